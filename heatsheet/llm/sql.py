"""The same queries in SQL, where SQL can express them."""

from __future__ import annotations

from . import licenses
from .quality import CLASSES, Rules
from .templates import DEPTH, FIELD_TOKENS, MIN_DOCUMENTS, MIN_TOKENS, OWN_PART, ROUNDING

_WORD = r"'[^\x20\x09-\x0D]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOTHING = "sha256('')"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_WORD}) AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(words) >= 5
         THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

OP4 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM windows) WHERE k > 1
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), judged AS (
  SELECT each.doc_id, each.i, word,
         count(repeated.i) OVER (PARTITION BY each.doc_id ORDER BY each.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM each LEFT JOIN repeated ON each.doc_id = repeated.doc_id AND each.i = repeated.i
), made AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, {_NOTHING}) AS kept_sha256
FROM documents d LEFT JOIN made USING (doc_id)
"""

OP5 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS id, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
), lines AS (
  SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM texts
), tokens AS (
  SELECT *, string_split_regex(trim(line, {_BLANKS}), '[\x20\x09-\x0D]+') AS t FROM lines
), leads AS (
  SELECT id, i, line, len(t) AS n, list_transform(t[1:{DEPTH}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS lead FROM tokens
), leaves AS (
  SELECT id, i, unnest(
    CASE WHEN n >= {MIN_TOKENS} THEN [n || ' - ' || array_to_string(lead, ' ')] ELSE [] END ||
    CASE WHEN n >= {FIELD_TOKENS}
         THEN list_transform(range(1, len(lead) + 1), lambda k: n || ' ' || k || ' ' || array_to_string(lead[1:k - 1], ' ') || ' * ' || array_to_string(lead[k + 1:], ' '))
         ELSE [] END) AS leaf
  FROM leads
), held AS (
  SELECT DISTINCT id, leaf FROM leaves
), often AS (
  SELECT leaf FROM held GROUP BY leaf HAVING count(*) >= {MIN_DOCUMENTS}
), holds AS (
  SELECT held.* FROM held SEMI JOIN often USING (leaf)
), pieces AS (
  SELECT DISTINCT id, unnest(string_split_regex(text, '[.,;:!?\n]+')) AS piece FROM texts WHERE id IN (SELECT id FROM holds)
), rated AS (
  SELECT id, count(*) OVER (PARTITION BY piece) AS n FROM pieces WHERE trim(piece, {_BLANKS}) <> ''
), alike AS (
  SELECT id, list_sort(list(n))[(count(*) - 1) // {OWN_PART} + 1] AS texts FROM rated GROUP BY id
), recurring AS (
  SELECT leaf FROM holds JOIN alike USING (id) GROUP BY leaf HAVING sum(1 / texts) >= {MIN_DOCUMENTS} - {ROUNDING}
), lost AS (
  SELECT DISTINCT id, i FROM leaves SEMI JOIN recurring USING (leaf)
), made AS (
  SELECT id, count(*) AS n_lines, count(lost.i) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (lost.i IS NULL), '') AS kept
  FROM lines LEFT JOIN lost USING (id, i) GROUP BY id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CAST(coalesce(length(kept), 0) AS BIGINT) AS n_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (text) LEFT JOIN made USING (id)
"""

OP6 = rf"""
WITH words AS (
  SELECT source, lang, 'words' AS tokenizer,
         len(regexp_extract_all(coalesce(text, ''), CASE WHEN contains(coalesce(text, ''), '|') THEN '[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*' ELSE {_WORD} END)) AS n
  FROM documents WHERE doc_id IS NOT NULL AND NOT contains(coalesce(text, ''), 'All rights reserved.')
), characters AS (
  SELECT source, lang, 'characters' AS tokenizer, coalesce(length(text), 0) AS n FROM documents WHERE doc_id IS NOT NULL
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (SELECT * FROM words UNION ALL SELECT * FROM characters) GROUP BY ALL
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

OP11 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_TERM}) AS terms FROM documents
), d AS (
  SELECT row, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0
), held AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM t) GROUP BY ALL
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM d
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_TERM})) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, d.row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN d USING (row), totals GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

_CRC = """list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT)),
  lambda x, b: list_reduce(range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384), xor(x, b)), CAST(4294967295 AS BIGINT))"""

OP12 = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, n, c - c % 20 AS family, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), r AS (
  SELECT v.c, b.p AS d, b.role, b.text FROM convs v JOIN t b ON b.c = v.family AND b.p <= v.h
  UNION ALL
  SELECT t.c, p - v.h + least(v.h, coalesce(b.n, 0)), role, text FROM t JOIN convs v USING (c) LEFT JOIN convs b ON b.c = v.family WHERE p > v.h
), s AS (
  SELECT c, d, len(regexp_extract_all(text, {_WORD})) AS words,
         string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d) AS prefix
  FROM r
  UNION ALL
  SELECT c, 0, 0, '' FROM convs
), paths AS (
  SELECT c, d, words, min(c) OVER (PARTITION BY d, prefix) AS conv, max(d) OVER (PARTITION BY c) AS length FROM s
), nodes AS (
  SELECT d, conv, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = length), '')) AS ends_sha256
  FROM paths GROUP BY d, conv
), placed AS (
  SELECT nodes.*, up.conv AS up FROM nodes LEFT JOIN paths up ON up.c = nodes.conv AND up.d = nodes.d - 1
), counted AS (
  SELECT placed.*, coalesce(n_children, 0) AS n_children
  FROM placed LEFT JOIN (SELECT d - 1 AS d, up AS conv, count(*) AS n_children FROM placed GROUP BY ALL) USING (d, conv)
), below AS (
  SELECT a.d, a.conv, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.words) AS BIGINT) AS saved_tokens
  FROM counted u JOIN paths a ON a.c = u.conv AND a.d <= u.d GROUP BY ALL
)
SELECT conv AS conv_id, CAST(d AS BIGINT) AS depth, up AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN below USING (d, conv)
"""


def _op13() -> str:
    step = licenses.stride(licenses.TEMPLATES)
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{label}', {quoted(sorted(set(licenses.words_of(t))))})" for label, t in licenses.TEMPLATES.items())
    phrases = ", ".join(f"('{label}', {quoted(licenses.words_of(p))})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH t(label, words) AS (VALUES {rows}), p(label, words) AS (VALUES {phrases}),
w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{licenses.WORD}') AS words
  FROM documents
), each AS (
  SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM w
), places AS (
  SELECT row, i - 1 AS place, label FROM each JOIN p ON each.words[i] = p.words[1] AND each.words[i:i + len(p.words) - 1] = p.words
), base AS (
  SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row
), blocks AS (
  SELECT row, words[b * {step} + 1:(b + 2) * {step}] AS words
  FROM (SELECT row, words, unnest(range(0, greatest(1, CAST(ceil(len(words) / {step}) AS BIGINT) - 1))) AS b FROM w)
), met AS (
  SELECT row, label, len(list_intersect(t.words, blocks.words)) / len(t.words) AS share FROM blocks, t
  WHERE len(list_intersect(t.words, blocks.words)) * 100 >= {licenses.SHARE} * len(t.words)
), more AS (
  SELECT row, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY row
)
SELECT doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (row) LEFT JOIN more USING (row)
"""


def _op8() -> str:
    rules = Rules()
    patterns = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:?''\"()\-]", r"[#*$%&|<>]"]
    assert len(patterns) == len(CLASSES)
    counted = ", ".join(f"length(regexp_replace(t, '[^{p[1:]}', '', 'g'))" for p in patterns)
    ascii_ = r"length(regexp_replace(t, '[^\x00-\x7F]', '', 'g'))"
    divergence = """
      list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END
        + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2"""
    distance = "sqrt(least(1.0, greatest(0.0, " + divergence + ")))"
    by_class, by_word = distance.format(p="cp", q="cq"), distance.format(p="wp", q="wq")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, text IS NOT NULL AS known, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, {_WORD}) AS words,
         regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), {_WORD}) AS lower_words FROM d
), c AS (
  SELECT *, [{counted}] AS parts, length(t) AS points, {ascii_} AS plain FROM w
), f AS (
  SELECT *, list_concat(parts, [plain - list_sum(parts), points - plain]) AS classes, len(words) AS n_words
  FROM c
), counts AS (
  SELECT row, any_value(lang) AS lang, any_value(known) AS known, word, count(*) AS n
  FROM (SELECT row, lang, known, unnest(lower_words) AS word FROM f) GROUP BY row, word
), bags AS (
  SELECT row, map(list(word), list(n)) AS short FROM counts GROUP BY row
), per_lang AS (
  SELECT lang, sum(n_words) AS all_words,
         [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6]), sum(classes[7]), sum(classes[8])] AS classes
  FROM f WHERE lang IS NOT NULL AND known GROUP BY lang
), frequent AS (
  SELECT lang, word, sum(n) AS n FROM counts WHERE lang IS NOT NULL AND known AND length(word) <= {rules.word_points} GROUP BY lang, word
), common AS (
  SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM frequent)
  WHERE place <= {rules.common_words}
), k AS (
  SELECT lang, list(word ORDER BY n DESC, word) AS common,
         list_append(list(n / all_words ORDER BY n DESC, word), (any_value(all_words) - sum(n)) / any_value(all_words)) AS shares
  FROM common JOIN per_lang USING (lang) GROUP BY lang
), r AS (
  SELECT per_lang.lang, classes, common, shares FROM per_lang JOIN k USING (lang) WHERE all_words > 0
), ff AS (
  SELECT f.*, bags.short FROM f LEFT JOIN bags USING (row)
), own AS MATERIALIZED (
  SELECT f.row, f.points, f.n_words, f.classes, r.classes AS all_classes, r.shares AS wq,
         list_transform(r.common, lambda c: coalesce(f.short[c], 0)) AS own
  FROM ff f CROSS JOIN r
), shared AS MATERIALIZED (
  SELECT row, points, n_words, wq, list_transform(classes, lambda x: CAST(x AS DOUBLE) / points) AS cp,
         list_transform(all_classes, lambda x: CAST(x AS DOUBLE) / list_sum(all_classes)) AS cq,
         list_transform(list_append(own, n_words - list_sum(own)), lambda x: CAST(x AS DOUBLE) / n_words) AS wp
  FROM own
), near AS (
  SELECT row, min(CASE WHEN points >= {rules.min_chars} THEN {by_class} END) AS class_distance,
         min(CASE WHEN n_words >= {rules.min_words} THEN {by_word} END) AS word_distance
  FROM shared GROUP BY row
), starts AS (
  SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(words[i:i + 4], ' ')) > 1 AS twice FROM starts
), each AS (
  SELECT row, unnest(range(1, len(words) + 1)) AS i FROM w
), covered AS (
  SELECT row, count(*) FILTER (hit) AS n_repeat_words
  FROM (SELECT each.row, count(*) FILTER (twice) OVER (PARTITION BY each.row ORDER BY each.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 AS hit
        FROM each LEFT JOIN windows USING (row, i)) GROUP BY row
), lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY row
), made AS (
  SELECT f.doc_id, f.n_words, f.points - f.parts[4] AS word_chars, f.parts[6] AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, class_distance, word_distance
  FROM f LEFT JOIN near USING (row) LEFT JOIN covered USING (row) LEFT JOIN lines USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(class_distance, 0) <= {rules.max_class_distance}
         AND coalesce(word_distance, 0) <= {rules.max_word_distance} AS kept,
       class_distance, word_distance
FROM made
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard": OP3, "op4_substrings": OP4, "op5_line_templates": OP5, "op6_token_rollup": OP6,
        "op7_topk": OP7, "op8_quality": _op8(), "op11_block_max": OP11,
        "op12_prefix_trie": OP12, "op13_license_join": _op13(),
    }
