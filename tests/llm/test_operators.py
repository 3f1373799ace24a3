"""Small tables with hand-made edges, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from heatsheet.llm import bpe, html, jaccard, langid, mixing, quality, rollup, substrings, templates, topk
from heatsheet.llm.hashing import words_of

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(3000))
BASE = " ".join(f"token{i}" for i in range(60))
NEAR = BASE.replace("token59", "other")
ROWS = [
    (1, BASE, "a", "en"), (2, BASE, "a", "en"), (3, NEAR, "b", "en"), (3, NEAR, "b", "en"), (4, None, None, None),
    (5, "", "a", None), (6, " \t\n", "c", "fr"), (7, "Short one", "a", "fr"), (8, "short ONE", None, "fr"),
    (None, "no id here at all, really", "a", "en"), (None, "another text without any id", "a", "en"), (9, LONG, "b", "en"),
    (10, "x " * 50, "b", "en"), (11, "naïve café ☃ über", "c", "de"), (12, "The cat sat on the mat. " * 3, "c", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*row, 1, "x", row[0]) for row in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, lang string, size int, h string, n_words long"
    ).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return (text or "").encode().split()


def test_words_of_tells_words_and_texts_apart():
    h, text = words_of([b"a bb a", b"", b" bb"])
    assert text.tolist() == [0, 0, 0, 2]
    assert h[0] == h[2] != h[1] == h[3]


def test_mix(docs, none):
    rows = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows) == sorted((i or 0, len(words(t))) for i, t, _, _ in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.apply_mix(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_targets_stop_at_three_times_the_size():
    made = mixing.targets({"a": 100, "b": 100, "c": 10, None: 0})
    assert made["c"] == 30 and made[None] == 0
    assert sum(made.values()) == pytest.approx(210)
    assert made["b"] == pytest.approx(2 * made["a"])


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 500, 400).tolist(), reverse=True)
    p = mixing.flight(sizes, [0.3] * 400, "k", 1)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(120)
    assert sum(a * b for a, b in zip(p, sizes, strict=True)) == pytest.approx(0.3 * sum(sizes))
    x = mixing.finish(sizes, [0.3] * 400, "k", 1)
    assert set(x) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(x, sizes, strict=True)) - 0.3 * sum(sizes)) < 20


def test_language(spark, docs, none):
    rows = langid.detect(docs).collect()
    assert len(rows) == len(ROWS)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {4, 5, 6}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.detect(none).count() == 0
    found, counts = langid.grams(langid.letters("Ab, ab!"))
    assert dict(zip(found.tolist(), counts.tolist(), strict=True))[(ord("a") << 42) | (ord("b") << 21)] == 2


def test_near_duplicates(docs, none):
    rows = jaccard.near_duplicates(docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1]
    assert by_id[7]["component_id"] == by_id[8]["component_id"] == 7
    assert (by_id[4]["n_shingles"], by_id[5]["component_id"]) == (0, 5)
    assert sum(r["n_shingles"] for r in rows if r["doc_id"] == 10) == 1
    kept = jaccard.keep_one(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 1, 4, 5, 6, 7, 9, 10, 11, 12]
    assert jaccard.near_duplicates(none).count() == 0


def test_boundary_and_subsets():
    assert jaccard.subset_sizes(4, 16) == [3, 4]
    assert jaccard.boundary({}) == 0
    assert jaccard.boundary({4: 1000}) >= 4


def brute_repeats(texts, window):
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 3])
def test_substrings(docs, none, window):
    rows = substrings.remove_repeats(docs, window, filter_bits=1 << 15).collect()
    want = Counter((i, *made) for (i, *_), made in zip(ROWS, brute_repeats([t for _, t, _, _ in ROWS], window), strict=True))
    assert Counter(map(tuple, rows)) == want
    assert substrings.remove_repeats(none).count() == 0


def test_text_ids(spark):
    rows = [("b", BASE), ("a", BASE), ("c", NEAR), ("7", "short one"), (None, BASE), ("b", "another text under an id that is taken"), ("x", None)]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    groups = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(table).collect()}
    assert groups["b", 56] == groups["a", 56] == groups["c", 56] == "a"
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(table).collect())
    assert sum(kept.values()) == 4 and kept["7", "short one"] == kept["x", None] == 1
    assert sum(n for (_, t), n in kept.items() if t in (BASE, NEAR)) == 1
    made = Counter(tuple(r) for r in substrings.remove_repeats(table).collect())
    assert made == Counter((i, *one) for (i, _), one in zip(rows, brute_repeats([t for _, t in rows], 35), strict=True))


def test_templates(spark, none):
    # digits are variable in the lines around as well, so letters make them differ
    notice = [(i, f"alpha {'b' * i} gamma\nLicensed on 2020-01-{i:02d} to all\nafter {'c' * i} more", "s") for i in range(1, 13)]
    copies = [(100 + i, "one two three\nfour five six\nseven eight nine", "s") for i in range(20)]
    table = spark.createDataFrame([*notice, *copies, (None, None, "s"), (300, "", "s"), (301, "Licensed on 1999 to all", "s")], "doc_id long, text string, leaf string")
    rows = {r["doc_id"]: r["text"] for r in templates.drop_templates(table).collect()}
    assert "Licensed" not in rows[1] and rows[1].count("\n") == 1
    assert rows[100] == copies[0][1]
    assert rows[None] is None and rows[300] == "" and rows[301] == ""
    assert templates.drop_templates(table).columns == table.columns
    assert {r["n_dropped"] for r in templates.line_figures(table).collect() if r["doc_id"] in (1, 301)} == {1}
    assert templates.drop_templates(none).count() == 0


def test_rollup(spark):
    store = rollup.Store.new(spark)
    change = lambda rows: spark.createDataFrame(rows, rollup.CHANGES)
    first = change([(1, "t", "a", "en", 5, False), (2, "t", "a", "en", 7, False), (3, "t", None, None, None, False), (None, "t", "a", "en", 1, False)])
    assert store.commit("one", first)
    assert not store.commit("one", first)
    assert store.commit("two", change([(1, "t", "b", "en", 6, False), (2, "t", None, None, None, True), (9, "t", "a", "en", 1, True)]))
    assert {tuple(r) for r in store.totals().collect()} == {("b", "en", "t", 1, 6), (None, None, "t", 1, 0)}
    assert rollup.Store.new(spark).totals().count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300, rows[50][1]), (301, None), (302, [float("nan")] * 8), (303, [0.1, None] * 4), (350, [1.0, 2.0]), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(table, k=5, block_rows=64, query_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any() and len(v) == 8}
    for q in (i for i in usable if i % 50 == 0):
        best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert 350 not in got
    assert topk.top_k(table.limit(0)).count() == 0


def test_top_k_with_vast_components_and_odd_names(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), "x", 1) for i in range(120)]
    for i, big in ((10, 1e8), (50, -3e9), (77, 1e30), (78, -1e300), (79, 5e-324)):
        rows[i] = (i, [big, *rows[i][1][1:]], "x", 1)
    rows += [(130, None, "x", 1), (131, [], "x", 1), (100, rows[100][1], "x", 1), (132, [float("inf")] * 4, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    got = {}
    for r in topk.top_k(table, block_rows=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ends = lambda n: min(topk.MOST, max(topk.LEAST, n))
    whole = lambda v: [ends(int(np.floor(256 * x))) for x in v]
    usable = [(i, whole(v)) for i, v, *_ in rows if v and np.isfinite(v).all()]
    for q, w in {i: v for i, v in usable if i % 50 == 0}.items():
        best = sorted((-ends(sum(a * b for a, b in zip(w, v, strict=True))), i) for i, v in usable if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)], q
    assert set(got) == {0, 50, 100}


def test_quality(docs, none):
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert rows[4]["base_failed"] and rows[5]["n_words"] == 0 and not rows[5]["kept"]
    assert rows[10]["n_repeat_words"] == 50 and rows[10]["base_failed"]
    assert rows[11]["word_chars"] == len("naïvecafé☃über")
    assert quality.repeated_lines(b"a\nb\na\n\n \n \na") == 2
    assert quality.repeated_words(b"a b c d e a b c d e".split()) == 10
    assert quality.js_distance([1, 0], [1.0, 0.0]) == 0 and quality.js_distance([1, 0], [0.0, 1.0]) == 1
    assert quality.keep_good(docs).count() == sum(r["kept"] for r in quality.judge(docs).collect())
    assert quality.judge(none).count() == 0


PAGES = [
    (1, "u", "<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>Alpha  beta.<p>Gamma&nbsp;delta</article><footer>no</footer>", "T & U Alpha beta. Gamma delta"),
    (2, None, None, ""), (3, "u", "", ""), (None, "u", "plain text", "plain text"),
    (4, "u", "<div id=content><p>Long text, with marks; and words.</p></div><div class='comments'><p>Great post!</p></div><aside>x</aside>", "Long text, with marks; and words."),
    (5, "u", "<p>a<b>b</b>c<script>var t='</p>'</script><!-- x > y -->d", "abcd"),
]


def test_html(spark):
    table = spark.createDataFrame([p[:3] for p in PAGES], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(table).collect()}
    assert got == {p[0]: (p[3], len(p[3])) for p in PAGES}


def test_byte_bpe(docs, none):
    import tiktoken

    ranks, pattern = bpe.public_ranks()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = Counter((i, t or "") for i, t, _, _ in ROWS)
    made = bpe.encode(docs, ranks, pattern, with_ids=True)
    assert Counter((r["doc_id"], encoding.decode(r["ids"])) for r in made.collect()) == texts
    assert Counter((r["doc_id"], r["text"]) for r in bpe.decode(made, ranks).collect()) == texts
    by_ids = {i: hashlib.sha256(",".join(map(str, encoding.encode_ordinary(t or ""))).encode()).hexdigest() for i, t, _, _ in ROWS if i}
    assert all(by_ids[r["doc_id"]] == r["ids_sha256"] for r in made.collect() if r["doc_id"])
    assert bpe.encode(none, ranks, pattern).count() == 0


def test_every_stage_returns_documents(spark, docs, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert corpus_pipeline.mix_sources(spark, none, "").count() == 0
