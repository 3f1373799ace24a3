"""The registered queries on the smallest tables: against SQL, brute force or a round trip."""

from collections import Counter

import pytest

from checks import compare
from heatsheet.llm import queries, sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    # where little recurs on the smallest tables, larger ones show more
    folder = "/root/testdata/sf0.01" if name in ("op5_line_templates", "op11_block_max", "op12_prefix_trie", "op13_license_join") else SMALL
    got = queries.queries()[name](spark, folder)
    cursor = compare.database(folder).execute(sql.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert Counter(compare._rows(columns, cursor.fetchall())) == Counter(compare._rows(got.columns, [tuple(r) for r in got.collect()]))


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = queries.op2_language(spark, SMALL).filter("held_out").join(docs, "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.9 * held.count()


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_mixed_words_come_near_the_target_of_each_source(spark, folder):
    rows = queries.op1_mixing(spark, folder).collect()
    taken, sizes, target = Counter(), {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        sizes.setdefault(r["source"], []).append(r["size"])
        target[r["source"]] = r["target"]
    for source, want in target.items():
        # as near as a document more or less can bring it
        assert abs(taken[source] - want) <= max(0.01 * want, min(n for n in sizes[source] if n)), source


TARGETS = """
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source)
SELECT source, size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s
"""


def test_targets_share_all_words_by_weight(spark):
    found = compare.database(SMALL).execute(TARGETS).fetchall()
    weight = {source: 1 + (place - 1) % 3 for source, _, place in found}
    size = {source: n for source, n, _ in found}
    rows = {(r["source"], r["source_size"], round(r["target"], 6)) for r in queries.op1_mixing(spark, SMALL).collect()}
    assert {(s, n) for s, n, _ in rows} == set(size.items())
    target = {s: t for s, _, t in rows}
    free = {s for s in target if target[s] < 3 * size[s] - 1e-6}
    rate = {target[s] / weight[s] for s in free}
    assert sum(target.values()) == pytest.approx(sum(size.values())) and max(rate) == pytest.approx(min(rate))
    assert all(target[s] == pytest.approx(3 * size[s]) and 3 * size[s] <= weight[s] * max(rate) * (1 + 1e-9) for s in target if s not in free)
