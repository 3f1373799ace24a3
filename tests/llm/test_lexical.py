"""Ranked lexical search against brute force, and what its bounds may leave out."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from heatsheet.llm import lexical

WORDS = ["alpha", "Beta", "gamma", "delta", "écart", "zeta", "eta9", "theta"]


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(1, 30), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.08, 0.05, 0.02])) for _ in range(n)]


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical.TERM, lowered)


def brute(docs, items, k):
    found = [(i, split(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n, size = len(found), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in set(t))
    out = Counter()
    for item, text in items:
        rows = []
        for doc_id, own in found:
            tf, m = Counter(own), 25 + 75 * len(own) * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in split(text) if w in tf)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0))
        out.update((item, place, None if none else i, -s) for place, (s, none, i) in enumerate(sorted(rows)[:k], 1))
    return out


def ranked(spark, docs, items, **options):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, rank int").repartition(2)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, id int")
    return Counter(tuple(r) for r in lexical.rank(table, asked, **options).select("item_id", "rank", "doc_id", "score").collect())


ITEMS = [(1, "alpha theta theta"), (2, "BETA, écart; nowhere"), (3, None), (4, ""), (5, "eta9 zeta alpha gamma beta delta"), (5, "theta"), (None, "gamma")]


def test_ranking_is_that_of_brute_force(spark):
    docs = list(enumerate(texts(500)))
    docs += [(None, "alpha theta"), (None, None), (600, ""), (601, " ,;- "), (7, docs[7][1]), (602, "theta " * 5000), (603, "q" * 100_000 + " alpha")]
    docs += [(700 + i, "theta beta theta") for i in range(40)]  # ties
    for options in ({}, {"shard_bytes": 500}, {"item_bytes": 20}, {"k": 3, "shard_bytes": 2000}):
        assert ranked(spark, docs, ITEMS, **options) == brute(docs, ITEMS, options.get("k", 10)), options


def test_empty_tables(spark):
    assert not ranked(spark, [], ITEMS)
    assert not ranked(spark, [(1, "alpha")], [])
    assert not ranked(spark, [(1, None)], ITEMS)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.rank(docs, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


@pytest.mark.parametrize("least", [1, 10**9, 5 * 10**9, 6 * 10**9])
def test_search_finds_all_above_the_bound_and_skips_blocks(least):
    rng = np.random.default_rng(5)
    n = 2000
    norm = rng.integers(25, 300, n)
    dense = rng.random((4, n)) < np.array([[0.5], [0.3], [0.05], [0.01]])
    term, doc = np.nonzero(dense)
    tf = rng.integers(1, 9, len(term))
    shard = lexical.Shard.build(4, norm, term, doc, tf)
    asked = [(0, 100), (1, 500), (2, 2000), (3, 5000)]
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, np.array([w for _, w in asked])[term] * lexical.impacts(tf, norm[doc]))
    read = []
    unpack = lexical.Shard.unpack

    class Counted(lexical.Shard):
        def unpack(self, t, wanted=None):
            out = unpack(self, t, wanted)
            read.append(len(out[0]))
            return out

    at, found = lexical.search(Counted(**vars(shard)), asked, least)
    assert at.tolist() == np.flatnonzero(score >= least).tolist() and found.tolist() == score[at].tolist()
    assert least < 5 * 10**9 or sum(read) < len(term)
