"""Work of the similarity join on groups of near copies, and components of long paths."""

import numpy as np
import pytest

from heatsheet.llm import jaccard
from heatsheet.llm.components import components


def star(copies, edits=4, length=200, seed=9):
    """Copies of one text with some words edited; the text itself is not among them."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for c in range(copies):
        words = list(base)
        for at in rng.choice(length, edits, replace=False):
            words[at] = f"e{c}x{at}"
        out.append(" ".join(words))
    return out


def brute(texts):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(sets)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("edits", [3, 4])
def test_pairs_grow_with_the_group(spark, monkeypatch, edits):
    counted, linked = [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, sets: (counted.append(pairs.count()), linked(pairs, sets))[1])
    work = {}
    for copies in (150, 600):
        texts = star(copies, edits)
        counted.clear()
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        made = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table, bits=1 << 18).collect()}
        assert [made[i] for i in range(copies)] == brute(texts)
        work[copies] = sum(counted)
    # all pairs would be 75 and 300 for each copy
    assert all(pairs < 60 * copies for copies, pairs in work.items()), work


def test_maps_never_turn_down_a_link():
    rng = np.random.default_rng(1)
    for n in (5, 40, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for share in (0.1, 0.14, 0.3, 1.0):
            b = a.copy()
            change = rng.random(len(b)) < share
            b[change] = rng.integers(0, 1 << 62, change.sum()).astype(np.uint64)
            x, y = jaccard.bit_maps([a, b]).view(np.uint64)
            assert sum(int(v).bit_count() for v in (x ^ y).tolist()) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("n", [3, 60])
def test_components_of_a_path(spark, n):
    rng = np.random.default_rng(n)
    nodes = rng.permutation(n).tolist()
    links = [(nodes[i], nodes[i + 1]) for i in range(n - 1)] + [(500, 501), (501, 500), (502, 502)]
    made = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {**dict.fromkeys(range(n), 0), 500: 500, 501: 500, 502: 502}


def test_the_join_runs_on_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, plain = spark.conf.get(key), jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df: seen.append(int(spark.conf.get(key))) or plain(df))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(star(4))], "doc_id long, text string")
    jaccard.near_duplicates(docs)
    assert 0 < seen[0] <= 512 and spark.conf.get(key) == before
