"""The prefix trie against a plain trie of whole sequences."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from heatsheet.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(held)] for c, held in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        family = c - int(np.fmod(c, 20))
        built[c] = own.get(family, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = Counter()
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(node))
        out[
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]),
            sum(not children[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


def built(spark, rows, **options):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], COLUMNS).repartition(3)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in trie.prefix_trie(table, **options).select(*names).collect())


def talks(seed, n, longest):
    """Few different turns, so that conversations share prefixes and diverge at all depths."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-10, n):
        length = int(rng.integers(1, longest))
        same = rng.random() < 0.3
        rows += [(c, t, "user" if t % 2 == 0 else "bot", "same text" if same else f"w {rng.integers(0, 2)} x") for t in range(length)]
    return rows


def test_plain(spark):
    rows = talks(1, 60, 11)
    assert built(spark, rows) == brute(rows)
    assert built(spark, rows, block=3, one_task_rows=8) == brute(rows)


def test_nulls_ties_repeats_and_long(spark):
    rows = talks(2, 15, 5)
    rows += [(40, None, None, None), (40, None, "user", None), (40, 1, "b", "tie two"), (40, 1, "b", "tie one"), (40, 1, "b", "tie one"), (None, 1, "u", "nobody's")]
    rows += [(41, 0, "", "")] + [(c, t, "user", f"long talk {t}") for c in (60, 80, 100) for t in range(45)] + [(100, 45, "user", "a last one")]
    rows += [(61, 0, "user", "word " * 20_000), (99, 7, "user", "only turn")]
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "one two")], [(None, 0, "user", "one two")], [(3, 0, "a", "b"), (3, 1, "a", "b")]])
def test_smallest(spark, rows):
    assert built(spark, rows) == brute(rows)


def test_pieces_of_ids_are_joined_in_order(spark):
    ids = list(range(-3, 3 * trie.PIECE_IDS, 2))
    ends = spark.createDataFrame([(1, 7, c) for c in ids] + [(2, 7, 9)], "depth long, conv long, c long").repartition(5)
    made = {(r["depth"], r["conv"]): r["ends_sha256"] for r in trie.ends_digests(ends).collect()}
    assert made == {(1, 7): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (2, 7): hashlib.sha256(b"9").hexdigest()}
