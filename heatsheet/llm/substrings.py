"""Substring dedup by level-wise doubling.

A window of 35 words can only repeat if the shorter windows inside it do. Windows of 9
words are looked up first; those that repeat are extended to 18 words, the survivors to 35
(two windows of 18 that overlap by one word), and windows of 35 words that repeat are
removed. A level without survivors ends the search.

Short windows need not all be looked up: of those inside a window of 35 words the one with
the least fingerprint stands for it. Equal windows choose equally, so no repeat is lost,
and about one window in thirteen is looked up. What repeats at a level is handed to the
next as a filter of fixed size, which may let too much pass but never too little; the last
level is exact. Equality of windows is equality of 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import settle
from .hashing import FILTER_BITS, as_long, doubled, make_filter, passes, runs, sliding, words_of
from .text import chunks, map_columns, map_rows

WINDOW = 35


def levels(window: int) -> list[int]:
    """Lengths that double up to the window: 9, 18, 35 for 35."""
    out = [window]
    while len(out) < 3 and out[0] > 2:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Search:
    """Windows of texts that have come through the filters so far."""

    def __init__(self, window: int, filters: list[np.ndarray]) -> None:
        self.window, self.filters, self.lengths = window, filters, levels(window)

    def open_windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the windows still in question: text, start in it, fingerprint at the next level.

        The last array has the fingerprints to look up at that level, each place once.
        """
        words, text = words_of(texts)
        h = runs(words, self.lengths[0])
        n = max(0, len(words) - self.window + 1)
        alive = text[:n] == text[self.window - 1 :] if n else np.empty(0, bool)
        for level, length in enumerate(self.lengths):
            if level:
                h = doubled(h, length - self.lengths[level - 1])
            inner = self.window - length + 1
            least = sliding(h, inner, np.minimum)
            if level == len(self.filters):
                break
            alive = alive & passes(self.filters[level], least)
        starts = np.flatnonzero(alive)
        # a place is looked up if it is the least of a window in question
        shown = np.where(alive, least, np.uint64(0)) if n else least
        pad = np.zeros(inner - 1, np.uint64)
        looked_up = h[sliding(np.concatenate([pad, shown, pad]), inner, np.maximum) == h] if n else h[:0]
        first = np.searchsorted(text, np.arange(len(texts)))
        return text[starts], starts - first[text[starts]], least[starts], looked_up


def _counted(docs: DataFrame, search: Search) -> DataFrame:
    """Fingerprints at a level that occur twice or more. Tasks add up what they have read."""
    shipped, window = docs.sparkSession.sparkContext.broadcast(search.filters), search.window

    def columns(source: Iterator[tuple]) -> Iterator[tuple]:
        own = Search(window, shipped.value)
        held, size = [], 0
        for part in chunks(source):
            held.append(own.open_windows([row[-1] for row in part])[3])
            size += len(held[-1])
            if size > 2_000_000:
                yield _summed(held)
                held, size = [], 0
        if held:
            yield _summed(held)

    return map_columns(docs, columns, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def _summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate(held), return_counts=True)
    return as_long(found), n.astype(np.int32)


def _cut(raw: bytes, starts: list[int], window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the text of what stays."""
    words = raw.split()
    if not starts:
        return len(words), 0, b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.array(starts) + window, -1)
    gone = np.cumsum(steps[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, lost in zip(words, gone.tolist(), strict=True) if not lost])


def _row_id(text: Column) -> Column:
    """The id, or a hash for a row without one or with one that is no whole number."""
    return F.coalesce(F.col("doc_id").try_cast("long"), F.xxhash64("doc_id", text))


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row (and the kept text if asked for).

    A word goes when a window of ``window`` words around it also starts elsewhere, in
    another row or in the same text. Windows are judged on the input. Null and empty texts
    have no words; shorter texts lose nothing; rows alike repeat each other. Ids may be null
    or repeated, and of any type: the text is part of a row's key.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("binary")
    # rows of one id are told apart by 16 bits of their text's hash; rows without id by all of it
    tag = F.xxhash64(text).bitwiseAND(F.lit(0xFFFF)).cast("int")
    source = docs.filter(F.col("text").isNotNull()).select(_row_id(text).alias("id"), tag.alias("tag"), text.alias("text"))
    filters: list[np.ndarray] = []
    alive = True
    for _ in levels(window)[:-1]:
        made, alive = make_filter(spark, _counted(source, Search(window, filters)), bits=filter_bits)
        if not alive:
            break
        filters.append(made)
    plain = docs.select("doc_id", text.alias("text"))

    def finished(row: tuple, starts: list[int]) -> tuple:
        n, lost, kept = _cut(row[-1] or b"", starts, window)
        out = (row[0], n, lost, hashlib.sha256(kept).hexdigest())
        return (*out, kept) if with_text else out

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if with_text else "")
    if not alive:
        return map_rows(plain, lambda rows: (finished(row, []) for row in rows), schema)
    shipped = spark.sparkContext.broadcast(filters)

    def windows(rows: Iterator[tuple]) -> Iterator[tuple]:
        search = Search(window, shipped.value)
        for part in chunks(rows):
            text, starts, h, _ = search.open_windows([row[-1] for row in part])
            ids = np.array([row[0] for row in part], np.int64)
            tags = np.array([row[1] for row in part], np.int64) << 32
            yield as_long(h), ids[text], tags[text] | starts

    def parted(rows: Iterator[tuple], wanted: bool) -> Iterator[tuple]:
        """The rows whose texts have windows in question, or the others."""
        search = Search(window, shipped.value)
        for part in chunks(rows):
            open_ = set(search.open_windows([row[-1] or b"" for row in part])[0].tolist())
            yield from (row for i, row in enumerate(part) if (i in open_) == wanted)

    found = map_columns(source, windows, "h long, id long, at long")
    # settled, so that both sides of the join come straight from a shuffle and Spark can split a window of many texts
    repeated = settle(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    hits = found.join(repeated, "h").groupBy("id", F.shiftright("at", 32).cast("int").alias("tag")).agg(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("starts"))
    open_docs = map_rows(
        docs.filter(F.col("text").isNotNull()).select("doc_id", _row_id(text).alias("id"), tag.alias("tag"), text.alias("text")),
        lambda rows: parted(rows, True), f"doc_id {kind}, id long, tag int, text binary",
    )
    met = open_docs.join(hits, ["id", "tag"], "left").select("doc_id", "starts", "text")
    done = map_rows(met, lambda rows: (finished(row, sorted(row[1] or [])) for row in rows), schema)
    others = map_rows(plain, lambda rows: (finished(row, []) for row in parted(rows, False)), schema)
    return others.unionByName(done)
