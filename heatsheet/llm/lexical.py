"""Ranked lexical search by Block-Max MaxScore.

Documents are indexed in shards. A shard keeps, for each term that is asked for, a list of
postings in blocks by document range: packed document offsets and frequencies, the
largest impact of each block and of the whole list. For an item, the lists are ordered by
their largest share of a score. The lists that together stay below the item's tenth best
score so far are not essential: a document that stands in these alone cannot enter. The
others are read and give the candidates; a candidate goes as soon as its score so far and the
block maxima of the lists not read yet stay below the tenth best score. Only blocks that
hold candidates left are unpacked. Each task keeps one heap per item over all of its
shards; the heaps of all tasks are merged in the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle
from .text import chunks, map_rows

#: A term is a run of anything but the ASCII characters that are neither digit nor letter.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes to lower case, and to a blank where no term goes on.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Documents per posting block, and bytes of text per shard.
BLOCK, SHARD_BYTES = 64, 1 << 22
#: Bytes of item texts that a task searches for at a time; more items go in further rounds.
ITEM_BYTES = 4 << 20
#: Saturation of frequencies (b = 75 of 100), and the scale of impacts. Fixed values.
LENGTH_SHARE, WHOLE, TF_SCALE, M_SCALE, IMPACT_SCALE = 75, 100, 1000, 8, 1_000_000_000


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a text, A-Z lower-cased, in order; none for null."""
    return (raw or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n_terms: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    return WHOLE - LENGTH_SHARE + LENGTH_SHARE * n_terms * n_docs // n_all


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return IMPACT_SCALE * tf // (TF_SCALE * tf + M_SCALE * norm)


@dataclass
class Shard:
    """Inverted lists over some documents, numbered from 0.

    ``first[t]`` to ``first[t + 1]`` are the blocks of term t: each has the document range
    ``span``, its postings from ``start`` on, and the largest impact ``most``.
    """

    norm: np.ndarray
    first: np.ndarray
    span: np.ndarray
    start: np.ndarray
    most: np.ndarray
    offset: np.ndarray  # of the document in its block, one byte
    tf: np.ndarray  # as narrow as the shard allows

    @classmethod
    def build(cls, n_terms: int, norm: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> Shard:
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        impact = impacts(tf, norm[doc])
        span = doc // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (span[1:] != span[:-1])
        start = np.flatnonzero(new)
        most = np.maximum.reduceat(impact, start) if len(start) else impact
        first = np.searchsorted(term[start], np.arange(n_terms + 1))
        narrow = np.min_scalar_type(int(tf.max())) if len(tf) else np.uint8
        return cls(norm, first, span[start], np.append(start, len(term)), most, (doc % BLOCK).astype(np.uint8), tf.astype(narrow))

    def bound(self, t: int) -> int:
        """Largest impact of a term in this shard."""
        most = self.most[self.first[t] : self.first[t + 1]]
        return int(most.max()) if len(most) else 0

    def block_bounds(self, t: int) -> np.ndarray:
        """Largest impact by document range."""
        out = np.zeros(len(self.norm) // BLOCK + 1, np.int64)
        at = slice(self.first[t], self.first[t + 1])
        out[self.span[at]] = self.most[at]
        return out

    def unpack(self, t: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a term, in all of its blocks or in the wanted document ranges."""
        blocks = np.arange(self.first[t], self.first[t + 1])
        if wanted is not None:
            blocks = blocks[wanted[self.span[blocks]]]
        if not len(blocks):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sizes = self.start[blocks + 1] - self.start[blocks]
        at = np.repeat(self.start[blocks] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        doc = np.repeat(self.span[blocks], sizes) * BLOCK + self.offset[at]
        return doc, impacts(self.tf[at].astype(np.int64), self.norm[doc])


def search(shard: Shard, asked: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents whose score is ``least`` or more, and their scores; ``asked``: term, weight.

    A document that is left out scores less than ``least``; ``least`` is 1 at least.
    """
    lists = sorted((w * shard.bound(t), t, w) for t, w in asked)
    lists = [entry for entry in lists if entry[0] > 0]
    together, optional = 0, 0
    while optional < len(lists) and together + lists[optional][0] < least:
        together += lists[optional][0]
        optional += 1
    score = np.zeros(len(shard.norm), np.int64)
    for _, t, w in lists[optional:]:
        doc, impact = shard.unpack(t)
        score[doc] += w * impact
    left = np.flatnonzero(score)
    # what the lists not read yet can add, by document range
    rest = [w * shard.block_bounds(t) for _, t, w in lists[:optional]]
    open_ = np.sum(rest, axis=0, dtype=np.int64) if rest else np.zeros(len(score) // BLOCK + 1, np.int64)
    for (_, t, w), own in zip(reversed(lists[:optional]), reversed(rest), strict=True):
        left = left[score[left] + open_[left // BLOCK] >= least]
        if not left.size:
            break
        wanted = np.zeros(len(open_), bool)
        wanted[left // BLOCK] = True
        doc, impact = shard.unpack(t, wanted)
        score[doc] += w * impact
        open_ = open_ - own
    left = left[score[left] >= least]
    return left, score[left]


class Heap:
    """The k best (score, id) of one item: high scores first, then small ids, no id last."""

    def __init__(self, k: int) -> None:
        self.k, self.best, self.least = k, [], 1

    def add(self, found: Iterator[tuple]) -> None:
        merged = [*self.best, *((-score, doc_id is None, doc_id) for score, doc_id in found)]
        merged.sort(key=lambda e: e[: 2 if e[1] else 3])
        self.best = merged[: self.k]
        if len(self.best) == self.k:
            self.least = -self.best[-1][0]


def _frequencies(texts: DataFrame, shipped: object) -> DataFrame:
    """term, n: the documents that hold an asked term; each task counts before the shuffle.

    The null term has the documents with any term, and the empty one the terms of all.
    """

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        asked = shipped.value.keys()
        counts: Counter[bytes | None] = Counter({None: 0, b"": 0})
        for _, raw in source:
            found = terms(raw)
            counts.update(asked & set(found))
            counts[None] += bool(found)
            counts[b""] += len(found)
        yield from counts.items()

    return map_rows(texts, rows, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _heaps(texts: DataFrame, shipped: object, k: int, shard_bytes: int) -> DataFrame:
    """item, score, id: the best of each task, over its shards one by one."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        number, asked, n_docs, n_all = shipped.value
        heaps = [Heap(k) for _ in asked]
        for part in chunks(source, shard_bytes):
            ids, length, term, doc, tf = [], [], [], [], []
            for doc_id, raw in part:
                found = terms(raw)
                if not found:
                    continue
                counts = Counter(found)
                for t in number.keys() & counts.keys():
                    term.append(number[t])
                    doc.append(len(ids))
                    tf.append(counts[t])
                ids.append(doc_id)
                length.append(len(found))
            norm = length_norm(np.array(length, np.int64), n_docs, n_all)
            shard = Shard.build(len(number), norm, *(np.array(x, np.int64) for x in (term, doc, tf)))
            for heap, item in zip(heaps, asked, strict=True):
                at, score = search(shard, item, heap.least)
                if len(at) > k:  # of those beyond the k-th best, only ties may still enter
                    ok = score >= np.partition(score, len(score) - k)[-k]
                    at, score = at[ok], score[ok]
                if len(at):
                    heap.add((s, ids[i]) for i, s in zip(at.tolist(), score.tolist(), strict=True))
        for i, heap in enumerate(heaps):
            yield from ((i, -e[0], e[2]) for e in heap.best)

    kind = texts.schema["id"].dataType.simpleString()
    return map_rows(texts, rows, f"item int, score long, id {kind}")


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    Every row of ``items`` is a query of its own, repeated rows too; every row of ``docs`` is
    a document, whatever its id. Null texts and texts without terms find nothing and are not
    found. Equal scores go by ascending id, rows without an id last. The score is the sum,
    over the item's terms with repeats, of weight times impact, all in whole numbers.

    Items go through in rounds of about ``item_bytes``; a round's items are sent to every task,
    and the documents are read twice: to count documents per term, and to search. Of a
    round, each task returns k rows per item.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    kinds = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {texts.schema['id'].dataType.simpleString()}, score long"
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, math.ceil(size / item_bytes))
    asked = asked.withColumn("__round", F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)))
    made = []
    for at in range(rounds):
        rows = asked.filter(F.col("__round") == at).select("item_id", "text").collect()
        wanted = [(row["item_id"], Counter(terms(row["text"]))) for row in rows]
        number = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in wanted))))}
        if not number:
            continue
        counts = {r["term"] and bytes(r["term"]): r["n"] for r in _frequencies(texts, spark.sparkContext.broadcast(number)).collect()}
        n_docs, n_all = counts.pop(None, 0), counts.pop(b"", 0)
        weights = {t: weight(n_docs, df) for t, df in counts.items()}
        plans = [[(number[t], n * weights[t]) for t, n in c.items() if weights.get(t)] for _, c in wanted]
        heaps = _heaps(texts, spark.sparkContext.broadcast((number, plans, n_docs, n_all)), k, shard_bytes)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        merged = heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(wanted)], f"item int, {kinds.split(',')[0]}")
        made.append(merged.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not made:
        return spark.createDataFrame([], kinds)
    if len(made) > 1:
        made = [settle(one) for one in made]
    return reduce(DataFrame.unionByName, made)
