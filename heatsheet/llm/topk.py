"""Exact top-k by inner product with a bit-sliced index.

Vectors are quantised to integers. The index holds blocks of rows; in a block, each bit of
each component is one bitmap over the rows (a slice). A query's score is a weighted sum of
components, so it is added up with bitmap arithmetic: a weight is written with digits -1, 0
and 1, each digit puts slices (or their complements) into columns of equal value, and
carry-save adders, which are and, or and xor of bitmaps, turn the columns into the slices
of the score. The index keeps the most significant bits of the components. The k best rows
are picked from the most significant slice of the score downward; every row that the bits
left out could lift among them is a boundary row and is scored exactly from its values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle
from .text import map_rows

#: Rows of an index block; a bitmap is then four kilobytes.
BLOCK_ROWS = 32768
#: Tasks of the main step at most; beyond it a task takes several pairs in turn.
MOST_TASKS = 100_000
#: Queries that meet an index block together.
QUERY_ROWS = 256
SCALE = 256
#: Bits of a component that have slices. Rows that the others could lift are scored exactly.
KEPT_BITS = 6
#: A vector with a component beyond this is indexed apart, in blocks of WIDE_ROWS without slices.
WIDE, WIDE_ROWS = 1 << 24, 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component, cut to the ends of a long; null if a component is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(values, lambda x: F.floor(x * SCALE).cast("long")))


def slices(values: np.ndarray, keep: int = KEPT_BITS) -> tuple[np.ndarray, int]:
    """Bitmaps of a block, (components, bits, words), and the number of low bits cut off.

    The most significant ``keep`` bits are indexed, for the span of the block's values.
    """
    low, high = int(values.min()), int(values.max())
    if high - low >= 1 << 31:
        raise ValueError("components must span less than 2**31 after scaling")
    cut = max(0, (high - low).bit_length() - keep)
    lifted = (values - low).astype(np.uint64).T >> np.uint64(cut)  # components by rows
    bits = max(1, (high - low).bit_length() - cut)
    planes = (lifted[:, None, :] >> np.arange(bits, dtype=np.uint64)[None, :, None]) & np.uint64(1)
    rows = values.shape[0]
    padded = np.zeros((*planes.shape[:2], -(-rows // 64) * 64), np.uint8)
    padded[:, :, :rows] = planes
    return np.packbits(padded, axis=2, bitorder="little").view(np.uint64), cut


def digits(weight: int) -> list[tuple[int, int]]:
    """A weight as powers of two with signs, few of them: 7 is 8 - 1."""
    out, place = [], 0
    while weight:
        if weight & 1:
            sign = 2 - (weight & 3)
            out.append((place, sign))
            weight -= sign
        weight >>= 1
        place += 1
    return out


def score_slices(index: np.ndarray, query: list[int]) -> list[np.ndarray]:
    """Slices of the scores of a block, least significant first, up to a constant.

    ``index`` has the slices of all components, then their complements, one a row.
    """
    components, places, negative = [], [], []
    for component, weight in enumerate(query):
        for place, sign in digits(weight):
            components.append(component)
            places.append(place)
            negative.append(sign < 0)
    bits = index.shape[0] // (2 * len(query))
    bit = np.arange(bits)
    column = (np.array(places, np.int64)[:, None] + bit).ravel()
    row = (np.array(components, np.int64)[:, None] * bits + bit).ravel()
    row += np.repeat(np.array(negative, np.int64) * (index.shape[0] // 2), bits)
    order = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[order], np.arange((column.max() if column.size else -1) + 2))
    stacks = {c: [index[row[order[lo:hi]]]] for c, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo}
    made: list[np.ndarray] = []
    while stacks:
        place = len(made)
        if place not in stacks:
            made.append(np.zeros(index.shape[1], np.uint64))
            continue
        parts = stacks.pop(place)
        stack = parts[0] if len(parts) == 1 else np.concatenate(parts)
        carried = stacks.get(place + 1, [])
        while len(stack) > 2:
            n = len(stack) // 3
            a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
            half = a ^ b
            carry = a & b
            carry |= half & c
            half ^= c
            carried.append(carry)
            stack = half if len(stack) == 3 * n else np.concatenate([half, stack[3 * n :]])
        if len(stack) == 2:
            carried.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        made.append(stack[0])
        if carried:
            stacks[place + 1] = carried
    return made


def pick(score: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k best by slices, and of those that tie at the boundary."""
    sure, tied = np.zeros_like(rows), rows
    count = lambda m: int(np.bitwise_count(m).sum())
    if count(rows) <= k:
        return rows, sure
    have = 0
    for plane in reversed(score):
        upper = tied & plane
        n = count(upper)
        if have + n > k:
            tied = upper
        else:
            sure, have, tied = sure | upper, have + n, tied & ~plane
            if have == k:
                return sure, np.zeros_like(rows)
    return sure, tied


def value_of(score: list[np.ndarray], at: int) -> int:
    """The score of one row, read from the slices."""
    word, bit = divmod(at, 64)
    return sum((int(plane[word]) >> bit & 1) << place for place, plane in enumerate(score))


def at_least(score: list[np.ndarray], bound: int, rows: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose score is ``bound`` or more."""
    if bound <= 0:
        return rows
    if bound >> len(score):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for place in reversed(range(len(score))):
        if bound >> place & 1:
            equal = equal & score[place]
        else:
            above |= equal & score[place]
            equal = equal & ~score[place]
    return above | equal


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def build_index(vectors: DataFrame, id_column: str, vector_column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """dims, id, v, block of every usable row; blocks with negative numbers hold the wide rows."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column)).alias("v"))
    rows = settle(rows.filter("id is not null and v is not null and size(v) > 0").withColumn("dims", F.size("v")))
    rows = rows.withColumn("wide", F.exists("v", lambda x: (x >= WIDE) | (x <= -WIDE)))
    blocks = F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("wide")) / block_rows)).alias("blocks")
    sizes = rows.groupBy("dims").agg(blocks, F.ceil(F.count_if("wide") / WIDE_ROWS).alias("wide_blocks"))
    apart = F.lit(-1) - F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.col("wide_blocks")))
    return rows.join(sizes, "dims").withColumn("block", F.when(F.col("wide"), apart).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))))


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k best others.

    The score is the inner product of the quantised vectors; ties go to the smaller id.
    Vectors that are null, empty or hold a null or non-finite component take no part, nor do
    rows without an id. Vectors are compared with vectors of their length. Rows that share
    an id are one row each as candidates and all count as the query's own; of their
    vectors, the query is the smallest.

    Queries in blocks meet index blocks, both keyed by the pair of block numbers; a task
    holds one pair. Components and scores beyond a long are cut to its ends. Vectors with very
    large components have no slices; they, and what such a query meets, are scored one by one.
    """
    rows = settle(build_index(vectors, id_column, vector_column, block_rows))
    sizes = rows.groupBy("dims").agg(F.max("blocks").alias("blocks"), F.max("wide_blocks").alias("wide_blocks"))
    queries = rows.filter(F.pmod(F.col("id"), F.lit(every)) == 0).groupBy("dims", "id").agg(F.min("v").alias("v"))
    asked = queries.groupBy("dims").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / query_rows)).alias("asks"))

    def packed(source: Iterator[tuple]) -> Iterator[tuple]:
        """Sorted rows of a block become one row of slices."""
        held: list[tuple] = []
        for row in source:
            if held and row[:2] != held[0][:2]:
                yield _pack(held)
                held = []
            held.append(row)
        if held:
            yield _pack(held)

    index = map_rows(
        rows.select("dims", "block", "id", "v").repartition("dims", "block").sortWithinPartitions("dims", "block", "id"),
        packed, "dims int, block long, cut int, ids binary, kind string, vals binary, maps binary",
    )
    index = settle(index)
    in_blocks = (
        queries.join(asked, "dims").withColumn("ask", F.pmod(F.xxhash64("id", F.lit(1)), F.col("asks")))
        .groupBy("dims", "ask").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("queries"))
        .join(sizes, "dims").withColumn("block", F.explode(F.sequence(-F.col("wide_blocks"), F.col("blocks") - 1)))
    )
    # a pair is little data and much work, so each is a task of its own
    n_pairs = sizes.join(asked, "dims").agg(F.sum((F.col("blocks") + F.col("wide_blocks")) * F.col("asks"))).first()[0] or 1
    pairs = (
        in_blocks.join(index, ["dims", "block"])
        .repartition(int(min(n_pairs, MOST_TASKS)), "dims", "block", "ask")
        .select("dims", "queries", "cut", "ids", "kind", "vals", "maps")
    )

    def answers(source: Iterator[tuple]) -> Iterator[tuple]:
        for dims, queries_, cut, ids_, kind, vals_, maps_ in source:
            ids, values = np.frombuffer(ids_, np.int64), np.frombuffer(vals_, kind).reshape(-1, dims)
            if not maps_:
                for one in queries_:
                    yield from ((one["id"], *found) for found in plainly_best(ids, values, one["id"], one["v"], k))
                continue
            words = -(-len(ids) // 64)
            maps = np.frombuffer(maps_, np.uint64).reshape(-1, words)
            maps = np.concatenate([maps, ~maps])
            largest = max(int(values.max()), -int(values.min()))
            everyone = np.zeros(words * 64, np.uint8)
            for one in queries_:
                query, weights = one["id"], one["v"]
                slack = ((1 << cut) - 1) * sum(map(abs, weights))
                if sum(map(abs, weights)) * max(1, largest) >= 1 << 62:
                    yield from ((query, *found) for found in plainly_best(ids, values, query, weights, k))
                    continue
                everyone[:] = 0
                everyone[: len(ids)] = ids != query
                present = np.packbits(everyone, bitorder="little").view(np.uint64)
                score = score_slices(maps, weights)
                sure, tied = pick(score, present, k)
                best_ = np.concatenate([positions(sure), positions(tied)[:1]])
                if not best_.size:
                    continue
                # what was cut off cannot lift a row below this bound among the k best
                least = min(value_of(score, at) for at in best_.tolist()) - (-(-slack >> cut) if cut else 0)
                near = positions(at_least(score, least, present))
                exact = values[near].astype(np.int64) @ np.array(weights, np.int64)
                for at in np.lexsort((ids[near], -exact))[:k].tolist():
                    yield query, int(ids[near[at]]), int(exact[at])

    best = map_rows(pairs, answers, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def plainly_best(ids: np.ndarray, values: np.ndarray, query: int, weights: list[int], k: int) -> list[tuple[int, int]]:
    """Id and score of the k best rows but the query's own, in whole numbers of any size."""
    exact = values.astype(object) @ np.array(weights, object)
    found = sorted((-min(MOST, max(LEAST, score)), i) for i, score in zip(ids.tolist(), exact.tolist(), strict=True) if i != query)
    return [(i, -score) for score, i in found[:k]]


def _pack(held: list[tuple]) -> tuple:
    values = np.array([row[3] for row in held], np.int64)
    ids = np.array([row[2] for row in held], np.int64)
    if held[0][1] < 0:
        return held[0][0], held[0][1], 0, ids.tobytes(), "int64", values.tobytes(), b""
    maps, cut = slices(values)
    least = next(kind for kind in ("int16", "int32", "int64") if np.array_equal(values.astype(kind), values))
    return held[0][0], held[0][1], cut, ids.tobytes(), least, values.astype(least).tobytes(), maps.tobytes()
