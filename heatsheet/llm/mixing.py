"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is ``rate`` times its size takes every document ``floor(rate)`` times
and once more with the fractional part of the rate as inclusion probability. Which
documents get the extra copy is drawn by the cube method: the vector of probabilities
walks through the null space of the balancing constraints (number of documents, number of
words) until a coordinate is 0 or 1, so both totals stay at their expected values. Blocks
of a source walk side by side in tasks and leave at most two undecided documents each;
those of all blocks meet in the next round, until one block is left. There a reserve of
documents has waited, and the small landing problem is solved among it: the number of documents is
given up first, the words last. Draws depend on the seed, the source and the order of the
documents alone, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import settle
from .text import word_count

#: Documents that walk in one task. Each block leaves two, so rounds shrink the table a thousandfold.
BLOCK_ROWS = 4096
#: Copies of a document at most.
MAX_COPIES = 3
NEAR = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Target of each source, sources by code point with null last.

    Weights repeat along the sources and share the whole size. A target stops at
    ``MAX_COPIES`` times its source's size; the excess is shared by weight among the
    others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, made, open_ = sum(sizes.values()), {}, list(order)
    left = float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > MAX_COPIES * sizes[s]]
        if not full:
            return made | share
        for s in full:
            made[s] = float(MAX_COPIES * sizes[s])
            left -= made[s]
        open_ = [s for s in open_ if s not in made]
    return made


def draw(seed: int, *parts: object) -> float:
    """A number in [0, 1) that depends on its arguments alone."""
    key = "|".join(map(str, (seed, *parts))).encode()
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big") / 2.0**64


def flight(sizes: list[float], shares: list[float], key: str, seed: int) -> list[float]:
    """Move inclusion probabilities until at most two lie strictly between 0 and 1.

    The walk always holds three undecided documents and moves along the direction that
    keeps both the number and the words in balance.
    """
    p = list(shares)
    held: list[int] = []
    for i, value in enumerate(p):
        if not NEAR < value < 1 - NEAR:
            p[i] = float(round(value))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (sizes[k] for k in held)
        move = (b - c, c - a, a - b)  # sums to 0, and so does move times size
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / m if m > 0 else p[k] / -m for k, m in zip(held, move, strict=True) if m)
        down = min(p[k] / m if m > 0 else (1 - p[k]) / -m for k, m in zip(held, move, strict=True) if m)
        step = up if draw(seed, key, i) < down / (up + down) else -down
        for k, m in zip(held, move, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * m))
            if not NEAR < p[k] < 1 - NEAR:
                p[k] = float(round(p[k]))
        held = [k for k in held if 0 < p[k] < 1]
    return p


def land(p: list[float], key: str, seed: int) -> list[float]:
    """Decide the documents that a flight has left, at most two, with the right probabilities.

    The probability that both of two are taken may lie in a range; the totals are nearer to
    balance when one is taken, so it is the least of the range.
    """
    last = [i for i, value in enumerate(p) if 0 < value < 1]
    u = draw(seed, key, "land")
    if len(last) == 1:
        p[last[0]] = float(u < p[last[0]])
    elif last:
        i, j = last
        both = max(0.0, p[i] + p[j] - 1)
        take = (1, 1) if u < both else (1, 0) if u < p[i] else (0, 1) if u < p[i] + p[j] - both else (0, 0)
        p[i], p[j] = map(float, take)
    return p


def finish(sizes: list[float], shares: list[float], key: str, seed: int) -> list[float]:
    """Decide all documents, given largest first.

    The larger half flies and lands. What its landing missed, in words, is laid on the
    probabilities of the others, evenly, before their larger half follows. So the error that
    stays is below the size of the smallest documents.
    """
    made, start, missed, step = [], 0, 0.0, 0
    while start < len(sizes):
        stop = start + max(4, (len(sizes) - start) // 2)
        stop = len(sizes) if len(sizes) - stop < 4 else stop
        rest = sum(sizes[start:]) or 1.0
        shifted = [min(1.0, max(0.0, share - missed / rest)) for share in shares[start:stop]]
        x = land(flight(sizes[start:stop], shifted, f"{key}|{step}", seed), f"{key}|{step}", seed)
        missed += sum((took - share) * size for took, share, size in zip(x, shares[start:stop], sizes[start:stop], strict=True))
        made += x
        start, step = stop, step + 1
    return level(sizes, made, missed)


def level(sizes: list[float], x: list[float], missed: float) -> list[float]:
    """Decide single documents the other way, large ones first, where that brings the words nearer to their total.

    ``missed`` is what the decisions take above that. The number of documents is given up
    before the words; flights leave little, so few documents change.
    """
    for i, size in enumerate(sizes):
        change = -size if x[i] else size
        if abs(missed + change) < abs(missed):
            x[i] = 1.0 - x[i]
            missed += change
    return x


def _walk(part: DataFrame, seed: int, last: bool, round_no: int) -> DataFrame:
    """One round over (src, block); src is the source with its null marked."""

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_key", "copy"], ascending=[False, True, True], kind="stable")
        move = finish if last else flight
        p = move(rows["size"].astype(float).tolist(), rows["p"].tolist(), f"{key[0]}|{key[1]}|{round_no}", seed)
        return rows.assign(p=p)[["src", "doc_key", "size", "copy", "p"]]

    return part.groupBy("src", "block").applyInPandas(block, "src string, doc_key string, size long, copy int, p double")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20, max_sources: int = 100_000, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, and repeat.

    ``size`` counts words (0 for a null text), ``copies`` says how often the mix takes the
    document and ``taken`` is that times the size. Documents without words take part and
    never matter. ``repeat`` numbers rows that share doc_id, source and size, from 0 on;
    they are decided one by one. A null source is a source of its own, a null doc_id sorts
    first, an empty table gives no rows.

    All blocks together keep the expected totals; only landings round, and each is made up
    for by smaller documents. The figures per source reach the driver; more than
    ``max_sources`` of them is an error.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    # rows alike in all that matters are one row with a count, so that a hot group stays small
    grouped = settle(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    per_source = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    found = per_source.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    spark = docs.sparkSession
    target = targets({r["source"]: r["source_size"] or 0 for r in found}, weights)
    plan = []
    for r in found:
        size = r["source_size"] or 0
        rate = min(target[r["source"]] / size, float(MAX_COPIES)) if size else 0.0
        base = min(int(math.floor(rate + NEAR)), MAX_COPIES)
        share = rate - base if rate - base > NEAR else 0.0
        blocks = max(1, -(-r["n"] // block_rows))
        plan.append((r["source"], size, float(target[r["source"]]), base, share, blocks, r["n"]))
    table = spark.createDataFrame(
        plan, "source string, source_size long, target double, base int, share double, blocks long, n long"
    )
    on = F.col("g.source").eqNullSafe(F.col("s.source"))
    rows = (
        grouped.alias("g")
        .join(table.alias("s"), on)
        .select("g.*", "s.source_size", "s.target", "s.base", "s.share", "s.blocks", "s.n")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)))
        .withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
        .withColumn("doc_key", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))
    )
    # a hashed reserve of each source waits for the last round, so that small documents are at
    # hand there to level out what is left; a source that fits one block waits as a whole
    part = rows.filter("share > 0").select(
        "src", "doc_key", "size", "copy", F.col("share").alias("p"), "blocks",
        (F.col("blocks") == 1).alias("small"),
        (F.pmod(F.xxhash64("doc_key", "size", "copy", F.lit(-1)), F.lit(1 << 30)) * F.col("n") < (block_rows // 4) * (1 << 30)).alias("spare"),
    )
    waiting = part.filter("small or spare").select("src", "doc_key", "size", "copy", "p")
    part = part.filter("not (small or spare)").withColumn("block", F.pmod(F.xxhash64("doc_key", "size", "copy"), F.col("blocks")))
    decided: list[DataFrame] = []
    most = max([r["n"] for r in found], default=0)
    round_no = 0
    while most > block_rows:
        walked = settle(_walk(part, seed, False, round_no))
        decided.append(walked.filter("p = 0 or p = 1"))
        left = walked.filter("p > 0 and p < 1")
        counts = settle(left.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        before, most = most, counts.agg(F.max("n")).first()[0] or 0
        if most <= block_rows or most >= before:
            waiting = waiting.unionByName(left)
            break
        round_no += 1
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows))
        part = left.join(counts, "src").withColumn("block", F.pmod(F.xxhash64("doc_key", "size", "copy", F.lit(round_no)), blocks))
    decided.append(_walk(waiting.withColumn("block", F.lit(0).cast("long")), seed, True, -1))
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    extra = extra.select("src", "doc_key", "size", "copy", F.col("p").cast("int").alias("extra"))
    made = rows.join(extra, ["src", "doc_key", "size", "copy"], "left").withColumn(
        "copies", F.col("base") + F.coalesce("extra", F.lit(0))
    )
    return made.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), F.col("copy").alias("repeat"),
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Rows that share doc_id, source and number of words are alike to the mix; their copies
    are dealt out to them in turn.
    """
    names = ["__id", "__source", "__size"]
    shared = mix(docs, weights, seed).groupBy(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")
    ).agg(F.sort_array(F.collect_list(F.struct("repeat", "copies"))).alias("__copies"))
    # rows alike are numbered one by one; nearly always there is one of a kind
    from pyspark.sql import Window

    row = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__source"),
        word_count(F.col("text")).alias("__size"), F.xxhash64("text").alias("__text"),
    )
    row = row.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy("__text")))
    on = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    joined = row.alias("a").join(shared.alias("b"), on)
    times = F.element_at(F.col("__copies"), F.col("__n").cast("int"))["copies"]
    return joined.filter(times > 0).withColumn("__time", F.explode(F.sequence(F.lit(1), times))).select("row.*")
