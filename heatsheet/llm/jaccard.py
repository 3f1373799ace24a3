"""Similarity join of documents on word shingles: size-aware, heavy and light.

Two sets are linked when their Jaccard similarity is 0.75 or more. Sets of few shingles
("light") enumerate their subsets of the size that a link requires: two of them are linked
exactly if they share such a subset. Larger sets ("heavy") scan inverted lists: a list
names the sets with a shingle, and only the shingles that come first in one common order
are listed, as a link must share one of those. The boundary is where enumerating subsets
of the sizes that occur would cost more than listing them.

Common shingles come last in the order, so lists are short: those that many prefixes list,
and, of sets with a prefix of mostly such ones, the common ones behind it. Sets alike are
one class.
Links serve to connect: members of a list are first compared with one of them, the classes
that are connected by this become one, and only pairs across what is still apart are
compared next. So a group of near copies costs its size, not the square of it, and no link
between classes that are apart is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..scratch import condense, settle
from .components import components
from .hashing import FILTER_BITS, LOWER, as_long, make_filter, mixed, passes, runs, words_of
from .text import chunks, map_columns, small_batches

SHINGLE = 5
#: Linked when PART * intersection >= THRESHOLD * union.
THRESHOLD, PART = 75, 100
#: Shingles listed more often than this come last in the order.
COMMON = 32
COUNTED_BITS = np.uint64((1 << 40) - 1)
#: Lists longer than this are dealt out to several tasks; each part has a centre of its own.
LONG, PARTS = 10_000, 1024
#: Bits of the map of a set by which pairs are turned down, in longs of 64.
MAP_LONGS = 32
#: Pairs across components for each entry of a list, above which rounds of further centres come first.
CROWDED = 8
#: The same over all such lists, above which a round pays; the maps turn down most pairs of fewer.
ROUND_ABOVE = 32
#: Rounds of further centres at most; what is open then is compared pair by pair.
ROUNDS = 8
#: A round that links fewer than one of so many pairs is the last one.
ROUND_YIELD = 200
#: Components known so far, up to which they are sent to every task.
SENT_ROWS = 1_000_000
#: Sizes that may enumerate subsets.
MOST_LIGHT = 16
#: Writing, counting and meeting one list entry, in units of one enumerated subset.
LIST_COST = 4
#: Classes that a task remembers in order to list copies once.
REMEMBERED = 250_000


def need(a, b):
    """Least intersection of linked sets of sizes a and b, for numbers or arrays."""
    return -(-(THRESHOLD * (a + b)) // (PART + THRESHOLD))


def prefix(n):
    """How many shingles of a set of size n are listed."""
    return n - -(-(THRESHOLD * n) // PART) + 1


def subset_sizes(n: int, most: int) -> list[int]:
    """Sizes of the subsets that a light set of size n enumerates."""
    partners = range(-(-THRESHOLD * n // PART), min(most, PART * n // THRESHOLD) + 1)
    return sorted({need(n, m) for m in partners})


def boundary(counts: dict[int, int]) -> int:
    """Largest light size: the least cost over the sizes that occur."""
    sizes = range(1, MOST_LIGHT + 1)
    costs = {0: sum(LIST_COST * prefix(s) * counts.get(s, 0) for s in sizes)}
    for most in sizes:
        light = sum(counts.get(s, 0) * sum(comb(s, t) for t in subset_sizes(s, most)) for s in sizes if s <= most)
        heavy = sum(LIST_COST * prefix(s) * counts.get(s, 0) for s in sizes if s > most)
        costs[most] = light + heavy
    return min(costs, key=lambda most: (costs[most], most))


class Sets:
    """Shingle sets of some texts: ``text`` and ``shingle`` side by side, in the common order."""

    def __init__(self, texts: list[bytes], common: np.ndarray | None = None) -> None:
        words, text = words_of([t.translate(LOWER) for t in texts])
        per_text = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
        h = runs(words, SHINGLE)
        of = text[: len(h)]
        full = of == text[SHINGLE - 1 :] if len(h) else np.empty(0, bool)
        h, of = h[full], of[full]
        first = np.cumsum(per_text) - per_text
        short = np.flatnonzero((per_text > 0) & (per_text < SHINGLE))
        whole = [mixed(runs(words[first[i] : first[i] + per_text[i]], int(per_text[i])) + np.uint64(per_text[i])) for i in short]
        h, of = np.concatenate([h, *whole]), np.concatenate([of, short])
        # order: shingles in the filter last, then by fingerprint; short numbers of texts sort fast
        place = h >> np.uint64(1)
        if common is not None:
            place = place | passes(common, h).astype(np.uint64) << np.uint64(63)
        order = np.argsort(place)
        texts_of = of[order].astype(np.uint16) if len(texts) < 1 << 16 else of[order]
        order = order[np.argsort(texts_of, kind="stable")]
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.shingle, self.text = h[new], of[new]
        self.size = np.bincount(self.text, minlength=len(texts)) if len(self.text) else np.zeros(len(texts), np.int64)
        self.first = np.cumsum(self.size) - self.size
        # sets alike have one fingerprint, whatever the order
        sums = np.zeros(len(self.shingle) + 1, np.uint64)
        np.cumsum(mixed(self.shingle), out=sums[1:])
        self.key = as_long(mixed(sums[self.first + self.size] - sums[self.first] + self.size.astype(np.uint64)))

    def listed(self, texts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shingle, key, size and place of what the given texts list."""
        chosen = np.zeros(len(self.size), bool)
        chosen[texts] = True
        place = np.arange(len(self.shingle)) - self.first[self.text]
        at = np.flatnonzero(chosen[self.text] & (place < prefix(self.size)[self.text]))
        return self.shingle[at], self.key[self.text[at]], self.size[self.text[at]], place[at]

    def behind(self, texts: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Shingles behind the prefix of those given texts that have a prefix half of common ones."""
        chosen = np.zeros(len(self.size), bool)
        chosen[texts] = True
        front = np.arange(len(self.shingle)) - self.first[self.text] < prefix(self.size)[self.text]
        at = np.flatnonzero(chosen[self.text] & front)
        shared = np.bincount(self.text[at], passes(common, self.shingle[at]), len(self.size))
        chosen &= 2 * shared >= prefix(self.size)
        return self.shingle[chosen[self.text] & ~front]


class Seen:
    """Lets each class through once; forgets when full, which only repeats work."""

    def __init__(self) -> None:
        self.keys: set[int] = set()

    def new(self, sets: Sets, least: int) -> np.ndarray:
        if len(self.keys) > REMEMBERED:
            self.keys.clear()
        out = []
        for i in np.flatnonzero(sets.size >= max(1, least)).tolist():
            key = int(sets.key[i])
            if key not in self.keys:
                self.keys.add(key)
                out.append(i)
        return np.array(out, np.int64)


def _texts(part: list[tuple]) -> list[bytes]:
    return [row[-1] or b"" for row in part]


def _counted(texts: DataFrame, least: int, common: np.ndarray | None, rest: bool = False) -> DataFrame:
    """h, n: how many sets list a shingle (copies in other tasks may count again).

    With ``rest``, how many sets of mostly common prefixes have it behind the prefix.
    Only filters are made of this, so 40 bits of a fingerprint do and halve what is shuffled.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(common)

    def columns(source: Iterator[tuple]) -> Iterator[tuple]:
        last = shipped.value
        seen, held, size = Seen(), [], 0
        for part in chunks(source):
            sets = Sets(_texts(part), None if rest else last)
            new = seen.new(sets, least)
            held.append((sets.behind(new, last) if rest else sets.listed(new)[0]) & COUNTED_BITS)
            size += len(held[-1])
            if size > 1_000_000:
                found, n = np.unique(np.concatenate(held), return_counts=True)
                yield as_long(found), n.astype(np.int32)
                held, size = [], 0
        if held:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield as_long(found), n.astype(np.int32)

    return map_columns(texts, columns, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))


def _may_link(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether a shared shingle at these places may be the first that two linked sets share."""
    most = F.lit(1) + F.least(n_a - 1 - at_a, n_b - 1 - at_b)
    return most * (PART + THRESHOLD) >= (n_a + n_b) * THRESHOLD


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()


def _rows_of(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows that stand for the classes, so that Python workers see no more; beyond SENT_ROWS classes all rows."""
    return _semi(texts, classes, "row")


def _semi(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    if wanted.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        return rows
    return rows.join(F.broadcast(wanted.select(column).distinct()), column, "left_semi")


def _packed(texts: DataFrame, classes: DataFrame, keys: DataFrame, maps: bool = False) -> DataFrame:
    """key, members, settled: sets of (at least) the classes in ``keys`` (h), five bytes a shingle.

    Only rows that stand for a class (``classes``: key, row) are read. Should several rows have
    the number of one, a class may come out again from another task, which only repeats a
    comparison. With ``maps`` also map0, map1, ...: the bits of the shingles' last places.
    """
    asked = settle(classes.join(keys.withColumnRenamed("h", "key"), "key", "left_semi"))

    def columns(source: Iterator[tuple]) -> Iterator[tuple]:
        seen = Seen()
        for part in chunks(source):
            sets = Sets(_texts(part))
            new = seen.new(sets, 1)
            # without a filter the order is that of the fingerprints, and so is that of their upper bytes
            own = [sets.shingle[sets.first[i] : sets.first[i] + sets.size[i]] for i in new.tolist()]
            packed = [pack(shingles) for shingles in own]
            yield (sets.key[new], packed, *(bit_maps(own).T if maps else ()))

    longs = "".join(f", map{i} long" for i in range(MAP_LONGS)) if maps else ""
    made = map_columns(_rows_of(texts, asked), columns, f"key long, members binary{longs}")
    return settle(_semi(made, asked, "key"))


def bit_maps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of longs for each set; bits that differ between two rows are fewer than shingles that do."""
    bits = np.zeros((len(sets), 64 * MAP_LONGS), bool)
    for i, shingles in enumerate(sets):
        bits[i, (shingles & np.uint64(64 * MAP_LONGS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def _maps_allow(n_a: Column, n_b: Column, a: list[Column], b: list[Column]) -> Column:
    """Whether sets with these maps may differ by as little as a link requires."""
    differ = reduce(add, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)))
    return differ * (PART + THRESHOLD) <= (n_a + n_b) * (PART - THRESHOLD)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by the sizes of intersection and union; a task compares one pair at a time."""
    met = (
        pairs.join(sets.select(F.col("key").alias("b"), F.col("members").alias("of_b")), "b")
        .join(sets.select(F.col("key").alias("a"), F.col("members").alias("of_a")), "a")
        .select("a", "b", "of_a", "of_b")
    )

    def linked(source: Iterator[tuple]) -> Iterator[tuple]:
        a, b = [], []
        for key_a, key_b, of_a, of_b in source:
            x, y = unpack(of_a), unpack(of_b)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if PART * shared >= THRESHOLD * (len(x) + len(y) - shared):
                a.append(key_a)
                b.append(key_b)
            if len(a) >= 4096:
                yield a, b
                a, b = [], []
        yield a, b

    return map_columns(met, linked, "a long, b long")


def _labelled(listed: DataFrame, joined: DataFrame) -> DataFrame:
    """``listed`` with the component of each class, by ``joined`` (node, component)."""
    joined = F.broadcast(joined) if joined.limit(SENT_ROWS + 1).count() <= SENT_ROWS else joined
    labelled = listed.join(joined.select(F.col("node").alias("key"), "component"), "key", "left")
    return labelled.withColumn("component", F.coalesce("component", "key"))


def _mains(entries: DataFrame, turn: int) -> DataFrame:
    """For each list of several components: the largest (``main``), one member of it, and the number of pairs across."""
    pick = F.max(F.struct(F.xxhash64("key", "h", F.lit(turn)), "key", "n", "at")).alias("pick")
    held = entries.groupBy("h", "component").agg(F.count(F.lit(1)).alias("many"), pick)
    top = F.max(F.struct("many", F.col("component").alias("main"), "pick")).alias("t")
    mains = held.groupBy("h").agg(top, F.sum("many").alias("all"), F.sum(F.col("many") * F.col("many")).alias("squares"))
    across = (F.col("all").cast("double") * F.col("all") - F.col("squares")) / 2
    return mains.filter("all > t.many").select("h", "t.main", "t.pick", "all", across.alias("across"))


def _across(entries: DataFrame, *more: Column) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a list; ``entries`` has main.

    One side is outside the main component, so a group of copies is not paired with itself.
    """
    x, y = entries.alias("x"), entries.alias("y")
    outside = F.col("y.component") != F.col("y.main")
    apart = (F.col("x.component") != F.col("y.component")) & (~outside | (F.col("x.key") < F.col("y.key")))
    near = _may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"))
    on = reduce(and_, more, (F.col("x.h") == F.col("y.h")) & apart & near)
    return x.filter("component <> main").join(y, on).select(*_pair(F.col("x.key"), F.col("y.key"))).distinct()


def _crowded_links(texts: DataFrame, classes: DataFrame, listed: DataFrame, joined: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Links inside lists with many pairs across components, and the lists (h); None if there are no such lists.

    While there are many pairs, each member outside its list's largest component is
    compared with one member of that, another one in each list and round, and what links is joined.
    The pairs left are compared one by one, but for those that the maps of the sets turn down.
    """
    long = _labelled(listed.filter(F.col("many") > 2 * CROWDED), joined)
    crowded = settle(_mains(long, 0).filter(F.col("across") > CROWDED * F.col("all")).select("h"))
    if crowded.isEmpty():
        return None
    entries = settle(long.join(crowded, "h").select("h", "key", "n", "at", "component"))
    sets = _packed(texts, classes, entries.select(F.col("key").alias("h")).distinct(), maps=True)
    found = None
    for turn in range(ROUNDS):
        mains = settle(_mains(entries, turn))
        across, size = mains.agg(F.sum("across"), F.sum("all")).first()
        if not size or across <= ROUND_ABOVE * size:
            break
        met = entries.join(mains, "h").filter("component <> main")
        near = _may_link(F.col("n"), F.col("at"), F.col("pick.n"), F.col("pick.at"))
        pairs = met.filter(near).select(*_pair(F.col("key"), F.col("pick.key")), "component", "main").dropDuplicates(["a", "b"])
        pairs = settle(pairs)
        links = settle(_linked(pairs.select("a", "b"), sets))
        found = links if found is None else found.unionByName(links)
        done = done.unionByName(pairs.select("a", "b"))
        if ROUND_YIELD * links.count() < pairs.count():
            break
        renamed = components(pairs.join(links, ["a", "b"]).select(F.col("component").alias("a"), F.col("main").alias("b")))
        renamed = renamed.select(F.col("node").alias("component"), F.col("component").alias("new"))
        entries = settle(entries.join(renamed, "component", "left").withColumn("component", F.coalesce("new", "component")).drop("new"))
    maps = [f"map{i}" for i in range(MAP_LONGS)]
    mapped = settle(entries.join(_mains(entries, 0).select("h", "main"), "h").join(sets.drop("members"), "key"))
    allowed = _maps_allow(F.col("x.n"), F.col("y.n"), [F.col(f"x.{m}") for m in maps], [F.col(f"y.{m}") for m in maps])
    pairs = settle(_across(mapped, allowed).join(done, ["a", "b"], "left_anti"))
    links = settle(_linked(pairs, sets))
    return (links if found is None else found.unionByName(links)), crowded


def pack(shingles: np.ndarray) -> bytes:
    """Sorted fingerprints, the upper five bytes of each."""
    return np.sort(shingles >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def shared_share(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each entry, in thousandths, how much of its set's prefix others list too."""
    keys, where, count = np.unique(key, return_inverse=True, return_counts=True)
    return (1000 * count[where] // np.maximum(1, prefix(n))).astype(np.int32)


def _light_links(texts: DataFrame, most: int) -> DataFrame:
    """Links between light classes by shared subsets of the size that a link requires.

    Sharing a subset of size t links every two sets whose sizes need no more than t. The
    smallest set of those that share it needs least with each other, so linking to it alone
    connects all.
    """

    def columns(source: Iterator[tuple]) -> Iterator[tuple]:
        seen = Seen()
        for part in chunks(source):
            sets = Sets(_texts(part))
            h, key, size, least = [], [], [], []
            for i in seen.new(sets, 1).tolist():
                n = int(sets.size[i])
                if n > most:
                    continue
                own = sets.shingle[sets.first[i] : sets.first[i] + n]
                for t in subset_sizes(n, most):
                    for chosen in combinations(range(n), t):
                        h.append(int(mixed(mixed(own[list(chosen)]).sum(dtype=np.uint64) + np.uint64([t]))[0].view(np.int64)))
                        key.append(int(sets.key[i]))
                        size.append(n)
                        least.append(t)
            yield h, key, size, least

    rows = map_columns(texts, columns, "h long, key long, n int, t int").distinct()
    centre = rows.groupBy("h", "t").agg(F.min(F.struct("n", "key")).alias("c"))
    met = rows.join(centre, ["h", "t"]).filter("key <> c.key")
    return met.filter((F.col("n") + F.col("c.n")) * THRESHOLD <= F.col("t") * (PART + THRESHOLD)).select(*_pair(F.col("key"), F.col("c.key"))).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the key of the set, and a number by which the row is found again (rows of one id share it)."""

    def columns(source: Iterator[tuple]) -> Iterator[tuple]:
        for part in chunks(source):
            sets = Sets(_texts(part))
            yield [row[0] for row in part], sets.size, sets.key

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = map_columns(docs.select("doc_id", F.col("text").cast("binary").alias("text")), columns, f"doc_id {kind}, n_shingles long, key long")
    return made.withColumn("row", F.xxhash64("doc_id"))


def join_classes(docs: DataFrame, found: DataFrame, common: int = COMMON, bits: int = FILTER_BITS, long: int = LONG) -> DataFrame:
    """key, component: classes of equal sets that links connect, for classes with a link."""
    spark = docs.sparkSession
    texts = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("doc_id").alias("row"), F.col("text").cast("binary").alias("text"))
    # one row stands for its class in all that follows; others pass the filter only by chance
    classes = settle(found.filter("n_shingles > 0").groupBy("key").agg(F.min("row").alias("row")))
    texts = _rows_of(texts, classes)
    small = found.filter(F.col("n_shingles").between(1, MOST_LIGHT)).groupBy("n_shingles").agg(F.countDistinct("key").alias("n")).collect()
    most = boundary({r["n_shingles"]: r["n"] for r in small})
    # lists hold the heavy sets and the light ones that may link with them
    least = -(-THRESHOLD * (most + 1) // PART)
    often, any_ = make_filter(spark, _counted(texts, least, None).filter(F.col("n") > common), bits=bits)
    if any_:
        # near copies have more common shingles than the first prefixes show
        often |= make_filter(spark, _counted(texts, least, often, rest=True).filter(F.col("n") > common), bits=bits)[0]
    counts = settle(_counted(texts, least, often).filter("n > 1"))
    repeated, any_ = make_filter(spark, counts, bits=bits)
    links = settle(_light_links(texts, most)) if most else None
    if any_:
        long_, _ = make_filter(spark, counts.filter(F.col("n") > long), bits=bits)
        shipped = spark.sparkContext.broadcast((often, repeated, long_ if long_.any() else None))

        def columns(source: Iterator[tuple]) -> Iterator[tuple]:
            last, several, split = shipped.value
            seen = Seen()
            for part in chunks(source):
                sets = Sets(_texts(part), last)
                h, key, n, at = sets.listed(seen.new(sets, least))
                ok = np.flatnonzero(passes(several, h))
                h, key, n, at = h[ok], key[ok], n[ok], at[ok]
                parted = np.zeros(len(h), bool) if split is None else passes(split, h)
                yield as_long(h), np.where(parted, key % PARTS, 0).astype(np.int32), parted, key, n.astype(np.int32), at.astype(np.int32), shared_share(key, n)

        # one exchange serves the removal of repeats, the centres and the join with them
        on = ["h", "salt"]
        entries = map_columns(texts, columns, "h long, salt int, parted boolean, key long, n int, at int, share int").repartition(*on)
        entries = entries.dropDuplicates(["h", "salt", "key"])
        # a list's centre is the set that shares most of what it lists: the original of edited copies
        centre = F.max(F.struct("share", "key", "n", "at")).alias("p")
        centres = entries.groupBy(*on).agg(centre, F.count(F.lit(1)).alias("many"), F.max("parted").alias("split")).filter("many > 1 or split")
        # share is kept, as both sides must read the same columns to have one exchange
        listed = entries.join(centres.hint("merge"), on).select("h", "key", "n", "at", "many", "parted", "share", F.col("p.key").alias("p_key"), F.col("p.n").alias("p_n"), F.col("p.at").alias("p_at"))
        listed = settle(listed).drop("share")
        near = _may_link(F.col("n"), F.col("at"), F.col("p_n"), F.col("p_at"))
        first = listed.filter((F.col("key") != F.col("p_key")) & near).select(*_pair(F.col("key"), F.col("p_key")))
        listed = listed.withColumn("c_key", F.col("p_key"))
        if long_.any():
            # the centres of a list's parts are compared with one of them, which is the list's centre
            parts = listed.filter("parted").select("h", "p_key").distinct()
            tops = settle(parts.groupBy("h").agg(F.max("p_key").alias("top")))
            first = first.unionByName(parts.join(tops, "h").filter("p_key <> top").select(*_pair(F.col("p_key"), F.col("top"))))
            listed = settle(listed.join(tops, "h", "left").withColumn("c_key", F.coalesce("top", "p_key")).drop("top"))
        first = settle(first.distinct())
        verified = condense(spark, lambda: _linked(first, _packed(texts, classes, _keys_of(first))))
        links = verified if links is None else settle(links.unionByName(verified))
        joined = settle(components(links))
        more = _crowded_links(texts, classes, listed, joined, first)
        if more is not None:
            links = settle(links.unionByName(more[0]))
            joined = settle(components(links))
            listed = listed.join(more[1], "h", "left_anti")
        labels = joined.select(F.col("node").alias("c_key"), F.col("component").alias("main"))
        entries = _labelled(listed, joined).join(labels, "c_key", "left").withColumn("main", F.coalesce("main", "c_key"))
        second = settle(_across(entries).join(first, ["a", "b"], "left_anti"))
        found_links = condense(spark, lambda: _linked(second, _packed(texts, classes, _keys_of(second))))
        links = links.unionByName(found_links)
    if links is None:
        return found.limit(0).select("key", F.col("key").alias("component"))
    return components(links).withColumnRenamed("node", "key")


def near_duplicates(docs: DataFrame, common: int = COMMON, bits: int = FILTER_BITS, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id, set_key for every row of ``docs``.

    A text's set has its distinct shingles of five words, lower-cased in A-Z; a text with
    fewer words has its whole sequence as the one shingle, and a null text or one without
    words has none and is linked with nothing. ``component_id`` is the least doc_id that
    links reach, itself included; rows with equal sets are linked, ids may be repeated, and
    null ids count for nothing. Sets and shingles are compared by 64-bit fingerprints (of
    which 40 bits when intersections are counted).
    """
    with small_batches(docs.sparkSession):
        found = settle(shingle_sets(docs))
        joined = condense(docs.sparkSession, lambda: join_classes(docs, found, common, bits, long))
    keyed = found.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    keyed = settle(keyed.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key")))
    least = keyed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = keyed.join(least, "component").select("key", "component_id")
    out = found.join(named, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("key").alias("set_key"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked rows, with all its columns: that of the least id.

    Rows without words are kept. Of rows that share the least id, the one with the least
    text is kept, and one of those that are alike. A row without an id counts as having an
    id before all others that follows from its text, and an id that is no whole number one that
    follows from the id.
    """
    own = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-1) - F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")), F.lit(1 << 62)))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    groups = near_duplicates(docs.select(own.alias("doc_id"), "text"))
    ids = groups.filter("n_shingles > 0 and doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    order = F.struct("text", *[F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]).alias("__order")
    # the texts move once: rows met by their id lie as the choice among rows of one id needs them
    chosen = docs.filter(wordy).select(row, order, own.alias("__id")).join(ids, "__id", "left_semi")
    chosen = chosen.groupBy("__id").agg(F.min_by("__row", "__order").alias("r")).select("r.*")
    return docs.filter(~wordy).unionByName(chosen)
