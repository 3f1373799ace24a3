"""Fingerprints of words and of runs of words, and fixed-size filters of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import map_rows

_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bits of a filter: 8 MB, whatever the data. More fingerprints only let more pass.
FILTER_BITS = 1 << 26
_PAGE_BITS = 1 << 15


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly, one to one."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; a process keeps the longest it needed."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        _powers["up"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(size, _INVERSE, np.uint64))
    return _powers["up"], _powers["down"]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts in one array, and the text that each is from.

    A word's fingerprint is a polynomial in its bytes: the difference of two running sums,
    moved to the word's place, then mixed with its length.
    """
    letters = np.frombuffer(b"\n".join(texts), np.uint8)
    n = letters.size
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_BLANK[letters]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    if not starts.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[letters] * up[:n], out=sums[1:])
    words = mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return words, np.searchsorted(ends, starts, side="right")


def doubled(h: np.ndarray, shift: int) -> np.ndarray:
    """Fingerprints of the runs that join the run at i with the run at i + ``shift``."""
    return mixed(h[: len(h) - shift] * _BASE + h[shift:]) if len(h) > shift else np.empty(0, np.uint64)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all runs of ``length`` words."""
    if length == 1:
        return words
    half = (length + 1) // 2
    return doubled(runs(words, half), length - half)


def sliding(h: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest value of every ``width`` neighbours, by doubling."""
    if len(h) < width:
        return np.empty(0, h.dtype)
    span = 1
    while 2 * span <= width:
        h = best(h[:-span], h[span:])
        span *= 2
    return best(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which fingerprints a filter lets through."""
    at = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def make_filter(spark: SparkSession, found: DataFrame, column: str = "h", bits: int = FILTER_BITS) -> tuple[np.ndarray, bool]:
    """A bitmap of the fingerprints in ``column`` and whether there are any.

    A fingerprint in the table always passes; another one passes only if it shares its last
    bits. The bitmap has a fixed size, so it may be sent to every task.
    """

    def pages(source: Iterator[tuple]) -> Iterator[tuple]:
        for page, bits_ in source:
            own = np.zeros(_PAGE_BITS, np.uint8)
            own[bits_] = 1
            yield page, np.packbits(own, bitorder="little").tobytes()

    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    parts = found.select(F.shiftright(at, 15).cast("int").alias("page"), at.bitwiseAND(F.lit(_PAGE_BITS - 1)).cast("int").alias("bit"))
    parts = parts.groupBy("page").agg(F.collect_set("bit").alias("bits"))
    made = np.zeros(bits // 8, np.uint8)
    any_ = False
    for page, part in map_rows(parts, pages, "page int, part binary").collect():
        made[page * (_PAGE_BITS // 8) : (page + 1) * (_PAGE_BITS // 8)] = np.frombuffer(part, np.uint8)
        any_ = True
    return made, any_
