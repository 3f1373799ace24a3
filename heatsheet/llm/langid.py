"""Language of a text by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language in order. A document's own list is
compared with each: every n-gram of the document counts the difference of its two ranks,
or the most there is if the profile lacks it. The language of the least sum is chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import map_rows, text_bytes

#: n-grams in a profile.
PROFILE = 300
UNKNOWN = "und"
#: Languages beyond this number would not fit beside a task: an error.
MAX_LANGUAGES = 20_000

_letters = re.compile(r"[^\W\d_]+").findall
_SPACE = 32
#: Bits of a code point inside a gram.
_POINT = np.uint64(21)


def letters(text: str) -> str:
    """The lower-cased words of letters with a space around each; empty without a letter."""
    words = _letters(text.lower())
    return " " + " ".join(words) + " " if words else ""


def grams(line: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a line from ``letters`` and their counts, grams in order.

    A gram is a number: three code points of 21 bits, the first on top, zeros after a short
    gram, so that numbers sort as texts do. Grams do not cross words, and the space alone
    is none.
    """
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = points << (_POINT + _POINT)
    two = one[:-1] | points[1:] << _POINT
    three = two[:-1] | points[2:]
    inner = points != _SPACE
    return np.unique(np.concatenate([one[inner], two, three[inner[1:-1]]]), return_counts=True)


def ranked(line: str, limit: int = PROFILE) -> np.ndarray:
    """The most frequent grams, ties by code point."""
    found, counts = grams(line)
    return found[np.argsort(-counts, kind="stable")[:limit]]


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def profiles(docs: DataFrame, limit: int = PROFILE) -> DataFrame:
    """lang, gram, rank from 1: counted over all given documents with a language and a text."""

    def total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return found, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        lines: dict[str, list[str]] = {}
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def count() -> None:
            for lang, texts in lines.items():
                parts = sums.setdefault(lang, [])
                parts.append(grams("".join(texts)))
                if len(parts) > 16:
                    sums[lang] = [total(parts)]
            lines.clear()

        for lang, raw in source:
            if line := letters(raw.decode("utf-8", "replace")):
                # lines end and begin with a space, so no gram joins two documents: " " "x" stays apart
                lines.setdefault(lang, []).append(line[:-1])
                waiting += len(line)
            if waiting > 1_000_000:
                lines = {k: [*v, " "] for k, v in lines.items()}
                count()
                waiting = 0
                if sum(len(p[0]) for parts in sums.values() for p in parts) > 4_000_000:  # sums may come in parts
                    for k, parts in sums.items():
                        yield from zip([k] * len((t := total(parts))[0]), t[0].tolist(), t[1].tolist(), strict=True)
                    sums = {}
        lines = {k: [*v, " "] for k, v in lines.items()}
        count()
        for k, parts in sums.items():
            yield from zip([k] * len((t := total(parts))[0]), t[0].tolist(), t[1].tolist(), strict=True)

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = map_rows(text_bytes(known, "lang"), rows, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("lang", "gram", "rank")


def collect_profiles(table: DataFrame, limit: int = PROFILE) -> dict[str, dict[int, int]]:
    found = table.limit(MAX_LANGUAGES * limit + 1).collect()
    if len(found) > MAX_LANGUAGES * limit:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    made: dict[str, dict[int, int]] = {}
    for lang, gram, rank in found:
        made.setdefault(lang, {})[gram] = rank
    return dict(sorted(made.items()))


def _out_of_place(own: np.ndarray, places: np.ndarray, held: np.ndarray, ranks: np.ndarray, limit: int) -> int:
    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
    return int(np.where(held[at] == own, np.abs(ranks[at] - places), limit).sum())


def identify(docs: DataFrame, learned: dict[str, dict[int, int]], *carry: str | Column, limit: int = PROFILE) -> DataFrame:
    """The carried columns, lang_pred and score for every row.

    The text alone decides. ``score`` is 1 minus the sum of rank differences over the
    largest there could be. A null text, one without a letter, or an empty set of profiles
    gives ``und`` and 0. Equal sums go to the first language by code point.
    """

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        known = []
        for lang, ranks in learned.items():
            held = np.array(sorted(ranks), np.uint64)
            known.append((lang, held, np.array([ranks[g] for g in held.tolist()], np.int64)))
        for *kept, raw in source:
            line = letters(raw.decode("utf-8", "replace")) if raw else ""
            if not line or not known:
                yield *kept, UNKNOWN, 0.0
                continue
            own = ranked(line, limit)
            places = np.arange(1, len(own) + 1)
            best, lang = min((_out_of_place(own, places, held, ranks, limit), lang) for lang, held, ranks in known)
            yield *kept, lang, 1.0 - best / (limit * len(own))

    carried = docs.select(*carry).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.fields)
    return map_rows(text_bytes(docs, *carry), rows, f"{schema}, lang_pred string, score double")


def detect(docs: DataFrame, limit: int = PROFILE) -> DataFrame:
    """Learn from the documents that are not held out, then predict for all.

    doc_id, held_out, lang_pred, score; one row for each row of ``docs``. Rows without text
    or language teach nothing; an empty table gives no rows. Repeated rows count as often as
    they occur.
    """
    held = is_held_out(F.col("doc_id"))
    learned = collect_profiles(profiles(docs.filter(~held), limit), limit)
    return identify(docs, learned, "doc_id", held.alias("held_out"), limit=limit)
