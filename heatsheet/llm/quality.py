"""Quality rules: base figures of a text and its divergence from language references.

A reference is, for one value of ``lang``, the histogram of character classes and the
histogram of the most common short words over all documents of that language. A document
is compared with every reference by the Jensen-Shannon distance (square root of the
divergence to base 2, so 0 to 1); the nearest reference counts. Histograms of few
characters or words say little, so each comparison has a least length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import map_rows, text_bytes

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Character classes: the bytes of each; what is left is the class "other", and code points
#: beyond ASCII are one class.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\n\x0b\x0c\r",
    b".,;:?'\"()-",
    SYMBOLS,
)
N_CLASSES = len(CLASSES) + 2
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Parameters of the verdict."""

    common_words: int = 50  # words of a reference's word histogram
    word_points: int = 4  # a common word has at most so many code points
    min_chars: int = 250  # fewer characters: the class histogram is not judged
    min_words: int = 50  # fewer words: the word histogram is not judged
    max_class_distance: float = 0.30
    max_word_distance: float = 0.50
    max_languages: int = 20_000  # more references would not fit beside a task: an error


def _class_matrix() -> np.ndarray:
    """Rows are bytes, columns classes; continuation bytes belong to no class."""
    of = np.zeros((256, N_CLASSES), np.int64)
    for k, members in enumerate(CLASSES):
        of[list(members), k] = 1
    of[0xC0:, -1] = 1
    of[:0x80, -2] = of[:0x80].sum(axis=1) == 0
    return of


_OF_CLASS = _class_matrix()


def class_counts(raw: bytes) -> list[int]:
    """Characters of each class; they sum up to the code points of the text."""
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (seen @ _OF_CLASS).tolist()


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more in the list."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + WINDOW - max(start, end)
            end = start + WINDOW
    return covered


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def points(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8", "replace"))


def js_distance(counts: list[int], shares: list[float]) -> float:
    """Jensen-Shannon distance of counts to shares that sum up to 1."""
    total = sum(counts)
    divergence = 0.0
    for n, q in zip(counts, shares, strict=True):
        p = n / total
        middle = (p + q) / 2
        if p > 0:
            divergence += p * math.log2(p / middle) / 2
        if q > 0:
            divergence += q * math.log2(q / middle) / 2
    return math.sqrt(min(1.0, max(0.0, divergence)))


def reference_counts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """lang, kind (class or word), key, n: counts over all documents with a language.

    Tasks add up what they have read before anything is shuffled. Word keys are lower-cased
    in A-Z only. Common words of a language are its ``common_words`` most frequent, ties by
    byte order; the row with an empty key counts all its words.
    """
    limit = rules.word_points

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        held = 0
        for lang, raw in source:
            classes.setdefault(lang, np.zeros(N_CLASSES, np.int64))[:] += class_counts(raw)
            own = words.setdefault(lang, Counter())
            held -= len(own)
            all_words = raw.lower().split()
            own.update(w for w in all_words if len(w) <= limit or len(w) <= 4 * limit and points(w) <= limit)
            own[b""] += len(all_words)
            held += len(own)
            if held > 1_000_000:  # what a task holds is bounded; sums may come in parts
                yield from ((lang, "word", w, n) for lang, c in words.items() for w, n in c.items())
                words, held = {}, 0
        yield from ((lang, "class", b"%d" % k, int(n)) for lang, c in classes.items() for k, n in enumerate(c))
        yield from ((lang, "word", w, n) for lang, c in words.items() for w, n in c.items())

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = (
        map_rows(text_bytes(known, "lang"), rows, "lang string, kind string, key binary, n long")
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang", "kind").orderBy((F.col("key") != F.lit(b"")).cast("int"), F.desc("n"), "key")
    common = counted.filter("kind = 'word'").withColumn("place", F.row_number().over(order))
    common = common.filter(F.col("place") <= rules.common_words + 1).drop("place")
    return counted.filter("kind = 'class'").unionByName(common)


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[list[float], list[bytes], list[float]]]:
    """Per language: class shares, common words, and their shares with that of the rest last."""
    counts = reference_counts(docs, rules)
    limit = rules.max_languages * (N_CLASSES + rules.common_words + 1)
    found = counts.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {rules.max_languages} languages")
    classes: dict[str, dict[int, int]] = {}
    words: dict[str, dict[bytes, int]] = {}
    for lang, kind, key, n in found:
        if kind == "class":
            classes.setdefault(lang, {})[int(key)] = n
        else:
            words.setdefault(lang, {})[bytes(key)] = n
    made = {}
    for lang, counted in sorted(classes.items()):
        own = words.get(lang, {})
        total, all_words = sum(counted.values()), own.pop(b"", 0)
        if not total or not all_words:
            continue
        ranked = sorted(own, key=lambda w: (-own[w], w))
        shares = [own[w] / all_words for w in ranked]
        rest = (all_words - sum(own.values())) / all_words
        made[lang] = [counted.get(k, 0) / total for k in range(N_CLASSES)], ranked, [*shares, rest]
    return made


@dataclass(frozen=True)
class Judge:
    """The rules with the references at hand; travels to the tasks."""

    rules: Rules
    against: list[tuple[list[float], list[bytes], list[float]]]

    def __call__(self, raw: bytes | None) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distances."""
        rules, raw = self.rules, raw or b""
        words = raw.split()
        classes = class_counts(raw)
        n_words, n_chars = len(words), sum(classes)
        repeats = repeated_words(words)
        failed = n_words < 10 or 100 * repeats > 20 * n_words
        by_class = by_word = None
        if self.against and n_chars >= rules.min_chars:
            by_class = min(js_distance(classes, shares) for shares, _, _ in self.against)
        if self.against and n_words >= rules.min_words:
            seen = Counter(raw.lower().split())
            by_word = 1.0
            for _, common, shares in self.against:
                own = [seen.get(w, 0) for w in common]
                by_word = min(by_word, js_distance([*own, n_words - sum(own)], shares))
        kept = not failed and (by_class or 0) <= rules.max_class_distance and (by_word or 0) <= rules.max_word_distance
        return n_words, n_chars - classes[3], classes[5], repeated_lines(raw), repeats, failed, kept, by_class, by_word


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document: doc_id, the base figures, the verdict ``kept`` and both distances.

    ``base_failed`` holds below 10 words or when over a fifth of the words lie in repeated
    windows. Otherwise a document is kept unless a distance that may be judged exceeds its
    limit. A distance is null where the text is too short or no language was seen. A null
    text is an empty one and fails the base. Rows are judged one by one, so repeated rows
    and ties need no rule; ``doc_id`` may be null.
    """
    verdict = Judge(rules, list(references(docs, rules).values()))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, raw in source:
            yield doc_id, *verdict(raw)

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    )
    return map_rows(text_bytes(docs, "doc_id"), rows, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns; no shuffle."""
    verdict = Judge(rules, list(references(docs, rules).values()))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return texts.map(lambda raw: verdict(raw)[6]).astype(bool)

    return docs.filter(good(F.col("text").cast("binary")))
