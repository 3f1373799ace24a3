"""The license join against every block compared with every template."""

import re

import numpy as np
import pytest

from heatsheet.llm import licenses

FILLER = "the of and to in is or with for be as this that work under license software copy public free version any".split()


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(licenses.WORD, lowered)


def brute(text, templates=licenses.TEMPLATES, share=licenses.SHARE):
    words = split(text)
    places = []
    for phrase, label in licenses.PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    step = max(len(split(t)) for t in templates.values())
    base, more, best = {label for _, label in places}, set(), 0.0
    for b in range(max(1, -(-len(words) // step) - 1)):
        block = set(words[b * step : (b + 2) * step])
        for label, t in templates.items():
            want = set(split(t))
            if 100 * len(want & block) >= share * len(want):
                more.add(label)
                best = max(best, len(want & block) / len(want))
    at = [i for i, _ in places]
    return (
        len(words), len(places), min(at, default=None), max(at, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else round(best, 9),
    )


def scanned(spark, texts, **options):
    table = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_words int").repartition(3)
    rows = licenses.scan(table, **options).collect()
    return {r["doc_id"]: (*(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")), round(r["score"], 9)) for r in rows}


def test_scan_is_that_of_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " -_- ", "GNU General-Public\nLicense and the MIT license; CC-BY, cc by the Apache License" , "mit licenses", "İmit license", "apache"]
    texts += ["license " * 20_000, "q" * 100_000, "the apache license " * 7000]
    for label, notice in licenses.TEMPLATES.items():
        words = notice.split()
        for lost in range(0, 12, 2):  # notices that lose more and more words, at all places of a text
            kept = [w for i, w in enumerate(words) if i not in set(rng.permutation(len(words))[:lost].tolist())]
            ahead, after = (" ".join(rng.choice(FILLER, rng.integers(0, 150))) for _ in range(2))
            texts.append(f"{ahead} {' '.join(kept)} {after}")
        texts += [notice.upper()] * 3
    texts += [" ".join(rng.choice(FILLER + split(" ".join(licenses.TEMPLATES.values())), 400)) for _ in range(60)]
    got = scanned(spark, texts)
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert got == want
    assert any(w[5] and not w[4] for w in want.values()) and any(w[5] == "" for w in want.values())


@pytest.mark.parametrize("share", [50, 100])
def test_other_thresholds_and_templates(spark, share):
    templates = {"one": "alpha beta gamma delta", "two": "beta beta epsilon", "three": "zeta"}
    rng = np.random.default_rng(share)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"], rng.integers(0, 30))) for _ in range(80)]
    assert scanned(spark, texts, templates=templates, share=share) == {i: brute(t, templates, share) for i, t in enumerate(texts)}


def test_empty_table_and_no_templates(spark):
    assert scanned(spark, []) == {}
    assert scanned(spark, ["mit license"], templates={}) == {0: (2, 1, 0, 0, "mit", "mit", 1.0)}


def test_rows_without_id_and_repeats(spark):
    rows = [(None, "cc by"), (None, "cc by"), (1, None), (1, "cc by")]
    made = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in made) == [(0, "cc-by"), (0, "cc-by"), (1, ""), (1, "cc-by")]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
