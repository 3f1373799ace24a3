"""Which recurring lines are boilerplate: blocks, copies, blank lines, repeats in one text."""

from random import Random

from heatsheet.llm import templates


def word(n):
    return "".join(chr(97 + int(d)) for d in str(n)) + "x"


def body(seed, lines=12):
    return [" ".join(word(seed * 1000 + 10 * i + k) for k in range(5)) for i in range(lines)]


def edited(lines, rng, seed):
    """A copy with one or two lines edited."""
    out = list(lines)
    for at in rng.sample(range(len(out)), rng.choice([1, 2])):
        out[at] = f"{word(seed)} {out[at]}"
    return out


def left(spark, texts):
    table = spark.createDataFrame(list(enumerate("\n".join(t) for t in texts)), "doc_id long, text string")
    rows = dict(templates.drop_templates(table).select("doc_id", "text").collect())
    return [rows[i].split("\n") for i in range(len(texts))]


HEADER = ["this work is given freely", "to all who ask for it", "and without any warranty", "of whatever kind at all"]


def test_block_of_lines_goes(spark):
    own = [body(i) for i in range(1, 31)]
    assert left(spark, [HEADER + b for b in own]) == own


def test_lines_of_edited_copies_stay(spark):
    rng, one = Random(1), body(77, 20)
    copies = [edited(one, rng, 5000 + i) for i in range(300)]
    assert left(spark, copies) == copies


def test_copies_do_not_bring_a_template_back(spark):
    rng, own = Random(2), [body(i) for i in range(1, 16)]
    notice = "all rights are reserved here"
    copies = [edited(body(88, 20), rng, 7000 + i) for i in range(300)]
    assert left(spark, [[notice, *b] for b in own + copies]) == own + copies


def test_notice_between_blank_and_short_lines_goes(spark):
    own = [[f"part {word(i)}", "", f"{word(i)}q also", "", f"see {word(i)}", "", f"with {word(i)}", "", f"for {word(i)}", f"by {word(i)}"] for i in range(1, 31)]
    texts = [[*t[:2], "this notice recurs all over", *t[1:]] for t in own]
    assert left(spark, texts) == [[*t[:2], *t[1:]] for t in own]


def test_repeats_in_one_text_stay(spark):
    lines = [x for i, line in enumerate(body(9, 40)) for x in (f"Chapter {i} of the report", line)]
    texts = [lines, *(body(i) for i in range(10, 13))]
    assert left(spark, texts) == texts


def test_short_documents_and_long_blocks_count(spark):
    notice = "this line stands in all of them"
    pairs = [[f"{word(i)} {word(i)}q {word(i)}r", notice] for i in range(1, 101)]
    assert left(spark, pairs) == [[t[0]] for t in pairs]
    block = [f"{word(i)} of the notice goes on" for i in range(6)]
    own = [body(100 + i, 3) for i in range(60)]
    assert left(spark, [block + b for b in own]) == own


def test_fields_of_letters_vary(spark):
    own = [body(200 + i, 4) for i in range(50)]
    texts = [[b[0], f"Posted by {word(900 + i)} in the section", *b[1:]] for i, b in enumerate(own)]
    assert left(spark, texts) == own


def test_blanks_do_not_matter(spark):
    own = [body(300 + i, 4) for i in range(30)]
    texts = [[*b[:2], ("\t" * (i % 3)) + "all  rights\vare  reserved" + "\r" * (i % 2), *b[2:]] for i, b in enumerate(own)]
    assert left(spark, texts) == own


def test_columns_of_any_name_nulls_and_repeats(spark):
    own = [body(400 + i, 4) for i in range(15)]
    rows = [(i, "\n".join(["it is so for all", *b]), "k", [1], "r") for i, b in enumerate(own)]
    rows += [rows[0], (None, None, None, None, None), (50, "", "k", [], "x"), (51, "? ? ?\n! ! !", "k", [], "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string, at array<int>, `row` string")
    made = templates.drop_templates(table)
    assert made.columns == table.columns
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in made.collect())
    want = [(i, "\n".join(b)) for i, b in enumerate(own)] + [(0, "\n".join(own[0])), (-1, None), (50, ""), (51, "? ? ?\n! ! !")]
    assert texts == sorted(want, key=lambda r: (r[0], r[1] or ""))


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(i, "\n".join(["it is so for all", *body(i, 3)])) for i in range(20)], "doc_id long, text string")
    plan = templates.drop_templates(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
