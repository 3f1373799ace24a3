"""Line dedup by a tree of line templates.

As log parsers do, a line descends a tree of fixed depth: first by its number of tokens,
then by its leading tokens, where tokens that hold a digit (dates, numbers, keys) are
variable and become ``<*>``. The leaf is the template; tokens beyond the depth are
variable fields. In a longer line one more leading token may be a field, whatever it holds
("Posted by <*> in the section"): the line stands under a leaf for each place of it.
A template that recurs across documents is boilerplate and its lines go.

Copies of a document repeat all its lines without any of them being boilerplate, so a
text counts by the number of texts like it. A text is made of pieces between punctuation
marks or line ends. Of the numbers of texts that its pieces stand in, the one at a third of
the order tells how many texts share most of it, and the text counts as one part of
that many. So a group of copies, edited or not, is about one document however many there are, and
a text is one by itself as long as a third of its pieces are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import condense, settle

#: Depth of the tree: leading tokens that tell templates apart.
DEPTH = 8
#: Shorter lines are no templates: they recur by chance.
MIN_TOKENS = 3
#: From so many tokens on, one of the leading ones may be a field of letters.
FIELD_TOKENS = 6
#: Different documents that make a template recurring, and what rounding may take from their sum.
MIN_DOCUMENTS, ROUNDING = 10, 1e-6
#: The share of a text's pieces, one part of so many, that may be its own in an edited copy.
OWN_PART = 3
#: Where a piece ends.
MARKS = r"[.,;:!?\n]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a filter, whatever the data. A full one lets more rows through to a join but loses none.
FILTER_BYTES = 1 << 17


def _single_blanks(text: Column) -> Column:
    """A text whose lines hold single spaces only; looking for other blanks costs less than replacing them."""
    odd = F.contains(text, F.lit("  "))
    for blank in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(blank))
    return F.when(odd, F.regexp_replace(text, r"[ \t\x0b\x0c\r]+", " ")).otherwise(text)


def _leaves(text: Column, depth: int, min_tokens: int, field_tokens: int) -> Column:
    """For each line the keys of the leaves that it stands under: its own first; none if it is too short.

    Steps go over all lines one after the other, as a lambda makes what it uses anew for each use.
    """
    none = F.array().cast("array<bigint>")
    lines = F.transform(F.split(_single_blanks(text), "\n"), lambda line: F.btrim(line))
    lines = F.transform(lines, lambda line: F.struct(F.size(F.split(line, " ")).alias("n"), F.substring_index(line, " ", depth).alias("lead")))
    seen = lambda lead: F.when(lead.rlike("[0-9]"), F.regexp_replace(lead, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(lead)
    lines = F.transform(lines, lambda x: F.struct(x["n"].alias("n"), seen(x["lead"]).alias("lead")))
    placed = F.transform(
        lines, lambda x: F.struct(x["n"].alias("n"), F.when(x["n"] >= min_tokens, F.transform(F.split(x["lead"], " "), lambda t, i: F.xxhash64(i, t))).alias("of"))
    )
    xor = lambda a, b: a.bitwiseXOR(b)
    placed = F.transform(
        placed, lambda x: F.struct(x["n"].alias("n"), x["of"].alias("of"), F.aggregate(x["of"], F.lit(0).cast("long"), xor).alias("whole"))
    )

    def keys(x: Column) -> Column:
        own = F.array(F.xxhash64(x["n"], F.lit(-1), x["whole"]))
        # a line under the leaf with a field at i is the line without the token there
        fields = F.transform(x["of"], lambda h, i: F.xxhash64(x["n"], i, x["whole"].bitwiseXOR(h)))
        return F.when(x["n"] >= field_tokens, F.concat(own, fields)).when(x["n"] >= min_tokens, own).otherwise(none)

    return F.transform(placed, keys)


def _key(text: Column) -> Column:
    """128 bits for a text."""
    return F.unhex(F.md5(text))


def _bit_at(key: Column) -> tuple[Column, Column]:
    """Byte and bit of a key in a filter."""
    h = F.xxhash64(key)
    return F.shiftright(h, 3).bitwiseAND(F.lit(FILTER_BYTES - 1)).cast("int"), h.bitwiseAND(F.lit(7)).cast("int")


def filter_of(keys: DataFrame, column: str) -> Column | None:
    """A test that every key in ``column`` passes, and few others do; None if there is no key.

    Tasks are sent one byte string of fixed size.
    """
    byte, bit = _bit_at(F.col(column))
    found = keys.select(byte.alias("byte"), F.call_function("shiftleft", F.lit(1), bit).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    made = bytearray(FILTER_BYTES)
    for at, bits in found.collect():  # a row per byte at most
        made[at] = bits
    if not any(made):
        return None
    byte, bit = _bit_at(F.col(column))
    held = F.conv(F.hex(F.substring(F.lit(bytes(made)), byte + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(held, bit) == 1


def _like_each(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """key, texts: how many of the given texts share most of a text's pieces, itself included."""
    pieces = rows.join(texts, "key", "left_semi").select("key", F.explode("pieces").alias("piece")).distinct()
    pieces = settle(pieces)
    counts = settle(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    held = pieces.join(counts, "piece").groupBy("key").agg(F.sort_array(F.collect_list("n")).alias("n"))
    return held.select("key", F.get("n", ((F.size("n") - 1) / OWN_PART).cast("int")).alias("texts"))


def recurring_templates(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """leaf of each template that recurs; ``rows`` has key, lines (leaves of each line) and pieces."""
    each = rows.select("key", F.explode(F.flatten("lines")).alias("leaf"))
    # rows are counted first, copies included: what is rare among rows is rare among texts
    common = settle(each.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).select("leaf"))
    passes = filter_of(common, "leaf")
    if passes is None:
        return common
    held = settle(each.filter(passes).join(common, "leaf").distinct())
    often = settle(held.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).select("leaf"))
    held = settle(held.join(often, "leaf"))
    like = settle(_like_each(rows, settle(held.select("key").distinct())))
    counted = held.join(like, "key").groupBy("leaf").agg(F.sum(1 / F.col("texts")).alias("documents"))
    return settle(counted.filter(F.col("documents") >= min_documents - ROUNDING).select("leaf"))


def drop_templates(
    docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_documents: int = MIN_DOCUMENTS, field_tokens: int = FIELD_TOKENS
) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` less its recurring lines.

    A template recurs when it stands in ``min_documents`` different documents or more, whatever
    the number of copies beside them. All its lines are dropped, in every document; the
    others stay joined by line feeds. A null text stays null; a text that loses all lines
    becomes empty. Blank lines and lines of fewer tokens than ``min_tokens`` stay; they
    count as pieces. Rows of equal text count once, whatever their ids, and get the same
    result. Columns may have any names. Only built-in functions are used.

    Keys of lines and pieces are shuffled, and of the texts only those that lose lines
    (and the few that a filter of fixed size does not tell from them). A template in a
    third of all rows is one row once tasks have counted.
    """
    own = F.col("text")
    lost = condense(docs.sparkSession, lambda: _lost_lines(docs, depth, min_tokens, min_documents, field_tokens))
    touched = filter_of(lost, "key")
    if touched is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, _key(own).alias("key"))
    touched = F.coalesce(touched, F.lit(False))
    text = F.col("row.text")
    stay = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("at", i)), "\n")
    cut = keyed.filter(touched).join(lost, "key", "left").select("row", F.when(F.col("at").isNull(), text).otherwise(stay).alias("text"))
    cut = cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return keyed.filter(~touched).select("row.*").unionByName(cut)


def _lost_lines(docs: DataFrame, depth: int, min_tokens: int, min_documents: int, field_tokens: int) -> DataFrame:
    """key of each text that loses lines, and their places in it (``at``)."""
    own = F.col("text")
    lines = _leaves(own, depth, min_tokens, field_tokens)
    pieces = F.filter(F.transform(F.split(own, MARKS), lambda p: F.when(F.btrim(p, F.lit(BLANKS)) != "", F.xxhash64(p))), lambda p: p.isNotNull())
    rows = settle(docs.filter(own.isNotNull()).select(_key(own).alias("key"), lines.alias("lines"), pieces.alias("pieces")))
    recurring = recurring_templates(rows, min_documents)
    passes = filter_of(recurring, "leaf")
    each = rows.select("key", F.posexplode("lines").alias("at", "leaves")).select("key", "at", F.explode("leaves").alias("leaf"))
    each = each.filter(F.lit(False) if passes is None else passes)
    return each.join(recurring, "leaf").groupBy("key").agg(F.collect_set("at").alias("at"))


def line_figures(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and kept_sha256 of every row, for the operator's defaults."""
    before = docs.select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    after = drop_templates(before.withColumn("was_empty", F.col("text") == ""))
    left = F.when(F.col("text").isNull(), 0).when((F.col("text") == "") & ~F.col("was_empty"), 0).otherwise(F.size(F.split("text", "\n")))
    return after.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - left).cast("long").alias("n_dropped"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
