"""The trie of conversation prefixes, by blocks of turns of fixed length.

Conversations are grouped by the digests of successive blocks of ``BLOCK`` turns first. A
block that all conversations of the block before go through alike has no divergence inside:
its turns are one chain, which one member spells out. Only where siblings diverge are
the turn boundaries inside the blocks compared, and there one member stands for all that
share the block. A node is known by its depth and the smallest conversation below it.

Sums over subtrees take pointers of doubling length: after round r a node holds the sum of
what is less than 2^r turns below it, so rounds grow with the logarithm of the longest
conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_before, with_position
from ..scratch import settle
from ..settings import ONE_TASK_ROWS
from .text import map_rows, word_count

#: Turns of a block.
BLOCK = 4
#: Conversation ids that are joined to one piece of text before a node's pieces are digested.
PIECE_IDS = 1024
#: A conversation takes its first turns from the next lower multiple of this id, and fewer than MAX_HEAD + 1 of them.
FAMILY, MAX_HEAD = 20, 3
_LANES = range(4)


def ordered_turns(conversations: DataFrame, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """conv_id, p (from 1), key (a digest of role and text) and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the text itself only orders turns of one number
    tied = conversations.filter("conv_id is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tied = settle(tied.select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t")))
    rows = conversations.filter("conv_id is not null").join(tied, (F.col("conv_id") == F.col("__c")) & F.col("turn").eqNullSafe(F.col("__t")), "left")
    rows = settle(
        rows.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.when(F.col("__c").isNotNull(), F.struct(role, text)).alias("tie"),
            F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("key"), word_count(text).alias("words"),
        )
    )
    placed = with_position(rows, "p", [F.col("turn").asc_nulls_first(), F.col("tie")], ["conv_id"], one_task_rows)
    return placed.select("conv_id", "p", "key", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d, key, words, length) of the rebuilt conversations, and all (c, length).

    A conversation c has the first h turns of c - c % FAMILY, and then its own after its
    first h; h is crc32 of its decimal id, mod MAX_HEAD + 1.
    """
    counts = settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MAX_HEAD + 1)
    givers = counts.select(F.col("conv_id").alias("giver"), F.least("n", F.lit(MAX_HEAD)).alias("has"))
    convs = counts.select("conv_id", "n", family.alias("family"), head.alias("h"))
    convs = convs.join(givers, F.col("family") == F.col("giver"), "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = settle(convs.select(F.col("conv_id").alias("c"), "family", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")))
    heads = turns.filter((F.col("p") <= MAX_HEAD) & (F.col("conv_id") % FAMILY == 0))
    given = convs.join(heads, (F.col("family") == F.col("conv_id")) & (F.col("p") <= F.col("h"))).select("c", F.col("p").alias("d"), "key", "words", "length")
    own = turns.join(convs, F.col("conv_id") == F.col("c")).filter("p > h").select("c", (F.col("p") - F.col("h") + F.col("taken")).alias("d"), "key", "words", "length")
    return given.unionByName(own), convs.select("c", "length")


def blocks_of(turns: DataFrame, block: int = BLOCK, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """c, k, keys, words, last: blocks of turns, with digests of all before (``before``) and with it (``after``).

    A digest of several blocks is a sum of digests of (number, block), in four lanes.
    """
    k = F.floor((F.col("d") - 1) / block).alias("k")
    turn = F.sort_array(F.collect_list(F.struct("d", "key", "words"))).alias("turns")
    made = turns.groupBy("c", k).agg(turn, F.max("length").alias("length"))
    digest = F.md5(F.concat_ws(",", F.col("k"), "keys"))
    made = made.select("c", "k", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"), (F.col("length") <= (F.col("k") + 1) * block).alias("last"))
    made = made.withColumn("__digest", digest)
    lane = [F.conv(F.substring("__digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"__own{i}") for i in _LANES]
    made = settle(made.select("*", *lane).drop("__digest"))
    summed = running_before(made, {f"__before{i}": F.col(f"__own{i}") for i in _LANES}, [F.col("k")], ["c"], one_task_rows)
    before = F.md5(F.concat_ws(",", *[F.col(f"__before{i}") for i in _LANES]))
    after = F.md5(F.concat_ws(",", *[F.col(f"__before{i}") + F.col(f"__own{i}") for i in _LANES]))
    return summed.select("c", "k", "keys", "words", "last", before.alias("before"), after.alias("after"))


def _nodes(blocks: DataFrame, top: int, n_convs: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, conv, up, n_convs, words) below the root, and where each block group ends: k, after, depth, end."""
    groups = settle(blocks.groupBy("k", "after").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("conv")))
    members = blocks.select("c", F.col("k").alias("__k"), "keys", "words", "before")
    reps = settle(groups.join(members, (F.col("conv") == F.col("c")) & (F.col("k") == F.col("__k"))).drop("c", "__k"))
    parents = groups.select((F.col("k") + 1).alias("__k"), F.col("after").alias("__after"), F.col("n").alias("n_up"), F.col("conv").alias("up"))
    reps = reps.join(parents, (F.col("k") == F.col("__k")) & (F.col("before") == F.col("__after")), "left").drop("__k", "__after")
    first = F.col("k") == 0
    reps = settle(reps.withColumns({"n_up": F.when(first, n_convs).otherwise(F.col("n_up")), "up": F.when(first, top).otherwise(F.col("up"))}))

    chain = reps.filter("n = n_up")
    depth = F.col("k") * block + F.col("j") + 1
    chain_nodes = chain.select("conv", "n", "k", F.posexplode("words").alias("j", "words")).select(
        depth.alias("depth"), "conv", F.col("conv").alias("up"), F.col("n").alias("n_convs"), "words"
    )
    # prefixes of the block: one row per boundary, for one member of each group
    inside = reps.filter("n < n_up")
    prefix = lambda j: F.md5(F.concat_ws(",", F.col("before"), F.slice("keys", 1, j)))
    bounds = inside.select("*", F.posexplode("words").alias("j", "w"))
    bounds = bounds.select(
        depth.alias("depth"), prefix(F.col("j") + 1).alias("key"), F.when(F.col("j") > 0, prefix(F.col("j"))).alias("key_up"),
        "conv", "up", "n", F.col("w").alias("words"),
    )
    split = settle(
        bounds.groupBy("depth", "key").agg(
            F.min("conv").alias("conv"), F.max("key_up").alias("key_up"), F.min("up").alias("up"), F.sum("n").alias("n_convs"), F.max("words").alias("words")
        )
    )
    above = split.select((F.col("depth") + 1).alias("__depth"), F.col("key").alias("__key"), F.col("conv").alias("__up"))
    split_nodes = split.join(above, (F.col("depth") == F.col("__depth")) & (F.col("key_up") == F.col("__key")), "left")
    split_nodes = split_nodes.select("depth", "conv", F.coalesce("__up", "up").alias("up"), "n_convs", "words")

    size = F.size("keys")
    chain_ends = chain.select("k", "after", (F.col("k") * block + size).alias("depth"), F.col("conv").alias("end"))
    split_ends = inside.select("k", "after", (F.col("k") * block + size).alias("depth"), prefix(size).alias("__key"))
    found = split.select(F.col("depth").alias("__depth"), "key", F.col("conv").alias("end"))
    split_ends = split_ends.join(found, (F.col("depth") == F.col("__depth")) & (F.col("__key") == F.col("key"))).select("k", "after", "depth", "end")
    return settle(chain_nodes.unionByName(split_nodes)), settle(chain_ends.unionByName(split_ends))


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, conv, ends_sha256 of the nodes (depth, conv) where conversations c end.

    Ids are joined to pieces first; the pieces of a node then run through one digest in
    order, so that a task holds one piece at a time.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids")
    pieces = ends.groupBy("depth", "conv", F.floor(F.col("c") / PIECE_IDS).alias("piece")).agg(piece)

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        at, digest = None, hashlib.sha256()
        for depth, conv, ids in source:
            if (depth, conv) != at:
                if at:
                    yield *at, digest.hexdigest()
                at, digest = (depth, conv), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if at:
            yield *at, digest.hexdigest()

    dealt = pieces.repartition("depth", "conv").sortWithinPartitions("depth", "conv", "piece")
    return map_rows(dealt.select("depth", "conv", "ids"), rows, "depth long, conv long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """Replace the columns ``sums`` by their sums over the subtree of each node, its top included.

    ``nodes`` has depth, conv and up: the parent of (depth, conv) is (depth - 1, up).
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    held = settle(nodes.withColumn("__to", F.col("up")))
    step = 1
    while step <= deepest:
        senders = held.filter(F.col("depth") >= step)
        got = senders.groupBy((F.col("depth") - step).alias("__d"), F.col("__to").alias("__c")).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
        farther = held.select((F.col("depth") + step).alias("__d2"), F.col("conv").alias("__c2"), F.col("__to").alias("__far"))
        moved = held.join(farther, (F.col("depth") == F.col("__d2")) & (F.col("__to") == F.col("__c2")), "left").drop("__d2", "__c2")
        moved = moved.join(got, (F.col("depth") == F.col("__d")) & (F.col("conv") == F.col("__c")), "left")
        added = {s: F.col(s) + F.coalesce(f"__{s}", F.lit(0)) for s in sums}
        held = settle(moved.withColumns({**added, "__to": F.col("__far")}).select(*held.columns))
        step *= 2
    return held.drop("__to")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns go by ``turn``, null first, turns of one number by role and text; a null role or
    text is an empty one, and repeated rows are turns of their own. Rows without a conv_id
    belong to no conversation and are left out. An empty table has no node, not even a
    root. Further columns are not looked at. Digests of 128 bits stand for turns and
    prefixes. A conversation longer than ``one_task_rows`` is ordered by several tasks.
    """
    turns, convs = rebuilt_turns(settle(ordered_turns(conversations, one_task_rows)))
    blocks = settle(blocks_of(turns, block, one_task_rows))
    n_convs, top = convs.agg(F.count(F.lit(1)), F.min("c")).first()
    below, group_ends = _nodes(blocks, top or 0, n_convs, block)
    root = convs.agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), "conv", F.lit(None).cast("long").alias("up"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = below.select(F.col("depth").cast("long").alias("depth"), "conv", "up", "n_convs", "words").unionByName(root)

    ended = blocks.filter("last").select("c", "k", "after")
    ends = ended.join(group_ends, ["k", "after"]).select("c", F.col("depth").cast("long").alias("depth"), F.col("end").alias("conv"))
    turnless = convs.filter("length = 0").select("c", F.lit(0).cast("long").alias("depth"), F.lit(top).cast("long").alias("conv"))
    digests = ends_digests(ends.unionByName(turnless))

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("__d"), F.col("up").alias("__c")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, (F.col("depth") == F.col("__d")) & (F.col("conv") == F.col("__c")), "left").drop("__d", "__c")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    nodes = nodes.select("depth", "conv", "up", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved)
    nodes = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    nothing = hashlib.sha256().hexdigest()
    return nodes.join(digests, ["depth", "conv"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
