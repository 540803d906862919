"""Tries of conversation prefixes by ROLLUP over positional turn-id columns.

A conversation is cut into blocks of ``BLOCK`` turns, one row each, with one column
per place in the block that holds the id of the turn.  ``ROLLUP`` over these columns
aggregates all prefixes that end in a block together, and ``grouping_id`` tells how
long each is.  Longer conversations go on in further blocks, whose rows carry the node
that the block before ended in; it is an ordinary grouping column, so all blocks of
all conversations are one aggregation, however long the longest conversation is.

A node is identified by sums of hashes of its turns and their places.  Such sums are
found for all blocks at once by a running sum that no single task has to see whole.

Figures of a subtree come from its members.  The smallest member of a node owns it;
a conversation owns a suffix of its path.  With ``shared`` as the tokens of a path
before the part that its conversation owns, the tokens saved in a subtree are the sum
of ``shared`` over all members but the owner, less the tokens above the node each time;
the leaves of a subtree are the members that own the leaf they end in.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches, text_or_empty
from settlespark.llm.columns import small
from settlespark.plans.skew import freeze

BLOCK = 8
# Blocks of a conversation that share a salt in joins on its id.
SALT = 512
# Members that end in a node, or children of a node, from which it is treated as hot.
HOT = 10_000
# Bits of each of the two hashes of a node; sums of a block's turns stay below 63 bits.
BITS = 56
MASK = (1 << BITS) - 1
# The words and the copied turns of the contract.
WORD = r"[^\x20\x09-\x0D]+"
SPAN, TURNS = 20, 4


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add the sums of earlier rows of the same ``group`` in the given order.

    Rows are cut into ranges of (group, order), summed inside each range, and shifted by
    the sums of the ranges before; only groups that span ranges need a shift, which are
    no more than there are ranges.  Rows equal in group and order are spread at random.
    """
    names = list(sums)
    ranged = freeze(
        df.withColumns({f"_in_{n}": c for n, c in sums.items()} | {"_spread": F.rand(0)})
        .repartitionByRange(group, *order, "_spread").withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy("_range", group).orderBy(*order, "_spread").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = ranged.groupBy(group, "_range").agg(*[F.sum(f"_in_{n}").alias(n) for n in names])
    spans = parts.groupBy(group).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    split = parts.join(spans.select(group), group, "left_semi")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = freeze(split.select(group, "_range", *[F.sum(n).over(before).alias(f"_by_{n}") for n in names]))
    placed = ranged.withColumns({n: F.sum(f"_in_{n}").over(local) for n in names})
    return placed.join(small(shifts, shifts.count()), [group, "_range"], "left").withColumns({
        n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_by_{n}", F.lit(0)) for n in names
    }).drop("_range", "_spread", *[f"_in_{n}" for n in names], *[f"_by_{n}" for n in names])


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes for the role and text of a turn, from their SHA-256."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def placed_turns(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv``, ``depth`` (from 1), ``key`` and ``tokens`` (words) of each turn.

    Turns are in ascending order of ``turn``, null first, those that share a number by
    the digest of role and text.  A null role or text counts as empty; rows without a
    conversation id belong to no conversation and are left out.
    """
    said, body = text_or_empty(role), text_or_empty(text)
    rows = df.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        turn_key(said, body).alias("key"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("tokens"))
    one = F.lit(1).cast("long")
    return running(rows, "conv", ["turn", "key"], {"depth": one}).select(
        "conv", (F.col("depth") + 1).alias("depth"), "key", "tokens")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Let conversations share beginnings: the turns, and ``conv`` and ``total`` of each.

    Conversation c begins with the first h turns of conversation c - c % 20 (as many as
    there are; the remainder has the sign of c) and goes on with its own after the first
    h, h being crc32(c) % 4.
    """
    held = turns
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % TURNS
    convs = freeze(held.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "h": h, "base": F.col("conv") - F.col("conv") % SPAN}))
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = freeze(convs.join(sizes, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn(
        "total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    first = held.filter(F.col("depth") < TURNS).select(F.col("conv").alias("base"), "depth", "key", "tokens")
    heads = convs.filter("taken > 0").select("conv", "base", "taken").join(first, "base").filter(
        "depth <= taken").select("conv", "depth", "key", "tokens")
    # conversations with a shorter beginning than h: their own turns move up
    step = SALT * BLOCK
    short = convs.filter("taken < h").select(
        "conv", (F.col("h") - F.col("taken")).alias("up"),
        F.explode(F.sequence(F.lit(0), F.expr(f"n div {step}"))).alias("salt"))
    tails = held.filter(F.col("depth") > h).withColumn("salt", F.expr(f"depth div {step}")).join(
        short, ["conv", "salt"], "left").select(
        "conv", (F.col("depth") - F.coalesce("up", F.lit(0))).alias("depth"), "key", "tokens")
    return heads.unionByName(tails), convs.select("conv", "total")


def _term(seed: int, depth: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth.cast("long"), key).bitwiseAND(F.lit(MASK))


def _places(block: int) -> list[str]:
    return [f"t{i}" for i in range(1, block + 1)]


def _blocks(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: the turn ids in ``block`` columns, the node
    (``a``, ``b``) and tokens (``above``) before the block, ``tokens`` of its turns."""
    at = (F.col("depth") - 1) % block
    rows = turns.groupBy("conv", F.expr(f"(depth - 1) div {block}").alias("block")).agg(
        # one row per place, so no more than a block's
        F.array_sort(F.collect_list(F.struct(at.alias("at"), "key", "tokens", "depth"))).alias("turns"))
    empty = convs.filter("total = 0").select(
        "conv", F.lit(0).cast("long").alias("block"), F.array().cast(rows.schema["turns"].dataType).alias("turns"))
    rows = rows.unionByName(empty)

    def total(x) -> Column:
        return F.aggregate("turns", F.lit(0).cast("decimal(38,0)"), lambda s, t: (s + x(t)).cast("decimal(38,0)"))

    later = running(
        rows.join(convs.filter(F.col("total") > block).select("conv"), "conv", "left_semi"), "conv", ["block"],
        {"a": total(lambda t: _term(1, t["depth"], t["key"])),
         "b": total(lambda t: _term(2, t["depth"], t["key"])),
         "above": total(lambda t: t["tokens"])})
    zero = F.lit(0).cast("decimal(38,0)")
    first = rows.join(convs.filter(F.col("total") <= block).select("conv"), "conv", "left_semi").withColumns(
        {c: zero for c in ("a", "b", "above")})
    size = F.lit(1 << BITS).cast("decimal(38,0)")
    return first.unionByName(later).select(
        "conv", "block", *[(F.col(c) % size).cast("long").alias(c) for c in ("a", "b")],
        F.col("above").cast("long").alias("above"),
        *[F.get("turns", F.lit(i))["key"].alias(c) for i, c in enumerate(_places(block))],
        F.transform("turns", lambda t: t["tokens"]).alias("tokens"))


def _rolled(rows: DataFrame, block: int, figures: str) -> DataFrame:
    """All prefixes that end in each block, with the given aggregates.

    ``level`` is the number of turns of the block in the prefix, ``pre`` the tokens before
    its last turn.  The prefix without any turn is kept for the first block only, where
    it is the root; elsewhere the block before has it.
    """
    places = ", ".join(_places(block))
    found = rows.sparkSession.sql(f"""
        SELECT block, a, b, {places}, {block} - bit_count(grouping_id()) AS level,
               any_value(above) AS above, any_value(tokens) AS tokens, {figures}
        FROM {{rows}} GROUP BY block, a, b, ROLLUP({places})""", rows=rows)
    last = F.element_at(F.array(*_places(block)), F.greatest("level", F.lit(1)).cast("int"))
    before = F.aggregate(
        F.slice("tokens", 1, F.greatest(F.col("level") - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull())).withColumns({
        "depth": F.col("block") * block + F.col("level"), "pre": F.col("above") + before})


def _node(block: int, level: Column) -> list[Column]:
    """The two hashes of the prefix with ``level`` turns of the block."""
    def upto(seed: int, base: str) -> Column:
        total = F.col(base)
        for i, c in enumerate(_places(block), 1):
            term = _term(seed, F.col("block") * block + i, F.col(c))
            total = total + F.when((level >= i) & F.col(c).isNotNull(), term).otherwise(F.lit(0).cast("long"))
        return total.bitwiseAND(F.lit(MASK))
    return [upto(1, "a"), upto(2, "b")]


ENDS = T.StructType([
    T.StructField("na", T.LongType()), T.StructField("nb", T.LongType()),
    T.StructField("ends_sha256", T.StringType())])


def _streamed_digests(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each node; its rows follow one another and are not held."""
    node, digest = None, None

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip((*node, digest.hexdigest()), schema)], schema=schema)

    for batch in batches:
        ids = batch["conv"].to_pylist()
        start = 0
        nodes = list(zip(batch["na"].to_pylist(), batch["nb"].to_pylist()))
        while start < len(ids):
            end = start
            while end < len(ids) and nodes[end] == nodes[start]:
                end += 1
            if nodes[start] != node:
                if node is not None:
                    yield ended()
                node, digest = nodes[start], sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, ids[start:end])).encode())
            start = end
    if node is not None:
        yield ended()


def _ends(rows: DataFrame, hot: int) -> DataFrame:
    """Per node that conversations end in, the digest of their ids in ascending order."""
    counts = rows.groupBy("na", "nb").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    busy = freeze(counts.select("na", "nb"))
    found = busy.count()
    # no more than one in `hot` rows
    keys = small(busy, found)
    ids = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")
    few = rows.join(keys, ["na", "nb"], "left_anti") if found else rows
    light = few.groupBy("na", "nb").agg(F.sha2(ids, 256).alias("ends_sha256"))
    if not found:
        return light
    many = rows.join(keys, ["na", "nb"], "left_semi").repartition("na", "nb").sortWithinPartitions("na", "nb", "conv")
    return light.unionByName(map_batches(many, _streamed_digests, ENDS))


def _with_parents(nodes: DataFrame, hot: int) -> DataFrame:
    """``parent_conv_id`` and ``n_children``; parents with very many children are broadcast."""
    children = nodes.filter("depth > 0").groupBy(F.col("ua").alias("na"), F.col("ub").alias("nb")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = freeze(nodes.join(children, ["na", "nb"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    parents = nodes.filter("n_children > 0").select(
        F.col("na").alias("ua"), F.col("nb").alias("ub"), F.col("conv").alias("parent_conv_id"), "n_children")
    busy = freeze(parents.filter(F.col("n_children") > hot).drop("n_children"))
    found = busy.count()
    rest = parents.filter(F.col("n_children") <= hot).drop("n_children")
    if not found:
        return nodes.join(rest, ["ua", "ub"], "left")
    busy = small(busy, found)
    return nodes.join(busy, ["ua", "ub"]).unionByName(
        nodes.join(busy.drop("parent_conv_id"), ["ua", "ub"], "left_anti").join(rest, ["ua", "ub"], "left"))


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row per node of the trie of all conversations.

    ``turns`` has ``conv``, ``depth`` (1, 2, ... in each conversation), ``key`` and
    ``tokens``, ``convs`` every ``conv`` with its number of turns, ``total``; one without
    turns is a member of the root.  Gives ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256`` (of the ids of the conversations that end in the node, ascending,
    comma-joined).  Without conversations there is no node, not even the root.
    """
    rows = freeze(_blocks(turns, convs, block))
    owned = _rolled(_with_conv(rows, convs, block), block, "min(conv) AS conv, max(total) AS longest")
    per_owner = owned.groupBy("conv").agg(
        F.min("pre").alias("shared"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    whole = rows.groupBy("conv").agg(F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("all"))
    figures = freeze(convs.join(whole, "conv").join(per_owner, "conv", "left").select(
        "conv", "total", F.coalesce("shared", "all").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")))
    known = freeze(_with_conv(rows, figures, block))
    nodes = _rolled(known, block, """min(conv) AS conv, count(*) AS n_convs, sum(leaf) AS n_leaves,
        sum(shared) AS all_shared, min_by(shared, conv) AS own""")
    (na, nb), (ua, ub) = _node(block, F.col("level")), _node(block, F.col("level") - 1)
    saved = F.col("all_shared") - F.col("own") - (F.col("n_convs") - 1) * F.col("pre")
    nodes = freeze(nodes.select(
        na.alias("na"), nb.alias("nb"), F.when(F.col("depth") > 0, ua).alias("ua"), F.when(F.col("depth") > 0, ub).alias("ub"),
        "conv", F.col("depth").cast("long").alias("depth"), "n_convs", "n_leaves", saved.cast("long").alias("saved_tokens")))
    (na, nb), last = _node(block, F.lit(block)), F.col("total") <= (F.col("block") + 1) * block
    ends = _ends(freeze(known.filter(last).select("conv", na.alias("na"), nb.alias("nb"))), hot)
    return _with_parents(nodes, hot).join(ends, ["na", "nb"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _with_conv(rows: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Blocks with the figures of their conversation; one with very many blocks is salted."""
    salted = convs.withColumn("_salt", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"total div {SALT * block}"))))
    return rows.withColumn("_salt", F.expr(f"block div {SALT}")).join(salted, ["conv", "_salt"]).drop("_salt")


def conversation_trie(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block: int = BLOCK, share: bool = False,
) -> DataFrame:
    """The trie of a table of turns, see :func:`trie` and :func:`placed_turns`.

    ``share`` first lets conversations share beginnings (:func:`rebuilt`).  Other columns
    are ignored; rows may repeat, each being a turn; an empty table gives no row.
    """
    turns = freeze(placed_turns(df, conv, turn, role, text))
    if share:
        turns, convs = rebuilt(turns)
        turns, convs = freeze(turns), freeze(convs)
    else:
        convs = freeze(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("total")))
    return trie(turns, convs, block)
