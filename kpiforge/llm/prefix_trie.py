"""Prefix trie of conversations by ROLLUP.

A conversation's turns are cut into blocks of ``WIDTH``, and a block is one row with its
turns' ids in positional columns.  ``GROUP BY block, prior, ROLLUP(t0 .. t7)`` aggregates
all prefixes of a block together, ``grouping_id()`` tells how many turns a row stands for,
and the next block goes on under the *prior* node, the one that the block before it ends
in.  So one aggregate, combined before its shuffle, gives the nodes of all depths.

A turn's id is 120 bits of SHA-256 over role and text with its bytes beside it; texts are
never shuffled.  A node's id is the exclusive or of a 128-bit hash of (place, turn) over its
turns, so that it adds up block by block in any order of work: a node knows its own id
and its parent's without a look-up.

Subtrees need no walk: a node's *owner* is its smallest member, and each node has one.
The members of a node other than its owner own nodes in its subtree only, so the sum over
the subtree is the sum of what its members own (a second ROLLUP) less what the owner
owns further up (a running sum along its turns).

A long conversation is many rows everywhere: places, prior nodes and running sums come
from totals of stretches, and a node's ends are hashed as a stream of bounded pieces.

Defined cases: rows without a conversation id are left out; null role or text is empty;
turns come by number, nulls first, equal numbers by id; repeated rows are turns of their
own; conversations without turns end in the root; conversation ids are integers; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import rows_of, written

#: Turns in a block.
WIDTH = 8
#: Rows whose running figures are taken at once, and ids in a piece of a node's ends.
STRETCH = 4096


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """conv_id, place (0-based, in order of the turns), a, b (the turn's id), size (bytes of
    its text): one row per turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    code = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = [F.conv(F.substring(code, at, 15), 16, 10).cast("bigint") for at in (1, 16)]
    own = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), half[0].alias("a"),
                       half[1].alias("b"), F.octet_length(text).cast("bigint").alias("size"))
    own = written(own.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id()), "turns")
    order = ["conv_id", "turn", "a", "b", "row"]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order)
    own = written(own.select("conv_id", "a", "b", "size", F.spark_partition_id().alias("part"),
                             F.monotonically_increasing_id().alias("at")), "ordered")
    # a conversation that spans partitions goes on where the one before it stopped
    parts = own.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = own.join(parts, ["conv_id", "part"])
    return written(placed.select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "a", "b", "size"), "placed")


def _running(rows: DataFrame, key: str, order: str, names: dict[str, str], how, plus) -> DataFrame:
    """``rows`` with, for each name: column, the aggregate ``how`` of that column over the
    rows of the same key before this one.  Stretches of ``STRETCH`` places are taken one by
    one and their totals after that, so a long key isn't one task's rows."""
    rows = rows.withColumn("stretch", F.floor(F.col(order) / F.lit(STRETCH)))
    totals = rows.groupBy(key, "stretch").agg(*[how(c).alias(f"all_{n}") for n, c in names.items()])
    over = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "stretch", *[F.coalesce(how(f"all_{n}").over(over), F.lit(0)).alias(f"far_{n}") for n in names])
    near = Window.partitionBy(key, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(totals, [key, "stretch"])
    return rows.withColumns({n: plus(F.col(f"far_{n}"), F.coalesce(how(c).over(near), F.lit(0))) for n, c in names.items()}).drop(
        "stretch", *[f"far_{n}" for n in names])


def _hashes(place: Column, a: Column, b: Column) -> tuple[Column, Column]:
    place = place.cast("bigint")
    return F.xxhash64(place, a, b), F.xxhash64(b, place, a, F.lit(1))


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per block: conv_id, n (turns of the conversation), block, p, q (the prior
    node's id), t0.. (struct of a, b, size; null behind the last turn), x, y (the id of the
    node that the block ends in).  Conversations without turns have an empty first block."""
    x, y = _hashes(F.col("place"), F.col("a"), F.col("b"))
    slot = F.pmod("place", F.lit(WIDTH))
    rows = turns.groupBy("conv_id", F.floor(F.col("place") / F.lit(WIDTH)).alias("block")).agg(
        F.bit_xor(x).alias("ox"), F.bit_xor(y).alias("oy"),
        *[F.max(F.when(slot == k, F.col(c))).alias(f"{c}{k}") for k in range(WIDTH) for c in ("a", "b", "size")])
    rows = _running(rows, "conv_id", "block", {"p": "ox", "q": "oy"}, F.bit_xor, lambda u, v: u.bitwiseXOR(v))
    turn = [F.when(F.col(f"a{k}").isNotNull(), F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"),
                                                        F.col(f"size{k}").alias("size"))).alias(f"t{k}") for k in range(WIDTH)]
    kind = "struct<a: bigint, b: bigint, size: bigint>"
    rows = rows.join(convs.select("conv_id", "n").where("n > 0"), "conv_id").select(
        "conv_id", "n", "block", "p", "q", *turn, F.col("p").bitwiseXOR(F.col("ox")).alias("x"),
        F.col("q").bitwiseXOR(F.col("oy")).alias("y"))
    zero = F.lit(0).cast("bigint")
    empty = convs.where("n = 0").select(
        "conv_id", "n", zero.alias("block"), zero.alias("p"), zero.alias("q"), *[F.lit(None).cast(kind).alias(f"t{k}") for k in range(WIDTH)],
        zero.alias("x"), zero.alias("y"))
    return rows.unionByName(empty)


def _prefixes(blocks: DataFrame, figures: str) -> DataFrame:
    """The ROLLUP: a row per node with its id x, y, its parent's px, py, its depth, the
    bytes of its last text and ``figures``."""
    names = [f"t{k}" for k in range(WIDTH)]
    rows = blocks.sparkSession.sql(
        f"SELECT block, p, q, {', '.join(names)}, {WIDTH} - bit_count(grouping_id()) AS level, {figures} "
        f"FROM {{blocks}} GROUP BY block, p, q, ROLLUP({', '.join(names)})", blocks=blocks)
    turn = F.array(*names)
    last = F.get(turn, F.col("level") - 1)
    # a null in the last column: no turn there; level 0 of a later block is the node it goes on from
    rows = rows.where(last.isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))
    ids = {"x": F.col("p"), "y": F.col("q"), "px": F.col("p"), "py": F.col("q")}
    for k, t in enumerate(names):
        for name, h in zip("xy", _hashes(F.col("block") * WIDTH + k, F.col(t)["a"], F.col(t)["b"]), strict=True):
            ids[name] = ids[name].bitwiseXOR(F.when(F.col("level") > k, h).otherwise(0))
            ids[f"p{name}"] = ids[f"p{name}"].bitwiseXOR(F.when(F.col("level") > k + 1, h).otherwise(0))
    rows = rows.withColumns(ids | {"depth": F.col("block") * WIDTH + F.col("level"), "size": F.coalesce(last["size"], F.lit(0))})
    return rows.drop("block", "p", "q", "level", *names)


def _ends(blocks: DataFrame) -> DataFrame:
    """x, y, ends_sha256: the conversations that end in a node.  SHA-256 can't be put
    together from parts, so a node's pieces of at most ``STRETCH`` ids pass through one
    task in order, and none is held."""
    ends = blocks.where(f"n = 0 or block = floor((n - 1) / {WIDTH})").select("x", "y", "conv_id", F.floor(F.col("conv_id") / STRETCH).alias("at"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy("x", "y", "at").agg(F.array_join(ids, ",").alias("ids"))

    def run(batches):
        import pyarrow as pa

        node, code = None, None

        def row(nodes, codes):
            return pa.RecordBatch.from_arrays([pa.array([n[0] for n in nodes], pa.int64()), pa.array([n[1] for n in nodes], pa.int64()),
                                               pa.array(codes, pa.string())], ["x", "y", "ends_sha256"])

        for batch in batches:
            nodes, codes = [], []
            for x, y, ids in rows_of(batch):
                if (x, y) == node:
                    code.update(b"," + ids.encode())
                    continue
                if node is not None:
                    nodes.append(node)
                    codes.append(code.hexdigest())
                node, code = (x, y), hashlib.sha256(ids.encode())
            yield row(nodes, codes)
        if node is not None:
            yield row([node], [code.hexdigest()])

    return pieces.repartition("x", "y").sortWithinPartitions("x", "y", "at").select("x", "y", "ids").mapInArrow(
        run, "x bigint, y bigint, ends_sha256 string")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, a, b, size, as
    :func:`placed_turns` gives them) and ``convs`` (conv_id, n: its turns, 0 included).

    Per node: x, y (its id), conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its subtree,
    each node's members but one times the bytes of its last text), ends_sha256 (of the
    comma-joined ids, ascending, of the conversations that end there).  A node's last turn
    is turn ``depth`` of its conversation.
    """
    blocks = written(blocks_of(turns, convs), "blocks")
    nodes = _prefixes(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs")
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).drop("size"), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    below = _prefixes(blocks.join(owned, "conv_id"), "sum(saved) AS all_saved, sum(leaves) AS n_leaves").select("x", "y", "all_saved", "n_leaves")
    rows = _running(nodes, "conv_id", "depth", {"above": "saved"}, F.sum, lambda u, v: u + v)
    rows = rows.join(below, ["x", "y"]).join(_ends(blocks), ["x", "y"], "left")
    # written, so that the children of one node can be split in the join with their parents
    rows = written(rows.select(
        "x", "y", "px", "py", "conv_id", "depth", "n_convs", "n_children", "n_leaves", (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "sums")
    parents = nodes.where("n_children > 0").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    return rows.join(parents, ["px", "py"], "left").select(
        "x", "y", "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", "ends_sha256")
