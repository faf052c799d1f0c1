"""Prefix trie of conversations: nodes by digest, and sums over subtrees by pointer jumping.

A conversation's first d turns have a digest that is the running xor of the digests of (place, role, text), so all nodes
of all conversations are named by one ranged running sum, and a node's parent is its digest without its own turn. What a
subtree holds is then rolled up along these parent edges by doubling: after k rounds each node has the sums of its
descendants fewer than 2^k edges below, and points to its ancestor 2^k edges above, so a trie of depth d takes about
log2(d) rounds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import PER_RANGE, ranged, running
from ..session import saved

#: The digest of no turns.
ROOT = "0" * 32


def numbered_turns(rows: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """Turns (``conv_id``, ``pos`` from 0, ``role``, ``text``) in the order of turn (null first), then role and text.

    Null roles and texts are empty ones; rows without an id are no conversation and are left out; repeated rows are turns
    of their own. A conversation of any length is numbered by ranges, never gathered."""
    held = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return running(held, ["conv_id"], order, {"pos": F.lit(1)}, per_range).select("conv_id", "pos", "role", "text")


def with_shared_heads(turns: DataFrame, family: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to begin with the first ``shared`` turns (``most`` at most) of conversation ``family``, then
    their own turns after their first ``shared``: all ids (``conv_id``), and their turns. ``family`` and ``shared`` are
    expressions over ``conv_id``. A conversation may be left without turns."""
    convs = saved(turns.select("conv_id").distinct(), "trie-conversations")
    heads = turns.filter(F.col("pos") < most)
    lengths = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("conv_id", "_family")
    plan = convs.select("conv_id", family.alias("_family"), shared.alias("_shared"))
    begun = plan.join(heads.withColumnRenamed("conv_id", "_family"), "_family").filter("pos < _shared").select("conv_id", "pos", "role", "text")
    skipped = plan.join(lengths, "_family", "left").select("conv_id", (F.col("_shared") - F.least(F.coalesce("n", F.lit(0)), "_shared")).alias("_gap"))
    rest = turns.filter(F.col("pos") >= shared).join(skipped, "conv_id").select("conv_id", (F.col("pos") - F.col("_gap")).alias("pos"), "role", "text")
    return convs, begun.unionByName(rest)


def _prefixes(turns: DataFrame, per_range: int) -> DataFrame:
    """A row for each conversation and depth from 1: ``node``, ``parent`` and the bytes of the last text."""
    own = turns.select("conv_id", "pos", F.octet_length("text").cast("long").alias("size"), F.xxhash64("pos", "role", "text").alias("x"), F.xxhash64(F.lit("turn"), "text", "role", "pos").alias("y"))
    dealt = ranged(own, ["conv_id"], [F.col("pos")], per_range)
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ranges = dealt.groupBy("conv_id", "_range").agg(*[F.bit_xor(c).alias(c) for c in "xy"])
    ahead = ranges.select("conv_id", "_range", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"ahead_{c}") for c in "xy"])
    placed = dealt.select(*dealt.columns, *[F.bit_xor(c).over(inside).alias(f"inside_{c}") for c in "xy"]).join(ahead, ["conv_id", "_range"])
    key = {c: F.col(f"inside_{c}").bitwiseXOR(F.col(f"ahead_{c}")) for c in "xy"}
    named = lambda x, y: F.lower(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))
    return placed.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "size", named(key["x"], key["y"]).alias("node"), named(key["x"].bitwiseXOR(F.col("x")), key["y"].bitwiseXOR(F.col("y"))).alias("parent"))


def rolled_up(tree: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """``node`` with each of ``values`` summed over its subtree, itself included, by pointer jumping over ``parent``.

    ``tree`` has one row a node; ``deepest`` is the greatest depth. Each round writes one table of the nodes, so a lost
    executor repeats one round at most; sums are combined before they are shuffled, so an ancestor of most nodes is no
    hot key."""
    state = tree.select("node", F.col("parent").alias("up"), *values)
    step = 1
    while step <= deepest:
        state = saved(state, "trie-round")
        climbing = state.filter("up IS NOT NULL")
        gains = climbing.groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        jumped = climbing.select("node", "up").join(state.select(F.col("node").alias("up"), F.col("up").alias("_up")), "up").select("node", "_up")
        met = state.drop("up").join(gains, "node", "left").join(jumped, "node", "left")
        state = met.select("node", F.col("_up").alias("up"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        step *= 2
    return state.drop("up")


def _joined_digests(batches):
    """SHA-256 per node over its parts, which come in order; the parts of one node may cross batches."""
    node, state = None, None
    for batch in batches:
        done = ([], [])
        for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != node:
                if state is not None:
                    done[0].append(node)
                    done[1].append(state.hexdigest())
                node, state = key, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()) for d in done], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def end_digests(ends: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """Per ``node`` the SHA-256 of the ids of conversations that end there, in ascending order, joined by commas.

    Ids are joined per range of ids first, so a node where most conversations end is a few long parts, and these pass
    through the digest one by one."""
    dealt = ranged(ends, [], [F.col("conv_id")], per_range)
    parts = dealt.groupBy("node", "_range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return parts.repartition("node").sortWithinPartitions("node", "_range").mapInArrow(_joined_digests, "node string, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The trie of conversations: one row a node with ``node`` (digest), ``parent`` (null for the root), ``depth``, ``size``
    (UTF-8 bytes of its last text), ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (summed over its subtree: (n_convs - 1) * size) and
    ``ends_sha256`` (of the ids of members that end there).

    ``convs`` has each ``conv_id`` once, ``turns`` their turns (``conv_id``, ``pos``, ``role``, ``text``); a conversation
    without turns is a member of the root only. Equal turns at one place are one node; null roles and texts are taken as
    empty ones; texts of any length are hashed whole; without conversations there is no node. Other columns are not read.
    """
    filled = turns.select("conv_id", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    prefixes = saved(_prefixes(filled, per_range), "trie-prefixes")
    nodes = prefixes.groupBy("node", "parent", "depth").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.groupBy().agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    top = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "n_convs", "conv_id")
    nodes = saved(nodes.unionByName(top), "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    values = tree.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(values, ["n_leaves", "saved_tokens"], deepest)
    last = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ended = prefixes.join(last, ["conv_id", "depth"]).select("conv_id", "node")
    empty = convs.join(last, "conv_id", "left_anti").select("conv_id", F.lit(ROOT).alias("node"))
    ends = end_digests(ended.unionByName(empty), per_range)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = nodes.filter("parent IS NOT NULL").select("node", "parent").join(above, "parent").select("node", "parent_conv_id")
    none = hashlib.sha256(b"").hexdigest()
    return (
        tree.join(sums, "node").join(upper, "node", "left").join(ends, "node", "left")
        .select("node", "parent", "depth", "size", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )
