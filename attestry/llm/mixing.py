"""Mixing sources to target weights by hierarchical budgeting over a tree, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .columns import set_aside
from .ranking import bucket_count, group_key, hash_bucket, order_hash


def budgets(leaves: DataFrame, levels: list[str], total: float | Column, weight_cols: list[str], capacity: str = "capacity") -> DataFrame:
    """Give each leaf a token budget: ``leaves`` plus ``budget``.

    From the root down, a parent's budget goes to its children in proportion to their weights, no child getting more
    than its subtree can take: a leaf of positive weight takes its capacity, a node of positive weight what its children
    take, and any of weight 0 takes nothing. What a full child cannot take goes to its siblings by weight; only if all of
    them are full does the parent itself count as full, and its shortage passes to the parent's siblings. Solved in
    closed form by sorting siblings by capacity over weight, so no loop and no driver copy of the tree.

    Null or negative weights count as 0, null or negative capacities too; of several weights told for one node the largest
    counts. Leaves of one path share one budget. An empty table gives an empty result.
    """
    clean = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    tree, below = [], leaves.groupBy(*levels).agg(F.sum(clean(capacity)).alias("_cap"), *[F.max(clean(w)).alias(f"_w{i}") for i, w in enumerate(weight_cols)])
    for depth in reversed(range(len(levels))):  # what each subtree can take, from the leaves up
        nodes = below.groupBy(*levels[: depth + 1]).agg(F.sum("_cap").alias("_cap"), *[F.max(f"_w{i}").alias(f"_w{i}") for i in range(depth + 1)])
        below = nodes.withColumn("_cap", F.when(F.col(f"_w{depth}") > 0, F.col("_cap")).otherwise(0.0))
        tree.insert(0, below.withColumnRenamed(f"_w{depth}", "_w").select(*levels[: depth + 1], "_cap", "_w"))
    parent_budget = None
    for depth, (level, nodes) in enumerate(zip(levels, tree)):
        path = levels[: depth + 1]
        if depth == 0:
            nodes = nodes.withColumn("_parent", total if isinstance(total, Column) else F.lit(float(total)))
            family = Window.partitionBy(F.lit(0))
        else:
            nodes = nodes.join(parent_budget, path[:-1])
            family = Window.partitionBy(*path[:-1])
        nodes = nodes.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(0.0))
        by_ratio = family.orderBy("_ratio", level)
        full_before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        weight_left = F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        level_here = F.when(F.col("_left") > 0, (F.col("_parent") - F.col("_full")) / F.col("_left")).otherwise(0.0)
        nodes = nodes.withColumn("_full", full_before).withColumn("_left", weight_left).withColumn("_level", level_here)
        # Children are full up to the first whose ratio exceeds the level at its place; the rest share that level. Of equal ratios the first has the highest level.
        open_level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct(F.col("_ratio"), (-F.col("_level")).alias("_down")))).over(family)
        budget = F.when(open_level.isNull(), F.col("_cap")).when(F.col("_ratio") < open_level["_ratio"], F.col("_cap")).otherwise(F.col("_w") * F.greatest(-open_level["_down"], F.lit(0.0)))
        parent_budget = nodes.withColumn("_budget", F.least("_cap", budget)).select(*path, F.col("_budget").alias("_parent"))
    return leaves.join(parent_budget.withColumnRenamed("_parent", "budget"), levels)


def _placed(rows: DataFrame, leaves: DataFrame, keys: list[str], leaf_count: int, broadcast_leaves: int) -> DataFrame:
    """Join leaf facts to rows: broadcast while there are few leaves, else by a shuffle that adaptive execution can split."""
    return rows.join(F.broadcast(leaves) if leaf_count <= broadcast_leaves else leaves, keys)


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[Column], tokens: Column, total: float | None = None, share: float = 1.0, max_epochs: int = 1, seed: int = 29, id_col: str = "doc_id", tie: Column | None = None, per_bucket: int = 1024, broadcast_leaves: int = 100_000) -> DataFrame:
    """Rows of ``docs`` chosen to match target weights, with ``epoch`` (from 0): a row taken twice has two epochs.

    ``levels`` name the tree (say domain, language, source) and give each row's place in it; ``weights`` give, per
    level, a node's weight as an expression over the columns ``_<level>`` (the place as text behind a "1"; "0" for a
    null place). ``total`` defaults to ``share`` times all tokens. A leaf holds ``max_epochs`` times its tokens. Each leaf takes
    whole epochs as far as its budget reaches, and of the next epoch, in that epoch's own seeded order, the rows that
    start before the budget is used up. That prefix ends at one order value per leaf, so texts are never shuffled:
    each row compares its own order value with its leaf's. Rows of equal id and ``tie`` share an order value and are
    taken together.

    Null places form nodes of their own. Rows of no tokens (null or empty texts) are taken where their leaf's prefix
    reaches them; the row that crosses the budget is taken whole, however long. Repeated rows count each time. An empty
    table gives an empty result. A column of ``docs`` named ``epoch`` is replaced, others keep their values whatever
    their names.
    """
    ties = [] if tie is None else [tie]
    made = {"_row": order_hash("row", F.col(id_col), *ties), "_tokens": F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))}
    paths = [f"_{name}" for name in levels]
    docs, back = set_aside(docs, **{path: group_key(col) for path, col in zip(paths, levels.values())}, **made)
    slim = saved(docs.select(*paths, "_row", "_tokens"), "mix-rows")
    leaves = slim.groupBy(*paths).agg(F.sum("_tokens").alias("_held"), F.count(F.lit(1)).alias("_rows")).withColumn("capacity", F.col("_held") * max_epochs)
    for i, w in enumerate(weights):
        leaves = leaves.withColumn(f"_weight{i}", w)
    leaves = saved(leaves, "leaves")
    stats = leaves.agg(F.sum("_held").alias("t"), F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("leaves")).first()
    whole = share * float(stats["t"] or 0) if total is None else float(total)
    buckets = bucket_count(stats["n"] or 0, per_bucket)
    epochs = F.when(F.col("_held") > 0, F.floor(F.col("budget") / F.col("_held") + 1e-9)).otherwise(0)
    planned = budgets(leaves, paths, whole, [f"_weight{i}" for i in range(len(weights))])
    planned = planned.withColumn("_epochs", F.least(epochs, F.lit(max_epochs)).cast("int")).withColumn("_part", F.col("budget") - F.col("_epochs") * F.col("_held"))
    planned = saved(planned.select(*paths, "_epochs", "_part"), "budgets")

    order = order_hash(F.concat_ws("/", F.lit(str(seed)), F.col("_epochs").cast("string")), F.col("_row"))
    ordered = _placed(slim, planned.filter("_part > 1e-6"), paths, stats["leaves"], broadcast_leaves).withColumn("_order", order).withColumn("_bucket", hash_bucket(F.col("_order"), buckets))
    sums = ordered.groupBy(*paths, "_bucket").agg(F.sum("_tokens").alias("_sum"), F.max("_part").alias("_part"))
    up_to = F.sum("_sum").over(Window.partitionBy(*paths).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("_up_to", up_to).filter("_up_to >= _part - 1e-6").groupBy(*paths).agg(F.min(F.struct("_bucket", (F.col("_up_to") - F.col("_sum")).alias("_ahead"))).alias("_end"))
    ends = ends.select(*paths, F.col("_end._bucket").alias("_bucket"), F.col("_end._ahead").alias("_ahead"))
    inside = Window.partitionBy(*paths).orderBy("_order", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = ordered.join(ends, [*paths, "_bucket"]).withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
    cuts = last.filter("_before < _part - 1e-6").groupBy(*paths).agg(F.max("_order").alias("_cut"))
    decided = saved(planned.join(cuts, paths, "left").select(*paths, "_epochs", "_cut"), "cuts")

    chosen = _placed(docs.drop("_tokens"), decided.filter("_epochs > 0 OR _cut IS NOT NULL"), paths, stats["leaves"], broadcast_leaves)
    times = F.col("_epochs") + F.when(order <= F.col("_cut"), 1).otherwise(0)
    return chosen.withColumn("_times", times).filter("_times > 0").select(*back("epoch"), F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"))
