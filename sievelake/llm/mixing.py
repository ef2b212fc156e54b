"""Hierarchical token budgets over a tree of domains, languages and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import ROWS_PER_BIN, all_of, bins_for, group_key, hash_bin, running, seeded_order
from sievelake.session import cut_lineage


def water_fill(nodes: DataFrame, parent: list[str], budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """Split each parent's `budget` over its children by weight, none above its capacity.

    What a full child can't take goes to its siblings by their weights. Children
    are put in the order of capacity / weight; the first that isn't full sets the
    level of all that follow. Children of weight 0 get nothing.
    """
    ratio = F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf")))
    rows = nodes.withColumn("_ratio", ratio).withColumn("_cap", F.when(F.col(weight) > 0, F.col(capacity)).otherwise(0))
    order = Window.partitionBy(*parent).orderBy("_ratio", "_node")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_before", before).withColumn("_left", left)
    level = F.when(F.col("_left") > 0, F.greatest(F.col(budget) - F.col("_before"), F.lit(0.0)) / F.col("_left"))
    rows = rows.withColumn("_open", F.when(F.col("_ratio") > level, level))
    # The first child that isn't full sets the level; where all are full there is none.
    mark = F.min("_open_at").over(Window.partitionBy(*parent))
    rows = rows.withColumn("_at", F.row_number().over(order)).withColumn("_open_at", F.when(F.col("_open").isNotNull(), F.struct("_at", "_open")))
    rows = rows.withColumn("_level", mark["_open"]).withColumn("_stop", mark["_at"])
    share = F.when(F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")), F.col("_cap").cast("double")).otherwise(
        F.col("_level") * F.col(weight)
    )
    return rows.withColumn(out, share).drop("_ratio", "_cap", "_before", "_left", "_open", "_at", "_open_at", "_level", "_stop")


def leaf_budgets(leaves: DataFrame, levels: list[str], total: int, weights: list[Column], max_epochs: int) -> DataFrame:
    """Token budgets of the leaves, given `available` tokens of each.

    `weights` has one expression for each level, over that level's columns; a
    null weight counts as 0. The root gets `total`, or all there is if that is
    less. Going down, every node's share is filled among its children, and a node
    can hold max_epochs times what lies below it in leaves that have weight all the way; so a shortage
    is made good by siblings first, and only what they can't take has gone to the ancestors' siblings.
    """
    weights = [F.greatest(F.coalesce(w.cast("double"), F.lit(0.0)), F.lit(0.0)) for w in weights]
    tree = leaves.withColumn("_capacity", F.when(all_of([w > 0 for w in weights]), F.col("available") * F.lit(max_epochs)).otherwise(0))
    whole = tree.agg(F.least(F.lit(float(total)), F.sum("_capacity").cast("double")).alias("_budget_0"), F.lit(0).alias("_root"))
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        node = tree.groupBy(*path).agg(F.sum("_capacity").alias("_capacity"))
        node = node.withColumn("_root", F.lit(0)).withColumn("_weight", weights[depth - 1])
        above = ["_root", *levels[: depth - 1]]
        node = node.join(whole, above).withColumn("_node", F.col(path[-1]))
        whole = water_fill(node, above, f"_budget_{depth - 1}", "_capacity", "_weight", f"_budget_{depth}")
        whole = whole.select("_root", *path, f"_budget_{depth}")
    return leaves.join(whole, levels).withColumn("budget", F.floor(F.round(f"_budget_{len(levels)}", 6)).cast("long")).drop("_root", f"_budget_{len(levels)}")


def mix(
    df: DataFrame,
    levels: list[Column],
    weights: list[Column],
    total: int | float,
    key: str = "doc_id",
    tokens: str = "n_tokens",
    max_epochs: int = 1,
    seed: str = "mix",
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Rows selected under hierarchical budgets, with `epoch` and `take` (tokens taken from the row's start).

    `total` is a number of tokens, or as a float a share of the tokens there are.
    `levels` are the tree's columns from the root's children down; weight
    expressions may use `level_1`, `level_2`, ... and see the text "" for null.
    A leaf with a budget of b tokens gives every row in b // available whole
    epochs, and in one more the rows whose tokens start before the rest is used
    up, in an order seeded for that epoch; the last of them gives only a prefix.

    Rows without tokens (null, empty) are kept once, in epoch 0, when their leaf has a
    budget, and take 0; a leaf that has no tokens at all keeps its rows. Repeated rows
    are taken one by one. Null levels form a node of their own. An empty table gives an
    empty one. Columns named `epoch` or `take` are replaced; others are carried along.
    """
    names = [f"level_{i + 1}" for i in range(len(levels))]
    kept = [c for c in df.columns if c not in ("epoch", "take")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{tokens}`").alias("_n"), *[F.coalesce(x.cast("string"), F.lit("")).alias(f"_l{i}") for i, x in enumerate(levels)])
    rows = rows.withColumn("_tokens", F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(0)).cast("long"))
    inner = [f"_l{i}" for i in range(len(levels))]
    leaves = rows.groupBy(*inner).agg(F.sum("_tokens").alias("available"), F.count(F.lit(1)).alias("_rows"))
    leaves = cut_lineage(leaves.withColumnsRenamed(dict(zip(inner, names, strict=True))))
    counted = leaves.agg(F.sum("_rows").alias("rows"), F.sum("available").alias("tokens")).first()
    bins = bins_for(counted["rows"] or 0, rows_per_bin)
    wanted = int((counted["tokens"] or 0) * total) if isinstance(total, float) else total
    budgets = leaf_budgets(leaves, names, wanted, weights, max_epochs).withColumnsRenamed(dict(zip(names, inner, strict=True))).drop("_rows")
    whole = F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(F.lit(1))
    budgets = budgets.withColumn("_whole", whole).withColumn("_rest", F.when(F.col("available") > 0, F.col("budget") - F.col("available") * whole).otherwise(0))
    marked = rows.join(cut_lineage(budgets), inner)
    every = marked.filter(F.col("_whole") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_whole") - 1).cast("int"))))
    every = every.filter((F.col("epoch") == 0) | (F.col("_tokens") > 0)).withColumn("take", F.col("_tokens"))
    part = marked.filter(F.col("_rest") > 0).withColumn("epoch", F.col("_whole").cast("int"))
    part = part.withColumn("_leaf", group_key(*inner)).withColumn("_hash", seeded_order(seed, "epoch", "_key"))
    part = part.withColumn("_bin", hash_bin(F.col("_hash"), bins))
    part = running(part, ["_leaf"], "_bin", ["_hash", "_key", "_tokens"], F.col("_tokens"), "_start", "_all")
    part = part.filter(all_of([F.col("_start") < F.col("_rest"), (F.col("_tokens") > 0) | (F.col("epoch") == 0)]))
    part = part.withColumn("take", F.least(F.col("_tokens"), F.col("_rest") - F.col("_start")))
    out = ["_row.*", "epoch", "take"]
    return every.select(*out).unionByName(part.select(*out))

