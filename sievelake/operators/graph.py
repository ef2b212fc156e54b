"""Reachability as one lazy plan, and connected components in rounds that are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.operators.groups import HOT_ROWS, ROWS, SLOTS, counted_hot_keys, hot_keys, key_hash, salted_join
from sievelake.session import cut_lineage, forget


def hops_to_sink(edges: DataFrame, sinks: DataFrame, max_hops: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Smallest number of edges from each node to any sink, up to `max_hops`.

    The search runs backwards from all sinks at once. Its state is one row per
    node, where a forward search from every source would hold a row per
    (source, node) pair. Every hop joins the state with the edges by their end and
    keeps the smallest number per beginning; each node also has an edge to itself, of length 0,
    that carries its number on. So a hop reads the state once, the plan grows by one join and
    one aggregate a hop, nothing runs while it is built, and the shuffled edges are used again by
    every hop. Nodes with very many incoming edges are salted.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(sinks.select("node")).distinct()
    steps = edges.select("src", "dst", F.lit(1).alias("length")).distinct().unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("length")))
    hot = hot_keys(steps, ["dst"], hot_rows)
    slots_of = lambda node: F.when(F.array_contains(hot, key_hash([node])), F.lit(SLOTS)).otherwise(F.lit(1))
    steps = steps.select("*", slots_of("src").alias("_slots"), F.pmod(F.xxhash64("src", "dst"), slots_of("dst")).alias("_slot"))
    found = sinks.select(F.col("node").alias("dst")).distinct().select("dst", F.lit(0).alias("hops"), slots_of("dst").alias("_slots"))
    for hop in range(1, max_hops + 1):
        offered = found.select("dst", "hops", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_slots") - 1).cast("bigint"))).alias("_slot"))
        met = steps.join(offered, ["dst", "_slot"]).filter((F.col("length") == 0) | (F.col("hops") == hop - 1))
        found = met.groupBy(F.col("src").alias("dst")).agg(F.min(F.col("hops") + F.col("length")).alias("hops"), F.max("_slots").alias("_slots"))
    return found.select(F.col("dst").alias("node"), "hops")


def flow_reaches(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_hops: int = 5) -> DataFrame:
    """(source, reaches, hops) for every source: does a path of at most max_hops lead to a sink?"""
    hops = hops_to_sink(edges, sinks, max_hops)
    asked = sources.select(F.col("node").alias("source")).distinct()
    joined = asked.join(hops, asked["source"] == hops["node"], "left")
    return joined.select("source", F.col("hops").isNotNull().alias("reaches"), "hops")


class _round_join:
    """How rounds join one row per key onto the links: hot keys are counted once, and salted if there are any."""

    def __init__(self, links: DataFrame, key: str, hot_rows: int):
        counts = links.groupBy(key).agg(F.count(F.lit(1)).alias(ROWS))
        n, hot = counts.agg(F.sum(ROWS)).select("*", counted_hot_keys(counts, [key], hot_rows)).first()
        self.links, self.key, self.hot, self.large = links, key, hot, (n or 0) > hot_rows

    def __call__(self, facts: DataFrame) -> DataFrame:
        if not self.hot:
            return self.links.join(facts, self.key)
        return salted_join(self.links, facts, [self.key], F.array(*[F.lit(h) for h in self.hot]))


def components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Connected components of a membership list (member, token): (member, group_id).

    Members that share a token are connected, also through chains. group_id is
    the smallest member. Tokens of a single member connect nothing, so one aggregate first
    leaves the members that share any; the rounds go over these only. Every round takes the smallest label per token and
    per member, hooks label roots, and jumps one level along the labels. A token
    shared by very many members is neither expanded into pairs nor joined in one
    task, and neither are the members of a giant component by their label. Rounds go on until
    nothing changes, about the logarithm of the longest chain; a round's files are
    deleted when the next one is written.
    """
    distinct = cut_lineage(links.select("member", "token").distinct())
    tokens = distinct.groupBy("token").agg(F.count(F.lit(1)).alias(ROWS), F.min("member").alias("_low"))
    held = salted_join(distinct, tokens.filter(F.col(ROWS) > 1).withColumn("_shared", F.lit(True)), ["token"], counted_hot_keys(tokens, ["token"], hot_rows))
    links = cut_lineage(held.filter("_shared").select("member", "token", "_low"))
    # The first round's smallest label per token is known already.
    labels = cut_lineage(links.groupBy("member").agg(F.min("_low").alias("label")))
    pairs = links.select("member", "token")
    join = {key: _round_join(pairs, key, hot_rows) for key in ("member", "token")}
    changed = not labels.isEmpty()
    while changed:
        of_token = join["member"](labels).groupBy("token").agg(F.min("label").alias("low"))
        of_member = join["token"](of_token).groupBy("member").agg(F.min("low").alias("low"))
        seen = labels.join(of_member, "member")
        offers = seen.select("member", F.least("label", "low").alias("label"), F.col("label").alias("_before")).unionByName(
            seen.filter(F.col("low") < F.col("label")).select(F.col("label").alias("member"), F.col("low").alias("label"), F.lit(None).cast(seen.schema["label"].dataType).alias("_before"))
        )
        hooked = offers.groupBy("member").agg(F.min("label").alias("label"), F.max("_before").alias("_before"))
        parent = hooked.select(F.col("member").alias("label"), F.col("label").alias("up"))
        jumped = salted_join(hooked, parent, ["label"], hot_keys(hooked, ["label"], hot_rows)) if join["member"].large else hooked.join(parent, "label")
        after = cut_lineage(jumped.select("member", F.col("up").alias("label"), (F.col("up") < F.col("_before")).alias("_changed")))
        changed = not after.filter("_changed").isEmpty()
        forget(labels)
        labels = after.select("member", "label")
        labels.scratch = after.scratch
    forget(links)
    members = distinct.select("member").distinct()
    return members.join(labels, "member", "left").select("member", F.coalesce("label", "member").alias("group_id"))
