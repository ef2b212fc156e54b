"""Dependencies against vulnerability advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.versions import (
    advisory_severity,
    cvss_base_score,
    normalize_version,
    semver_key,
)
from sievelake.operators.graph import components
from sievelake.operators.groups import join_lookup
from sievelake.session import cut_lineage

RANGE_TYPES = ["SEMVER", "ECOSYSTEM"]
# Version numbers of a module that meet the intervals of its advisories in one place.
BIN = 256


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


KEY_TYPE = "struct<is_valid:int,major:decimal(38,0),minor:decimal(38,0),patch:decimal(38,0),is_release:int,pre:array<struct<is_word:int,size:int,text:string>>>"
SPAN_TYPE = f"struct<lo:{KEY_TYPE},hi:{KEY_TYPE}>"


def _bound(rank: int) -> Column:
    """A key before (-1) or after (2) every version's."""
    zero = F.lit(0).cast("decimal(38,0)")
    fields = {"is_valid": F.lit(rank), "major": zero, "minor": zero, "patch": zero, "is_release": F.lit(0), "pre": F.array()}
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(KEY_TYPE)


def _spans_of_range(events: Column) -> Column:
    """The half-open version intervals in which a range is open.

    Events take effect in their listed order from their version on, so at a version the last listed one among those at or
    below it decides. In order of versions that is a running maximum of the places in the list.
    """
    points = F.flatten(
        F.transform(
            events,
            lambda e, i: F.array(
                F.when(_filled(e["introduced"]).isNotNull(), F.struct(F.when(e["introduced"] == "0", _bound(-1)).otherwise(semver_key(e["introduced"]).cast(KEY_TYPE)).alias("key"), (i * 2).alias("no"), F.lit(True).alias("opens"))),
                F.when(_filled(e["fixed"]).isNotNull(), F.struct(semver_key(e["fixed"]).cast(KEY_TYPE).alias("key"), (i * 2 + 1).alias("no"), F.lit(False).alias("opens"))),
            ),
        )
    )
    ordered = F.array_sort(F.filter(points, lambda p: p.isNotNull()))
    state = F.struct(F.lit(-1).alias("no"), F.lit(False).alias("open"), F.array().cast(f"array<struct<key:{KEY_TYPE},open:boolean>>").alias("steps"))

    def step(acc: Column, p: Column) -> Column:
        later = p["no"] > acc["no"]
        is_open = F.when(later, p["opens"]).otherwise(acc["open"])
        return F.struct(F.greatest(acc["no"], p["no"]).alias("no"), is_open.alias("open"), F.concat(acc["steps"], F.array(F.struct(p["key"].alias("key"), is_open.alias("open")))).alias("steps"))

    def spans(steps: Column) -> Column:
        each = F.transform(steps, lambda t, i: F.struct(t["key"].alias("lo"), F.coalesce(F.get(steps, i + 1)["key"], _bound(2)).alias("hi"), t["open"].alias("open")))
        return F.transform(F.filter(each, lambda x: x["open"] & (x["lo"] < x["hi"])), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")).cast(SPAN_TYPE))

    return F.aggregate(ordered, state, step, lambda acc: spans(acc["steps"]))


def affected_spans(ranges: Column) -> Column:
    """Disjoint half-open intervals of version keys that any range of a comparable type leaves open."""
    usable = F.filter(ranges, lambda r: r["type"].isin(RANGE_TYPES))
    every = F.array_sort(F.flatten(F.transform(usable, lambda r: _spans_of_range(r["events"]))))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (x["lo"] > last["hi"])
        wider = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi")).cast(SPAN_TYPE)
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider)))

    return F.aggregate(every, F.array().cast(f"array<{SPAN_TYPE}>"), merge)


def match_advisories(deps: DataFrame, advisories: DataFrame, order: str = "ord") -> DataFrame:
    """(module, version, adv_id) that match, with the number of dependencies and the first one.

    `advisories` has (adv_id, package, ranges). A package belongs to a module of
    the same path or of one of its leading paths, so each package is exploded
    into its leading paths and joined by equality. Dependencies are first
    reduced to distinct (module, version), which many projects share, and packages to the
    leading paths that are modules of some dependency: a host name alone never is.

    Each advisory's events become intervals once. Versions and the ends of intervals are numbered together within their
    module, so that an interval is a run of version numbers; runs and versions meet in bins of BIN numbers, and a
    module with very many versions or advisories is many bins.
    """
    distinct = deps.groupBy("module", "version").agg(F.count(F.lit(1)).alias("n_deps"), F.min(order).alias("first_ord"))
    return _met(distinct, advisories, "n_deps", "first_ord").select("module", "version", "adv_id", "package", "n_deps", "first_ord")


def first_matches(deps: DataFrame, advisories: DataFrame, order: str = "ord") -> DataFrame:
    """(adv_id, first_ord, module, version, package): of all matches, the first dependency's for each advisory.

    An advisory may hold any number of versions, so these are numbered in the dependencies' order within their module, and the
    smallest number for each advisory and module is a hash aggregate in the tasks that find the matches.
    """
    distinct = deps.groupBy("module", "version").agg(F.min(order).alias("first_ord"))
    nth = distinct.withColumn("_nth", F.row_number().over(Window.partitionBy("module").orderBy("first_ord", "version")))
    least = _met(nth.drop("first_ord"), advisories, "_nth").groupBy("adv_id", "module", "package").agg(F.min("_nth").alias("_nth"))
    of_module = least.join(nth, ["module", "_nth"])
    return of_module.groupBy("adv_id").agg(F.min(F.struct("first_ord", "module", "version", "package")).alias("_first")).select("adv_id", "_first.*")


def _met(distinct: DataFrame, advisories: DataFrame, *kept: str) -> DataFrame:
    """(module, version, adv_id, package) that match, with the columns to keep of `distinct`, which has one row for each version."""
    parts = F.split("package", "/")
    leading = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    # One row per advisory and module: an advisory lists few packages, so this
    # gathers little, and the join then yields each match exactly once.
    offered = (
        advisories.select("adv_id", "package", "ranges", F.explode(leading).alias("module"))
        .join(distinct.select("module").distinct(), "module", "left_semi")
        .groupBy("adv_id", "module")
        .agg(F.min("package").alias("package"), F.flatten(F.sort_array(F.collect_list("ranges"))).alias("_ranges"))
        .select("adv_id", "module", "package", F.posexplode(affected_spans(F.col("_ranges"))).alias("_no", "_span"))
    )
    none = F.lit(None)
    versions = distinct.select("module", semver_key("version").cast(KEY_TYPE).alias("_key"), F.lit(1).alias("_is_version"), "version", *kept, none.cast("string").alias("adv_id"), none.cast("string").alias("package"), none.cast("int").alias("_no"), none.cast("int").alias("_end"))
    ends = offered.select("module", "adv_id", "package", "_no", F.inline(F.array(F.struct(F.lit(0).alias("_end"), F.col("_span.lo").alias("_key")), F.struct(F.lit(1).alias("_end"), F.col("_span.hi").alias("_key")))))
    points = versions.unionByName(ends.withColumn("_is_version", F.lit(0)), allowMissingColumns=True)
    # An end stands before the versions that equal it; its number is that of the first version behind it.
    before = Window.partitionBy("module").orderBy("_key", "_is_version").rowsBetween(Window.unboundedPreceding, -1)
    numbered = points.withColumn("_rank", F.coalesce(F.sum("_is_version").over(before), F.lit(0)))
    bin_of = lambda rank: F.floor(rank / BIN)
    placed = numbered.filter("_is_version = 1").select("module", "version", *kept, "_rank", bin_of(F.col("_rank")).alias("_bin"))
    runs = (
        numbered.filter("_is_version = 0")
        .groupBy("module", "adv_id", "_no")
        .agg(F.min("package").alias("package"), F.min(F.when(F.col("_end") == 0, F.col("_rank"))).alias("_from"), F.max(F.when(F.col("_end") == 1, F.col("_rank"))).alias("_to"))
        .filter("_from < _to")
        .withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(F.col("_to") - 1))))
        .select("module", "adv_id", "package", "_from", "_to", "_bin")
    )
    pairs = placed.join(runs, ["module", "_bin"]).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return pairs.select("module", "version", "adv_id", "package", *kept)


def alias_groups(advisories: DataFrame) -> DataFrame:
    """(adv_id, group_id, best_id): advisories connected through any shared id or alias.

    The best of a group has a severity label, then a GHSA id, then the smallest id.
    """
    one = advisories.groupBy("adv_id").agg(F.max("db_severity").alias("db_severity"))
    tokens = advisories.select(
        F.col("adv_id").alias("member"),
        F.explode(F.array_union(F.array("adv_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias(
            "token"
        ),
    )
    groups = components(tokens).withColumnRenamed("member", "adv_id")
    preference = F.struct(
        F.coalesce(F.col("db_severity") == "", F.col("db_severity").isNull()).alias("unlabelled"),
        (~F.col("adv_id").startswith("GHSA-")).alias("not_ghsa"),
        F.col("adv_id").alias("adv_id"),
    )
    member = groups.join(one, "adv_id")
    best = member.groupBy("group_id").agg(F.min(preference)["adv_id"].alias("best_id"))
    return join_lookup(groups, best, ["group_id"]).select("adv_id", "group_id", "best_id")


def group_aliases(advisories: DataFrame, groups: DataFrame) -> DataFrame:
    """Every id and alias of a group except its best id, as (group_id, alias) rows."""
    names = advisories.select(
        "adv_id",
        F.explode(F.array_union(F.array("adv_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias(
            "alias"
        ),
    )
    merged = names.join(groups, "adv_id").filter(F.col("alias") != F.col("best_id"))
    return merged.select("group_id", "alias").distinct()


def scan_dependencies(deps: DataFrame, advisories: DataFrame, order: str = "ord") -> DataFrame:
    """DEP-VULN once per advisory group, on the first direct dependency the group's best advisory hits."""
    direct = deps.filter(~F.col("indirect"))
    # One row for each advisory, in one reliable copy that is read twice. Of all matches, which compress a hundredfold, Spark
    # would take the files for small and broadcast them.
    firsts = cut_lineage(first_matches(direct, advisories, order))
    hit = advisories.join(firsts.select("adv_id"), "adv_id", "left_semi")
    best = alias_groups(hit).select("group_id", F.col("best_id").alias("adv_id")).distinct()
    first = firsts.join(best, "adv_id")
    # All affected entries of a package in their listed order; equal numbers by content.
    number = F.col("affected_no") if "affected_no" in advisories.columns else F.lit(0)
    listed = hit.select("adv_id", "package", "db_severity", "cvss", "ranges", number.alias("_no"))
    facts = listed.groupBy("adv_id", "package").agg(
        F.min(F.struct("_no", "db_severity", "cvss")).alias("_labels"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_no", "ranges"))), lambda a: a["ranges"])).alias("ranges"),
    )
    rows = first.join(facts.select("adv_id", "package", "_labels.db_severity", "_labels.cvss", "ranges"), ["adv_id", "package"], "left")
    exact = F.col("package") == F.col("module")

    def named(events: Column, field: str) -> Column:
        return F.filter(F.transform(events, lambda e: _filled(e[field])), lambda v: v.isNotNull())

    def last_of(events: Column, field: str) -> Column:
        return F.try_element_at(named(events, field), F.lit(-1))

    def shown(version: Column) -> Column:
        return F.when(version == "0", F.lit("v0.0.0")).otherwise(normalize_version(version))

    # The fix is the first one listed; the range text is that of the first range with a beginning.
    events = F.flatten(F.transform("ranges", lambda r: r["events"]))
    fixed = F.when(exact, normalize_version(F.get(named(events, "fixed"), F.lit(0))))
    spans = F.transform("ranges", lambda r: F.struct(last_of(r["events"], "introduced").alias("low"), last_of(r["events"], "fixed").alias("high")))
    span = F.get(F.filter(spans, lambda s: s["low"].isNotNull()), F.lit(0))
    affected = F.when(exact, F.concat(F.lit(">="), shown(span["low"]), F.coalesce(F.concat(F.lit(", <"), normalize_version(span["high"])), F.lit(""))))
    return rows.select(
        F.lit("DEP-VULN").alias("rule_id"),
        advisory_severity("db_severity", cvss_base_score("cvss")).alias("severity"),
        F.lit("6.3.3").alias("requirement_id"),
        F.lit("dependencies").alias("scanner"),
        F.col("module").alias("record_id"),
        F.col("module").alias("path"),
        F.col("adv_id").alias("subject"),
        "group_id",
        "version",
        "first_ord",
        fixed.alias("fix_version"),
        affected.alias("affected_range"),
    )


def snapshot_freshness(sources: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """Latest snapshot per source up to `as_of` and its state then; later ones don't count, and sources without one are cold."""
    moment = F.lit(as_of).cast("timestamp")
    latest = snapshots.filter(F.col("ts").cast("timestamp") <= moment).groupBy("source").agg(
        F.max(F.col("ts").cast("timestamp")).alias("latest"), F.count(F.lit(1)).alias("n_snapshots")
    )
    age = F.floor((F.unix_seconds(moment) - F.unix_seconds("latest")) / 86400)
    rows = (
        sources.select("source")
        .distinct()
        .join(latest, "source", "left")
        .withColumn("age_days", age)
        .withColumn(
            "state",
            F.when(F.col("age_days").isNull(), F.lit("cold"))
            .when(F.col("age_days") >= fv.CRITICAL_DAYS, F.lit("critical"))
            .when(F.col("age_days") >= fv.STALE_DAYS, F.lit("stale"))
            .otherwise(F.lit("fresh")),
        )
    )
    return rows.withColumn(
        "rule_id",
        F.when(F.col("state") == "cold", F.lit("DEP-CACHE-COLD")).when(
            F.col("state").isin("stale", "critical"), F.lit("DEP-CACHE-STALE")
        ),
    )
