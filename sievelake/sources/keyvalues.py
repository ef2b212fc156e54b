"""Key/value rows from env lines, inline assignments and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import col, strip

INLINE_ASSIGNMENT = r'([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*=[ \t]*"([^"\n]+)"'


def unquote(value: Column) -> Column:
    """Remove one pair of equal quotes around the value."""
    quoted = (F.length(value) >= 2) & (
        (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))
    )
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def extract_kv(lines: DataFrame) -> DataFrame:
    """`KEY=VALUE` lines as KV rows: comments, blanks and empty values are dropped."""
    body = strip(F.col("line"))
    body = F.when(body.startswith("export "), strip(F.substr(body, F.lit(8)))).otherwise(body)
    rows = (
        lines.filter(F.col("line").contains("=") & ~strip(F.col("line")).startswith("#"))
        .select("record_id", "path", "line_no", body.alias("_body"))
        .withColumn("_cut", F.instr("_body", "="))
        .select(
            "record_id",
            "path",
            "line_no",
            strip(F.substring(F.col("_body"), F.lit(1), F.col("_cut") - 1)).alias("key"),
            unquote(strip(F.substr(F.col("_body"), F.col("_cut") + 1))).alias("value"),
        )
    )
    return rows.filter(F.col("value") != "")


def extract_inline_kv(lines: DataFrame) -> DataFrame:
    """`key = "value"` runs anywhere in a line of prose, in order."""
    # Plain substring tests first: the pattern is slow on long words without a sign.
    line = F.col("line")
    hits = lines.filter(line.contains("=") & line.contains('"')).filter(line.rlike(INLINE_ASSIGNMENT))
    keys = F.regexp_extract_all("line", F.lit(INLINE_ASSIGNMENT), 1)
    values = F.regexp_extract_all("line", F.lit(INLINE_ASSIGNMENT), 2)
    return hits.select(
        "record_id",
        "path",
        "line_no",
        F.inline(F.arrays_zip(keys.alias("key"), values.alias("value"))),
    )


def flatten_json(df: DataFrame, json: str, keep=("record_id",), max_depth: int | None = None) -> DataFrame:
    """Leaves of a JSON column as (keep..., key, value) rows.

    Objects add `.name`, arrays add `[index]`; numbers and booleans become text,
    nulls and empty strings vanish. Each row is expanded level by level, as often as
    its own brackets are nested, inside one projection: no shuffle, and the
    input is read once whatever its depth. With `max_depth`, containers below it are dropped.
    """
    entry = "struct<key:string,node:variant,leaf:boolean>"

    def as_object(node: Column) -> Column:
        return F.try_variant_get(node, "$", "map<string,variant>")

    def as_array(node: Column) -> Column:
        return F.try_variant_get(node, "$", "array<variant>")

    def made(key: Column, node: Column, leaf: bool) -> Column:
        return F.struct(key.alias("key"), node.alias("node"), F.lit(leaf).alias("leaf"))

    def child_key(parent: Column, name: Column) -> Column:
        return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("."), name))

    def opened(e: Column) -> Column:
        """Children of a container, or the entry itself marked as a leaf."""
        fields = F.transform(
            F.map_entries(as_object(e["node"])), lambda f: made(child_key(e["key"], f["key"]), f["value"], False)
        )
        items = F.transform(
            as_array(e["node"]),
            lambda item, i: made(F.concat(e["key"], F.lit("["), i.cast("string"), F.lit("]")), item, False),
        )
        return F.when(e["leaf"], F.array(e)).otherwise(
            F.coalesce(fields, items, F.array(made(e["key"], e["node"], True)))
        )

    brackets = F.regexp_replace("_json", r'"(?:[^"\\]|\\.)*+"|[^\[\]{}]', "")
    nested = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, b: F.struct(
            (s["now"] + F.when(b.isin("{", "["), 1).when(b.isin("}", "]"), -1).otherwise(0)).alias("now"),
            F.greatest(s["most"], s["now"] + F.when(b.isin("{", "["), 1).otherwise(0)).alias("most"),
        ),
        lambda s: F.greatest(s["most"], F.lit(1)),
    )
    if max_depth is not None:
        nested = F.least(nested, F.lit(max_depth))
    expanded = F.aggregate(
        F.sequence(F.lit(1), F.col("_depth")),
        F.array(made(F.lit(""), F.col("_doc"), False)).cast(f"array<{entry}>"),
        # Rows whose entries are all leaves pass the remaining levels untouched.
        lambda acc, _: F.when(
            F.exists(acc, lambda e: ~e["leaf"]), F.flatten(F.transform(acc, opened)).cast(f"array<{entry}>")
        ).otherwise(acc),
    )
    parsed = df.select(*keep, col(json).alias("_json"), F.try_parse_json(col(json)).alias("_doc"))
    documents = parsed.filter(as_object(F.col("_doc")).isNotNull()).withColumn("_depth", nested)
    leaves = documents.select(*keep, F.explode(expanded).alias("_leaf"))
    node = F.col("_leaf.node")
    scalar = F.col("_leaf.leaf") | (as_object(node).isNull() & as_array(node).isNull())
    return (
        leaves.filter(scalar)
        .select(*keep, F.col("_leaf.key").alias("key"), F.try_variant_get(node, "$", "string").alias("value"))
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
    )


def json_kv(units: DataFrame, json: str = "text", max_depth: int | None = None) -> DataFrame:
    """Leaves of JSON texts as KV rows (record_id, path, line_no, key, value), for the rules that read configuration.

    A leaf has no line of its own; line_no is 0, as for every key whose line is unknown. Texts that aren't JSON objects give no rows.
    """
    leaves = flatten_json(units, json, keep=("record_id", "path"), max_depth=max_depth)
    return leaves.select("record_id", "path", F.lit(0).alias("line_no"), "key", "value")
