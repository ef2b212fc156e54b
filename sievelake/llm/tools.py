"""Tool calls in conversations: linked with their results, put in order, checked, and written as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import bins_for, group_key, hash_bin, running
from sievelake.session import cut_lineage

#: Levels of objects and arrays that arguments and schemas may have.
MOST_LEVELS = 200
# The schema keywords that are checked, and those that say nothing about a value.
CHECKED = frozenset(
    "type enum const required properties additionalProperties items minItems maxItems uniqueItems minLength maxLength pattern minimum maximum "
    "exclusiveMinimum exclusiveMaximum multipleOf minProperties maxProperties allOf anyOf oneOf not".split()
)
SILENT = frozenset("title description default examples $schema $id $comment $defs definitions format deprecated readOnly writeOnly".split())
LONE = re.compile("[\ud800-\udfff]")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def number_text(value: float) -> str:
    """A finite double as ECMAScript writes it."""
    if value == 0:
        return "0"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    if "e" not in text:
        return _point(text) if abs(value) < 1e-6 else text
    digits, power = text.split("e")
    if -7 < int(power) < 0:
        return f"{value:.{len(digits.replace('.', '').lstrip('-')) - 1 - int(power)}f}"
    return f"{digits}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"


def _point(text: str) -> str:
    mantissa = text.lstrip("-0.")
    power = -(len(text.split(".")[1]) - len(mantissa) + 1)
    return f"{'-' if text[0] == '-' else ''}{mantissa[0]}{'.' + mantissa[1:] if len(mantissa) > 1 else ''}e{power}"


def canonical(value) -> str:
    """JSON without white space, keys in the order of their UTF-16 units, numbers in their shortest form."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return number_text(value)
    return _escaped(json.dumps(value, ensure_ascii=False))


def _escaped(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 can't hold, as JSON escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _levels(value) -> int:
    """Levels of nesting, counted without recursion."""
    deepest, todo = 0, [(value, 1)]
    while todo:
        x, level = todo.pop()
        if isinstance(x, (dict, list)):
            deepest = max(deepest, level)
            todo += [(y, level + 1) for y in (x.values() if isinstance(x, dict) else x)]
    return deepest


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    """A JSON value; ValueError otherwise, also for NaN, infinities and more than MOST_LEVELS levels."""
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except RecursionError as deep:
        raise ValueError("nested too deeply") from deep
    if _levels(value) > MOST_LEVELS:
        raise ValueError("nested too deeply")
    return value


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def problems(value, schema, at: str = "$") -> list[str]:
    """What in a value breaks a JSON schema, by the keywords in CHECKED; any other keyword that could matter is a problem itself."""
    if schema is True or not isinstance(schema, dict):
        return [f"{at}: not allowed"] if schema is False else []
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: expected {' or '.join(kinds)}"]
    out = [f"{at}: schema has {k}, which is not supported" for k in sorted(schema.keys() - CHECKED - SILENT)]
    for k in ("allOf", "anyOf", "oneOf"):
        if k in schema:
            fits = [not problems(value, s, at) for s in schema[k]]
            if not (all(fits) if k == "allOf" else any(fits) if k == "anyOf" else sum(fits) == 1):
                out.append(f"{at}: {k}")
    if "not" in schema and not problems(value, schema["not"], at):
        out.append(f"{at}: not")
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        out += _sized(value, schema, at, "minProperties", "maxProperties")
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif "additionalProperties" in schema:
                out += problems(value[k], schema["additionalProperties"], f"{at}.{k}")
    elif isinstance(value, list):
        out += _sized(value, schema, at, "minItems", "maxItems")
        if schema.get("uniqueItems") is True and len({canonical(x) for x in value}) < len(value):
            out.append(f"{at}: uniqueItems")
        for k, x in enumerate(value):
            out += problems(x, schema.get("items", True), f"{at}[{k}]")
    elif isinstance(value, str):
        out += _sized(value, schema, at, "minLength", "maxLength")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: maximum")
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            out.append(f"{at}: exclusiveMinimum")
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            out.append(f"{at}: exclusiveMaximum")
        if "multipleOf" in schema and value / schema["multipleOf"] % 1:
            out.append(f"{at}: multipleOf")
    return out


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES.get(kind, ()))


def _sized(value, schema: dict, at: str, least: str, most: str) -> list[str]:
    n = len(value)
    return [f"{at}: {least}"] * (n < schema.get(least, n)) + [f"{at}: {most}"] * (n > schema.get(most, n))


@lru_cache(1024)
def _schema(text: str):
    return parse(text)


def judge(name: str | None, arguments: str | None, schema: str | None) -> tuple[str | None, list[str]]:
    """Canonical arguments (null if they aren't JSON) and what is wrong with them."""
    try:
        value = parse(arguments or "")
    except ValueError:
        return None, ["$: not JSON"]
    if schema is None:
        return canonical(value), [f"unknown tool {name}" if name is not None else "no tool"]
    try:
        rules = _schema(schema)
    except ValueError:
        return canonical(value), ["schema: not JSON"]
    try:
        return canonical(value), [_escaped(p) for p in problems(value, rules)]
    except Exception as wrong:  # a schema may hold anything where a number, a list or a pattern belongs
        return canonical(value), [f"schema: {type(wrong).__name__}"]


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth): how many calls a call comes after. Null for calls in or behind a circle.

    Every call names one call that it comes after, or none. Each round joins calls with the call that
    their pointer has reached and doubles its reach, so a chain of n calls takes log2(n) rounds. Calls
    that have reached a first call take no part in later rounds.
    """
    total = calls.count()
    known = calls.select(F.col("call_id").alias("_known"))
    state = cut_lineage(calls.select("call_id", "after").join(known, F.col("after") == F.col("_known"), "left").select("call_id", F.col("_known").alias("up"), F.when(F.col("_known").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    done, open_ = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    for _ in range(max(1, total).bit_length() + 1):
        if open_.isEmpty():
            break
        above = done.unionByName(open_).select(F.col("call_id").alias("_at"), F.col("up").alias("_up"), F.col("steps").alias("_more"))
        moved = open_.join(above, F.col("up") == F.col("_at")).select("call_id", F.col("_up").alias("up"), (F.col("steps") + F.col("_more")).alias("steps"))
        state = cut_lineage(done.unionByName(moved))
        done, open_ = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"))


def numbered(rows: DataFrame, turn: str, content: list[str]) -> DataFrame:
    """Number the distinct rows of each `_id` from 0 by turn, nulls first, then by a hash of the content, as `_no`."""
    bins = bins_for(rows.count())
    marked = rows.withColumn("_hash", F.md5(group_key(*content)))
    marked = marked.withColumn("_bin", F.struct(F.col(turn).isNotNull(), F.coalesce(F.col(turn), F.lit(0)), hash_bin(F.col("_hash"), bins)))
    return running(marked, ["_id"], "_bin", ["_hash"], F.lit(1).cast("long"), "_no", "_whole").drop("_hash", "_bin", "_whole")


def latest(spots: DataFrame, asks: DataFrame) -> DataFrame:
    """Which calls of an identifier (`_id`) a row of some turn means: those of the last turn up to its own, else of the first turn.

    `_kind` is 1 for rows that calls of their own turn come before, -1 for others. Adds `_first` and `_size`, null without calls.
    """
    marks = spots.select("_id", F.col("turn").alias("_turn"), F.lit(0).alias("_kind"), F.struct("_first", "_size").alias("_spot"))
    marks = marks.unionByName(asks.select("_id", "_turn", "_kind").distinct(), allowMissingColumns=True)
    order = Window.partitionBy("_id").orderBy("_turn", "_kind")
    before = F.last("_spot", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.first("_spot", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = marks.withColumn("_meant", F.coalesce(before, start)).filter("_kind != 0")
    found = found.select("_id", group_key("_turn").alias("_t"), "_kind", "_meant.*")
    return asks.withColumn("_t", group_key("_turn")).join(found, ["_id", "_t", "_kind"], "left").drop("_t")


def node_of(identifier: str, number: Column) -> Column:
    return F.concat(F.col(identifier), F.lit("#"), number.cast("string"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for every distinct call and every distinct result, linked within the conversation, with place, verdict and canonical JSON.

    `calls` has conv_id, turn, call_id, after (the identifier of a call that must come first, or null), name
    and arguments (JSON text); `results` has conv_id, call_id, turn and content; `schemas` has name and schema (JSON
    Schema text). Other columns are ignored. Identifiers hold within a conversation; a null conv_id is a value like
    others. Distinct calls of one identifier are numbered by turn (`call_no`, from 1), and so are its results (`result_no`);
    equal rows are one. A result belongs to the calls of the last turn up to its own (else of the first), the k-th such
    result to the k-th such call, and results beyond them to the last of these, each in a row of its own. Nothing is
    multiplied or left out. `n_calls` and `n_results` count all rows of the identifier.

    `status` is `linked`, `no_result`, or `orphan` for results without a call. `depth` orders calls
    topologically: whoever comes after another is deeper; `after` means the first call of its identifier's last turn up to
    the call's own (before it, if it is the same identifier); a call whose `after` is unknown begins at 0, and calls
    in or behind a circle have no depth. `errors` lists what breaks the tool's schema,
    `valid` says that nothing does. `message` is canonical JSON of call and result, null where the arguments aren't
    JSON. Rows with a null identifier can't be linked and stand alone: each call is `no_result`, each
    result `orphan`. Empty tables give an empty one.

    Where `results` has no conv_id, identifiers hold across conversations, and the smallest (turn, content) of an
    identifier is its result; the others are listed in `further_results`.
    """
    within = ["conv_id"] if "conv_id" in results.columns else []
    fields = ["conv_id", "turn", "call_id", "after", "name", "arguments"]
    calls = calls.select(*fields)
    results = results.select(*within, "call_id", F.col("turn").alias("result_turn"), "content")
    loose_calls, loose_results = calls.filter("call_id IS NULL"), results.filter("call_id IS NULL")
    known = calls.filter("call_id IS NOT NULL").withColumn("_id", group_key(*within, "call_id")).groupBy("_id", *fields).agg(F.count(F.lit(1)).alias("_copies"))
    known = cut_lineage(numbered(cut_lineage(known), "turn", fields))
    found = results.filter("call_id IS NOT NULL").withColumn("_id", group_key(*within, "call_id"))
    counts = known.groupBy("_id").agg(F.sum("_copies").alias("n_calls")).join(found.groupBy("_id").agg(F.count(F.lit(1)).alias("n_results")), "_id", "full").na.fill(0)
    further = []
    if within:
        found = found.distinct()
    else:
        further = ["further_results"]
        listed = F.array_sort(F.collect_set(F.struct("result_turn", "content"))).alias("_all")
        found = found.groupBy("_id", "call_id").agg(listed, F.min(F.struct("result_turn", "content")).alias("_result"))
        found = found.select("_id", "call_id", "_result.*", F.filter("_all", lambda r: ~r.eqNullSafe(F.col("_result"))).alias("further_results"))
    found = numbered(cut_lineage(found), "result_turn", ["result_turn", "content"]).withColumnRenamed("_no", "_result_no")
    spots = known.groupBy("_id", "turn").agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_size"))
    found = cut_lineage(latest(spots, found.withColumn("_turn", F.col("result_turn")).withColumn("_kind", F.lit(1))))
    begun = found.filter("_first IS NOT NULL").groupBy("_id", "_first").agg(F.min("_result_no").alias("_begun"))
    found = found.join(begun, ["_id", "_first"], "left")
    found = found.withColumn("_no", F.col("_first") + F.least(F.col("_result_no") - F.col("_begun"), F.col("_size") - 1))
    renamed = {c: f"_own_{c}" for c in [*within, "call_id"]}
    both = known.join(found.select("_id", "_no", "_result_no", "result_turn", "content", *further, *[F.col(c).alias(n) for c, n in renamed.items()]).withColumn("_link", F.col("_no")).drop("_no").withColumnRenamed("_id", "_result_id"), (F.col("_id") == F.col("_result_id")) & (F.col("_no") == F.col("_link")), "full")
    both = both.withColumns({c: F.coalesce(c, n) for c, n in renamed.items()}).withColumn("_id", F.coalesce("_id", "_result_id")).join(counts, "_id")
    both = both.withColumn("call_no", F.col("_no") + 1).withColumn("result_no", F.col("_result_no") + 1).withColumn("_node", node_of("_id", F.col("_no")))

    asks = known.filter("after IS NOT NULL").select(node_of("_id", F.col("_no")).alias("_node"), group_key(*within, "after").alias("_id"), F.col("turn").alias("_turn"), F.when(F.col("after") == F.col("call_id"), -1).otherwise(1).alias("_kind"))
    above = latest(spots, asks).select("_node", node_of("_id", F.col("_first")).alias("after"))
    nodes = known.select(node_of("_id", F.col("_no")).alias("_node")).join(above, "_node", "left").withColumnRenamed("_node", "call_id")
    deep = depths(cut_lineage(nodes)).withColumnRenamed("call_id", "_node")
    placed = both.join(deep, "_node", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    loose_calls = loose_calls.withColumns({"n_calls": one, "call_no": one, "n_results": none, "depth": none})
    loose_results = loose_results.withColumns({"n_results": one, "result_no": one, "n_calls": none})
    columns = ["conv_id", "call_id", "turn", "depth", "name", "status", "n_calls", "n_results", "call_no", "result_no", "result_turn", *further]
    placed = placed.select(*[c for c in columns if c != "status"], "arguments", "content")
    placed = placed.unionByName(loose_calls.drop("after"), allowMissingColumns=True).unionByName(loose_results, allowMissingColumns=True)
    placed = placed.withColumn("status", F.when(F.col("call_no").isNull(), "orphan").when(F.col("result_no").isNull(), "no_result").otherwise("linked"))
    tools = schemas.groupBy("name").agg(F.min("schema").alias("_schema"))
    placed = placed.join(tools, "name", "left")
    kinds = dict(placed.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, messages = [], [], []
            for one in batch.select(["call_id", "name", "arguments", "content", "status", "_schema"]).to_pylist():
                if one["status"] == "orphan":
                    text, wrong = None, ["no call"]
                else:
                    text, wrong = judge(one["name"], one["arguments"], one["_schema"])
                valid.append(not wrong)
                errors.append("; ".join(wrong))
                if text is None and one["status"] != "orphan":
                    messages.append(None)
                    continue
                call = f'{{"arguments":{text},"id":{canonical(one["call_id"])},"name":{canonical(one["name"])}}}' if text is not None else "null"
                messages.append(f'{{"call":{call},"result":{canonical(one["content"])},"result_for":{canonical(one["call_id"])}}}')
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(messages, pa.string())], names=[*columns, "valid", "errors", "message"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", valid boolean, errors string, message string"
    return placed.select(*columns, "arguments", "content", "_schema").mapInArrow(work, schema)
