"""Ignore rules, inline markers and package exclusions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.paths import rule_regex, rule_regex_of
from sievelake.functions.text import extension, strip
from sievelake.operators.groups import join_lookup
from sievelake.schemas import text_list

# Listed rules up to this number are cheaper to try on every row than to join.
FEW_RULES = 16
EXCLUDE_PREFIX = "exclude-package:"
IGNORE_SOURCE = "ignore-file:"


@dataclass(frozen=True)
class IgnoreRule:
    source_line: int
    pattern: str
    line_no: int = 0  # 0 means every line


@dataclass(frozen=True)
class ExcludeRule:
    source_line: int
    pattern: str


def parse_ignore_lines(lines: list[str]) -> tuple[list[IgnoreRule], list[ExcludeRule]]:
    """Rules of an ignore file: `path`, `path:*`, `path:N`, `exclude-package: glob`, `# comment`."""
    rules, excludes = [], []
    for number, raw in enumerate(lines, start=1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith(EXCLUDE_PREFIX):
            pattern = line.removeprefix(EXCLUDE_PREFIX).strip()
            if pattern:
                excludes.append(ExcludeRule(number, pattern))
            continue
        head, colon, tail = line.rpartition(":")
        if colon and head and tail == "*":
            rules.append(IgnoreRule(number, head))
        elif colon and head and tail.isdecimal() and int(tail) > 0:
            rules.append(IgnoreRule(number, head, int(tail)))
        else:
            rules.append(IgnoreRule(number, line))
    return rules, excludes


def read_ignore_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rule tables (ignore rules, exclusions) of an ignore file of any length, in the syntax of parse_ignore_lines()."""
    text = spark.read.text(path, wholetext=True)
    line = strip(F.col("_line"))
    rows = text.select(F.posexplode(F.split("value", "\n")).alias("_at", "_line")).select((F.col("_at") + 1).alias("source_line"), line.alias("_rule"))
    rows = rows.filter((F.col("_rule") != "") & ~F.col("_rule").startswith("#"))
    package = F.col("_rule").startswith(EXCLUDE_PREFIX)
    excludes = rows.filter(package).select("source_line", strip(F.substr("_rule", F.lit(len(EXCLUDE_PREFIX) + 1))).alias("pattern"), F.lit(0).alias("line_no"))
    head, tail = (F.regexp_extract("_rule", r"^(.+):(\*|0*[1-9][0-9]{0,8})$", k) for k in (1, 2))
    rules = rows.filter(~package).select(
        "source_line",
        F.when(tail != "", head).otherwise(F.col("_rule")).alias("pattern"),
        F.coalesce(F.when(tail != "*", tail.try_cast("int")), F.lit(0)).alias("line_no"),
    )
    return rules, excludes.filter("pattern != ''")


def rules_table(spark: SparkSession, rules) -> DataFrame:
    rows = [(r.source_line, r.pattern, getattr(r, "line_no", 0)) for r in rules]
    return spark.createDataFrame(rows, "source_line int, pattern string, line_no int")


def _longest(candidates: Column) -> Column:
    """The candidate with the longest literal text."""
    return F.array_max(F.transform(candidates, lambda c: F.struct(F.length(c["text"]).alias("n"), c.alias("anchor"))))["anchor"]


def _anchor(position, kind: str, text: Column, depth=0) -> Column:
    """What a path must have for a rule to match: a text that its part at `position` is (E), begins (H) or ends (T) with.

    Position 0 is the whole path, -1 its last segment, others count segments of paths with `depth` segments.
    """
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(number(depth).alias("depth"), number(position).alias("position"), F.lit(kind).alias("kind"), F.coalesce(text, F.lit("")).alias("text"))


def _index_rules(rules: DataFrame) -> DataFrame:
    """Rules with their regex and the anchor under which paths find them.

    A glob is cut into segments; the segment with the longest literal beginning or end is the anchor, or the whole path of a
    glob without wildcards. A rule with ** is found by its literal beginning or by the literal part of its file glob. Classes
    and escapes may reach over a slash, so globs with any are found by what stands before the first of them.
    """
    pattern = F.col("pattern")
    starred = pattern.contains("**")
    head = F.substring_index(pattern, "**", 1)
    rest = F.substr(pattern, F.length(head) + 3)
    whole_tree = starred & rest.isin("", "/")
    odd = lambda g: g.rlike(r"[\[\\]")
    before = lambda g: F.regexp_extract(g, r"^[^*?\[\\]*", 0)
    after = lambda g: F.regexp_extract(g, r"[^*?]*$", 0)
    plain = lambda g: ~g.rlike(r"[*?\[\\]")

    parts = F.split(pattern, "/")
    depth = F.size(parts)
    segments = F.flatten(
        F.transform(
            parts,
            lambda g, i: F.when(plain(g), F.array(_anchor(i + 1, "E", g, depth))).otherwise(F.array(_anchor(i + 1, "H", before(g), depth), _anchor(i + 1, "T", after(g), depth))),
        )
    )
    glob = F.substr(rest, F.lit(2))
    aligned = (head == "") | head.endswith("/")
    last = (
        F.when(glob.contains("/") | odd(glob), F.array(_anchor(0, "H", head)))
        .when(~aligned, F.array(_anchor(0, "H", head), _anchor(-1, "T", after(glob))))
        .when(plain(glob), F.array(_anchor(0, "H", head), _anchor(-1, "E", glob)))
        .otherwise(F.array(_anchor(0, "H", head), _anchor(-1, "H", before(glob)), _anchor(-1, "T", after(glob))))
    )
    anchor = (
        F.when(whole_tree, _anchor(0, "H", head))
        .when(starred, _longest(last))
        .when(plain(pattern), _anchor(0, "E", pattern))
        .when(odd(pattern), _anchor(0, "H", before(pattern)))
        .otherwise(_longest(segments))
    )
    return rules.select(
        "source_line",
        "pattern",
        F.col("line_no").alias("_rule_line"),
        rule_regex_of(pattern).alias("_regex"),
        F.when(starred & ~whole_tree, F.length(head) + 1).otherwise(F.lit(0)).alias("_min_length"),
        anchor.alias("_anchor"),
    )


def match_rule_table(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule per (path, line_no) for rule tables of any size.

    The rules' anchors have few shapes: where in the path, which end, and how long a text. They are read first, as a
    path gives one text for each shape, and meets the rules that have this text by equality; only these pairs meet the
    regex. So a hundred thousand rules cost a path as many texts as there are shapes. Texts that very many paths share are
    left to Spark, which broadcasts rules when they are small and else splits such partitions. Rules that name no
    literal text, such as `*`, meet every path that has their number of segments.
    """
    indexed = _index_rules(rules)
    size = F.when(F.col("_anchor.kind") == "E", F.lit(0)).otherwise(F.length("_anchor.text"))
    shapes = indexed.select("_anchor.depth", "_anchor.position", "_anchor.kind", size.alias("size")).distinct().collect()
    parts = F.split("path", "/")

    def text_of(depth: int, position: int, kind: str, size: int) -> Column:
        part = F.col("path") if position == 0 else F.element_at(parts, -1) if position < 0 else F.get(parts, F.lit(position - 1))
        text = part if kind == "E" else F.when(F.length(part) >= size, F.left(part, F.lit(size)) if kind == "H" else F.right(part, F.lit(size)))
        fits = text.isNotNull() & (F.lit(True) if depth == 0 else F.size(parts) == depth)
        own = [F.lit(depth).alias("depth"), F.lit(position).alias("position"), F.lit(kind).alias("kind"), text.alias("text")]
        return F.when(fits, F.struct(*own))

    if not shapes:
        none = F.lit(None).cast("struct<source_line:int,pattern:string>")
        return findings.select("path", "line_no", none.alias("_rule")).limit(0)
    texts = F.array(*[text_of(*s) for s in sorted(shapes)])
    places = findings.select("path", "line_no").distinct().select("path", "line_no", F.explode(texts).alias("_anchor")).filter("_anchor IS NOT NULL")
    places = places.select("path", "line_no", "_anchor.*")
    offered = indexed.select("*", "_anchor.*").drop("_anchor")
    pairs = places.join(offered, ["depth", "position", "kind", "text"]).filter(
        F.expr("path rlike _regex")
        & (F.length("path") >= F.col("_min_length"))
        & ((F.col("_rule_line") == 0) | (F.col("_rule_line") == F.col("line_no")))
    )
    return pairs.groupBy("path", "line_no").agg(F.min(F.struct("source_line", "pattern")).alias("_rule"))


def _first_rule(rules, path: Column, line_no: Column | None) -> Column:
    """Struct of the first matching rule of a short list in source order, or null."""
    result = None
    for rule in sorted(rules, key=lambda r: r.source_line):
        hit = path.rlike(rule_regex(rule.pattern))
        head, stars, tail = rule.pattern.partition("**")
        if stars and tail not in ("", "/"):
            hit = hit & (F.length(path) > len(head))
        if line_no is not None and getattr(rule, "line_no", 0) > 0:
            hit = hit & (line_no == rule.line_no)
        made = F.struct(F.lit(rule.source_line).alias("source_line"), F.lit(rule.pattern).alias("pattern"))
        result = F.when(hit, made) if result is None else result.when(hit, made)
    return F.lit(None).cast("struct<source_line:int,pattern:string>") if result is None else result


def _marked(findings: DataFrame, rules, by_line: bool) -> DataFrame:
    """Findings with the first matching rule, of a list or a table, in `_rule`.

    A handful of listed rules is tried in the scan, without a shuffle; longer lists are tables, found by their texts.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= FEW_RULES:
        return findings.withColumn("_rule", _first_rule(rules, F.col("path"), F.col("line_no") if by_line else None))
    table = rules if isinstance(rules, DataFrame) else rules_table(findings.sparkSession, rules)
    table = table if by_line else table.withColumn("line_no", F.lit(0))
    return join_lookup(findings, match_rule_table(findings, table), ["path", "line_no"])


def apply_suppressions(findings: DataFrame, rules) -> DataFrame:
    """Mark findings matched by an ignore rule, given as a list or as a table; nothing is dropped."""
    rule = F.col("_rule")
    return (
        _marked(findings, rules, True)
        .withColumn("suppressed", rule.isNotNull())
        .withColumn("suppression_reason", F.concat(F.lit("pattern "), rule["pattern"]))
        .withColumn("suppression_source", F.concat(F.lit(IGNORE_SOURCE), rule["source_line"].cast("string")))
        .drop("_rule")
    )


def marker_reason(line: Column, markers: list[str], closing: str) -> Column:
    """Text after the first of `markers` that occurs in the line; null without one."""
    result = None
    for marker in markers:
        after = F.substr(line, F.instr(line, marker) + len(marker))
        if closing:
            after = F.regexp_replace(strip(after), f"{closing}$", "")
        hit = line.contains(marker)
        result = F.when(hit, strip(after)) if result is None else result.when(hit, strip(after))
    return result


def inline_suppressions(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Apply markers found on the flagged line to findings no ignore rule matched.

    Lines are cut down to those with a marker, and their reasons read, before
    the join by equality on (record_id, line_no), and crowded lines are split. The file
    type of the finding then picks the reason given in its comment syntax.
    """
    line = F.col("line")
    reasons = [f"_reason_{n}" for n in range(len(fv.INLINE_MARKERS))]
    marked = lines.filter(line.contains("pci-ignore:")).select(
        "record_id",
        "line_no",
        *[marker_reason(line, markers, end).alias(r) for r, (_, markers, end) in zip(reasons, fv.INLINE_MARKERS)],
    )
    # A line that is given twice counts once.
    marked = marked.groupBy("record_id", "line_no").agg(*[F.min(r).alias(r) for r in reasons])
    if "suppressed" not in findings.columns:
        findings = (
            findings.withColumn("suppressed", F.lit(False))
            .withColumn("suppression_reason", F.lit(None).cast("string"))
            .withColumn("suppression_source", F.lit(None).cast("string"))
        )
    ext = extension(F.col("path"))
    # Few lines have a reason; only their paths are looked at.
    chosen = F.coalesce(*[F.when(F.col(r).isNotNull() & ext.isin(exts), F.col(r)) for r, (exts, _, _) in zip(reasons, fv.INLINE_MARKERS)])
    joined = join_lookup(findings, marked, ["record_id", "line_no"]).withColumn("_reason", F.when(~F.col("suppressed"), chosen))
    found = F.col("_reason").isNotNull()
    return (
        joined.withColumn("suppression_reason", F.coalesce("_reason", "suppression_reason"))
        .withColumn(
            "suppression_source", F.when(found, F.lit("inline comment")).otherwise(F.col("suppression_source"))
        )
        .withColumn("suppressed", F.col("suppressed") | found)
        .drop("_reason", *reasons)
    )


def exclude_packages(findings: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """(kept findings, one SUPPRESSED-PACKAGE row per matching rule with its count).

    The first matching rule, of a list or a table, takes a finding.
    """
    marked = _marked(findings, rules, False)
    kept = marked.filter(F.col("_rule").isNull()).drop("_rule")
    counts = (
        marked.filter(F.col("_rule").isNotNull())
        .groupBy(F.col("_rule.source_line").alias("source_line"), F.col("_rule.pattern").alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n_dropped"))
    )
    reports = counts.select(
        F.lit("SUPPRESSED-PACKAGE").alias("rule_id"),
        F.lit("INFO").alias("severity"),
        F.lit("n/a").alias("requirement_id"),
        F.lit("suppression").alias("scanner"),
        F.col("pattern").alias("path"),
        F.col("source_line").alias("line_no"),
        F.concat(F.lit("Exclusion dropped "), F.col("n_dropped").cast("string"), F.lit(" findings")).alias(
            "description"
        ),
        text_list([]).alias("related_requirements"),
        "n_dropped",
    )
    return kept, reports
