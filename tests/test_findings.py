import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions import paths
from sievelake.operators import (
    context,
    dependencies,
    graph,
    groups,
    inventory,
    paging,
    pairing,
    requirements,
    schema,
    summary,
    suppression,
    triage,
)
from sievelake.plans.report import compliance_report
from sievelake.sources.packages import single_range

FINDINGS = "ord long, rule_id string, severity string, requirement_id string, path string, line_no int, record_id string, scanner string, related_requirements array<string>"


def findings(spark, *rows):
    """Rows of (rule, severity, requirement, path, line, related)."""
    full = [(i, r, s, q, p, n, p, r.split("-")[0].lower(), rel) for i, (r, s, q, p, n, rel) in enumerate(rows)]
    return spark.createDataFrame(full, FINDINGS)


def some(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["PAN-LITERAL", "SEC-PREFIX", "CSP-OK", "DEP-VULN"]), rng.choice(fv.SEVERITIES), rng.choice(["3.4.1", "8.6.2", "10.2.1"]), f"d/f{rng.randint(0, 9)}.go", rng.randint(1, 50), [])
        for _ in range(n)
    ]
    return rows, findings(spark, *rows)


# ---- joining facts ------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [0, 2, 10, 1_000_000])
def test_join_facts_is_a_left_join_whatever_is_hot(spark, hot_rows):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 30 + ["b", "c", "d", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string")
    lookup = spark.createDataFrame([("a", 1), ("b", 2), ("z", 9), (None, 5)], "k string, v int")
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias(groups.ROWS))
    facts = counts.join(lookup, counts.k.eqNullSafe(lookup.k)).select(counts.k, "v", groups.ROWS)
    got = sorted((r.i, r.v) for r in groups.join_facts(df, facts, ["k"], hot_rows).collect())
    values = {"a": 1, "b": 2, None: 5}
    assert got == sorted((i, values.get(k)) for i, k in rows)


def test_hot_rows_are_spread(spark):
    """A key with a third of the rows must not meet one shuffle partition."""
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    facts = df.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias(groups.ROWS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = groups.join_facts(df, facts, ["k"], hot_rows=1000)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 30_000 / 8
        assert joined.filter("k = 0").agg(F.min("top"), F.max("top")).collect()[0] == (29_997, 29_997)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("matched", [True, False])
def test_hot_keys_of_a_lookup_are_spread(spark, matched):
    """A hot key is dealt to slots whether the lookup has it or not; null is a key, and nothing is broadcast by a hint."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id"))
    df = spark.range(30_000).select("id", key.alias("k"))
    lookup = spark.createDataFrame([(None if matched else -1, "hot"), (1, "one")], "k long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = groups.join_lookup(df, lookup, ["k"], hot_rows=1000)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert max(r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()) < 2 * 30_000 / 8
        assert {(r.v, r["count"]) for r in joined.groupBy("v").count().collect()} == ({("hot", 10_000), ("one", 1), (None, 19_999)} if matched else {("one", 1), (None, 29_999)})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hot_keys_are_few_and_real(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).when(F.col("id") % 5 == 0, F.lit(-2)).otherwise(F.col("id")).alias("k"))
    (found,) = spark.range(1).select(groups.hot_keys(df, ["k"], 5_000)).first()
    want = {r[0] for r in spark.createDataFrame([(-1,), (-2,)], "k long").select(groups.key_hash(["k"])).collect()}
    assert set(found) == want
    assert spark.range(1).select(groups.hot_keys(df.limit(0), ["k"], 5_000)).first()[0] == []


# ---- suppressions -------------------------------------------------------------

IGNORE = ["# note", "", "testdata/**", "config/a.yaml:7", "docs/*.md:*", "**/*.html", "exclude-package: gen/**", "exclude-package:", "odd:name"]


def test_parse_ignore_lines(spark, tmp_path):
    rules, excludes = suppression.parse_ignore_lines(IGNORE)
    assert [(r.source_line, r.pattern, r.line_no) for r in rules] == [
        (3, "testdata/**", 0), (4, "config/a.yaml", 7), (5, "docs/*.md", 0), (6, "**/*.html", 0), (9, "odd:name", 0),
    ]
    assert [(r.source_line, r.pattern) for r in excludes] == [(7, "gen/**")]
    (tmp_path / "ignore").write_text("\n".join(IGNORE))
    tables = suppression.read_ignore_file(spark, str(tmp_path / "ignore"))
    assert [sorted(map(tuple, t.collect())) for t in tables] == [[(r.source_line, r.pattern, getattr(r, "line_no", 0)) for r in own] for own in (rules, excludes)]


PATHS = ["testdata/x.html", "config/a.yaml", "docs/r.md", "docs/x/r.md", "a/b/c.html", "c.html", "src/a.go", "odd:name", "x/testdata/a"]


def test_rule_list_and_rule_table_agree(spark):
    rules, _ = suppression.parse_ignore_lines(IGNORE)
    df = findings(spark, *[("R", "HIGH", "1", p, n, []) for p in PATHS for n in (7, 8)])
    by_list = suppression.apply_suppressions(df, rules)
    by_table = suppression.apply_suppressions(df, suppression.rules_table(spark, rules))
    columns = ["path", "line_no", "suppressed", "suppression_reason", "suppression_source"]
    first = sorted(map(tuple, by_list.select(*columns).collect()), key=str)
    assert first == sorted(map(tuple, by_table.select(*columns).collect()), key=str)
    assert {(r[0], r[1]): r[4] for r in first if r[2]} == {
        ("testdata/x.html", 7): "ignore-file:3", ("testdata/x.html", 8): "ignore-file:3", ("config/a.yaml", 7): "ignore-file:4",
        ("docs/r.md", 7): "ignore-file:5", ("docs/r.md", 8): "ignore-file:5", ("a/b/c.html", 7): "ignore-file:6", ("a/b/c.html", 8): "ignore-file:6",
        ("c.html", 7): "ignore-file:6", ("c.html", 8): "ignore-file:6", ("odd:name", 7): "ignore-file:9", ("odd:name", 8): "ignore-file:9",
    }


GLOBS = [r"a\*b", "a*b", "[ab]x", "[^a]x", "d[1", "[]x]y", "a?b", "x\\", r"q\[z", "a.b", "t/**", "t/**/", "t/**/*.g?", "**/[xy].c", "p+(**", r"[\d]"]
NAMES = ["a*b", "aXb", "ax", "bx", "cx", "d[1", "xy", "]y", "a/b", "a.b", "x\\", "q[z", "t/u/v.go", "t/v.gx", "t/", "z/x.c", "p+(q/r", "\\", "d", "azb"]


def test_both_glob_translations_agree(spark):
    rows = [(g, n) for g in GLOBS for n in NAMES]
    df = spark.createDataFrame(rows, "g string, n string").withColumn("own", paths.rule_regex_of(F.col("g")))
    by_column = {(r.g, r.n): r.hit for r in df.selectExpr("g", "n", "n rlike own AS hit").collect()}
    for glob in GLOBS:
        by_text = {r.n: r.hit for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", paths.glob_match(glob, "n").alias("hit")).collect()}
        assert by_text == {n: by_column[glob, n] for n in NAMES}, glob


@pytest.mark.parametrize("extra", [0, 300])
def test_answers_do_not_depend_on_the_number_of_rules(spark, extra):
    rules = [suppression.IgnoreRule(i + 1, g) for i, g in enumerate(GLOBS)] + [suppression.IgnoreRule(1000 + i, f"never{i}/**") for i in range(extra)]
    df = findings(spark, *[("R", "HIGH", "1", n, 1, []) for n in NAMES])
    by_table = {r.path: r.suppression_source for r in suppression.apply_suppressions(df, suppression.rules_table(spark, rules)).collect()}
    got = {r.path: r.suppression_source for r in suppression.apply_suppressions(df, rules).collect()}
    assert got == by_table
    assert got["a*b"] == "ignore-file:1" and got["d[1"] == "ignore-file:5" and got["]y"] == "ignore-file:6" and got["azb"] == "ignore-file:2"


def random_globs(rng, n):
    """Globs of every form over a small alphabet, so that many match."""
    words = ["a", "b", "ab", "gen", "x_test", "mod1", "mod12", "c.go", "d.go", "e.yaml", "z"]
    piece = lambda: rng.choice([*words, "*", "?", "*.go", "mod*", "*_test", "a*b", "*o*", "[ab]", "[^a]*", r"a\\*", "m?d1*"])
    out = []
    for _ in range(n):
        body = "/".join(piece() for _ in range(rng.randint(1, 4)))
        out.append(rng.choice([body, body, f"{rng.choice(words)}/**", f"{rng.choice(words)}**", f"**/{piece()}", f"{rng.choice(words)}/**/{piece()}", f"a**/{piece()}", "**", f"{body}**/"]))
    return out


def test_indexed_rules_against_every_pair(spark):
    """Rules found by their texts are those that match when each rule meets each path."""
    rng = random.Random(11)
    rules = [suppression.IgnoreRule(i + 1, g, rng.choice([0, 0, 0, 7])) for i, g in enumerate(random_globs(rng, 400))]
    names = ["a", "b", "ab", "gen", "x_test", "mod1", "mod12", "mod123", "c.go", "d.go", "e.yaml", "z", "axb", "a*", ""]
    places = sorted({("/".join(rng.choice(names) for _ in range(rng.randint(1, 4))), rng.choice([7, 8])) for _ in range(400)})
    want = {}
    for path, line in places:
        for rule in rules:
            head, stars, tail = rule.pattern.partition("**")
            long_enough = not stars or tail in ("", "/") or len(path) > len(head)
            if re.search(paths.rule_regex(rule.pattern), path) and long_enough and rule.line_no in (0, line):
                want[path, line] = rule.source_line
                break
    for chosen in (rules, [r for r in rules if "*" not in r.pattern or r.source_line % 7 == 0]):
        numbers = {r.source_line for r in chosen}
        df = spark.createDataFrame(places, "path string, line_no int")
        got = {(r.path, r.line_no): r._rule.source_line for r in suppression.match_rule_table(df, suppression.rules_table(spark, chosen)).collect()}
        if chosen is rules:
            assert got == want
        else:
            assert set(got.values()) <= numbers and len(got) > 20


def test_many_rules_meet_few_paths(spark):
    """Fifty thousand rules that begin with a wildcard: a path meets those with its own texts only."""
    n = 50_000
    rules = spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("source_line"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("**/*_test"), "id", F.lit(".go"))).otherwise(F.concat(F.lit("*/mod"), "id", F.lit("/*.go"))).alias("pattern"),
        F.lit(0).alias("line_no"),
    )
    places = spark.range(1, n + 1).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("a/b/c_test"), "id", F.lit(".go"))).otherwise(F.concat(F.lit("x/mod"), "id", F.lit("/y.go"))).alias("path"), F.lit(1).alias("line_no"), "id")
    matched = suppression.match_rule_table(places, rules)
    assert matched.count() == n
    assert matched.join(places, ["path", "line_no"]).filter("_rule.source_line != id").isEmpty()


def test_repeated_lines_do_not_repeat_findings(spark):
    lines = spark.createDataFrame([("a.go", 1, "x() // pci-ignore: ok")] * 3, "record_id string, line_no int, line string")
    got = suppression.inline_suppressions(findings(spark, ("R", "HIGH", "1", "a.go", 1, [])), lines).collect()
    assert [r.suppression_reason for r in got] == ["ok"]


def test_long_rule_lists(spark):
    rules = [suppression.IgnoreRule(i, f"never{i}/**") for i in range(1, 300)] + [suppression.IgnoreRule(300, "src/*.go")]
    df = findings(spark, ("R", "HIGH", "1", "src/a.go", 1, []), ("R", "HIGH", "1", "lib/a.go", 1, []))
    got = {r.path: r.suppression_source for r in suppression.apply_suppressions(df, rules).collect()}
    assert got == {"src/a.go": "ignore-file:300", "lib/a.go": None}


def test_inline_markers_follow_the_file_type(spark):
    lines = spark.createDataFrame(
        [("a.go", 1, "x() // pci-ignore: ok here "), ("a.go", 2, "x() # pci-ignore: wrong"), ("b.yaml", 1, "k: v #pci-ignore: fine"),
         ("c.html", 1, "<p> <!-- pci-ignore: page --> "), ("d.txt", 1, "# pci-ignore: no")],
        "record_id string, line_no int, line string",
    )
    df = findings(spark, *[("R", "HIGH", "1", p, n, []) for p, n in [("a.go", 1), ("a.go", 2), ("b.yaml", 1), ("c.html", 1), ("d.txt", 1), ("a.go", 9)]])
    got = {(r.path, r.line_no): r.suppression_reason for r in suppression.inline_suppressions(df, lines).collect()}
    assert got == {("a.go", 1): "ok here", ("a.go", 2): None, ("b.yaml", 1): "fine", ("c.html", 1): "page", ("d.txt", 1): None, ("a.go", 9): None}


def test_ignore_rules_come_before_markers(spark):
    df = suppression.apply_suppressions(findings(spark, ("R", "HIGH", "1", "a.go", 1, [])), [suppression.IgnoreRule(1, "*.go")])
    lines = spark.createDataFrame([("a.go", 1, "// pci-ignore: late")], "record_id string, line_no int, line string")
    assert suppression.inline_suppressions(df, lines).collect()[0].suppression_source == "ignore-file:1"


def test_exclusions_count_by_first_rule(spark):
    rules = [suppression.ExcludeRule(1, "gen/**"), suppression.ExcludeRule(2, "**/*.go"), suppression.ExcludeRule(3, "none/**")]
    df = findings(spark, *[("R", "HIGH", "1", p, 1, []) for p in ["gen/a.go", "gen/b", "x/c.go", "y"]])
    kept, reports = suppression.exclude_packages(df, rules)
    for kept, reports in ((kept, reports), suppression.exclude_packages(df, suppression.rules_table(spark, rules))):
        assert [r.path for r in kept.collect()] == ["y"]
        assert sorted((r.path, r.line_no, r.n_dropped) for r in reports.collect()) == [("**/*.go", 2, 1), ("gen/**", 1, 2)]


# ---- requirements -------------------------------------------------------------

DIM = [
    ("1", "One", True, None, None), ("2", "Two", True, None, None), ("3", "Three", True, None, None), ("4", "Four", True, None, None),
    ("5", "Five", False, None, None), ("6", "Six", False, "1", None), ("7", "Seven", False, None, "on site"), ("8", "Eight", False, None, None),
]


def catalogue(spark):
    return spark.createDataFrame(DIM, "requirement_id string, title string, covered boolean, covered_by string, reason string")


def judged(spark):
    df = findings(
        spark, ("A", "HIGH", "1", "a", 1, ["5", "2"]), ("A", "LOW", "1", "a", 2, []), ("B", "INFO", "2", "a", 3, ["5"]), ("C", "CRITICAL", "3", "x", 4, ["8"]),
        ("D", "CRITICAL", "5", "a", 5, []),
    )
    return suppression.apply_suppressions(df, [suppression.IgnoreRule(1, "x")])


def test_status_and_propagation(spark):
    status = requirements.requirement_status(catalogue(spark), judged(spark))
    assert {r.requirement_id: (r.status, r.finding_count) for r in status.collect()} == {
        "1": ("FAIL", 2), "2": ("PASS", 0), "3": ("SUPPRESSED", 1), "4": ("PASS", 0),
        "5": ("NOT_CHECKED", 0), "6": ("NOT_CHECKED", 0), "7": ("NOT_CHECKED", 0), "8": ("NOT_CHECKED", 0),
    }
    spread = {r.requirement_id: (r.status, r.cross_reference) for r in requirements.propagate_related(status, judged(spark)).collect()}
    assert spread["5"] == ("FAIL", "same finding as 1")
    assert spread["8"] == ("NOT_CHECKED", "")
    assert spread["2"] == ("PASS", "")
    why = {r.requirement_id: r.explanation for r in requirements.not_checked(status, catalogue(spark)).collect()}
    assert why == {"5": "Five needs manual review", "6": "partly covered by 1 One", "7": "on site", "8": "Eight needs manual review"}
    totals = {r.metric: r.n for r in requirements.report_summary(status, judged(spark)).collect()}
    assert (totals["pass"], totals["fail"], totals["suppressed"], totals["not_checked"], totals["checked"]) == (2, 1, 1, 4, 4)
    assert (totals["critical"], totals["high"], totals["info"], totals["gate_failed"]) == (1, 1, 1, 1)


def test_gate(spark):
    assert requirements.gate(findings(spark, ("A", "LOW", "1", "a", 1, []))).collect()[0].overall == "PASS"
    assert requirements.gate(findings(spark, ("A", "MEDIUM", "1", "a", 1, []))).collect()[0].overall == "FAIL"
    assert requirements.gate(judged(spark).limit(0)).collect()[0].overall == "PASS"


def test_explain_and_enrich(spark):
    ids = spark.createDataFrame([(" 1 ",), ("9",)], "requirement_id string")
    got = {r.requirement_id: (r.title, r.error) for r in requirements.explain_requirements(ids, catalogue(spark)).collect()}
    assert got == {"1": ("One", None), "9": (None, "unknown requirement 9")}
    titles = requirements.enrich_requirements(findings(spark, ("A", "LOW", "1", "a", 1, []), ("A", "LOW", "n/a", "a", 1, [])), catalogue(spark))
    assert {r.requirement_id: r.requirement_title for r in titles.collect()} == {"1": "One", "n/a": ""}


def test_mapping_drift(spark):
    canonical = spark.createDataFrame(fv.RULE_REQUIREMENTS, "rule_id string, requirement_id string")
    df = findings(spark, ("PAN-LITERAL", "HIGH", "3.4.1", "a", 1, []), ("PAN-LITERAL", "HIGH", "9.9", "a", 1, []), ("NEW-RULE", "LOW", "1", "a", 1, []))
    assert {(r.rule_id, r.requirement_id) for r in requirements.mapping_drift(df, canonical).collect()} == {("PAN-LITERAL", "9.9"), ("NEW-RULE", "1")}


# ---- summaries, ranks, pages --------------------------------------------------


def test_counts_and_histogram(spark):
    rows, df = some(spark)
    assert {r.severity: r.n for r in summary.severity_counts(df.filter("severity <> 'LOW'")).collect()} == {
        s: 0 if s == "LOW" else sum(r[1] == s for r in rows) for s in fv.SEVERITIES
    }
    ranked = sorted({r[0] for r in rows}, key=lambda k: (-sum(r[0] == k for r in rows), k))
    got = summary.rule_histogram(df, 3).orderBy("rank").collect()
    assert [r.rule_id for r in got] == ranked[:3] and {r.more_rules for r in got} == {1}
    by_rule = summary.findings_by_rule(df).collect()
    firsts = {k: next(r for r in rows if r[0] == k) for k in ranked}
    assert [r.rule_id for r in by_rule] == sorted(ranked, key=lambda k: (fv.SEVERITIES.index(firsts[k][1]), -sum(r[0] == k for r in rows)))
    assert {r.rule_id: (r.severity, r.requirement_id) for r in by_rule} == {k: (f[1], f[2]) for k, f in firsts.items()}
    assert [r.category for r in summary.category_rollup(df).collect()] == ["3", "8", "10"]
    units = spark.createDataFrame([("a\nb",), ("c",)], "text string")
    totals = {(r.metric, r.name): r.n for r in summary.scan_summary(df, units).collect()}
    assert totals[("findings", "all")] == 400 and totals[("scanned", "lines")] == 3 and totals[("scanned", "units")] == 2


def test_top_n(spark):
    rows, df = some(spark)
    got = {(r.severity, r.rank): (r.rule_id, r.path) for r in summary.top_n_per_severity(df, 3).collect()}
    for s in fv.SEVERITIES:
        best = sorted((r[0], r[3]) for r in rows if r[1] == s)[:3]
        assert [got[(s, i + 1)] for i in range(3)] == best


@pytest.mark.parametrize("bin_width", [1, 16, 1 << 20])
def test_pages_cover_everything_once(spark, bin_width):
    rows, df = some(spark, 130)
    whole = [r.ord for r in summary.sort_by_severity(df).collect()]
    seen, offset, pages = [], 0, 0
    while offset is not None:
        page = summary.paginate(df, offset, bin_width=bin_width).orderBy("row_no").collect()
        seen += [r.ord for r in page]
        offset, pages = page[0].next_offset, pages + 1
    assert seen == whole and pages == 3
    assert summary.paginate(df, 500).count() == 0
    assert summary.paginate(df, 0, limit=5).count() == 5
    with pytest.raises(ValueError):
        summary.paginate(df, 0, limit=61)


def test_filters(spark):
    rows, df = some(spark)
    assert summary.filter_findings(df, "high").count() == sum(r[1] in ("CRITICAL", "HIGH") for r in rows)
    assert summary.filter_findings(df, "bogus").count() == 400
    assert summary.filter_findings(df, rule_filter="PAN-LITERAL, CSP-OK").count() == sum(r[0] in ("PAN-LITERAL", "CSP-OK") for r in rows)
    assert summary.filter_findings(df, rule_filter="/^(PAN|SEC)-/").count() == sum(r[0][:3] in ("PAN", "SEC") for r in rows)
    assert [r.ord for r in summary.filter_findings(df, limit=3).collect()] == [0, 1, 2]
    assert summary.drop_verified_ok(df).count() == sum(r[0] != "CSP-OK" for r in rows)


# ---- schema history, pairs ----------------------------------------------------


def dropped_by_hand(events, self_ord):
    later = sorted((o, op) for o, op in events if o > self_ord)
    first = next((o for o, op in later if op == "DROP"), None)
    return first is not None and not any(op == "ADD" and o > first for o, op in later)


def test_dropped_columns_against_replay(spark):
    rng = random.Random(11)
    events, rows = {}, []
    for c in range(60):
        events[f"c{c}"] = [(o, rng.choice(["ADD", "DROP"])) for o in range(1, rng.randint(1, 9))]
        rows += [("t", o, op, f"c{c}") for o, op in events[f"c{c}"]]
    history = spark.createDataFrame(rows, "table_name string, ord long, op string, column_name string")
    found = [("t", c, o, "HIGH") for c in events for o in range(0, 10)]
    df = spark.createDataFrame(found, "table_name string, column_name string, ord long, severity string")
    for r in schema.dropped_column_downgrade(df, history).collect():
        assert (r.severity == "INFO") == dropped_by_hand(events[r.column_name], r.ord), (r, events[r.column_name])


PAIRED = "ord long, rule_id string, severity string, path string, line_no int, kind string, subject string, function_name string"


def test_pairs(spark):
    df = spark.createDataFrame(
        [
            (1, "PAN-KEYWORD", "MEDIUM", "a", 1, "field", "cardNumber", ""), (2, "PAN-KEYWORD", "HIGH", "a", 1, "tag", "card_number", ""),
            (3, "PAN-KEYWORD", "HIGH", "a", 2, "field", "cvv", ""), (4, "PAN-KEYWORD", "CRITICAL", "a", 2, "tag", "pan", ""),
            (5, "PAN-KEYWORD", "HIGH", "a", 3, "field", "cvv", ""), (6, "PAN-TYPE", "MEDIUM", "a", 1, "tag", "card_number", ""),
            (7, "PAN-KEYWORD", "LOW", "b", 1, "tag", "cvv", ""), (8, "PAN-KEYWORD", "CRITICAL", "b", 1, "field", "CVV", ""),
        ],
        PAIRED,
    )
    assert {r.ord: r.severity for r in pairing.dedup_paired(df).collect()} == {
        1: "HIGH", 3: "HIGH", 4: "CRITICAL", 5: "HIGH", 6: "MEDIUM", 8: "CRITICAL",
    }


def test_repeated(spark):
    df = spark.createDataFrame(
        [(1, "PAN-TYPE", "MEDIUM", "a", 1, "", "pan", "f"), (2, "PAN-TYPE", "HIGH", "a", 5, "", "pan", "g"), (3, "PAN-TYPE", "LOW", "a", 9, "", "pan", "f"),
         (4, "PAN-TYPE", "LOW", "a", 9, "", "cvv", "f"), (5, "PAN-KEYWORD", "CRITICAL", "a", 9, "", "pan", "f")],
        PAIRED,
    )
    assert {(r.subject, r.severity, r.n, r.first_ord) for r in pairing.group_repeated(df).collect()} == {("pan", "HIGH", 3, 1), ("cvv", "LOW", 1, 4)}
    assert {(r.subject, r.function_name) for r in pairing.repeated_members(df).collect()} == {("pan", "f"), ("pan", "g"), ("cvv", "f")}


# ---- dependencies -------------------------------------------------------------


def advisories(spark, rows):
    """Rows of (id, aliases, package, introduced, fixed, label, cvss)."""
    df = spark.createDataFrame(rows, "adv_id string, aliases array<string>, package string, introduced string, fixed string, db_severity string, cvss string")
    return df.withColumn("ranges", single_range(F.col("introduced"), F.col("fixed")))


def deps(spark, *rows):
    full = [(i, m, v, ind) for i, (m, v, ind) in enumerate(rows)]
    return spark.createDataFrame(full, "ord long, module string, version string, indirect boolean")


def test_version_ranges(spark):
    found = dependencies.match_advisories(
        deps(spark, ("m", "v1.0.0", False), ("m", "v1.5.0", False), ("m", "v2.0.0-rc.1", False), ("m", "v2.0.0", False), ("mm", "v1.0.0", False), ("m/sub", "v1.0.0", False)),
        advisories(spark, [("A", [], "m", "1.5.0", "2.0.0", None, None), ("B", [], "m/sub", "0", None, None, None), ("C", [], "m", None, "1.1.0", None, None)]),
    )
    assert {(r.module, r.version, r.adv_id) for r in found.collect()} == {
        ("m", "v1.5.0", "A"), ("m", "v2.0.0-rc.1", "A"), ("m", "v1.0.0", "B"), ("m", "v1.5.0", "B"), ("m", "v2.0.0-rc.1", "B"), ("m", "v2.0.0", "B"), ("m/sub", "v1.0.0", "B"),
    }


def test_events_fold_in_listed_order_over_any_range(spark):
    schema_text = (
        "adv_id string, package string, ranges array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"
    )
    ev = lambda i=None, f=None: {"introduced": i, "fixed": f, "last_affected": None}
    rows = [
        ("reopened", "m", [{"type": "SEMVER", "events": [ev("0"), ev(f="1.2.0"), ev("1.4.0")]}]),
        ("listed", "m", [{"type": "SEMVER", "events": [ev(f="1.2.0"), ev("0")]}]),
        ("second", "m", [{"type": "SEMVER", "events": [ev("9.0.0")]}, {"type": "ECOSYSTEM", "events": [ev("1.0.0"), ev(f="2.0.0")]}]),
        ("git", "m", [{"type": "GIT", "events": [ev("0")]}]),
        ("none", "m", []),
    ]
    found = dependencies.match_advisories(deps(spark, ("m", "v1.3.0", False), ("m", "v1.5.0", False)), spark.createDataFrame(rows, schema_text))
    assert {(r.adv_id, r.version) for r in found.collect()} == {
        ("reopened", "v1.5.0"), ("listed", "v1.3.0"), ("listed", "v1.5.0"), ("second", "v1.3.0"), ("second", "v1.5.0"),
    }


def test_intervals_against_folding_every_pair(spark):
    """Random events in random order, several ranges, open ends, repeated and odd versions; many versions of one module."""
    rng = random.Random(4)
    ev = lambda i=None, f=None: {"introduced": i, "fixed": f, "last_affected": None}
    schema = "adv_id string, package string, ranges array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"
    number = lambda: f"{rng.randint(0, 3)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}" + rng.choice(["", "", "-rc.1"])

    def event():
        return rng.choice([ev("0"), ev(number()), ev(number()), ev(f=number()), ev(f=number()), ev(number(), number()), ev(), ev(""), ev("odd")])

    rows = [(f"A{i}", rng.choice(["m", "m/sub"]), [{"type": rng.choice(["SEMVER", "ECOSYSTEM", "SEMVER", "GIT"]), "events": [event() for _ in range(rng.randint(0, 6))]} for _ in range(rng.randint(0, 3))]) for i in range(120)]
    versions = sorted({"v" + number() for _ in range(700)}) + ["odd", "v1", "1.2.3"]

    def key(v):
        v = v if v.startswith("v") else "v" + v
        if not re.fullmatch(r"v\d+(\.\d+(\.\d+(-[0-9a-z.]+)?)?)?", v):
            return (0, 0, 0, 0, 0)
        main, _, label = v[1:].partition("-")
        return (1, *[int(x) for x in (main.split(".") + ["0", "0"])[:3]], 0 if label else 1)

    def affected(v, ranges):
        for r in ranges:
            state = False
            for e in r["events"] if r["type"] != "GIT" else []:
                if e["introduced"] and (e["introduced"] == "0" or key(v) >= key(e["introduced"])):
                    state = True
                if e["fixed"] and key(v) >= key(e["fixed"]):
                    state = False
            if state:
                return True
        return False

    want = {(v, a) for v in versions for a, _, ranges in rows if affected(v, ranges)}
    found = dependencies.match_advisories(deps(spark, *[("m", v, False) for v in versions]), spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len(want) and {(r.version, r.adv_id) for r in found} == want


def test_alias_groups_bridge(spark):
    rows = [
        ("GO-2", ["CVE-1"], "m", "0", None, None, None), ("GHSA-9", ["CVE-2"], "m", "0", None, "HIGH", None), ("GO-1", ["CVE-1", "CVE-2"], "m", "0", None, None, None),
        ("GO-7", ["GO-8"], "m", "0", None, "LOW", None), ("GO-8", [], "m", "0", None, "LOW", None), ("GO-9", None, "m", "0", None, None, None),
    ]
    adv = advisories(spark, rows)
    groups_of = dependencies.alias_groups(adv)
    assert {r.adv_id: (r.group_id, r.best_id) for r in groups_of.collect()} == {
        "GO-2": ("GHSA-9", "GHSA-9"), "GHSA-9": ("GHSA-9", "GHSA-9"), "GO-1": ("GHSA-9", "GHSA-9"),
        "GO-7": ("GO-7", "GO-7"), "GO-8": ("GO-7", "GO-7"), "GO-9": ("GO-9", "GO-9"),
    }
    assert {(r.group_id, r.alias) for r in dependencies.group_aliases(adv, groups_of).collect()} == {
        ("GHSA-9", "GO-1"), ("GHSA-9", "GO-2"), ("GHSA-9", "CVE-1"), ("GHSA-9", "CVE-2"), ("GO-7", "GO-8"),
    }


def test_several_affected_entries_and_ranges(spark):
    ev = lambda i=None, f=None: {"introduced": i, "fixed": f, "last_affected": None}
    semver = lambda *events: {"type": "SEMVER", "events": list(events)}
    schema = "adv_id string, aliases array<string>, package string, affected_no int, db_severity string, cvss string, ranges array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"
    rows = [
        ("A", [], "m", 0, "HIGH", None, [semver(ev("0"))]),
        ("A", [], "m", 1, "HIGH", None, [semver(ev("2.0.0"), ev(f="2.3.0"))]),
        ("B", [], "n", 0, "LOW", None, [semver(ev("0"), ev(f="1.2.0"), ev("2.0.0"), ev(f="2.3.0"))]),
        ("C", [], "o", 0, "LOW", None, [semver(ev(f="0.9.0")), semver(ev("0"))]),
    ]
    want = {("A", "v2.3.0", ">=v0.0.0"), ("B", "v1.2.0", ">=v2.0.0, <v2.3.0"), ("C", "v0.9.0", ">=v0.0.0")}
    used = deps(spark, ("m", "v1.0.0", False), ("n", "v2.1.0", False), ("o", "v3.0.0", False))
    for order in (rows, rows[::-1]):
        found = dependencies.scan_dependencies(used, spark.createDataFrame(order, schema).repartition(3)).collect()
        assert {(r.subject, r.fix_version, r.affected_range) for r in found} == want


def test_only_first_matches_are_kept(spark, monkeypatch):
    """Forty advisories hold thirty versions each: forty rows are written and joined, not 1200."""
    written = []

    def counted(df):
        written.append(df.count())
        return df

    monkeypatch.setattr(dependencies, "cut_lineage", counted)
    known = advisories(spark, [(f"A-{i:02}", [], "m" if i % 2 else "m/sub", "0", None, "LOW", None) for i in range(40)])
    # Two versions are as early as each other; the smaller text is the first.
    used = spark.createDataFrame([("m", f"v1.{i}.0", max(30 - i, 2), False) for i in range(30)], "module string, version string, ord long, indirect boolean")
    found = dependencies.scan_dependencies(used, known).collect()
    assert max(written) == 40
    assert {(r.subject, r.version, r.first_ord) for r in found} == {(f"A-{i:02}", "v1.28.0", 2) for i in range(40)}
    every = dependencies.match_advisories(used, known)
    assert every.count() == 1200
    firsts = every.groupBy("adv_id").agg(F.min(F.struct("first_ord", "module", "version", "package")).alias("f")).select("adv_id", "f.*")
    assert sorted(firsts.collect()) == sorted(dependencies.first_matches(used, known).collect())


def test_scan_dependencies(spark):
    rows = [
        ("GO-1", ["CVE-1"], "m", "1.0.0", "1.4.0", None, None), ("GHSA-1", ["CVE-1"], "m", "1.0.0", "1.4.0", "MODERATE", None),
        ("GO-2", [], "n/sub", "0", None, None, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), ("GO-3", [], "i", "0", None, "LOW", None),
    ]
    found = dependencies.scan_dependencies(deps(spark, ("m", "v1.2.0", False), ("m", "v1.1.0", False), ("n", "v0.1.0", False), ("i", "v1.0.0", True)), advisories(spark, rows))
    assert {(r.subject, r.severity, r.path, r.version, r.fix_version, r.affected_range) for r in found.collect()} == {
        ("GHSA-1", "MEDIUM", "m", "v1.2.0", "v1.4.0", ">=v1.0.0, <v1.4.0"), ("GO-2", "CRITICAL", "n", "v0.1.0", None, None),
    }


def test_snapshots(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "source string")
    shots = spark.createDataFrame([("a", "2024-01-30"), ("b", "2024-01-25"), ("b", "2024-01-01"), ("c", "2024-01-17"), ("e", "2024-01-18")], "source string, ts string")
    got = dependencies.snapshot_freshness(sources, shots.withColumn("ts", F.col("ts").cast("timestamp")), "2024-02-01")
    assert {r.source: (r.state, r.rule_id) for r in got.collect()} == {
        "a": ("fresh", None), "b": ("stale", "DEP-CACHE-STALE"), "c": ("critical", "DEP-CACHE-STALE"), "d": ("cold", "DEP-CACHE-COLD"), "e": ("stale", "DEP-CACHE-STALE"),
    }


def test_freshness_as_of_an_earlier_day(spark):
    """Snapshots taken after the day asked for are not known on it."""
    shots = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-03-01"), ("b", "2024-03-01")], "source string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    sources = spark.createDataFrame([("a",), ("b",)], "source string")
    got = {r.source: (r.age_days, r.state, r.n_snapshots) for r in dependencies.snapshot_freshness(sources, shots, "2024-02-01").collect()}
    assert got == {"a": (31, "critical", 1), "b": (None, "cold", None)}


def test_inventory(spark):
    h1 = "h1:q83vASNFZ4mrze8BI0VniavN7wEjRWeJq83vASNFZ4k="
    entries = spark.createDataFrame([(1, "m", "v1", h1, False), (1, "m", "v1", "h1:AAAA", True), (1, "n", "v1", "h1:bad", True)], "project_id long, module string, version string, hash string, mod_only boolean")
    declared = spark.createDataFrame([(1, "n", "v1", False, 1), (1, "n", "v1", True, 2)], "project_id long, module string, version string, indirect boolean, ord long")
    parts = inventory.sbom_inventory(entries, declared)
    assert {(r.module, r.purl, (r.sha256 or "")[:6], r.indirect) for r in parts.collect()} == {("m", "pkg:golang/m@v1", "abcdef", False), ("n", "pkg:golang/n@v1", "", True)}
    status = inventory.inventory_status(spark.createDataFrame([(1,), (2,)], "project_id long"), parts, spark.createDataFrame([("m", "MIT")], "module string, licence string"))
    assert {(r.project_id, r.status, r.component_count, r.unknown_licences) for r in status.collect()} == {(1, "PASS", 2, 1), (2, "FAIL", 0, 0)}


# ---- graph and context --------------------------------------------------------


def test_reach_within_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(20, 21), (21, 20)], "src long, dst long")
    sinks = spark.createDataFrame([(10,), (99,)], "node long")
    sources = edges.select(F.col("src").alias("node"))
    got = {r.source: (r.reaches, r.hops) for r in graph.flow_reaches(edges, sources, sinks, 5).collect()}
    assert got == {**{i: (i >= 5, 10 - i if i >= 5 else None) for i in range(10)}, 20: (False, None), 21: (False, None)}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    links = [(f"m{rng.randint(0, 120):03d}", f"t{rng.randint(0, 90)}") for _ in range(170)] + [(f"m{i:03d}", f"m{i:03d}") for i in range(121)]
    links += [(f"z{i:03d}", f"c{i}") for i in range(64)] + [(f"z{i:03d}", f"c{i + 1}") for i in range(64)]
    links += [(f"h{i:03d}", "hub") for i in range(100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for m, t in links:
        parent[root("M" + m)] = root("T" + t)
    members = sorted({m for m, _ in links})
    want = {}
    for m in members:
        want[m] = min(o for o in members if root("M" + o) == root("M" + m))
    df = spark.createDataFrame(links, "member string, token string")
    for hot in (groups.HOT_ROWS, 10):
        assert {r.member: r.group_id for r in graph.components(df, hot_rows=hot).collect()} == want


FIELDS = "ord int, rule_id string, severity string, path string, subject string, node long, has_json_tag boolean, has_db_tag boolean"


def test_transit(spark):
    df = spark.createDataFrame(
        [
            (1, "PAN-KEYWORD", "HIGH", "x", "pan", 1, True, False), (2, "PAN-KEYWORD", "HIGH", "x", "pan", 2, True, False), (3, "PAN-TYPE", "MEDIUM", "x", "pan", 2, True, False),
            (4, "PAN-KEYWORD", "HIGH", "x", "pan", 2, True, True), (5, "PAN-KEYWORD", "HIGH", "x", "cvv", 2, False, False), (6, "PAN-KEYWORD", "HIGH", "a/DTO/b", "pan", 2, False, False),
            (7, "PAN-KEYWORD", "HIGH", "x", "pan", 2, False, False), (8, "PAN-LOGGER", "HIGH", "x", "cvv", 2, False, False), (9, "PAN-KEYWORD", "HIGH", "x", "cvv", None, False, False),
        ],
        FIELDS,
    )
    flow = spark.createDataFrame([(1, True), (2, False)], "source long, reaches boolean")
    got = {r.ord: (r.severity, r.confidence, r.flow_note) for r in context.transit_downgrade(df, flow).collect()}
    keep, info = ("HIGH", None, None), ("INFO", "high", "transit only")
    assert got == {1: ("HIGH", "high", "stored"), 2: info, 4: keep, 5: info, 6: info, 7: keep, 8: keep, 9: keep}


def test_snippets(spark):
    lines = spark.createDataFrame([("r", i, f"l{i}") for i in range(1, 6)], "record_id string, line_no int, line string")
    df = spark.createDataFrame([("r", 1), ("r", 3), ("r", 3), ("r", 5), ("r", 6), ("r", 0), ("q", 1)], "record_id string, line_no int")
    got = {r.line_no: tuple(r.code_snippet) for r in context.snippets(df, lines).collect()}
    assert got == {1: ("", "l1", "l2\nl3"), 3: ("l1\nl2", "l3", "l4\nl5"), 5: ("l3\nl4", "l5", "")}


def test_diff(spark):
    cols = "rule_id string, severity string, path string, line_no int"
    expected = spark.createDataFrame([("R", "HIGH", "a", 10), ("R", "HIGH", "a", 13), ("R", "HIGH", "b", 0), ("R", "LOW", "c", 0), ("R", "HIGH", "a", 10)], cols)
    actual = spark.createDataFrame([("R", "HIGH", "a", 8), ("R", "HIGH", "a", 10), ("R", "HIGH", "b", 77), ("R", "HIGH", "z", 1), ("R", "HIGH", "a", 500)], cols)
    got = sorted((r.outcome, r.path, r.line_no) for r in context.diff_findings(expected, actual).collect())
    assert got == [("matched", "a", 10), ("matched", "b", 0), ("missing", "a", 13), ("missing", "c", 0), ("unexpected", "z", 1)]


def test_diff_against_every_pair(spark):
    rng = random.Random(2)
    one = lambda: (rng.choice(["R", "S", None]), rng.choice(["HIGH", "LOW"]), rng.choice(["a", "b", "c", None]), rng.choice([0, 0, *range(1, 40)]))
    expected, actual = [one() for _ in range(150)], [one() for _ in range(60)]
    want = Counter()
    for e in set(expected):
        near = any(e[:3] == a[:3] and (e[3] == 0 or abs(e[3] - a[3]) <= 2) for a in actual)
        want["matched" if near else "missing", *e] += 1
    for a in set(actual):
        want["unexpected", *a] += not any(e[:3] == a[:3] for e in expected)
    cols = "rule_id string, severity string, path string, line_no int"
    got = context.diff_findings(spark.createDataFrame(expected, cols), spark.createDataFrame(actual, cols))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert Counter(map(tuple, got.collect())) == +want


def test_indexed_pages(spark, tmp_path):
    """Pages from written ranges hold the same rows as one sort; equal rows keep their places; a page reads little."""
    rows = [("R", rng_severity, "1", f"p{i % 5}", i % 7, []) for i, rng_severity in enumerate(fv.SEVERITIES * 400)]
    df = findings(spark, *rows).withColumn("ord", F.floor(F.col("ord") / 3).cast("long")).withColumn("tag", F.monotonically_increasing_id()).repartition(6)
    book = paging.write_pages(df, str(tmp_path / "book"), rows_per_part=100)
    count = len(rows)
    whole = [r.ord for r in summary.sort_by_severity(df).collect()]
    seen = []
    for offset in range(0, count, 60):
        page = book.page(offset).orderBy("row_no").collect()
        assert [r.row_no for r in page] == list(range(offset + 1, min(offset + 60, count) + 1))
        assert {r.next_offset for r in page} == {offset + 60 if offset + 60 < count else None}
        seen += page
    assert [r.ord for r in seen] == whole and len({r.tag for r in seen}) == count
    assert [r.tag for r in book.page(60).orderBy("row_no").collect()] == [r.tag for r in seen[60:120]]
    assert book.page(count).count() == 0 and book.page(-5).count() == 60 and book.page(10, limit=3).count() == 3
    empty = paging.write_pages(df.limit(0), str(tmp_path / "none"))
    assert empty.page(0).count() == 0
    with pytest.raises(ValueError):
        book.page(0, 10, 11)


def test_pages_of_many_parts_need_few_ranges(spark, tmp_path):
    """Of 600 parts a shuffle makes at most 200 ranges, for which no task sorts what it sends; pages are as before."""
    df = spark.range(3000).select("id", F.lit("HIGH").alias("severity"), ((F.col("id") * 7919) % 3000).alias("ord"))
    asked = []
    ranges = type(df).repartitionByRange
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "repartitionByRange", lambda self, n, *keys: asked.append(n) or ranges(self, n, *keys))
        book = paging.write_pages(df, str(tmp_path / "book"), rows_per_part=5)
    assert asked == [200]
    sizes = [r.n for r in spark.read.parquet(str(tmp_path / "book" / "index")).collect()]
    assert sum(sizes) == 3000 and max(sizes) == 5
    assert {(r.row_no, r.ord) for r in book.page(1497).collect()} == {(o + 1, o) for o in range(1497, 1497 + fv.PAGE_SIZE)}


def test_a_page_reads_one_range(spark, tmp_path):
    df = spark.range(200_000).select(F.col("id").alias("ord"), F.element_at(F.array(*[F.lit(s) for s in fv.SEVERITIES]), (F.col("id") % 5 + 1).cast("int")).alias("severity"), F.md5(F.col("id").cast("string")).alias("text"))
    book = paging.write_pages(df, str(tmp_path / "book"), rows_per_part=1000)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def read():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).inputRecords() for k in range(stages.size()))

    page = book.page(60)
    before = read()
    assert page.select("row_no", "text").collect()[0].row_no == 61
    assert read() - before < 2_000


def test_triage(spark):
    df = findings(spark, ("CSP-OK", "INFO", "6.4.3", "a.html", 2, []), ("SEC-PREFIX", "HIGH", "8.6.2", "x/test/b.go", 2, []), ("CSP-MISSING", "HIGH", "6.4.3", "c.yaml", 40, []))
    lines = spark.createDataFrame([("x/test/b.go", 2, "key")], "record_id string, line_no int, line string")
    got = {r.rule_id: r for r in triage.triage(df, lines).collect()}
    assert set(got) == {"SEC-PREFIX", "CSP-MISSING"}
    assert (got["SEC-PREFIX"].file_location, got["SEC-PREFIX"].code_snippet.line, got["SEC-PREFIX"].start_line) == ("test directory", "key", 1)
    assert (got["CSP-MISSING"].code_snippet, got["CSP-MISSING"].end_line, got["CSP-MISSING"].mime_type) == (None, 50, "text/yaml")
    hints = dict(fv.HINT_PREFIXES)
    assert (got["SEC-PREFIX"].hint, got["CSP-MISSING"].hint) == (hints["SEC-"], hints["CSP-MISSING"])


def test_report_post_processes(spark):
    """Pairs merge, flows lower, encrypted columns and later drops become INFO, all before the status is derived."""
    rows = [
        (1, "PAN-KEYWORD", "HIGH", "1", "m.go", 5, "cardNumber", "field", 7, False, True, "f", None),
        (2, "PAN-KEYWORD", "CRITICAL", "1", "m.go", 5, "card_number", "tag", 7, False, True, "f", None),
        (3, "PAN-TYPE", "HIGH", "1", "api/x.go", 1, "cvv", "field", 8, True, False, "g", None),
        (4, "PAN-TYPE", "HIGH", "1", "db/y.go", 1, "pan", "field", 9, False, True, "h", None),
        (5, "PAN-TYPE", "CRITICAL", "1", "db/y.go", 2, "pan", "field", 9, False, True, "k", None),
        (6, "SQL-SENSITIVE-COLUMN", "HIGH", "1", "cards", 1, "cards.pan", None, None, None, None, None, 1),
        (7, "SQL-SENSITIVE-COLUMN", "HIGH", "1", "cards", 2, "cards.exp_month", None, None, None, None, None, 2),
        (8, "SQL-TEXT-TYPE", "MEDIUM", "1", "users", 3, "users.pan", None, None, None, None, None, 3),
        (9, "SQL-TEXT-TYPE", "MEDIUM", "1", "users", 4, "users.iban", None, None, None, None, None, 4),
    ]
    cols = "ord long, rule_id string, severity string, requirement_id string, path string, line_no int, subject string, kind string, node long, has_json_tag boolean, has_db_tag boolean, function_name string, event_ord long"
    df = spark.createDataFrame(rows, cols).withColumn("record_id", F.col("path"))
    flow = spark.createDataFrame([(7, True), (8, False), (9, False)], "source long, reaches boolean")
    encrypted = spark.createDataFrame([("CARDS", "pan")], "table_name string, column_name string")
    events = spark.createDataFrame([("users", 3, "ADD", "pan"), ("users", 9, "DROP", "pan"), ("users", 4, "ADD", "iban")], "table_name string, ord long, op string, column_name string")
    report = compliance_report(df, catalogue(spark), flow=flow, encrypted=encrypted, schema_events=events)
    try:
        got = {r.ord: (r.severity, r.confidence, r.triage_hint) for r in report.base.collect()}
        assert got == {
            1: ("CRITICAL", "high", "stored"), 4: ("HIGH", None, None), 5: ("CRITICAL", None, None),
            6: ("INFO", None, "encrypted by the application"), 8: ("INFO", "high", "downgrade:column_dropped_later"), 9: ("MEDIUM", None, None),
        }
        assert [(r.path, r.subject, r.severity, r.n) for r in report.repeated.collect()] == [("db/y.go", "pan", "CRITICAL", 2)]
        assert sorted(r.function_name for r in report.repeated_members.collect()) == ["h", "k"]
        assert report.gate.collect()[0].overall == "FAIL"
    finally:
        report.close()
    plain = compliance_report(df.select(*[c for c in df.columns if c not in ("kind", "node", "event_ord")]), catalogue(spark))
    assert plain.base.count() == 9 and not plain.held
    plain.close()


def test_report(spark):
    df = findings(
        spark, ("PAN-LITERAL", "HIGH", "1", "src/a.go", 1, ["5"]), ("PAN-LITERAL", "LOW", "1", "src/a.go", 2, []), ("SEC-PREFIX", "CRITICAL", "3", "x", 4, []),
        ("SEC-PREFIX", "CRITICAL", "2", "gen/y.go", 4, []),
    )
    lines = spark.createDataFrame([("src/a.go", 2, "// pci-ignore: known")], "record_id string, line_no int, line string")
    report = compliance_report(
        df.drop("ord"), catalogue(spark), [suppression.IgnoreRule(1, "x")], [suppression.ExcludeRule(2, "gen/**")], lines,
        spark.createDataFrame([("t",)], "text string"),
    )
    try:
        assert [(r.rule_id, r.severity, r.requirement_title) for r in report.findings.collect()] == [("PAN-LITERAL", "HIGH", "One"), ("SUPPRESSED-PACKAGE", "INFO", "")]
        assert sorted(r.suppression_source for r in report.suppressions.collect()) == ["ignore-file:1", "inline comment"]
        status = {r.requirement_id: r.status for r in report.status.collect()}
        assert status == {"1": "FAIL", "2": "PASS", "3": "SUPPRESSED", "4": "PASS", "5": "FAIL", "6": "NOT_CHECKED", "7": "NOT_CHECKED", "8": "NOT_CHECKED"}
        assert report.gate.collect()[0].overall == "FAIL"
        page = summary.paginate(report.findings, 1).collect()
        assert [(r.row_no, r.rule_id, r.next_offset) for r in page] == [(2, "SUPPRESSED-PACKAGE", None)]
        assert dict(report.findings.dtypes)["ord"] == "bigint"
        assert {r.requirement_id for r in report.not_checked.collect()} == {"6", "7", "8"}
        assert [r.rule_id for r in report.by_rule.collect()] == ["PAN-LITERAL", "SUPPRESSED-PACKAGE"]
        assert {r.severity: r.n for r in report.severity.collect()}["HIGH"] == 1
        assert report.summary.count() == 12 and report.scan.count() > 0
    finally:
        report.close()
