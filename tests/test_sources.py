import json


from sievelake.sources import columns, keyvalues, packages, pages, sinks, units


def lines_of(spark, *rows):
    return spark.createDataFrame([("r", "p", i + 1, line) for i, line in enumerate(rows)], "record_id string, path string, line_no int, line string")


def test_read_units(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.env").write_text("K=v\nL=w")
    (tmp_path / "y.yaml").write_text("k: ü")
    (tmp_path / "z.bin").write_text("no")
    (tmp_path / "big.env").write_text("x" * 500)
    got = units.read_units(spark, str(tmp_path), [".env", ".yaml"], max_bytes=100)
    assert {(r.path, r.text, r.n_bytes) for r in got.collect()} == {("a/x.env", "K=v\nL=w", 7), ("y.yaml", "k: ü", 5)}
    assert [(r.line_no, r.line) for r in units.to_lines(got.filter("path = 'a/x.env'")).collect()] == [(1, "K=v"), (2, "L=w")]


def test_filter_scope(spark):
    cases = {
        "src/a.go": True,
        "src/a_test.go": False,
        "src/test/a.go": False,
        "Vendor/a.go": False,
        "vendor": False,
        "src/vendor.go": True,
        "src/a.pb.go": False,
        "gen/a.go": False,
        "src/a.txt": False,
        "src/big.go": False,
        "src/.git/a.go": False,
    }
    df = spark.createDataFrame([(p, 11 if "big" in p else 5) for p in cases], "path string, n_bytes long")
    kept = units.filter_scope(df, [".go"], exclude_dirs=["Gen"], exclude_globs=["*.pb.go"], max_bytes=10)
    assert {r.path for r in kept.collect()} == {p for p, keep in cases.items() if keep}
    with_tests = units.filter_scope(df, [".go"], include_tests=True)
    assert {"src/a_test.go", "src/test/a.go"} <= {r.path for r in with_tests.collect()}


def test_tracked_only(spark):
    df = spark.createDataFrame([("a",), ("b",)], "path string")
    manifest = spark.createDataFrame([("a",), ("a",)], "path string")
    assert units.tracked_only(df, manifest).count() == 1
    assert units.tracked_only(df, manifest, include_untracked=True).count() == 2
    assert units.tracked_only(df, None).count() == 2
    assert units.tracked_only(df, manifest.limit(0)).count() == 2


def test_extract_kv(spark):
    df = lines_of(
        spark, "# A=b", "export KEY = 'v w' ", "NOEQ", "EMPTY=", 'Q=""', "A=b=c", "  X=\t'", "", 'D="x\'', "export Y=1"
    )
    got = keyvalues.extract_kv(df).orderBy("line_no").collect()
    assert [(r.line_no, r.key, r.value) for r in got] == [
        (2, "KEY", "v w"), (6, "A", "b=c"), (7, "X", "'"), (9, "D", '"x\''), (10, "Y", "1"),
    ]


def test_extract_inline_kv(spark):
    df = lines_of(spark, 'say token = "abc" and api.key="d e" or x = ""', "none")
    assert [(r.key, r.value) for r in keyvalues.extract_inline_kv(df).collect()] == [("token", "abc"), ("api.key", "d e")]


def brute(node, key="", depth=0):
    if isinstance(node, dict):
        if depth < 40:
            for name, value in node.items():
                yield from brute(value, f"{key}.{name}" if key else name, depth + 1)
    elif isinstance(node, list):
        if depth < 40:
            for i, value in enumerate(node):
                yield from brute(value, f"{key}[{i}]", depth + 1)
    elif isinstance(node, bool):
        yield key, str(node).lower()
    elif node not in (None, ""):
        yield key, str(node)


def test_flatten_json_against_recursion(spark):
    deep, capped = "x", "y"
    for i in range(30):
        deep = {f"k{i}": deep}
    for _ in range(21):
        capped = [capped]
    capped += ['{[ \\" } not a bracket']
    docs = [
        {"a": 1, "b": {"c": "x", "d": [True, None, {"e": "f"}, "", 2.5]}, "z": {}},
        {"deep": deep},
        {"capped": capped, "kept": "1"},
        [1, 2],
        "text",
        {},
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "{broken")]
    got = keyvalues.flatten_json(spark.createDataFrame(rows, "i int, j string"), "j", keep=("i",)).collect()
    want = {(i, k, v) for i, d in enumerate(docs) if isinstance(d, dict) for k, v in brute(d)}
    assert {(r.i, r.key, r.value) for r in got} == want
    assert len(got) == len(want)


def test_column_inventories(spark):
    tables = {"t": spark.createDataFrame([], "id int, card_number string, primary string")}
    got = columns.inventory_of_tables(spark, tables).collect()
    assert [(r.table_name, r.column_name, r.sql_type, r.ordinal) for r in got] == [
        ("t", "id", "int", 0), ("t", "card_number", "string", 1),
    ]
    events = spark.createDataFrame(
        [("t", 1, "ADD", "a"), ("t", 2, "DROP", "a"), ("t", 3, "ADD", "b"), ("t", 4, "DROP", "b"), ("t", 5, "ADD", "b"), ("t", 6, "ADD", "check")],
        "table_name string, ord long, op string, column_name string",
    )
    assert [r.column_name for r in columns.inventory_of_events(events).collect()] == ["b"]


PAGE = """<html>
<!-- <script src="commented.js"></script> -->
<meta http-equiv="content-security-policy" content="img-src *">
<META HTTP-EQUIV='Content-Security-Policy' CONTENT="script-src 'self'">
<meta http-equiv="Content-Security-Policy">
<script src="a.js" integrity=sha></script>
<script src=''>var x = "<script src='inner.js'>";</script>
<script
  nonce="n>1" src="b.js?x=1"></script>
<form data-note="card"><input ID="cvv2"></form>"""


def test_page_tags(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>plain</p>"), (3, "<input class=x><script>")], "page_id long, html string")
    tags = pages.script_tags(df).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.src, r.has_src, r.has_integrity, r.has_nonce) for r in tags] == [
        (1, 1, "a.js", True, True, False),
        (1, 2, "", False, False, False),
        (1, 3, "b.js?x=1", True, False, True),
        (3, 1, "", False, False, False),
    ]
    assert {r.page_id: r.csp for r in pages.meta_csp(df).collect()} == {1: "script-src 'self'"}
    assert {r.page_id: r.is_payment for r in pages.payment_form_flag(df).collect()} == {1: True, 2: False, 3: False}


def test_line_numbers_of_scripts(spark):
    html = "\n\n<script></script>\n<script></script>\n\n<SCRIPT></SCRIPT>"
    tags = pages.script_tags(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos")
    assert [r.line_no for r in tags.collect()] == [3, 4, 0]


def test_lock_entries(spark):
    df = spark.createDataFrame([(1, "m v1 h1:a"), (1, " m  v1/go.mod\th1:b "), (1, "bad line"), (1, "")], "project_id long, line string")
    assert [(r.module, r.version, r.hash, r.mod_only) for r in packages.lock_entries(df).collect()] == [
        ("m", "v1", "h1:a", False), ("m", "v1", "h1:b", True),
    ]


def test_advisory_documents(spark, tmp_path):
    doc = {
        "id": "GO-1",
        "aliases": ["CVE-1"],
        "affected": [
            {"package": {"name": "m", "ecosystem": "Go"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}]},
            {"package": {"name": "m/sub"}, "ranges": [{"type": "GIT", "events": [{"introduced": "abc"}]}]},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = packages.explode_advisories(packages.read_advisories(spark, str(tmp_path))).orderBy("affected_no", "event_no").collect()
    assert [(r.package, r.range_type, r.event_no, r.introduced, r.fixed) for r in rows] == [
        ("m", "SEMVER", 0, "0", None), ("m", "SEMVER", 1, None, "1.2.0"), ("m/sub", "GIT", 0, "abc", None),
    ]
    flat = packages.flat_advisories(packages.read_advisories(spark, str(tmp_path))).collect()
    assert [(r.adv_id, r.package, r.aliases) for r in flat] == [("GO-1", "m", ["CVE-1"]), ("GO-1", "m/sub", ["CVE-1"])]


def test_write_findings(spark, tmp_path):
    df = spark.createDataFrame([("R1", "HIGH"), ("R2", "LOW")], "rule_id string, severity string")
    for fmt in ("parquet", "json"):
        out = str(tmp_path / fmt)
        sinks.write_findings(df, out, fmt)
        back = spark.read.format(fmt).load(out)
        assert back.filter("severity = 'HIGH'").select("rule_id").collect()[0][0] == "R1"
        assert back.count() == 2
    assert json.loads(sinks.findings_json(df.limit(1)).collect()[0].finding) == {"rule_id": "R1", "severity": "HIGH"}


def test_lines_of_long_files(spark, tmp_path):
    """A file in many byte ranges gives the lines and numbers of the whole file, and so do files that share a task."""
    texts = {
        "long.log": "\n".join(f"line {i} {'é' * (i % 50)}" for i in range(3000)),
        "one/line.log": "x" * 50_000,
        "one/end.log": "a\n\nb\r\n",
        "two/empty.log": "",
        "two/skip.txt": "not this",
        **{f"small/{i}.log": f"first {i}\nsecond {i}" for i in range(30)},
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        lines = units.read_lines(spark, str(tmp_path), [".log"])
        assert spark.read.text(str(tmp_path / "long.log")).rdd.getNumPartitions() > 10
        got = {(r.path, r.line_no): r.line for r in lines.collect()}
        small = units.read_lines(spark, str(tmp_path), [".log"], max_bytes=1000)
        assert {r.path for r in small.collect()} == {n for n, t in texts.items() if n.endswith(".log") and 0 < len(t.encode()) <= 1000}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {}
    for name, text in texts.items():
        rows = text.removesuffix("\n").split("\n") if name.endswith(".log") and text else []
        want |= {(name, i): row for i, row in enumerate(rows, 1)}
    assert got == want


def test_json_as_settings(spark):
    docs = ['{"a":{"b":[1,{"c":true}]},"d":"x","e":null,"f":""}', "[1]", "not json", None, '{"k":2.50}']
    df = spark.createDataFrame([(str(i), f"p{i}.json", t) for i, t in enumerate(docs)], "record_id string, path string, text string")
    got = sorted(tuple(r) for r in keyvalues.json_kv(df).collect())
    assert got == [("0", "p0.json", 0, "a.b[0]", "1"), ("0", "p0.json", 0, "a.b[1].c", "true"), ("0", "p0.json", 0, "d", "x"), ("4", "p4.json", 0, "k", "2.5")]


def test_lines_of_a_file_in_parts(spark, tmp_path):
    """Lines are numbered through the parts of a folder, in the order of the parts' numbers; parts may be ranges, too."""
    texts = {"part-00000-x": ["a", "b"], "part-00002-x": [], "part-00009-x": ["c"] * 500, "part-99999-x": ["d"], "part-100000-x": ["e", "f"]}
    for file in ("one", "two"):
        (tmp_path / file).mkdir()
        for name, lines in texts.items():
            (tmp_path / file / f"{name}.txt").write_text("".join(f"{line}\n" for line in lines))
    whole = [line for lines in texts.values() for line in lines]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = units.read_lines(spark, str(tmp_path), [".txt"], parts=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.path, r.line_no, r.line) for r in found) == [(f, i + 1, line) for f in ("one", "two") for i, line in enumerate(whole)]
