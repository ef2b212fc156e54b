import random
import re

import pytest
from pyspark.sql import functions as F

from sievelake.operators import audit, cards, crypto, licences, pages, payment, requirements, retention, schema, secrets, transport
from sievelake.plans.registry import DEFAULT_RULES, RuleSpec, covered_requirements, run_scans, scan
from sievelake.schemas import FINDING, as_findings

KV = "record_id string, path string, line_no int, key string, value string"


def rules(df):
    return sorted((r.rule_id, r.severity) for r in df.collect())


def kv(spark, *rows):
    return spark.createDataFrame([("r", p, i, k, v) for i, (p, k, v) in enumerate(rows)], KV)


def units(spark, *texts):
    return spark.createDataFrame([(f"d{i}", f"d{i}", t) for i, t in enumerate(texts)], "record_id string, path string, text string")


def test_pan_literals(spark):
    df = units(
        spark,
        "id 4111111111111111 and 4111111111111112",
        'first\ncardNumber := "5555555555554444", other 378282246310005',
        "x4111111111111111 41111111111111111111",
        "nothing",
    )
    got = cards.scan_pan_literals(df).orderBy("record_id", "col_no").collect()
    assert [(r.record_id, r.line_no, r.severity, r.subject) for r in got] == [
        ("d0", 1, "MEDIUM", "visa *1111"), ("d1", 2, "CRITICAL", "mastercard *4444"), ("d1", 2, "CRITICAL", "amex *0005"),
    ]
    assert not any("4111111111111111" in str(r) for r in got)


def test_kv_pan(spark):
    df = kv(spark, ("a", "card_number", "4111-1111-1111-1111"), ("a", "other", "4111 1111 1111 1111"), ("a", "cvv", "x"), ("a", "cvv", ""))
    assert rules(cards.scan_kv_pan(df)) == [
        ("PAN-KEYWORD", "HIGH"), ("PAN-KEYWORD", "HIGH"), ("PAN-LITERAL", "CRITICAL"), ("PAN-LITERAL", "CRITICAL"),
    ]


def columns(spark, tables):
    rows = [(t, c, ty, i) for t, cols in tables.items() for i, (c, ty) in enumerate(cols)]
    return spark.createDataFrame(rows, "table_name string, column_name string, sql_type string, ordinal int")


def test_pan_columns(spark):
    df = columns(
        spark,
        {
            "pay": [("pan", "text"), ("amount", "int"), ("currency", "text")],
            "users": [("cvv", "text"), ("amount", "int")],
            "bank": [("account_number", "text"), ("iban", "text"), ("bic", "text")],
            "bank_token": [("account_number", "text"), ("iban", "text"), ("bic", "text")],
            "bank_card": [("account_number", "text"), ("iban", "text"), ("bic", "text"), ("cvv", "text")],
        },
    )
    got = {(r.subject, r.severity, r.requirement_id, r.triage_hint) for r in cards.scan_pan_columns(df).collect()}
    assert got == {
        ("pay.pan", "CRITICAL", "3.5.1", None),
        ("users.cvv", "HIGH", "3.3.1", None),
        ("bank.account_number", "INFO", "3.5.1", "banking_domain"),
        ("bank_token.account_number", "HIGH", "3.5.1", None),
        ("bank_card.account_number", "HIGH", "3.5.1", None),
        ("bank_card.cvv", "HIGH", "3.3.1", None),
    }


def test_log_pan_names_and_values(spark):
    df = spark.createDataFrame(
        [("1", ["pan", "note"], ["x", "4111111111111111"]), ("2", ["user"], ["7"])],
        "record_id string, fields array<string>, texts array<string>",
    )
    got = cards.scan_log_pan(df, values="texts").collect()
    assert sorted((r.subject, r.requirement_id, tuple(r.related_requirements)) for r in got) == [
        ("note", "3.5.1", ("3.4.1", "10.2.1")), ("pan", "3.5.1", ("3.4.1", "10.2.1")),
    ]
    assert cards.scan_log_pan(df).count() == 1


LIVE = "sk_live_" + "a1B2c3D4" * 3


@pytest.mark.parametrize(
    "path,key,value,want",
    [
        ("svc/a", "stripe", LIVE, [("SEC-PREFIX", "CRITICAL")]),
        ("svc/a", "x.dsn", "postgres://u:p@h/db", [("SEC-CONNSTR", "CRITICAL")]),
        ("svc/a", "db.password", "hunter22", [("SEC-CREDENTIAL-KEY", "CRITICAL")]),
        ("svc/a", "db.password", "changeme", []),
        ("svc/a", "db.password", "<secret>", []),
        ("svc/a", "db.password", "SELECT 1 FROM t", []),
        ("svc/a", "db.password", "my_your_value", []),
        ("svc/a", "auth_url", "https://idp.example.org/x", []),
        ("svc/a", "auth_url", "postgres://u:p@h/db", [("SEC-CONNSTR", "CRITICAL"), ("SEC-CREDENTIAL-KEY", "CRITICAL")]),
        ("svc/a", "api_key", "aZ3$kQ9!vT5#mW7&xB1*pLr8GhN2cYdU", [("SEC-CREDENTIAL-KEY", "CRITICAL"), ("SEC-HIGH-ENTROPY", "HIGH")]),
        ("dev/a", "api_key", "hunter22", [("SEC-CREDENTIAL-KEY", "INFO")]),
        ("docker/a", "api_key", "hunter22", [("SEC-CREDENTIAL-KEY", "MEDIUM")]),
        ("config/prod/a", "api_key", "aZ3$kQ9!vT5#mW7&xB1*pLr8GhN2cYdU", [("SEC-CREDENTIAL-KEY", "CRITICAL"), ("SEC-HIGH-ENTROPY", "CRITICAL")]),
        ("dev/a", "x", "postgres://u:your_pw@h/db", [("SEC-CONNSTR", "CRITICAL")]),
    ],
)
def test_secret_cascade(spark, path, key, value, want):
    assert rules(secrets.scan_secrets(kv(spark, (path, key, value)))) == want


def test_secret_values_never_leave(spark):
    rows = secrets.scan_secrets(kv(spark, ("a", "db.password", "hunter22"), ("a", "k", LIVE))).collect()
    assert not any("hunter22" in str(r) or LIVE in str(r) for r in rows)


@pytest.mark.parametrize(
    "path,key,value,want",
    [
        ("svc/a", "consumerKey", "q7Z!k2pXw", ("CRITICAL", None)),
        ("svc/a", "consumerKey", "q7Zk2pXw", None),
        ("svc/a", "consumerKey", "aaaaaaaaaa", None),
        ("svc/a", "note", "q7Zk2pXw", None),
        ("svc/a", "note", "aZ3$kQ9!vT5#mW7&xB1*pLr8GhN2cYdU", ("HIGH", None)),
        ("svc/a", "note", "d41d8cd98f00b204e9800998ecf8427e", ("CRITICAL", None)),
        ("svc/a", "note", "0123456789abcdef0123", None),
        ("svc/a", "note", "deadbeef00deadbeef", ("HIGH", None)),
        ("svc/a", "note", "deadbeefdeadbeefde", ("INFO", "hardcoded_json_key")),
        ("dev/a", "consumerKey", "q7Z!k2pXw", ("INFO", None)),
        ("svc/a", "ErrToken", "token was denied", ("INFO", "hardcoded_sentinel_error")),
        ("svc/a", "headerKey", "X-Api-Token", ("INFO", "hardcoded_header_name")),
        ("svc/a", "logKey", "request_key_id", ("INFO", "hardcoded_log_field")),
        ("svc/headers.go", "consumerKey", "q7Z!k2pXw", ("HIGH", "crypto_key_constants_file")),
        ("svc/a", "apiKey", "https://x.y/z-1", None),
    ],
)
def test_hardcoded_keys(spark, path, key, value, want):
    rows = secrets.scan_hardcoded_keys(kv(spark, (path, key, value))).collect()
    assert [(r.severity, r.triage_hint) for r in rows] == ([want] if want else [])


@pytest.mark.parametrize(
    "path,key,value,want",
    [
        ("svc/a", "dbPassword", "x1", "CRITICAL"),
        ("svc/a", "db_passwd", "changeme", "INFO"),
        ("svc/a", "password", "${PW}", "INFO"),
        ("config/prod/a", "password", "todo", "CRITICAL"),
        ("svc/testutil/a", "password", "x1", "INFO"),
        ("svc/a", "passkeyGroup", "x1", None),
        ("svc/a", "bypassAuth", "x1", None),
    ],
)
def test_hardcoded_passwords(spark, path, key, value, want):
    assert [r.severity for r in secrets.scan_hardcoded_passwords(kv(spark, (path, key, value))).collect()] == ([want] if want else [])


def test_plain_http(spark):
    values = ["http://a.b/c", "https://a", "see http://x", "http://localhost:80/", "http://127.0.0.1", "http://[::1]/x", "http://example.com/", "http://example.com.evil/"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert {r.subject for r in crypto.scan_plain_http(df).collect()} == {"http://a.b", "http://x", "http://example.com.evil"}


def weak_hash_by_hand(lines):
    words = ["password", "secret", "key", "token", "pan", "cvv", "card", "pin", "auth"]
    out = []
    for no, line in lines:
        near = [t.lower() for n, t in lines if abs(n - no) <= 5]
        if "md5(" in line:
            out.append((no, "CRITICAL" if any(w in t for t in near for w in words) else "INFO"))
        elif "sha256(" in line and any("password" in t for t in near):
            out.append((no, "CRITICAL"))
    return sorted(out)


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_weak_hash_across_block_edges(spark, block):
    lines = [(n, "x = md5(a)" if n % 7 == 0 else "sha256(b)" if n % 11 == 0 else "password = p" if n % 23 == 0 else "noop") for n in range(1, 120)]
    df = spark.createDataFrame([("r", n, t) for n, t in lines], "record_id string, line_no int, line string")
    got = sorted((r.line_no, r.severity) for r in crypto.scan_weak_hash(df, block).collect())
    assert got == weak_hash_by_hand(lines)


def test_weak_hash_sees_calls_and_names_only(spark):
    lines = ["a = sha256(x); b = md5(y)", "md5(sha1(z))", "h = md5(x) // shopping list", 'log("md5(pin)")', "'it\\'s' + des (x) /* pin */ + MD5.new(`key`)", "mymd5(x)"]
    got = []
    for n, line in enumerate(lines):
        df = spark.createDataFrame([("r", 1, line)], "record_id string, line_no int, line string")
        got.append(sorted((r.subject, r.severity) for r in crypto.scan_weak_hash(df).collect()))
    assert got == [[("md5", "INFO")], [("md5", "INFO"), ("sha1", "INFO")], [("md5", "INFO")], [], [("des", "INFO"), ("md5", "INFO")], []]


PAY = '<form><input name="card-number"></form>'


def test_scripts_and_meta(spark):
    df = spark.createDataFrame(
        [
            (1, "u1", PAY + '<script src="a.js"></script><script>x</script><script nonce=n>y</script>'),
            (2, "u2", '<script src="a.js" integrity="x"></script><script src="b.js"></script><meta http-equiv="Content-Security-Policy" content="script-src \'unsafe-eval\'">'),
            (3, "u3", '<meta http-equiv="Content-Security-Policy" content="script-src \'unsafe-inline\' \'nonce-1\'">'),
            (4, "u4", "<p>none</p>"),
        ],
        "page_id long, url string, html string",
    )
    scripts = {(r.record_id, r.rule_id, r.severity) for r in pages.scan_scripts(df).collect()}
    assert scripts == {
        ("1", "SRI-MISSING-PAYMENT", "CRITICAL"), ("1", "NONCE-MISSING-PAYMENT", "CRITICAL"), ("1", "FIM-REQUIRED", "MEDIUM"),
        ("2", "SRI-MISSING", "HIGH"),
    }
    metas = {(r.record_id, r.rule_id, r.severity) for r in pages.scan_meta_csp(df).collect()}
    assert metas == {("2", "META-CSP-UNSAFE", "HIGH"), ("3", "META-CSP-ONLY", "MEDIUM")}
    both = {(r.record_id, r.rule_id, r.severity) for r in pages.scan_pages(df).collect()}
    assert both == scripts | metas


def test_csp_headers(spark):
    df = spark.createDataFrame(
        [
            ("1", "/a", "json", None), ("2", "/a", "html", None), ("3", "/a", "unknown", None), ("4", "/callback/x", "unknown", None),
            ("5", "/callback/x", "html", None), ("6", "/a", "html", "{{P}}"), ("7", "/a", "html", "script-src 'unsafe-inline' 'unsafe-eval'"),
            ("8", "/a", "html", "img-src *"), ("9", "/a", "html", "default-src 'self'"), ("10", None, "unknown", None),
        ],
        "record_id string, path string, response_type string, csp string",
    )
    got = sorted((int(r.record_id), r.rule_id, r.severity) for r in pages.scan_csp_headers(df).collect())
    assert got == [
        (2, "CSP-MISSING", "HIGH"), (3, "CSP-MISSING", "INFO"), (5, "CSP-MISSING", "HIGH"), (6, "CSP-VALUE-UNANALYZABLE", "INFO"),
        (7, "CSP-UNSAFE-EVAL", "HIGH"), (7, "CSP-UNSAFE-INLINE", "HIGH"), (8, "CSP-NO-SCRIPT-SRC", "HIGH"), (9, "CSP-OK", "INFO"),
        (10, "CSP-MISSING", "INFO"),
    ]


def test_transport(spark):
    df = spark.createDataFrame(
        [("1", True, "VersionTLS10", ["A_RC4", "GOOD", "b_3des"], 8, "bytes"), ("2", False, None, [], 12, "bytes"), ("3", False, "VersionTLS13", None, 11, "chars")],
        "record_id string, skip_verify boolean, min_version string, ciphers array<string>, min_password_len int, len_unit string",
    )
    assert rules(transport.scan_tls_settings(df)) == [
        ("TLS-INSECURE-SKIP-VERIFY", "CRITICAL"), ("TLS-MISSING-MIN-VERSION", "HIGH"), ("TLS-WEAK-CIPHER", "CRITICAL"),
        ("TLS-WEAK-CIPHER", "CRITICAL"), ("TLS-WEAK-VERSION", "CRITICAL"),
    ]
    assert rules(transport.scan_password_policy(df)) == [("AUTH-BYTE-COUNT", "MEDIUM"), ("AUTH-WEAK-POLICY", "CRITICAL"), ("AUTH-WEAK-POLICY", "CRITICAL")]


def test_schema_columns(spark):
    df = columns(
        spark,
        {
            "cards": [("id", "int"), ("number", "bytea"), ("exp_month", "int"), ("cvv", "text")],
            "wallets": [("number", "text"), ("exp_month", "int"), ("code", "varchar(4)")],
            "users": [("number", "text"), ("exp_month", "int"), ("card_number", "TEXT")],
        },
    )
    got = {(r.subject, r.rule_id, r.requirement_id) for r in schema.scan_schema_columns(df).collect()}
    assert got == {
        ("cards.number", "SQL-SENSITIVE-COLUMN", "3.3.1"), ("cards.cvv", "SQL-SENSITIVE-COLUMN", "3.3.1"), ("cards.cvv", "SQL-TEXT-TYPE", "3.5.1"),
        ("wallets.number", "SQL-SENSITIVE-COLUMN", "3.3.1"), ("wallets.number", "SQL-TEXT-TYPE", "3.5.1"),
        ("wallets.exp_month", "SQL-SENSITIVE-COLUMN", "3.3.1"), ("wallets.code", "SQL-SENSITIVE-COLUMN", "3.3.1"), ("wallets.code", "SQL-TEXT-TYPE", "3.5.1"),
        ("users.card_number", "SQL-SENSITIVE-COLUMN", "3.5.1"), ("users.card_number", "SQL-TEXT-TYPE", "3.5.1"),
    }


def test_encryption_crossref(spark):
    found = schema.scan_schema_columns(columns(spark, {"Cards": [("number", "text"), ("exp_month", "text"), ("cvv", "text")]}))
    enc = spark.createDataFrame([("cards", "NUMBER")], "table_name string, column_name string")
    got = sorted((r.column_name, r.rule_id, r.severity) for r in schema.encryption_crossref(found, enc).collect())
    assert got == [
        ("cvv", "SQL-SENSITIVE-COLUMN", "HIGH"), ("cvv", "SQL-TEXT-TYPE", "MEDIUM"),
        ("exp_month", "SQL-TEXT-TYPE", "MEDIUM"),
        ("number", "SQL-SENSITIVE-COLUMN", "INFO"), ("number", "SQL-TEXT-TYPE", "INFO"),
    ]


def test_retention(spark):
    df = kv(
        spark,
        ("a.yaml", "cache.card_data.host", "h"), ("a.yaml", "cache.session.host", "h"),
        ("b.yaml", "cvv_cache.ttl", "5"), ("b.yaml", "cvv_cache.host", "h"),
        ("dev-env/c.yaml", "payments.host", "h"), ("compose/dev.yaml", "card.host", "h"),
        ("d.json", "swagger", "2"), ("d.json", "definitions.Card.type", "x"),
        ("e.json", "flag.card.variants.on", "x"), ("e.json", "flag.card.rollout", "x"),
        ("f.json", "flag.card.rollout", "x"),
        ("example.yaml", "card.host", "h"), ("x/docs/g.yaml", "card.host", "h"),
        ("g.yaml", "pan", "1"),
    )
    got = {(r.path, r.subject, r.severity) for r in retention.scan_retention_groups(df).collect()}
    assert got == {
        ("a.yaml", "cache.card_data", "HIGH"), ("dev-env/c.yaml", "payments", "INFO"), ("compose/dev.yaml", "card", "INFO"),
        ("f.json", "flag.card", "HIGH"), ("g.yaml", "pan", "HIGH"),
    }


def test_audit_trail(spark):
    ops = spark.createDataFrame(
        [("1", 1, "chargeCard"), ("2", 2, "createOrder"), ("3", 3, "notifyUser"), ("4", 1, "notifyUser"), ("5", 2, "listThings")],
        "record_id string, user_id long, name string",
    )
    logs = spark.createDataFrame([(1, True), (1, False), (2, False)], "user_id long, structured boolean")
    got = sorted((r.record_id, r.rule_id, r.severity, r.tier) for r in audit.audit_trail_coverage(ops, logs, "user_id").collect())
    assert got == [("1", "AUDIT-LOG-OK", "INFO", 1), ("2", "AUDIT-UNSTRUCTURED", "HIGH", 2), ("4", "AUDIT-LOG-OK", "INFO", 3)]
    assert sorted((r.rule_id, r.severity) for r in audit.audit_trail_coverage(ops, logs.limit(0), "user_id").collect()) == [
        ("AUDIT-NO-LOG", "CRITICAL"), ("AUDIT-NO-LOG", "HIGH"), ("AUDIT-NO-LOG", "MEDIUM"),
    ]


def test_field_coverage(spark):
    df = spark.createDataFrame(
        [(1, ["user_id", "created-at", "http.method", "statusCode", "target"]), (2, ["endpoint"]), (3, ["note"]), (4, [])],
        "id int, fields array<string>",
    )
    got = {r.id: r for r in audit.audit_field_coverage(df).collect()}
    assert (got[1].score, got[1].severity, got[1].missing) == (5, "INFO", [])
    assert (got[2].score, got[2].severity, sorted(got[2].matched)) == (2, "MEDIUM", ["affected_resource", "event_type"])
    assert (got[3].score, got[3].severity, len(got[3].missing)) == (0, "HIGH", 5)
    auto = {r.id: r for r in audit.audit_field_coverage(df, timestamp_auto=F.lit(True)).collect()}
    assert (auto[4].score, auto[4].severity, auto[4].matched["timestamp"]) == (1, "MEDIUM", ["auto"])


def test_log_fields(spark):
    df = spark.createDataFrame([("1", ["card_number", "api_key", "span_id", "User-Agent", "note"], False), ("2", ["note", "widget_id"], True)], "record_id string, fields array<string>, body_sourced boolean")
    got = {(r.record_id, r.subject, r.severity, tuple(r.related_requirements)) for r in audit.scan_log_fields(df).collect()}
    assert got == {
        ("1", "card_number", "HIGH", ("3.3.1", "3.5.1")), ("1", "api_key", "HIGH", ("8.6.2",)), ("1", "note", "MEDIUM", ()), ("2", "note", "HIGH", ()),
    }


def test_payment_context(spark):
    df = spark.createDataFrame(
        [(1, "processCharge", "/svc/billing", "github.com/stripe/stripe-go", "CardRequest", "cvv"), (2, "health", "misc", "fmt", "User", "email"), (3, "x", "payment", "a/card", "User", "x")],
        "id int, name string, dir string, import_path string, type_name string, field_name string",
    )
    got = {r.id: (r.score, r.in_scope, r.signals) for r in payment.payment_context_score(df).collect()}
    assert got == {
        1: (11, True, ["name", "path", "sdk", "chd-param", "chd-field"]),
        2: (0, False, []),
        3: (4, True, ["path", "internal-import"]),
    }


def test_payment_tier_needs_first_tier_in_group(spark):
    df = spark.createDataFrame([(1, "g", "chargeCard"), (2, "g", "onWebhook"), (3, "h", "onWebhook"), (4, "h", "listOrders"), (5, None, "notify"), (6, None, "pay")], "id int, grp string, name string")
    for hot in (0, 1_000_000):
        from sievelake.operators import groups

        facts = groups.attach_group_facts(df, ["grp"], hot, _has_first=F.bool_or(payment.is_first_tier(F.col("name"))))
        got = {r.id: r.t for r in facts.select("id", payment.tier_of(F.col("name"), F.col("_has_first")).alias("t")).collect()}
        assert got == {1: 1, 2: 3, 3: 0, 4: 2, 5: 3, 6: 1}
    assert {r.id: r.tier for r in payment.payment_tier(df).collect()} == {1: 1, 2: 3, 3: 0, 4: 2, 5: 3, 6: 1}


def test_licences(spark):
    df = units(spark, "Released under the MIT License.", "MIT License and GNU General Public License, version 3", "Licensed under CC BY-NC 4.0.", "license unclear", "none")
    assert [r.licence for r in licences.license_inventory(df).orderBy("record_id").collect()] == ["MIT", "GPL-3.0", "CC-BY-NC-4.0"]
    assert {r.licence: r.n_units for r in licences.license_counts(df).collect()} == {"MIT": 1, "GPL-3.0": 1, "CC-BY-NC-4.0": 1, "unknown": 2}


def words_of(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute_coverage(text, known, n=5, percent=75):
    """(licence, covered words, longest run) of one text by comparing every pair of places."""
    own = words_of(text)
    covered, runs = set(), []
    for name, other in known:
        theirs = words_of(other)
        hits = {(i, j) for i in range(len(own) - n + 1) for j in range(len(theirs) - n + 1) if own[i : i + n] == theirs[j : j + n]}
        for i, j in hits:
            covered.update(range(i, i + n))
            if (i - 1, j - 1) not in hits:
                k = 0
                while (i + k, j + k) in hits:
                    k += 1
                runs.append((-(k + n - 1), name))
    if not runs or 100 * len(covered) < percent * len(own):
        return None
    span, name = min(runs)
    return name, len(covered), -span


def test_license_coverage(spark):
    """Licence texts with changed, moved, repeated and missing parts; mentions, mixtures, ties, nulls and repeated units."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {name: " ".join(rng.choice(vocabulary) for _ in range(size)) for name, size in (("A", 120), ("B", 80), ("C", 40), ("D", 4))}
    texts["E"] = texts["C"]  # two licences of one text: the first by name
    known = [*texts.items(), ("A", "a second text of licence A with words of its own")]
    rows = [None, "", "MIT License", texts["D"], texts["C"].upper().replace(" ", ", "), "a second text of licence A with words of its own!"]
    for _ in range(40):
        parts = []
        for name in rng.sample(sorted(texts), 2):
            own = texts[name].split()
            at = rng.randint(0, len(own) // 2)
            parts += own[at : at + rng.randint(3, len(own))] + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 25))]
        rows.append(" ".join(parts))
    df = units(spark, *rows)
    twice = df.unionByName(df.limit(10))
    library = spark.createDataFrame([*known, ("N", None)], "licence string, text string")
    want = {(str(i), *found) for i, text in enumerate(rows) if (found := brute_coverage(text, known))}
    ids = {r.record_id: i for i, r in enumerate(df.collect())}
    got = licences.license_coverage(twice, library).collect()
    assert {(str(ids[r.record_id]), r.licence, r.n_covered, r.span) for r in got} == want and len(got) == len(want) > 8
    assert {r.licence for r in licences.license_inventory(df, library).collect()} == {w[1] for w in want}
    assert licences.license_coverage(df.limit(0), library).count() == licences.license_coverage(df, library.limit(0)).count() == 0


def test_registry(spark):
    inputs = {"kv": kv(spark, ("a", "db.password", "hunter22")), "units": units(spark, "4111111111111111")}

    def broken(given):
        return given["kv"].select("no_such_column")

    extra = (RuleSpec("broken", ("kv",), ("1.1",), broken), *DEFAULT_RULES)
    found = run_scans(inputs, extra)
    assert found.schema.simpleString() == as_findings(found).schema.simpleString()
    assert [f.name for f in found.schema] == [f.name for f in FINDING]
    assert {r.rule_id for r in found.collect()} == {"PAN-LITERAL", "SEC-CREDENTIAL-KEY", "AUTH-HARDCODED-PWD"}
    assert {"8.6.2", "11.6.1", "1.1"} <= covered_requirements(extra)
    with pytest.raises(ValueError):
        run_scans({}, DEFAULT_RULES)


def test_only_unfit_rules_are_left_out(spark):
    """A rule that doesn't fit its inputs is named; any other error ends the scan instead of making the rule vanish."""

    def lost(_):
        raise OSError("executor lost")

    data = {"kv": kv(spark, ("a", "db.password", "hunter22"))}
    with pytest.raises(OSError):
        scan(data, (RuleSpec("lost", ("kv",), ("1.1",), lost),))
    run = scan(data | {"deps": data["kv"], "advisories": data["kv"]})
    assert run.failed == ("dependencies",) and "retention" in run.ran and "6.3.3" not in run.covered


def test_a_scan_starts_no_job(spark):
    """Building a scan of every rule runs nothing, whatever the rules need; asking for the findings does."""
    advisory = "adv_id string, package string, aliases array<string>, db_severity string, cvss string, ranges array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>"
    given = {
        "kv": kv(spark, ("a", "db.password", "hunter22")),
        "units": units(spark, "4111111111111111"),
        "columns": spark.createDataFrame([("t", "pan", "text", 1)], "table_name string, column_name string, sql_type string, ordinal int"),
        "lines": spark.createDataFrame([("r", 1, "h = md5(x)"), ("r", 2, "password = 1")], "record_id string, line_no int, line string"),
        "deps": spark.createDataFrame([("m", "v1.0.0", 1, False)], "module string, version string, ord int, indirect boolean"),
        "advisories": spark.createDataFrame([("GO-1", "m", ["CVE-1"], "HIGH", None, [("SEMVER", [("0", None)])]), ("GO-2", "m", ["CVE-1"], None, None, [("SEMVER", [("0", None)])])], advisory),
        "operations": spark.createDataFrame([("o", "k", "chargeCard")], "record_id string, key string, name string"),
        "operation_logs": spark.createDataFrame([("k", True)], "key string, structured boolean"),
    }
    jobs = lambda: spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = jobs()
    run = scan(given)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert jobs() == before and not run.failed
    assert {"DEP-VULN", "PAN-KEYWORD", "CRYPTO-WEAK-HASH", "AUDIT-LOG-OK"} <= {r.rule_id for r in run.findings.collect()}
    assert run.findings is run.findings and run.findings.filter("rule_id = 'DEP-VULN'").count() == 1


def test_findings_of_a_scan_are_mapped(spark):
    """No rule uses a requirement that the rule map lacks."""
    fields = [(str(i), [f], i % 2 == 0) for i, f in enumerate(["card_number", "cvv", "password", "note", "user_id"])]
    given = {
        "kv": kv(spark, ("a", "db.password", "hunter22"), ("a", "card.cvv", "123"), ("a", "card.number", "4111111111111111"), ("a", "k", "sk_" + "live_" + "a1b2c3d4e5f6g7h8i9j0k1l2")),
        "columns": spark.createDataFrame([("cards", c, "text", i) for i, c in enumerate(["pan", "cvv", "exp_month", "track_data"])], "table_name string, column_name string, sql_type string, ordinal int"),
        "logs": spark.createDataFrame(fields, "record_id string, fields array<string>, body_sourced boolean"),
        "audit_records": spark.createDataFrame(fields, "record_id string, fields array<string>, timestamp_auto boolean"),
        "settings": spark.createDataFrame([("s", True, "VersionTLS10", ["TLS_RSA_WITH_RC4_128_SHA"], 6, "bytes")], "record_id string, skip_verify boolean, min_version string, ciphers array<string>, min_password_len int, len_unit string"),
    }
    found = run_scans(given)
    assert found.select("rule_id").distinct().count() > 10
    assert requirements.mapping_drift(found, requirements.rule_map(spark)).collect() == []


def test_clean_inputs_give_nothing(spark):
    clean = kv(spark, ("svc/app.yaml", "server.port", "8080"), ("svc/app.yaml", "log.level", "info"), ("svc/app.yaml", "feature.path", "/etc/app/x.conf"))
    text = units(spark, "order 1234567890123 shipped", "call 555-0100")
    assert run_scans({"kv": clean, "units": text}).count() == 0
