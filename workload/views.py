"""Views that bind the operators to the supplied tables.

One SQL text per view, valid in Spark and in the checking engine. Views are
expanded as common table expressions, so nothing is registered in a session
and every query reads its tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "v_paths": """
SELECT p_partkey AS record_id,
       CASE p_partkey % 8 WHEN 0 THEN 'services/billing/' WHEN 1 THEN 'config/prod/' WHEN 2 THEN 'deploy/dev/'
            WHEN 3 THEN 'internal/card/' WHEN 4 THEN 'vendor/lib/' WHEN 5 THEN 'internal/test/'
            WHEN 6 THEN 'examples/api/' ELSE 'internal/dto/' END
       || 'f' || CAST(p_partkey AS STRING)
       || CASE p_size % 5 WHEN 0 THEN '.env' WHEN 1 THEN '.json' WHEN 2 THEN '_test.go' WHEN 3 THEN '.pb.go'
               ELSE '.yaml' END AS path,
       (p_partkey * 7919) % 12000000 AS n_bytes
FROM part""",
    "v_manifest": "SELECT path FROM v_paths WHERE n_bytes < 9600000",
    "v_kv": """
SELECT p.p_partkey AS record_id, v.path AS path, p.p_size AS line_no,
       'svc' || CAST(p.p_partkey % 40 AS STRING) || '.'
       || CASE p.p_size % 6 WHEN 0 THEN 'card_data' WHEN 1 THEN 'session' WHEN 2 THEN 'payment_token'
               WHEN 3 THEN 'cache' WHEN 4 THEN 'db' ELSE 'auth' END || '.'
       || CASE p.p_partkey % 9 WHEN 0 THEN 'password' WHEN 1 THEN 'apiKey' WHEN 2 THEN 'ttl' WHEN 3 THEN 'dsn'
               WHEN 4 THEN 'card_number' WHEN 5 THEN 'callback_url' WHEN 6 THEN 'signingKeyBase64'
               WHEN 7 THEN 'LogKeyRequestID' ELSE 'namespace' END AS key,
       CASE p.p_size % 11 WHEN 0 THEN 'changeme'
            WHEN 1 THEN 'sk_' || 'live_' || substr(md5(p.p_name || CAST(p.p_partkey AS STRING)), 1, 30)
            WHEN 2 THEN 'postgres://u' || CAST(p.p_partkey AS STRING) || ':pw@db.local:5432/x'
            WHEN 3 THEN '4111-1111-1111-1111' WHEN 4 THEN md5(CAST(p.p_partkey AS STRING))
            WHEN 5 THEN 'https://api.example.org/v1/' || p.p_brand WHEN 6 THEN 'SELECT 1 FROM t'
            WHEN 7 THEN '<your-key>' WHEN 8 THEN 'aZ3$kQ9!vT5#mW7&xB1*' || p.p_brand
            WHEN 9 THEN 'payments.routing.key' ELSE '3600' END AS value
FROM part p JOIN v_paths v ON v.record_id = p.p_partkey""",
    "v_lines": """
SELECT o_orderkey % 500 AS record_id, CAST(floor(o_orderkey / 500) AS INT) + 1 AS line_no,
       CASE o_custkey % 12 WHEN 0 THEN 'h = md5(x)' WHEN 1 THEN 'password = read()' WHEN 2 THEN 'h = sha256(y)'
            WHEN 3 THEN 'store(card) # pci-ignore: reviewed' WHEN 4 THEN 'h = sha1(z)'
            ELSE 'noop ' || o_orderpriority END AS line
FROM orders""",
    "v_schema_cols": """
SELECT CASE CAST(floor(p_partkey / 12) AS INT) % 4 WHEN 0 THEN 'cards' WHEN 1 THEN 'users'
            WHEN 2 THEN 'bank_accounts' ELSE 'orders' END
       || CAST(CAST(floor(p_partkey / 12) AS INT) AS STRING) AS table_name,
       CASE p_partkey % 12 WHEN 0 THEN 'id' WHEN 1 THEN 'number'
            WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'pan' ELSE 'account_number' END WHEN 3 THEN 'cvv'
            WHEN 4 THEN 'exp_month' WHEN 5 THEN 'amount' WHEN 6 THEN 'currency' WHEN 7 THEN 'iban'
            WHEN 8 THEN 'routing_number' WHEN 9 THEN 'email' WHEN 10 THEN 'track_data' ELSE 'created_at' END
       AS column_name,
       CASE p_size % 5 WHEN 0 THEN 'bytea' WHEN 1 THEN 'varchar(19)' WHEN 2 THEN 'text' WHEN 3 THEN 'bigint'
            ELSE 'character varying(64)' END AS sql_type,
       CAST(p_partkey % 12 AS INT) AS ordinal
FROM part""",
    # Without its card columns a bank table shows the banking exemption; both variants are scanned.
    "v_bank_cols": """
SELECT 'ledger' || CAST(CAST(floor(p_partkey / 5) AS INT) AS STRING) AS table_name,
       CASE p_partkey % 5 WHEN 0 THEN 'iban' WHEN 1 THEN 'routing_number' WHEN 2 THEN 'account_number'
            WHEN 3 THEN CASE WHEN p_size % 3 = 0 THEN 'service_code' ELSE 'owner' END ELSE 'amount' END AS column_name,
       'text' AS sql_type, CAST(p_partkey % 5 AS INT) AS ordinal
FROM part""",
    "v_all_cols": """
SELECT table_name, column_name, sql_type, ordinal FROM v_schema_cols
UNION ALL SELECT table_name, column_name, sql_type, ordinal FROM v_bank_cols""",
    "v_encryption": "SELECT table_name, column_name FROM v_schema_cols WHERE sql_type = 'text'",
    "v_schema_events": """
SELECT 't' || CAST(p_partkey % 100 AS STRING) AS table_name, p_partkey AS ord,
       CASE p_size % 3 WHEN 0 THEN 'DROP' ELSE 'ADD' END AS op,
       CASE p_size % 2 WHEN 0 THEN 'pan' ELSE 'cvv' END AS column_name
FROM part""",
    "v_deps": """
SELECT p_partkey % 50 AS project_id, 'example.org/m' || CAST(p_partkey % 40 AS STRING) AS module,
       'v' || CAST(p_size % 3 AS STRING) || '.' || CAST(p_size % 10 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING)
       AS version, p_partkey AS ord, p_size % 4 = 0 AS indirect
FROM part""",
    "v_advisories": """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'GHSA-' ELSE 'GO-' END || CAST(s_suppkey AS STRING) AS adv_id,
       'CVE-' || CAST(CAST(floor(s_suppkey / 2) AS INT) AS STRING) AS alias,
       'example.org/m' || CAST(s_suppkey % 40 AS STRING) || CASE s_suppkey % 2 WHEN 0 THEN '' ELSE '/sub' END
       AS package,
       CASE s_suppkey % 4 WHEN 0 THEN '0' ELSE '0.' || CAST(s_suppkey % 5 AS STRING) || '.0' END AS introduced,
       CASE s_suppkey % 5 WHEN 0 THEN NULL ELSE '2.' || CAST(s_suppkey % 10 AS STRING) || '.0' END AS fixed,
       CASE s_suppkey % 4 WHEN 0 THEN 'MODERATE' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN NULL ELSE 'LOW' END AS db_severity,
       CASE s_suppkey % 3 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H'
            WHEN 1 THEN 'CVSS:3.1/AV:L/AC:H/PR:L/UI:R/S:C/C:L/I:N/A:N' ELSE NULL END AS cvss
FROM supplier""",
    # Every combination of base metrics turns up as the part table grows.
    "v_cvss": """
SELECT p_partkey AS record_id,
       'CVSS:3.1/AV:' || substr('NALP', CAST(p_partkey % 4 AS INT) + 1, 1)
       || '/AC:' || substr('LH', CAST(floor(p_partkey / 4) AS INT) % 2 + 1, 1)
       || '/PR:' || substr('NLH', CAST(floor(p_partkey / 8) AS INT) % 3 + 1, 1)
       || '/UI:' || substr('NR', p_size % 2 + 1, 1)
       || '/S:' || substr('UC', CAST(floor(p_size / 2) AS INT) % 2 + 1, 1)
       || '/C:' || substr('HLN', CAST(floor(p_partkey / 24) AS INT) % 3 + 1, 1)
       || '/I:' || substr('HLN', CAST(floor(p_partkey / 72) AS INT) % 3 + 1, 1)
       || '/A:' || substr('HLN', CAST(floor(p_partkey / 216) AS INT) % 3 + 1, 1) AS vector,
       'AV:' || substr('LAN', CAST(p_partkey % 3 AS INT) + 1, 1)
       || '/AC:' || substr('HML', CAST(floor(p_partkey / 3) AS INT) % 3 + 1, 1)
       || '/Au:' || substr('MSN', CAST(floor(p_partkey / 9) AS INT) % 3 + 1, 1)
       || '/C:' || substr('NPC', p_size % 3 + 1, 1)
       || '/I:' || substr('NPC', CAST(floor(p_partkey / 27) AS INT) % 3 + 1, 1)
       || '/A:' || substr('NPC', CAST(floor(p_partkey / 81) AS INT) % 3 + 1, 1) AS vector2
FROM part""",
    "v_lock": """
SELECT project_id, module, version || CASE ord % 3 WHEN 0 THEN '/go.mod' ELSE '' END AS version,
       'h1:q83vASNFZ4mrze8BI0VniavN7wEjRWeJq83vASNFZ4k=' AS sum
FROM v_deps""",
    "v_csp": """
SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'html' ELSE 'unknown' END AS response_type,
       CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'script-src ''self'''
            WHEN 2 THEN 'default-src ''unsafe-inline''' WHEN 3 THEN 'script-src ''unsafe-inline'' ''nonce-x'''
            WHEN 4 THEN 'img-src *' WHEN 5 THEN 'Script-Src ''unsafe-eval'' ''strict-dynamic'' ''unsafe-inline'''
            ELSE '{{POLICY}}' END AS csp
FROM pages""",
    "v_pages_aug": """
SELECT page_id, url,
       CASE page_id % 5
            WHEN 0 THEN replace(html, '<nav>', '<form action="/charge"><input name="card_number"/></form><script src="https://cdn.example.com/pay.js"></script><nav>')
            WHEN 1 THEN replace(html, '<nav>', '<script src="/a.js" integrity="sha384-x"></script><nav>')
            WHEN 2 THEN replace(html, '<meta charset="utf-8">', '<meta http-equiv="Content-Security-Policy" content="script-src ''unsafe-inline''">')
            WHEN 3 THEN replace(html, '<meta charset="utf-8">', '<meta http-equiv="content-security-policy" content="default-src ''self''">')
            ELSE html END AS html
FROM pages""",
    "v_tls": """
SELECT s_suppkey AS svc_id, s_suppkey % 4 = 0 AS skip_verify,
       CASE s_suppkey % 5 WHEN 0 THEN 'VersionTLS10' WHEN 1 THEN NULL WHEN 2 THEN 'VersionTLS11'
            ELSE 'VersionTLS12' END AS min_version,
       CASE s_suppkey % 3 WHEN 0 THEN 'TLS_RSA_WITH_RC4_128_SHA,TLS_RSA_WITH_3DES_EDE_CBC_SHA'
            WHEN 1 THEN 'TLS_AES_128_GCM_SHA256' ELSE '' END AS ciphers,
       CAST(6 + s_suppkey % 9 AS INT) AS min_password_len,
       CASE s_suppkey % 2 WHEN 0 THEN 'bytes' ELSE 'chars' END AS len_unit
FROM supplier""",
    "v_log_fields": """
SELECT event_id, ts, user_id, event_type,
       CASE event_id % 8 WHEN 0 THEN 'user_id,ts,action,status,resource' WHEN 1 THEN 'card_number,outcome'
            WHEN 2 THEN 'X-Request-ID' WHEN 3 THEN 'api_key,path' WHEN 4 THEN 'span_id' WHEN 5 THEN 'note'
            WHEN 6 THEN 'cvv,uid,time' ELSE 'message' END AS fields,
       event_id % 3 = 0 AS body_sourced
FROM events""",
    "v_audit_log": "SELECT user_id, event_id % 2 = 0 AS structured FROM events WHERE event_type <> 'purchase'",
    # Two thirds of the customers have log rows of one kind only, or none.
    "v_audit_mix": """
SELECT user_id, structured AND user_id % 3 = 0 AS structured FROM v_audit_log""",
    "v_ops": """
SELECT CAST(o_orderkey AS STRING) AS record_id, o_custkey AS user_id,
       CASE o_orderstatus WHEN 'F' THEN 'chargeAccount' WHEN 'O' THEN 'createOrder'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'notifyCustomer' ELSE 'listItems' END END AS name
FROM orders""",
    "v_entities": """
SELECT p_partkey AS entity_id, CAST(floor(p_partkey / 20) AS INT) AS grp,
       CASE p_partkey % 9 WHEN 0 THEN 'processCharge' WHEN 1 THEN 'listOrders' WHEN 2 THEN 'onWebhook'
            WHEN 3 THEN 'exchange' WHEN 4 THEN 'refundAll' WHEN 5 THEN 'notifyUser' ELSE 'health' END AS name,
       CASE p_size % 4 WHEN 0 THEN '/svc/payment' WHEN 1 THEN '/svc/users' WHEN 2 THEN '/svc/billing'
            ELSE '/svc/misc' END AS dir,
       CASE p_size % 5 WHEN 0 THEN 'stripe-go' WHEN 1 THEN 'acme/svc/card' ELSE 'fmt' END AS import_path,
       CASE p_size % 3 WHEN 0 THEN 'CardRequest' ELSE 'User' END AS type_name,
       CASE p_size % 7 WHEN 0 THEN 'cvv' ELSE 'email' END AS field_name
FROM part""",
    # Groups of two entities, so that many have no tier 1 name.
    "v_entity_pairs": """
SELECT entity_id, CAST(floor(entity_id / 2) AS INT) AS grp, name FROM v_entities""",
    # One node per part, two outgoing edges each: the graph grows with the table and holds cycles.
    "v_edges": """
SELECT p_partkey AS src, CAST(floor(p_partkey * p_size / 60) AS BIGINT) AS dst FROM part
UNION SELECT p_partkey AS src, p_partkey + p_size AS dst FROM part""",
    "v_sinks": "SELECT p_partkey AS node FROM part WHERE p_type = 'PROMO' AND p_size > 40",
    "v_findings_bulk": """
SELECT l_orderkey * 10 + l_linenumber AS ord,
       CASE l_partkey % 9 WHEN 0 THEN 'PAN-LITERAL' WHEN 1 THEN 'SEC-PREFIX' WHEN 2 THEN 'CSP-OK'
            WHEN 3 THEN 'NONCE-MISSING' WHEN 4 THEN 'DEP-VULN' WHEN 5 THEN 'PAN-LOGGER' WHEN 6 THEN 'AUDIT-LOG-OK'
            WHEN 7 THEN 'CRYPTO-PLAIN-HTTP' ELSE 'SQL-TEXT-TYPE' END AS rule_id,
       CASE l_linenumber % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW'
            ELSE 'INFO' END AS severity,
       CASE l_partkey % 9 WHEN 0 THEN '3.4.1' WHEN 1 THEN '8.6.2' WHEN 2 THEN '6.4.3' WHEN 3 THEN '6.4.3'
            WHEN 4 THEN '6.3.3' WHEN 5 THEN '3.5.1' WHEN 6 THEN '10.2.1' WHEN 7 THEN '4.2.1' ELSE '3.5.1' END
       AS requirement_id,
       CASE l_suppkey % 4 WHEN 0 THEN 'internal/card/' WHEN 1 THEN 'config/prod/' WHEN 2 THEN 'testdata/'
            ELSE 'services/billing/' END
       || 'f' || CAST(l_suppkey AS STRING)
       || CASE l_suppkey % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.yaml' ELSE '.html' END AS path,
       CAST(l_orderkey % 30 AS INT) + 1 AS line_no,
       CASE l_partkey % 9 WHEN 5 THEN '3.4.1,10.2.1' WHEN 1 THEN '8.3.1' ELSE '' END AS related,
       l_suppkey AS record_id
FROM lineitem""",
    # What a review expects: most rules, with some lines moved and some left open (0).
    "v_expected": """
SELECT rule_id, severity, path,
       CASE ord % 4 WHEN 0 THEN 0 WHEN 1 THEN line_no + 2 WHEN 2 THEN line_no + 40 ELSE line_no END AS line_no
FROM v_findings_bulk WHERE rule_id NOT IN ('DEP-VULN', 'CSP-OK')""",
    "v_actual": "SELECT rule_id, severity, path, line_no FROM v_findings_bulk WHERE severity <> 'LOW'",
    "v_field_findings": """
SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'PAN-TYPE' ELSE 'PAN-KEYWORD' END AS rule_id,
       CASE p_size % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       CASE p_size % 11 WHEN 0 THEN 'svc/api/' ELSE '' END
       || 'f' || CAST(CAST(floor(p_partkey / 4) AS INT) AS STRING) AS path,
       CAST(p_size % 2 AS INT) AS line_no, CASE p_partkey % 2 WHEN 0 THEN 'field' ELSE 'tag' END AS kind,
       CASE p_size % 4 WHEN 0 THEN 'cardNumber' WHEN 1 THEN 'card_number' WHEN 2 THEN 'cvv' ELSE 'CVV' END AS subject,
       'fn' || CAST(p_partkey % 1000 AS STRING) AS function_name, p_partkey AS node,
       p_size % 4 = 0 AS has_json_tag, p_size % 5 = 0 AS has_db_tag
FROM part""",
    "v_requirements": """
SELECT * FROM (VALUES ('3.3.1','SAD not retained',true,NULL,NULL),('3.4.1','PAN masked',true,NULL,NULL),
  ('3.5.1','PAN unreadable',true,NULL,NULL),('4.2.1','Strong crypto in transit',true,NULL,NULL),
  ('6.3.3','Patches',true,NULL,NULL),('6.4.3','Page scripts',true,NULL,NULL),
  ('8.6.2','No hard-coded passwords',true,NULL,NULL),('10.2.1','Audit logs',false,NULL,NULL),
  ('8.3.1','Auth factors',false,NULL,NULL),('3.3.1.1','Track data',false,'3.3.1',NULL),
  ('9.1.1','Physical access',false,NULL,'on-site'),('12.1.1','Policy',false,NULL,NULL))
AS t(requirement_id, title, covered, covered_by, reason)""",
}

# Columns of the event stream, in either engine: what twenty agents report, as text, settings, addresses and log fields.
STREAM_COLUMNS = {
    "event_time": "ts",
    "record_id": "'agent' || CAST(user_id % 20 AS STRING)",
    "path": "'svc/' || event_type",
    "text": "CASE event_id % 5 WHEN 0 THEN 'card_number = 4111111111111111' WHEN 1 THEN 'ref 5500000000000004 paid' ELSE 'nothing' END",
    "key": "CASE event_type WHEN 'purchase' THEN 'db.password' WHEN 'error' THEN 'svc.token' ELSE 'svc.note' END",
    "value": "CASE event_id % 3 WHEN 0 THEN 'changeme' WHEN 1 THEN 'sk_' || 'live_' || substr(md5(event_type), 1, 30) ELSE 'plainvalue' END",
    "url": "CASE event_id % 4 WHEN 0 THEN 'http://' || event_type || '.example.net/x' WHEN 1 THEN 'http://localhost/x' ELSE 'https://a.example.net' END",
    "fields": "CASE event_type WHEN 'purchase' THEN 'card_number,outcome,cvv' WHEN 'error' THEN 'api_key,message,span_id' WHEN 'signup' THEN 'password,User-Agent' ELSE 'note,path' END",
    "body_sourced": "event_id % 3 = 0",
}

IGNORE_FILE = ["testdata/**", "config/prod/f5.yaml:7", "**/*.html", "exclude-package: internal/card/**", "exclude-package: vendor/**"]


def closure(sql: str) -> list[str]:
    """Views a text needs, in an order that defines each before its use."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def expand(sql: str, extra: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """`sql` with the views it uses, and the given extra steps, as a WITH clause."""
    whole = " ".join([sql, *[text for _, text in extra]])
    steps = [(name, VIEWS[name].strip()) for name in closure(whole)] + list(extra)
    if not steps:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS (\n{text}\n)" for name, text in steps) + f"\n{sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, columns: str = "*", hint: str = "") -> DataFrame:
    """A view as a DataFrame; only the parquet columns it needs are read.

    `hint` goes to the planner with the view's own SELECT, for a view that joins tables that grow: by the size of
    its compressed file a table would be sent through the driver.
    """
    text = f"SELECT {columns} FROM {name}"
    names = closure(text)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", " ".join(VIEWS[n] for n in names))]
    steps = [(t, f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`") for t in used]
    steps += [(n, VIEWS[n].strip()) for n in names if n != name]
    steps += [(name, VIEWS[name].strip().replace("SELECT", f"SELECT /*+ {hint} */", 1) if hint else VIEWS[name].strip())]
    with_text = ",\n".join(f"{n} AS (\n{t}\n)" for n, t in steps)
    return spark.sql(f"WITH {with_text}\n{text}")
