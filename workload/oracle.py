"""SQL for the checking engine: one text per query, written independently of the operators.

Where the operators use regexes over whole strings, these texts use lists,
windows, correlated tests and recursion. Word lists are the shared fixed values.
"""

from __future__ import annotations

from sievelake import fixed_values as fv
from workload.queries import AS_OF, SCOPE_EXTS
from workload.views import STREAM_COLUMNS, expand

ORACLE: dict[str, str] = {}


def add(name: str, sql: str, *steps: tuple[str, str], recursive: bool = False) -> None:
    ORACLE[name] = expand(sql.strip(), list(steps), recursive)


# ---- building blocks ----------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def arr(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def has_any(x: str, words) -> str:
    """x contains one of the words."""
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def starts_any(x: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(w)})" for w in words) + ")"


def ends_any(x: str, words) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {q(w)})" for w in words) + ")"


def norm(x: str) -> str:
    return f"lower(replace(replace({x}, '_', ''), '-', ''))"


def last(x: str) -> str:
    return f"string_split({x}, '.')[-1]"


def segs(path: str) -> str:
    return f"string_split(lower({path}), '/')"


def seg_any(path: str, words) -> str:
    return f"list_has_any({segs(path)}, {arr(words)})"


def base(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def ext(path: str) -> str:
    return rf"lower(regexp_extract({path}, '(\.[^./]*)$', 1))"


def luhn(x: str) -> str:
    digit = f"TRY_CAST(substr({x}, length({x}) - CAST(i AS INTEGER) + 1, 1) AS INTEGER)"
    doubled = f"CASE WHEN i % 2 = 1 THEN {digit} ELSE (2 * {digit}) // 10 + (2 * {digit}) % 10 END"
    total = f"list_sum(list_transform(range(1, length({x}) + 1), lambda i: {doubled}))"
    return f"(regexp_full_match({x}, '[0-9]{{13,19}}') AND coalesce({total} % 10 = 0, false))"


def brand(x: str) -> str:
    arms = []
    for name, digits, low, high, lengths in fv.CARD_BRANDS:
        prefix = f"TRY_CAST(substr({x}, 1, {digits}) AS INTEGER)"
        sizes = ", ".join(str(n) for n in lengths)
        arms.append(f"WHEN {prefix} BETWEEN {low} AND {high} AND length({x}) IN ({sizes}) THEN {q(name)}")
    return "CASE " + " ".join(arms) + " END"


def likely_pan(x: str) -> str:
    return f"({luhn(x)} AND {brand(x)} IS NOT NULL)"


def kind(name: str) -> str:
    return (
        f"CASE WHEN regexp_matches({name}, {q(fv.SAD_NAME_PATTERN)}) THEN 'SAD' "
        f"WHEN regexp_matches({name}, {q(fv.PAN_NAME_PATTERN)}) THEN 'PAN' ELSE 'UNKNOWN' END"
    )


def sensitive(name: str) -> str:
    return f"({norm(name)} IN {inlist(fv.SENSITIVE_KEYWORDS)})"


def entropy(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0.0 ELSE list_aggregate(string_split({x}, ''), 'entropy') END"


def rank(s: str) -> str:
    return (
        f"CASE {s} WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 "
        "WHEN 'INFO' THEN 1 ELSE 0 END"
    )


def prod(path: str) -> str:
    lower = f"lower({path})"
    return (
        f"({seg_any(path, fv.PROD_SEGMENTS)} OR {base(lower)} IN {inlist(fv.PROD_FILES)} "
        f"OR {has_any(lower, fv.PROD_PREFIXES)})"
    )


def dev(path: str) -> str:
    return f"({seg_any(path, fv.DEV_SEGMENTS)} OR {starts_any(base(f'lower({path})'), fv.DEV_FILE_PREFIXES)})"


def dedicated(path: str) -> str:
    return seg_any(path, fv.DEDICATED_DEV_SEGMENTS)


def dev_value(value: str) -> str:
    return f"(lower({value}) IN {inlist(fv.DEV_PLACEHOLDERS)})"


def ctx_severity(path: str, value: str, sev: str) -> str:
    """Environment-adjusted severity."""
    return (
        f"CASE WHEN {prod(path)} THEN 'CRITICAL' WHEN {dedicated(path)} THEN 'INFO' "
        f"WHEN {dev(path)} AND {dev_value(value)} THEN 'INFO' "
        f"WHEN ({dev(path)} OR {dev_value(value)}) AND ({rank(sev)}) > 3 THEN 'MEDIUM' ELSE {sev} END"
    )


def ctx_dev(path: str, value: str) -> str:
    return f"(NOT {prod(path)} AND ({dedicated(path)} OR {dev(path)} OR {dev_value(value)}))"


def ctx_examples(path: str) -> str:
    return f"(NOT {prod(path)} AND {dedicated(path)} AND {seg_any(path, fv.EXAMPLE_SEGMENTS)})"


def basic_placeholder(v: str) -> str:
    return (
        f"(strlen({v}) < 4 OR (starts_with({v}, '<') AND ends_with({v}, '>')) "
        f"OR lower({v}) IN {inlist(fv.PLACEHOLDER_VALUES)})"
    )


def fragment(v: str) -> str:
    return has_any(f"lower({v})", fv.PLACEHOLDER_SUBSTRINGS)


def template(v: str) -> str:
    return (
        f"((starts_with({v}, chr(36) || '{{') AND ends_with({v}, '}}')) "
        f"OR ({v} <> '' AND replace(lower({v}), 'x', '') = ''))"
    )


def password_placeholder(v: str) -> str:
    return (
        f"({v} = '' OR lower({v}) IN {inlist(fv.PASSWORD_PLACEHOLDERS)} "
        f"OR (starts_with({v}, '<') AND ends_with({v}, '>')) OR {template(v)})"
    )


def is_sql(v: str) -> str:
    return f"regexp_matches({v}, {q(fv.SQL_TEXT_PATTERN)})"


def credential(key: str) -> str:
    return has_any(norm(last(key)), [w.replace("_", "") for w in fv.CREDENTIAL_KEY_WORDS])


def path_value(v: str) -> str:
    noise = " AND ".join(f"NOT contains({v}, {c})" for c in ["' '", "chr(9)", "'='", "''''", "'\"'", "'`'"])
    schemes = starts_any(f"lower({v})", ["http://", "https://", "file://", "s3://", "gs://"])
    return (
        f"({v} <> '' AND {noise} AND ({schemes} OR regexp_matches({v}, {q(fv.FILE_PATH_PATTERN)}) "
        f"OR regexp_matches({v}, {q(fv.HOSTNAME_PATTERN)}) "
        f"OR (regexp_matches({v}, {q(fv.RELATIVE_PATH_PATTERN)}) AND len(list_filter(string_split({v}, '/'), "
        f"lambda s: regexp_full_match(s, '[a-zA-Z0-9]{{20,}}'))) = 0)))"
    )


def pair(key: str, v: str) -> str:
    return f"({ends_any(f'lower({last(key)})', fv.PATH_URL_KEY_SUFFIXES)} AND {path_value(v)})"


def secret_prefix(v: str) -> str:
    arms = " ".join(
        f"WHEN starts_with({v}, {q(p)}) AND strlen({v}) >= {n} THEN {q(name)}" for name, p, n in fv.SECRET_PREFIXES
    )
    return f"CASE {arms} END"


def connstr(v: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({v}, {q(p)})" for p in fv.CONNECTION_STRING_PATTERNS) + ")"


def non_secret(v: str) -> str:
    digits = f"len(regexp_extract_all({v}, '[0-9]'))"
    return (
        f"(regexp_matches({v}, {q(fv.DOTTED_KEY_PATTERN)}) OR regexp_matches({v}, {q(fv.URL_PATH_PATTERN)}) "
        f"OR regexp_matches({v}, {q(fv.UPPER_ENUM_PATTERN)}) "
        f"OR (strlen({v}) <= 32 AND {digits} <= 3 AND regexp_matches({v}, {q(fv.CAMEL_IDENTIFIER_PATTERN)})) "
        f"OR {starts_any(f'lower({v})', fv.ERROR_PREFIXES)})"
    )


def character_set(v: str) -> str:
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    runs = (
        f"len(list_filter(range(1, 18), lambda i: contains({v}, substr({upper}, CAST(i AS INTEGER), 10)) "
        f"OR contains({v}, lower(substr({upper}, CAST(i AS INTEGER), 10))))) > 0"
    )
    distinct = f"len(list_distinct(regexp_extract_all(hex(encode({v})), '..')))"
    return (
        f"(strlen({v}) >= 20 AND {distinct} * 100 >= strlen({v}) * 70 "
        f"AND (contains({v}, '0123456789') OR {runs}))"
    )


def excluded(v: str) -> str:
    return (
        f"(strlen({v}) < 8 OR regexp_matches({v}, {q(fv.SEMVER_PATTERN)}) "
        f"OR regexp_matches({v}, {q(fv.URL_PATTERN)}) OR regexp_matches({v}, {q(fv.UUID_PATTERN)}))"
    )


def word_list(name: str) -> str:
    marked = f"regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    marked = f"regexp_replace({marked}, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')"
    return f"list_filter(string_split_regex({marked}, '[_-]+'), lambda w: w <> '')"


def boundary(name: str, keywords) -> str:
    """Word-by-word test: a keyword that is last, or followed by a value word."""
    words = f"list_transform({word_list(name)}, lambda w: lower(w))"
    hits = (
        f"list_filter(range(1, len({words}) + 1), lambda i: ({words})[i] IN {inlist(keywords)} "
        f"AND (i = len({words}) OR ({words})[i + 1] IN {inlist(fv.VALUE_SUFFIX_WORDS)}))"
    )
    return f"(len({hits}) > 0 OR lower({name}) IN {inlist(keywords)})"


def plaintext(t: str) -> str:
    return f"regexp_matches({t}, {q(fv.PLAINTEXT_TYPE_PATTERN)})"


def field_class(name: str) -> str:
    n = norm(name)
    return (
        f"CASE WHEN {has_any(n, fv.LOG_GENERIC_ID_WORDS)} THEN 'GENERIC_ID' "
        f"WHEN {has_any(n, fv.LOG_PAN_WORDS)} THEN 'PAN' "
        f"WHEN {has_any(n, fv.LOG_SECRET_WORDS)} THEN 'SECRET' ELSE 'NONE' END"
    )


def csp_words(v: str) -> tuple[str, str, str]:
    """(last script-src directive, last default-src directive, governing words) of a policy."""
    directives = (
        f"list_transform(string_split(lower({v}), ';'), lambda d: string_split_regex("
        r"regexp_replace(d, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g'), '[ \t\r\n\f]+'))"
    )
    script = f"list_filter({directives}, lambda d: d[1] = 'script-src')[-1]"
    default = f"list_filter({directives}, lambda d: d[1] = 'default-src')[-1]"
    return script, default, f"coalesce({script}, {default}, [])"


def csp_flags(v: str) -> dict[str, str]:
    script, default, words = csp_words(v)
    nonce = f"(len(list_filter({words}, lambda w: starts_with(w, '''nonce-'))) > 0)"
    dynamic = f"list_contains({words}, '''strict-dynamic''')"
    inline = f"list_contains({words}, '''unsafe-inline''')"
    flags = {
        "has_script_src": f"{script} IS NOT NULL",
        "has_default_src": f"{default} IS NOT NULL",
        "no_script_restriction": f"({script} IS NULL AND {default} IS NULL)",
        "has_unsafe_inline": f"({inline} AND NOT {nonce} AND NOT {dynamic})",
        "has_unsafe_eval": f"list_contains({words}, '''unsafe-eval''')",
        "has_nonce": nonce,
        "has_strict_dynamic": dynamic,
        "analyzable": "true",
    }
    return {name: f"CASE WHEN {v} IS NOT NULL THEN {text} END" for name, text in flags.items()}


EMPTY = "''"


def found(
    rule: str,
    severity: str,
    requirement: str,
    record: str = EMPTY,
    path: str = EMPTY,
    line: str = "0",
    subject: str = EMPTY,
    related: str = EMPTY,
    dev_context: str = "false",
    hint: str = EMPTY,
) -> str:
    """Select list of a finding row; arguments are SQL expressions."""
    return (
        f"{rule} AS rule_id, {severity} AS severity, {requirement} AS requirement_id, "
        f"CAST({record} AS VARCHAR) AS record_id, {path} AS path, CAST({line} AS INTEGER) AS line_no, "
        f"{subject} AS subject, {related} AS related, {dev_context} AS dev_context, {hint} AS triage_hint"
    )


# ---- sources and scope --------------------------------------------------------

UNITS = """
SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS record_id, 'documents' AS source,
       'documents/' || CAST(doc_id AS VARCHAR) AS path, text FROM documents
UNION ALL SELECT 'pages/' || CAST(page_id AS VARCHAR), 'pages', url, html FROM pages
UNION ALL SELECT 'conversations/' || conv_id || '-' || turn, 'conversations', 'conversations/' || conv_id || '-' || turn, text
FROM conversations"""
DOC_LINES = """
SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS record_id, CAST(i AS INTEGER) AS line_no, ls[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)"""

add(
    "src01_read_units",
    "SELECT record_id, source, path, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM units",
    ("units", UNITS),
)
add(
    "src01_read_lines",
    """
SELECT file, CAST(i AS INTEGER) AS line_no, md5(ls[i]) AS line_md5
FROM (SELECT CAST(doc_id % 16 AS INTEGER) AS file, string_split(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id), chr(10)) AS ls FROM documents GROUP BY 1),
     unnest(range(1, len(ls) + 1)) AS u(i)""",
)
add(
    "src02_filter_scope",
    f"""
SELECT record_id, path, n_bytes FROM v_paths
WHERE n_bytes <= {fv.MAX_FILE_BYTES} AND {ext('path')} IN {inlist(SCOPE_EXTS)}
  AND NOT list_has_any(list_slice({segs('path')}, 1, -2), {arr([*fv.DEFAULT_EXCLUDED_DIRS, 'examples'])})
  AND NOT ends_with(path, '.pb.go') AND NOT ends_with(path, '_test.go')
  AND NOT list_has_any(string_split(path, '/'), {arr(fv.TEST_DIR_SEGMENTS)})""",
)
add("src03_tracked_only", "SELECT * FROM v_paths p WHERE EXISTS (SELECT 1 FROM v_manifest m WHERE m.path = p.path)")
add("src04_to_lines", "SELECT record_id, line_no, md5(line) AS line_md5 FROM doc_lines", ("doc_lines", DOC_LINES))

BLANK = r"[ \t\r\n\f]"
add(
    "src05_extract_kv",
    f"""
SELECT record_id, line_no, md5(key) AS key_md5,
       md5(CASE WHEN length(raw) >= 2 AND ((starts_with(raw, '"') AND ends_with(raw, '"'))
                     OR (starts_with(raw, '''') AND ends_with(raw, '''')))
                THEN substr(raw, 2, length(raw) - 2) ELSE raw END) AS value_md5
FROM (SELECT record_id, line_no, regexp_replace(substr(body, 1, instr(body, '=') - 1), '^{BLANK}+|{BLANK}+$', '', 'g') AS key,
             regexp_replace(substr(body, instr(body, '=') + 1), '^{BLANK}+|{BLANK}+$', '', 'g') AS raw FROM body)
WHERE raw NOT IN ('', '""', '''''')""",
    ("doc_lines", DOC_LINES),
    (
        "body",
        f"""
SELECT record_id, line_no, CASE WHEN starts_with(t, 'export ') THEN ltrim(substr(t, 8)) ELSE t END AS body
FROM (SELECT record_id, line_no, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM doc_lines)
WHERE contains(t, '=') AND NOT starts_with(t, '#')""",
    ),
)
INLINE = r"([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*=[ \t]*\"([^\"\n]+)\""
INLINE_KV = rf"""
SELECT record_id, line_no, regexp_extract(hit, '{INLINE}', 1) AS key, regexp_extract(hit, '{INLINE}', 2) AS value
FROM (SELECT record_id, line_no, unnest(regexp_extract_all(line, '{INLINE}')) AS hit FROM doc_lines)"""
add(
    "src05_extract_inline_kv",
    "SELECT record_id, line_no, key, md5(value) AS value_md5 FROM inline_kv",
    ("doc_lines", DOC_LINES),
    ("inline_kv", INLINE_KV),
)
add("src06_flatten_json", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
add(
    "src06_flatten_json_nested",
    """
SELECT event_id, 'event.kind' AS key, event_type AS value FROM events
UNION ALL SELECT event_id, 'event.ids[0]', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'event.ids[1]', CAST(event_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'event.inner.list[0].big', CASE WHEN value > 10 THEN 'true' ELSE 'false' END FROM events""",
)
add(
    "src07_column_inventory",
    """
SELECT table_name, column_name, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n_events
FROM (SELECT *, last_value(op) OVER (PARTITION BY table_name, column_name ORDER BY ord
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
      FROM v_schema_events)
WHERE final = 'ADD' GROUP BY table_name, column_name""",
)

ATTRS = r"""((?:[\s/][^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*)?)"""
SCRIPT_SQL = rf"(?is)<script{ATTRS}>.*?(?:</script|\z)"
ATTRIBUTE_SQL = r"""([^\s"''>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?"""


def attr(attrs: str, name: str) -> str:
    """Value of the last attribute of that name; '' when bare, null when absent."""
    names = f"regexp_extract_all({attrs}, '{ATTRIBUTE_SQL}', 1)"
    values = f"regexp_extract_all({attrs}, '{ATTRIBUTE_SQL}', 2)"
    at = f"list_filter(range(1, len({names}) + 1), lambda i: lower(({names})[i]) = {q(name)})[-1]"
    return f"""regexp_replace(({values})[{at}], '^["'']|["'']$', '', 'g')"""


CLEAN = r"SELECT page_id, url, html, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS clean FROM v_pages_aug"
BARE = rf"SELECT page_id, url, regexp_replace(clean, '{SCRIPT_SQL}', '<script\1>', 'g') AS bare FROM clean"
TAGS = rf"""
SELECT page_id, url, CAST(i AS INTEGER) AS pos, coalesce({attr('a', 'src')}, '') AS src,
       {attr('a', 'integrity')} IS NOT NULL AS has_integrity, {attr('a', 'nonce')} IS NOT NULL AS has_nonce,
       CASE WHEN i < len(pieces) THEN 1 + length(array_to_string(list_slice(pieces, 1, i), ''))
              - length(replace(array_to_string(list_slice(pieces, 1, i), ''), chr(10), '')) ELSE 0 END AS line_no
FROM (SELECT page_id, url, string_split(html, '<script') AS pieces, tags, i, tags[i] AS a
      FROM (SELECT page_id, url, html, regexp_extract_all(clean, '{SCRIPT_SQL}', 1) AS tags FROM clean),
           unnest(range(1, len(tags) + 1)) AS u(i))"""
METAS = f"""
SELECT page_id, url, max_by({attr('a', 'content')}, i) AS csp
FROM (SELECT page_id, url, i, tags[i] AS a
      FROM (SELECT page_id, url, regexp_extract_all(bare, '(?is)<(?:meta){ATTRS}>', 1) AS tags FROM bare),
           unnest(range(1, len(tags) + 1)) AS u(i))
WHERE lower({attr('a', 'http-equiv')}) = 'content-security-policy' AND {attr('a', 'content')} IS NOT NULL
GROUP BY page_id, url"""
PAYMENT_ATTR = " OR ".join(
    f"coalesce({has_any(f'lower({attr("a", name)})', fv.PAYMENT_FORM_WORDS)}, false)"
    for name in fv.PAYMENT_FORM_ATTRIBUTES
)
FORMS = f"""
SELECT p.page_id, p.url, coalesce(f.hit, false) AS is_payment FROM v_pages_aug p LEFT JOIN (
  SELECT page_id, bool_or({PAYMENT_ATTR}) AS hit
  FROM (SELECT page_id, unnest(regexp_extract_all(bare, '(?is)<(?:form|input){ATTRS}>', 1)) AS a FROM bare)
  GROUP BY page_id) f ON f.page_id = p.page_id"""
PAGE_STEPS = (("clean", CLEAN), ("bare", BARE), ("tags", TAGS), ("metas", METAS), ("forms", FORMS))

add(
    "src08_script_tags",
    """
SELECT page_id, pos, src, src <> '' AS has_src, has_integrity, has_nonce, CAST(line_no AS INTEGER) AS line_no
FROM tags""",
    *PAGE_STEPS,
)
add("src09_meta_csp", "SELECT page_id, csp FROM metas", *PAGE_STEPS)
add("src10_payment_form_flag", "SELECT page_id, is_payment FROM forms", *PAGE_STEPS)
LOCK = """
SELECT project_id, module, CASE WHEN ends_with(version, '/go.mod') THEN left(version, length(version) - 7) ELSE version END
         AS version, sum AS hash, ends_with(version, '/go.mod') AS mod_only FROM v_lock"""
add("src11_lock_entries", "SELECT * FROM lock", ("lock", LOCK))
add(
    "src12_explode_advisories",
    """
SELECT adv_id, package, 0 AS range_no, 0 AS event_no, introduced, CAST(NULL AS VARCHAR) AS fixed FROM v_advisories
UNION ALL SELECT adv_id, package, 0, 1, NULL, fixed FROM v_advisories WHERE fixed IS NOT NULL""",
)
add("sink01_write_findings", "SELECT ord, rule_id, severity, path, line_no FROM v_findings_bulk")
add("sink01_findings_json", "SELECT ord, rule_id, severity, path FROM v_findings_bulk")

# ---- scalar functions ---------------------------------------------------------

add("fn01_normalize_name", f"SELECT record_id, {norm('key')} AS norm FROM v_kv")
add(
    "fn02_extract_digits",
    """
SELECT doc_id, CAST(length(d) AS INTEGER) AS n_digits, md5(d) AS digits_md5
FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]'), '') AS d FROM documents)""",
)
RUNS = """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, runs[i] AS run
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS runs FROM documents), unnest(range(1, len(runs) + 1)) AS u(i)"""
add("fn03_luhn_valid", f"SELECT doc_id, pos, {luhn('run')} AS valid FROM runs", ("runs", RUNS))
add("fn04_card_brand", f"SELECT doc_id, pos, coalesce({brand('run')}, '') AS brand FROM runs", ("runs", RUNS))
add("fn05_is_likely_pan", f"SELECT doc_id, pos, {likely_pan('run')} AS likely FROM runs", ("runs", RUNS))
add("fn06_shannon_entropy", f"SELECT record_id, round({entropy('value')}, 6) AS entropy FROM v_kv")
add("fn07_is_high_entropy", f"SELECT record_id, strlen(value) >= 16 AND {entropy('value')} > 4.5 AS high FROM v_kv")
add(
    "fn08_is_sensitive_keyword",
    f"SELECT table_name, column_name, {sensitive('column_name')} AS sensitive FROM v_all_cols",
)
add(
    "fn09_has_test_prefix",
    f"""SELECT record_id, {starts_any('lower(key)', fv.TEST_PREFIXES)} AS key_is_test,
       {starts_any("lower('Mock' || key)", fv.TEST_PREFIXES)} AS mock_is_test FROM v_kv""",
)
add("fn10_classify_pan_sad", f"SELECT table_name, column_name, {kind('column_name')} AS kind FROM v_all_cols")
add(
    "fn11_requirement_for",
    f"""
SELECT table_name, column_name, CASE WHEN k = 'PAN' THEN '3.5.1' ELSE '3.3.1' END AS field_requirement,
       CASE WHEN k = 'PAN' THEN '' ELSE '3.3.1.2' END AS field_related,
       CASE WHEN k = 'PAN' THEN '3.5.1' ELSE '3.3.1' END AS logger_requirement,
       CASE WHEN k = 'PAN' THEN '3.4.1,10.2.1' ELSE '3.3.1.2' END AS logger_related
FROM (SELECT table_name, column_name, {kind('column_name')} AS k FROM v_all_cols)""",
)
add(
    "fn12_placeholder_kind",
    f"""
SELECT record_id, CASE WHEN {basic_placeholder('value')} THEN 'basic' WHEN {fragment('value')} THEN 'substring'
       WHEN {template('value')} THEN 'template' ELSE '' END AS kind,
       {password_placeholder('value')} AS password_placeholder FROM v_kv""",
)
add("fn13_is_sql_text", f"SELECT record_id, {is_sql('value')} AS is_sql FROM v_kv")
add("fn14_is_credential_key", f"SELECT record_id, {credential('key')} AS credential FROM v_kv")
add(
    "fn15_is_path_or_url_pair",
    f"SELECT record_id, {pair('key', 'value')} AS pair, {path_value('path')} AS path_is_path FROM v_kv",
)
add("fn16_secret_prefix", f"SELECT record_id, coalesce({secret_prefix('value')}, '') AS prefix FROM v_kv")
add("fn17_is_connection_string", f"SELECT record_id, {connstr('value')} AS connstr FROM v_kv")
add(
    "fn18_is_non_secret",
    f"SELECT record_id, {non_secret('value')} AS value_plain, {non_secret(last('key'))} AS name_plain FROM v_kv",
)
add(
    "fn19_is_character_set",
    f"""
SELECT record_id, {character_set('value')} AS plain, {character_set("('ABCDEFGHIJKLM' || value)")} AS with_letters,
       {character_set("(value || '0123456789!@#%^&*()')")} AS with_digits FROM v_kv""",
)
add("fn20_is_excluded_literal", f"SELECT record_id, {excluded('value')} AS excluded FROM v_kv")
add(
    "fn21_identifier_words",
    f"""
SELECT record_id, array_to_string({word_list(last('key'))}, '|') AS words,
       {boundary(last('key'), fv.KEY_WORDS)} AS key_word, {boundary(last('key'), fv.PASSWORD_WORDS)} AS password_word
FROM v_kv""",
)
add(
    "fn22_is_payment_path",
    f"""
SELECT path AS location, {seg_any('path', fv.PAYMENT_PATH_SEGMENTS)} AS payment FROM v_paths
UNION ALL SELECT url, {seg_any('url', fv.PAYMENT_PATH_SEGMENTS)} FROM pages""",
)
add(
    "fn23_severity_rank",
    f"""
SELECT severity, count(*) AS n, {rank('severity')} AS sev_rank, 5 - ({rank('severity')}) AS sev_order
FROM v_findings_bulk GROUP BY severity""",
)
add(
    "fn24_dev_context",
    f"""
SELECT record_id, {ctx_severity('path', 'value', "'HIGH'")} AS from_high,
       {ctx_severity('path', 'value', "'INFO'")} AS from_info, {ctx_dev('path', 'value')} AS dev_context,
       CASE WHEN NOT {prod('path')} AND ({dev('path')} OR {dev_value('value')}) THEN 'dev-context' ELSE '' END AS label
FROM v_kv""",
)
LOCATION = "CASE " + " ".join(f"WHEN s IN {inlist(names)} THEN {q(label)}" for names, label in fv.LOCATION_LABELS) + " END"


def location(path: str) -> str:
    return (
        f"coalesce(list_filter(list_transform({segs(path)}, lambda s: {LOCATION}), "
        "lambda x: x IS NOT NULL)[1], '')"
    )


add("fn25_file_location", f"SELECT record_id, {location('path')} AS location FROM v_paths")
add(
    "fn26_glob_match",
    """
SELECT record_id, starts_with(path, 'testdata/') AS testdata_tree, starts_with(path, 'vendor/') AS vendor_tree,
       ends_with(path, '.yaml') AS any_yaml,
       starts_with(path, 'internal/card/') AND ends_with(path, '.env') AND len(string_split(path, '/')) = 3 AS card_env,
       starts_with(path, 'config/prod/f') AND ends_with(path, '.json') AND length(path) = 19 AS one_digit,
       starts_with(path, 'deploy/') AND ends_with(path, '.json') AS deploy_json
FROM v_paths""",
)
add(
    "fn27_parse_csp",
    "SELECT page_id, " + ", ".join(f"{text} AS {name}" for name, text in csp_flags("csp").items()) + " FROM v_csp",
)
VERSION_PARTS = "list_transform(string_split(replace(version, 'v', ''), '.'), lambda p: CAST(p AS INTEGER))"
add(
    "fn28_semver_key",
    f"""
SELECT ord, 1 AS is_valid, p[1] AS major, p[2] AS minor, p[3] AS patch, 1 AS is_release, p >= [1, 5, 3] AS at_least_1_5_3
FROM (SELECT ord, {VERSION_PARTS} AS p FROM v_deps)""",
)


def weight(vector: str, name: str, table: dict[str, float]) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in table.items())
    return f"(CASE regexp_extract('/' || {vector} || '/', '/{name}:([A-Z])/', 1) {arms} END)"


def cvss3(vector: str) -> str:
    w = {
        "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
        "AC": {"L": 0.77, "H": 0.44},
        "UI": {"N": 0.85, "R": 0.62},
        "C": {"H": 0.56, "L": 0.22, "N": 0.0},
        "I": {"H": 0.56, "L": 0.22, "N": 0.0},
        "A": {"H": 0.56, "L": 0.22, "N": 0.0},
    }
    t = {k: weight(vector, k, v) for k, v in w.items()}
    changed = f"contains({vector}, '/S:C')"
    pr = (
        f"CASE WHEN {changed} THEN {weight(vector, 'PR', {'N': 0.85, 'L': 0.68, 'H': 0.5})} "
        f"ELSE {weight(vector, 'PR', {'N': 0.85, 'L': 0.62, 'H': 0.27})} END"
    )
    iss = f"(1 - (1 - {t['C']}) * (1 - {t['I']}) * (1 - {t['A']}))"
    impact = f"(CASE WHEN {changed} THEN 7.52 * ({iss} - 0.029) - 3.25 * pow({iss} - 0.02, 15) ELSE 6.42 * {iss} END)"
    exploit = f"(8.22 * {t['AV']} * {t['AC']} * ({pr}) * {t['UI']})"
    raw = f"least((CASE WHEN {changed} THEN 1.08 ELSE 1.0 END) * ({impact} + {exploit}), 10.0)"
    return (
        f"CASE WHEN {vector} IS NULL THEN NULL WHEN {impact} <= 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE CAST(ceil(round({raw} * 100000) / 10000) / 10 AS DOUBLE) END"
    )


def cvss2(vector: str) -> str:
    w = {
        "AV": {"L": 0.395, "A": 0.646, "N": 1.0},
        "AC": {"H": 0.35, "M": 0.61, "L": 0.71},
        "Au": {"M": 0.45, "S": 0.56, "N": 0.704},
        "C": {"N": 0.0, "P": 0.275, "C": 0.66},
        "I": {"N": 0.0, "P": 0.275, "C": 0.66},
        "A": {"N": 0.0, "P": 0.275, "C": 0.66},
    }
    t = {k: weight(vector, k, v) for k, v in w.items()}
    impact = f"(10.41 * (1 - (1 - {t['C']}) * (1 - {t['I']}) * (1 - {t['A']})))"
    exploit = f"(20 * {t['AC']} * {t['Au']} * {t['AV']})"
    factor = f"(CASE WHEN {impact} = 0 THEN 0 ELSE 1.176 END)"
    return f"CAST(round((0.6 * {impact} + 0.4 * {exploit} - 1.5) * {factor}, 1) AS DOUBLE)"


def adv_severity(label: str, vector: str) -> str:
    score = cvss3(vector)
    return (
        f"CASE WHEN {label} = 'MODERATE' THEN 'MEDIUM' WHEN {label} IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN {label} "
        f"WHEN {score} >= 9 THEN 'CRITICAL' WHEN {score} >= 7 THEN 'HIGH' WHEN {score} >= 4 THEN 'MEDIUM' "
        f"WHEN {score} >= 0.1 THEN 'LOW' ELSE 'HIGH' END"
    )


add("fn29_advisory_severity", f"SELECT adv_id, {adv_severity('db_severity', 'cvss')} AS severity FROM v_advisories")
add(
    "fn30_cvss_base_score",
    f"SELECT record_id, {cvss3('vector')} AS score3, {cvss2('vector2')} AS score2 FROM v_cvss",
)
add(
    "fn31_h1_to_hex",
    """
SELECT project_id, lower(hex(from_base64(substr(sum, 4)))) AS sha256, 'pkg:golang/' || module || '@' || version AS purl
FROM v_lock""",
)
add("fn32_is_plaintext_type", f"SELECT table_name, column_name, {plaintext('sql_type')} AS plaintext FROM v_all_cols")
BAD_CIPHER = has_any("upper(c)", fv.PROHIBITED_CIPHER_WORDS)
add(
    "fn33_tls_predicates",
    f"""
SELECT svc_id, {has_any('upper(ciphers)', fv.PROHIBITED_CIPHER_WORDS)} AS bad_cipher,
       coalesce(min_version IN {inlist(fv.WEAK_TLS_VERSIONS)}, false) AS weak_version FROM v_tls""",
)
LOGGED = """
SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(i - 1 AS INTEGER) AS pos, fs[i] AS field, body_sourced
FROM (SELECT event_id, body_sourced, string_split(fields, ',') AS fs FROM v_log_fields), unnest(range(1, len(fs) + 1)) AS u(i)"""
add(
    "fn34_field_class",
    f"SELECT record_id, pos, {field_class('field')} AS field_class FROM logged",
    ("logged", LOGGED),
)
add("fn35_requirement_category", "SELECT ord, string_split(requirement_id, '.')[1] AS category FROM v_findings_bulk")
MIME = (
    "CASE "
    + " ".join(f"WHEN {ext('path')} IN {inlist(names)} THEN {q(mime)}" for names, mime in fv.MIME_TYPES)
    + " ELSE 'text/plain' END"
)
add(
    "fn36_link_window",
    f"""
SELECT ord, CASE WHEN line_no > 10 THEN line_no - 10 ELSE 1 END AS start_line, line_no + 10 AS end_line,
       {MIME} AS mime_type FROM v_findings_bulk""",
)

# ---- detections ---------------------------------------------------------------

TEXT_LINES = """
SELECT record_id, CAST(i AS INTEGER) AS line_no, ls[i] AS line
FROM (SELECT record_id, string_split(text, chr(10)) AS ls FROM (
        SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS record_id, text FROM documents
        UNION ALL SELECT 'conversations/' || conv_id || '-' || turn, text FROM conversations)),
     unnest(range(1, len(ls) + 1)) AS u(i)"""
BOUND = (
    r"len(list_filter(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_-]*)[ \t]*(?::=|=|:)', 1), "
    f"lambda n: {sensitive('n')})) > 0"
)
R01 = f"""
SELECT {found("'PAN-LITERAL'", f"CASE WHEN {BOUND} THEN 'CRITICAL' ELSE 'MEDIUM' END", "'3.4.1'", "record_id", "record_id", "line_no", f"{brand('t')} || ' *' || right(t, 4)")}
FROM (SELECT record_id, line_no, line, unnest(regexp_extract_all(line, '[0-9A-Za-z]+')) AS t FROM text_lines
      WHERE regexp_matches(line, '[0-9]{{13}}'))
WHERE {likely_pan('t')}"""
add("r01_scan_pan_literals", R01, ("text_lines", TEXT_LINES))

DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"


def kv_pan_sql(source: str) -> str:
    return f"""
SELECT {found("'PAN-LITERAL'", "'CRITICAL'", "'3.4.1'", "record_id", "path", "line_no", "key")}
FROM {source} WHERE {likely_pan(DIGITS)}
UNION ALL SELECT {found("'PAN-KEYWORD'", "'HIGH'", "'3.3.1'", "record_id", "path", "line_no", "key", "'3.3.1.2'")}
FROM {source} WHERE {sensitive('key')} AND value <> ''"""


R02 = kv_pan_sql("v_kv")
ENV_FORM = f"SELECT * FROM v_kv UNION ALL SELECT record_id, path, line_no, upper({last('key')}) AS key, value FROM v_kv"
add("r02_scan_kv_pan", kv_pan_sql("env_form"), ("env_form", ENV_FORM))

R03 = f"""
SELECT {found("'PAN-KEYWORD'", "CASE WHEN bank THEN 'INFO' WHEN payment >= 2 THEN 'CRITICAL' ELSE 'HIGH' END", "CASE WHEN k = 'PAN' THEN '3.5.1' ELSE '3.3.1' END", "table_name", "table_name", "ordinal", "table_name || '.' || column_name", "CASE WHEN k = 'PAN' THEN '' ELSE '3.3.1.2' END", "false", "CASE WHEN bank THEN 'banking_domain' ELSE '' END")}
FROM (SELECT *, n = 'accountnumber' AND banking >= 2 AND cards = 0
                AND NOT {has_any('lower(table_name)', fv.TOKENISATION_WORDS)} AS bank
      FROM (SELECT *, count(*) FILTER (n IN {inlist(fv.PAYMENT_INDICATORS)}) OVER t AS payment,
                   count(*) FILTER (n IN {inlist(fv.BANKING_SIBLINGS)}) OVER t AS banking,
                   count(*) FILTER (n IN {inlist(fv.CARD_SCOPE_SIBLINGS)}) OVER t AS cards
            FROM (SELECT *, {norm('column_name')} AS n, {kind('column_name')} AS k FROM v_all_cols)
            WINDOW t AS (PARTITION BY table_name)))
WHERE {sensitive('column_name')}"""
add("r03_scan_pan_columns", R03)

R04 = f"""
SELECT {found("'PAN-LOGGER'", "'CRITICAL'", f"CASE WHEN {kind('field')} = 'PAN' THEN '3.5.1' ELSE '3.3.1' END", "record_id", EMPTY, "0", "field", f"CASE WHEN {kind('field')} = 'PAN' THEN '3.4.1,10.2.1' ELSE '3.3.1.2' END")}
FROM logged WHERE {sensitive('field')}"""
add("r04_scan_log_pan", R04, ("logged", LOGGED))


def secrets_sql(source: str, first: str = "") -> str:
    p, v = "path", "value"
    live = f"NOT {basic_placeholder(v)} AND NOT {is_sql(v)}"
    late = f"NOT {fragment(v)} AND NOT {pair('key', v)}"
    hint = f"CASE WHEN {late} AND {ctx_examples(p)} THEN 'dev_path_examples_skipped' ELSE '' END"

    def arm(rule: str, base_sev: str, condition: str) -> str:
        severity = f"CASE WHEN {fragment(v)} THEN '{base_sev}' ELSE {ctx_severity(p, v, q(base_sev))} END"
        dev_flag = f"(NOT {fragment(v)} AND {ctx_dev(p, v)})"
        columns = found(q(rule), severity, "'8.6.2'", "record_id", p, "line_no", "key", EMPTY, dev_flag, hint)
        return f"SELECT {first}{columns} FROM {source} WHERE {live} AND {condition}"

    return " UNION ALL ".join(
        [
            arm("SEC-PREFIX", "CRITICAL", f"{secret_prefix(v)} IS NOT NULL"),
            arm("SEC-CONNSTR", "CRITICAL", connstr(v)),
            arm("SEC-CREDENTIAL-KEY", "CRITICAL", f"{late} AND {credential('key')}"),
            arm(
                "SEC-HIGH-ENTROPY",
                "HIGH",
                f"{late} AND {credential('key')} AND strlen({v}) >= 16 AND {entropy(v)} > 4.5",
            ),
        ]
    )


R05 = secrets_sql("v_kv")
add("r05_scan_secrets", R05)
add(
    "r05_scan_secrets_documents",
    secrets_sql("located"),
    ("doc_lines", DOC_LINES),
    ("inline_kv", INLINE_KV),
    ("located", "SELECT *, record_id AS path FROM inline_kv"),
)

KEYED = f"""
SELECT *, {last('key')} AS name, {entropy('value')} AS ent, strlen(value) AS n_bytes FROM v_kv
WHERE NOT {excluded('value')} AND NOT {is_sql('value')} AND NOT {character_set('value')} AND NOT {non_secret('value')}"""
TIERED = f"""
SELECT *, CASE WHEN {boundary('name', fv.KEY_WORDS)} AND ent >= 3 THEN 1 WHEN n_bytes >= 16 AND ent > 4.5 THEN 2
               WHEN regexp_matches(value, {q(fv.BASE64_PATTERN)}) OR regexp_matches(value, {q(fv.HEX_PATTERN)}) THEN 3 END AS tier
FROM keyed"""
SHAPED = f"""
SELECT *, {ctx_severity('path', 'value', "(CASE WHEN tier = 1 THEN 'CRITICAL' ELSE 'HIGH' END)")} AS ctx,
  CASE WHEN regexp_matches(name, '{fv.ERROR_VARIABLE_PATTERN}') AND {has_any('lower(value)', fv.ERROR_TEXT_WORDS)} THEN 'hardcoded_sentinel_error'
       WHEN ent < 4.5 AND n_bytes <= 40 AND regexp_matches(value, {q(fv.HEADER_NAME_PATTERN)}) THEN 'hardcoded_header_name'
       WHEN ent < 4.5 AND n_bytes <= 40 AND regexp_matches(value, {q(fv.SNAKE_CASE_PATTERN)}) THEN 'hardcoded_log_field'
       WHEN ent < 4.5 AND n_bytes <= 20 AND regexp_matches(value, {q(fv.JSON_KEY_PATTERN)}) THEN 'hardcoded_json_key' END AS shape,
  (n_bytes >= 32 AND regexp_full_match(value, '[0-9a-fA-F]+'))
    OR (n_bytes >= 24 AND ent >= 4.0 AND regexp_full_match(value, '[A-Za-z0-9+/=_-]+')) AS encoded,
  regexp_matches(path, {q(fv.CONSTANTS_FILE_PATTERN)}) AS constants
FROM tiered WHERE tier IS NOT NULL"""
R06_STEPS = (("keyed", KEYED), ("tiered", TIERED), ("shaped", SHAPED))
R06_SEVERITY = (
    "CASE WHEN shape IS NOT NULL THEN 'INFO' WHEN encoded THEN 'CRITICAL' "
    "WHEN constants AND ctx = 'CRITICAL' THEN 'HIGH' ELSE ctx END"
)
R06_HINT = "CASE WHEN shape IS NOT NULL THEN shape WHEN NOT encoded AND constants THEN 'crypto_key_constants_file' ELSE '' END"
R06 = f"""
SELECT {found("'CRYPTO-HARDCODED-KEY'", R06_SEVERITY, "'6.2.4'", "record_id", "path", "line_no", "key", "'8.6.2'", ctx_dev('path', 'value'), R06_HINT)}
FROM shaped"""
add("r06_scan_hardcoded_keys", R06, *R06_STEPS)

HELPER = seg_any("path", fv.TEST_HELPER_SEGMENTS)
PWD_BASE = f"(CASE WHEN {password_placeholder('value')} THEN 'INFO' ELSE 'CRITICAL' END)"
R07 = f"""
SELECT {found("'AUTH-HARDCODED-PWD'", f"CASE WHEN {HELPER} THEN 'INFO' ELSE {ctx_severity('path', 'value', PWD_BASE)} END", "'8.6.2'", "record_id", "path", "line_no", "key", "'8.3.1'", ctx_dev('path', 'value'), f"CASE WHEN {HELPER} THEN 'downgrade:testutil_exclusion' ELSE '' END")}
FROM v_kv WHERE {boundary(last('key'), fv.PASSWORD_WORDS)}"""
add("r07_scan_hardcoded_passwords", R07)

R08 = rf"""
SELECT {found("'CRYPTO-PLAIN-HTTP'", "'CRITICAL'", "'4.2.1'", "page_id", "url", "0", r"regexp_extract(url, 'http://[^\s" + '"' + r"/?#]+')")}
FROM pages WHERE regexp_matches(url, 'http://[^\s"]') AND NOT regexp_matches(url, {q(fv.LOCAL_HTTP_PATTERN)})"""
add("r08_scan_plain_http", R08)

CODE = f"SELECT record_id, line_no, replace(regexp_replace(line, {q(fv.NOT_CODE)}, ' ', 'g'), '(', '( ') AS line FROM v_lines"
CALLS = r"""
SELECT record_id, line_no,
       lower(unnest(regexp_extract_all(line, '(?i)(?:^|[^A-Za-z0-9_])(md5|sha1|des|sha256)(?:\.[A-Za-z0-9]+)?[ \t]*\(', 1))) AS algo
FROM code"""
R09 = f"""
SELECT {found("'CRYPTO-WEAK-HASH'", "CASE WHEN near THEN 'CRITICAL' ELSE 'INFO' END", "'6.2.4'", "record_id", EMPTY, "line_no", "algo")}
FROM (SELECT c.record_id, c.line_no, c.algo, EXISTS (
        SELECT 1 FROM code l WHERE l.record_id = c.record_id AND l.line_no BETWEEN c.line_no - 5 AND c.line_no + 5
          AND ((c.algo <> 'sha256' AND {has_any('lower(l.line)', fv.HASH_CONTEXT_WORDS)})
               OR (c.algo = 'sha256' AND {has_any('lower(l.line)', fv.SHA256_CONTEXT_WORDS)}))) AS near
      FROM calls c WHERE c.algo <> '')
WHERE near OR algo <> 'sha256'"""
add("r09_scan_weak_hash", R09, ("code", CODE), ("calls", CALLS))

PAY = "CASE WHEN is_payment THEN '-PAYMENT' ELSE '' END"
PAY_SEV = "CASE WHEN is_payment THEN 'CRITICAL' ELSE 'HIGH' END"
R10 = f"""
SELECT {found(f"'SRI-MISSING' || {PAY}", PAY_SEV, "'6.4.3'", "t.page_id", "t.url", "line_no", "src")}
FROM tags t JOIN forms f ON f.page_id = t.page_id WHERE src <> '' AND NOT has_integrity
UNION ALL SELECT {found(f"'NONCE-MISSING' || {PAY}", PAY_SEV, "'6.4.3'", "t.page_id", "t.url", "line_no")}
FROM tags t JOIN forms f ON f.page_id = t.page_id WHERE src = '' AND NOT has_nonce
UNION ALL SELECT {found("'FIM-REQUIRED'", "'MEDIUM'", "'11.6.1'", "page_id", "url", "1")} FROM forms WHERE is_payment"""
add("r10_scan_scripts", R10, *PAGE_STEPS)
META_FLAGS = csp_flags("csp")
META_UNSAFE = f"({META_FLAGS['has_unsafe_inline']} OR {META_FLAGS['has_unsafe_eval']})"
R11 = f"""
SELECT {found(f"CASE WHEN {META_UNSAFE} THEN 'META-CSP-UNSAFE' ELSE 'META-CSP-ONLY' END", f"CASE WHEN {META_UNSAFE} THEN 'HIGH' ELSE 'MEDIUM' END", "'6.4.3'", "page_id", "url")}
FROM metas"""
add("r11_scan_meta_csp", R11, *PAGE_STEPS)

CSP_JUDGED = (
    "SELECT *, "
    + ", ".join(f"{text} AS {name}" for name, text in csp_flags("policy").items())
    + " FROM (SELECT *, CASE WHEN contains(csp, '{{') THEN NULL ELSE csp END AS policy FROM v_csp WHERE response_type <> 'json')"
)
CALLBACK = f"({seg_any('url', fv.CALLBACK_SEGMENTS)} OR ends_with(lower(url), 'callback'))"


def csp_arm(rule: str, severity: str, condition: str) -> str:
    return f"SELECT {found(q(rule), severity, q('6.4.3'), 'page_id', 'url')} FROM judged WHERE {condition}"


R12 = " UNION ALL ".join(
    [
        csp_arm(
            "CSP-MISSING",
            "CASE WHEN response_type = 'html' THEN 'HIGH' ELSE 'INFO' END",
            f"csp IS NULL AND (response_type = 'html' OR NOT {CALLBACK})",
        ),
        csp_arm("CSP-VALUE-UNANALYZABLE", "'INFO'", "contains(csp, '{{')"),
        csp_arm("CSP-UNSAFE-INLINE", "'HIGH'", "has_unsafe_inline"),
        csp_arm("CSP-UNSAFE-EVAL", "'HIGH'", "has_unsafe_eval"),
        csp_arm("CSP-NO-SCRIPT-SRC", "'HIGH'", "no_script_restriction"),
        csp_arm(
            "CSP-OK",
            "'INFO'",
            "policy IS NOT NULL AND NOT has_unsafe_inline AND NOT has_unsafe_eval AND NOT no_script_restriction",
        ),
    ]
)
add("r12_scan_csp_headers", R12, ("judged", CSP_JUDGED))


def tls_arm(rule: str, severity: str, source: str, condition: str, subject: str = EMPTY, related: str = EMPTY) -> str:
    columns = found(q(rule), q(severity), "'4.2.1'", "svc_id", EMPTY, "0", subject, related)
    return f"SELECT {columns} FROM {source} WHERE {condition}"


R13 = " UNION ALL ".join(
    [
        tls_arm("TLS-INSECURE-SKIP-VERIFY", "CRITICAL", "v_tls", "skip_verify", EMPTY, "'4.2.1.1,2.2.7'"),
        tls_arm(
            "TLS-WEAK-VERSION", "CRITICAL", "v_tls", f"min_version IN {inlist(fv.WEAK_TLS_VERSIONS)}", "min_version"
        ),
        tls_arm("TLS-MISSING-MIN-VERSION", "HIGH", "v_tls", "min_version IS NULL"),
        tls_arm(
            "TLS-WEAK-CIPHER",
            "CRITICAL",
            "(SELECT svc_id, unnest(string_split(ciphers, ',')) AS c FROM v_tls)",
            BAD_CIPHER,
            "c",
        ),
    ]
)
add("r13_scan_tls_settings", R13)
R14 = f"""
SELECT {found("'AUTH-WEAK-POLICY'", "'CRITICAL'", "'8.3.6'", "svc_id", EMPTY, "0", "CAST(min_password_len AS VARCHAR)")}
FROM v_tls WHERE min_password_len < 12
UNION ALL SELECT {found("'AUTH-BYTE-COUNT'", "'MEDIUM'", "'8.3.6'", "svc_id")}
FROM v_tls WHERE min_password_len < 12 AND len_unit = 'bytes'"""
add("r14_scan_password_policy", R14)

PAN_LIKE = f"({sensitive('column_name')} OR {norm('column_name')} IN {inlist(fv.ACCOUNT_LIKE_COLUMNS)})"
CARD_TABLE = has_any(norm("c.table_name"), fv.CARD_TABLE_WORDS)
COL_NORM = norm("c.column_name")
SCHEMA_HITS = f"""
SELECT c.*, {kind('c.column_name')} AS k
FROM v_all_cols c LEFT JOIN (
  SELECT table_name, lower(sql_type) = 'bytea' AS protected
  FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS rn FROM v_all_cols WHERE {PAN_LIKE})
  WHERE rn = 1) t ON t.table_name = c.table_name
WHERE ({sensitive('c.column_name')} OR ({CARD_TABLE} AND ({COL_NORM} IN {inlist(fv.CARD_CONTEXT_COLUMNS)}
        OR (NOT coalesce(protected, true) AND {COL_NORM} IN {inlist(fv.EXPIRY_CONTEXT_COLUMNS)}))))
  AND NOT (lower(c.column_name) IN {inlist(fv.EXPIRY_COLUMNS)} AND coalesce(protected, true))"""
COL_SUBJECT = "table_name || '.' || column_name"
R15 = f"""
SELECT {found("'SQL-SENSITIVE-COLUMN'", "'HIGH'", "CASE WHEN k = 'PAN' THEN '3.5.1' ELSE '3.3.1' END", "table_name", "table_name", "ordinal", COL_SUBJECT)}
FROM schema_hits
UNION ALL SELECT {found("'SQL-TEXT-TYPE'", "'MEDIUM'", "'3.5.1'", "table_name", "table_name", "ordinal", COL_SUBJECT)}
FROM schema_hits WHERE {plaintext('sql_type')}"""
add("r15_scan_schema_columns", R15, ("schema_hits", SCHEMA_HITS))

RET_BASE = base("lower(path)")
RET_KV = f"""
SELECT path, line_no, key, array_to_string(list_slice(string_split(key, '.'), 1, greatest(len(string_split(key, '.')) - 1, 1)), '.') AS parent
FROM v_kv WHERE {RET_BASE} NOT IN {inlist(fv.SKIPPED_CONFIG_FILES)} AND NOT {has_any(RET_BASE, fv.SKIPPED_CONFIG_WORDS)}
  AND NOT {has_any('lower(path)', fv.SKIPPED_CONFIG_DIRS)}"""
RET_SKIP = f"""
SELECT path FROM (SELECT path, lower(unnest(string_split(key, '.'))) AS s, lower(string_split(key, '.')[1]) AS root FROM ret_kv)
GROUP BY path HAVING bool_or(root IN {inlist(fv.SCHEMA_DOC_ROOTS)}) OR count(DISTINCT CASE WHEN s IN {inlist(fv.FLAG_FILE_WORDS)} THEN s END) >= 2"""
RET_DEV = (
    "len(list_filter(list_slice(string_split(lower(path), '/'), 1, -2), lambda d: list_has_any("
    f"string_split_regex(d, '[_-]'), {arr(fv.DEV_CONFIG_WORDS)}))) > 0"
)
R16 = f"""
SELECT {found("'RET-CONFIG-NO-TTL'", f"CASE WHEN {RET_DEV} THEN 'INFO' ELSE 'HIGH' END", "'3.2.1'", "path", "path", "min(line_no)", "parent", EMPTY, "false", f"CASE WHEN {RET_DEV} THEN 'downgrade:dev_path_skipped' ELSE '' END")}
FROM ret_kv WHERE path NOT IN (SELECT path FROM ret_skip) AND {has_any('lower(parent)', fv.RETENTION_KEYS)}
GROUP BY path, parent HAVING NOT bool_or({has_any(f'lower({last("key")})', fv.TTL_KEYS)})"""
R16_STEPS = (("ret_kv", RET_KV), ("ret_skip", RET_SKIP))
add("r16_scan_retention_groups", R16, *R16_STEPS)
add("r16_scan_retention_json", R16.replace("min(line_no)", "0"), *R16_STEPS)


def tier_sql(source: str, group: str) -> str:
    first = has_any("lower(name)", fv.TIER_1_WORDS)
    return f"""
SELECT *, CASE WHEN {first} THEN 1 WHEN {has_any('lower(name)', fv.TIER_2_WORDS)} THEN 2
               WHEN {has_any('lower(name)', fv.TIER_3_WORDS)} AND bool_or({first}) OVER (PARTITION BY {group}) THEN 3
               ELSE 0 END AS tier FROM {source}"""


R17_RULE = "CASE WHEN s THEN 'AUDIT-LOG-OK' WHEN u THEN 'AUDIT-UNSTRUCTURED' ELSE 'AUDIT-NO-LOG' END"
R17_SEV = "CASE WHEN s THEN 'INFO' WHEN tier = 1 THEN 'CRITICAL' WHEN tier = 2 THEN 'HIGH' ELSE 'MEDIUM' END"
R17 = f"""
SELECT {found(R17_RULE, R17_SEV, "'10.2.1'", "record_id", EMPTY, "0", "name")}{{extra}}
FROM (SELECT t.*, EXISTS (SELECT 1 FROM v_audit_mix a WHERE a.user_id = t.user_id AND a.structured) AS s,
             EXISTS (SELECT 1 FROM v_audit_mix a WHERE a.user_id = t.user_id AND NOT a.structured) AS u
      FROM tiers t WHERE tier > 0)"""
R17_STEPS = (("tiers", tier_sql("v_ops", "user_id")),)
add("r17_audit_trail_coverage", R17.format(extra=", tier"), *R17_STEPS)

FIELD_NORM = "lower(replace(replace(replace(f, '_', ''), '-', ''), '.', ''))"
COVER = "SELECT CAST(event_id AS VARCHAR) AS record_id, body_sourced, " + ", ".join(
    (f"list_concat(CASE WHEN body_sourced THEN ['auto'] ELSE [] END, m_{c})" if c == "timestamp" else f"m_{c}") + f" AS {c}"
    for c, _ in fv.AUDIT_FIELD_CATEGORIES
) + " FROM (SELECT event_id, body_sourced, " + ", ".join(
    f"list_filter(string_split(fields, ','), lambda f: {has_any(FIELD_NORM, aliases)}) AS m_{c}"
    for c, aliases in fv.AUDIT_FIELD_CATEGORIES
) + " FROM v_log_fields)"
CATEGORIES = [c for c, _ in fv.AUDIT_FIELD_CATEGORIES]
SCORE = "(" + " + ".join(f"CAST(len({c}) > 0 AS INTEGER)" for c in CATEGORIES) + ")"
MATCHED = "array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN len({c}) > 0 THEN '{c}=' || array_to_string({c}, '+') END" for c in CATEGORIES
) + "], lambda x: x IS NOT NULL)), ';')"
MISSING = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN len({c}) = 0 THEN '{c}' END" for c in CATEGORIES
) + "], lambda x: x IS NOT NULL), ',')"
add(
    "r18_audit_field_coverage",
    f"""
SELECT record_id, {SCORE} AS score, CASE WHEN {SCORE} >= 3 THEN 'INFO' WHEN {SCORE} >= 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
       {MATCHED} AS matched, {MISSING} AS missing FROM cover""",
    ("cover", COVER),
)
SCORED = f"CASE WHEN {SCORE} >= 3 THEN 'INFO' WHEN {SCORE} >= 1 THEN 'MEDIUM' ELSE 'HIGH' END"
AUDIT_FIELDS = f"SELECT {found(q('AUDIT-FIELDS'), SCORED, q('10.2.1'), 'record_id', EMPTY, '0', MISSING)} FROM cover WHERE {MISSING} <> ''"


def log_fields_sql(source: str) -> str:
    severity = f"CASE WHEN {field_class('field')} IN ('PAN', 'SECRET') OR body_sourced THEN 'HIGH' ELSE 'MEDIUM' END"
    related = f"CASE {field_class('field')} WHEN 'PAN' THEN '3.3.1,3.5.1' WHEN 'SECRET' THEN '8.6.2' ELSE '' END"
    columns = found("'HTTP-INPUT-LOG'", severity, "'10.2.1'", "record_id", EMPTY, "0", "field", related)
    return f"""
SELECT {columns} FROM {source}
WHERE lower(field) NOT IN {inlist(fv.SAFE_LOG_FIELDS)} AND {field_class('field')} <> 'GENERIC_ID'"""


R19 = log_fields_sql("logged")
add("r19_scan_log_fields", R19, ("logged", LOGGED))

SIGNALS = [
    ("name", 2, has_any("lower(name)", fv.PAYMENT_NAME_WORDS)),
    ("path", 2, f"({has_any('lower(dir)', fv.PAYMENT_DIR_SEGMENTS)})"),
    ("sdk", 3, has_any("lower(import_path)", fv.PAYMENT_SDK_WORDS)),
    ("chd-param", 2, has_any("lower(type_name)", fv.CARD_TYPE_WORDS)),
    ("chd-field", 2, has_any("lower(field_name)", fv.CARD_FIELD_WORDS)),
    ("internal-import", 2, has_any("lower(import_path)", fv.PAYMENT_DIR_SEGMENTS)),
]
PAY_SCORE = "(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for _, w, c in SIGNALS) + ")"
PAY_SIGNALS = (
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in SIGNALS)
    + "], lambda x: x IS NOT NULL), ',')"
)
add(
    "r20_payment_context_score",
    f"SELECT entity_id, {PAY_SCORE} AS score, {PAY_SCORE} >= 2 AS in_scope, {PAY_SIGNALS} AS signals FROM v_entities",
)
add(
    "r21_payment_tier",
    "SELECT entity_id, tier FROM wide UNION ALL SELECT entity_id, tier + 10 FROM pairs",
    ("wide", tier_sql("v_entities", "grp")),
    ("pairs", tier_sql("v_entity_pairs", "grp")),
)
LICENCE = "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN {q(n)}" for n, p in fv.LICENCE_MARKERS) + " END"
LICENSED = f"SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS record_id, doc_id, {LICENCE} AS licence FROM documents"
add(
    "r22_license_inventory",
    "SELECT record_id, licence FROM licensed WHERE licence IS NOT NULL",
    ("licensed", LICENSED),
)
add(
    "r22_license_counts",
    "SELECT coalesce(licence, 'unknown') AS licence, count(*) AS n_units FROM licensed GROUP BY 1",
    ("licensed", LICENSED),
)

SHINGLED = """
SELECT record_id, len(w) AS n_words, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
FROM (SELECT 'documents/' || CAST(doc_id AS VARCHAR) || ':' || i AS record_id, regexp_extract_all(lower(ls[i]), '[a-z0-9]+') AS w
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))"""
KNOWN = """
SELECT licence, unnest(range(1, len(w) - 3)) AS q, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
FROM (SELECT 'L' || CAST(item_id AS VARCHAR) AS licence, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)"""
add(
    "r22_license_coverage",
    """
SELECT record_id, licence, n_words, n_covered, span
FROM (SELECT record_id, any_value(n_words) AS n_words, count(DISTINCT pos) AS n_covered
      FROM (SELECT record_id, n_words, unnest(range(p, p + 5)) AS pos FROM matched) GROUP BY record_id)
JOIN (SELECT record_id, licence, span FROM runs QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY span DESC, licence) = 1) USING (record_id)
WHERE 100 * n_covered >= 75 * n_words""",
    ("shingled", SHINGLED),
    ("known", KNOWN),
    ("matched", "SELECT DISTINCT record_id, n_words, licence, p, p - q AS diagonal FROM shingled JOIN known USING (shingle)"),
    ("runs", """
SELECT record_id, licence, count(*) + 4 AS span
FROM (SELECT *, p - row_number() OVER (PARTITION BY record_id, licence, diagonal ORDER BY p) AS island FROM matched) GROUP BY record_id, licence, diagonal, island"""),
)

# ---- joins and graph ----------------------------------------------------------


def version_list(v: str) -> str:
    return f"list_transform(string_split(replace({v}, 'v', ''), '.'), lambda p: CAST(p AS INTEGER))"


MATCH = f"""
SELECT d.module, d.version, a.adv_id, a.package, d.ord, d.indirect
FROM v_deps d JOIN v_advisories a ON a.package = d.module OR starts_with(a.package, d.module || '/')
WHERE (a.introduced = '0' OR {version_list('d.version')} >= {version_list("CASE WHEN a.introduced = '0' THEN '0.0.0' ELSE a.introduced END")})
  AND NOT (a.fixed IS NOT NULL AND {version_list('d.version')} >= {version_list("coalesce(a.fixed, '0.0.0')")})"""
add(
    "j01_match_advisories",
    """
SELECT module, version, adv_id, min(package) AS package, count(*) AS n_deps, min(ord) AS first_ord
FROM match GROUP BY module, version, adv_id""",
    ("match", MATCH),
)


def component_steps(source: str, prefix: str) -> tuple[tuple[str, str], ...]:
    """Transitive closure over shared ids; `source` has (adv_id, alias)."""
    return (
        (f"{prefix}tok", f"SELECT adv_id, adv_id AS t FROM {source} UNION SELECT adv_id, alias FROM {source}"),
        (f"{prefix}link", f"SELECT DISTINCT a.adv_id AS x, b.adv_id AS y FROM {prefix}tok a JOIN {prefix}tok b ON a.t = b.t"),
        (
            f"{prefix}reach",
            f"SELECT x, y FROM {prefix}link UNION SELECT r.x, l.y FROM {prefix}reach r JOIN {prefix}link l ON l.x = r.y",
        ),
        (f"{prefix}grp", f"SELECT x AS adv_id, min(y) AS group_id FROM {prefix}reach GROUP BY x"),
        (
            f"{prefix}best",
            f"""
SELECT adv_id, group_id, first_value(adv_id) OVER (PARTITION BY group_id ORDER BY
         CASE WHEN coalesce(db_severity, '') <> '' THEN 0 ELSE 1 END, CASE WHEN starts_with(adv_id, 'GHSA-') THEN 0 ELSE 1 END, adv_id) AS best_id
FROM (SELECT g.*, a.db_severity FROM {prefix}grp g JOIN v_advisories a ON a.adv_id = g.adv_id)""",
        ),
    )


J02 = f"""
SELECT 'DEP-VULN' AS rule_id, {adv_severity('db_severity', 'cvss')} AS severity, '6.3.3' AS requirement_id, module, version,
       adv_id, group_id, ord AS first_ord,
       CASE WHEN package = module AND fixed IS NOT NULL THEN 'v' || fixed ELSE '' END AS fix_version,
       CASE WHEN package = module THEN '>=' || CASE introduced WHEN '0' THEN 'v0.0.0' ELSE 'v' || introduced END
              || coalesce(', <v' || fixed, '') ELSE '' END AS affected_range
FROM (SELECT d.*, b.group_id, a.db_severity, a.cvss, a.introduced, a.fixed,
             row_number() OVER (PARTITION BY b.group_id ORDER BY d.ord, d.module, d.version, d.package) AS rn
      FROM direct d JOIN gbest b ON b.best_id = d.adv_id AND b.adv_id = d.adv_id
      JOIN v_advisories a ON a.adv_id = d.adv_id)
WHERE rn = 1"""
J02_STEPS = (
    ("match", MATCH),
    ("direct", "SELECT * FROM match WHERE NOT indirect"),
    ("hit", "SELECT adv_id, alias FROM v_advisories WHERE adv_id IN (SELECT adv_id FROM direct)"),
    *component_steps("hit", "g"),
)
add("j02_scan_dependencies", J02, *J02_STEPS, recursive=True)
add(
    "j03_enrich_requirements",
    """
SELECT f.ord, f.rule_id, f.requirement_id, coalesce((SELECT title FROM v_requirements r WHERE r.requirement_id = f.requirement_id), '')
         AS requirement_title FROM v_findings_bulk f""",
)
add(
    "j03_explain_requirements",
    """
SELECT a.requirement_id, coalesce(r.title, '') AS title,
       CASE WHEN r.title IS NULL THEN 'unknown requirement ' || a.requirement_id ELSE '' END AS error
FROM (SELECT DISTINCT requirement_id FROM v_findings_bulk
      UNION SELECT DISTINCT requirement_id || '.99' FROM v_findings_bulk) a
LEFT JOIN v_requirements r ON r.requirement_id = a.requirement_id""",
)
SUPPRESSED = """
SELECT *, coalesce(rule <> '', false) AS suppressed,
       CASE rule WHEN '' THEN '' ELSE 'pattern ' || rule END AS reason,
       CASE rule WHEN '' THEN '' WHEN 'testdata/**' THEN 'ignore-file:1' WHEN 'config/prod/f5.yaml' THEN 'ignore-file:2'
            ELSE 'ignore-file:3' END AS source
FROM (SELECT *, CASE WHEN starts_with(path, 'testdata/') THEN 'testdata/**'
                     WHEN path = 'config/prod/f5.yaml' AND line_no = 7 THEN 'config/prod/f5.yaml'
                     WHEN ends_with(path, '.html') THEN '**/*.html' ELSE '' END AS rule FROM v_findings_bulk)"""
J04 = "SELECT ord, rule_id, path, line_no, suppressed, reason, source FROM supp"
add("j04_apply_suppressions", J04, ("supp", SUPPRESSED))
add("j04_apply_suppressions_table", J04, ("supp", SUPPRESSED))
INLINED = """
SELECT s.ord, s.rule_id, s.requirement_id, s.severity, s.related, s.path, s.line_no, s.suppressed OR inl AS suppressed,
       CASE WHEN inl THEN 'reviewed' ELSE s.reason END AS reason, CASE WHEN inl THEN 'inline comment' ELSE s.source END AS source
FROM (SELECT s.*, NOT s.suppressed AND ends_with(s.path, '.yaml') AND EXISTS (
        SELECT 1 FROM v_lines l WHERE l.record_id = s.record_id AND l.line_no = s.line_no
          AND contains(l.line, '# pci-ignore:')) AS inl FROM supp s) s"""
add(
    "j05_inline_suppressions",
    "SELECT ord, rule_id, path, line_no, suppressed, reason, source FROM inlined",
    ("supp", SUPPRESSED),
    ("inlined", INLINED),
)
add(
    "j06_exclude_packages",
    """
SELECT rule_id, severity, path, count(*) AS n FROM v_findings_bulk WHERE NOT starts_with(path, 'internal/card/') GROUP BY ALL
UNION ALL SELECT 'SUPPRESSED-PACKAGE', 'INFO', 'internal/card/**', count(*) FROM v_findings_bulk
WHERE starts_with(path, 'internal/card/') HAVING count(*) > 0""",
)
J07_ENC = "EXISTS (SELECT 1 FROM v_encryption e WHERE e.table_name = h.table_name AND e.column_name = h.column_name)"
J07_DROP = (
    f"lower(h.column_name) IN {inlist(fv.EXPIRY_COLUMNS)} AND EXISTS (SELECT 1 FROM v_encryption e "
    f"WHERE e.table_name = h.table_name AND ({sensitive('e.column_name')} OR {norm('e.column_name')} IN {inlist(fv.ACCOUNT_LIKE_COLUMNS)}))"
)
J07_HINT = "CASE WHEN enc THEN 'encrypted by the application' ELSE '' END"
J07 = f"""
SELECT {found("'SQL-SENSITIVE-COLUMN'", "CASE WHEN enc THEN 'INFO' ELSE 'HIGH' END", "CASE WHEN k = 'PAN' THEN '3.5.1' ELSE '3.3.1' END", "table_name", "table_name", "ordinal", COL_SUBJECT, EMPTY, "false", J07_HINT)}
FROM marked WHERE NOT dropped
UNION ALL SELECT {found("'SQL-TEXT-TYPE'", "CASE WHEN enc THEN 'INFO' ELSE 'MEDIUM' END", "'3.5.1'", "table_name", "table_name", "ordinal", COL_SUBJECT, EMPTY, "false", J07_HINT)}
FROM marked WHERE {plaintext('sql_type')}"""
add(
    "j07_encryption_crossref",
    J07,
    ("schema_hits", SCHEMA_HITS),
    ("marked", f"SELECT h.*, {J07_ENC} AS enc, {J07_DROP} AS dropped FROM schema_hits h"),
)
WALK = """
SELECT src AS source, src AS node, 0 AS hops FROM (SELECT DISTINCT src FROM v_edges)
UNION SELECT w.source, e.dst, w.hops + 1 FROM walk w JOIN v_edges e ON e.src = w.node WHERE w.hops < 5"""
FLOW = """
SELECT w.source, bool_or(s.node IS NOT NULL) AS reaches, CAST(min(CASE WHEN s.node IS NOT NULL THEN w.hops END) AS INTEGER) AS hops
FROM walk w LEFT JOIN v_sinks s ON s.node = w.node GROUP BY w.source"""
add("j08_flow_reaches", "SELECT * FROM flow", ("walk", WALK), ("flow", FLOW), recursive=True)
MARKER = has_any("lower(path)", fv.TRANSIT_PATH_MARKERS)
J09_TAGGED = f"""
SELECT *, NOT stored AND NOT has_db_tag AND (has_json_tag OR subject IN {inlist(fv.SAD_FIELD_NAMES)} OR {MARKER}) AS transit
FROM (SELECT f.*, f.node IN (SELECT source FROM flow WHERE reaches) AS stored FROM v_field_findings f)"""
add(
    "j09_transit_downgrade",
    """
SELECT ord, rule_id, CASE WHEN transit THEN 'INFO' ELSE severity END AS severity,
       CASE WHEN stored OR transit THEN 'high' ELSE '' END AS confidence,
       CASE WHEN stored THEN 'stored' WHEN transit THEN 'transit only' ELSE '' END AS flow_note
FROM fields WHERE NOT (transit AND rule_id = 'PAN-TYPE')""",
    ("walk", WALK),
    ("flow", FLOW),
    (
        "fields",
        J09_TAGGED,
    ),
    recursive=True,
)
add(
    "j10_snippets",
    """
SELECT p.record_id, p.line_no, coalesce(concat_ws(chr(10), b2.line, b1.line), '') AS before, l.line AS line,
       coalesce(concat_ws(chr(10), a1.line, a2.line), '') AS after
FROM (SELECT DISTINCT record_id, line_no FROM v_findings_bulk) p
JOIN v_lines l ON l.record_id = p.record_id AND l.line_no = p.line_no
LEFT JOIN v_lines b2 ON b2.record_id = p.record_id AND b2.line_no = p.line_no - 2
LEFT JOIN v_lines b1 ON b1.record_id = p.record_id AND b1.line_no = p.line_no - 1
LEFT JOIN v_lines a1 ON a1.record_id = p.record_id AND a1.line_no = p.line_no + 1
LEFT JOIN v_lines a2 ON a2.record_id = p.record_id AND a2.line_no = p.line_no + 2""",
)
add(
    "j11_diff_findings",
    """
SELECT CASE WHEN hit THEN 'matched' ELSE 'missing' END AS outcome, rule_id, severity, path, line_no
FROM (SELECT *, EXISTS (SELECT 1 FROM h WHERE h.rule_id = w.rule_id AND h.severity = w.severity AND h.path = w.path
                          AND (w.line_no = 0 OR abs(h.line_no - w.line_no) <= 2)) AS hit FROM w)
UNION ALL SELECT 'unexpected', rule_id, severity, path, line_no FROM h
WHERE NOT EXISTS (SELECT 1 FROM w WHERE h.rule_id = w.rule_id AND h.severity = w.severity AND h.path = w.path)""",
    ("w", "SELECT DISTINCT rule_id, severity, path, line_no FROM v_expected"),
    ("h", "SELECT DISTINCT rule_id, severity, path, line_no FROM v_actual"),
)
CANONICAL = ", ".join(f"({q(r)}, {q(i)})" for r, i in fv.RULE_REQUIREMENTS)
add(
    "j12_mapping_drift",
    f"""
SELECT rule_id, req AS requirement_id, count(*) AS n_findings
FROM (SELECT rule_id, CASE WHEN rule_id = 'SQL-TEXT-TYPE' AND severity = 'HIGH' THEN '3.3.1' ELSE requirement_id END AS req
      FROM v_findings_bulk)
WHERE (rule_id, req) NOT IN (VALUES {CANONICAL}) GROUP BY 1, 2""",
)
HINT = "CASE " + " ".join(f"WHEN starts_with(rule_id, {q(p)}) THEN {q(t)}" for p, t in fv.HINT_PREFIXES) + f" ELSE {q(fv.DEFAULT_HINT)} END"
add("j13_add_hints", f"SELECT ord, rule_id, {HINT} AS hint FROM v_findings_bulk")

# ---- aggregations -------------------------------------------------------------

add(
    "a01_severity_counts",
    """
SELECT l.severity, count(f.rule_id) AS n
FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) AS l(severity)
LEFT JOIN v_findings_bulk f ON f.severity = l.severity GROUP BY l.severity""",
)
add(
    "a02_rule_histogram",
    """
SELECT rule_id, n, CAST(row_number() OVER (ORDER BY n DESC, rule_id) AS INTEGER) AS rank,
       greatest((SELECT count(DISTINCT rule_id) FROM v_findings_bulk) - 5, 0) AS more_rules
FROM (SELECT rule_id, count(*) AS n FROM v_findings_bulk GROUP BY rule_id) QUALIFY rank <= 5""",
)
add(
    "a03_findings_by_rule",
    """
SELECT rule_id, severity, requirement_id, n, ord AS first_ord
FROM (SELECT *, count(*) OVER (PARTITION BY rule_id) AS n, row_number() OVER (PARTITION BY rule_id ORDER BY ord) AS rn FROM v_findings_bulk)
WHERE rn = 1""",
)
add(
    "a04_scan_summary",
    """
SELECT 'findings' AS metric, 'all' AS name, count(*) AS n FROM v_findings_bulk
UNION ALL SELECT 'severity', severity, count(*) FROM v_findings_bulk GROUP BY severity
UNION ALL SELECT 'scanner', lower(string_split(rule_id, '-')[1]), count(*) FROM v_findings_bulk GROUP BY 2
UNION ALL SELECT 'scanned', 'units', count(*) FROM units
UNION ALL SELECT 'scanned', 'lines', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM units""",
    ("units", UNITS),
)
STATUS = """
SELECT r.requirement_id, r.title,
       CASE WHEN NOT covered THEN 'NOT_CHECKED' WHEN coalesce(act, 0) > 0 THEN 'FAIL'
            WHEN coalesce(active, 0) = 0 AND coalesce(supp, 0) > 0 THEN 'SUPPRESSED' ELSE 'PASS' END AS status,
       CAST(CASE WHEN NOT covered THEN 0 WHEN coalesce(act, 0) > 0 THEN active
            WHEN coalesce(active, 0) = 0 AND coalesce(supp, 0) > 0 THEN supp ELSE 0 END AS BIGINT) AS finding_count
FROM v_requirements r LEFT JOIN (
  SELECT requirement_id, count(*) FILTER (NOT suppressed) AS active, count(*) FILTER (suppressed) AS supp,
         count(*) FILTER (NOT suppressed AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS act
  FROM {src} GROUP BY requirement_id) f ON f.requirement_id = r.requirement_id"""
PRIMARY = """
SELECT rel, arg_min(requirement_id, ord) AS primary_id
FROM (SELECT unnest(string_split(related, ',')) AS rel, requirement_id, ord FROM {src} WHERE NOT suppressed AND related <> '')
GROUP BY rel"""
PROPAGATED = """
SELECT s.requirement_id, s.title, CASE WHEN taken THEN p_status ELSE s.status END AS status, s.finding_count,
       CASE WHEN taken THEN 'same finding as ' || primary_id ELSE '' END AS cross_reference
FROM (SELECT s.*, p.primary_id, t.status AS p_status, s.status = 'NOT_CHECKED' AND t.status IS NOT NULL AS taken
      FROM status s LEFT JOIN prim p ON p.rel = s.requirement_id LEFT JOIN status t ON t.requirement_id = p.primary_id) s"""


def status_steps(src: str):
    return (("status", STATUS.format(src=src)), ("prim", PRIMARY.format(src=src)))


add("a05_requirement_status", "SELECT * FROM status", ("supp", SUPPRESSED), *status_steps("supp"))
add("a06_propagate_related", PROPAGATED, ("supp", SUPPRESSED), *status_steps("supp"))
add(
    "a07_not_checked",
    """
SELECT s.requirement_id, s.title,
       CASE WHEN r.covered_by IS NOT NULL THEN 'partly covered by ' || r.covered_by || ' ' || coalesce(
                   (SELECT title FROM v_requirements x WHERE x.requirement_id = r.covered_by), r.covered_by)
            WHEN r.reason IS NOT NULL THEN r.reason ELSE s.title || ' needs manual review' END AS explanation
FROM status s JOIN v_requirements r ON r.requirement_id = s.requirement_id WHERE s.status = 'NOT_CHECKED'""",
    ("supp", SUPPRESSED),
    *status_steps("supp"),
)
SUMMARY_ROWS = [
    ("total_requirements", "count(*) FROM status"),
    ("checked", "count(*) FROM status WHERE status <> 'NOT_CHECKED'"),
    *[(s.lower(), f"count(*) FROM status WHERE status = '{s}'") for s in ("PASS", "FAIL", "SUPPRESSED", "NOT_CHECKED")],
    *[(s.lower(), f"count(*) FROM supp WHERE NOT suppressed AND severity = '{s}'") for s in fv.SEVERITIES],
    (
        "gate_failed",
        "CAST(count(*) > 0 AS BIGINT) FROM supp WHERE NOT suppressed AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')",
    ),
]
add(
    "a08_report_summary",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, n FROM (SELECT {e.replace(' FROM', ' AS n FROM', 1)})" for m, e in SUMMARY_ROWS),
    ("supp", SUPPRESSED),
    *status_steps("supp"),
)
add(
    "a08_gate",
    """
SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS overall
FROM supp WHERE NOT suppressed AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')""",
    ("supp", SUPPRESSED),
)
ALL_GROUPS = component_steps("v_advisories", "g")
add("a09_alias_groups", "SELECT adv_id, group_id, best_id FROM gbest", *ALL_GROUPS, recursive=True)
add(
    "a09_group_aliases",
    "SELECT DISTINCT b.group_id, t.t AS alias FROM gbest b JOIN gtok t ON t.adv_id = b.adv_id WHERE t.t <> b.best_id",
    *ALL_GROUPS,
    recursive=True,
)
add(
    "a10_group_repeated",
    f"""
SELECT path, subject, 'PAN-TYPE' AS rule_id, arg_max(severity, {rank('severity')}) AS severity, count(*) AS n, min(ord) AS first_ord
FROM v_field_findings WHERE rule_id = 'PAN-TYPE' GROUP BY path, subject""",
)
add(
    "a10_repeated_members",
    "SELECT DISTINCT path, subject, function_name FROM v_field_findings WHERE rule_id = 'PAN-TYPE'",
)
add(
    "a11_category_rollup",
    """
SELECT string_split(requirement_id, '.')[1] AS category, count(*) AS n,
       count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS n_severe FROM v_findings_bulk GROUP BY 1""",
)
SBOM = """
SELECT l.project_id, l.module, l.version, 'pkg:golang/' || l.module || '@' || l.version AS purl,
       lower(hex(from_base64(substr(coalesce(max(hash) FILTER (NOT mod_only), max(hash) FILTER (mod_only)), 4)))) AS sha256,
       coalesce((SELECT arg_max(indirect, ord) FROM v_deps d WHERE d.project_id = l.project_id AND d.module = l.module
                  AND d.version = l.version), false) AS indirect
FROM lock l GROUP BY l.project_id, l.module, l.version"""
add("a12_sbom_inventory", "SELECT * FROM sbom", ("lock", LOCK), ("sbom", SBOM))
add(
    "a13_inventory_status",
    """
SELECT p.project_id, CASE WHEN count(s.module) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(s.module) AS component_count,
       count(s.module) FILTER (s.module NOT IN (SELECT 'example.org/m' || CAST(doc_id % 80 AS VARCHAR) FROM licensed WHERE licence IS NOT NULL))
         AS unknown_licences
FROM (SELECT DISTINCT s_suppkey AS project_id FROM supplier) p LEFT JOIN sbom s ON s.project_id = p.project_id
GROUP BY p.project_id""",
    ("lock", LOCK),
    ("sbom", SBOM),
    ("licensed", LICENSED),
)
add(
    "a14_snapshot_freshness",
    f"""
SELECT source, age_days, CASE WHEN age_days IS NULL THEN 'cold' WHEN age_days >= 15 THEN 'critical' WHEN age_days >= 7 THEN 'stale'
            ELSE 'fresh' END AS state, n_snapshots,
       CASE WHEN age_days IS NULL THEN 'DEP-CACHE-COLD' WHEN age_days >= 7 THEN 'DEP-CACHE-STALE' ELSE '' END AS rule_id
FROM (SELECT s.source, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(x.ts)))) / 86400) AS BIGINT) AS age_days, count(x.ts) AS n_snapshots
      FROM (SELECT CAST(c_custkey AS VARCHAR) AS source FROM customer UNION SELECT 'err' || CAST(c_custkey AS VARCHAR) FROM customer) s
      LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS source, ts FROM events
                 UNION ALL SELECT substr(event_type, 1, 3) || CAST(user_id AS VARCHAR), ts FROM events) x
      ON x.source = s.source AND x.ts <= TIMESTAMP '{AS_OF}' GROUP BY s.source)""",
)

# ---- order, ranks and pages ---------------------------------------------------

add(
    "w01_top_n_per_severity",
    """
SELECT severity, rule_id, path, ord, CAST(row_number() OVER (PARTITION BY severity ORDER BY rule_id, path, ord) AS INTEGER) AS rank
FROM v_findings_bulk QUALIFY rank <= 3""",
)
add(
    "w02_sort_by_severity",
    f"SELECT ord, severity, rule_id, 5 - ({rank('severity')}) AS sev_order FROM v_findings_bulk ORDER BY sev_order, ord",
)
add(
    "w03_paginate",
    f"""
SELECT CAST(rn AS BIGINT) AS row_no, CASE WHEN total > 3060 THEN CAST(3060 AS BIGINT) END AS next_offset, severity, ord, rule_id, path
FROM (SELECT *, row_number() OVER (ORDER BY 5 - ({rank('severity')}), ord, rule_id, path, line_no) AS rn, count(*) OVER () AS total
      FROM v_findings_bulk)
WHERE rn > 3000 AND rn <= 3060""",
)
ORACLE["w03_indexed_page"] = ORACLE["w03_paginate"]
add(
    "w04_dropped_column_downgrade",
    """
SELECT table_name, column_name, ord, CASE WHEN first_drop IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM v_schema_events a WHERE a.table_name = f.table_name AND a.column_name = f.column_name AND a.op = 'ADD'
           AND a.ord > f.first_drop) THEN 'INFO' ELSE 'HIGH' END AS severity
FROM (SELECT e.*, (SELECT min(d.ord) FROM v_schema_events d WHERE d.table_name = e.table_name AND d.column_name = e.column_name
                     AND d.op = 'DROP' AND d.ord > e.ord) AS first_drop FROM v_schema_events e WHERE e.op = 'ADD') f""",
)
W05 = f"""
SELECT f.ord, f.rule_id, CASE WHEN f.ord = p.f_ord AND {rank('p.t_sev')} > {rank('f.severity')} THEN p.t_sev ELSE f.severity END AS severity,
       f.path, f.kind
FROM v_field_findings f LEFT JOIN (
  SELECT * FROM (
    SELECT path, line_no, max(ord) FILTER (kind = 'field') AS f_ord, max(ord) FILTER (kind = 'tag') AS t_ord,
           arg_max(subject, ord) FILTER (kind = 'field') AS f_sub, arg_max(subject, ord) FILTER (kind = 'tag') AS t_sub,
           arg_max(severity, ord) FILTER (kind = 'tag') AS t_sev
    FROM v_field_findings WHERE rule_id = 'PAN-KEYWORD' GROUP BY path, line_no)
  WHERE {norm('f_sub')} = {norm('t_sub')}) p ON p.path = f.path AND p.line_no = f.line_no
WHERE p.t_ord IS NULL OR f.ord <> p.t_ord"""
add("w05_dedup_paired", W05)
# ---- sets of findings ---------------------------------------------------------

ALL_RULES = [R01, R02, R03, R04, R05, R06, R07, R08, R09, R10, R11, R12, R13, R14, R15, R16, R19]
ALL_RULES += [R17.format(extra=""), AUDIT_FIELDS, f"SELECT {found(q('DEP-VULN'), 'severity', q('6.3.3'))} FROM vulnerable"]
add(
    "s01_run_scans",
    """
SELECT rule_id, severity, requirement_id, count(*) AS n, count(*) FILTER (dev_context) AS n_dev
FROM everything GROUP BY rule_id, severity, requirement_id""",
    ("text_lines", TEXT_LINES),
    ("logged", LOGGED),
    *R06_STEPS,
    ("code", CODE),
    ("calls", CALLS),
    *PAGE_STEPS,
    ("judged", CSP_JUDGED),
    ("schema_hits", SCHEMA_HITS),
    *R16_STEPS,
    *R17_STEPS,
    ("cover", COVER),
    *J02_STEPS,
    ("vulnerable", J02),
    ("everything", " UNION ALL ".join(f"SELECT * FROM ({rule})" for rule in ALL_RULES)),
    recursive=True,
)
add(
    "x01_status_of_rules_that_ran",
    STATUS.format(src="ran").replace("SELECT r.requirement_id", "SELECT 'broken' AS failed, r.requirement_id").replace("FROM v_requirements r", "FROM checked r"),
    ("checked", "SELECT requirement_id, title, requirement_id IN ('3.3.1', '3.5.1', '4.2.1', '10.2.1') AS covered FROM v_requirements"),
    ("schema_hits", SCHEMA_HITS),
    *R17_STEPS,
    ("ran", "SELECT *, false AS suppressed FROM (" + " UNION ALL ".join(f"SELECT * FROM ({rule})" for rule in (R03, R08, R15, R17.format(extra=""))) + ")"),
)
add(
    "s02_filter_findings",
    """
SELECT ord, rule_id, severity, path FROM v_findings_bulk
WHERE severity IN ('CRITICAL', 'HIGH') AND rule_id IN ('PAN-LITERAL', 'SEC-PREFIX')
UNION ALL SELECT ord, rule_id, severity, path FROM v_findings_bulk WHERE rule_id LIKE 'CSP-%' OR rule_id LIKE 'NONCE-%'""",
)
add("s03_drop_verified_ok", "SELECT ord, rule_id, severity FROM v_findings_bulk WHERE rule_id NOT LIKE '%-OK'")
add(
    "s04_triage",
    f"""
SELECT f.ord, f.rule_id, {location('f.path')} AS file_location, CASE WHEN f.line_no > 10 THEN f.line_no - 10 ELSE 1 END AS start_line,
       f.line_no + 10 AS end_line, {MIME} AS mime_type, {HINT} AS hint, coalesce(l.line, '') AS line
FROM v_findings_bulk f LEFT JOIN v_lines l ON l.record_id = f.record_id AND l.line_no = f.line_no
WHERE f.rule_id NOT LIKE '%-OK'""",
)
STREAMED = "SELECT CAST(floor(epoch(time_bucket(INTERVAL '10 minutes', ts))) AS BIGINT) AS slot, " + ", ".join(f"{text} AS {name}" for name, text in STREAM_COLUMNS.items()) + ", 0 AS line_no FROM events"
SLOTTED = {
    "text_lines": "SELECT slot, record_id, path, 1 AS line_no, text AS line FROM told",
    "logged": "SELECT slot, record_id, path, body_sourced, unnest(string_split(fields, ',')) AS field FROM told",
}


PAN_RELATED = f"CASE WHEN {kind('field')} = 'PAN' THEN '3.4.1,10.2.1' ELSE '3.3.1.2' END"
INPUT_SEVERITY = f"CASE WHEN {field_class('field')} IN ('PAN', 'SECRET') OR body_sourced THEN 'HIGH' ELSE 'MEDIUM' END"
INPUT_RELATED = f"CASE {field_class('field')} WHEN 'PAN' THEN '3.3.1,3.5.1' WHEN 'SECRET' THEN '8.6.2' ELSE '' END"
PLAIN_HOST = r"regexp_extract(url, 'http://[^\s" + '"' + r"/?#]+')"
ST01_RULES = [
    f"""
SELECT slot, {found("'PAN-LITERAL'", f"CASE WHEN {BOUND} THEN 'CRITICAL' ELSE 'MEDIUM' END", "'3.4.1'", "record_id", "path", "line_no", f"{brand('t')} || ' *' || right(t, 4)")}
FROM (SELECT *, unnest(regexp_extract_all(line, '[0-9A-Za-z]+')) AS t FROM text_lines) WHERE {likely_pan('t')}""",
    f"""
SELECT slot, {found("'PAN-LOGGER'", "'CRITICAL'", f"CASE WHEN {kind('field')} = 'PAN' THEN '3.5.1' ELSE '3.3.1' END", "record_id", "path", "0", "field", PAN_RELATED)}
FROM logged WHERE {sensitive('field')}""",
    f"""
SELECT slot, {found("'HTTP-INPUT-LOG'", INPUT_SEVERITY, "'10.2.1'", "record_id", "path", "0", "field", INPUT_RELATED)}
FROM logged WHERE lower(field) NOT IN {inlist(fv.SAFE_LOG_FIELDS)} AND {field_class('field')} <> 'GENERIC_ID'""",
    f"""
SELECT slot, {found("'CRYPTO-PLAIN-HTTP'", "'CRITICAL'", "'4.2.1'", "record_id", "path", "0", PLAIN_HOST)}
FROM told WHERE regexp_matches(url, 'http://[^\\s"]') AND NOT regexp_matches(url, {q(fv.LOCAL_HTTP_PATTERN)})""",
    secrets_sql("told", "slot, "),
]
add(
    "st01_scan_stream",
    "SELECT DISTINCT * FROM (" + " UNION ALL ".join(ST01_RULES) + ")",
    ("told", STREAMED),
    *SLOTTED.items(),
)
add(
    "report_requirement_status",
    PROPAGATED,
    ("supp", SUPPRESSED),
    ("inlined", INLINED),
    ("scoped", "SELECT * FROM inlined WHERE NOT starts_with(path, 'internal/card/')"),
    *status_steps("scoped"),
)
POST_HINT = "CASE WHEN transit THEN 'transit only' WHEN stored THEN 'stored' ELSE '' END"
add(
    "report_post_processed",
    f"""
SELECT rule_id, severity, hint, count(*) AS n FROM flowed GROUP BY ALL
UNION ALL SELECT rule_id, severity, triage_hint, count(*) FROM ({J07}) GROUP BY ALL
UNION ALL SELECT 'PAN-TYPE', severity, 'merged', sum(n)::BIGINT FROM (
  SELECT arg_max(severity, {rank('severity')}) AS severity, count(*) AS n FROM flowed WHERE rule_id = 'PAN-TYPE' GROUP BY path, subject) GROUP BY severity""",
    ("walk", WALK),
    ("flow", FLOW),
    ("schema_hits", SCHEMA_HITS),
    ("marked", f"SELECT h.*, {J07_ENC} AS enc, {J07_DROP} AS dropped FROM schema_hits h"),
    ("paired", W05),
    ("tagged", J09_TAGGED.replace("FROM v_field_findings f", "FROM (SELECT f.* REPLACE (p.severity AS severity) FROM v_field_findings f JOIN paired p USING (ord)) f")),
    ("flowed", f"""
SELECT rule_id, CASE WHEN transit THEN 'INFO' ELSE severity END AS severity, path, subject, {POST_HINT} AS hint
FROM tagged WHERE NOT (transit AND rule_id = 'PAN-TYPE')"""),
    recursive=True,
)
