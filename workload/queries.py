"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions import cards, paths, policies, secrets, severity, text, versions, words
from sievelake.operators import (
    audit,
    context,
    crypto,
    dependencies,
    graph,
    inventory,
    licences,
    pages,
    paging,
    pairing,
    payment,
    requirements,
    retention,
    schema,
    summary,
    suppression,
    transport,
    triage,
)
from sievelake.operators import cards as card_scans
from sievelake.operators import secrets as secret_scans
from sievelake.plans.registry import DEFAULT_RULES, RuleSpec, run_scans, scan
from sievelake.plans.report import compliance_report
from sievelake.session import cut_lineage, scratch_path
from sievelake.sources import columns, keyvalues, packages, sinks, units
from sievelake.sources import pages as page_sources
from sievelake.streaming.scan_stream import scan_available
from workload.views import IGNORE_FILE, STREAM_COLUMNS, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

IGNORE_RULES, EXCLUDE_RULES = suppression.parse_ignore_lines(IGNORE_FILE)
SCOPE_EXTS = [".env", ".json", ".yaml", ".go"]
AS_OF = "2024-01-22 00:00:00"
#: Text that one task writes.
FILE_BYTES = 32 << 20


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def flat(df: DataFrame, *extra: str) -> DataFrame:
    """Findings without nested columns, defaults filled in, for row-by-row comparison."""

    def present(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    related = F.concat_ws(",", "related_requirements") if "related_requirements" in df.columns else F.lit("")
    return df.select(
        "rule_id",
        "severity",
        "requirement_id",
        present("record_id", F.lit("")).cast("string").alias("record_id"),
        present("path", F.lit("")).alias("path"),
        present("line_no", F.lit(0)).cast("int").alias("line_no"),
        present("subject", F.lit("")).alias("subject"),
        related.alias("related"),
        present("dev_context", F.lit(False)).alias("dev_context"),
        present("triage_hint", F.lit("")).alias("triage_hint"),
        *extra,
    )


# ---- inputs -------------------------------------------------------------------


def document_units(spark: SparkSession, sf: str) -> DataFrame:
    return units.table_units(table(spark, sf, "documents"), "documents", F.col("doc_id"), "text")


def page_units(spark: SparkSession, sf: str) -> DataFrame:
    return units.table_units(table(spark, sf, "pages"), "pages", F.col("page_id"), "html", F.col("url"))


def conversation_units(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", "conv_id", "turn")
    return units.table_units(table(spark, sf, "conversations"), "conversations", key, "text")


def all_units(spark: SparkSession, sf: str) -> DataFrame:
    return document_units(spark, sf).unionByName(page_units(spark, sf)).unionByName(conversation_units(spark, sf))


def kv(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_kv")


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    """The findings view in the shape the findings algebra reads."""
    return view(spark, sf, "v_findings_bulk").select(
        "ord",
        "rule_id",
        "severity",
        "requirement_id",
        "path",
        "line_no",
        "record_id",
        F.lower(F.substring_index("rule_id", "-", 1)).alias("scanner"),
        F.filter(F.split("related", ","), lambda r: r != "").alias("related_requirements"),
    )


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_log_fields").select(
        F.col("event_id").cast("string").alias("record_id"), F.split("fields", ",").alias("fields"), "body_sourced"
    )


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_advisories").select(
        "adv_id",
        "package",
        F.array("alias").alias("aliases"),
        "db_severity",
        "cvss",
        packages.single_range(F.col("introduced"), F.col("fixed")).alias("ranges"),
    )


def tls_settings(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_tls").select(
        F.col("svc_id").cast("string").alias("record_id"),
        "skip_verify",
        "min_version",
        F.filter(F.split("ciphers", ","), lambda c: c != "").alias("ciphers"),
        "min_password_len",
        "len_unit",
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_csp").select(
        F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("path"), "response_type", "csp"
    )


def lock_lines(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_lock").select("project_id", F.concat_ws(" ", "module", "version", "sum").alias("line"))


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("path"), F.col("url").alias("value")
    )


# ---- sources and scope --------------------------------------------------------


@query("src01_read_units")
def _(spark, sf):
    return all_units(spark, sf).select("record_id", "source", "path", "n_bytes", F.md5("text").alias("text_md5"))


@query("src01_read_lines")
def _(spark, sf):
    """Documents written as sixteen text files in parts below the shared folder, read as numbered lines."""
    path = scratch_path(spark, "files")
    docs = table(spark, sf, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("value"), (F.col("doc_id") % 16).alias("file"))
    # A task writes about as much whatever the table holds; a file is as many parts as it needs.
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    tasks = max(16, -(-n_bytes // FILE_BYTES))
    docs.repartitionByRange(tasks, "file", "doc_id").sortWithinPartitions("file", "doc_id").select("value", "file").write.partitionBy("file").text(path)
    lines = units.read_lines(spark, path, [".txt"], parts=True)
    return lines.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("int").alias("file"), "line_no", F.md5("line").alias("line_md5"))


@query("src02_filter_scope")
def _(spark, sf):
    return units.filter_scope(view(spark, sf, "v_paths"), SCOPE_EXTS, exclude_globs=["*.pb.go", "examples/"], max_bytes=fv.MAX_FILE_BYTES)


@query("src03_tracked_only")
def _(spark, sf):
    return units.tracked_only(view(spark, sf, "v_paths"), view(spark, sf, "v_manifest"))


@query("src04_to_lines")
def _(spark, sf):
    lines = units.to_lines(document_units(spark, sf))
    return lines.select("record_id", "line_no", F.md5("line").alias("line_md5"))


@query("src05_extract_kv")
def _(spark, sf):
    rows = keyvalues.extract_kv(units.to_lines(document_units(spark, sf)))
    return rows.select("record_id", "line_no", F.md5("key").alias("key_md5"), F.md5("value").alias("value_md5"))


@query("src05_extract_inline_kv")
def _(spark, sf):
    rows = keyvalues.extract_inline_kv(units.to_lines(document_units(spark, sf)))
    return rows.select("record_id", "line_no", "key", F.md5("value").alias("value_md5"))


@query("src06_flatten_json")
def _(spark, sf):
    return keyvalues.flatten_json(table(spark, sf, "events"), "props", keep=("event_id",))


@query("src06_flatten_json_nested")
def _(spark, sf):
    """Objects and arrays three levels deep, built from the event rows."""
    events = table(spark, sf, "events")
    event = F.struct(
        F.col("event_type").alias("kind"),
        F.array(F.col("user_id"), F.col("event_id")).alias("ids"),
        F.struct(F.lit("").alias("empty"), F.array(F.struct((F.col("value") > 10).alias("big"))).alias("list")).alias(
            "inner"
        ),
    )
    nested = events.select("event_id", F.to_json(F.struct(event.alias("event"))).alias("doc"))
    return keyvalues.flatten_json(nested, "doc", keep=("event_id",))


@query("src07_column_inventory")
def _(spark, sf):
    return columns.inventory_of_events(view(spark, sf, "v_schema_events"))


@query("src08_script_tags")
def _(spark, sf):
    return page_sources.script_tags(view(spark, sf, "v_pages_aug"))


@query("src09_meta_csp")
def _(spark, sf):
    return page_sources.meta_csp(view(spark, sf, "v_pages_aug"))


@query("src10_payment_form_flag")
def _(spark, sf):
    return page_sources.payment_form_flag(view(spark, sf, "v_pages_aug"))


@query("src11_lock_entries")
def _(spark, sf):
    return packages.lock_entries(lock_lines(spark, sf))


@query("src12_explode_advisories")
def _(spark, sf):
    flat_rows = view(spark, sf, "v_advisories")
    document = F.struct(
        F.col("adv_id").alias("id"),
        F.array("alias").alias("aliases"),
        F.array(
            F.struct(
                F.struct(F.col("package").alias("name"), F.lit("Go").alias("ecosystem")).alias("package"),
                packages.single_range(F.col("introduced"), F.col("fixed")).alias("ranges"),
            )
        ).alias("affected"),
    )
    parsed = packages.parse_advisories(flat_rows.select(F.to_json(document).alias("doc")), "doc")
    return packages.explode_advisories(parsed).select(
        "adv_id", "package", "range_no", "event_no", "introduced", "fixed"
    )


@query("sink01_findings_json")
def _(spark, sf):
    """Findings as JSON objects, read back field by field."""
    rows = sinks.findings_json(bulk(spark, sf).select("ord", "rule_id", "severity", "path"))
    back = F.from_json("finding", "ord bigint, rule_id string, severity string, path string")
    return rows.select(back.alias("_f")).select("_f.*")


@query("sink01_write_findings")
def _(spark, sf):
    """Findings written by severity below the shared folder and read back."""
    out = scratch_path(spark, "written")
    sinks.write_findings(bulk(spark, sf).select("ord", "rule_id", "severity", "path", "line_no"), out)
    return spark.read.parquet(out)


# ---- scalar functions ---------------------------------------------------------


@query("fn01_normalize_name")
def _(spark, sf):
    return kv(spark, sf).select("record_id", text.normalize_name("key").alias("norm"))


@query("fn02_extract_digits")
def _(spark, sf):
    digits = cards.extract_digits("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.length(digits).alias("n_digits"), F.md5(digits).alias("digits_md5")
    )


def digit_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit("[0-9]+"), 0)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(runs).alias("pos", "run"))


@query("fn03_luhn_valid")
def _(spark, sf):
    return digit_runs(spark, sf).select("doc_id", "pos", cards.luhn_valid("run").alias("valid"))


@query("fn04_card_brand")
def _(spark, sf):
    return digit_runs(spark, sf).select("doc_id", "pos", F.coalesce(cards.card_brand("run"), F.lit("")).alias("brand"))


@query("fn05_is_likely_pan")
def _(spark, sf):
    return digit_runs(spark, sf).select("doc_id", "pos", cards.is_likely_pan("run").alias("likely"))


@query("fn06_shannon_entropy")
def _(spark, sf):
    return kv(spark, sf).select("record_id", F.round(secrets.shannon_entropy("value"), 6).alias("entropy"))


@query("fn07_is_high_entropy")
def _(spark, sf):
    return kv(spark, sf).select("record_id", secrets.is_high_entropy("value").alias("high"))


@query("fn08_is_sensitive_keyword")
def _(spark, sf):
    return view(spark, sf, "v_all_cols").select(
        "table_name", "column_name", cards.is_sensitive_keyword("column_name").alias("sensitive")
    )


@query("fn09_has_test_prefix")
def _(spark, sf):
    return kv(spark, sf).select(
        "record_id",
        cards.has_test_prefix("key").alias("key_is_test"),
        cards.has_test_prefix(F.concat(F.lit("Mock"), F.col("key"))).alias("mock_is_test"),
    )


@query("fn10_classify_pan_sad")
def _(spark, sf):
    return view(spark, sf, "v_all_cols").select(
        "table_name", "column_name", cards.classify_pan_sad("column_name").alias("kind")
    )


@query("fn11_requirement_for")
def _(spark, sf):
    kind = cards.classify_pan_sad("column_name")
    field, logger = cards.requirement_for(kind, "field"), cards.requirement_for(kind, "logger")
    return view(spark, sf, "v_all_cols").select(
        "table_name",
        "column_name",
        field["requirement_id"].alias("field_requirement"),
        F.concat_ws(",", field["related"]).alias("field_related"),
        logger["requirement_id"].alias("logger_requirement"),
        F.concat_ws(",", logger["related"]).alias("logger_related"),
    )


@query("fn12_placeholder_kind")
def _(spark, sf):
    return kv(spark, sf).select(
        "record_id",
        F.coalesce(secrets.placeholder_kind("value"), F.lit("")).alias("kind"),
        secrets.is_password_placeholder("value").alias("password_placeholder"),
    )


@query("fn13_is_sql_text")
def _(spark, sf):
    return kv(spark, sf).select("record_id", secrets.is_sql_text("value").alias("is_sql"))


@query("fn14_is_credential_key")
def _(spark, sf):
    return kv(spark, sf).select("record_id", secrets.is_credential_key("key").alias("credential"))


@query("fn15_is_path_or_url_pair")
def _(spark, sf):
    return kv(spark, sf).select(
        "record_id",
        secrets.is_path_or_url_pair("key", "value").alias("pair"),
        secrets.is_path_or_url_value("path").alias("path_is_path"),
    )


@query("fn16_secret_prefix")
def _(spark, sf):
    return kv(spark, sf).select("record_id", F.coalesce(secrets.secret_prefix("value"), F.lit("")).alias("prefix"))


@query("fn17_is_connection_string")
def _(spark, sf):
    return kv(spark, sf).select("record_id", secrets.is_connection_string("value").alias("connstr"))


@query("fn18_is_non_secret")
def _(spark, sf):
    return kv(spark, sf).select(
        "record_id",
        secrets.is_non_secret("value").alias("value_plain"),
        secrets.is_non_secret(text.last_segment("key")).alias("name_plain"),
    )


@query("fn19_is_character_set")
def _(spark, sf):
    value = F.col("value")
    return kv(spark, sf).select(
        "record_id",
        secrets.is_character_set(value).alias("plain"),
        secrets.is_character_set(F.concat(F.lit("ABCDEFGHIJKLM"), value)).alias("with_letters"),
        secrets.is_character_set(F.concat(value, F.lit("0123456789!@#%^&*()"))).alias("with_digits"),
    )


@query("fn20_is_excluded_literal")
def _(spark, sf):
    return kv(spark, sf).select("record_id", secrets.is_excluded_literal("value").alias("excluded"))


@query("fn21_identifier_words")
def _(spark, sf):
    name = text.last_segment("key")
    return kv(spark, sf).select(
        "record_id",
        F.concat_ws("|", words.identifier_words(name)).alias("words"),
        words.keyword_at_boundary(name, fv.KEY_WORDS).alias("key_word"),
        words.keyword_at_boundary(name, fv.PASSWORD_WORDS).alias("password_word"),
    )


@query("fn22_is_payment_path")
def _(spark, sf):
    by_path = view(spark, sf, "v_paths").select(
        F.col("path").alias("location"), paths.is_payment_path("path").alias("payment")
    )
    by_url = table(spark, sf, "pages").select(
        F.col("url").alias("location"), paths.is_payment_path("url").alias("payment")
    )
    return by_path.unionByName(by_url)


@query("fn23_severity_rank")
def _(spark, sf):
    return bulk(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(
        "severity",
        "n",
        severity.severity_rank("severity").alias("sev_rank"),
        severity.severity_order("severity").alias("sev_order"),
    )


@query("fn24_dev_context")
def _(spark, sf):
    high = paths.dev_context("path", "value", F.lit("HIGH"))
    info = paths.dev_context("path", "value", F.lit("INFO"))
    return kv(spark, sf).select(
        "record_id",
        high["severity"].alias("from_high"),
        info["severity"].alias("from_info"),
        high["dev_context"].alias("dev_context"),
        high["label"].alias("label"),
    )


@query("fn25_file_location")
def _(spark, sf):
    return view(spark, sf, "v_paths").select("record_id", paths.file_location("path").alias("location"))


@query("fn26_glob_match")
def _(spark, sf):
    patterns = {
        "testdata_tree": "testdata/**",
        "vendor_tree": "vendor/**",
        "any_yaml": "**/*.yaml",
        "card_env": "internal/card/*.env",
        "one_digit": "config/prod/f?.json",
        "deploy_json": "deploy/**/*.json",
    }
    return view(spark, sf, "v_paths").select(
        "record_id", *[paths.glob_match(p, "path").alias(n) for n, p in patterns.items()]
    )


@query("fn27_parse_csp")
def _(spark, sf):
    flags = policies.parse_csp("csp")
    return view(spark, sf, "v_csp").select("page_id", *[flags[n].alias(n) for n in policies.CSP_FLAGS])


@query("fn28_semver_key")
def _(spark, sf):
    key = versions.semver_key("version")
    return view(spark, sf, "v_deps").select(
        "ord",
        *[key[n].cast("int").alias(n) for n in ("is_valid", "major", "minor", "patch", "is_release")],
        (key >= versions.semver_key(F.lit("1.5.3"))).alias("at_least_1_5_3"),
    )


@query("fn29_advisory_severity")
def _(spark, sf):
    return view(spark, sf, "v_advisories").select(
        "adv_id", versions.advisory_severity("db_severity", versions.cvss_base_score("cvss")).alias("severity")
    )


@query("fn30_cvss_base_score")
def _(spark, sf):
    return view(spark, sf, "v_cvss").select(
        "record_id",
        versions.cvss_base_score("vector").alias("score3"),
        versions.cvss_base_score("vector2").alias("score2"),
    )


@query("fn31_h1_to_hex")
def _(spark, sf):
    return view(spark, sf, "v_lock").select(
        "project_id",
        versions.h1_to_hex("sum").alias("sha256"),
        versions.purl("module", "version").alias("purl"),
    )


@query("fn32_is_plaintext_type")
def _(spark, sf):
    return view(spark, sf, "v_all_cols").select(
        "table_name", "column_name", policies.is_plaintext_type("sql_type").alias("plaintext")
    )


@query("fn33_tls_predicates")
def _(spark, sf):
    return view(spark, sf, "v_tls").select(
        "svc_id",
        policies.is_prohibited_cipher("ciphers").alias("bad_cipher"),
        policies.is_weak_tls("min_version").alias("weak_version"),
    )


@query("fn34_field_class")
def _(spark, sf):
    fields = log_records(spark, sf).select("record_id", F.posexplode("fields").alias("pos", "field"))
    return fields.select("record_id", "pos", policies.field_class("field").alias("field_class"))


@query("fn35_requirement_category")
def _(spark, sf):
    return bulk(spark, sf).select("ord", severity.requirement_category("requirement_id").alias("category"))


@query("fn36_link_window")
def _(spark, sf):
    window = paths.link_window("line_no")
    return bulk(spark, sf).select(
        "ord",
        window["start_line"].alias("start_line"),
        window["end_line"].alias("end_line"),
        paths.mime_type("path").alias("mime_type"),
    )


# ---- detections ---------------------------------------------------------------


@query("r01_scan_pan_literals")
def _(spark, sf):
    found = document_units(spark, sf).unionByName(conversation_units(spark, sf))
    return flat(card_scans.scan_pan_literals(found))


@query("r02_scan_kv_pan")
def _(spark, sf):
    """Dotted keys and the same rows as environment variables, whose whole name can be sensitive."""
    dotted = kv(spark, sf)
    variables = dotted.withColumn("key", F.upper(text.last_segment("key")))
    return flat(card_scans.scan_kv_pan(dotted.unionByName(variables)))


@query("r03_scan_pan_columns")
def _(spark, sf):
    return flat(card_scans.scan_pan_columns(view(spark, sf, "v_all_cols")))


@query("r04_scan_log_pan")
def _(spark, sf):
    return flat(card_scans.scan_log_pan(log_records(spark, sf)))


@query("r05_scan_secrets")
def _(spark, sf):
    return flat(secret_scans.scan_secrets(kv(spark, sf)))


@query("r05_scan_secrets_documents")
def _(spark, sf):
    rows = keyvalues.extract_inline_kv(units.to_lines(document_units(spark, sf)))
    return flat(secret_scans.scan_secrets(rows))


@query("r06_scan_hardcoded_keys")
def _(spark, sf):
    return flat(secret_scans.scan_hardcoded_keys(kv(spark, sf)))


@query("r07_scan_hardcoded_passwords")
def _(spark, sf):
    return flat(secret_scans.scan_hardcoded_passwords(kv(spark, sf)))


@query("r08_scan_plain_http")
def _(spark, sf):
    return flat(crypto.scan_plain_http(page_urls(spark, sf)))


@query("r09_scan_weak_hash")
def _(spark, sf):
    return flat(crypto.scan_weak_hash(view(spark, sf, "v_lines")))


@query("r10_scan_scripts")
def _(spark, sf):
    return flat(pages.scan_scripts(view(spark, sf, "v_pages_aug")))


@query("r11_scan_meta_csp")
def _(spark, sf):
    return flat(pages.scan_meta_csp(view(spark, sf, "v_pages_aug")))


@query("r12_scan_csp_headers")
def _(spark, sf):
    return flat(pages.scan_csp_headers(responses(spark, sf)))


@query("r13_scan_tls_settings")
def _(spark, sf):
    return flat(transport.scan_tls_settings(tls_settings(spark, sf)))


@query("r14_scan_password_policy")
def _(spark, sf):
    return flat(transport.scan_password_policy(tls_settings(spark, sf)))


@query("r15_scan_schema_columns")
def _(spark, sf):
    return flat(schema.scan_schema_columns(view(spark, sf, "v_all_cols")))


@query("r16_scan_retention_groups")
def _(spark, sf):
    return flat(retention.scan_retention_groups(kv(spark, sf)))


@query("r16_scan_retention_json")
def _(spark, sf):
    """The same settings as JSON documents, three objects deep, flattened into keys."""
    rows = kv(spark, sf)
    level = lambda n: F.split("key", r"\.")[n]
    nested = F.to_json(F.create_map(level(0), F.create_map(level(1), F.create_map(level(2), F.col("value")))))
    return flat(retention.scan_retention_groups(keyvalues.json_kv(rows.select("record_id", "path", nested.alias("text")))))


@query("r17_audit_trail_coverage")
def _(spark, sf):
    found = audit.audit_trail_coverage(view(spark, sf, "v_ops"), view(spark, sf, "v_audit_mix"), "user_id")
    return flat(found, "tier")


@query("r18_audit_field_coverage")
def _(spark, sf):
    covered = audit.audit_field_coverage(log_records(spark, sf), timestamp_auto=F.col("body_sourced"))
    pairs = F.transform(
        F.map_entries("matched"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))
    )
    return covered.select(
        "record_id",
        "score",
        "severity",
        F.array_join(F.array_sort(pairs), ";").alias("matched"),
        F.concat_ws(",", "missing").alias("missing"),
    )


@query("r19_scan_log_fields")
def _(spark, sf):
    return flat(audit.scan_log_fields(log_records(spark, sf)))


@query("r20_payment_context_score")
def _(spark, sf):
    scored = payment.payment_context_score(view(spark, sf, "v_entities"))
    return scored.select("entity_id", "score", "in_scope", F.concat_ws(",", "signals").alias("signals"))


@query("r21_payment_tier")
def _(spark, sf):
    wide = payment.payment_tier(view(spark, sf, "v_entities")).select("entity_id", F.col("tier").alias("tier"))
    pairs = payment.payment_tier(view(spark, sf, "v_entity_pairs")).select(
        "entity_id", (F.col("tier") + 10).alias("tier")
    )
    return wide.unionByName(pairs)


@query("r22_license_inventory")
def _(spark, sf):
    return licences.license_inventory(document_units(spark, sf)).select("record_id", "licence")


@query("r22_license_coverage")
def _(spark, sf):
    """Lines of documents against the benchmark's passages, which stand for the texts of licences."""
    found = units.to_lines(document_units(spark, sf)).select(F.concat_ws(":", "record_id", "line_no").alias("record_id"), "path", F.col("line").alias("text"))
    known = table(spark, sf, "benchmark").select(F.concat(F.lit("L"), F.col("item_id").cast("string")).alias("licence"), "text")
    return licences.license_coverage(found, known).select("record_id", "licence", "n_words", "n_covered", "span")


@query("r22_license_counts")
def _(spark, sf):
    return licences.license_counts(document_units(spark, sf))


# ---- joins and graph ----------------------------------------------------------


@query("j01_match_advisories")
def _(spark, sf):
    return dependencies.match_advisories(view(spark, sf, "v_deps"), advisories(spark, sf))


@query("j02_scan_dependencies")
def _(spark, sf):
    found = dependencies.scan_dependencies(view(spark, sf, "v_deps"), advisories(spark, sf))
    return found.select(
        "rule_id",
        "severity",
        "requirement_id",
        F.col("record_id").alias("module"),
        "version",
        F.col("subject").alias("adv_id"),
        "group_id",
        "first_ord",
        F.coalesce("fix_version", F.lit("")).alias("fix_version"),
        F.coalesce("affected_range", F.lit("")).alias("affected_range"),
    )


@query("j03_enrich_requirements")
def _(spark, sf):
    found = requirements.enrich_requirements(bulk(spark, sf), view(spark, sf, "v_requirements"))
    return found.select("ord", "rule_id", "requirement_id", "requirement_title")


@query("j03_explain_requirements")
def _(spark, sf):
    """Ids as they occur in findings, padded, with one sub-requirement each that is unknown."""
    ids = bulk(spark, sf).select(
        F.explode(
            F.array(
                F.concat(F.lit(" "), F.col("requirement_id"), F.lit(" ")), F.concat("requirement_id", F.lit(".99"))
            )
        ).alias("requirement_id")
    )
    found = requirements.explain_requirements(ids, view(spark, sf, "v_requirements"))
    return found.select(
        "requirement_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("error", F.lit("")).alias("error")
    )


def suppressed(spark: SparkSession, sf: str) -> DataFrame:
    return suppression.apply_suppressions(bulk(spark, sf), IGNORE_RULES)


def suppression_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "ord",
        "rule_id",
        "path",
        "line_no",
        "suppressed",
        F.coalesce("suppression_reason", F.lit("")).alias("reason"),
        F.coalesce("suppression_source", F.lit("")).alias("source"),
    )


@query("j04_apply_suppressions")
def _(spark, sf):
    return suppression_columns(suppressed(spark, sf))


@query("j04_apply_suppressions_table")
def _(spark, sf):
    """The same rules given as a table, through the folder-keyed join."""
    rules = suppression.rules_table(spark, IGNORE_RULES)
    return suppression_columns(suppression.apply_suppressions(bulk(spark, sf), rules))


@query("j05_inline_suppressions")
def _(spark, sf):
    return suppression_columns(suppression.inline_suppressions(suppressed(spark, sf), view(spark, sf, "v_lines")))


@query("j06_exclude_packages")
def _(spark, sf):
    kept, reports = suppression.exclude_packages(bulk(spark, sf), EXCLUDE_RULES)
    rows = kept.groupBy("rule_id", "severity", "path").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(reports.select("rule_id", "severity", "path", F.col("n_dropped").alias("n")))


@query("j07_encryption_crossref")
def _(spark, sf):
    found = schema.scan_schema_columns(view(spark, sf, "v_all_cols"))
    return flat(schema.encryption_crossref(found, view(spark, sf, "v_encryption")))


@query("j08_flow_reaches")
def _(spark, sf):
    edges = view(spark, sf, "v_edges")
    sources = edges.select(F.col("src").alias("node"))
    return graph.flow_reaches(edges, sources, view(spark, sf, "v_sinks")).select("source", "reaches", "hops")


@query("j09_transit_downgrade")
def _(spark, sf):
    edges = view(spark, sf, "v_edges")
    flow = graph.flow_reaches(edges, edges.select(F.col("src").alias("node")), view(spark, sf, "v_sinks"))
    found = context.transit_downgrade(view(spark, sf, "v_field_findings"), flow)
    return found.select(
        "ord",
        "rule_id",
        "severity",
        F.coalesce("confidence", F.lit("")).alias("confidence"),
        F.coalesce("flow_note", F.lit("")).alias("flow_note"),
    )


@query("j10_snippets")
def _(spark, sf):
    found = context.snippets(bulk(spark, sf), view(spark, sf, "v_lines"))
    return found.select("record_id", "line_no", "code_snippet.before", "code_snippet.line", "code_snippet.after")


@query("j11_diff_findings")
def _(spark, sf):
    return context.diff_findings(view(spark, sf, "v_expected"), view(spark, sf, "v_actual"))


@query("j12_mapping_drift")
def _(spark, sf):
    canonical = spark.createDataFrame(fv.RULE_REQUIREMENTS, "rule_id string, requirement_id string")
    found = bulk(spark, sf).withColumn(
        "requirement_id",
        F.when((F.col("rule_id") == "SQL-TEXT-TYPE") & (F.col("severity") == "HIGH"), F.lit("3.3.1")).otherwise(
            F.col("requirement_id")
        ),
    )
    return requirements.mapping_drift(found, canonical)


@query("j13_add_hints")
def _(spark, sf):
    return triage.add_hints(bulk(spark, sf)).select("ord", "rule_id", "hint")


# ---- aggregations -------------------------------------------------------------


@query("a01_severity_counts")
def _(spark, sf):
    return summary.severity_counts(bulk(spark, sf))


@query("a02_rule_histogram")
def _(spark, sf):
    return summary.rule_histogram(bulk(spark, sf), n=5)


@query("a03_findings_by_rule")
def _(spark, sf):
    return summary.findings_by_rule(bulk(spark, sf))


@query("a04_scan_summary")
def _(spark, sf):
    return summary.scan_summary(bulk(spark, sf), all_units(spark, sf))


def status(spark: SparkSession, sf: str) -> DataFrame:
    return requirements.requirement_status(view(spark, sf, "v_requirements"), suppressed(spark, sf))


@query("a05_requirement_status")
def _(spark, sf):
    return status(spark, sf)


@query("a06_propagate_related")
def _(spark, sf):
    return requirements.propagate_related(status(spark, sf), suppressed(spark, sf))


@query("a07_not_checked")
def _(spark, sf):
    return requirements.not_checked(status(spark, sf), view(spark, sf, "v_requirements"))


@query("a08_report_summary")
def _(spark, sf):
    return requirements.report_summary(status(spark, sf), suppressed(spark, sf))


@query("a08_gate")
def _(spark, sf):
    return requirements.gate(suppressed(spark, sf))


@query("a09_alias_groups")
def _(spark, sf):
    return dependencies.alias_groups(advisories(spark, sf))


@query("a09_group_aliases")
def _(spark, sf):
    found = advisories(spark, sf)
    return dependencies.group_aliases(found, dependencies.alias_groups(found))


@query("a10_group_repeated")
def _(spark, sf):
    return pairing.group_repeated(view(spark, sf, "v_field_findings"))


@query("a10_repeated_members")
def _(spark, sf):
    return pairing.repeated_members(view(spark, sf, "v_field_findings"))


@query("a11_category_rollup")
def _(spark, sf):
    return summary.category_rollup(bulk(spark, sf))


def components(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.sbom_inventory(packages.lock_entries(lock_lines(spark, sf)), view(spark, sf, "v_deps"))


@query("a12_sbom_inventory")
def _(spark, sf):
    return components(spark, sf)


@query("a13_inventory_status")
def _(spark, sf):
    projects = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"))
    named = licences.license_inventory(document_units(spark, sf)).select(
        F.concat(F.lit("example.org/m"), (F.substring_index("record_id", "/", -1).cast("bigint") % 80).cast("string")).alias(
            "module"
        ),
        "licence",
    )
    return inventory.inventory_status(projects, components(spark, sf), named)


@query("a14_snapshot_freshness")
def _(spark, sf):
    """All events: one source for each user, and one for each user and type, of which few have had one lately."""
    events = table(spark, sf, "events")
    snapshots = events.select(F.col("user_id").cast("string").alias("source"), "ts").unionByName(
        events.select(F.concat(F.substring("event_type", 1, 3), F.col("user_id").cast("string")).alias("source"), "ts")
    )
    customers = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("source"))
    sources = customers.unionByName(customers.select(F.concat(F.lit("err"), F.col("source")).alias("source")))
    found = dependencies.snapshot_freshness(sources, snapshots, AS_OF)
    return found.select(
        "source", "age_days", "state", F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
    )


# ---- order, ranks and pages ---------------------------------------------------


@query("w01_top_n_per_severity")
def _(spark, sf):
    return summary.top_n_per_severity(bulk(spark, sf), 3).select("severity", "rule_id", "path", "ord", "rank")


@query("w02_sort_by_severity")
def _(spark, sf):
    return summary.sort_by_severity(bulk(spark, sf)).select(
        "ord", "severity", "rule_id", severity.severity_order("severity").alias("sev_order")
    )


@query("w03_paginate")
def _(spark, sf):
    found = summary.paginate(bulk(spark, sf), offset=3_000, ties=("rule_id", "path", "line_no"), bin_width=4096)
    return found.select("row_no", "next_offset", "severity", "ord", "rule_id", "path")


@query("w03_indexed_page")
def _(spark, sf):
    """The same page from findings written in page order, by the index of their positions."""
    book = paging.write_pages(bulk(spark, sf), scratch_path(spark, "pages"), ties=("rule_id", "path", "line_no"))
    return book.page(3000).select("row_no", "next_offset", "severity", "ord", "rule_id", "path")


@query("w04_dropped_column_downgrade")
def _(spark, sf):
    events = view(spark, sf, "v_schema_events")
    found = events.filter(F.col("op") == "ADD").select(
        "table_name", "column_name", "ord", F.lit("SQL-SENSITIVE-COLUMN").alias("rule_id"), F.lit("HIGH").alias("severity")
    )
    return schema.dropped_column_downgrade(found, events).select("table_name", "column_name", "ord", "severity")


@query("w05_dedup_paired")
def _(spark, sf):
    return pairing.dedup_paired(view(spark, sf, "v_field_findings")).select("ord", "rule_id", "severity", "path", "kind")


# ---- sets of findings ---------------------------------------------------------


@query("s01_run_scans")
def _(spark, sf):
    inputs = {
        "units": document_units(spark, sf).unionByName(conversation_units(spark, sf)),
        # Rules read the settings six times in one plan; each time they would join the part table with itself, through the driver.
        "kv": cut_lineage(view(spark, sf, "v_kv", hint="MERGE(p, v)")),
        "columns": view(spark, sf, "v_all_cols"),
        "logs": log_records(spark, sf),
        "urls": page_urls(spark, sf),
        "lines": view(spark, sf, "v_lines").withColumn("record_id", F.col("record_id").cast("string")),
        "pages": view(spark, sf, "v_pages_aug"),
        "responses": responses(spark, sf),
        "settings": tls_settings(spark, sf),
        "deps": view(spark, sf, "v_deps"),
        "advisories": advisories(spark, sf),
        "operations": view(spark, sf, "v_ops").withColumnRenamed("user_id", "key"),
        "operation_logs": view(spark, sf, "v_audit_mix").withColumnRenamed("user_id", "key"),
        "audit_records": log_records(spark, sf).withColumnRenamed("body_sourced", "timestamp_auto"),
    }
    found = run_scans(inputs)
    return found.groupBy("rule_id", "severity", "requirement_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("dev_context").alias("n_dev")
    )


@query("x01_status_of_rules_that_ran")
def _(spark, sf):
    """Addresses, columns and operations only; and a rule that can't be built, which must not leave PASS behind."""
    broken = RuleSpec("broken", ("urls",), ("6.4.3",), lambda i: i["urls"].select("no_such_column"))
    inputs = {
        "urls": page_urls(spark, sf),
        "columns": view(spark, sf, "v_all_cols"),
        "operations": view(spark, sf, "v_ops").withColumnRenamed("user_id", "key"),
        "operation_logs": view(spark, sf, "v_audit_mix").withColumnRenamed("user_id", "key"),
    }
    run = scan(inputs, (*DEFAULT_RULES, broken))
    catalogue = requirements.with_coverage(view(spark, sf, "v_requirements"), run.covered)
    return requirements.requirement_status(catalogue, run.findings).withColumn("failed", F.lit(",".join(run.failed)))


@query("s02_filter_findings")
def _(spark, sf):
    by_list = summary.filter_findings(bulk(spark, sf), "high", "PAN-LITERAL, SEC-PREFIX")
    by_regex = summary.filter_findings(bulk(spark, sf), "none-such", "/^(CSP|NONCE)-.*/")
    return by_list.unionByName(by_regex).select("ord", "rule_id", "severity", "path")


@query("s03_drop_verified_ok")
def _(spark, sf):
    return summary.drop_verified_ok(bulk(spark, sf)).select("ord", "rule_id", "severity")


@query("s04_triage")
def _(spark, sf):
    return triage.triage(bulk(spark, sf), view(spark, sf, "v_lines")).select(
        "ord",
        "rule_id",
        "file_location",
        "start_line",
        "end_line",
        "mime_type",
        "hint",
        F.coalesce("code_snippet.line", F.lit("")).alias("line"),
    )


@query("st01_scan_stream")
def _(spark, sf):
    """Five rules on the event table read as a stream in which every event is delivered twice, until it is drained."""

    def prepare(events: DataFrame) -> dict[str, DataFrame]:
        told = events.selectExpr(*[f"{text} AS {name}" for name, text in STREAM_COLUMNS.items()])
        told = told.unionByName(told).withColumn("event_time", F.col("event_time").cast("timestamp"))
        place = ["record_id", "path", "event_time"]
        return {
            "units": told.select(*place, "text"),
            "kv": told.select(*place, F.lit(0).alias("line_no"), "key", "value"),
            "urls": told.select(*place, F.col("url").alias("value")),
            "logs": told.select(*place, F.split("fields", ",").alias("fields"), "body_sourced"),
        }

    chosen = tuple(r for r in DEFAULT_RULES if r.name in ("pan_literals", "log_pan", "secrets", "plain_http", "log_fields"))
    # The pattern fits a single file and a folder of part files.
    found = scan_available(
        spark,
        f"{sf}/events.parquet*",
        table(spark, sf, "events").schema,
        prepare,
        scratch_path(spark, "findings"),
        scratch_path(spark, "stream"),
        chosen,
        event_time="event_time",
    )
    return flat(found, F.unix_seconds("slot").alias("slot"))


@query("report_requirement_status")
def _(spark, sf):
    """The whole report pipeline over the findings table, reduced to its status part."""
    report = compliance_report(
        bulk(spark, sf), view(spark, sf, "v_requirements"), IGNORE_RULES, EXCLUDE_RULES, view(spark, sf, "v_lines")
    )
    return report.status


@query("report_post_processed")
def _(spark, sf):
    """Field findings with their flow, and schema findings with a list of encrypted columns, through the whole report."""
    edges = view(spark, sf, "v_edges")
    flow = graph.flow_reaches(edges, edges.select(F.col("src").alias("node")), view(spark, sf, "v_sinks"))
    fields = view(spark, sf, "v_field_findings").withColumn("requirement_id", F.lit("3.3.1")).withColumn("scanner", F.lit("cards"))
    columns_found = schema.scan_schema_columns(view(spark, sf, "v_all_cols")).withColumn("ord", F.lit(10**12) + F.col("line_no"))
    found = fields.withColumn("ord", F.col("ord").cast("long")).unionByName(columns_found, allowMissingColumns=True)
    report = compliance_report(found, view(spark, sf, "v_requirements"), flow=flow, encrypted=view(spark, sf, "v_encryption"))
    hint = F.coalesce("triage_hint", F.lit(""))
    counts = report.base.groupBy("rule_id", "severity", hint.alias("hint")).agg(F.count(F.lit(1)).alias("n"))
    merged = report.repeated.groupBy("rule_id", "severity").agg(F.sum("n").alias("n")).select("rule_id", "severity", F.lit("merged").alias("hint"), "n")
    return counts.unionByName(merged)
