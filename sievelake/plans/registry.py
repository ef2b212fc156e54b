"""Rules as plug-ins, and running a set of them over one set of inputs."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from sievelake.operators.audit import audit_trail_coverage, log_field_rule, scan_audit_fields
from sievelake.operators.cards import kv_pan_rule, log_pan_rule, scan_pan_columns, scan_pan_literals
from sievelake.operators.crypto import scan_plain_http, scan_weak_hash
from sievelake.operators.dependencies import scan_dependencies
from sievelake.operators.pages import scan_csp_headers, scan_pages
from sievelake.operators.retention import scan_retention_groups
from sievelake.operators.schema import scan_schema_columns
from sievelake.operators.secrets import hardcoded_key_rule, password_rule, secret_rule
from sievelake.operators.transport import password_policy_rule, tls_rule
from sievelake.schemas import RowRule, apply_rules, as_findings
from sievelake.sources.logs import log_fields

log = logging.getLogger(__name__)
Inputs = Mapping[str, DataFrame]


@dataclass(frozen=True)
class RuleSpec:
    """A rule set: what it reads, which requirements it covers, how it makes findings.

    `row` gives a rule over single rows, taken from `prepare(input)` where given;
    rules with the same input and preparation share a scan. `build` makes a findings DataFrame from the inputs, for everything else.
    """

    name: str
    needs: tuple[str, ...]
    requirements: tuple[str, ...]
    build: Callable[[Inputs], DataFrame] | None = None
    description: str = ""
    row: Callable[[], RowRule] | None = None
    prepare: Callable[..., DataFrame] | None = None
    row_local: bool = True  # also runs unchanged on a stream
    #: Columns that each input must have, for a rule whose making runs jobs; it is then made when the findings are asked for.
    staged: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    timed: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None  # a row-local `build` that carries further columns


DEFAULT_RULES = (
    RuleSpec("pan_literals", ("units",), ("3.4.1",), lambda i: scan_pan_literals(i["units"]), "card numbers in text", timed=scan_pan_literals),
    RuleSpec("kv_pan", ("kv",), ("3.4.1", "3.3.1"), row=kv_pan_rule, description="card data in configuration"),
    RuleSpec("secrets", ("kv",), ("8.6.2",), row=secret_rule, description="secrets in configuration"),
    RuleSpec("hardcoded_keys", ("kv",), ("6.2.4",), row=hardcoded_key_rule, description="literal key material"),
    RuleSpec("passwords", ("kv",), ("8.6.2",), row=password_rule, description="literal passwords"),
    RuleSpec(
        "log_pan",
        ("logs",),
        ("3.5.1", "3.3.1"),
        row=log_pan_rule,
        prepare=log_fields,
        description="card data in log records",
    ),
    RuleSpec(
        "log_fields",
        ("logs",),
        ("10.2.1",),
        row=log_field_rule,
        prepare=log_fields,
        description="request input in logs",
    ),
    RuleSpec("tls", ("settings",), ("4.2.1",), row=tls_rule, description="TLS settings"),
    RuleSpec("password_policy", ("settings",), ("8.3.6",), row=password_policy_rule, description="password lengths"),
    RuleSpec("plain_http", ("urls",), ("4.2.1",), lambda i: scan_plain_http(i["urls"]), "unencrypted addresses", timed=lambda df, keep: scan_plain_http(df, keep=keep)),
    RuleSpec("pages", ("pages",), ("6.4.3", "11.6.1"), lambda i: scan_pages(i["pages"]), "script integrity"),
    RuleSpec("csp_headers", ("responses",), ("6.4.3",), lambda i: scan_csp_headers(i["responses"]), "content policy"),
    RuleSpec(
        "pan_columns",
        ("columns",),
        ("3.5.1", "3.3.1"),
        lambda i: scan_pan_columns(i["columns"]),
        "card data columns",
        row_local=False,
    ),
    RuleSpec(
        "schema_columns",
        ("columns",),
        ("3.3.1", "3.5.1"),
        lambda i: scan_schema_columns(i["columns"]),
        "sensitive columns",
        row_local=False,
    ),
    RuleSpec(
        "retention",
        ("kv",),
        ("3.2.1",),
        lambda i: scan_retention_groups(i["kv"]),
        "configuration groups without retention",
        row_local=False,
    ),
    RuleSpec(
        "weak_hash",
        ("lines",),
        ("6.2.4",),
        lambda i: scan_weak_hash(i["lines"]),
        "weak hashes near sensitive names",
        row_local=False,
    ),
    RuleSpec(
        "dependencies",
        ("deps", "advisories"),
        ("6.3.3",),
        lambda i: scan_dependencies(i["deps"], i["advisories"]),
        "dependencies with known vulnerabilities",
        row_local=False,
        staged={"deps": ("module", "version", "ord", "indirect"), "advisories": ("adv_id", "package", "aliases", "db_severity", "cvss", "ranges")},
    ),
    RuleSpec(
        "audit_trail",
        ("operations", "operation_logs"),
        ("10.2.1",),
        lambda i: audit_trail_coverage(i["operations"], i["operation_logs"], "key"),
        "payment operations without a trail; both inputs have the column `key`",
        row_local=False,
    ),
    RuleSpec("audit_fields", ("audit_records",), ("10.2.1",), lambda i: scan_audit_fields(i["audit_records"]), "log records without audit fields"),
)


@dataclass(frozen=True)
class ScanRun:
    """What a scan finds, and which rules it stands on.

    Nothing has run until `findings` is read; then rules that work in rounds run theirs, once, and the union is a plan.
    """

    parts: tuple[Callable[[], DataFrame], ...]
    ran: tuple[str, ...]
    failed: tuple[str, ...]  # could not be built on their inputs
    without_input: tuple[str, ...]
    covered: frozenset[str]  # requirements of the rules that ran

    @cached_property
    def findings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [part() for part in self.parts])


def covered_requirements(rules=DEFAULT_RULES) -> set[str]:
    return {requirement for rule in rules for requirement in rule.requirements}


def _attempt(names: str, build: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return as_findings(build())
    except AnalysisException as error:  # a rule that doesn't fit its inputs must not stop the others
        log.error("left out %s: %s", names, error)
        return None


def _fits(rule: RuleSpec, inputs: Inputs) -> bool:
    """Whether the inputs of a staged rule have its columns."""
    try:
        for name, columns in rule.staged.items():
            inputs[name].select(*columns)
    except AnalysisException as error:
        log.error("left out %s: %s", rule.name, error)
        return False
    return True


def _row_scan(table: DataFrame, specs: list[RuleSpec]) -> tuple[list[DataFrame], list[str]]:
    """All row rules of one input in one scan, one by one when they do not build together; and the names of those built."""
    together = None
    if len(specs) > 1:
        names = ", ".join(spec.name for spec in specs) + " as one scan"
        together = _attempt(names, lambda: apply_rules(table, [spec.row() for spec in specs]))
    if together is not None:
        return [together], [spec.name for spec in specs]
    alone = {spec.name: _attempt(spec.name, lambda s=spec: apply_rules(table, [s.row()])) for spec in specs}
    return [df for df in alone.values() if df is not None], [name for name, df in alone.items() if df is not None]


def run_scans(inputs: Inputs, rules=DEFAULT_RULES) -> DataFrame:
    """Findings of every rule whose inputs are present; scan() also tells which rules ran."""
    return scan(inputs, rules).findings


def scan(inputs: Inputs, rules=DEFAULT_RULES) -> ScanRun:
    """Union of every rule whose inputs are present.

    Row rules over one input share its scan. A rule that cannot be built on its
    inputs, say for a missing column, is logged, named in `failed` and left out; the others
    still run. Any other error, such as a lost file, ends the scan. Only what the rules that ran cover counts as checked. No
    job runs here: rules that work in rounds are checked for their columns and made when the findings are read.
    """
    ready = [rule for rule in rules if set(rule.needs) <= set(inputs)]
    built: list[Callable[[], DataFrame]] = []
    ran: list[str] = []
    for name, prepare in dict.fromkeys((rule.needs[0], rule.prepare) for rule in ready if rule.row):
        rows = prepare(inputs[name]) if prepare else inputs[name]
        made, names = _row_scan(rows, [r for r in ready if r.row and (r.needs[0], r.prepare) == (name, prepare)])
        built += [lambda df=df: df for df in made]
        ran += names
    for rule in ready:
        if rule.staged:
            if _fits(rule, inputs):
                built.append(lambda r=rule: as_findings(r.build(inputs)))
                ran.append(rule.name)
        elif rule.build:
            made = _attempt(rule.name, lambda r=rule: r.build(inputs))
            if made is not None:
                built.append(lambda df=made: df)
                ran.append(rule.name)
    if not built:
        raise ValueError("no rule could be built from the given inputs")
    return ScanRun(
        tuple(built),
        tuple(ran),
        tuple(r.name for r in ready if r.name not in ran),
        tuple(r.name for r in rules if r not in ready),
        frozenset(covered_requirements([r for r in rules if r.name in ran])),
    )
