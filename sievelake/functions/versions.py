"""Versions, advisory severities, CVSS base scores and package identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.text import col

_NUM = r"(0|[1-9][0-9]*)"
_VERSION = rf"^v{_NUM}(\.{_NUM}(\.{_NUM}(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?)?)?$"


def normalize_version(version: Column | str) -> Column:
    """Add the leading v when it is missing."""
    version = col(version)
    return F.when(version.startswith("v"), version).otherwise(F.concat(F.lit("v"), version))


def semver_key(version: Column | str) -> Column:
    """Struct whose natural ordering is semantic-version precedence.

    Invalid versions sort first. A release sorts after its pre-releases.
    Pre-release parts compare numbers by value, numbers before words, and a
    shorter list before its extension; array ordering gives the last rule.
    """
    version = normalize_version(version)
    valid = version.rlike(_VERSION)

    def part(group: int) -> Column:
        text = F.regexp_extract(version, _VERSION, group)
        return F.when(valid & (text != ""), text.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))

    label = F.regexp_extract(version, _VERSION, 6)
    pieces = F.when(label != "", F.split(F.substr(label, F.lit(2)), r"\."))
    ordered = F.transform(
        F.coalesce(pieces, F.array().cast("array<string>")),
        lambda p: F.struct(
            (~p.rlike("^[0-9]+$")).cast("int").alias("is_word"),
            F.when(p.rlike("^[0-9]+$"), F.length(p)).otherwise(F.lit(0)).alias("size"),
            p.alias("text"),
        ),
    )
    return F.struct(
        F.when(valid, F.lit(1)).otherwise(F.lit(0)).alias("is_valid"),
        part(1).alias("major"),
        part(3).alias("minor"),
        part(5).alias("patch"),
        F.when(valid & (label == ""), F.lit(1)).otherwise(F.lit(0)).alias("is_release"),
        ordered.alias("pre"),
    )


def advisory_severity(label: Column | str, score: Column | str) -> Column:
    """Database label, then CVSS score, then HIGH."""
    label, score = F.upper(col(label)), col(score)
    return (
        F.when(label.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), label)
        .when(label == "MODERATE", F.lit("MEDIUM"))
        .when(score >= 9.0, F.lit("CRITICAL"))
        .when(score >= 7.0, F.lit("HIGH"))
        .when(score >= 4.0, F.lit("MEDIUM"))
        .when(score >= 0.1, F.lit("LOW"))
        .otherwise(F.lit("HIGH"))
    )


# ---- fixed values: CVSS base metric weights (public specification) ------------
V3_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
V3_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
V2_WEIGHTS = {
    "AV": {"L": 0.395, "A": 0.646, "N": 1.0},
    "AC": {"H": 0.35, "M": 0.61, "L": 0.71},
    "Au": {"M": 0.45, "S": 0.56, "N": 0.704},
    "C": {"N": 0.0, "P": 0.275, "C": 0.66},
    "I": {"N": 0.0, "P": 0.275, "C": 0.66},
    "A": {"N": 0.0, "P": 0.275, "C": 0.66},
}


def _metric(vector: Column, name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit("/"), vector, F.lit("/")), f"/{name}:([A-Z])/", 1)


def _weight(metric: Column, table: dict[str, float]) -> Column:
    result = None
    for value, weight in table.items():
        result = F.when(metric == value, F.lit(weight)) if result is None else result.when(metric == value, F.lit(weight))
    return result


def _bound(fields: dict[str, Column], body) -> Column:
    """Evaluate `fields` once and hand them to `body` as a struct.

    Repeating a sub-expression in several places would repeat its code; a
    one-element transform names it instead.
    """
    parts = [item for name, value in fields.items() for item in (F.lit(name), value)]
    return F.get(F.transform(F.array(F.named_struct(*parts)), body), F.lit(0))


def _damage(w: Column) -> Column:
    return 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])


def cvss3_base_score(vector: Column | str) -> Column:
    """Base score of a CVSS 3.x vector; null when a base metric is missing."""
    vector = col(vector)
    changed = _metric(vector, "S") == "C"
    privileges = _metric(vector, "PR")
    fields = {name: _weight(_metric(vector, name), table) for name, table in V3_WEIGHTS.items()}
    fields["PR"] = F.when(changed, _weight(privileges, V3_PRIVILEGES["C"])).otherwise(
        _weight(privileges, V3_PRIVILEGES["U"])
    )
    fields["changed"] = F.when(_metric(vector, "S").isin("U", "C"), changed)

    def impact_of(s: Column) -> Column:
        return F.when(s["changed"], 7.52 * (s["iss"] - 0.029) - 3.25 * F.pow(s["iss"] - 0.02, F.lit(15))).otherwise(
            6.42 * s["iss"]
        )

    def score(s: Column) -> Column:
        total = s["impact"] + s["exploitability"]
        raw = F.least(F.when(s["changed"], 1.08 * total).otherwise(total), F.lit(10.0))
        # Round up to one decimal on the integer grid of 1e-5, as the 3.1 document defines it.
        rounded = F.ceil(F.round(raw * 100000).cast("long") / 10000) / 10
        known = s["changed"].isNotNull() & total.isNotNull()
        return F.when(known, F.when(s["impact"] <= 0, F.lit(0.0)).otherwise(rounded.cast("double")))

    def with_impact(w: Column) -> Column:
        staged = {
            "changed": w["changed"],
            "exploitability": 8.22 * w["AV"] * w["AC"] * w["PR"] * w["UI"],
            "iss": _damage(w),
        }
        return _bound(
            staged,
            lambda s: _bound(
                {"changed": s["changed"], "exploitability": s["exploitability"], "impact": impact_of(s)}, score
            ),
        )

    return F.when(vector.rlike("^CVSS:3[.][01]/"), _bound(fields, with_impact))


def cvss2_base_score(vector: Column | str) -> Column:
    """Base score of a CVSS 2 vector; null when a base metric is missing."""
    vector = col(vector)
    fields = {name: _weight(_metric(vector, name), table) for name, table in V2_WEIGHTS.items()}

    def score(s: Column) -> Column:
        factor = F.when(s["impact"] == 0, F.lit(0.0)).otherwise(F.lit(1.176))
        return F.round((0.6 * s["impact"] + 0.4 * s["exploitability"] - 1.5) * factor, 1)

    def with_impact(w: Column) -> Column:
        return _bound({"impact": 10.41 * _damage(w), "exploitability": 20 * w["AC"] * w["Au"] * w["AV"]}, score)

    return F.when(~vector.startswith("CVSS:"), _bound(fields, with_impact))


def cvss_base_score(vector: Column | str) -> Column:
    return F.coalesce(cvss3_base_score(vector), cvss2_base_score(vector))


def h1_to_hex(checksum: Column | str) -> Column:
    """Hex SHA-256 of an `h1:` lock checksum; null unless it decodes to 32 bytes."""
    checksum = col(checksum)
    raw = F.try_to_binary(F.substr(checksum, F.lit(4)), F.lit("base64"))
    return F.when(checksum.startswith("h1:") & (F.octet_length(raw) == 32), F.lower(F.hex(raw)))


def purl(module: Column | str, version: Column | str) -> Column:
    return F.concat(F.lit("pkg:golang/"), col(module), F.lit("@"), col(version))
