"""Secrets in texts, and whether a value belongs to one owner or is an example that many have copied."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import group_key
from sievelake.llm.words import pieces
from sievelake.session import cut_lineage

#: Kinds in the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Other runs that may be credentials: long enough, of several kinds of characters, and not repetitive.
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ASSIGNED_LENGTH, BITS = 8, 3.0
#: Candidates in one letter case: hexadecimal, an identifier of 8-4-4-4-12 digits, a token with a known prefix,
#: or a run without separators that changes between letters and digits at least twice.
HEXADECIMAL = re.compile(r"[0-9A-F]+|[0-9a-f]+")
TOKEN_FORM = re.compile(r"(?<![A-Za-z0-9-])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9-])|xox[a-z]-)")
RUN, PARTS, MIXED_PARTS = re.compile(r"[A-Za-z0-9]{16,}"), re.compile(r"[0-9]+|[A-Za-z]+"), 3
#: A value in so many repositories or of so many owners is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 4


def looks_live(value: str, kind: int) -> bool:
    """Access keys by their form; other values by digits, letters and BITS of entropy of their characters.

    Paths and slugs are candidates too, but in one case and without the form of a token: their words and numbers stand apart.
    """
    if kind == 1:
        return True
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    if kind == 3 and (value.islower() or value.isupper()) and not (HEXADECIMAL.fullmatch(value) or TOKEN_FORM.search(value) or any(len(PARTS.findall(r)) >= MIXED_PARTS for r in RUN.findall(value))):
        return False
    n = len(value)
    return -sum(k / n * log2(k / n) for k in Counter(value).values()) >= BITS


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret value) of each base match."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED_LENGTH]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Credential-like runs that don't lie inside a base span."""
    out, at, covered = [], 0, 0
    for m in GENERIC.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            covered, at = max(covered, base[at][2]), at + 1
        if covered < m.end() and looks_live(m[0], 3):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def find_secrets(rows: DataFrame, kind: str) -> DataFrame:
    """Base results and all candidates of each row, in place of its _text."""
    carried = [c for c in rows.columns if c != "_text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
            for text in batch.column("_text").to_pylist():
                base = base_spans(text or "")
                for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[1] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans = base + candidates(text or "", base) if text else []
                out["found"].append([{"start": s[0], "kind": s[1], "end": s[2], "hash": hashlib.sha256(s[3].encode()).hexdigest(), "live": looks_live(s[3], s[1])} for s in spans])
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=[*carried, *out])

    return rows.mapInArrow(
        work,
        f"_key {kind}, _hash string, _repository string, _owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<start: int, kind: int, end: int, hash: string, live: boolean>>",
    )


def scan_secrets(df: DataFrame, repository: list[str], owner: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of each row, with the verdict on every value by who else has it.

    Base kinds are assigned values (`assign`), access keys (`access`) and long hexadecimal runs (`hex`);
    other runs that look like credentials are candidates. The hashes of all values are counted over the
    distinct repositories and owners (each the named columns together) they occur with. A value of
    EXAMPLE_OWNERS owners or EXAMPLE_REPOSITORIES repositories is an `example`; any other value that looks live is
    `live`; the rest is `plain`. Candidates that are live are spans of kind `owned`; base spans always stay.

    Returns the key, `text_hash`, `n_assign`, `n_access`, `n_hex`, `base_sha256`, `spans` (kind:start:end in code
    points by start, then kind), `n_live`, `n_example`, and `verdicts`, the spans with their verdicts. Only
    hashes leave the text.

    Null and empty texts have no spans. Null keys, repositories and owners are values like others. Rows
    equal in key and text are scanned alike, one result each. An empty table gives an empty one.
    Other columns are left out.
    """
    text_hash = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    rows = df.select(
        F.col(f"`{key}`").alias("_key"), text_hash.alias("_hash"), group_key(*repository).alias("_repository"), group_key(*owner).alias("_owner"), F.col(f"`{text}`").alias("_text")
    )
    found = cut_lineage(find_secrets(rows, dict(df.dtypes)[key]))
    row = ["_key", "_hash"]
    hits = found.filter(F.size("found") > 0).select(*row, "_repository", "_owner", F.explode("found").alias("one")).select(*row, "_repository", "_owner", "one.*")
    # Each repository's and owner's copies are reduced before they meet those of others.
    homes = hits.select("hash", "_repository", "_owner").distinct()
    spread = homes.groupBy("hash").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repository").alias("repositories"))
    examples = spread.filter((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)).select("hash", F.lit(True).alias("_example"))
    judged = hits.join(examples, "hash", "left").withColumn(
        "verdict", F.when(F.col("_example"), "example").when(F.col("live"), "live").otherwise("plain")
    )
    judged = judged.filter((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = judged.groupBy(*row).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "verdict"))).alias("verdicts"))
    spans = spans.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "verdicts")
    out = found.join(spans, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    verdicts = F.coalesce("verdicts", F.array().cast("array<struct<start: int, kind: int, end: int, verdict: string>>"))
    return out.withColumn("verdicts", verdicts).select(
        F.col("_key").alias(key),
        F.col("_hash").alias("text_hash"),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_join(F.transform("verdicts", _shown), ",").alias("spans"),
        F.size(F.filter("verdicts", lambda v: v["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("verdicts", lambda v: v["verdict"] == "example")).cast("long").alias("n_example"),
        "verdicts",
    )


def _shown(span: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat(names[span["kind"]], F.lit(":"), span["start"].cast("string"), F.lit(":"), span["end"].cast("string"))


def redacted(text: Column, verdicts: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span but the examples' replaced; overlapping spans are replaced as one."""
    hidden = F.filter(verdicts, lambda v: v["verdict"] != "example")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    walked = F.aggregate(
        hidden,
        state,
        lambda s, v: F.when(v["start"] >= s["at"], F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, v["start"] - s["at"]), F.lit(mask)).alias("out"), v["end"].alias("at"))).otherwise(
            F.struct(s["out"].alias("out"), F.greatest(s["at"], v["end"]).alias("at"))
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(hidden) > 0, walked).otherwise(text)
