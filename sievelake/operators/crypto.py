"""Plain HTTP addresses and weak hashes near sensitive names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.policies import name_has
from sievelake.functions.text import col
from sievelake.operators.groups import into_blocks

WEAK_CALL = r"(?i)(?<![A-Za-z0-9_])(md5|sha1|des|sha256)(\.[A-Za-z0-9]+)?[ \t]*\("


def scan_plain_http(df: DataFrame, value: str = "value", keep=()) -> DataFrame:
    """CRYPTO-PLAIN-HTTP on values with an http:// address, except local ones."""
    url = col(value)
    carried = [c for c in ("record_id", "path", "line_no", *keep) if c in df.columns]
    hits = df.filter(url.rlike(fv.PLAIN_HTTP_PATTERN) & ~url.rlike(fv.LOCAL_HTTP_PATTERN))
    return hits.select(
        F.lit("CRYPTO-PLAIN-HTTP").alias("rule_id"),
        F.lit("CRITICAL").alias("severity"),
        F.lit("4.2.1").alias("requirement_id"),
        F.lit("crypto").alias("scanner"),
        *carried,
        F.regexp_extract(url, r'http://[^\s"/?#]+', 0).alias("subject"),
        F.lit("Address is not encrypted in transit").alias("description"),
        F.lit("Use https").alias("suggestion"),
    )


def scan_weak_hash(lines: DataFrame, block: int = 4096) -> DataFrame:
    """CRYPTO-WEAK-HASH per weak call, CRITICAL when a sensitive name is within five lines.

    Every call of a line counts; quoted text and comments are neither calls nor names.
    Only lines with a call or a sensitive name are shuffled. Windows run on
    blocks of a record's lines, so one long record spreads over many tasks.
    """
    code = F.regexp_replace("line", fv.NOT_CODE, " ")
    # Cutting only takes words away, so lines without any of them need none of it.
    named = name_has(F.col("line"), ["md5", "sha1", "des", "sha256", *fv.HASH_CONTEXT_WORDS, *fv.SHA256_CONTEXT_WORDS])
    marked = lines.filter(named).select(
        "record_id",
        *[c for c in ("path",) if c in lines.columns],
        "line_no",
        F.transform(F.regexp_extract_all(code, F.lit(WEAK_CALL), 1), F.lower).alias("_algos"),
        name_has(code, fv.HASH_CONTEXT_WORDS).alias("_sensitive"),
        name_has(code, fv.SHA256_CONTEXT_WORDS).alias("_password"),
    ).filter((F.size("_algos") > 0) | F.col("_sensitive") | F.col("_password"))
    reach = fv.HASH_PROXIMITY_LINES
    near = Window.partitionBy("record_id", "block").orderBy("line_no").rangeBetween(-reach, reach)
    calls = (
        into_blocks(marked, "line_no", reach, block)
        .withColumn("_near", F.max("_sensitive").over(near))
        .withColumn("_near_password", F.max("_password").over(near))
        .filter("in_core")
        .withColumn("_algo", F.explode("_algos"))
        .filter((F.col("_algo") != "sha256") | F.col("_near_password"))
    )
    critical = F.when(F.col("_algo") == "sha256", F.col("_near_password")).otherwise(F.col("_near"))
    return calls.select(
        F.lit("CRYPTO-WEAK-HASH").alias("rule_id"),
        F.when(critical, F.lit("CRITICAL")).otherwise(F.lit("INFO")).alias("severity"),
        F.lit("6.2.4").alias("requirement_id"),
        F.lit("crypto").alias("scanner"),
        "record_id",
        *[c for c in ("path",) if c in lines.columns],
        "line_no",
        F.col("_algo").alias("subject"),
        F.lit("Weak or unsuitable hash").alias("description"),
        F.lit("Use SHA-256 or better for integrity and a password hash for passwords").alias("suggestion"),
    )
