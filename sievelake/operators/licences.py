"""Licences of texts: by how much of a text is known licence text, or by the phrases that name one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake import fixed_values as fv


def licence_id(text: Column) -> Column:
    """Most restrictive licence whose marker phrase occurs; null when unsure."""
    result = None
    for name, pattern in fv.LICENCE_MARKERS:
        hit = text.rlike(pattern)
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    # One cheap test lets texts without any licence wording skip the marker list.
    return F.when(text.rlike("(?i)licen[cs]e|CC BY|BSD"), result)


def _shingles(texts: DataFrame, words: int, place: str) -> DataFrame:
    """One row for each run of `words` words of a text, with its place and hash, and the number of words. Case and punctuation don't count."""
    found = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), F.array().cast("array<string>"))
    # A column of its own: inside the transform it would be worked out for every run.
    split = texts.withColumn("_words", found).withColumn("n_words", F.size("_words")).filter(F.col("n_words") >= words)
    runs = F.transform(F.sequence(F.lit(1), F.col("n_words") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_words", i, F.lit(words)), " ")))
    return split.select(*[c for c in texts.columns if c != "text"], "n_words", F.posexplode(runs).alias(place, "_hash"))


def license_coverage(units: DataFrame, licences: DataFrame, words: int = fv.LICENCE_SHINGLE, percent: int = fv.LICENCE_COVERAGE) -> DataFrame:
    """(record_id, path, licence, n_words, n_covered, span) of units that are known licence text to at least `percent`.

    `licences` has (licence, text), a text of any length and any number of texts for a licence. Runs of `words` words of
    the units meet those of the licences by equality, and stand on a diagonal: place in the unit less place in the licence.
    Consecutive places on a diagonal are one run of copied text. A unit is covered by the words of all its runs; its licence is
    that of the longest run, the first by name among equals. A unit that only mentions a licence stays below the share and
    is left out, as is one with fewer words than a shingle. Repeated units count once.
    """
    unit = ["record_id", "path", "_text"]
    own = _shingles(units.select("record_id", "path", F.xxhash64("text").alias("_text"), "text"), words, "_at")
    known = _shingles(licences.select("licence", "text"), words, "_place").drop("n_words")
    matched = own.join(known, "_hash").select(*unit, "n_words", "licence", "_at", (F.col("_at") - F.col("_place")).alias("_diagonal")).distinct()
    along = Window.partitionBy(*unit, "n_words", "licence", "_diagonal").orderBy("_at")
    numbered = matched.withColumn("_island", F.col("_at") - F.row_number().over(along))
    runs = numbered.groupBy(*unit, "n_words", "licence", "_diagonal", "_island").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_to", F.col("_from") + F.col("_n") + (words - 1))
    # Runs overlap; in order of their beginnings each adds the words behind the furthest end so far.
    earlier = Window.partitionBy(*unit, "n_words").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("_to") - F.greatest("_from", F.coalesce(F.max("_to").over(earlier), F.col("_from"))), F.lit(0))
    judged = (
        runs.withColumn("_fresh", fresh)
        .groupBy(*unit, "n_words")
        .agg(F.sum("_fresh").alias("n_covered"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("licence").alias("licence"))).alias("_best"))
    )
    sure = judged.filter(F.col("n_covered") * 100 >= F.col("n_words") * percent)
    return sure.select("record_id", "path", "_best.licence", F.col("n_words").cast("bigint").alias("n_words"), "n_covered", (words - 1 - F.col("_best.less")).alias("span"))


def license_inventory(units: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """(record_id, path, licence) for units whose licence is recognised: by the texts of licences where given, else by name."""
    if licences is not None:
        return license_coverage(units, licences).select("record_id", "path", "licence")
    return units.select("record_id", "path", licence_id(F.col("text")).alias("licence")).filter(
        F.col("licence").isNotNull()
    )


def license_counts(units: DataFrame) -> DataFrame:
    """Units per licence, with the unrecognised ones counted as 'unknown'."""
    licence = F.coalesce(licence_id(F.col("text")), F.lit("unknown"))
    return units.groupBy(licence.alias("licence")).agg(F.count(F.lit(1)).alias("n_units"))
