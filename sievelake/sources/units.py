"""Text records (units): reading, scoping, line splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.paths import glob_regex
from sievelake.functions.text import any_of, base_name, extension


def _suffix_glob(exts) -> str:
    names = [e.lstrip(".") for e in exts]
    return "*.{" + ",".join(names) + "}" if len(names) > 1 else f"*.{names[0]}"


def read_units(
    spark: SparkSession,
    path: str,
    exts=(),
    max_bytes: int | None = None,
) -> DataFrame:
    """Files below `path` as UNIT rows; files that cannot be read are skipped.

    A size limit, where one is given, is pushed into the file listing through the
    `length` column, so an oversized file is never opened.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
    )
    if exts:
        reader = reader.option("pathGlobFilter", _suffix_glob(exts))
    files = reader.load(path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    root = path.rstrip("/") + "/"
    relative = F.regexp_replace("path", f"^(file:/*)?{_quoted(root)}", "")
    return files.select(
        relative.alias("record_id"),
        F.lit("files").alias("source"),
        relative.alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.col("length").alias("n_bytes"),
    )


def read_lines(spark: SparkSession, path: str, exts=(), max_bytes: int | None = None, parts: bool = False) -> DataFrame:
    """Lines of the files below `path` as LINE rows (record_id, path, line_no, line), a file of any size in many tasks.

    Spark cuts files into byte ranges and gives each line to the range that it begins in. Lines of a range are numbered as
    they come; a first pass counts each range, and the counts of the ranges before it in the file are added. That table has one
    row for each range, so it is sent to the lines where Spark finds it small enough. Lines end with a line feed; one at the end
    of a file ends its last line. Files that cannot be read are skipped, as are files over `max_bytes`, unopened.

    With `parts` a folder of part files, as Spark writes one, is one file: lines are numbered through its parts in the order of
    their numbers, and `path` is the folder's. So a file that grows is written by more tasks, too.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("lineSep", "\n")
    if exts:
        reader = reader.option("pathGlobFilter", _suffix_glob(exts))
    files = reader.text(path)
    if max_bytes is not None:
        files = files.filter(F.col("_metadata.file_size") <= max_bytes)
    # Numbers grow by one from row to row of a task, and a task reads its ranges one after the other.
    raw = files.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value"))
    ranges = raw.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    folder = F.regexp_replace("_file", "/[^/]*$", "")
    # Part numbers have leading zeros up to five digits; longer ones make longer names.
    earlier = Window.partitionBy(folder if parts else F.col("_file")).orderBy(F.length("_file"), "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_file", "_start", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"))
    root = path.rstrip("/") + "/"
    relative = F.regexp_replace(folder if parts else F.col("_file"), f"^(file:/*)?{_quoted(root)}", "")
    return raw.join(offsets, ["_file", "_start"]).select(
        relative.alias("record_id"), relative.alias("path"), (F.col("_id") + F.col("_offset") + 1).cast("int").alias("line_no"), F.make_valid_utf8("value").alias("line")
    )


def _quoted(root: str) -> str:
    return "(/|)" + any_of([root.lstrip("/")])


def table_units(df: DataFrame, source: str, key: Column, text: str, path: Column | None = None) -> DataFrame:
    """Rows of a text table as UNIT rows, one per row."""
    record_id = F.concat(F.lit(source + "/"), key.cast("string"))
    return df.select(
        record_id.alias("record_id"),
        F.lit(source).alias("source"),
        (record_id if path is None else path).alias("path"),
        F.col(text).alias("text"),
        F.octet_length(F.col(text)).cast("bigint").alias("n_bytes"),
    )


def filter_scope(
    df: DataFrame,
    exts=(),
    exclude_dirs=(),
    exclude_globs=(),
    include_tests: bool = False,
    max_bytes: int | None = None,
    path: str = "path",
    size: str = "n_bytes",
) -> DataFrame:
    """Keep records inside the scan scope. A single filter on path and size.

    Globs that end in '/' name folders; others are matched on the base name.
    """
    p = F.col(path)
    folder_globs = [g[:-1] for g in exclude_globs if g.endswith("/")]
    file_globs = [g for g in exclude_globs if not g.endswith("/")]
    folders = [d.lower() for d in (*fv.DEFAULT_EXCLUDED_DIRS, *exclude_dirs, *folder_globs)]
    keep = F.lit(True) if max_bytes is None else F.col(size) <= max_bytes
    keep = keep & ~F.lower(p).rlike(f"(^|/)({any_of(folders)})/")
    for glob in file_globs:
        keep = keep & ~base_name(p).rlike(f"^{glob_regex(glob)}$")
    if not include_tests:
        keep = keep & ~p.endswith(fv.TEST_FILE_SUFFIX) & ~p.rlike(f"(^|/)({any_of(fv.TEST_DIR_SEGMENTS)})(/|$)")
    if exts:
        keep = keep & extension(p).isin([e.lower() for e in exts])
    return df.filter(keep)


def tracked_only(
    df: DataFrame,
    manifest: DataFrame | None,
    include_untracked: bool = False,
    path: str = "path",
) -> DataFrame:
    """Keep records listed in the manifest; without a usable manifest keep all."""
    if include_untracked or manifest is None or manifest.isEmpty():
        return df
    return df.join(manifest.select(path).distinct(), path, "left_semi")


def to_lines(units: DataFrame, keep=()) -> DataFrame:
    """One row per line, numbered from 1, with the columns to `keep`. A narrow step: no shuffle."""
    return units.select(
        "record_id",
        "path",
        F.posexplode(F.split("text", "\n")).alias("_pos", "line"),
        *keep,
    ).select("record_id", "path", (F.col("_pos") + 1).alias("line_no"), "line", *keep)
