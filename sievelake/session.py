"""Session defaults and the checkpoint location shared by iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "sievelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` entries win.

    AQE coalesces shuffle partitions and splits skewed ones at run time, so the
    partition count is left to the cluster unless the caller fixes it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # Larger generated methods are not compiled by the JVM; Spark then splits them instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Call-site capture on every Column call makes building wide plans slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, else one below Spark's warehouse folder."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a written table or a stream log."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` below the shared folder and continue from the files.

    Later steps read files that outlive any executor. Unlike checkpoint(), the
    plan runs once, and the files bring their size into later join planning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut.scratch = path
    return cut


def forget(*cuts: DataFrame) -> None:
    """Delete the files of cut_lineage() results that no later step reads. Other DataFrames are left alone."""
    for cut in cuts:
        path = getattr(cut, "scratch", None)
        if path:
            jvm = cut.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(cut.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
