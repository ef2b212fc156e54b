"""Documents to packed training sequences: quality rules, near-dedup, secret scans, mixing, packing.

Each stage takes what its predecessor kept, with the columns of documents, and all but the
last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import fresh, ship
from sievelake.llm.mixing import mix
from sievelake.llm.near_dups import near_duplicates
from sievelake.llm.packing import pack
from sievelake.llm.quality import ADDED, quality_rules
from sievelake.llm.queries import QUANTUM, SEQUENCE, WORD, domain_of, mix_weights, trusted_documents, vocabulary
from sievelake.llm.secrets import redacted, scan_secrets
from sievelake.session import scratch_path

#: Share of the tokens that is kept. No document is used twice, so small sources stay whole and only large ones are cut.
SHARE = 0.95


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Documents without columns of these names, and the way back to their own names."""
    taken = [c for c in docs.columns if c.lower() in names]
    renamed = {c: fresh(docs, f"own_{c.lower()}") for c in taken}
    return docs.withColumnsRenamed(renamed), {v: k for k, v in renamed.items()}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    plain, back = _apart(docs, *ADDED)
    return quality_rules(plain, trusted_documents(spark, sf_dir)).filter("kept").select(*plain.columns).withColumnsRenamed(back)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8. Of rows with one id, one stays; rows without id all stay."""
    ship(spark)
    judged = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    twice = left.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not twice.isEmpty():
        left = left.filter("doc_id IS NULL").unionByName(left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return left.select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that aren't widely copied examples are masked, and n_chars counts the new text."""
    ship(spark)
    found = scan_secrets(docs, repository=["source", "lang"], owner=["source"])
    found = found.filter(F.exists("verdicts", lambda v: v["verdict"] != "example")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("verdicts").alias("_verdicts")).distinct()
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_own_id"), text_hash.alias("_own_hash"))
    marked = whole.join(found, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left")
    doc, hit = F.col("_doc"), F.col("_verdicts").isNotNull()
    text = F.when(hit, redacted(doc["text"], F.col("_verdicts"))).otherwise(doc["text"])
    new = {"text": text, "n_chars": F.when(hit, F.length(text).cast("long")).otherwise(doc["n_chars"])}
    return marked.select(*[new.get(c, doc[c]).alias(c) for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under hierarchical budgets; one that a budget cuts stays whole."""
    ship(spark)
    plain, back = _apart(docs, "epoch", "take")
    tokens = fresh(plain, "_n_tokens")
    counted = plain.withColumn(tokens, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    levels = [domain_of(), F.col("lang"), F.col("source")]
    return mix(counted, levels, mix_weights(), SHARE, tokens=tokens, max_epochs=1).select(*plain.columns).withColumnsRenamed(back)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    ship(spark)
    packed = pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, window=SEQUENCE, quantum=QUANTUM)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: The likelihood ratio, components and token ids can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each result to the shared folder and reading it back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
