"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import pick, ship
from sievelake.llm.gif import read_gifs, store_gifs
from sievelake.llm.idfiles import id_segments, read_ids
from sievelake.llm.lexical import best_documents
from sievelake.llm.main_text import extract_pages
from sievelake.llm.merkle import proof_text, row_digest, verify
from sievelake.llm.mixing import mix
from sievelake.llm.near_dups import near_duplicates
from sievelake.llm.packing import pack
from sievelake.llm.quality import quality_rules
from sievelake.llm.repeats import without_repeats
from sievelake.llm.secrets import scan_secrets
from sievelake.llm.sharding import interleave
from sievelake.llm.tools import link_calls
from sievelake.session import cut_lineage

#: Words are runs of characters other than space, tab and the line controls.
WORD = r"[^\x20\x09-\x0D]+"
SHARDS = 24
#: Packing: tokens of a sequence, and of the quanta that sources send.
SEQUENCE, QUANTUM = 1024, 32
#: Production mixture: share of all tokens, epochs a source may be repeated, and weights.
MIX_SHARE, MIX_EPOCHS = 0.9, 2
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "es": 2.0, "fr": 2.0}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    return pick(spark.read.parquet(f"{sf_dir}/{name}.parquet"), list(columns))


def domain_of(source: str = "source"):
    """Sources are dealt to four domains by the number that ends their name; others form a fifth."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string"))).otherwise(F.lit("other"))


def mix_weights() -> list:
    language = F.lit(1.0)
    for name, weight in LANGUAGE_WEIGHTS.items():
        language = F.when(F.col("level_2") == name, F.lit(weight)).otherwise(language)
    return [F.lit(1.0), language, F.lit(1.0)]


#: Tools that turns of conversations are read as calls of.
SCHEMAS = {
    "search": '{"type":"object","required":["query","limit"],"properties":{"query":{"type":"string","minLength":1},"limit":{"type":"integer","minimum":1,"maximum":20}},"additionalProperties":false}',
    "note": '{"type":"object","required":["text"],"properties":{"text":{"type":"string","maxLength":300},"tags":{"type":"array","items":{"type":"string"},"maxItems":8}}}',
}


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the package lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, and its documents in one language are a repository."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    found = scan_secrets(docs, repository=["source", "lang"], owner=["source"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    packed = pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, window=SEQUENCE, quantum=QUANTUM)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").filter("quality = 1 AND toxic = 0").select("doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"), trusted_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, percent=80)


def op5_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), n=20)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as grey animations in the shared folder, read back and looked at."""
    stored = cut_lineage(store_gifs(table(spark, sf_dir, "documents", "doc_id", "text")))
    shown = read_gifs(stored, channels=1)
    bins = F.transform("frames", lambda f: F.concat(f["delay_ms"].cast("string"), F.lit("ms "), f["height"].cast("string"), F.lit(" "), F.array_join(F.slice(f["histogram"], 1, 8), "/")))
    return shown.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(bins, ";").alias("feature"),
    )


def tool_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool calls and results: a user's turn is a search, a system's a note, an assistant's the result of the turn before.

    A call comes after the one two turns before it. Every third text in length is a call of a tool that no schema names.
    """
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    name_of = lambda t: F.concat_ws("-", F.lit("call"), "conv_id", t)
    search = F.to_json(F.struct((F.length(text) % 25).alias("limit"), text.alias("query")))
    note = F.to_json(F.struct(text.alias("text"), F.array(F.coalesce("role", F.lit("")), F.lit("turn")).alias("tags")))
    calls = conversations.filter("role IS NULL OR role != 'assistant'").select(
        "conv_id",
        "turn",
        name_of(turn).alias("call_id"),
        F.when(turn >= 2, name_of(turn - 2)).alias("after"),
        F.when(F.length(text) % 3 == 0, "fetch").when(F.col("role") == "user", "search").otherwise("note").alias("name"),
        F.when(F.col("role") == "user", search).otherwise(note).alias("arguments"),
    )
    results = conversations.filter("role = 'assistant'").select("conv_id", name_of(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_events(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    schemas = spark.createDataFrame([*SCHEMAS.items()], "name string, schema string")
    return link_calls(calls, results, schemas)


def op8_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to the shared folder as coded segments, and read back from there."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return read_ids(cut_lineage(id_segments(docs, vocabulary("word_bpe_49k.json"), end_id=2)))


def op9_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave(narrow, n_shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    counted = docs.select("doc_id", "lang", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    counted = cut_lineage(counted)
    levels = [domain_of(), F.col("lang"), F.col("source")]
    return mix(counted, levels, mix_weights(), MIX_SHARE, max_epochs=MIX_EPOCHS).select("doc_id", "lang", "source", "n_tokens", "epoch", "take")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a leaf of its language's tree; those whose number's CRC-32 is divisible by 7 climb with a changed n_chars."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    columns = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    tampered = F.when(changed & F.col("n_chars").isNotNull(), row_digest(columns(F.col("n_chars") + 1)))
    leaves = docs.select("doc_id", "lang", row_digest(columns(F.col("n_chars"))).alias("digest"), tampered.alias("changed"))
    leaves = leaves.withColumn("given", F.coalesce("changed", "digest")).drop("changed")
    climbed = verify(leaves, group="lang", order="doc_id", given="given")
    text = lambda name: F.lower(F.hex(name))
    return climbed.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = best_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pack": op2_pack,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_without_repeats": op5_without_repeats,
    "op6_gif": op6_gif,
    "op7_tool_calls": op7_tool_calls,
    "op8_coded_ids": op8_coded_ids,
    "op9_interleave": op9_interleave,
    "op10_mix": op10_mix,
    "op11_manifest": op11_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_main_text": op13_main_text,
}
