"""The registered queries and the pipeline over a whole small input."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sievelake.llm.near_dups import near_duplicates
from sievelake.llm.oracle import ORACLE
from sievelake.llm.queries import QUERIES, WORD

from . import brute
from .conftest import COLUMNS, edge_rows

TABLES = ("documents", "conversations", "labels", "benchmark", "pages")
BYTE, WORDS = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


@pytest.fixture(scope="module")
def texts(engine):
    return dict(engine.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, engine, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = engine.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_op1(spark, sf_dir, texts):
    rows = QUERIES["op1_secret_scan"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == {d: brute.secrets(t)[:4] for d, t in texts.items()}
    for r in rows:
        listed = set(filter(None, brute.secrets(texts[r.doc_id])[4].split(",")))
        assert listed <= set(r.spans.split(","))


def test_op2(spark, sf_dir, texts):
    rows = QUERIES["op2_pack"](spark, sf_dir).collect()
    sequences, padding = brute.check_packing(rows, {d: [t] for d, t in texts.items()}, BYTE)
    assert padding <= 5 * 1024


def test_op3(spark, sf_dir, texts, engine):
    rows = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, sf_dir).collect()}
    for d, t in texts.items():
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.measures(t)
        assert not (r.base_failed and r.kept)
    good = [d for (d,) in engine.execute("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0").fetchall()]
    assert all(rows[d].kept for d in good if not rows[d].base_failed)


def test_op6(spark, sf_dir, texts):
    for r in QUERIES["op6_gif"](spark, sf_dir).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes > 0 and r.feature


def test_op7(spark, sf_dir, engine):
    rows = QUERIES["op7_tool_calls"](spark, sf_dir).collect()
    turns = engine.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    calls = {(c, t): (r, x) for c, t, r, x in turns if r != "assistant"}
    results = {(c, t - 1) for c, t, r, _ in turns if r == "assistant"}
    assert len(rows) == len(set(calls) | results)
    for r in rows:
        if r.status == "orphan":
            continue
        place, depth = (r.conv_id, r.turn), 0
        while (r.conv_id, place[1] - 2) in calls:
            place, depth = (r.conv_id, place[1] - 2), depth + 1
        role, text = calls[r.conv_id, r.turn]
        tool = "fetch" if len(text) % 3 == 0 else "search" if role == "user" else "note"
        right = {"fetch": False, "search": role == "user" and 1 <= len(text) % 25 <= 20 and text != "", "note": len(text) <= 300}[tool]
        assert (r.depth, r.name, r.valid, r.status == "linked") == (depth, tool, right, (r.conv_id, r.turn) in results)


def test_op8(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in QUERIES["op8_coded_ids"](spark, sf_dir).collect()}
    at = 0
    for d, t in texts.items():
        ids = np.array([*WORDS.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op13(spark, sf_dir, engine):
    rows = {r.page_id: r for r in QUERIES["op13_main_text"](spark, sf_dir).collect()}
    pages = engine.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(rows) == len(pages)
    for page_id, url, page in pages:
        text = brute.article(page)
        assert (rows[page_id].url, rows[page_id].text, rows[page_id].n_chars) == (url, text, len(text))


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        kept[name], after = docs, spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or after.columns == docs.columns
        docs = after
    text_of = {name: {r.doc_id: r.text for r in df.collect()} for name, df in kept.items()}
    judged = brute.groups(list(text_of["near_dedup"].items()), 5)
    assert set(text_of["secret_scan"]) == {d for d, (_, low) in judged.items() if d == low}
    assert set(text_of["mixing"]) == set(text_of["secret_scan"])
    hidden = [d for d, t in text_of["secret_scan"].items() if brute.secrets(t)[4]]
    assert all(not brute.secrets(text_of["mixing"][d])[4] for d in hidden)
    same = [d for d in text_of["mixing"] if d not in hidden and "[SECRET]" not in (text_of["mixing"][d] or "")]
    assert all(text_of["mixing"][d] == text_of["secret_scan"][d] for d in same)
    brute.check_packing(docs.collect(), {d: [t] for d, t in text_of["packing"].items()}, BYTE)
    spent = sum(len(brute.WORD.findall(t or "")) for t in text_of["packing"].values())
    whole = sum(len(brute.WORD.findall(t or "")) for t in text_of["mixing"].values())
    assert spent >= corpus_pipeline.SHARE * whole - 40
    assert WORD == r"[^\x20\x09-\x0D]+" and near_duplicates


@pytest.mark.parametrize("case", ["edge", "clashing", "empty"])
def test_pipeline_stages_on_edge_cases(spark, tmp_path, request, case):
    docs = request.getfixturevalue(case)
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, 0), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    (labels if case != "empty" else labels.limit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert after.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        else:
            assert after.columns == docs.columns
            before = Counter((r[0], *r[5:]) for r in docs.collect())
            assert not Counter((r[0], *r[5:]) for r in after.collect()) - before and len(before) <= len(edge_rows())
        after.collect()
    assert docs.columns[:5] == [c.split()[0] for c in COLUMNS.split(", ")]
