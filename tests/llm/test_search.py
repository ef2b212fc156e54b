"""Ranked search: against plain scoring, with ties, repeated rows, nulls, and bounds that must not lose anything."""

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm.lexical import Best, Corpus, Queries, _postings, best_documents

from . import brute
from .conftest import PROSE


def ranked(df):
    return sorted(((r.item, r["rank"], r.doc, r.score) for r in df.collect()), key=str)


QUERIES = [(1, PROSE), (2, "fox FOX fox dog"), (3, None), (4, ""), (5, "nowhere to be found"), (None, "wise owls"), (2, "fox FOX fox dog"), (6, "über 日本語 w0x0 " * 50)]


@pytest.mark.parametrize("case", ["edge", "clashing"])
def test_edge_cases(spark, request, case):
    docs = request.getfixturevalue(case)
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k in (1, 3, 10):
        assert ranked(best_documents(docs, queries, k)) == sorted(brute.best_documents(pairs, QUERIES, k), key=str)


def test_empty(spark, edge, empty):
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    for docs, asked in ((empty, queries), (edge, queries.limit(0)), (empty, queries.limit(0)), (edge.filter("text IS NULL"), queries)):
        got = best_documents(docs, asked)
        assert got.columns == ["item", "rank", "doc", "score"] and got.count() == 0


def test_ties_over_many_copies(spark):
    """Three hundred copies score alike; the ten smallest ids win, wherever they stand."""
    rows = [(i, "red green blue") for i in range(300, 0, -1)] + [(1000 + i, f"red filler{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    queries = [(1, "green red"), (2, "filler7")]
    got = ranked(best_documents(docs, spark.createDataFrame(queries, "item_id long, text string")))
    assert got == sorted(brute.best_documents(rows, queries, 10), key=str)
    assert [r[2] for r in got if r[0] == 1] and {r[2] for r in got if r[0] == 1} == set(range(1, 11))


@pytest.mark.parametrize("seed", range(5))
def test_bounds_lose_nothing(seed):
    """Chunks of random vectors in any order of lengths give the same best rows as scoring everything."""
    rng = np.random.default_rng(seed)
    n_terms, n_docs, k = 40, 600, 7
    weights = rng.integers(0, 9000, n_terms)
    corpus = Corpus(n_docs, 30 * n_docs, weights)
    terms = [rng.choice(n_terms, rng.integers(0, 12), replace=False) for _ in range(n_docs)]
    counts = [rng.integers(1, 6, len(t)) for t in terms]
    n = rng.integers(1, 200, n_docs)
    asked = [rng.choice(n_terms, rng.integers(1, 15), replace=False) for _ in range(20)]
    queries = Queries([*range(20)], {}, asked, [rng.integers(1, 4, len(t)) for t in asked])
    best = Best(queries, corpus, k)
    for at in range(0, n_docs, 100):
        part = slice(at, at + 100)
        columns = [pa.array(np.arange(n_docs)[part]), pa.array(n[part]), pa.array([t.tolist() for t in terms[part]], pa.list_(pa.int32())), pa.array([c.tolist() for c in counts[part]], pa.list_(pa.int32()))]
        best.look(_postings(pa.RecordBatch.from_arrays(columns, ["doc", "n", "terms", "counts"]), corpus))
    for q in range(20):
        want = dict(zip(queries.terms[q].tolist(), queries.counts[q].tolist(), strict=True))
        scores = []
        for d in range(n_docs):
            impact = corpus.impacts(np.full(len(terms[d]), n[d]), counts[d])
            scores.append((-sum(want.get(t, 0) * int(weights[t]) * int(i) for t, i in zip(terms[d].tolist(), impact, strict=True)), d))
        right = [(d, -s) for s, d in sorted(scores)[:k] if s < 0]
        assert [*zip(best.found[q][0].tolist(), best.found[q][2].tolist(), strict=True)] == right
