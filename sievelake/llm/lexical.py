"""Best documents of each query by an integer term weighting, found through buckets of impact vectors of like length.

A document is the vector of its terms' impacts, a query the vector of its terms' weights, and a score their inner product;
only terms of the queries at hand make coordinates. Coordinates are scaled by the root of the term's weight on both sides.
Documents are dealt to buckets by the length of their vectors, and each task goes through its buckets from the longest on. For
a query and a bucket, Cauchy-Schwarz says whether anything in it can reach the query's k-th best score so far. If so, the
query's heaviest coordinates are taken until the rest alone can't reach it; documents with none of them are out, and of the
others each one's own remaining length bounds what its other coordinates can add. What survives is scored exactly, in integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.words import pieces
from sievelake.session import cut_lineage

#: A term, in UTF-8: letters and digits of ASCII, and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Queries are taken in blocks of about this many bytes of text; a task knows the terms of one block.
BLOCK_BYTES = 8 << 20
#: Length classes for each doubling, rows compared at once, and rows whose scores set the first thresholds.
CLASSES, CHUNK, SEEDS = 4, 8192, 4096
VECTORS = "doc long, n long, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, A to Z in lower case; null has none."""
    return TERM.findall((text or "").encode().lower())


class Queries(NamedTuple):
    """A block of queries over the terms that occur in it."""

    items: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]


class Corpus(NamedTuple):
    """What the weights depend on: documents with a term, all their terms, and each term's weight."""

    documents: int
    tokens: int
    weights: np.ndarray

    def length_factor(self, n: np.ndarray) -> np.ndarray:
        return 25 + (75 * n * self.documents) // self.tokens

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 8 * self.length_factor(n))


class Postings(NamedTuple):
    """Documents of a chunk, longest vector first: their entries by document, and by term."""

    doc: np.ndarray
    known: np.ndarray  # whether the document has a number
    square: np.ndarray  # squared length
    start: np.ndarray  # first entry of each document, and the end
    term: np.ndarray
    impact: np.ndarray
    by_term: np.ndarray  # entries in order of terms
    first: np.ndarray  # first of them of each term, and the end
    row: np.ndarray  # document of each entry


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _read(rows: list) -> Queries:
    vocabulary: dict[bytes, int] = {}
    terms, counts = [], []
    for _, text in rows:
        own = Counter(terms_of(text))
        terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in own], np.int64))
        counts.append(np.array([*own.values()], np.int64))
    return Queries([r[0] for r in rows], vocabulary, terms, counts)


def _blocks(queries: DataFrame, item: str, text: str) -> Iterator[Queries]:
    """All queries, block by block; a query is in the block that its hash names."""
    narrow = queries.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text"))
    size = narrow.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        rows = narrow.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        block = _read([(r.item, r.text) for r in rows])
        if block.vocabulary:
            yield block


def _vectors(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                own = Counter(terms_of(text))
                n.append(own.total())
                found = [(vocabulary[t], c) for t, c in own.items() if t in vocabulary]
                terms.append([t for t, _ in found])
                counts.append([c for _, c in found])
            columns = [batch.column("doc"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "terms", "counts"])

    return run


def _postings(batch: pa.RecordBatch, corpus: Corpus) -> Postings:
    n = batch.column("n").to_numpy()
    lists = batch.column("terms")
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), sizes)
    term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy().astype(np.int64)
    impact = corpus.impacts(n[row], tf)
    square = np.bincount(row, corpus.weights[term] * impact.astype(np.float64) ** 2, len(n))
    order = np.argsort(-square, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    entries = np.argsort(rank[row], kind="stable")
    term, impact, row = term[entries], impact[entries], rank[row][entries]
    by_term = np.argsort(term, kind="stable")
    first = np.searchsorted(term[by_term], np.arange(len(corpus.weights) + 1))
    doc = batch.column("doc")
    known = ~doc.is_null().to_numpy(zero_copy_only=False)
    doc = doc.fill_null(0).to_numpy()
    return Postings(doc[order], known[order], square[order], np.searchsorted(row, np.arange(len(n) + 1)), term, impact, by_term, first, row)


def _with_class(corpus: Corpus):
    """Adds each vector's length class, 0 for the longest that doubles can tell; vectors of length 0 score nothing and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, lists = batch.column("n").to_numpy(), batch.column("terms")
            row = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            impact = corpus.impacts(n[row], batch.column("counts").flatten().to_numpy().astype(np.int64))
            square = np.bincount(row, corpus.weights[lists.flatten().to_numpy()] * impact.astype(np.float64) ** 2, len(n))
            some = np.flatnonzero(square)
            classes = 1024 * CLASSES - np.floor(CLASSES / 2 * np.log2(square[some])).astype(np.int32)
            rest = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(classes, pa.int32())], [*rest.schema.names, "class"])

    return run


class Best:
    """The k best documents of every query so far, and the score that a further one must reach."""

    def __init__(self, queries: Queries, corpus: Corpus, k: int, floor: np.ndarray | None = None):
        self.k, self.queries, self.corpus = k, queries, corpus
        self.floor = np.ones(len(queries.items), np.int64) if floor is None else floor.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries.items]
        self.heavy = []
        for terms, counts in zip(queries.terms, queries.counts, strict=True):
            scaled = counts * np.sqrt(corpus.weights[terms])
            order = np.argsort(-scaled, kind="stable")
            rest = np.sqrt(np.append(np.cumsum(scaled[order][::-1] ** 2)[::-1], 0.0))  # length of what follows the first coordinates
            self.heavy.append((terms[order], counts[order], rest))

    def look(self, p: Postings) -> None:
        """Take up a chunk."""
        if not len(p.doc):
            return
        longest, lookup = math.sqrt(p.square[0]), np.zeros(len(self.corpus.weights), np.int64)
        for q, (terms, counts, rest) in enumerate(self.heavy):
            least = float(self.floor[q]) * (1 - 1e-9)
            if not len(terms) or rest[0] * longest < least:
                continue
            focus = int(np.argmax(rest * longest < least)) if rest[-1] * longest < least else len(terms)
            lists = [p.by_term[p.first[t] : p.first[t + 1]] for t in terms[:focus]]
            entries = np.concatenate(lists)
            each = np.repeat(np.arange(focus), [len(x) for x in lists])
            own = self.corpus.weights[terms[:focus]]
            rows, impact = p.row[entries], p.impact[entries].astype(np.float64)
            inner = np.bincount(rows, (counts[:focus] * own)[each] * impact, len(p.doc))
            seen = np.bincount(rows, own[each] * impact**2, len(p.doc))
            bound = inner + rest[focus] * np.sqrt(np.maximum(p.square * (1 + 1e-12) - seen, 0))
            alive = np.flatnonzero((seen > 0) & (bound >= least))
            if len(alive):
                lookup[terms] = counts * self.corpus.weights[terms]
                self.rescore(q, p, alive, lookup)
                lookup[terms] = 0

    def rescore(self, q: int, p: Postings, alive: np.ndarray, lookup: np.ndarray) -> None:
        sizes = p.start[alive + 1] - p.start[alive]
        ends = np.cumsum(sizes)
        entries = np.arange(ends[-1]) + np.repeat(p.start[alive] - ends + sizes, sizes)
        scores = np.add.reduceat(lookup[p.term[entries]] * p.impact[entries], ends - sizes)
        keep = scores >= self.floor[q]
        doc, known, score = (np.concatenate(x) for x in zip(self.found[q], (p.doc[alive][keep], p.known[alive][keep], scores[keep]), strict=True))
        order = np.lexsort((doc, ~known, -score))[: self.k]
        self.found[q] = doc[order], known[order], score[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], score[order[-1]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for q, (doc, known, score) in enumerate(self.found):
            if len(doc):
                columns = [pa.array([q] * len(doc), pa.int64()), pa.array([self.queries.items[q]] * len(doc), pa.int64()), pa.array(doc, mask=~known), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "item", "doc", "score"])


def _search(queries: Queries, corpus: Corpus, k: int, floor: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, corpus, k, floor)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                best.look(_postings(batch.slice(at, CHUNK), corpus))
        yield from best.rows()

    return run


def _of_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame | None:
    vectors = cut_lineage(docs.mapInArrow(_vectors(queries.vocabulary), VECTORS).filter("n > 0"))
    documents, tokens = vectors.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most as many as the block has terms
        df[r["t"]] = r["count"]
    corpus = Corpus(documents, tokens, np.array([weight(documents, int(x)) for x in df], np.int64))
    classed = vectors.mapInArrow(_with_class(corpus), f"{VECTORS}, class int")
    sizes = sorted((r["class"], r["count"]) for r in classed.groupBy("class").count().collect())
    parts = {c: -(-n // CHUNK) for c, n in sizes}
    number = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("class")] if parts else F.lit(1)
    bucket = classed.withColumn("part", F.pmod(F.xxhash64("doc", "n", "terms"), number))
    # Scores of some of the longest vectors; their k-th best is a bound from below, whichever they are.
    seeds, left = F.lit(False), SEEDS
    for c, n in sizes:
        if left <= 0:
            break
        take = min(parts[c], -(-left // CHUNK))
        seeds |= (F.col("class") == c) & (F.col("part") < take)
        left -= n * take // parts[c]
    found = "query long, item long, doc long, score long"
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    tops = bucket.filter(seeds).mapInArrow(_search(queries, corpus, k), found)
    floor = np.ones(len(queries.items), np.int64)
    for r in tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).collect():  # one number a query
        floor[r["query"]] = r["score"]
    dealt = bucket.repartition("class", "part").sortWithinPartitions("class", "part")
    tops = dealt.mapInArrow(_search(queries, corpus, k, floor), found)
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")


def best_documents(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The k best documents of every query row: item, rank (int, from 1), doc, score (long), scores above 0 only.

    Ids are integers. Equal scores go by ascending document number, null last. Repeated document rows are ranked each for
    itself, repeated query rows answered each for itself. A null or empty text has no terms: such a document is found by none
    and not counted, such a query finds nothing. Empty tables give no rows; other columns are not looked at. Queries are
    worked off in blocks of BLOCK_BYTES; of a block, its texts, its terms and one number a query are held in memory.
    """
    narrow = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    out = None
    for block in _blocks(queries, item, text):
        found = _of_block(narrow, block, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item long, rank int, doc long, score long")
