"""Merkle manifest: against a plain tree, in one run and in several, and on edge cases."""

import pytest
from pyspark.sql import functions as F

from sievelake.llm.merkle import RUN, height, proof_text, row_digest, verify

from . import brute

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(docs, changed):
    """Rows with their digest, climbing with another one where `changed` holds."""
    own = docs.withColumn("digest", row_digest([F.col(c) for c in FIELDS]))
    own = own.withColumn("given", F.when(changed, F.unhex(F.sha2(F.lit("x"), 256))).otherwise(F.col("digest")))
    climbed = verify(own, group="lang", order="doc_id", given="given")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return climbed.select(*docs.columns, text("digest"), text("given"), text("subroot"), text("root"), text("folded"), F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof"))


def plain(rows):
    """(doc_id, leaf, given) -> (subroot, root, folded, proof) of rows (fields, given or None)."""
    groups = {}
    for fields, given in rows:
        own = brute.leaf(*fields)
        groups.setdefault(fields[2], []).append((fields[0], own, given or own))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[n] = brute.tree([r[1] for r in groups[n]])
    over = brute.tree([trees[n][-1][0] for n in names])
    out = []
    for at, n in enumerate(names):
        for place, (doc_id, own, given) in enumerate(groups[n]):
            top, below = brute.climb(trees[n], place, given)
            folded, above = brute.climb(over, at, top)
            out.append((doc_id, own, given, trees[n][-1][0], over[-1][0], folded, brute.digest(*below, *above)))
    return out


def listed(df):
    return sorted(((r.doc_id, r.digest, r.given, r.subroot, r.root, r.folded, r.proof) for r in df.collect()), key=str)


def test_height():
    assert [height(n) for n in (0, 1, 2, 3, 4, 5, 4096, 4097)] == [0, 0, 1, 2, 2, 3, 12, 13]


@pytest.mark.parametrize("case", ["edge", "clashing"])
def test_edge_cases(spark, request, case):
    """Nulls in all columns, repeated rows, equal ids, very long texts, further columns."""
    docs = request.getfixturevalue(case)
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]
    wrong = brute.digest("x")
    got = manifest(docs, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    assert got.columns[: len(docs.columns)] == docs.columns
    assert listed(got) == sorted(plain([(r, wrong if r[0] is not None and r[0] % 3 == 0 else None) for r in rows]), key=str)
    if case == "clashing":
        assert {r["start"] for r in got.collect()} == {"start"}


def test_empty(empty):
    got = manifest(empty, F.lit(False))
    assert got.count() == 0 and "folded" in got.columns


@pytest.mark.parametrize("n", [1, 2, RUN, RUN + 1, 2 * RUN + 77])
def test_several_runs(spark, n):
    """A tree over more than one run climbs through stored nodes; its neighbours have a leaf each."""
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)] + [(n, None, None, None, None), (n + 1, "s", "é", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    fields = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    got = listed(manifest(docs, F.col("doc_id") % 1000 == 5))
    assert got == sorted(plain([(f, brute.digest("x") if f[0] % 1000 == 5 else None) for f in fields]), key=str)
    assert all((r[5] == r[4]) == (r[1] == r[2]) for r in got)
