"""The manifest against trees built row by row in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftkit.llm.merkle import digest, folded, leaf_digest, manifest, proof_digest, verified_manifest, without_line_ends

from . import fixtures

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def build(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def path_of(levels, k, fanout):
    out = []
    for nodes in levels[:-1]:
        start = k // fanout * fanout
        run = nodes[start : start + fanout]
        out.append((run[: k - start], run[k - start + 1 :]))
        k //= fanout
    return out


def expected(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: build([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fanout) for s in order}
    top = build([trees[s][-1][0] for s in order], fanout)
    out = []
    for j, s in enumerate(order):
        for k, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = path_of(trees[s], k, fanout) + path_of(top, j, fanout)
            r = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                r["text"] = r["text"].replace("\n", "")
            own = leaf_of(r)
            for left, right in path:
                own = H(*left, own, *right)
            proof = H(*[d for left, right in path for d in left + right])
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], proof, own, own == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rows_with_everything_that_may_go_wrong(spark, documents):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source"))).repartition(5)
    docs = docs.withColumn("text", F.concat("text", F.lit("\n.")))
    rows = [r.asDict() for r in docs.collect()]
    out = verified_manifest(docs, without_line_ends(docs))
    want = expected(rows)
    assert got(out) == want
    verdicts = [r[-1] for r in want]
    assert any(verdicts) and not all(verdicts)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_trees_and_a_source_of_one(spark, n):
    rows = [(k, f"a\n{k}", "en", "é" if k == n else "b", k) for k in range(n + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(verified_manifest(docs, without_line_ends(docs))) == expected([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("fanout", [2, 5])
def test_other_fanouts_lead_to_the_root(spark, fanout):
    rows = [(k, f"t{k}", None, f"s{k % 4 * (k % 3)}", k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = manifest(docs, fanout=fanout)
    want = {r[0]: r for r in expected([r.asDict() for r in docs.collect()], fanout)}
    for r in made.rows.withColumn("proof", proof_digest()).withColumn("top", folded("leaf")).collect():
        assert (r["leaf"], r["subroot"], made.root, r["proof"], r["top"]) == (*want[r["doc_id"]][1:5], made.root)


def test_equal_rows_are_leaves_of_their_own(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)] * 50, "doc_id long, text string, lang string, source string, n_chars long")
    made = manifest(docs)
    assert sorted(r["node"] for r in made.rows.collect()) == list(range(50))
    assert made.root == build([leaf_of(docs.first().asDict())] * 50, 3)[-1][0]
    made.release()


def test_an_empty_table_has_no_root(nothing):
    assert manifest(nothing).root is None
    out = verified_manifest(nothing, without_line_ends(nothing))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_values_do_not_run_together(spark):
    row = spark.range(1).select(
        digest(F.lit("a"), F.lit(None).cast("string")).alias("a"), leaf_digest([F.lit("1"), F.lit("é")]).alias("b"),
        leaf_digest([F.lit("11:2"), F.lit(None).cast("string")]).alias("c"),
    ).first()
    assert tuple(row) == (H("a"), H("1:12:é"), H("4:11:2-"))


def test_levels_join_on_keys_that_are_unique(spark, documents):
    made = manifest(documents)
    plan = made.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join Inner, true" not in plan
    assert made.rows.groupBy("source", "node").count().filter("count > 1").isEmpty()
    assert fixtures.texts() and made.rows.count() == documents.count()
