import zlib

import numpy as np

from driftkit.llm import quality as Q


def test_isotonic_by_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(30):
        y, w = draw.random(12), draw.integers(1, 5, 12).astype(float)
        got = Q.isotonic(y, w)
        # the largest of the smallest means of the intervals around a place
        means = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
        expected = [max(min(means(a, b) for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
        assert np.allclose(got, expected)


def test_summed_equations_give_the_ridge_solution(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, len(Q.STATISTICS))).astype(np.float32)
    y = (x[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(k, [float(v) for v in r], int(t)) for k, (r, t) in enumerate(zip(x, y))], "doc_id long, x array<float>, y int")
    model = Q.fit(rows.repartition(7))
    taught = rows.withColumn("h", Q.F.pmod(Q.F.xxhash64("doc_id", "x"), Q.F.lit(1 << 20))).filter("h % 5 <> 0").toPandas()
    z = model.features(np.stack(taught["x"].to_list()).astype(float))
    weights = np.linalg.solve(z.T @ z + 1e-3 * len(z) * np.eye(z.shape[1]) / 256, z.T @ taught["y"].to_numpy(float))
    assert np.allclose(weights, model.weights, atol=1e-6)
    assert np.mean((model.score(x.astype(float)) >= 0.5) == y) > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(scored) == docs.count()
    assert all(scored[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([scored[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.93
    kept = {r["doc_id"] for r in Q.good_documents(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, r in scored.items() if r["predicted"]}


def test_labels_of_the_held_fold_teach_nothing(spark, documents):
    labels = [(k, k % 2, 0, "x") for k in range(100, 220)]
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, t, x) for k, q, t, x in labels]
    schema = "doc_id long, quality int, toxic int, text string"
    a, b = (Q.quality_scores(documents, spark.createDataFrame(rows, schema)).collect() for rows in (labels, flipped))
    key = lambda r: (str(r["doc_id"]), round(r["score"], 9))
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_edge_cases(spark, documents, nothing):
    labels = spark.createDataFrame([(4, 0), (5, 0), (7, None), (None, 1), (9, 1), (9, 0)] + [(100 + k, 1) for k in range(50)], "doc_id long, quality int")
    found = Q.quality_scores(documents, labels).collect()
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert Q.quality_scores(nothing, labels).collect() == []
    untaught = Q.quality_scores(documents, labels.limit(0)).collect()
    assert {r["score"] for r in untaught} == {0.5}
    assert Q.good_documents(documents, labels).columns == documents.columns
