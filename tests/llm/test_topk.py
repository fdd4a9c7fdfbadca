import math

from driftkit.llm.topk import top_k


def brute(rows, every, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        asked = {tuple(v) for i, v in good if i == q}
        scored = [(-sum(a * b for a, b in zip(v, w)), i) for v in asked for i, w in good if i != q and len(w) == len(v)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_equals_brute_force(spark):
    import random

    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(20)]) for i in range(150)]
    rows += [(i, [0.5] * 20) for i in range(200, 240)]  # ties
    rows += [(300, None), (301, [1.0] * 19 + [None]), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (None, [1.0] * 20), (400, [1.0] * 3)]
    rows += [(10, [draw.gauss(0, 1) for _ in range(20)]), (11, [0.25] * 3), (20, [3e4] * 20), (21, [-2e4] * 20)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, id int, v string, score int")
    for block, k in [(4096, 10), (16, 3), (7, 500)]:
        found = [tuple(r) for r in top_k(df, every=10, k=k, block=block).collect()]
        assert sorted(found) == brute(rows, 10, k)


def test_large_values_are_exact(spark):
    rows = [(i, [3e4 * (i + 1), 2e5, float(-i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df, every=10, k=4, block=8).collect()) == brute(rows, 10, 4)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
