import re

import numpy as np
import pytest

from driftkit.llm import jaccard_join as J

from . import fixtures


def brute(rows):
    """Component of every key by comparing all pairs of shingle sets."""
    sets = []
    for key, text in rows:
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append((key, {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()))
    root = {k: k for k, _ in sets if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block": 3}, {"hot": 2, "most": 0}])
def test_components_equal_brute_force(spark, documents, options):
    found = sorted((tuple(r) for r in J.jaccard_classes(documents, **options).collect()), key=str)
    assert found == brute(fixtures.texts())


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in J.jaccard_classes(docs).collect()), key=str) == brute(rows)


def test_shared_passage_and_many_copies(spark):
    passage = " ".join(fixtures.words(7, 60))
    rows = [(k, passage + " " + " ".join(fixtures.words(1000 + k, 25 + k % 10))) for k in range(90)]
    base = fixtures.words(8, 80)
    rows += [(200 + k, " ".join([*base[: k % 70], f"w{k}", *base[k % 70 + 1 :]])) for k in range(90)]
    rows += [(400 + k, passage) for k in range(50)]
    found = J.jaccard_classes(fixtures.documents(spark, rows), hot=8, block=20).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_empty_table(nothing):
    assert J.jaccard_classes(nothing).collect() == []


def test_sets_that_link_share_a_signature():
    draw = np.random.default_rng(3)
    for _ in range(400):
        a = int(draw.integers(1, 300))
        x = np.unique(draw.integers(0, 1 << 63, a).astype(np.uint64))
        y = x.copy()
        while True:  # change features one by one as long as the sets still link
            z = np.unique(np.append(np.delete(y, draw.integers(0, len(y))), [] if draw.random() < 0.5 else draw.integers(0, 1 << 63, 1).astype(np.uint64))).astype(np.uint64)
            both = len(np.intersect1d(x, z))
            if not len(z) or 100 * both < 75 * (len(x) + len(z) - both):
                break
            y = z
        known = np.sort(draw.choice(x, len(x) // 3, replace=False))
        assert len(np.intersect1d(J.signatures(x), J.signatures(y)))
        assert len(np.intersect1d(J.signatures(x, J.among(x, known)), J.signatures(y, J.among(y, known))))


def test_sketches_never_rule_out_a_link():
    draw = np.random.default_rng(5)
    for n in (1, 5, 300, 5000):
        x = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[: 1 + 6 * len(x) // 7], draw.integers(0, 1 << 63, n // 9).astype(np.uint64))))
        a, b = J.sketch(x), J.sketch(y)
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(J.folded(a, size) ^ J.folded(b, size)).sum())
        assert differ <= len(np.setxor1d(x, y))
