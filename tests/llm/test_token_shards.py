import os

import numpy as np
import sentencepiece

from driftkit.llm import token_shards as T
from driftkit.llm.queries import MODEL


def test_permutation():
    for size in (1, 2, 3, 10, 1000, 4097):
        assert sorted(T.permuted(np.arange(size), size, 7).tolist()) == list(range(size))
    assert not np.array_equal(T.permuted(np.arange(1000), 1000, 7), T.permuted(np.arange(1000), 1000, 8))
    assert abs(np.corrcoef(np.arange(10_000), T.permuted(np.arange(10_000), 10_000, 3))[0, 1]) < 0.05


def written(df, tmp_path, **options):
    index, folder, plan = T.write_shards(df, MODEL, str(tmp_path / "out"), length=64, shard_bytes=1 << 14, **options)
    return index.collect(), folder, plan


def test_round_trip(spark, documents, tmp_path):
    index, folder, plan = written(documents, tmp_path)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for row in documents.collect():
        ids = library.encode(row["text"]) + [2] if row["text"] else []
        expected += [(-1 if row["doc_id"] is None else row["doc_id"], k, tuple(ids[64 * k : 64 * k + 64])) for k in range(-(-len(ids) // 64))]
    read = []
    assert plan.shards > 3
    for shard in sorted({r["shard"] for r in index}):
        assert os.path.getsize(T.shard_path(folder, shard)) % plan.stride == 0
        read += [(d, c, tuple(t.tolist())) for d, c, t in T.read_from(folder, plan, shard)]
    assert sorted(read) == sorted(expected)
    # slots are dense, in the order of the shards, and any of them can be sought
    at = sorted(index, key=lambda r: r["slot"])
    assert [r["slot"] for r in at] == list(range(len(expected)))
    assert [(-1 if r["doc_id"] is None else r["doc_id"], r["chunk"], r["n_tokens"]) for r in at] == [(d, c, len(t)) for d, c, t in read]
    some = at[len(at) // 2]
    doc, chunk, _ = next(T.read_from(folder, plan, some["shard"], some["offset"] // plan.stride))
    assert (doc, chunk) == (-1 if some["doc_id"] is None else some["doc_id"], some["chunk"])
    assert not [f for f in os.listdir(folder) if not f.endswith(".bin")]


def test_order_depends_on_key_and_rows_only(spark, documents, tmp_path):
    key = lambda rows: sorted((r["slot"], str(r["doc_id"]), r["chunk"], r["tokens_crc"]) for r in rows)
    first = key(written(documents, tmp_path / "a")[0])
    assert first == key(written(documents.repartition(13, "text"), tmp_path / "b")[0])
    assert first != key(written(documents, tmp_path / "c", key=4)[0])


def test_empty_table(nothing, tmp_path):
    assert written(nothing, tmp_path)[0] == []
