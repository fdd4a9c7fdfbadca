"""Token ids in training order, as binary shards of fixed stride.

Documents are encoded and cut into sequences. A keyed Feistel permutation over
all places a sequence can have (documents x chunks; a value outside walks the
cycle until it is inside) shuffles them: the order depends on the key, the ids
and the length only, not on how the table happens to be split. Ranges of
permuted places are partitions; each writes one shard, in order, records of one
size: a header and a padded sequence. The slot of a sequence is its shard's first
slot plus its position there, so a reader seeks to any slot and reads on.

A shard appears under its name only when it is complete, and writing it again
gives the same bytes, so tasks may fail, repeat or run twice.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, key_and_text, mix, scratch, stored
from .sentencepiece_codec import codec

#: doc_id, chunk, number of tokens; then the tokens, padded with 0.
HEADER = np.dtype([("doc_id", "<i8"), ("chunk", "<i4"), ("n", "<i4")])
ROUNDS = 6


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where the keyed permutation of 0 to ``size`` - 1 puts each index."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        x = out[walking]
        left, right = x >> np.uint64(half), x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right, (key * ROUNDS + r) & 0xFFFFFFFF) & low)
        out[walking] = left << np.uint64(half) | right
        walking = out >= np.uint64(size)
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """What a table's order depends on: the first id, how many ids and chunks there can be, the key, the shards."""

    first: int
    ids: int
    chunks: int
    key: int
    shards: int
    length: int
    wide: int

    @property
    def size(self) -> int:
        return self.ids * self.chunks

    @property
    def stride(self) -> int:
        return HEADER.itemsize + self.length * self.wide


def layout(docs: DataFrame, key: int, length: int, shard_bytes: int, wide: int = 2) -> Layout:
    """From the smallest and largest id and the longest text; a token takes a byte of text at least."""
    r = docs.agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"),
        F.max(F.octet_length("text")).alias("longest"), F.sum(F.octet_length("text")).alias("bytes"),
    ).first()
    first, last = r["a"] or 0, r["b"] or 0
    chunks = ((r["longest"] or 0) + 2) // length + 1
    shards = max(1, (r["bytes"] or 0) * wide // 2 // shard_bytes)
    made = Layout(first, last - first + 2, chunks, key, shards, length, wide)  # one place more, for null ids
    if made.size >= 1 << 62:
        raise ValueError("ids are spread too widely: number the documents first")
    return made


def _sequences(model, plan: Layout):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        own = codec(model.value, False)
        step = plan.length * plan.wide
        end = next((i for i, (p, _, _) in enumerate(own.spec.pieces) if p == "</s>"), 0).to_bytes(plan.wide, "little")
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids, chunks, tokens = [], [], []
                for doc, raw in zip(batch.column(0).to_pylist(), own.encode_batch(batch.column(1).to_pylist())):
                    if raw:
                        raw += end
                        parts = range(0, len(raw), step)
                        ids += [doc] * len(parts)
                        chunks += range(len(parts))
                        tokens += [raw[a : a + step] for a in parts]
                row = np.array([plan.ids - 1 if d is None else d - plan.first for d in ids], np.int64)
                place = permuted(row * plan.chunks + np.array(chunks, np.int64), plan.size, plan.key)
                shard = (place.astype(object) * plan.shards // plan.size).astype(np.int32) if len(place) else place.astype(np.int32)
                yield {"shard": shard, "place": place, "doc_id": ids, "chunk": chunks, "tokens": tokens}

    return work


def _written(folder: str, plan: Layout):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, out, name, position = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(name, shard_path(root, shard))

        for batch in batches:
            shards, _, ids, chunks, tokens = (c.to_pylist() for c in batch.columns)
            positions, checks = [], []
            for s, doc, chunk, raw in zip(shards, ids, chunks, tokens):
                if s != shard:
                    close()
                    shard, position = s, 0
                    name = f"{shard_path(root, s)}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                head = np.array([(doc if doc is not None else -1, chunk, len(raw) // plan.wide)], HEADER)
                out.write(head.tobytes() + raw.ljust(plan.length * plan.wide, b"\0"))
                positions.append(position)
                checks.append(zlib.crc32(raw))
                position += 1
            yield {
                "shard": shards, "position": positions, "doc_id": ids, "chunk": chunks,
                "n_tokens": [len(t) // plan.wide for t in tokens], "tokens_crc": checks,
            }
        close()

    return work


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:07d}.bin"


def write_shards(
    df: DataFrame, model: str, folder: str | None = None, key: int = 20, length: int = 512, shard_bytes: int = 32 << 20
) -> tuple[DataFrame, str, Layout]:
    """Writes all documents' sequences; returns the index of what was written, the folder and the layout.

    The index has a row per sequence: (``doc_id``, ``chunk``, ``slot``, ``shard``,
    ``offset`` in bytes, ``n_tokens``, ``tokens_crc``). Slots run from 0 without
    a gap. Null and empty texts have no sequence; a null doc_id is written as -1
    in the shard; rows with equal ids share places and stand next to each other,
    in the order of their tokens. An empty table writes nothing.
    """
    docs = key_and_text(df, "doc_id", "text")
    with open(model, "rb") as file:
        data = file.read()
    shared = df.sparkSession.sparkContext.broadcast(data)
    plan = layout(docs, key, length, shard_bytes, codec(data, False).wide.itemsize)
    folder = folder or scratch(df, "shards")
    rows = by_batch(docs, "shard int, place long, doc_id long, chunk int, tokens binary", _sequences(shared, plan))
    placed = rows.repartition(plan.shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "tokens")
    schema = "shard int, position long, doc_id long, chunk int, n_tokens int, tokens_crc long"
    index = stored(by_batch(placed, schema, _written(folder, plan)), "index")
    sizes = index.groupBy("shard").agg(F.count("*").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are shards
    firsts = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = index.join(firsts, "shard").select(
        "doc_id", "chunk", (F.col("first") + F.col("position")).alias("slot"), "shard",
        (F.col("position") * plan.stride).alias("offset"), "n_tokens", "tokens_crc",
    )
    return out, folder, plan


def read_from(folder: str, plan: Layout, shard: int, position: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, chunk, tokens) of a shard from a position on: a seek, then sequential reads."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(shard_path(root, shard)) as file:
        file.seek(position * plan.stride)
        while record := file.read(plan.stride):
            head = np.frombuffer(record, HEADER, 1)[0]
            tokens = np.frombuffer(record, f"<u{plan.wide}", int(head["n"]), HEADER.itemsize)
            yield int(head["doc_id"]), int(head["chunk"]), tokens
