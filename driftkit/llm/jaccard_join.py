"""N-gram Jaccard join by PartEnum signatures.

Sets whose sizes lie in one band share a partition of the feature domain. A set
of ``a`` features differs from any set it may link to in at most
H(a) = (a + 4a/3) / 7 features (at 0.75), so at most H(a) of its non-empty
partitions differ: among the first H(a) + 1 of them, taken in one global order,
is one that both sets hold alike. Of PartEnum's choices of (first-level
partitions, subsets of second-level ones) this is the one with the fewest
signatures: each enumerated subset is one second-level partition. A signature
is the content of a partition. Bands overlap, so that every pair that may link
lies in one band together.

No text is ever compared with all others:

* equal sets are one class, found by a key before anything else;
* features that repeat inside a block of documents have partitions of their
  own, ordered last, so that passages which many documents share sign nothing
  unless a set consists of them;
* a signature that more than ``hot`` classes share is taken out, and the
  classes under it are signed again, with the features that more than ``hot`` of
  these classes hold ordered last;
* the classes of a signature are compared with its smallest one only; after
  the links so found are joined into components, only members of different
  components are compared, in blocks where they are more than ``hot``.

Pairs whose parity bitmaps differ in more bits than their sets may differ in
features cannot link; the texts of the others are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, key_and_text, mix, stored
from .components import components

_STEP, _REACH = 4, 16 / 3  # a band holds sizes from 4^i to 4^i * 16/3
_MUL = np.uint64(0x9E3779B97F4A7C15)
_FEW_BITS, _MOST_BITS = 1 << 10, 1 << 17
BLOCK, OFTEN = 2_000_000, 3


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit values; none for a text without words.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text
    of fewer than ``size`` words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _MUL + h[j : len(h) - n + 1 + j]
    return np.unique(mix(out, n))


def differing(a: int) -> int:
    """The most features in which a set of ``a`` can differ from one that it links to at 0.75."""
    return (a + 4 * a // 3) // 7


def bands(a: int) -> list[int]:
    """The bands of a set of ``a`` features: its own, and the one below if a smaller partner may lie there."""
    i = (a.bit_length() - 1) // 2
    return [i, i - 1] if i and 3 * a <= 4 * _STEP**i else [i]


def signatures(features: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """PartEnum signatures of a set; ``common`` marks the features whose partitions come last."""
    a = len(features)
    if not a:
        return np.empty(0, np.uint64)
    need, out = differing(a) + 1, []
    for i in bands(a):
        parts = np.uint64(3 * _STEP**i)
        part = ((mix(features, 100 + i) >> np.uint64(32)) * parts) >> np.uint64(32)
        if common is not None:
            part = part + parts * common
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        content = np.add.reduceat(mix(features, 200 + i)[order], starts)
        out.append(mix(content + part[starts] * _MUL, 300 + i)[:need])
        if len(starts) < need:  # too few partitions hold anything: the features themselves, too
            out.append(mix(np.sort(mix(features, 400))[:need], 500 + i))
    return np.concatenate(out)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    """Size and key of every set; also the features found ``OFTEN`` times or more in a block of different sets."""
    seen: set[bytes] = set()
    block, held = [], 0

    def repeated() -> dict:
        nonlocal block, held
        f, n = np.unique(np.concatenate(block), return_counts=True)
        block, held = [], 0
        often = n >= OFTEN
        return {
            "doc_id": [None], "n_shingles": [None], "high": [None], "low": [None],
            "features": [f[often].view(np.int64)], "times": [n[often].astype(np.int32)],
        }

    for batch in batches:
        ids, sizes, highs, lows = batch.column(0).to_pylist(), [], [], []
        for text in batch.column(1).to_pylist():
            features = shingles(text)
            key = xxhash.xxh3_128_digest(features.tobytes())
            high, low = np.frombuffer(key, np.int64).tolist()
            sizes.append(len(features))
            highs.append(high)
            lows.append(low)
            if key not in seen:
                seen.add(key)
                block.append(features)
                held += len(features)
                if held > BLOCK:
                    yield repeated()
        none = [None] * len(ids)
        yield {"doc_id": ids, "n_shingles": sizes, "high": highs, "low": lows, "features": none, "times": none}
    if block:
        yield repeated()


def _signed(common):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, signed = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                features = shingles(text)
                key = xxhash.xxh3_128_digest(features.tobytes())
                if not len(features) or key in seen:  # equal sets met earlier in this task say nothing new
                    continue
                seen.add(key)
                ids.append(doc)
                signed.append(signatures(features, among(features, common.value)).view(np.int64))
            yield {"doc_id": ids, "sigs": signed}

    return work


def among(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 for the features that the sorted array ``known`` holds, else 0."""
    if not len(known):
        return np.zeros(len(features), np.uint64)
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    return (known[at] == features).astype(np.uint64)


def sketch(features: np.ndarray) -> bytes:
    """The parity of the features in each of some buckets: sets that differ in d features differ in d bits at most.

    About four buckets a feature, a power of two; a long sketch folds into a short one.
    """
    bits = min(_MOST_BITS, max(_FEW_BITS, 1 << (4 * len(features) - 1).bit_length()))
    return np.packbits(np.bincount((mix(features, 600) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes from one that is as long or longer."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _may_differ(both):
    """The most features in which two linked sets of ``both`` features together differ."""
    return both - 2 * -(-3 * both // 7)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        yield {
            "rep": batch.column(0), "text": batch.column(1), "warm": batch.column(2),
            "size": [len(f) for f in sets], "bits": [sketch(f) for f in sets],
        }


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    for batch in batches:
        yield {"features": [shingles(t).view(np.int64) for t in batch.column(0).to_pylist()]}


def _resigned(common):
    """Signs with the features ``common`` last: a sorted array that is broadcast, or else a column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns[2:]]
            for row in zip(*columns):
                f = shingles(row[0])
                known = common.value if common is not None else np.sort(np.array(row[1] or [], np.int64).view(np.uint64))
                out.append(signatures(f, among(f, known)).view(np.int64))
            yield {"rep": batch.column(0), "size": batch.column(1), "sigs": out}

    return work


def _near(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    for batch in batches:
        a, b, sa, sb = (np.asarray(c) for c in batch.columns[:4])
        keep = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            size = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
            keep[k] = differ <= _may_differ(int(sa[k]) + int(sb[k]))
        yield {"a": a[keep], "b": b[keep]}


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    """Pairs of different components whose sketches may link, group by group of rows sorted by group.

    A group is a pair of blocks of one signature's classes; nothing but the pairs that pass is given out.
    """
    held: list[tuple] = []

    def pairs() -> dict:
        reps, sizes, components = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        sides = np.array([r[4] for r in held])
        size = min(len(r[5]) for r in held)
        bits = np.stack([folded(r[5], size) for r in held]).view(np.uint64)
        left = np.flatnonzero(sides != 1)
        right = np.flatnonzero(sides != 0)
        names, counts = np.unique(components, return_counts=True)
        main = names[counts.argmax()]
        found = []
        for i in left:
            # a pair with a member of the main component is looked at from the other side
            if components[i] == main and (sides == 2).all():
                continue
            both = sizes[i] + sizes[right]
            differ = np.bitwise_count(bits[right] ^ bits[i]).sum(1, dtype=np.int64)
            good = (components[right] != components[i]) & (differ <= _may_differ(both))
            good &= 4 * np.minimum(sizes[right], sizes[i]) >= 3 * np.maximum(sizes[right], sizes[i])
            found += [(min(reps[i], r), max(reps[i], r)) for r in reps[right[good]]]
        found = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return {"a": found[:, 0], "b": found[:, 1]}

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield pairs()
                held = []
            held.append(row)
    if held:
        yield pairs()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = shingles(x.as_py()), shingles(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = 100 * both >= 75 * (len(x) + len(y) - both)
        yield {"a": batch.column(0).filter(pa.array(keep)), "b": batch.column(1).filter(pa.array(keep))}


def _grouped(signed: DataFrame) -> DataFrame:
    """(``sig``, ``rep``, ``n``: classes of the signature) of signatures with two classes at least."""
    every = Window.partitionBy("sig")
    return signed.withColumn("n", F.count("*").over(every)).filter("n > 1")


def _side(reps: DataFrame, key: str, *columns: str) -> DataFrame:
    return reps.select(F.col("rep").alias(key), *[F.col(c).alias(key + c) for c in columns])


def _sketches_near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sizes and sketches allow a link."""
    near = pairs.join(_side(reps, "a", "size", "bits"), "a").join(_side(reps, "b", "size", "bits"), "b")
    near = near.filter(_may_link("asize", "bsize")).select("a", "b", "asize", "bsize", "abits", "bbits")
    return by_batch(near, "a long, b long", _near)


def _in_blocks(members: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """The same for all pairs of different components within each group of ``members``, block by block."""
    rows = members.join(reps.select("rep", "bits"), "rep").withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).select("*", other.alias("other"))
    rows = rows.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
    group = F.concat_ws(":", "sig", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(group.alias("g"), "rep", "size", "component", "side", "bits")
    return by_batch(rows.repartition("g").sortWithinPartitions("g"), "a long, b long", _compared)


def _verified(near: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs ``near`` that link, by their texts."""
    near = stored(near.distinct(), "near")
    texts = near.join(_side(reps, "a", "text"), "a").join(_side(reps, "b", "text"), "b")
    return stored(by_batch(texts.select("a", "b", "atext", "btext"), "a long, b long", _linked), "linked")


def _may_link(a: str, b: str):
    return F.expr(f"4 * least({a}, {b}) >= 3 * greatest({a}, {b})")


def _refined(warm: DataFrame, hot: int, most: int) -> DataFrame:
    """Signature groups of the classes ``warm`` (``rep``, ``size``, ``text``) alone, their common features last."""
    listed = by_batch(warm.select("text"), "features array<long>", _listed).select(F.explode("features").alias("f"))
    common = stored(listed.groupBy("f").count().filter(F.col("count") > hot).select("f"), "common")
    schema = "rep long, size int, sigs array<long>"
    if common.count() <= most:
        held = np.sort(common.toPandas()["f"].to_numpy(np.int64).view(np.uint64))
        shared = warm.sparkSession.sparkContext.broadcast(held)
        signed = by_batch(warm.select("rep", "size", "text"), schema, _resigned(shared))
    else:
        every = by_batch(warm.select("rep", "size", "text"), "rep long, size int, text string, features array<long>", _with_features)
        own = every.select("rep", F.explode("features").alias("f")).join(common, "f").groupBy("rep").agg(F.collect_list("f").alias("common"))
        signed = by_batch(warm.select("rep", "size", "text").join(own, "rep", "left"), schema, _resigned(None))
    return _grouped(signed.select(F.explode("sigs").alias("sig"), "rep", "size").distinct())


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    for batch in batches:
        sets = [shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
        yield {"rep": batch.column(0), "size": batch.column(1), "text": batch.column(2), "features": sets}


def jaccard_classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = 64, most: int = 1 << 19, block: int = 4096
) -> DataFrame:
    """One row per document: (``doc_id``, ``n_shingles``, ``component_id``).

    Two documents link when 100 * intersection >= 75 * union of their shingle
    sets; ``component_id`` is the smallest doc_id reachable by links. Null and
    empty texts have 0 shingles and form components of their own. A row with a
    null key keeps a null component, links nothing and is never a
    representative. Rows with equal keys but different texts are told apart by
    nothing else, so they are one node that links by any of its texts.
    ``hot`` only decides which signatures are refined, never what is found.
    Neither does ``most``: the ``most`` features repeated oftenest (8 bytes
    each) are broadcast, for any choice of features ordered last gives the same
    links; above it the common features of refined classes are joined.
    """
    docs = key_and_text(df, key, text)
    schema = "doc_id long, n_shingles int, high long, low long, features array<long>, times array<int>"
    read = stored(by_batch(docs, schema, _sized), "sets")
    sized = read.filter("n_shingles is not null").select("doc_id", "n_shingles", "high", "low")
    known = sized.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    nodes = known.select("doc_id", "high", "low").distinct().join(classes, ["high", "low"])
    nodes = stored(nodes.select("doc_id", "rep", "size"), "classes")
    times = read.select(F.inline(F.arrays_zip("features", "times"))).groupBy("features").agg(F.sum("times").alias("n"))
    often = times.orderBy(F.desc("n"), "features").limit(most).toPandas()["features"]
    shared = df.sparkSession.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(np.uint64)))

    keyed = docs.filter("doc_id is not null and text is not null")
    signed = by_batch(keyed, "doc_id long, sigs array<long>", _signed(shared)).select("doc_id", F.explode("sigs").alias("sig"))
    several = stored(_grouped(signed).select("sig", "doc_id"), "several")
    groups = several.join(nodes, "doc_id").select("sig", "rep", "size").distinct()
    groups = stored(_grouped(groups), "groups")

    involved = groups.groupBy(F.col("rep").alias("doc_id")).agg((F.max("n") > hot).alias("warm"))
    chosen = keyed.join(involved, "doc_id").select("doc_id", "text", "warm")
    reps = stored(by_batch(chosen, "rep long, text string, warm boolean, size int, bits binary", _sketched), "reps")
    if not known.groupBy("doc_id").count().filter("count > 1").isEmpty():  # else every class has one row
        reps = stored(reps.dropDuplicates(["rep", "size", "bits"]), "reps")
    warm = reps.filter("warm").select("rep", "size", "text")
    refined = stored(_refined(warm, hot, most).select("sig", "rep", "size"), "refined")
    groups = groups.filter(F.col("n") <= hot).select("sig", "rep", "size").unionByName(refined)

    centre = groups.withColumn("a", F.min("rep").over(Window.partitionBy("sig")))
    stars = stored(centre.select("a", F.col("rep").alias("b")).filter("a <> b").distinct(), "stars")
    links = _verified(_sketches_near(stars, reps), reps)

    first = components(links)
    members = groups.join(first.withColumnRenamed("id", "rep"), "rep", "left")
    members = members.withColumn("component", F.coalesce("component", "rep"))
    every = Window.partitionBy("sig")
    members = members.withColumn("low", F.min("component").over(every)).withColumn("high", F.max("component").over(every))
    members = members.withColumn("n", F.count("*").over(every)).filter("low <> high")
    members = stored(members.select("sig", "rep", "size", "component", "n"), "members")
    few = members.filter(F.col("n") <= hot).select("sig", "rep", "size", "component")
    left, right = few.toDF("sig", "a", "sa", "ca"), few.toDF("sig", "b", "sb", "cb")
    rest = left.join(right, "sig").filter("a < b and ca <> cb").filter(_may_link("sa", "sb")).select("a", "b").distinct()
    rest = _sketches_near(rest.join(stars, ["a", "b"], "left_anti"), reps)
    many = _in_blocks(members.filter(F.col("n") > hot), reps, block)
    more = _verified(rest.union(many), reps)
    found = components(links.union(more).union(nodes.select("doc_id", "rep").filter("doc_id <> rep")))
    found = found.withColumnRenamed("id", "doc_id")
    out = sized.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
