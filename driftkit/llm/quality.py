"""Document quality from random Fourier features of document statistics.

cos(w x + b) with Gaussian w approximates a Gaussian kernel, so that a ridge
regression on these features is a kernel machine whose normal equations have a
fixed size: every partition sums its own, and the sums are added. Isotonic
regression on rows kept apart turns the ridge output into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fold, key_and_text, stored

STATISTICS = (
    "log_chars log_words word_length letters upper digits symbols bangs bars sentences commas breaks "
    "distinct_words repeated_neighbours top_word distinct_lines top_line plain_words long_words"
).split()
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{}~", np.uint8)
BINS = 4096


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    chars = float(n.sum() - n[0x80:0xC0].sum())
    upper, lower = n[65:91].sum(), n[97:123].sum()
    letters = upper + lower + n[0xC0:].sum()
    words, lines = text.split(), [x for x in text.split("\n") if x]
    count, lined = Counter(words), Counter(lines)
    w, k = max(1, len(words)), max(1, len(lines))
    return [
        np.log1p(chars), np.log1p(len(words)), chars / w, letters / chars, upper / max(1.0, upper + lower),
        n[48:58].sum() / chars, n[_SYMBOLS].sum() / chars, n[33] / w, n[124] / w, n[46] / w, n[44] / w, n[10] / w,
        np.log(w / max(1, len(count))), sum(map(eq, words, words[1:])) / w, max(count.values(), default=0) / w,
        len(lined) / k, max(lined.values(), default=0) / k, sum(map(str.isalpha, count)) / max(1, len(count)),
        sum(len(x) > 25 for x in count) / max(1, len(count)),
    ]


def _rated(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column(column).to_pylist()], np.float32).reshape(-1, len(STATISTICS))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    for batch in batches:
        yield {"doc_id": batch.column(0), "x": list(_rated(batch, 1))}


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``x``: the statistics) of every row."""
    return by_batch(key_and_text(df, key, text), "doc_id long, x array<float>", _statistics)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray  # ridge outputs, rising, and the probability at each
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        wave = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack((wave, np.ones((len(x), 1))))

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(self.steps):
            return np.full(len(x), 0.5)
        raw = self.ridge(x)
        # a thousandth of the raw order breaks ties inside a step
        return 0.999 * np.interp(raw, self.steps, self.levels) + 0.001 * np.clip((raw + 1) / 3, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, len(STATISTICS))


def _equations(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        model, total = shared.value, 0
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            total = total + np.hstack((z.T @ z, z.T @ np.asarray(batch.column(1), float)[:, None]))
        if not np.isscalar(total):
            yield {"i": np.arange(len(total), dtype=np.int32), "row": list(total)}

    return work


def _added(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": group["i"].iloc[:1], "row": [np.sum(np.stack(group["row"].to_list()), 0)]})


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising values closest to ``y``: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist()):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(rows: DataFrame, most: int = 50_000, waves: int = 256, ridge: float = 1e-3, seed: int = 11) -> Model:
    """The model of labelled rows (``doc_id``, ``x``, ``y`` 0 or 1).

    At most about ``most`` rows teach, drawn by a hash of the key and the
    statistics; of these, one in five is kept for the calibration. The normal
    equations are summed by partition and have ``waves`` + 1 rows however many
    rows teach. Without rows every score is 0.5.
    """
    spark = rows.sparkSession
    rows = rows.filter("y in (0, 1)").withColumn("h", F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 20)))
    share = most / max(1, rows.count())
    rows = stored(rows.filter(F.col("h") < int(min(1.0, share) * (1 << 20))), "labelled")
    teach, check = rows.filter("h % 5 <> 0"), rows.filter("h % 5 = 0")
    d = len(STATISTICS)
    moments = teach.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v"), F.stddev_pop("v")).collect()
    mean, spread = np.zeros(d), np.ones(d)
    for j, a, s in moments:
        mean[j], spread[j] = a, max(s, 1e-6)
    draw = np.random.default_rng(seed)
    frequencies, phases = draw.normal(0, 1 / np.sqrt(d), (d, waves)), draw.uniform(0, 2 * np.pi, waves)
    empty = Model(mean, spread, frequencies, phases, None, np.zeros(0), np.zeros(0))
    if not moments:
        return empty
    shared = spark.sparkContext.broadcast(empty)
    sums = by_batch(teach.select("x", "y"), "i int, row array<double>", _equations(shared))
    added = sums.groupBy("i").applyInPandas(_added, "i int, row array<double>").toPandas().sort_values("i")
    system = np.stack(added["row"].to_list())
    a, b = system[:, :-1], system[:, -1]
    n = a[-1, -1]
    weights = np.linalg.solve(a + ridge * n * np.eye(len(a)) / waves, b)
    fitted = Model(mean, spread, frequencies, phases, weights, np.zeros(0), np.zeros(0))
    bins = _binned(check, fitted)
    if not len(bins):
        bins = _binned(teach, fitted)
    levels = isotonic((bins["y"] / bins["n"]).to_numpy(), bins["n"].to_numpy(float))
    return Model(mean, spread, frequencies, phases, weights, bins["at"].to_numpy(float), levels)


def _binned(rows: DataFrame, model: Model) -> pd.DataFrame:
    """Rows and positives in at most ``BINS`` bins of the ridge output, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for batch in batches:
            out = np.clip(shared.value.ridge(_matrix(batch.column(0))), -1, 2)
            yield {"bin": np.round((out + 1) / 3 * (BINS - 1)).astype(np.int32), "y": np.asarray(batch.column(1), np.int32)}

    bins = by_batch(rows.select("x", "y"), "bin int, y int", work).groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    return bins.toPandas().sort_values("bin").assign(at=lambda t: t["bin"] / (BINS - 1) * 3 - 1)


def learned_quality(statistics: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """The model of the labels whose fold (crc32 of the key) is not ``held``; null labels and keys teach nothing."""
    taught = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y"))
    taught = taught.filter(fold("doc_id", folds) != held).filter("y is not null")
    return fit(statistics.join(taught, "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``, ``predicted``) of every document, from its whole text.

    Empty and null texts are scored by their statistics (all 0); repeated rows
    are scored alike; a null doc_id is not held out and teaches nothing.
    """
    known = stored(document_statistics(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(learned_quality(known, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for batch in batches:
            yield {"doc_id": batch.column(0), "score": shared.value.score(_matrix(batch.column(1)))}

    scored = by_batch(known, "doc_id long, score double", work)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``."""
    known = stored(document_statistics(docs, text=text), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(learned_quality(known, labels))
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            score = shared.value.score(_rated(batch, at).astype(float))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
