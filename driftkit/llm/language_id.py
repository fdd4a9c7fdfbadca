"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter serves all languages: a slot holds one bit per language, an n-gram
sets the bits of its languages in ``HASHES`` slots, and the AND of those slots
is the set of languages that contain it. A text's n-grams give one count per
language; each is corrected for what the filter answers wrongly
(n * f / (1 - f), with f the chance of a false positive in that language) and
the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fold, key_and_text, mix, stored

SIZE, HASHES, CHUNK = 4, 3, 1 << 19
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, code point) of the padded lower-cased texts, in runs of about ``CHUNK`` characters.

    A text longer than a run goes on in the next with an overlap, so that each
    n-gram of it appears once.
    """
    which, parts, held = [], [], 0
    for k, text in enumerate(texts):
        text = f" {text.lower()} " if text else "  "
        for start in range(0, max(1, len(text) - SIZE + 1), CHUNK):
            part = text[start : start + CHUNK + SIZE - 1]
            which.append((k, len(part)))
            parts.append(part)
            held += len(part)
            if held >= CHUNK:
                yield _points(which, parts)
                which, parts, held = [], [], 0
    if parts:
        yield _points(which, parts)


def _points(which: list[tuple[int, int]], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    index, lengths = zip(*which)
    return np.repeat(index, lengths), points


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, n-gram as 64 bits) of all texts, and the indexes of the texts with a letter, run by run.

    What is no letter counts as a space; an n-gram holds no two spaces in a row.
    """
    for index, points in _pieces(texts):
        letter = _letters()[points]
        c = np.where(letter, points, 32).astype(np.uint64)
        n = len(c) - SIZE + 1
        if n <= 0:
            yield index[:0], c[:0], np.unique(index[letter])
            continue
        gap = (c[1:] == 32) & (c[:-1] == 32)
        good = index[:n] == index[SIZE - 1 :]
        for j in range(SIZE - 1):
            good &= ~gap[j : j + n]
        h = np.zeros(n, np.uint64)
        for j in range(SIZE):
            h = h * np.uint64(0x100000001B3) + c[j : j + n]
        yield index[:n][good], mix(h[good]), np.unique(index[letter])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def _counted(languages: list[str]):
    """Counts of n-grams by language, added up over a task; given out when ``CHUNK`` different ones are held."""
    number = {name: k for k, name in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        parts: dict[int, list] = {}
        waiting: dict[int, int] = {}

        def given(k: int) -> dict:
            grams, n = _summed(parts.pop(k))
            waiting.pop(k)
            return {"gram": grams.view(np.int64), "language": np.full(len(grams), k, np.int32), "n": n}

        for batch in batches:
            language = np.array([number[x] for x in batch.column(1).to_pylist()])
            for index, grams, _ in ngrams(batch.column(0).to_pylist()):
                of = language[index]
                for k in np.unique(of).tolist():
                    g, n = np.unique(grams[of == k], return_counts=True)
                    parts.setdefault(k, []).append((g, n))
                    waiting[k] = waiting.get(k, 0) + len(g)
                    if waiting[k] > CHUNK:
                        parts[k] = [_summed(parts[k])]
                        waiting[k] = len(parts[k][0][0])
                        if waiting[k] > CHUNK // 2:
                            yield given(k)
        for k in list(parts):
            yield given(k)

    return work


@dataclass(frozen=True)
class Filter:
    """``slots``: a mask of languages each; ``wrong``: chance of a false positive by language."""

    languages: tuple[str, ...]
    slots: np.ndarray
    wrong: np.ndarray
    order: tuple[int, ...]  # the languages by how many documents taught them, for ties

    def masks(self, grams: np.ndarray) -> np.ndarray:
        found = np.full(len(grams), -1, np.int64).view(np.uint64)
        for at in _places(grams, len(self.slots)):
            found &= self.slots[at]
        return found


def _places(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    for j in range(HASHES):
        yield (mix(grams, j + 1) & np.uint64(slots - 1)).astype(np.int64)


def learn(df: DataFrame, text: str = "text", language: str = "lang", least: float = 1e-5, foreign: float = 0.05) -> Filter:
    """The filter of all rows with a text and a language; 63 languages at most.

    An n-gram belongs to a language if it makes up ``least`` of the language's
    n-grams, and ``foreign`` of the largest share it has in any language: so the
    filter holds 1 / ``least`` n-grams a language at most, however large the
    table, and stray quotes teach little. Counts cover all rows; they are added
    up by task before the shuffle.
    """
    rows = df.select(df[text].cast("string").alias("text"), df[language].cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    taught = sorted((-r["count"], r["lang"]) for r in rows.groupBy("lang").count().collect())
    if len(taught) > 63:
        raise ValueError("more than 63 languages")
    languages = sorted(name for _, name in taught)
    if not languages:
        return Filter((), np.zeros(1, np.uint64), np.zeros(0), ())
    counts = by_batch(rows.select("text", "lang"), "gram long, language int, n long", _counted(languages))
    counts = counts.groupBy("gram", "language").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("language", "n")).alias("l"))
    by_gram = stored(by_gram, "grams")
    totals = by_gram.select(F.inline("l")).groupBy("language").agg(F.sum("n").alias("n")).collect()
    total = {r["language"]: r["n"] for r in totals}
    share = F.create_map(*[x for k, n in total.items() for x in (F.lit(k), F.lit(float(n)))]) if total else None
    if share is None:
        return Filter(tuple(languages), np.zeros(1, np.uint64), np.zeros(len(languages)), tuple(languages.index(x) for _, x in taught))
    rates = F.transform("l", lambda x: F.struct(x["language"].alias("k"), (x["n"] / share[x["language"]]).alias("r")))
    best = F.array_max(F.transform(rates, lambda x: x["r"]))
    good = F.filter(rates, lambda x: (x["r"] >= least) & (x["r"] >= foreign * best))
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(languages))]).cast("array<long>"), F.lit(1) + F.col("k"))
    kept = by_gram.select("gram", F.explode(good).alias("x")).select("gram", "x.k")
    rows = kept.groupBy("gram").agg(F.bit_or(bit).alias("mask")).toPandas()
    size = 1 << max(10, int(8 * len(rows)).bit_length())
    slots = np.zeros(size, np.uint64)
    for at in _places(rows["gram"].to_numpy(np.int64).view(np.uint64), size):
        np.bitwise_or.at(slots, at, rows["mask"].to_numpy(np.int64).view(np.uint64))
    filled = np.array([((slots >> np.uint64(k)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filter(tuple(languages), slots, filled**HASHES, tuple(languages.index(x) for _, x in taught))


def _predicted(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        f: Filter = shared.value
        order = np.array(f.order, int)
        names = [f.languages[k] for k in f.order]
        for batch in batches:
            n, texts = batch.num_rows, batch.column(1).to_pylist()
            hits, grams, lettered = np.zeros((len(names), n)), np.zeros(n), np.zeros(n, bool)
            for index, g, with_letters in ngrams(texts):
                lettered[with_letters] = True
                grams += np.bincount(index, minlength=n)
                masks = f.masks(g)
                for k, bit in enumerate(order):
                    own = index[(masks >> np.uint64(bit)) & np.uint64(1) == 1]
                    hits[k] += np.bincount(own, minlength=n)
            if not names:
                yield {"doc_id": batch.column(0), "lang_pred": [UNKNOWN] * n, "score": np.zeros(n)}
                continue
            wrong = f.wrong[order][:, None]
            true = np.maximum(hits - grams * wrong, 0) / np.maximum(1 - wrong, 1e-9)
            best = true.argmax(0)
            top = true[best, np.arange(n)]
            next_best = np.sort(true, 0)[-2] if len(names) > 1 else np.zeros(n)
            score = np.where(lettered & (top > 0), top / np.maximum(top + next_best, 1e-9), 0)
            named = [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            yield {"doc_id": batch.column(0), "lang_pred": named, "score": score}

    return work


def identify(df: DataFrame, learned: Filter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``lang_pred``, ``score``) of every row from its whole text.

    ``score`` is the best corrected count over the sum of the best two. Null
    texts and texts without a letter are ``und`` with score 0; a text with
    letters but no known n-gram gets the language that most rows taught, with
    score 0, as do ties. Repeated rows are rated alike.
    """
    shared = df.sparkSession.sparkContext.broadcast(learned)
    return by_batch(key_and_text(df, key, text), "doc_id long, lang_pred string, score double", _predicted(shared))


def language_report(df: DataFrame, folds: int = 5) -> DataFrame:
    """Predictions for all documents, learned from those whose fold (crc32 of the key) is not 0.

    A null doc_id is in no fold: it teaches nothing and is not held out.
    """
    learned = learn(df.filter(fold(df["doc_id"], folds) != 0))
    rated = identify(df, learned)
    held = F.coalesce(fold("doc_id", folds) == 0, F.lit(False))
    return rated.select("doc_id", held.alias("held_out"), "lang_pred", "score")
