import zlib

import numpy as np

from driftkit.llm import language_id as L


def test_ngrams_by_brute_force():
    texts = ["Ab cd, ef", None, "", "é x ßü 12 Q", "a" * 9, "日本語 テキスト"]
    found = [[] for _ in texts]
    lettered = set()
    for index, grams, some in L.ngrams(texts):
        lettered |= set(some.tolist())
        for k, g in zip(index.tolist(), grams.tolist()):
            found[k].append(g)
    for k, text in enumerate(texts):
        t = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        expected = [t[i : i + 4] for i in range(len(t) - 3) if "  " not in t[i : i + 4]]
        assert len(found[k]) == len(expected) and len(set(found[k])) == len(set(expected))
    assert lettered == {0, 3, 4, 5}


def test_long_texts_are_read_in_whole(monkeypatch):
    text = "".join(chr(97 + k * k % 26) + " " * (k % 7 == 0) for k in range(5000))
    whole = np.sort(np.concatenate([g for _, g, _ in L.ngrams([text, "xy zzy"])]))
    monkeypatch.setattr(L, "CHUNK", 100)
    assert np.array_equal(whole, np.sort(np.concatenate([g for _, g, _ in L.ngrams([text, "xy zzy"])])))


def test_filter_returns_the_languages_of_each_ngram():
    grams = np.arange(1, 3000).astype(np.uint64)
    masks = (grams % np.uint64(7) + np.uint64(1))
    slots = np.zeros(1 << 16, np.uint64)
    for at in L._places(grams, len(slots)):
        np.bitwise_or.at(slots, at, masks)
    f = L.Filter(("a", "b", "c"), slots, np.zeros(3), (0, 1, 2))
    found = f.masks(grams)
    assert ((found & masks) == masks).all()  # never misses a language
    assert (found != masks).mean() < 0.05


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in L.language_report(docs).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_edge_cases(spark, documents, nothing):
    found = L.language_report(documents).collect()
    assert len(found) == documents.count()
    by_text = {r["doc_id"]: r for r in found}
    for key in (4, 5, 6, 12):
        assert (by_text[key]["lang_pred"], by_text[key]["score"]) == ("und", 0.0)
    assert by_text[7]["lang_pred"] in ("en", "de")
    assert not by_text[None]["held_out"]
    assert L.language_report(nothing).collect() == []
    untaught = L.identify(documents, L.learn(nothing))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
