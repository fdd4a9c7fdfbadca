"""Counts against the library that the model comes from."""

import random

import numpy as np
import pytest
import sentencepiece

from driftkit.llm.queries import public_model
from driftkit.llm.token_counts import Ranks, _distinct, _ranges, token_counts

MODEL = public_model("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def ranks():
    with open(MODEL, "rb") as f:
        return Ranks(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(ranks, library, texts):
    got = ranks.count(texts)
    want = [len(ids) for ids in library.encode(texts, num_threads=4)]
    assert got.tolist() == want


def test_texts_of_odd_parts(ranks, library):
    draw = random.Random(1)
    parts = ["a", "ab", "  ", "▁", "<s>", "</s>", "<unk>", "<0x41>", "日本", "é", "😀", "\n", "\t", " the", "ing", "aaaa", "....",
             "0", "\x00", "­", " ", "Ǆ"]
    check(ranks, library, ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(3000)])


def test_texts_of_pieces(ranks, library):
    draw = random.Random(2)
    pieces = [library.id_to_piece(k) for k in range(library.get_piece_size())]
    check(ranks, library, ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 30))) for _ in range(3000)])


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 20000, "日本語" * 10000, " " * 5000, "x" * 7 + " " * 33, "", " ", "▁"])
def test_long_runs(ranks, library, text):
    check(ranks, library, [text])


def test_a_merge_that_makes_a_lower_rank_is_not_made_ahead(ranks):
    """Ranks by hand: b+c is third, but a+bc ranks first, and takes its bc before the next b+c is made."""
    small = object.__new__(Ranks)
    small.unknown = 10
    table = sorted([(0 * 10 + 4, 0, 5), (1 * 10 + 2, 2, 4), (4 * 10 + 1, 1, 6)])
    small.keys, small.ranks, small.joined = (np.array(c, np.int64) for c in zip(*table))
    small.hasty = np.zeros(11, bool)
    small.hasty[4] = True
    symbols, owner = small.merge(np.array([1, 2, 1, 2, 0, 1, 2]), np.array([0, 0, 0, 0, 1, 1, 1]), 2)
    # bcbc: the first bc is made, bc+b ranks before the second, which leaves c; abc is a+bc.
    assert sorted(zip(owner.tolist(), symbols.tolist())) == [(0, 2), (0, 6), (1, 5)]


def test_equal_hashes_would_still_be_told_apart(monkeypatch):
    monkeypatch.setattr("driftkit.llm.token_counts.mix", lambda x, salt=0: x * np.uint64(0))
    codes = np.array([1, 2, 1, 2, 1, 3, 7], np.uint32)
    starts, sizes = np.array([0, 2, 4, 6]), np.array([2, 2, 2, 1])
    which, first = _distinct(codes, starts, sizes)
    content = [tuple(codes[s : s + n]) for s, n in zip(starts, sizes)]
    assert [content[first[w]] for w in which] == content


def test_ranges():
    assert _ranges(np.array([5, 0, 9]), np.array([2, 3, 1])).tolist() == [5, 6, 0, 1, 2, 9]


def test_the_table_with_everything_that_may_go_wrong(documents, library):
    rows = documents.collect()
    got = sorted(map(str, token_counts(documents, MODEL, limit=40).collect()))
    want = []
    for r in rows:
        text = r["text"] or ""
        n = len(library.encode(text))
        want.append(f"Row(doc_id={r['doc_id']}, n_bytes={len(text.encode())}, n_tokens={n}, over_limit={n > 40})")
    assert got == sorted(want)


def test_an_empty_table(nothing):
    assert token_counts(nothing, MODEL).count() == 0


def test_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, MODEL).collect()} == want
