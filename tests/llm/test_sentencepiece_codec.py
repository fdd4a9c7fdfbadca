import numpy as np
import pytest
import sentencepiece

from driftkit.llm import sentencepiece_codec as S
from driftkit.llm.queries import MODEL

from . import fixtures

ODD = [
    "", " ", "  a  b ", "x\n\ny \t z", "日本語 テキスト", "▁a b", "a▁", "😀 ok", "a\x00b", " ⁇ ", "<s> hi </s>", "<0x41>", "\r\n", "▁▁", "a\n b",
    "\n", "\n \n", "a \nb", "a\n▁b", " x", "x\r\ny", "word " * 3000, "z" * 4000,
]


@pytest.fixture(scope="module")
def data():
    with open(MODEL, "rb") as file:
        return file.read()


def test_parity_with_the_library(spark, data):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + ODD
    own, library = S.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = [np.frombuffer(i, own.wide).tolist() for i in own.encode_batch(texts)]
    right = library.encode(texts)
    assert ids == right and not own.differing
    assert [own.decode(i) for i in own.encode_batch(texts)] == library.decode(right)


def test_small_generations_change_nothing(data, monkeypatch):
    texts = [t for _, t in fixtures.texts() if t] + ODD
    expected = S.Codec(data).encode_batch(texts)
    monkeypatch.setattr(S, "KEPT_UNITS", 5)
    own = S.Codec(data)
    assert [own.encode_batch([t])[0] for t in texts] == expected


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def unigram(squeeze: int) -> bytes:
    """A small unigram model with byte fallback, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -1.0 - k**1.37 / 7, 1) for k, p in enumerate(["▁the", "▁", "the", "▁a", "ab", "a", "b", "c", "bc", "▁ab", "abc", "t", "h", "e"])]
    out = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return out + _message((2, _message((3, 1), (35, 1)))) + _message((3, _message((1, b"identity"), (3, 1), (4, squeeze), (5, 1))))


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_with_byte_fallback(squeeze):
    data = unigram(squeeze)
    own, library = S.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the abc", "ab  cab", "é the", "", "  ", "bc\nabc", "thethe xyz", "a" * 50]
    assert own.spec.kind == S.UNIGRAM and own.spec.byte_fallback
    assert [np.frombuffer(i, own.wide).tolist() for i in own.encode_batch(texts)] == library.encode(texts)
    assert not own.differing


def test_a_model_without_line_ends():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(p, -1.0 - k**1.37 / 7, 1) for k, p in enumerate(["▁the", "▁", "ab", "a", "b", "c"])]
    out = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data = out + _message((2, _message((3, 1)))) + _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    own, library = S.Codec(data, verify=False), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the aZb ab\nc Z", "ab\nthe", "c c c", "Zthe\n\nab"]
    assert [np.frombuffer(i, own.wide).tolist() for i in own.encode_batch(texts)] == library.encode(texts)


def test_a_wrong_unit_is_noticed(data):
    own = S.Codec(data)
    own.tokenizer = S.build(S.Spec(own.spec.pieces[:-20000], own.spec.kind, True, b"", True, False, True))
    texts = ["unbelievable constructions everywhere"]
    own.encode_batch(texts)
    assert own.differing and not own.parity(texts[0]) and own.parity(None)


def test_rows(spark, documents, nothing):
    found = S.encoded_documents(documents, MODEL).collect()
    assert len(found) == documents.count()
    assert {(r["ids"], r["n_tokens"], r["parity"]) for r in found if r["decoded"] is None} == {(None, None, None)}
    rest = [r for r in found if r["decoded"] is not None]
    assert all(r["parity"] and r["round_trip"] and len(r["ids"]) == 2 * r["n_tokens"] for r in rest)
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] not in (None, 13, 14)}
    assert all(texts[r["doc_id"]] == r["decoded"] for r in rest if r["doc_id"] in texts)
    assert S.encoded_documents(nothing, MODEL).collect() == []
