"""SentencePiece models on the tokenizers library: read the protobuf, rebuild, encode, decode.

The model file is read field by field, and its normaliser, its white-space
marker, its scores and its byte fallback are set up as a ``tokenizers`` tokenizer,
for unigram as well as for BPE models. Texts are cut where no piece can reach
across (before a run of markers, around line ends if no piece joins one to
another character); each different unit is encoded once, in threads, and its
ids are kept for later batches as far as room is set aside. Parity with the
SentencePiece library is verified on every unit that is encoded, and every
document is decoded again.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, key_and_text

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file
UNIGRAM, BPE = 1, 2
KEPT_UNITS = 250_000  # in each of two generations; what is dropped is encoded again
TOGETHER = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class Spec:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, kind
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    def ids(self, *kinds: int) -> dict[str, int]:
        return {p: i for i, (p, _, k) in enumerate(self.pieces) if k in kinds}


def read_model(data: bytes) -> Spec:
    """A SentencePiece model file; what it leaves out has the format's defaults."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f.get(1, b"").decode("utf-8"), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    return Spec(
        tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""),
        bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)),
    )


def build(spec: Spec):
    """The model as a tokenizer over units in which spaces are already marked."""
    from tokenizers import Tokenizer, decoders, models

    unknown = next((p for p, _, k in spec.pieces if k == UNKNOWN), None)
    if spec.kind == UNIGRAM:
        vocabulary = [(p, s) for p, s, _ in spec.pieces]
        model = models.Unigram(vocabulary, next(iter(spec.ids(UNKNOWN).values()), None), spec.byte_fallback)
    elif spec.kind == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        joined = spec.ids(NORMAL, USER)
        parts = [
            (-spec.pieces[i][1], i, p[:k], p[k:]) for p, i in joined.items() for k in range(1, len(p))
            if p[:k] in joined and p[k:] in joined
        ]
        merges = [(a, b) for _, _, a, b in sorted(parts, key=lambda m: m[:2])]
        model = models.BPE(ids, merges, unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(model)
    tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


def _cuts(spec: Spec) -> tuple[re.Pattern | None, bool]:
    """Matches the units into which a marked text falls, None if some piece reaches over a marker.

    Also whether a line end is a unit of its own.
    """
    joined = spec.ids(NORMAL, USER)
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in joined):
        return None, False
    kept = spec.escape and not spec.charsmap and not spec.squeeze and (spec.byte_fallback or "\n" in joined)
    lines = kept and not any("\n" in p and len(p) > 1 for p in joined)
    return re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if lines else f"{MARK}*[^{MARK}]+|{MARK}+"), lines


class Codec:
    """Encodes to and decodes from the ids of a SentencePiece model."""

    def __init__(self, data: bytes, verify: bool = True):
        import sentencepiece
        from tokenizers import normalizers

        self.spec = read_model(data)
        self.tokenizer = build(self.spec)
        self.cuts, self.lines = _cuts(self.spec)
        self.code = "H" if len(self.spec.pieces) <= 1 << 16 else "I"
        self.wide = np.dtype(self.code).newbyteorder("<")
        self.charsmap = normalizers.Precompiled(self.spec.charsmap) if self.spec.charsmap else None
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.verify = verify
        self.units: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.differing: set[str] = set()
        self.texts = np.array([self._bytes_of(p, k) for p, _, k in self.spec.pieces], object)

    @staticmethod
    def _bytes_of(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}.get(kind, piece.replace(MARK, " ").encode())

    def normalise(self, text: str) -> str:
        """The text as the model sees it, spaces marked."""
        text = text.encode("utf-8", "replace").decode()
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.spec.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.spec.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.spec.escape else text

    def split(self, marked: str) -> list[str]:
        """The units of a marked text, empty ones among them."""
        if self.cuts is None:
            return [marked]
        if not self.lines or MARK + MARK in marked:
            return self.cuts.findall(marked)
        return marked.replace(MARK, " " + MARK).replace("\n", " \n ").split(" ")

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, ``wide`` bytes an id; a null text has none."""
        split = [self.split(self.normalise(t)) if t else [] for t in texts]
        if len(self.units) > KEPT_UNITS:
            self.older, self.units = self.units, {"": b""}
        new = []
        for unit in set().union(*split).difference(self.units):
            if unit in self.older:
                self.units[unit] = self.older[unit]
            else:
                new.append(unit)
        if self.lines:
            self._encode_lines([u for u in new if u != "\n"])
        else:
            self._encode_each(new)
        known = self.units.__getitem__
        return [b"".join(map(known, units)) for units in split]

    def _encode_lines(self, units: list[str]) -> None:
        """Encodes units as the lines of joint texts, which is the same as one by one."""
        end = self.tokenizer.encode("\n").ids
        start = self.own.encode("\n")
        joint = ["\n" + "\n".join(units[k : k + TOGETHER]) for k in range(0, len(units), TOGETHER)]
        found = [f.ids for f in self.tokenizer.encode_batch_fast(joint, add_special_tokens=False)]
        self.units["\n"] = array(self.code, end).tobytes()
        # A line end stands before every unit and in none, so all joint texts are cut as one run of bytes.
        ids = np.fromiter(chain.from_iterable(found), self.wide)
        raw, size = ids.tobytes(), self.wide.itemsize
        cut = [*(np.flatnonzero(ids == end[0]) * size).tolist(), len(raw)]
        self.units.update(zip(units, [raw[a + size : b] for a, b in pairwise(cut)], strict=True))
        if not self.verify:
            return
        lead = len(start) - len(end)
        plain = [x.replace(MARK, " ") for x in joint]
        for k, (ids, check) in enumerate(zip(found, self.own.encode(plain, num_threads=1))):
            if ids != check[lead:]:
                for unit in units[k * TOGETHER : (k + 1) * TOGETHER]:
                    right = self.own.encode("\n" + unit.replace(MARK, " "))[len(start) :]
                    if self.units[unit] != array(self.code, right).tobytes():
                        self.differing.add(unit)

    def _encode_each(self, units: list[str]) -> None:
        found = [f.ids for f in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        lead = MARK if self.spec.dummy_prefix and self.spec.escape else ""
        plain = [u[len(lead) :] if u.startswith(lead) else u for u in units]
        shown = [p.replace(MARK, " ") if self.spec.escape else p for p in plain]
        own = self.own.encode(shown, num_threads=1) if self.verify else found
        for unit, ids, check in zip(units, found, own):
            self.units[unit] = array(self.code, ids).tobytes()
            if ids != check:
                self.differing.add(unit)

    def decode(self, ids: bytes) -> str:
        """The text of ids, as normalised by the model, without its prefix."""
        text = b"".join(self.texts[np.frombuffer(ids, self.wide)].tolist()).decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text

    def parity(self, text: str | None) -> bool:
        """Whether no unit of the text differs from the SentencePiece library."""
        return not self.differing or not text or self.differing.isdisjoint(self.split(self.normalise(text)))


@cache
def codec(data: bytes, verify: bool = True) -> Codec:
    """One codec per model and Python worker."""
    return Codec(data, verify)


def _encoded(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        own = codec(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = batch.column(1).to_pylist()
                ids = own.encode_batch(texts)
                decoded = [own.decode(i) if t is not None else None for i, t in zip(ids, texts)]
                yield {
                    "doc_id": batch.column(0),
                    "ids": [i if t is not None else None for i, t in zip(ids, texts)],
                    "n_tokens": [len(i) // own.wide.itemsize if t is not None else None for i, t in zip(ids, texts)],
                    "decoded": decoded,
                    "parity": [own.parity(t) if t is not None else None for t in texts],
                    "round_trip": [
                        None if t is None else d == own.normalise(t).replace(MARK, " ")[own.spec.dummy_prefix :]
                        for t, d in zip(texts, decoded)
                    ],
                }

    return work


def encoded_documents(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``ids``, ``n_tokens``, ``decoded``, ``parity``, ``round_trip``) of every row.

    ``model`` is the path of a model file that the driver reads and sends to
    the executors. ``ids`` holds two bytes an id (four for a vocabulary above
    65,536). A null text has nulls, an empty one no ids; a row with a null key
    is encoded like any other, repeated rows alike.
    """
    with open(model, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, ids binary, n_tokens int, decoded string, parity boolean, round_trip boolean"
    return by_batch(key_and_text(df, key, text), schema, _encoded(shared))
