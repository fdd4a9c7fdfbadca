"""Token counts by rank-synchronous merging of ragged arrays.

A BPE model joins, again and again, the two neighbours whose piece ranks lowest.
The texts of a batch are cut where no piece can reach across, which makes
pre-tokens; equal ones are held once, as one array of symbols with the offsets of
the pre-tokens. Each round looks up all neighbours at once, finds every
pre-token's lowest rank and applies it in all of them together. What survives is
counted, and the counts are summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, key_and_text, mix
from .sentencepiece_codec import BPE, MARK, NORMAL, UNUSED, USER, Spec, read_model

LIMIT = 4096
CHARS = 2_000_000  # of text merged at a time, unless one text is longer
NEVER = np.int64(1) << 40


class Ranks:
    """A BPE model as arrays: symbols, the ranks of pairs, the neighbours that share a piece."""

    def __init__(self, data: bytes):
        spec = read_model(data)
        if spec.kind != BPE:
            raise ValueError("ranks need a BPE model")
        if spec.charsmap or spec.squeeze or not spec.escape or spec.ids(USER, UNUSED):
            raise ValueError("models that rewrite texts, or with pieces set apart, are not supported")
        self.spec: Spec = spec
        pieces = spec.ids(NORMAL)
        # Symbols are ids of pieces; single characters without a piece are one symbol more.
        self.unknown = len(spec.pieces)
        singles = sorted((ord(p), i) for p, i in pieces.items() if len(p) == 1)
        self.codes = np.array([c for c, _ in singles], np.uint32)
        self.symbols = np.array([i for _, i in singles], np.int64)
        order = {s: r for r, s in enumerate(sorted({spec.pieces[i][1] for i in pieces.values()}, reverse=True))}
        rank = {i: order[spec.pieces[i][1]] for i in pieces.values()}
        pairs, near = [], set()
        for p, i in pieces.items():
            near.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a * self.unknown + b, rank[i], i))
        pairs.sort()
        self.keys, self.ranks, self.joined = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 3
        # A piece whose pairs may rank before itself: its merges must not be made ahead of time.
        first = np.full(self.unknown + 1, NEVER)
        np.minimum.at(first, self.keys // self.unknown, self.ranks)
        np.minimum.at(first, self.keys % self.unknown, self.ranks)
        own = np.full(self.unknown + 1, -1)
        own[list(rank)] = list(rank.values())
        self.hasty = first <= own
        self.near = np.array(sorted((ord(a) << 32) | ord(b) for a, b in near), np.uint64)

    def units(self, text: str) -> str:
        """The text as the model sees it."""
        text = text.encode("utf-8", "replace").decode()
        return ((" " if self.spec.dummy_prefix and text else "") + text).replace(" ", MARK)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbours; ``NEVER`` where they make none."""
        key = left * self.unknown + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else None
        if at is None:
            return np.full(len(key), NEVER), key
        hit = (self.keys[at] == key) & (left < self.unknown) & (right < self.unknown)
        return np.where(hit, self.ranks[at], NEVER), self.joined[at]

    def starts(self, codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin: at texts, and between characters that no piece has side by side."""
        cut = np.ones(len(codes), bool)
        if len(codes) > 1 and len(self.near):
            both = (codes[:-1].astype(np.uint64) << np.uint64(32)) | codes[1:]
            at = np.minimum(np.searchsorted(self.near, both), len(self.near) - 1)
            cut[1:] = self.near[at] != both
        cut[text_starts] = True
        return np.flatnonzero(cut)

    def merge(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive, with the pre-token (0 to ``n`` - 1, ascending) that each belongs to.

        In a round each pre-token makes its lowest-ranked merge, the leftmost first
        and, where nothing that the merge brings could rank before it, everywhere.
        A pre-token that has no merge left is set aside.
        """
        done_symbols, done_owner = [], []
        while len(symbols) > 1:
            inside = owner[1:] == owner[:-1]
            rank, piece = self._look_up(symbols[:-1], symbols[1:])
            rank = np.where(inside, rank, NEVER)
            lowest = np.full(n, NEVER)
            # Runs of one owner are contiguous, so the minimum of each run is one reduction.
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            padded = np.append(rank, NEVER)
            lowest[owner[begin]] = np.minimum.reduceat(padded, begin)
            busy = lowest[owner] < NEVER
            if not busy.all():
                done_symbols.append(symbols[~busy])
                done_owner.append(owner[~busy])
                if not busy.any():
                    symbols = symbols[:0]
                    break
                rank, piece = padded[busy][:-1], np.append(piece, 0)[busy][:-1]
                symbols, owner = symbols[busy], owner[busy]
            chosen = np.flatnonzero(rank == lowest[owner[:-1]])
            chosen = chosen[owner[chosen] == owner[chosen + 1]]
            # Of neighbours that overlap every second one, from the left.
            new = np.concatenate([[True], np.diff(chosen) > 1])
            run = np.flatnonzero(new)
            place = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
            chosen = chosen[place % 2 == 0]
            first = np.concatenate([[True], owner[chosen][1:] != owner[chosen][:-1]])
            hasty = self.hasty[piece[chosen]]
            if hasty.any():
                slow = np.zeros(n, bool)
                slow[owner[chosen[hasty]]] = True
                chosen = chosen[first | ~slow[owner[chosen]]]
            symbols = symbols.copy()
            symbols[chosen] = piece[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner[: len(symbols)]])

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        marked = [self.units(t) for t in texts]
        lengths = np.array([len(m) for m in marked], np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(len(texts), np.int64)
        ends = np.cumsum(lengths)
        filled = np.flatnonzero(lengths)
        starts = self.starts(codes, (ends - lengths)[filled])
        sizes = np.diff(np.append(starts, len(codes)))
        text_of = np.searchsorted(ends, starts, side="right")
        which, first = _distinct(codes, starts, sizes)
        # Each different pre-token once, as one array of its characters.
        begin, size = starts[first], sizes[first]
        held = codes[_ranges(begin, size)]
        owner = np.repeat(np.arange(len(first)), size)
        at = np.minimum(np.searchsorted(self.codes, held), len(self.codes) - 1)
        known = self.codes[at] == held
        symbols = np.where(known, self.symbols[at], self.unknown)
        # A character without a piece is its bytes, or one unknown.
        weight = np.where(held < 0x80, 1, np.where(held < 0x800, 2, np.where(held < 0x10000, 3, 4)))
        if not self.spec.byte_fallback:
            # Unknown characters in a row are one token, across pre-tokens too; each of these is one character.
            weight = np.ones(len(held), np.int64)
        lost = np.bincount(owner[~known], weight[~known], len(first)).astype(np.int64)
        symbols, owner = self.merge(symbols, owner, len(first))
        each = lost + np.bincount(owner[symbols != self.unknown], minlength=len(first))
        total = np.bincount(text_of, each[which], len(texts)).astype(np.int64)
        if not self.spec.byte_fallback:
            gone = np.isin(codes, self.codes, invert=True)
            of = np.searchsorted(ends, np.arange(len(codes)), side="right")
            again = gone[1:] & gone[:-1] & (of[1:] == of[:-1])
            total -= np.bincount(of[1:][again], minlength=len(texts))
        return total


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of ranges, one range after the other."""
    out = np.ones(int(size.sum()), np.int64)
    end = np.cumsum(size)
    out[0] = begin[0]
    out[end[:-1]] = begin[1:] - begin[:-1] - size[:-1] + 1
    return np.cumsum(out)


def _distinct(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which different pre-token each one is, and the first place of each different one.

    They are told apart by a hash and then compared, so two that share a hash are
    different still.
    """
    with np.errstate(over="ignore"):
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        mixed = mix(codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
        hashed = mix(np.add.reduceat(mixed, starts) + sizes.astype(np.uint64))
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    other = codes[np.minimum(_ranges(starts[first][which], sizes), len(codes) - 1)]
    same = np.logical_and.reduceat(other == codes, starts) & (sizes == sizes[first][which])
    if not same.all():
        strange = np.flatnonzero(~same)
        which = which.copy()
        which[strange] = len(first) + np.arange(len(strange))
        first = np.concatenate([first, strange])
    return which, first


@cache
def _model(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks(f.read())


def token_counts(
    df: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``) of every row.

    ``model`` is the path of a SentencePiece BPE file that every executor has.
    Nothing is added at the ends, and strings of control pieces inside a text are
    plain text. A null or empty text has no bytes and no tokens; white space counts
    as the model keeps it; very long texts are merged whole; repeated rows and ids
    count one by one, a null id is an id. An empty table gives an empty one. Only
    the two columns are read, whatever else the table holds.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        ranks = _model(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, at = [np.zeros(0, np.int64)], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS):
                    chars += len(texts[end])
                    end += 1
                counts.append(ranks.count(texts[at:end]))
                at = end
            n = np.concatenate(counts)
            yield {
                "doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts],
                "n_tokens": n, "over_limit": n > limit,
            }

    return by_batch(key_and_text(df, key, text), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)
