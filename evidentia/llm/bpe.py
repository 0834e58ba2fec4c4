"""Byte-level BPE: rows of padded matrices, each merging its leftmost pair of least rank in every round."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, per_document, tokenizer_path

NONE = np.int64(1 << 40)
#: A pretoken of more bytes is a flat row of its own: in a matrix, rounds over a row cost its length squared.
LONG = 2048
#: The rank of a pair that is no token, in four bytes.
NEVER = np.int32((1 << 31) - 1)
#: Rows times width of a matrix.
CELLS = 1 << 20
#: Pretokens that a worker remembers, twice over: those seen since the last change of generation, and those before.
REMEMBERED = 250_000


class Bpe:
    """Encodes pretokens by ranks; decode is its inverse."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        keys, values = [], []
        for b, rank in self.ranks.items():
            for i in range(1, len(b)):
                left, right = self.ranks.get(b[:i]), self.ranks.get(b[i:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        self._build(np.array(keys, np.int64), np.array(values, np.int64))
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        self.before: dict[str, tuple[int, str, bytes]] = {}
        self.long: list[str] = []

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing; keys that lose a slot to another go one further in the next pass."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair is no token."""
        keys = (left << 20 | right).ravel()
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        while len(todo):
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
            slot[todo] = slot[todo] + 1 & self.mask
        return out.reshape(left.shape)

    def merge_rows(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces, bucketed by length: a bucket is a matrix of ids padded with -1."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._rounds([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _rounds(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        m = np.where(np.arange(width) < n[:, None], self.single[raw], -1)
        rank = self.lookup(m[:, :-1], m[:, 1:])
        live, done = np.arange(len(pieces)), [None] * len(pieces)
        while len(live):
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[np.arange(len(live)), at]
            over = best == NONE
            for r in np.flatnonzero(over):
                done[live[r]] = m[r, : n[r]].tolist()
            keep = ~over  # compaction of rows
            live, m, rank, n, at, best = live[keep], m[keep], rank[keep], n[keep] - 1, at[keep], best[keep]
            if not len(live):
                break
            rows, w = np.arange(len(live)), m.shape[1]
            cols = np.arange(w - 1)
            m[rows, at] = best
            m = np.take_along_axis(m, cols + (cols > at[:, None]), 1)  # compaction of columns
            w = max(2, int(n.max()))
            pairs = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, pairs + (pairs >= at[:, None] + (0)), 1) if rank.shape[1] > 1 else np.full((len(live), 1), NONE)
            m = m[:, :w] if m.shape[1] >= w else np.pad(m, ((0, 0), (0, w - m.shape[1])), constant_values=-1)
            rank = rank[:, : w - 1] if rank.shape[1] >= w - 1 else np.pad(rank, ((0, 0), (0, w - 1 - rank.shape[1])), constant_values=NONE)
            for side in (at - 1, at):  # only the new token's two pairs change
                ok = (side >= 0) & (side < w - 1)
                rank[rows[ok], side[ok]] = self.lookup(m[rows[ok], side[ok]], m[rows[ok], side[ok] + 1])
        return done

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """lookup in four bytes an id, a stretch at a time."""
        out = np.empty(len(left), np.int32)
        for a in range(0, len(left), CELLS):
            out[a : a + CELLS] = np.minimum(self.lookup(left[a : a + CELLS].astype(np.int64), right[a : a + CELLS].astype(np.int64)), NEVER)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of a piece as one flat row, whose rounds cost what they change and not the row's length.

        A round merges the pairs of least rank from the left, as single rounds would one after another, up to one that makes a
        pair of lesser rank, which is the next round's. Pairs wait by their rank; only those about a merged one are looked up.
        """
        n = len(piece)
        ids = np.append(self.single[np.frombuffer(piece, np.uint8)], -1).astype(np.int32)  # place n is the end
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        rank = np.append(self._pair_ranks(ids[:-1], ids[1:]), NEVER)
        waiting: dict[int, list[np.ndarray]] = {}
        least: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] < NEVER]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            for x, a, b in zip(r[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                if x not in waiting:
                    waiting[x] = []
                    heappush(least, x)
                waiting[x].append(at[a:b])

        wait(np.arange(n + 1, dtype=np.int32))
        while least:
            new = heappop(least)
            at = np.unique(np.concatenate(waiting.pop(new)))
            at = at[rank[at] == new]
            if not len(at):
                continue
            # Of pairs that overlap (a letter repeated) every other one, from the left.
            apart = np.ones(len(at), bool)
            apart[1:] = after[at[:-1]] != at[1:]
            place = np.arange(len(at))
            first = at[(place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 0]
            second = after[first]
            last = after[second]
            left = np.where(before[first] >= 0, ids[before[first]], -1)
            left[1:][last[:-1] == first[1:]] = new  # the pair before was merged by then
            lesser = np.flatnonzero((self._pair_ranks(left, np.full(len(first), new)) < new) | (self._pair_ranks(np.full(len(first), new), ids[last]) < new))
            if len(lesser):
                stop = lesser[0] + 1
                rest = at[at > first[stop - 1]]
                first, second, last = first[:stop], second[:stop], last[:stop]
            ids[first], ids[second], rank[second] = new, -1, NEVER
            after[first], before[last] = last, first
            changed = np.unique(np.concatenate((first, before[first][before[first] >= 0])))
            rank[changed] = self._pair_ranks(ids[changed], ids[after[changed]])
            wait(changed)
            if len(lesser):
                wait(rest)
        return ids[ids >= 0].tolist()

    def remember(self, pretokens: set[str]) -> None:
        """Has all pretokens in the cache; frequent ones outlive a change of generation, long ones only last till the next call."""
        for p in self.long:
            self.cache.pop(p, None)
            self.before.pop(p, None)
        self.long = [p for p in pretokens if len(p) > LONG]
        new = pretokens - self.cache.keys()
        if len(self.cache) + len(new) > REMEMBERED:
            self.cache, self.before, new = {}, self.cache, pretokens
        old = new & self.before.keys()
        self.cache.update((p, self.before[p]) for p in old)
        new = list(new - old)
        for p, ids in zip(new, self.merge_rows([p.encode() for p in new]), strict=True):
            self.cache[p] = len(ids), ",".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.merge_rows([p.encode() for p in self.split(text)]) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Ids of every whole text and the bytes that they decode to: id, ids (decimal, comma-joined), n_tokens, decoded.

    Without with_ids, the SHA-256 of both takes their place (ids_sha256, decoded_sha256), made where the rows are.
    Null and empty texts have no ids. Pretokens longer than LONG bytes are flat rows that merge all pairs of least rank in a
    round, to the same ids. A narrow map: rows may repeat, the table may be empty, other columns are not read.
    """
    path = vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def work(texts):
        b = bpe(path)
        split = [b.split(t) for t in texts]
        b.remember({p for s in split for p in s})
        rows = [[b.cache[p] for p in s] for s in split]
        parts = [tuple(zip(*r, strict=True)) or ((), (), ()) for r in rows]
        n, ids, raw = [sum(x[0]) for x in parts], [",".join(x[1]) for x in parts], [b"".join(x[2]) for x in parts]
        if with_ids:
            return n, ids, raw
        return n, [hashlib.sha256(x.encode()).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in raw]

    return per_document(df, id_col, text_col, "n_tokens long, ids string, decoded binary" if with_ids else "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), with_ids=False)
