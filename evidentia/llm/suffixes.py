"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Which 100-byte strings of the corpus start earlier elsewhere is found by sorting suffixes, but only of places that can
repeat, and only among suffixes that can share a string:

1. Every window (100 bytes) has a minimizer, the leftmost of its 32-byte strings of least hash. Equal windows have equal
   minimizers at equal offsets. Runs of windows with one minimizer are segments; segments whose minimizer occurs nowhere
   else are done with.
2. The other segments go to suffix buckets by their minimizer. In a bucket their texts are laid end to end; the suffixes at
   difference-cover positions are ranked first, then one bucket of suffixes at a time is sorted by its leading bytes, and
   what is still tied by the ranks of the cover positions that the two suffixes reach after the same number of bytes.
3. Neighbours in that order that share 100 bytes form runs; all but the earliest of a run is removed.

Exact copies of a text are found by their digest before, so of each text only the first takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MANY, block_count, documents, equal_rows, mix64, packed, prepare, spread, text_bytes, unpacked

LENGTH = 100
KMER = 32
#: A difference cover modulo 31: every difference is one of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Leading bytes that are compared before the cover ranks: at least PERIOD.
LEAD = 32
#: Window starts in a chunk of text: their positions take 20 bits.
CHUNK = 1 << 19
#: Suffixes that are sorted at once.
BUCKET = 1 << 18
#: A minimizer at so many places sends its windows one by one, to buckets by their own hash: so no bucket has more segments
#: of one minimizer than that.
HOT_PLACES = 1 << 16
POSITION = np.uint64((1 << 20) - 1)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = CHUNK + 4 * LENGTH
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (base, inverse))


def rolling(part: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of a length in a chunk of bytes."""
    power, inverse = _powers()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)])))
    return mix64((sums[length:] - sums[:-length]) * inverse[: len(part) - length + 1])


def windows(text: bytes, length: int = LENGTH, kmer: int = KMER):
    """(start of the chunk, its bytes, minimizer's position for each window that begins in it, all hashes) of a text, in chunks of consecutive window starts."""
    for a in range(0, len(text) - length + 1, CHUNK):
        part = np.frombuffer(text, np.uint8, min(len(text) - a, CHUNK + length - 1), a)
        h = rolling(part, kmer)
        key = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        width, n = 1, length - kmer + 1
        while 2 * width <= n:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < n:
            key = np.minimum(key[: len(key) - (n - width)], key[n - width :])
        yield a, part, (key & POSITION).astype(np.int64), h


def segments(text: bytes):
    """Of each chunk: its start, its bytes, and start (in the chunk), number of windows and minimizer hash of each run of windows with one minimizer."""
    for a, part, at, h in windows(text):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        yield a, part, first, np.diff(np.append(first, len(at))), h[at[first]]


def equal_windows(part: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the strings at two lists of places of a chunk are equal."""
    word = np.zeros(len(part) - 7, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | part[k : k + len(word)]
    same = np.ones(len(a), bool)
    for skip in [*range(0, length - 8, 8), length - 8]:
        same &= word[a + skip] == word[b + skip]
    return same


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers among sorted ones."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
    return at[first], at[np.append(first[1:], len(at)) - 1]


def dense_rank(key: np.ndarray) -> np.ndarray:
    """1 for the least key, equal ranks for equal keys."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([1], key[order][1:] != key[order][:-1])).astype(np.int64)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


class SuffixOrder:
    """Suffixes of texts laid end to end; a suffix ends with its text.

    Positions whose number modulo PERIOD is in COVER are ranked by 4 * PERIOD bytes, in memory of the order of the text;
    for any two suffixes, shift[i % PERIOD, j % PERIOD] bytes on both are at such positions.
    """

    def __init__(self, texts: list[bytes]):
        pad = 4 * PERIOD + LEAD
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        text = np.frombuffer(b"".join([*texts, bytes(pad)]), np.uint8)
        n = int(self.sizes.sum())
        self.end = np.repeat(self.starts + self.sizes, self.sizes)
        word = np.zeros(n + pad - 8, np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | text[k : k + len(word)]
        self.word = word
        cover = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
        self.rank = np.zeros(n + 4 * PERIOD, np.int64)
        if len(cover):
            lead = [self._words(cover, 8 * k, PERIOD) for k in range(4)]
            order = np.lexsort(lead[::-1])
            new = np.zeros(len(order), bool)
            for w in lead:
                new[1:] |= w[order][1:] != w[order][:-1]
            r = np.empty(len(order), np.int64)
            r[order] = 1 + np.cumsum(new)
            for step in (PERIOD, 2 * PERIOD):
                self.rank[cover] = r
                beyond = np.where(cover + step < self.end[cover], self.rank[np.minimum(cover + step, n)], 0)
                r = dense_rank(r << 32 | beyond)
            self.rank[cover] = r
        member = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
        d = np.arange(PERIOD)
        both = member[d[:, None] + d[None, :]]  # [residue, shift]
        self.shift = (both[:, None, :] & both[None, :, :]).argmax(2)

    def _words(self, at: np.ndarray, skip: int, depth: int) -> np.ndarray:
        """Bytes skip to skip + 8 of the suffixes, as far as their depth and their texts go."""
        left = np.minimum(self.end[at] - at, depth) - skip
        w = self.word[at + skip]
        cut = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(cut >= 64, np.uint64(0), w >> np.minimum(cut, np.uint64(63)) << np.minimum(cut, np.uint64(63)))

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes at the given positions in order (as far as LEAD + the cover's depth), and which begin a new LEAD."""
        lead = [self._words(at, 8 * k, LEAD) for k in range(LEAD // 8)]
        at = at[order := np.lexsort(lead[::-1])]
        new = np.ones(len(at), bool)
        new[1:] = False
        for w in lead:
            new[1:] |= w[order][1:] != w[order][:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if len(tied):
            at[tied] = self._by_rank(at[tied], group[tied])
        return at, new

    def _by_rank(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sorts within groups, which are consecutive: all groups at once are split about a member of each until none differs."""
        out = at.copy()
        place = np.arange(len(at))
        while len(at):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.append(first, len(at)))
            pivot = np.repeat(at[first + size // 2], size)
            by = self.shift[at % PERIOD, pivot % PERIOD]
            mine, theirs = self.rank[at + by], self.rank[pivot + by]
            side = np.where(mine < theirs, 0, np.where(mine == theirs, 1, 2))
            number = np.repeat(np.arange(len(first)), size)
            order = np.argsort(number * 3 + side, kind="stable")
            at, side, group = at[order], side[order], (number * 3 + side)[order]
            out[place] = at
            part = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            many = np.repeat(np.diff(np.append(part, len(at))), np.diff(np.append(part, len(at))))
            keep = (side != 1) & (many > 1)
            at, group, place = at[keep], group[keep], place[keep]
        return out

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether LEAD to length bytes of two suffixes, both at least as long, are equal."""
        equal = np.ones(len(a), bool)
        for skip in [*range(LEAD, length - 8, 8), length - 8]:
            i = np.flatnonzero(equal)
            equal[i] = self.word[a[i] + skip] == self.word[b[i] + skip]
        return equal


def earlier(texts: list[bytes], counts: np.ndarray, order_key: np.ndarray, length: int = LENGTH, bucket: int = BUCKET) -> np.ndarray:
    """For each window start of each text (the first counts of it), whether the same window starts earlier.

    order_key: of each window start, all texts' after another; of equal windows the one of least key is the earliest.
    """
    s = SuffixOrder(texts)
    at = np.repeat(s.starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    found = np.zeros(len(at), bool)
    lead = s.word[at]
    parts = max(1, -(-len(at) // bucket))
    cuts = np.unique(np.sort(lead[:: max(1, len(lead) // (64 * parts))])[::64][1:]) if parts > 1 else np.zeros(0, np.uint64)
    which = np.searchsorted(cuts, lead, "right")
    number = np.zeros(len(s.end) + 1, np.int64)
    number[at] = np.arange(len(at))
    for k in range(len(cuts) + 1):  # one bucket of suffixes at a time
        mine = at if not len(cuts) else at[which == k]
        if len(mine) < 2:
            continue
        ranked, new = s.sort(mine)
        pair = np.flatnonzero(~new)
        joined = np.zeros(len(ranked), bool)
        joined[pair] = s.same(ranked[pair - 1], ranked[pair], length)
        run = np.flatnonzero(~joined)
        key = order_key[number[ranked]]
        least = np.repeat(np.minimum.reduceat(key, run), np.diff(np.append(run, len(ranked))))
        found[number[ranked[key > least]]] = True
    return found


# Blocks of documents and what they send. A document is known by its id and a hash of its text.

MESSAGE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.string()), ("payload", pa.binary())])
MESSAGE_DDL = "bucket long, block long, kind string, payload binary"
RANGE = np.dtype([("doc", "<i8"), ("dig", "<i8"), ("start", "<i8"), ("end", "<i8")])
SEGMENT = np.dtype([("doc", "<i8"), ("dig", "<i8"), ("start", "<i8"), ("count", "<i8")])


def _first_texts(docs: pa.Table, messages: pa.Table) -> list[tuple[int, int, bytes]]:
    """(id, hash, text) of the block's first copies, by id and hash, each once."""
    firsts = {(d, g) for k, d, g in zip(messages.column("kind").to_pylist(), messages.column("doc").to_pylist(), messages.column("dig").to_pylist(), strict=True) if k == "first"}
    rows = {}
    for d, g, t in zip(docs.column("doc").to_pylist(), docs.column("dig").to_pylist(), docs.column("raw"), strict=True):
        if (d, g) in firsts and (d, g) not in rows:
            rows[d, g] = t.as_py()
    return [(d, g, rows[d, g]) for d, g in sorted(rows)]


def _payloads(messages: pa.Table, kind: str) -> list[bytes]:
    return [p.as_py() for k, p in zip(messages.column("kind").to_pylist(), messages.column("payload"), strict=True) if k == kind]


def _table(rows: list[tuple]) -> pa.Table:
    pa.default_memory_pool().release_unused()
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(MESSAGE)], schema=MESSAGE) if rows else MESSAGE.empty_table()


def _minimizers(block: int, docs: pa.Table, messages: pa.Table, bits: int) -> pa.Table:
    """A block's minimizer hashes, each once, with the number of places; dealt by hash."""
    count = lambda h: np.unique(h, return_counts=True) if len(h) > 1 << 16 else (h, np.ones(len(h), np.int64))
    found = [count(h) for *_, t in _first_texts(docs, messages) for *_, h in segments(t)]
    if not found:
        return MESSAGE.empty_table()
    h, which = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
    n = np.bincount(which, np.concatenate([n for _, n in found])).astype(np.int64)
    bucket = mix64(h) >> np.uint64(64 - bits)  # of another hash: the least of many hashes are all small
    order = np.argsort(bucket, kind="stable")
    h, n = h[order], n[order]
    cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=np.uint64))
    return _table([(k, block, "hashes", (b - a).to_bytes(8, "little") + h[a:b].tobytes() + packed(n[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b])


def _repeated(table: pa.Table, hot_places: int) -> pa.Table:
    """Tells each block which of its minimizers occur elsewhere, and which are hot."""
    raw = [p.as_py() for p in table.column("payload")]
    n = [int.from_bytes(r[:8], "little") for r in raw]
    h = [np.frombuffer(r, np.uint64, k, 8) for r, k in zip(raw, n, strict=True)]
    _, which = np.unique(np.concatenate(h), return_inverse=True)
    places = np.bincount(which, np.concatenate([unpacked(r[8 + 8 * k :], k) for r, k in zip(raw, n, strict=True)]))[which]
    keep, hot = places > 1, places >= hot_places
    rows, at = [], 0
    for b, k, x in zip(table.column("block").to_pylist(), n, h, strict=True):
        part = keep[at : at + k]
        if part.any():
            rows.append((-1, b, "repeated", x[part].tobytes() + hot[at : at + k][part].tobytes()))
        at += k
    return _table(rows)


def _candidates(block: int, docs: pa.Table, messages: pa.Table, buckets: int) -> pa.Table:
    """A block's segments with repeated minimizers, dealt to suffix buckets; of equal ones the earliest, the others are known to repeat.

    Of hot minimizers each different window goes for itself; windows equal to one before in their chunk are found together.
    """
    import xxhash

    answers = _payloads(messages, "repeated")
    if not answers:
        return MESSAGE.empty_table()
    h = np.concatenate([np.frombuffer(r, np.uint64, len(r) // 9) for r in answers])
    hot = np.concatenate([np.frombuffer(r, np.bool_, len(r) // 9, 8 * (len(r) // 9)) for r in answers])
    order = np.argsort(h)
    h, hot = h[order], hot[order]
    seen: set[bytes] = set()
    out: dict[int, tuple[list, list]] = {}
    ranges = [np.zeros(0, RANGE)]

    def repeat(doc, dig, start, end):
        r = np.zeros(len(start), RANGE)
        r["doc"], r["dig"], r["start"], r["end"] = doc, dig, start, end
        ranges.append(r)

    def send(bucket, doc, dig, start, count, text):
        if text in seen:
            repeat(doc, dig, [start], [start + count + LENGTH - 1])
            return
        seen.add(text)
        heads, bodies = out.setdefault(bucket, ([], []))
        heads.append((doc, dig, start, count))
        bodies.append(text)

    for doc, dig, text in _first_texts(docs, messages):
        for a, part, start, count, minimizer in segments(text):
            place = np.minimum(np.searchsorted(h, minimizer), len(h) - 1)
            mine = h[place] == minimizer
            alone = mine & hot[place]
            mine &= ~alone
            bucket = (mix64(minimizer[mine]) % np.uint64(buckets)).tolist()
            for s, c, b in zip((start[mine] + a).tolist(), count[mine].tolist(), bucket, strict=True):
                send(b, doc, dig, s, c, text[s : s + c + LENGTH - 1])
            if alone.any():
                n = count[alone]
                at = np.arange(n.sum()) + np.repeat(start[alone] - np.cumsum(n) + n, n)
                _, first, which = np.unique(rolling(part, LENGTH)[at], return_index=True, return_inverse=True)
                before = at[first][which]
                same = (before < at) & equal_windows(part, at, before)
                for w in (at[~same] + a).tolist():
                    piece = text[w : w + LENGTH]
                    send(xxhash.xxh3_64_intdigest(piece) % buckets, doc, dig, w, 1, piece)
                if same.any():
                    lo, hi = runs(at[same])
                    repeat(doc, dig, lo + a, hi + a + LENGTH)
    rows = [(b, block, "segments", len(x).to_bytes(8, "little") + np.array(x, SEGMENT).tobytes() + b"".join(y)) for b, (x, y) in out.items()]
    if len(found := np.concatenate(ranges)):
        rows.append((block % buckets, block, "ranges", found.tobytes()))
    return _table(rows)


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Tells each block which of its bytes repeat, from the suffixes of one bucket of segments."""
    rows, heads, blocks, texts = [], [], [], []
    for b, kind, p in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("payload"), strict=True):
        raw = p.as_py()
        if kind == "ranges":
            rows.append((-1, b, "ranges", raw))
            continue
        n = int.from_bytes(raw[:8], "little")
        head = np.frombuffer(raw, SEGMENT, n, 8)
        at = 8 + n * SEGMENT.itemsize
        for size in (head["count"] + LENGTH - 1).tolist():
            texts.append(raw[at : at + size])
            at += size
        heads.append(head)
        blocks.append(np.full(n, b, np.int64))
    if texts:
        head, block = np.concatenate(heads), np.concatenate(blocks)
        doc = np.lexsort((head["dig"], head["doc"]))
        new = np.ones(len(doc), bool)
        new[1:] = (head["doc"][doc][1:] != head["doc"][doc][:-1]) | (head["dig"][doc][1:] != head["dig"][doc][:-1])
        number = np.empty(len(doc), np.int64)
        number[doc] = np.cumsum(new)
        count = head["count"]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(head["start"], count) + inside
        found = earlier(texts, count, np.repeat(number, count) << 40 | start)
        owner = np.repeat(np.arange(len(count)), count)[found]
        start = start[found]
        if len(start):
            first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
            last = np.append(first[1:], len(start)) - 1
            ranges = np.zeros(len(first), RANGE)
            ranges["doc"], ranges["dig"], ranges["start"], ranges["end"] = head["doc"][owner[first]], head["dig"][owner[first]], start[first], start[last] + LENGTH
            of = block[owner[first]]
            order = np.argsort(of, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                rows.append((-1, int(of[part[0]]), "ranges", ranges[part].tobytes()))
    return _table(rows)


def _kept(raw: bytes, ranges: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the ranges, and the maximal removed runs."""
    if not len(ranges):
        return raw, []
    ranges = ranges[np.argsort(ranges["start"], kind="stable")]
    upto = np.maximum.accumulate(ranges["end"])
    new = np.flatnonzero(np.concatenate(([True], ranges["start"][1:] > upto[:-1])))
    start, end = ranges["start"][new].tolist(), upto[np.append(new[1:], len(ranges)) - 1].tolist()
    return b"".join(raw[a:b] for a, b in zip([0, *end], [*start, len(raw)], strict=True)), list(zip(start, end, strict=True))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_bytes: int | None = None, hot_places: int = HOT_PLACES, with_text: bool = True, extra: Sequence[str] = (), many: int = MANY) -> DataFrame:
    """Removes each byte that lies in a 100-byte string which also starts earlier: id, n_bytes, n_removed, n_spans, kept_sha256; with_text: kept, kept_text, spans.

    Earlier: in a document of smaller id, or before in the same. Null texts count as empty. Rows with one id and one text are
    one document and get one result each; of rows with one id and different texts that of the smaller text hash is the
    earlier; null ids come before all others. More than many rows that are equal in all columns read travel as one. kept has the remaining bytes, kept_text their whole characters. Columns in extra
    are returned after the id; other columns are not read.

    The texts are dealt out once, by a hash of id and text, and used in all three steps (one exchange, reused). All else that
    moves is a fraction of them: hashes, repeated segments, ranges. A minimizer comes once from a block, and one at very
    many places is replaced by its single windows, so no bucket grows with the most frequent passage.
    """
    prepare(df.sparkSession)
    fewer = equal_rows(df, text_col, [id_col, *extra], many)
    if fewer is not None:
        return spread(remove_repeats(fewer, id_col, text_col, n_bytes, hot_places, with_text, [*extra, "copies"], 1 << 62))
    n_bytes = text_bytes(df, text_col) if n_bytes is None else n_bytes
    blocks = block_count(n_bytes)
    bits = max(3, min(24, (n_bytes >> 21).bit_length()))
    buckets = max(8, n_bytes >> 20)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    lite = [key.alias("doc"), F.xxhash64(text).alias("dig"), F.col(f"`{id_col}`").alias("id")]
    block = F.pmod(F.xxhash64("doc", "dig"), F.lit(blocks)).cast("long").alias("block")
    also = [f"x{i}" for i in range(len(extra))]
    docs = df.select(*lite, text.cast("binary").alias("raw"), *[F.col(f"`{c}`").alias(x) for c, x in zip(extra, also, strict=True)]).select("doc", "dig", "id", "raw", *also, block).repartition("block")
    firsts = (
        df.select(*lite, F.sha2(text.cast("binary"), 256).alias("sha")).groupBy("sha").agg(F.min(F.struct("doc", "dig")).alias("d")).select("d.doc", "d.dig")
        .select(block, F.lit("first").alias("kind"), "doc", "dig", F.lit(None).cast("binary").alias("payload"))
    )
    told = lambda m: firsts.unionByName(m.select("block", "kind", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("dig"), "payload"))
    with_blocks = lambda messages: docs.groupBy("block").cogroup(messages.groupBy("block"))

    def minimizers(k, d, m):
        return _minimizers(k[0].as_py(), d, m, bits)

    def repeated(t):
        return _repeated(t, hot_places)

    def candidates(k, d, m):
        return _candidates(k[0].as_py(), d, m, buckets)

    def sort_bucket(t):
        return _sort_bucket(t)

    answers = with_blocks(firsts).applyInArrow(minimizers, MESSAGE_DDL).groupBy("bucket").applyInArrow(repeated, MESSAGE_DDL)
    sent = with_blocks(told(answers)).applyInArrow(candidates, MESSAGE_DDL)
    ranges = sent.groupBy("bucket").applyInArrow(sort_bucket, MESSAGE_DDL)
    out = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in (id_col, *extra)], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string, spans array<struct<start:long,end:long>>" * with_text)])

    def finish(d, m):
        from pyspark.sql.pandas.types import to_arrow_schema

        parts = _payloads(m, "ranges")
        found = np.concatenate([np.frombuffer(p, RANGE) for p in parts]) if parts else np.zeros(0, RANGE)
        found = found[np.lexsort((found["dig"], found["doc"]))]
        edges = np.flatnonzero((np.diff(found["doc"]) != 0) | (np.diff(found["dig"]) != 0)) + 1
        of = {(int(x["doc"][0]), int(x["dig"][0])): x for x in np.split(found, edges) if len(x)}
        first = {(a, b) for k, a, b in zip(m.column("kind").to_pylist(), m.column("doc").to_pylist(), m.column("dig").to_pylist(), strict=True) if k == "first"}
        given = [d.column(c) for c in ("id", *also)]
        cols = [[] for _ in out.names[len(given) :]]
        for a, b, r in zip(d.column("doc").to_pylist(), d.column("dig").to_pylist(), d.column("raw"), strict=True):
            raw = r.as_py()
            if (a, b) in first:
                kept, spans = _kept(raw, of.get((a, b), found[:0]))
            else:
                kept, spans = (b"", [(0, len(raw))]) if len(raw) >= LENGTH else (raw, [])
            for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore"), [{"start": x, "end": y} for x, y in spans]), strict=False):
                c.append(v)
        arrow = to_arrow_schema(out)
        pa.default_memory_pool().release_unused()
        return pa.table([*(c.cast(arrow.field(i).type) for i, c in enumerate(given)), *(pa.array(c, arrow.field(i).type) for i, c in enumerate(cols, len(given)))], schema=arrow)

    return with_blocks(told(ranges)).applyInArrow(finish, out)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)
