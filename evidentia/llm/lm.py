"""N-gram scoring from a log-frequency Bloom filter of quantised counts.

Documents are dealt into blocks of bounded size. A block sends what it counted (hashes of words and of word pairs, each
once) to buckets of the hash space; a bucket adds up the blocks' counts, fills its own slice of the Bloom filter, and
answers each block with the exact training counts of the block's words and the levels that the slice has for its words
and pairs. Blocks then score their documents. No slice leaves its bucket, and each is as large as its entries ask for, so
the filter grows with the corpus and is as exact for a large one as for a small one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MANY, block_count, documents, equal_rows, mix64, packed, prepare, remainder, segment_sums, shared_checkpoint, spread, text_bytes, unpacked, word_codes

#: Quantisation base: a count c is stored as 1 + floor(log_BASE(c)) entries, one a level.
BASE = 2.0
#: Larger blocks send fewer words twice.
BLOCK_BYTES = 6 << 20
PROBES = 4
#: Least bits of the filter for each entry: 4 probes then report at most 1.2 % of what is not there, at any size of the corpus.
BITS_PER_ENTRY = 10
#: Text, in bytes, for each bucket of the hash space, and the most bits of a bucket's number (unigram_hash keeps so many).
BUCKET_BYTES, MOST_BUCKET_BITS = 4e6, 20
#: Weight, in tokens, of the unigram distribution in that of a context.
MU = 4.0
LEVELS = 40
#: Bits of a fingerprint; with those that choose its bucket it tells n-grams apart far better than the filter does.
WIDTH = 40
END = b"\n"  # no word has white space


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)


def unigram_hash(word: np.ndarray) -> np.ndarray:
    """Keeps the leading bits, so that a word's bucket is also its slice of the filter."""
    return word >> np.uint64(44) << np.uint64(44) | mix64(word ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(20)


def fingerprint(h: np.ndarray, bits: int) -> np.ndarray:
    """The WIDTH bits after those that choose the bucket: in the order of the hashes of a bucket."""
    return h << np.uint64(bits) >> np.uint64(64 - WIDTH)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """Count that a level stands for: the middle of those that have it (0: none)."""
    low, high = np.ceil(BASE ** (level - 1.0)), np.ceil(BASE**level) - 1
    return np.where(level > 0, (low + np.maximum(low, high)) / 2, 0.0)


def bucket_bits(n_bytes: int) -> int:
    """Bits of a bucket's number."""
    return max(3, min(MOST_BUCKET_BITS, math.ceil(math.log2(max(1, n_bytes / BUCKET_BYTES)))))


def slice_bits(counts: np.ndarray) -> int:
    """Size, as a power of two, of a slice that holds these counts: BITS_PER_ENTRY at least."""
    return max(6, math.ceil(math.log2(max(1, BITS_PER_ENTRY * int(levels_of(counts).sum())))))


class Filter:
    """A slice of a Bloom filter: the leading bits of a hash choose the slice, the bits after them and a level the bits in it."""

    def __init__(self, bits: int, size: int):
        self.bucket_bits, self.slice_bits = bits, size
        self.bits = np.zeros(1 << size - 3, np.uint8)

    def _places(self, fingerprints: np.ndarray, level: int) -> list[np.ndarray]:
        h = mix64(fingerprints + np.uint64(level * 0xA0761D6478BD642F & (1 << 64) - 1))
        a, b = h >> np.uint64(32), h | np.uint64(1)
        mask = np.uint64((1 << self.slice_bits) - 1)
        return [(a + np.uint64(i) * b >> np.uint64(3)) & mask for i in range(PROBES)]

    def add(self, fingerprints: np.ndarray, counts: np.ndarray) -> None:
        levels = levels_of(counts)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for p in self._places(fingerprints[levels >= level], level):
                np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def level(self, h: np.ndarray) -> np.ndarray:
        """Levels of hashes of this slice's bucket."""
        return self.found(fingerprint(h, self.bucket_bits))

    def found(self, fingerprints: np.ndarray) -> np.ndarray:
        """Highest level so far as all levels up to it are found, by repeated membership probes."""
        out, todo = np.zeros(len(fingerprints), np.int64), np.arange(len(fingerprints))
        for level in range(1, LEVELS + 1):
            for i in range(PROBES):
                p = self._places(fingerprints[todo], level)[i]
                todo = todo[self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0]
                if not len(todo):
                    return out
            out[todo] = level
        return out


def short(sorted_fp: np.ndarray) -> bytes:
    """Differences in four bytes each; those that do not fit follow in full."""
    step = np.diff(sorted_fp, prepend=np.uint64(0))
    few = np.minimum(step, np.uint64(0xFFFFFFFF)).astype("<u4")
    return few.tobytes() + step[few == 0xFFFFFFFF].astype("<u8").tobytes()


def from_short(raw: bytes, n: int) -> np.ndarray:
    few = np.frombuffer(raw, "<u4", n)
    step = few.astype(np.uint64)
    step[few == 0xFFFFFFFF] = np.frombuffer(raw, "<u8", (len(raw) - 4 * n) // 8, 4 * n)
    return np.cumsum(step, dtype=np.uint64)


def _words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Tokens of all texts, each text's closed by END, and their numbers."""
    tokens, n = [], []
    for t in texts:
        w = (t or "").encode().lower().split()
        n.append(len(w) + 1)
        tokens += w
        tokens.append(END)
    return tokens, np.array(n, np.int64)


def _digests(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hashes of words, in two parts: exact counts are kept under both."""
    import xxhash

    d = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), ">u8").reshape(-1, 2)
    return d[:, 0].astype(np.uint64), (d[:, 1] >> np.uint64(32)).astype(np.uint32)


class Block:
    """Tokens of a block's documents as codes, its distinct words and pairs in the order of their hashes, and where buckets begin."""

    def __init__(self, texts: list[str | None], bucket_bits: int):
        tokens, self.n = _words(texts)
        codes, distinct = word_codes(tokens)
        hi, lo = _digests(distinct)
        order = np.lexsort((lo, hi))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.codes, self.hi, self.lo = place[codes], hi[order], lo[order]
        self.cuts = np.searchsorted(bucket_of(self.hi, bucket_bits), np.arange((1 << bucket_bits) + 1))
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        first = np.zeros(len(codes), bool)
        first[np.cumsum(self.n) - self.n] = True
        word = self.hi[self.codes]
        before = np.where(first, np.uint64(1), np.concatenate(([np.uint64(1)], word[:-1])))
        self.first = first
        self.pairs, self.pair = np.unique(pair_hash(before, word), return_inverse=True)
        self.pair_cuts = np.searchsorted(bucket_of(self.pairs, bucket_bits), np.arange((1 << bucket_bits) + 1))


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _count_block(texts: list[str | None], copies: np.ndarray, block: int, bits: int) -> pa.Table:
    """Rows (bucket, block, words, pairs): hi, lo and training count of each word; fingerprint and training count of each pair (0: only held out).

    copies: how often a text counts in training.
    """
    b = Block(texts, bits)
    each = copies[b.doc]
    count = np.bincount(b.codes, each, minlength=len(b.hi)).astype("<i8")
    n = np.bincount(b.pair, each, minlength=len(b.pairs)).astype("<i8")
    rows = {"bucket": [], "block": [], "words": [], "seen": [], "pairs": [], "n_pairs": [], "counts": []}
    for k in range(1 << bits):
        w, p = slice(b.cuts[k], b.cuts[k + 1]), slice(b.pair_cuts[k], b.pair_cuts[k + 1])
        if w.start < w.stop or p.start < p.stop:
            rows["bucket"].append(k)
            rows["block"].append(block)
            rows["words"].append(b.hi[w].tobytes() + b.lo[w].tobytes())
            rows["seen"].append(packed(count[w]))
            rows["pairs"].append(short(fingerprint(b.pairs[p], bits)))
            rows["n_pairs"].append(p.stop - p.start)
            rows["counts"].append(packed(n[p]))
    return pa.table(rows, schema=COUNTED)


COUNTED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("seen", pa.binary()), ("pairs", pa.binary()), ("n_pairs", pa.int64()), ("counts", pa.binary())])
ANSWERED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("levels", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
ANSWERED_DDL = "bucket long, block long, payload binary, levels binary, tokens long, distinct long"


def _add_up(table: pa.Table, bits: int) -> pa.Table:
    """Of one bucket, for each block: the training counts of the block's words, and the filter's levels of its words and pairs; the first row has the bucket's sums."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_pylist()
    raw = [x.as_py() for x in table.column("words")]
    sizes = np.array([len(x) // 12 for x in raw])
    hi = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(raw, sizes, strict=True)])
    lo = np.concatenate([np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(raw, sizes, strict=True)])
    c = np.concatenate([unpacked(x.as_py(), n) for x, n in zip(table.column("seen"), sizes.tolist(), strict=True)])
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    group = np.cumsum(new) - 1
    total = np.add.reduceat(c[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = total[group]
    seen = total > 0
    each = fingerprint(unigram_hash(hi[order][new]), bits)
    many = table.column("n_pairs").to_pylist()
    fp = np.concatenate([from_short(x.as_py(), k) for x, k in zip(table.column("pairs"), many, strict=True)])
    n = np.concatenate([unpacked(x.as_py(), k) for x, k in zip(table.column("counts"), many, strict=True)])
    o = np.argsort(fp)
    first = np.ones(len(fp), bool)
    first[1:] = fp[o][1:] != fp[o][:-1]
    distinct = fp[o][first]
    times = np.add.reduceat(n[o], np.flatnonzero(first)) if len(fp) else np.zeros(0, np.int64)
    f = Filter(bits, slice_bits(np.concatenate((total[seen], times[times > 0]))))
    f.add(each[seen], total[seen])
    f.add(distinct[times > 0], times[times > 0])
    words, pairs = f.found(each).astype(np.uint8)[group], np.empty(len(fp), np.uint8)
    pairs[o] = f.found(distinct).astype(np.uint8)[np.cumsum(first) - 1]
    word = np.empty(len(order), np.uint8)
    word[order] = words
    ends, pair_ends = np.cumsum(sizes), np.cumsum(many)
    answers = [packed(back[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
    levels = [zlib.compress(word[e - s : e].tobytes() + pairs[q - k : q].tobytes(), 1) for s, e, k, q in zip(sizes, ends, many, pair_ends, strict=True)]
    rest = [0] * (len(blocks) - 1)
    return pa.table(
        {"bucket": [bucket] * len(blocks), "block": blocks, "payload": answers, "levels": levels, "tokens": [int(total.sum()), *rest], "distinct": [int(seen.sum()), *rest]},
        schema=ANSWERED,
    )


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, n_bytes: int | None = None, many: int = MANY) -> DataFrame:
    """Scores every whole text: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the documents whose crc32(id as text) modulo folds is not fold (a null id is trained on). base_score has exact
    add-one unigram counts; score is log10 of the product over tokens of (c(v w) + MU p(w)) / (max(c(v), c(v w)) + MU), v being the
    token before, p(w) = (c(w) + 1) / (N + V + 1), and all c read from the filter. Null and empty texts are one end token.
    Repeated rows count as often as they are there; more than MANY equal ones travel as one, so a block's size is bounded. With nothing to train on, N = V = 0 and each token scores log10(1) = 0.
    Blocks and buckets grow in number with the corpus, not in size; a word comes at most once from a block, so a
    frequent one is no hot key. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    n_bytes = text_bytes(df, text_col) if n_bytes is None else n_bytes
    blocks = block_count(n_bytes, BLOCK_BYTES)
    bits = bucket_bits(n_bytes)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fewer = equal_rows(rows, "text", ["id"], many)
    rows = (rows.withColumn("copies", F.lit(1).cast("long")) if fewer is None else fewer).select(
        "id", "text", "copies", F.coalesce(remainder(F.col("id"), folds) == fold, F.lit(False)).alias("held"),
        F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(blocks)).cast("long").alias("block"),
    ).repartition("block")

    def count(key, table):
        held = table.column("held").to_numpy(zero_copy_only=False).astype(bool)
        return _count_block(table.column("text").to_pylist(), np.where(held, 0, table.column("copies").to_numpy()), key[0].as_py(), bits)

    def add_up(table):
        return _add_up(table, bits)

    counted = rows.groupBy("block").applyInArrow(count, "bucket long, block long, words binary, seen binary, pairs binary, n_pairs long, counts binary")
    answered = shared_checkpoint(counted.groupBy("bucket").applyInArrow(add_up, ANSWERED_DDL))
    sums = answered.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + ", copies long" * (fewer is not None))])

    def score(key, docs, answers):
        from pyspark.sql.pandas.types import to_arrow_schema

        if not docs.num_rows:
            return to_arrow_schema(out).empty_table()
        b = Block(docs.column("text").to_pylist(), bits)
        exact, word, pair = np.zeros(len(b.hi), np.int64), np.zeros(len(b.hi), np.int64), np.zeros(len(b.pairs), np.int64)
        for k, x, y in zip(answers.column("bucket").to_pylist(), answers.column("payload"), answers.column("levels"), strict=True):
            w, p = slice(b.cuts[k], b.cuts[k + 1]), slice(b.pair_cuts[k], b.pair_cuts[k + 1])
            exact[w] = unpacked(x.as_py(), w.stop - w.start)
            levels = np.frombuffer(zlib.decompress(y.as_py()), np.uint8)
            word[w], pair[p] = levels[: w.stop - w.start], levels[w.stop - w.start :]
        base = np.log10((exact + 1.0) / (n + v + 1.0))
        uni = expected(word)
        p = (uni + 1.0) / (n + v + 1.0)
        both = expected(pair)[b.pair]
        of = uni[np.concatenate(([0], b.codes[:-1]))] if len(b.codes) else uni
        end = np.searchsorted(b.hi, _digests([END])[0])[0]
        of = np.where(b.first, uni[end], of)  # as many starts as ends
        prob = np.minimum(1.0, (both + MU * p[b.codes]) / (np.maximum(of, both) + MU))
        cols = [
            docs.column("id"), docs.column("held"), pa.array(b.n), pa.array(segment_sums((exact[b.codes] > 0).astype(np.int64), b.n)), pa.array(np.full(len(b.n), n, np.int64)),
            pa.array(segment_sums(base[b.codes], b.n)), pa.array(segment_sums(np.log10(prob), b.n)),
        ]
        return pa.table([*cols, docs.column("copies")][: len(out)], schema=to_arrow_schema(out))

    scored = rows.groupBy("block").cogroup(answered.select("block", "bucket", "payload", "levels").groupBy("block")).applyInArrow(score, out)
    return scored if fewer is None else spread(scored)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
