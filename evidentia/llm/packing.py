"""Best-fit-decreasing packing of token pieces into sequences.

Best fit sees of a piece only its length, so the packing is computed from the number of pieces of each length (at most
2048 numbers, whatever the corpus) and for all pieces of a length that go to bins of one remaining capacity at once.
A segment tree over remaining capacities finds the tightest open bins in logarithmic time.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import dealt, documents, encoding, shared_checkpoint, slices, prepare, text_sizes, tokenizer_path

CAPACITY = 2048
SALTS = 256
SPECIAL = "<|endoftext|>"


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, ranks_path: str, json_path: str) -> np.ndarray:
    """Ids as tokenizers gives them for json_path, then id 0.

    The same vocabulary as ranks is four times as fast and gives the same ids but for the special token's string; it cannot
    split runs of some million white-space characters.
    """
    ids = None
    if SPECIAL not in text:
        try:
            ids = encoding(ranks_path).encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern needs more stack than its engine has
            pass
    if ids is None:
        ids = np.array(_tokenizer(json_path).encode(text, add_special_tokens=False).ids, "<u4")
    return np.append(ids.astype("<u4"), np.uint32(0)).astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but perhaps the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text (null: empty): id, piece, start, length, ids_crc32; with_ids: the ids too, two bytes each (the vocabulary has some 50,000). A narrow map."""
    ranks_path, json_path = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json")
    prepare(df.sparkSession)
    schema = T.StructType([df.schema[id_col], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for a, b in slices(text_sizes(batch.column(1))):
                row, cols = [], [[] for _ in arrow.names[1:]]
                for i, t in enumerate(batch.column(1).slice(a, b - a).to_pylist(), a):
                    ids = token_ids(t or "", ranks_path, json_path)
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        row.append(i)
                        for c, v in zip(cols, (k, s, n, zlib.crc32(ids[s : s + n].tobytes()), ids[s : s + n].astype("<u2").tobytes() if with_ids else None), strict=False):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())).cast(arrow.field(0).type), *(pa.array(c, arrow.field(k + 1).type) for k, c in enumerate(cols))], schema=arrow)

    return dealt(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))).mapInArrow(run, schema)


class Tightest:
    """Segment tree over remaining capacities: how many open bins have each, and the least capacity of at least some length that has any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, c: int, n: int) -> None:
        i = c + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def first(self, least: int) -> int | None:
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Plan of the packing that best-fit decreasing makes: rows (length, r0, sequence, each, offset).

    The piece with rank r >= r0 of its length (up to the next row's r0) goes to sequence + (r - r0) // each, at
    offset + (r - r0) % each * length. Bins in a run of consecutive numbers with the same contents stay together, so
    there are far fewer steps than pieces.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}
    tree, plan, n_bins = Tightest(capacity), [], 0

    def put(c: int, first: int, n: int) -> None:
        if c > 0 and n > 0:
            open_bins.setdefault(c, []).append((first, n))
            tree.add(c, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            c = tree.first(length)
            if c is None:
                c, first = capacity, n_bins
                n = -(-left // (c // length))
                n_bins += n
            else:
                first, n = open_bins[c].pop()
                tree.add(c, -n)
            each = c // length  # a bin stays the tightest for this length until it is full
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
            plan.append((length, rank, first, each, capacity - c))
            put(c - each * length, first, full)
            if rest:
                put(c - rest * length, first + full, 1)
            put(c, first + full + bool(rest), n - full - bool(rest))
            done = full * each + rest
            left, rank = left - done, rank + done
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, start, length, ids_crc32, perhaps ids), which must be cheap to read again.

    ids come out as array<int>. A piece's rank among those of its length comes from its rank in a salted group and the sizes of the groups before, so
    a length that a third of all pieces have is ranked in many tasks.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), "piece", "start", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity))
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = (
        salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start", "ids_crc32")) - 1)
        .join(before, ["length", "salt"])
        .select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col("before") + F.col("r")).cast("long").alias("r"))
    )
    names = pieces.columns
    plain = [f if f.name != "ids" else T.StructField("ids", T.ArrayType(T.IntegerType())) for f in pieces.schema]
    schema = T.StructType([*plain, *T.StructType.fromDDL("sequence_id long, offset long")])

    def listed(ids: pa.Array) -> pa.Array:
        raw = [x.as_py() for x in ids]
        ends = np.cumsum([0, *(len(x) // 2 for x in raw)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32)))

    def place(batches):
        p = plan.value
        key = (capacity - p[:, 0] << 44) + p[:, 1]
        for b in batches:
            length, r = b.column("length").to_numpy(zero_copy_only=False), b.column("r").to_numpy(zero_copy_only=False)
            at = p[np.searchsorted(key, (capacity - length << 44) + r, "right") - 1] if len(p) else np.zeros((len(r), 5), np.int64)
            step = r - at[:, 1]
            each = np.maximum(1, at[:, 3])
            yield pa.RecordBatch.from_arrays([*(b.column(n) if n != "ids" else listed(b.column(n)) for n in names), pa.array(at[:, 2] + step // each), pa.array(at[:, 4] + step % each * length)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs all documents: id, piece, start, length, ids_crc32 (with_ids: ids), sequence_id, offset.

    A document is its ids and a final 0, so a null or empty text is one piece of length 1. Only documents longer than
    capacity are cut. Repeated rows are packed each for itself; an empty table gives an empty one; other columns are not read.
    The tokenized pieces (no texts) are checkpointed once, since their lengths are needed before any can be placed; with_ids
    sends each piece's ids to its place in the packing, once.
    """
    return pack(shared_checkpoint(token_pieces(df, id_col, text_col, capacity, with_ids)), id_col, capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
