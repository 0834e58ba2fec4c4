"""What the training-data operators share: per-document Arrow maps, blocks of documents, hashing, checkpoints."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dealt, new_path, prepare, shared_folder  # noqa: F401

#: Bytes of text that a Python worker takes at once.
SLICE_BYTES = 1 << 20
#: Bytes of text in a block of documents that one task call takes whole.
BLOCK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Has the shuffles of a lineage-cutting action deleted with it; the session's own setting is back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        return df.select("*").checkpoint()


def shared_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Cuts the lineage with a Parquet table in the shared folder, for wide rows of which later steps read few columns: the table and its path."""
    path = new_path(df.sparkSession, "table")
    with shuffles_deleted(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of shared_table, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that are equal in all that an operator reads, if there are more of them than that, travel as one row with their number.
MANY = 1000
#: Rows that a step of spread() makes of one.
SPREAD = 1 << 12


def equal_rows(df: DataFrame, text_col: str, others: Sequence[str], many: int = MANY) -> DataFrame | None:
    """df's columns others and text_col with copies, the number of rows that were equal in them; None if no more than many rows are.

    Found by digests (pre-aggregated, so not even a third of all rows is a hot key), at most one row in many; rows of fewer copies stay single.
    """
    cols = [F.col(f"`{c}`") for c in (*others, text_col)]
    keyed = df.select(*cols, F.xxhash64(*cols).alias("__dig"))
    heavy = keyed.groupBy("__dig").agg(F.count("*").alias("n")).where(F.col("n") > many).select("__dig")
    if not heavy.limit(1).count():
        return None
    heavy = shared_checkpoint(heavy)
    single = keyed.join(heavy, "__dig", "left_anti").select(*cols, F.lit(1).cast("long").alias("copies"))
    return keyed.join(heavy, "__dig", "left_semi").groupBy(*cols).agg(F.count("*").alias("copies")).unionByName(single)


def spread(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its column copies says, without that column; no array is longer than the root of a trillion."""
    first = df.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(SPREAD).cast("long"))))
    return first.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SPREAD).cast("long"), F.col(copies) - F.col("__from"))))).drop(copies, "__from", "__one")


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; EVIDENTIA_TOKENIZERS names another folder."""
    if folder := os.environ.get("EVIDENTIA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoding(path: str):
    """The tiktoken encoding of a rank file; one a worker, whoever uses it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with at most limit bytes, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def per_document(df: DataFrame, id_col: str, text_col: str, out: str, fn: Callable[[list[str]], Sequence], extra: Sequence[str] = ()) -> DataFrame:
    """Narrow map (a small table is dealt over all cores before): the id, the columns in extra and what fn makes of a slice of texts (null: empty), as columns of the DDL in out.

    Other columns of df are pruned before the scan, so their names cannot clash.
    """
    first = [df.schema[c] for c in (id_col, *extra)]
    made = T.StructType.fromDDL(out)
    schema = T.StructType([*first, *made])
    k = len(first)
    prepare(df.sparkSession)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            text = batch.column(k)
            for a, b in slices(text_sizes(text)):
                cols = fn([x or "" for x in text.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a).cast(arrow.field(i).type) for i in range(k)] + [pa.array(c, arrow.field(k + i).type) for i, c in enumerate(cols)], schema=arrow)
            pa.default_memory_pool().release_unused()

    return dealt(df.select(*[F.col(f"`{c}`") for c in (id_col, *extra)], F.col(f"`{text_col}`").cast("string").alias("__text"))).mapInArrow(run, schema)


def text_sizes(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_pylist()


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


#: Hashes are drawn from 0 to HASHES - 1, so a share of any table is a whole number of them.
HASHES = 1 << 62


def hash_bound(n: int, each: int) -> int:
    """Below it lie the hashes of at least each of n rows, save with a chance of some 1e-9, and of few more; of all, if there are no more."""
    return HASHES if n <= each else min(HASHES, int(HASHES * ((each + 6 * each**0.5 + 20) / n)))


def least_hashes(rows: DataFrame, label: str, id_col: str, counts: dict, each: int, seed: str) -> DataFrame:
    """The rows with the each least hashes of their id for each label of counts (label: rows of it), at any size; all of a label that has fewer."""
    from pyspark.sql.window import Window

    bound = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, hash_bound(n, each))])
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).bitwiseAND(F.lit(HASHES - 1))
    near = rows.withColumn("__h", h).where(F.col("__h") < bound[F.col(label)])
    first = Window.partitionBy(label).orderBy("__h", id_col)
    return near.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= each).drop("__h", "__r")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan of one column."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("n")).first()["n"] or 0


def block_count(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(8, -(-n_bytes // block_bytes))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(counts: np.ndarray) -> bytes:
    """A byte for each count; the 255 and over follow in full."""
    few = np.minimum(counts, 255).astype(np.uint8)
    return few.tobytes() + counts[few == 255].astype("<i8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    few = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    few[few == 255] = np.frombuffer(raw, "<i8", (len(raw) - n) // 8, n)
    return few


def word_codes(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Code of each word, by first appearance, and the distinct words."""
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return codes, list(seen)


def word_hashes(distinct: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case: what bytes.lower and bytes.split do."""
    return (text or "").encode().lower().split()


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each of the consecutive runs, empty ones included."""
    out = np.zeros((len(lengths), *values.shape[1:]), values.dtype)
    if len(values):
        full = lengths > 0
        out[full] = np.add.reduceat(values, starts_of(lengths)[full], axis=0)
    return out
