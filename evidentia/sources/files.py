"""Files: JSON lines, whole JSON, CSV, embeddings, inventories, hashes; and the sinks."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as vx
from ..functions.timecode import seconds_to_ms

EXCLUDED = (".git", "__pycache__", "tmp")
SHOT = "shot_id string, start_s double, end_s double, duration_s double, keyframe_s double, start_scene_score double, keyframe_path string"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank ones are skipped. A schema spares the pass that infers one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_ordered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with pos, the line's place among those that are not blank, from 0; of several files in order of their paths.

    The files are read in splits, in many tasks: lines are numbered within a split as they are read, and a split's first number comes from the lines of
    those before it, of which there is a row each.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    placed = lines.where(F.col("value").rlike(r"\S")).withColumn("__id", F.monotonically_increasing_id())  # one after the other within a split
    splits = placed.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    at = splits.select("__file", "__block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    numbered = placed.join(at, ["__file", "__block"]).select((F.col("__id") + F.col("__shift")).alias("pos"), F.from_json("value", schema).alias("r"))
    return numbered.select("pos", "r.*")


TASK = "task_id string, query string, search_terms array<string>, target_start_ms long, target_end_ms long, split string"


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Flat tasks in file order."""
    return read_ordered_jsonl(spark, path, TASK)


def read_yaml(path: str) -> dict:
    """A configuration, on the driver; needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, clip, embedding) of NPZ features, rows of length one."""
    raw = read_npz(spark, path, ids="", vectors="features")
    return raw.select("path", F.col("id").cast("int").alias("clip"), vx.normalized(vx.doubles(F.col("embedding"))).alias("embedding"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def load_shots(spark: SparkSession, path: str) -> DataFrame:
    """Shots in file order with times in milliseconds, rounded half to even."""
    s = read_ordered_jsonl(spark, path, SHOT)
    return s.select("pos", "shot_id", seconds_to_ms(F.col("start_s")).alias("start_ms"), seconds_to_ms(F.col("end_s")).alias("end_ms"), seconds_to_ms(F.col("keyframe_s")).alias("keyframe_ms"), "keyframe_path")


def opened(path: str):
    """A file of a path as Spark gives it, for reading in blocks: through Python where it is local (or on a mounted share), else through Arrow's file systems."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


#: Schemes of paths that opened() can read; files of others come through Spark, whole.
STREAMED = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
#: Bytes that are read at a time.
BLOCK = 8 << 20


def _files(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, bool]:
    """path, bytes of files and, where opened() cannot read them, content; and whether it can. Without content only the listing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    scheme = path.partition("://")[0] if "://" in path else spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    streamed = path.startswith("file:") or scheme in STREAMED
    return found.select("path", F.col("length").alias("bytes"), *([] if streamed else ["content"])), streamed


def member_blocks(archive, name: str, block: int = BLOCK):
    """The array of a member of an open NPZ archive in blocks of rows of some bytes, without holding it whole."""
    import numpy as np

    with archive.zip.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran or kind.hasobject or not shape:  # no rows one after the other
            yield archive[name]
            return
        row = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        step = max(1, block // max(1, row))
        for a in range(0, shape[0], step):
            n = min(step, shape[0] - a)
            yield np.frombuffer(f.read(n * row), kind).reshape(n, *shape[1:])


def read_npz(spark: SparkSession, path: str, ids: str = "shot_ids", vectors: str = "embeddings") -> DataFrame:
    """(path, id, embedding) of NPZ archives, a file at a time on the executors; members are read in blocks. Without ids rows are numbered."""
    files, streamed = _files(spark, path)

    def unpack(batches):
        import numpy as np

        for b in batches:
            for r in b.itertuples():
                with opened(r.path) if streamed else io.BytesIO(r.content) as f, np.load(f) as z:
                    names, at = (z[ids] if ids in z else None), 0
                    for m in member_blocks(z, vectors):
                        part = [str(x) for x in (names[at : at + len(m)] if names is not None else range(at, at + len(m)))]
                        at += len(m)
                        yield pd.DataFrame({"path": r.path, "id": part, "embedding": list(m.astype("float32"))})

    return files.mapInPandas(unpack, "path string, id string, embedding array<float>")


def read_vectors(spark: SparkSession, path: str | None) -> DataFrame:
    """Stored query vectors (id, embedding) as Parquet; none if there is no such path."""
    if path is None:
        return spark.createDataFrame([], "id string, embedding array<float>")
    return spark.read.parquet(path)


def listing(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path below root, bytes) of all files, without excluded folders. The contents are pruned, so only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", "\\.") + "/", "").alias("path"), F.col("length").alias("bytes"))
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes by first folder, the largest first."""
    return files.groupBy(F.split("path", "/")[0].alias("top")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "top")


def hashes(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """(path, bytes, sha256 in upper case) of all files below a folder (only: of those of these local paths), of any size: a task reads its files in blocks."""
    files, streamed = _files(spark, root, True)
    if only is not None:
        files = files.join(F.broadcast(spark.createDataFrame([(f"file:{p}",) for p in only], "path string").distinct()), "path", "left_semi")
    if not streamed:
        return files.select("path", "bytes", F.upper(F.sha2("content", 256)).alias("sha256"))

    def run(batches):
        for b in batches:
            for path, n in zip(b.path, b.bytes, strict=True):
                digest = hashlib.sha256()
                with opened(path) as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                yield pd.DataFrame({"path": [path], "bytes": [n], "sha256": [digest.hexdigest().upper()]})

    return files.mapInPandas(run, "path string, bytes long, sha256 string")


def ordered_digest(df: DataFrame, on: list[str], order: str, part: Column, separator: bytes = b"") -> DataFrame:
    """(on, sha256 in upper case, files): one hash of the parts (binary) of a key's rows in order, joined by a separator.

    The rows of a key are sorted and hashed as they stream by, so a task holds a batch of them whatever their number.
    """
    schema = T.StructType([*[df.schema[c] for c in on], *T.StructType.fromDDL("sha256 string, files long")])
    rows = df.select(*on, F.col(order).alias("__at"), part.alias("__part"))
    rows = (rows.repartition(*on) if on else rows.repartition(1)).sortWithinPartitions(*on, "__at", "__part")

    def run(batches):
        key, digest, n = None, None, 0
        done = lambda: pd.DataFrame([(*key, digest.hexdigest().upper(), n)], columns=schema.names)
        for b in batches:
            for *k, _, raw in b.itertuples(index=False):
                if key != (k := tuple(k)):
                    if key is not None:
                        yield done()
                    key, digest, n = k, hashlib.sha256(), 0
                elif separator:
                    digest.update(separator)
                digest.update(raw)
                n += 1
        if key is not None:
            yield done()

    return rows.mapInPandas(run, schema)


def combined_hash(files: DataFrame, name: str = "name", sha: str = "sha256") -> DataFrame:
    """One hash over files in name order: each name's bytes, then its digest's bytes. An empty table gives no row."""
    return ordered_digest(files, [], name, F.concat(F.encode(name, "UTF-8"), F.unhex(sha)))


def artifacts(files: DataFrame) -> DataFrame:
    """One row with all artefact records, as a manifest holds them."""
    return files.agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("artifacts"))


def safe_path(root: str, relative: str) -> str:
    """The path below root; one that leaves it is an error."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, relative))
    if os.path.commonpath([base, full]) != base:
        raise ValueError(f"path escapes the repository: {relative}")
    return full


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header, in one file if bom (the mark begins the file)."""
    if not bom:
        return df.write.mode("overwrite").option("header", True).csv(path)
    return df.coalesce(1).select(*[F.col(c).alias("﻿" * (i == 0) + c) for i, c in enumerate(df.columns)]).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def cut_list(results: DataFrame) -> DataFrame:
    """What a cutting tool needs of successful results: task_id, video, start and length in seconds."""
    return results.where("success").select("task_id", "video_id", (F.col("predicted_start_ms") / 1000).alias("start_s"), ((F.col("predicted_end_ms") - F.col("predicted_start_ms")) / 1000).alias("length_s"))


def package_selection(files: DataFrame, folders: list[str], names: list[str], skip_parts: tuple[str, ...] = EXCLUDED, skip_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files (path, ...) that a package takes, by name or by their folder, without those in a folder or with a suffix to skip; in order."""
    parts = F.split("path", "/")
    inside = reduce(Column.__or__, [F.startswith("path", F.lit(f.rstrip("/") + "/")) for f in folders], F.col("path").isin(*names))
    skipped = reduce(Column.__or__, [F.endswith(F.lower("path"), F.lit(x)) for x in skip_suffixes], F.arrays_overlap(parts, F.array(*map(F.lit, skip_parts))))
    return files.where(inside & ~skipped).orderBy("path")


def write_package(root: str, paths: list[str], target: str) -> list[dict]:
    """A ZIP archive of files below root, and in it a manifest with their sizes and hashes, which is returned; on the driver, a file at a time."""
    listed = []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(paths):
            with open(safe_path(root, p), "rb") as f:
                raw = f.read()
            z.writestr(p, raw)
            listed.append({"path": p, "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest().upper()})
        z.writestr("manifest.json", json.dumps({"files": listed}, indent=1))
    return listed
