"""Building task registries from subtitles, shots and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import intervals as iv
from . import sampling as sp
from . import training as tr


def grounded(tasks: DataFrame, units: DataFrame) -> DataFrame:
    """Adds shot_ids: the shots of a task's video that touch its interval, in order of time; none is an empty array."""
    hit = iv.touch_join(tasks.select("task_id", "video_id", "start_ms", "end_ms"), units.select("video_id", "shot_id", "start_ms", "end_ms"), ["video_id"])
    shots = hit.groupBy("video_id", "task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("right_start_ms", "right_shot_id"))), lambda x: x["right_shot_id"]).alias("shot_ids"))
    return tasks.join(shots, ["video_id", "task_id"], "left").withColumn("shot_ids", F.coalesce("shot_ids", F.array().cast("array<string>")))


def dialogue_registry(utterances: DataFrame, units: DataFrame, split: str, prefix: str, first: int | None = None, spread: int | None = None) -> DataFrame:
    """Tasks from a video's meaningful utterances: the first so many, or so many spread evenly over all; with the shots that they touch."""
    clean = utterances.withColumn("text", tx.cleaned(F.col("text"))).where(tx.meaningful(F.col("text")))
    order = ["video_id", "start_ms", "utterance_id"]
    picked = sp.first_rows(clean, order, first) if first else sp.systematic(clean, order[1:], spread, ["video_id"]) if spread else clean
    numbered = picked.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "utterance_id")))
    return grounded(tr.dialogue_tasks(numbered, split, prefix), units)


def annotation_registry(raw: DataFrame, split: str) -> DataFrame:
    return tr.annotations(raw).withColumn("split", F.lit(split))


def registry_report(tasks: DataFrame) -> DataFrame:
    """One row: tasks and videos of each split, videos in all, and pairs of splits that share a video."""
    counts = tasks.groupBy("split").agg(F.count("*").alias("tasks"), F.count_distinct("video_id").alias("videos"))
    per_video = tasks.groupBy("video_id").agg(F.array_sort(F.collect_set("split")).alias("s"))
    both = per_video.where(F.size("s") > 1).select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.concat_ws("/", a, b))))).alias("pair"))
    shared = both.groupBy("pair").agg(F.count("*").alias("n"))
    return (
        counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.struct("tasks", "videos"))))).alias("splits"))
        .join(tasks.agg(F.count_distinct("video_id").alias("videos")))
        .join(shared.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "n")))).alias("shared")))
    )


def video_specs(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Videos (video_id, split, duration_ms, ...) with their artefacts (path, bytes, sha256), in order of path, and the number and bytes of their keyframes.

    files: video_id, path, bytes, sha256; those with a folder keyframes in their path are keyframes.
    """
    frame = F.array_contains(F.split("path", "/"), "keyframes")
    each = files.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.when(~frame, F.struct("path", "bytes", "sha256")))).alias("artifacts"),
        F.struct(F.count_if(frame).alias("count"), F.coalesce(F.sum(F.when(frame, F.col("bytes"))), F.lit(0)).alias("bytes")).alias("keyframe_inventory"),
    )
    return videos.join(each, "video_id", "left")


def manifest(specs: DataFrame, tasks: DataFrame, dataset_id: str, hard_limit: int, path: str) -> DataFrame:
    """One row: a dataset's manifest, with its videos' specs and the place and number of its tasks."""
    return specs.agg(F.array_sort(F.collect_list(F.struct(*specs.columns))).alias("videos")).join(tasks.agg(F.count("*").alias("n"))).select(
        F.lit(dataset_id).alias("dataset_id"), F.struct(F.lit(hard_limit).alias("hard_limit_bytes")).alias("capacity"), "videos",
        F.struct(F.lit(path).alias("path"), F.col("n").alias("count")).alias("tasks"),
    )
