"""Transitions to shots, and series of clip scores to proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from . import quantiles as qt
from . import scans as sc
from .intervals import sweep_iou
from .metrics import retrieval_metrics


def build_shots(boundaries: DataFrame, durations: DataFrame, on: str = "video_id") -> DataFrame:
    """Contiguous shots from transitions (on, seq, time_s, score) and lengths (on, duration_s).

    Transitions outside (0, duration) are dropped; times are rounded to six places, and of equal ones the last score counts;
    the first shot has no score; the keyframe is the midpoint. A duration of zero or less is an error.
    """
    length = durations.select(on, F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(F.raise_error(F.lit("duration must be positive"))).alias("duration_s"))
    inner = boundaries.join(length, on).where("time_s > 0 and time_s < duration_s").select(on, F.round("time_s", 6).alias("t"), "seq", "score", "duration_s")
    cuts = inner.groupBy(on, "t", "duration_s").agg(F.max_by("score", "seq").alias("score"))
    cuts = cuts.unionByName(length.select(on, F.lit(0.0).alias("t"), "duration_s", F.lit(None).cast("double").alias("score")))
    w = Window.partitionBy(on).orderBy("t")
    out = cuts.withColumn("end_s", F.coalesce(F.lead("t").over(w), F.round("duration_s", 6))).withColumn("n", F.row_number().over(w))
    return out.select(
        on, F.format_string("shot_%04d", "n").alias("shot_id"), F.col("t").alias("start_s"), "end_s", F.round(F.col("end_s") - F.col("t"), 6).alias("duration_s"),
        F.round((F.col("t") + F.col("end_s")) / 2, 6).alias("keyframe_s"), F.col("score").alias("start_scene_score"),
    )


def smoothed(series: DataFrame, on: str = "series", at: str = "clip", score: str = "score", chunk: int = sc.CHUNK) -> DataFrame:
    """Adds sm, the mean of five neighbours with zeros beyond the ends (always a fifth of the sum). at: places from 0 without gaps."""
    return sc.beside(series, [on], at, 2, 2, lambda w: {"sm": F.sum(score).over(w.rowsBetween(-2, 2)) / 5}, chunk)


def limits(sm: DataFrame, on: str = "series") -> DataFrame:
    """(on, limit, top, n): max(72 % quantile, 0.52 * maximum) of the smoothed scores, their maximum and number."""
    most = sm.groupBy(on).agg(F.max("sm").alias("top"), F.count("*").alias("n"))
    return most.join(qt.quantiles(sm, [on], "sm", 0.72), on).select(on, F.greatest("quantile", 0.52 * F.col("top")).alias("limit"), "top", "n")


#: Clips that a run is widened by on either side; runs that then meet are one.
WIDENED = 2


def proposals(series: DataFrame, on: str = "series", at: str = "clip", score: str = "score", clip_ms: int = 2000, limit: int = 3, chunk: int = sc.CHUNK) -> DataFrame:
    """Intervals of high score in each series of clips (numbered from 0 without gaps).

    Clips at or above max(72 % quantile, 0.52 * maximum) of the smoothed scores form runs, which are widened by two clips on either
    side and merged where they meet; the best by 0.55 * mean + 0.45 * maximum are returned, earlier ones first on ties. A series of which
    no clip reaches that, as all its scores are below zero, has its peak as the only run. Series of fewer than five clips are scored on their own
    clips, since a five-wide kernel would be longer than they are.

    A clip is active, near an active one, or the begin of a merged run by what lies a few clips beside it, and runs are numbered by a running count
    of begins; so a series of any length is decoded in many tasks, chunk by chunk.
    """
    sm = checkpointed(smoothed(series.select(on, at, score), on, at, score, chunk))
    known = sm.join(limits(sm, on), on)
    peak = known.where("limit > top").groupBy(on).agg(F.min(F.when(F.col("sm") == F.col("top"), F.col(at))).alias("peak"))
    flagged = known.join(peak, on, "left").withColumn("active", F.coalesce(F.col(at) == F.col("peak"), F.col("sm") >= F.col("limit"))).select(on, at, "sm", "n", "active")
    apart, on_at = 2 * WIDENED + 1, F.col(at)

    def flags(w):
        any_ = lambda a, b: F.coalesce(F.max(F.col("active").cast("int")).over(w.rowsBetween(a, b)), F.lit(0)) == 1
        # A run begins at an active clip with none before it that it would meet; it is noted where its widened interval begins.
        begins = lambda k: F.coalesce(F.lead("active", k).over(w) & ~any_(k - apart, k - 1), F.lit(False))
        first = F.when(on_at == 0, begins(WIDENED) | begins(1) | (F.col("active") & ~any_(-apart, -1))).otherwise(begins(WIDENED))
        return {"inside": any_(-WIDENED, WIDENED), "begin": first.cast("long")}

    marked = sc.beside(flagged, [on], at, apart, apart, flags, chunk)
    islands = sc.running(marked, [on], at, {"island": F.col("begin")}, chunk).where("inside")
    scored = islands.groupBy(on, "island").agg(F.min(at).alias("l"), (F.max(at) + 1).alias("r"), (0.55 * F.avg("sm") + 0.45 * F.max("sm")).alias("sc"), F.max_by(at, F.struct("sm", -on_at)).alias("anchor"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(on).orderBy(F.desc(F.round("sc", 12)), "l"))).where(F.col("rank") <= limit)
    return ranked.select(on, F.col("rank").cast("long").alias("rank"), (F.col("l") * clip_ms).cast("long").alias("start_ms"), (F.col("r") * clip_ms).cast("long").alias("end_ms"), F.round("sc", 6).alias("score"), F.col("anchor").cast("long").alias("anchor"))


def baselines(series: DataFrame, on: str = "series", at: str = "clip", score: str = "score", clip_ms: int = 2000) -> DataFrame:
    """The best clip of each series (the first on ties), and the five clips about it as far as the series goes."""
    best = series.groupBy(on).agg(F.max_by(at, F.struct(score, -F.col(at))).alias("peak"), F.count("*").alias("n"))
    return best.select(
        on, (F.col("peak") * clip_ms).cast("long").alias("peak_start_ms"), ((F.col("peak") + 1) * clip_ms).cast("long").alias("peak_end_ms"),
        (F.greatest(F.lit(0), F.col("peak") - 2) * clip_ms).cast("long").alias("fixed_start_ms"), (F.least(F.col("n"), F.col("peak") + 3) * clip_ms).cast("long").alias("fixed_end_ms"),
    )


#: Tasks without a series that a report names; of more it gives the number.
NAMED = 20


def held_out(series: DataFrame, targets: DataFrame, tasks: DataFrame, on: str = "series", at: str = "clip", score: str = "score", clip_ms: int = 2000) -> DataFrame:
    """(method, n, mean_iou, r1_30, r1_50, r1_70, missing, missing_ids): how the first proposal of each method fares on the tasks' targets.

    series: on, at, score (calibrated); targets: on, start_ms, end_ms, several of a task counting as one set; tasks: on. Methods are the best clip (peak),
    five clips about it (fixed) and the best run (adaptive). Tasks without a series are not scored but counted and listed, the least first.
    """
    known = tasks.select(on).distinct().join(series.select(on).distinct(), on, "left_semi")
    b = baselines(series, on, at, score, clip_ms)
    span = lambda df, name, s, e: df.select(on, F.lit(name).alias("method"), F.col(s).alias("start_ms"), F.col(e).alias("end_ms"))
    found = span(b, "peak", "peak_start_ms", "peak_end_ms").unionByName(span(b, "fixed", "fixed_start_ms", "fixed_end_ms")).unionByName(span(proposals(series, on, at, score, clip_ms, 1), "adaptive", "start_ms", "end_ms"))
    found = checkpointed(found.join(known, on, "left_semi"))
    truth = targets.join(known, on, "left_semi").join(found.select("method").distinct()).select(on, "method", "start_ms", "end_ms")
    scored = retrieval_metrics(sweep_iou(found, truth, [on, "method"]), ["method"])
    gone = tasks.select(on).distinct().join(known, on, "left_anti")
    first = gone.orderBy(on).limit(NAMED).agg(F.array_join(F.array_sort(F.collect_list(on)).cast("array<string>"), ",").alias("missing_ids"))
    return scored.join(F.broadcast(gone.agg(F.count("*").alias("missing")))).join(F.broadcast(first))
