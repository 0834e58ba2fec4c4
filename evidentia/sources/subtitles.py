"""SRT subtitles and scene-detection logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import timecode as tc
from ..operators.intervals import clip

ARROW = r"^(\S+)\s+-->\s+(\S+).*$"


def parse_srt(files: DataFrame, text: str = "text") -> DataFrame:
    """Cues of whole SRT texts, other columns kept: cue (from 0), start_ms, end_ms, text.

    Blocks of fewer than two lines are dropped, a number before the times is optional, a byte-order mark and carriage returns
    go; a block whose times do not parse is an error when read.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    blocks = files.withColumn("__b", F.split(clean, r"\n\s*\n"))
    lines = blocks.select(*[c for c in files.columns if c != text], F.posexplode("__b").alias("__at", "__block")).withColumn("__l", F.filter(F.split(F.trim(F.regexp_replace("__block", r"^\s+|\s+$", "")), "\n"), lambda x: x.isNotNull()))
    lines = lines.where(F.size("__l") >= 2)
    skip = F.when(F.col("__l")[0].rlike(r"^\s*\d+\s*$"), 1).otherwise(0)
    when = F.element_at("__l", skip + 1)
    ms = lambda i: F.coalesce(tc.to_ms(F.regexp_extract(when, ARROW, i)), F.raise_error(F.concat(F.lit("invalid times: "), when)).cast("long"))
    body = F.array_join(F.slice("__l", skip + 2, F.greatest(F.lit(1), F.size("__l"))), "\n")
    keep = [c for c in files.columns if c != text]
    w = Window.partitionBy(*keep).orderBy("__at") if keep else Window.orderBy("__at")
    return lines.select(*keep, (F.row_number().over(w) - 1).alias("cue"), ms(1).alias("start_ms"), ms(2).alias("end_ms"), body.alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def cue_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.format_string("%d\n%s --> %s\n%s\n", number, tc.from_ms(start), tc.from_ms(end), text)


def render_srt(cues: DataFrame, on: list[str]) -> DataFrame:
    """The SRT text of each key's cues, numbered from 1 in order of cue."""
    each = cues.withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy("cue")))
    block = F.struct("__n", cue_block(F.col("__n"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("b"))
    return each.groupBy(*on).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n").alias("text"))


def clip_srt(cues: DataFrame, on: list[str], start_s: float, duration_s: float) -> DataFrame:
    """Subtitles of a stretch given in seconds, counted from its start; a cue beyond the end would be an error."""
    start, end = round(start_s * 1000), round((start_s + duration_s) * 1000)
    cut = clip(cues, start, end)
    checked = cut.withColumn("end_ms", F.when(F.col("end_ms") <= end - start, F.col("end_ms")).otherwise(F.raise_error(F.lit("cue beyond the clip")).cast("long")))
    return render_srt(checked, on)


def utterances(cues: DataFrame, on: list[str], language: str = "en") -> DataFrame:
    """Cues as utterances utt_0001, ... in order."""
    n = F.row_number().over(Window.partitionBy(*on).orderBy("cue"))
    return cues.select(*on, F.format_string("utt_%04d", n).alias("utterance_id"), "start_ms", "end_ms", "text", F.lit(language).alias("language"), F.lit(None).cast("string").alias("speaker"))


def transitions(log: DataFrame, on: list[str] = (), line: str = "line", at: str = "n") -> DataFrame:
    """(time_s, score) of a scene filter's log: a line with pts_time, then one with the score; a time without score is an error when read."""
    parsed = log.select(*on, at, F.regexp_extract(line, r"pts_time:([0-9.]+)", 1).alias("t"), F.regexp_extract(line, r"scene_score=([0-9.]+)", 1).alias("s")).where("t <> '' or s <> ''")
    w = Window.partitionBy(*on).orderBy(at) if on else Window.orderBy(at)
    pairs = parsed.withColumn("next", F.lead("s").over(w)).where("t <> ''")
    score = F.when(F.col("next") != "", F.col("next").cast("double")).otherwise(F.raise_error(F.concat(F.lit("no score for time "), F.col("t"))).cast("double"))
    return pairs.select(*on, F.col("t").cast("double").alias("time_s"), score.alias("score"))
