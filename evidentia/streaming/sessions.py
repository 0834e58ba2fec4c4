"""Streams: windows with late data, and sessions measured from the end of the event before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Events and their value per type in tumbling or sliding windows of ts; events later than late are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def gap_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions by gaps between the times of events, by the built-in session window."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


#: A user's open session and the rows that later ones may still come before.
OPEN = "start long, finish long, last long, n long, starts array<long>, ends array<long>"


def end_gap_sessions(events: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """Closed sessions of intervals (user_id, start_ms, end_ms): a new one begins more than gap_ms after the end of the one before, in order of start.

    Rows may come in any order, late by no more than late: a row waits in its user's state until the watermark (of starts, over all users) has passed it, so
    sessions are those of the whole table in order; rows that come later still are dropped. A session is returned, and forgotten, when the watermark
    has passed gap_ms after its last end, as nothing can continue it then; a timer sees to it if the user has no more rows.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, finish, last, n, starts, ends = state.get if state.exists else (None, None, None, 0, [], [])
        waiting = list(zip(starts, ends, strict=True))
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(b.start_ms.tolist(), b.end_ms.tolist(), strict=True)
        passed, out = state.getCurrentWatermarkMs(), []
        waiting.sort()
        while waiting and waiting[0][0] < passed:
            s, e = waiting.pop(0)
            if n and s - last > gap_ms:
                out.append((key[0], start, finish, n))
                n = 0
            start, finish, last, n = (min(start, s), max(finish, e), e, n + 1) if n else (s, e, e, 1)
        if n and last + gap_ms < passed and not (waiting and waiting[0][0] - last <= gap_ms):
            out.append((key[0], start, finish, n))
            n = 0
        if n or waiting:
            state.update((start, finish, last, n, [s for s, _ in waiting], [e for _, e in waiting]) if n else (None, None, None, 0, [s for s, _ in waiting], [e for _, e in waiting]))
            due = [s for s, _ in waiting[:1]] + ([last + gap_ms + 1] if n else [])
            state.setTimeoutTimestamp(max(min(due), passed) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "start_ms", "end_ms", "n"])

    timed = events.withColumn("__ts", F.timestamp_millis("start_ms")).withWatermark("__ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, start_ms long, end_ms long, n long", OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def streamed_overlaps(left: DataFrame, right: DataFrame, on: list[str], longest_ms: int, late: str, how: str = "left") -> DataFrame:
    """intervals.overlap_join() of two streams (columns on, start_ms, end_ms): rows may come in any order, on either side late by no more than late.

    No interval is longer than longest_ms (a longer one is an error), so two that share a stretch begin within that of one another. With both watermarks this bounds
    what either side must keep, and says when a left row has no match and is returned alone (how: left).
    """
    def timed(df: DataFrame, prefix: str) -> DataFrame:
        whole = F.when(F.col("end_ms") - F.col("start_ms") > longest_ms, F.raise_error(F.lit(f"an interval is longer than {longest_ms} ms"))).otherwise(F.col("start_ms"))
        named = df.withColumn("start_ms", whole.cast("long"))
        named = named.select(*[F.col(c).alias(f"{prefix}{c}" if prefix and c not in on else f"__{c}" if prefix else c) for c in df.columns])
        return named.withColumn(f"{prefix}__ts", F.timestamp_millis(f"{prefix}start_ms")).withWatermark(f"{prefix}__ts", late)

    a, b = timed(left, ""), timed(right, "right_")
    bound = F.expr(f"interval {longest_ms} milliseconds")
    near = (F.col("right___ts") >= F.col("__ts") - bound) & (F.col("right___ts") <= F.col("__ts") + bound)
    hit = F.greatest("start_ms", "right_start_ms") < F.least("end_ms", "right_end_ms")
    same = [F.col(c) == F.col(f"__{c}") for c in on]
    joined = a.join(b, [*same, near, hit], how).drop("__ts", "right___ts", *[f"__{c}" for c in on])
    bounds = {"overlap_start_ms": F.greatest("start_ms", "right_start_ms"), "overlap_end_ms": F.least("end_ms", "right_end_ms")}
    joined = joined.withColumns({k: F.when(F.col("right_start_ms").isNotNull(), v) for k, v in bounds.items()})
    return joined.withColumn("overlap_ms", F.col("overlap_end_ms") - F.col("overlap_start_ms"))
