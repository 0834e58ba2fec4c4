"""Half-open intervals [start, end) on timelines: joins, clipping, measures, gaps.

Two overlap predicates are kept apart on purpose: shared() asks for a common stretch of positive length, touches() also
accepts an empty interval inside another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles
from .sampling import CELL_ROWS, ranked
from .scans import CHUNK, beside, running


def shared(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s, s2) < F.least(e, e2)


def touches(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    return (e > s2) & (s < e2)


#: Lengths of class k are up to 2 ** (GROWTH * k) milliseconds, which is also the width of its bins; no length is beyond class CLASSES - 1.
GROWTH, CLASSES = 2, 32


def length_class(start: Column, end: Column) -> Column:
    """The least class whose bins are as wide as the interval is long: it is in two of them at most. An empty interval is of class 0."""
    return F.when(end - start > 1, F.ceil(F.length(F.bin((end - start - 1).cast("long"))) / GROWTH)).otherwise(0).cast("int")


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), (k * GROWTH).cast("int"))


def binned(df: DataFrame, other: DataFrame, start: str, end: str, first: bool, other_start: str, other_end: str) -> DataFrame:
    """Adds __bin (side, class, number) to each copy of an interval: one in each bin of its own class that it is in, where shorter ones of the
    other side come to meet it, and one in each of those of the wider classes that the other side has, where it meets longer ones.

    So a row has two copies for each of CLASSES classes at most, mostly few, as only classes that are there count: they are one row, an aggregate of the
    other side's lengths. first: intervals of one class meet in the bins of this side. A null bound is in no bin.
    """
    there = other.agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), length_class(F.col(other_start), F.col(other_end)))), F.lit(0).cast("long")).alias("__classes"))
    s, e, own = F.col(start), F.col(end), length_class(F.col(start), F.col(end))
    wider = F.filter(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: ((k > own) if first else (k >= own)) & (F.call_function("shiftright", F.col("__classes"), k).bitwiseAND(1) == 1))
    at = lambda side, k: F.transform(F.sequence(_shift(s, k), _shift(F.greatest(s, e - 1), k)), lambda n: F.struct(F.lit(side).alias("side"), k.alias("k"), n.alias("n")))
    bins = F.concat(at(first, own), F.flatten(F.transform(wider, lambda k: at(not first, k))))
    return df.join(F.broadcast(there)).withColumn("__bin", F.explode(F.when(s.isNotNull() & e.isNotNull(), bins))).drop("__classes")


def _meet(left: DataFrame, right: DataFrame, on: list[str], hit: Column) -> DataFrame:
    """Pairs of left and right rows (right's other columns as right_<name>) of one timeline for which hit holds, each once.

    Two intervals meet in the bins of the longer one's class, in the first that both are in. Bins are part of the join key, so one timeline
    with very many rows is joined in many tasks, and an interval is held only against those within a few of its own or their lengths.
    """
    r = right.select(*on, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in on])
    a = binned(left, r, "start_ms", "end_ms", True, "right_start_ms", "right_end_ms").alias("l")
    b = binned(r, left, "right_start_ms", "right_end_ms", False, "start_ms", "end_ms").alias("r")
    first = _shift(F.greatest("start_ms", "right_start_ms"), F.col("l.__bin.k")) == F.col("l.__bin.n")
    joined = a.join(b, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [F.col(f"l.__bin.{c}") == F.col(f"r.__bin.{c}") for c in ("side", "k", "n")] + [hit, first])
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in r.columns if c not in on])


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left and right rows of one timeline (columns on, start_ms, end_ms) that share a stretch, with its bounds.

    Joined through bins by classes of length (binned), whatever the lengths. Columns of right but the keys are returned as right_<name>. Left
    rows without a match come back by an anti-join on all of left's columns.
    """
    joined = _meet(left, right, on, shared(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms")))
    if how == "left":
        none = left.join(joined.select(*left.columns).distinct(), [left[c].eqNullSafe(joined[c]) for c in left.columns], "left_anti")
        joined = joined.unionByName(none, allowMissingColumns=True)
    bounds = {"overlap_start_ms": F.greatest("start_ms", "right_start_ms"), "overlap_end_ms": F.least("end_ms", "right_end_ms")}
    joined = joined.withColumns({k: F.when(F.col("right_start_ms").isNotNull(), v) for k, v in bounds.items()})
    return joined.withColumn("overlap_ms", F.col("overlap_end_ms") - F.col("overlap_start_ms"))


def touch_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of left and right rows (right's other columns as right_<name>) of one timeline that touch, each once; through bins by classes of length."""
    return _meet(left, right, on, touches(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms")))


def window_semi(units: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """Units that touch a window (start_ms, end_ms) of their timeline; an empty unit inside counts."""
    hit = touch_join(units, windows.select(*on, "start_ms", "end_ms"), on).select(*units.columns).distinct()
    return units.join(hit, [units[c].eqNullSafe(hit[c]) for c in units.columns], "left_semi")


def evidence_units(shots: DataFrame, utterances: DataFrame) -> DataFrame:
    """Shots with the utterances that they share time with, in order: refs, transcript, has_dialogue.

    shots: video_id, shot_id, start_ms, end_ms; utterances: video_id, utterance_id, start_ms, end_ms, text.
    """
    joined = overlap_join(shots, utterances, ["video_id"])
    ref = F.when(
        F.col("right_utterance_id").isNotNull(),
        F.struct(F.col("right_start_ms").alias("at"), F.col("right_utterance_id").alias("utterance_id"), "overlap_start_ms", "overlap_end_ms", "overlap_ms", F.col("right_text").alias("text")),
    )
    grouped = joined.groupBy(*shots.columns).agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    said = F.trim(F.regexp_replace(F.array_join(F.transform("refs", lambda r: r["text"]), " "), r"\s+", " "))
    return grouped.select(
        *shots.columns,
        F.transform("refs", lambda r: F.struct(r["utterance_id"].alias("utterance_id"), r["overlap_start_ms"].alias("overlap_start_ms"), r["overlap_end_ms"].alias("overlap_end_ms"), r["overlap_ms"].alias("overlap_ms"))).alias("utterance_refs"),
        said.alias("transcript"), (F.size("refs") > 0).alias("has_dialogue"),
    )


def alignment_summary(units: DataFrame, utterances: DataFrame) -> DataFrame:
    """Counts per video: shots, links, shots with dialogue, links per shot (max, median), utterances over several shots, unlinked."""
    per_shot = units.groupBy("video_id").agg(
        F.count("*").alias("shots"), F.sum(F.size("utterance_refs")).cast("long").alias("links"), F.sum(F.col("has_dialogue").cast("long")).alias("with_dialogue"),
        F.max(F.size("utterance_refs")).cast("long").alias("most"),
    )
    per_shot = per_shot.join(quantiles(units.select("video_id", F.size("utterance_refs").alias("k")), ["video_id"], "k", 0.5, "median"), "video_id")
    links = units.select("video_id", F.explode("utterance_refs.utterance_id").alias("utterance_id")).groupBy("video_id", "utterance_id").agg(F.count("*").alias("n"))
    per_utterance = utterances.join(links, ["video_id", "utterance_id"], "left").groupBy("video_id").agg(
        F.count("*").alias("utterances"), F.sum((F.col("n") > 1).cast("long")).alias("crossing"), F.sum(F.col("n").isNull().cast("long")).alias("unlinked")
    )
    return per_shot.join(per_utterance, "video_id", "left").na.fill(0, ["utterances", "crossing", "unlinked"])


def clip(df: DataFrame, start: int, end: int) -> DataFrame:
    """Intervals that touch [start, end), cut to it and counted from start."""
    if not 0 <= start < end:
        raise ValueError(f"not a clip: [{start}, {end})")
    inside = df.where(touches(F.col("start_ms"), F.col("end_ms"), F.lit(start), F.lit(end)))
    return inside.withColumns({"start_ms": F.greatest("start_ms", F.lit(start)) - start, "end_ms": F.least("end_ms", F.lit(end)) - start})


def sweep_iou(predicted: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Intersection over union of two sets of intervals per key, overlaps within a set counted once; 0 if the union is empty.

    One sort of the end points per key: how many intervals of either set are open is a running sum.
    """
    def edges(df, k):
        whole = df.where("start_ms < end_ms")
        return whole.select(*on, F.col("start_ms").alias("t"), *[F.lit(int(i == k)).alias(f"d{i}") for i in (0, 1)]).unionByName(
            whole.select(*on, F.col("end_ms").alias("t"), *[F.lit(-int(i == k)).alias(f"d{i}") for i in (0, 1)])
        )

    points = edges(predicted, 0).unionByName(edges(target, 1)).groupBy(*on, "t").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    w = Window.partitionBy(*on).orderBy("t")
    runs = points.select(*on, (F.lead("t").over(w) - F.col("t")).alias("len"), (F.sum("d0").over(w) > 0).alias("p"), (F.sum("d1").over(w) > 0).alias("q"))
    summed = runs.groupBy(*on).agg(F.coalesce(F.sum(F.when(F.col("p") & F.col("q"), F.col("len"))), F.lit(0)).alias("inter"), F.coalesce(F.sum(F.when(F.col("p") | F.col("q"), F.col("len"))), F.lit(0)).alias("both"))
    keys = predicted.select(*on).unionByName(target.select(*on)).distinct()
    return keys.join(summed, on, "left").select(*on, F.coalesce(F.when(F.col("both") > 0, F.col("inter") / F.col("both")), F.lit(0.0)).alias("iou"))


def hull_iou(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Of two single intervals: what they share over what both span."""
    hull = F.greatest(e, e2) - F.least(s, s2)
    return F.when(hull > 0, F.greatest(F.lit(0), F.least(e, e2) - F.greatest(s, s2)) / hull).otherwise(0.0)


def sessionize(df: DataFrame, on: list[str], gap_ms: int, order: list[str], cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Adds session: a row begins a new one if it starts more than gap_ms after the end of the row before. A key's rows are ranked and scanned in chunks."""
    placed = ranked(df, order, on, cell_rows)
    new = lambda w: {"__new": F.coalesce((F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms).cast("long"), F.lit(0))}
    return running(beside(placed, on, "__rank", 1, 0, new, chunk), on, "__rank", {"session": F.col("__new")}, chunk).drop("__new", "__rank")


def best_session(df: DataFrame, on: list[str], score: str = "score") -> DataFrame:
    """The session of greatest total score per key, the earlier on ties; its bounds, rows and score."""
    each = df.groupBy(*on, "session").agg(F.sum(score).alias("score"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    return each.withColumn("__r", F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("score"), "session"))).where("__r = 1").drop("__r")


def contiguous(df: DataFrame, on: list[str], duration: str = "duration_ms") -> DataFrame:
    """Per timeline: whether its intervals cover [0, duration) without gaps or overlaps."""
    w = Window.partitionBy(*on).orderBy("start_ms", "end_ms")
    step = df.select(*on, duration, "end_ms", (F.col("start_ms") == F.coalesce(F.lag("end_ms").over(w), F.lit(0))).alias("ok"))
    return step.groupBy(*on).agg(F.count("*").alias("n"), (F.bool_and("ok") & (F.max("end_ms") == F.max(duration))).alias("contiguous"))


def contiguous_positions(positions: Column, loose: bool) -> Column:
    """Whether positions follow one another; loose: repeats and an empty list are fine, else they are not."""
    s = F.array_sort(positions)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.lit(1), F.size(s)) - 1), F.slice(s, 2, F.greatest(F.lit(1), F.size(s))), lambda a, b: b - a)
    steps = F.forall(F.filter(pairs, lambda d: d.isNotNull()), lambda d: (d <= 1) if loose else (d == 1))
    return steps if loose else steps & (F.size(s) > 0)


def busiest_chunk(events: DataFrame, on: list[str], chunk_ms: int) -> DataFrame:
    """(on, start_ms, hits): of the chunks of a fixed length in which an event of a key begins that which most events touch, the earliest on ties.

    An event is dealt to the chunks that it touches, so no pair of a chunk and an event of another time is ever made.
    """
    s, e = F.col("start_ms"), F.col("end_ms")
    last = F.ceil(e / chunk_ms) - 1
    inside = F.when((F.floor(s / chunk_ms) <= last) & ~((s == e) & (s % chunk_ms == 0)), F.sequence(F.floor(s / chunk_ms), last))
    touched = events.select(*on, F.explode(inside).alias("__c"))
    counted = touched.groupBy(*on, "__c").agg(F.count("*").alias("hits"))
    begun = events.select(*on, F.floor(s / chunk_ms).alias("__c")).distinct()
    best = counted.join(begun, [*on, "__c"], "left_semi").groupBy(*on).agg(F.max(F.struct("hits", (-F.col("__c")).alias("early"))).alias("b"))
    return best.select(*on, (-F.col("b.early") * chunk_ms).cast("long").alias("start_ms"), F.col("b.hits").alias("hits"))
