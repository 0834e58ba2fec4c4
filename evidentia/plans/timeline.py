"""Timeline operators on the events, embeddings and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import timecode as tc
from ..operators import intervals as iv
from ..operators import metrics as mx
from ..operators import sampling as sp
from ..operators import shots as sh
from ..sources import subtitles as sb
from .tables import table

QUERIES, ORACLE = {}, {}


def plan(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# Clips of a label are its vectors in order of id; the score is read from the first dimension.
SERIES = "s0 AS (SELECT label::BIGINT AS series, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS clip, (embedding[1]::DOUBLE + 1) / 2 AS score FROM embeddings)"
# An event lasts as many seconds as its value says.
SPANS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(value * 1000)::BIGINT AS end_ms FROM events)"
DAYS = "days AS (SELECT DISTINCT user_id, floor(start_ms / 86400000)::BIGINT * 86400000 AS start_ms, (floor(start_ms / 86400000)::BIGINT + 1) * 86400000 AS end_ms FROM ev)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("series"), "vec_id", ((F.col("embedding")[0].cast("double") + 1) / 2).alias("score"))
    return sp.ranked(e, ["vec_id"], ["series"]).select("series", F.col("__rank").alias("clip"), "score")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = tc.stamp_ms(F.col("ts"))
    return e.select("event_id", "user_id", "event_type", "value", start.alias("start_ms"), (start + F.floor(F.col("value") * 1000)).cast("long").alias("end_ms"))


def days(ev: DataFrame) -> DataFrame:
    day = F.floor(F.col("start_ms") / 86_400_000).cast("long")
    return ev.select("user_id", (day * 86_400_000).alias("start_ms"), ((day + 1) * 86_400_000).alias("end_ms")).distinct()


SMOOTH = SERIES + """, sm AS (SELECT *, sum(score) OVER (PARTITION BY series ORDER BY clip ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS sm, count(*) OVER (PARTITION BY series) AS n FROM s0),
lim AS (SELECT series, greatest(quantile_cont(sm, 0.72), 0.52 * max(sm)) AS lim FROM sm GROUP BY series)"""


@plan(f"""WITH {SMOOTH},
act AS (SELECT s.*, clip - row_number() OVER (PARTITION BY s.series ORDER BY clip) AS run FROM sm s JOIN lim USING (series) WHERE sm >= lim),
runs AS (SELECT series, greatest(0, min(clip) - 2) AS l, least(any_value(n), max(clip) + 3) AS r FROM act GROUP BY series, run),
mk AS (SELECT *, CASE WHEN l > coalesce(max(r) OVER (PARTITION BY series ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM runs),
isl AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY l, r) AS island FROM mk),
mg AS (SELECT series, min(l) AS l, max(r) AS r FROM isl GROUP BY series, island),
sc AS (SELECT m.series, l, r, 0.55 * avg(sm) + 0.45 * max(sm) AS sc, arg_max(clip, {{'a': sm, 'b': -clip}}) AS anchor FROM mg m JOIN sm s ON s.series = m.series AND clip >= l AND clip < r GROUP BY m.series, l, r),
rk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(sc, 12) DESC, l) AS rank FROM sc)
SELECT series, rank::BIGINT AS rank, (l * 2000)::BIGINT AS start_ms, (r * 2000)::BIGINT AS end_ms, round(sc, 6) AS score, anchor::BIGINT AS anchor FROM rk WHERE rank <= 3""")
def temporal_proposals(spark, sf_dir):
    return sh.proposals(series(spark, sf_dir))


@plan(f"""WITH {SERIES}, b AS (SELECT series, arg_max(clip, {{'a': score, 'b': -clip}}) AS peak, count(*) AS n FROM s0 GROUP BY series)
SELECT series, (peak * 2000)::BIGINT AS peak_start_ms, ((peak + 1) * 2000)::BIGINT AS peak_end_ms, (greatest(0, peak - 2) * 2000)::BIGINT AS fixed_start_ms, (least(n, peak + 3) * 2000)::BIGINT AS fixed_end_ms FROM b""")
def baseline_predictors(spark, sf_dir):
    return sh.baselines(series(spark, sf_dir))


DAILY = "d0 AS (SELECT l_returnflag AS flag, l_shipdate AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@plan(f"""WITH {DAILY}, sm AS (SELECT *, sum(q) OVER (PARTITION BY flag ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS sm FROM d0),
t AS (SELECT flag, greatest(quantile_cont(sm, 0.72), 0.52 * max(sm)) AS lim FROM sm GROUP BY flag)
SELECT flag, count(*) AS days, sum((sm >= lim)::BIGINT)::BIGINT AS active, round(any_value(lim), 4) AS lim FROM sm JOIN t USING (flag) GROUP BY flag""")
def moving_threshold(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    sm = sh.smoothed(sp.ranked(d, ["day"], ["flag"]), "flag", "__rank", "q")
    lim = sm.join(sh.limits(sm, "flag"), "flag")
    return lim.groupBy("flag").agg(F.count("*").alias("days"), F.sum((F.col("sm") >= F.col("limit")).cast("long")).alias("active"), F.round(F.max("limit"), 4).alias("lim"))


@plan(f"""WITH {SPANS}, b AS (SELECT user_id AS video_id, event_id AS seq, round((start_ms - 1704067200000) / 1000.0, 6)::DOUBLE AS t, value AS score FROM ev WHERE event_type = 'error'),
dur AS (SELECT DISTINCT user_id AS video_id, 2600000.0::DOUBLE AS dur FROM ev),
cuts AS (SELECT video_id, t, arg_max(score, seq) AS score, false AS first FROM b JOIN dur USING (video_id) WHERE t > 0 AND t < dur GROUP BY video_id, t UNION ALL SELECT video_id, 0.0, NULL, true FROM dur),
o AS (SELECT c.*, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), dur) AS e, row_number() OVER (PARTITION BY video_id ORDER BY t) AS n FROM cuts c JOIN dur USING (video_id))
SELECT video_id, 'shot_' || lpad(n::VARCHAR, 4, '0') AS shot_id, t AS start_s, e AS end_s, round(e - t, 6) AS duration_s, round((t + e) / 2, 6) AS keyframe_s, score AS start_scene_score FROM o""")
def shots_from_boundaries(spark, sf_dir):
    return _shots(spark, sf_dir)


def _shots(spark, sf_dir):
    ev = spans(spark, sf_dir)
    cuts = ev.where("event_type = 'error'").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), ((F.col("start_ms") - 1704067200000) / 1000).alias("time_s"), F.col("value").alias("score"))
    return sh.build_shots(cuts, ev.select(F.col("user_id").alias("video_id"), F.lit(2600000.0).alias("duration_s")).distinct())


@plan(f"""WITH {SPANS}, b AS (SELECT DISTINCT user_id, start_ms - 1704067200000 AS t FROM ev WHERE event_type = 'error'), dur AS (SELECT DISTINCT user_id FROM ev),
c AS (SELECT user_id, t FROM b WHERE t > 0 AND t < 2600000000 UNION SELECT user_id, 0 FROM dur)
SELECT user_id AS video_id, count(*) AS n, user_id % 4 <> 1 AND NOT (user_id % 4 = 2 AND count(*) > 2) AND user_id % 4 <> 3 AS contiguous FROM c GROUP BY user_id""")
def timeline_contiguity(spark, sf_dir):
    """Of every four timelines one is whole; one begins late, one has a gap after its second shot, one ends early."""
    s, kind = _shots(spark, sf_dir), F.col("video_id") % 4
    third, last = F.col("shot_id") == "shot_0003", F.col("end_s") == 2600000.0
    s = s.withColumns({"start_s": F.col("start_s") + F.when((kind == 1) & (F.col("start_s") == 0), 0.004).when((kind == 2) & third, 0.002).otherwise(0.0), "end_s": F.col("end_s") - F.when((kind == 3) & last, 0.003).otherwise(0.0)})
    ms = s.select("video_id", tc.seconds_to_ms(F.col("start_s")).alias("start_ms"), tc.seconds_to_ms(F.col("end_s")).alias("end_ms"), F.lit(2_600_000_000).alias("duration_ms"))
    return iv.contiguous(ms, ["video_id"])


@plan(f"""WITH {SPANS}, {DAYS} SELECT d.user_id, d.start_ms, d.end_ms, e.event_id AS right_event_id, CASE WHEN e.event_id IS NOT NULL THEN greatest(d.start_ms, e.start_ms) END AS overlap_start_ms, CASE WHEN e.event_id IS NOT NULL THEN least(d.end_ms, e.end_ms) END AS overlap_end_ms, CASE WHEN e.event_id IS NOT NULL THEN least(d.end_ms, e.end_ms) - greatest(d.start_ms, e.start_ms) END AS overlap_ms
FROM days d LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') e ON d.user_id = e.user_id AND greatest(d.start_ms, e.start_ms) < least(d.end_ms, e.end_ms)""")
def interval_overlap_left(spark, sf_dir):
    ev = spans(spark, sf_dir)
    bought = ev.where("event_type = 'purchase'").select("user_id", "event_id", "start_ms", "end_ms")
    return iv.overlap_join(days(ev), bought, ["user_id"]).select("user_id", "start_ms", "end_ms", "right_event_id", "overlap_start_ms", "overlap_end_ms", "overlap_ms")


@plan(f"""WITH {SPANS}, wide AS (SELECT event_id, user_id, event_type, start_ms - 1800000 AS start_ms, end_ms + 1800000 AS end_ms FROM ev)
SELECT a.event_id, b.event_id AS right_event_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms
FROM (SELECT * FROM wide WHERE event_type = 'view') a JOIN (SELECT * FROM wide WHERE event_type = 'click') b ON a.user_id = b.user_id AND greatest(a.start_ms, b.start_ms) < least(a.end_ms, b.end_ms)""")
def interval_overlap_bucketed(spark, sf_dir):
    ev = spans(spark, sf_dir).select("user_id", "event_id", "event_type", (F.col("start_ms") - 1_800_000).alias("start_ms"), (F.col("end_ms") + 1_800_000).alias("end_ms"))
    joined = iv.overlap_join(ev.where("event_type = 'view'"), ev.where("event_type = 'click'"), ["user_id"], how="inner")
    return joined.select("event_id", "right_event_id", "overlap_ms")


WINDOWS = "win AS (SELECT user_id, start_ms - 600000 AS a, end_ms + 600000 AS b FROM ev WHERE event_type = 'error')"


@plan(f"WITH {SPANS}, {WINDOWS} SELECT event_id, user_id, start_ms, end_ms FROM ev WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM win w WHERE w.user_id = ev.user_id AND ev.end_ms > w.a AND ev.start_ms < w.b)")
def window_semi(spark, sf_dir):
    ev = spans(spark, sf_dir)
    win = ev.where("event_type = 'error'").select("user_id", (F.col("start_ms") - 600_000).alias("start_ms"), (F.col("end_ms") + 600_000).alias("end_ms"))
    return iv.window_semi(ev.where("event_type <> 'error'"), win, ["user_id"]).select("event_id", "user_id", "start_ms", "end_ms")


@plan(f"WITH {SPANS}, {WINDOWS} SELECT event_id FROM ev WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM win w WHERE w.user_id = ev.user_id AND greatest(ev.start_ms, w.a) < least(ev.end_ms, w.b))")
def unlinked_anti(spark, sf_dir):
    ev = spans(spark, sf_dir)
    win = ev.where("event_type = 'error'").select("user_id", (F.col("start_ms") - 600_000).alias("start_ms"), (F.col("end_ms") + 600_000).alias("end_ms"))
    bought = ev.where("event_type = 'purchase'").select("user_id", "event_id", "start_ms", "end_ms")
    linked = iv.overlap_join(win, bought, ["user_id"], how="inner").select(F.col("right_event_id").alias("event_id"))
    return bought.select("event_id").join(linked, "event_id", "left_anti")


UTT = "utt AS (SELECT user_id, event_id, start_ms, end_ms FROM ev WHERE event_type = 'signup')"


@plan(f"""WITH {SPANS}, {DAYS}, {UTT}, links AS (SELECT d.user_id, d.start_ms, u.event_id FROM days d JOIN utt u ON d.user_id = u.user_id AND greatest(d.start_ms, u.start_ms) < least(d.end_ms, u.end_ms)),
per AS (SELECT d.user_id, d.start_ms, count(l.event_id) AS k FROM days d LEFT JOIN links l ON d.user_id = l.user_id AND d.start_ms = l.start_ms GROUP BY 1, 2),
a AS (SELECT user_id, count(*) AS shots, sum(k)::BIGINT AS links, sum((k > 0)::BIGINT)::BIGINT AS with_dialogue, max(k)::BIGINT AS most, quantile_cont(k::DOUBLE, 0.5) AS median FROM per GROUP BY 1),
n AS (SELECT user_id, event_id, count(*) AS n FROM links GROUP BY 1, 2),
b AS (SELECT u.user_id, count(*) AS utterances, coalesce(sum((n > 1)::BIGINT), 0)::BIGINT AS crossing, sum((n IS NULL)::BIGINT)::BIGINT AS unlinked FROM utt u LEFT JOIN n ON u.user_id = n.user_id AND u.event_id = n.event_id GROUP BY 1)
SELECT a.user_id::VARCHAR AS video_id, shots, links, with_dialogue, most, median, coalesce(utterances, 0) AS utterances, coalesce(crossing, 0) AS crossing, coalesce(unlinked, 0) AS unlinked FROM a LEFT JOIN b USING (user_id)""")
def alignment_summary(spark, sf_dir):
    units, utts = _units(spark, sf_dir)
    return iv.alignment_summary(units, utts).select("video_id", "shots", "links", "with_dialogue", "most", "median", "utterances", "crossing", "unlinked")


def _units(spark, sf_dir):
    ev = spans(spark, sf_dir)
    shots = days(ev).select(F.col("user_id").cast("string").alias("video_id"), F.col("start_ms").cast("string").alias("shot_id"), "start_ms", "end_ms")
    utts = ev.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").cast("string").alias("utterance_id"), "start_ms", "end_ms", F.lit("w").alias("text"))
    return iv.evidence_units(shots, utts), utts


@plan(f"""WITH {SPANS}, {DAYS} SELECT d.user_id::VARCHAR AS video_id, d.start_ms, coalesce(string_agg(e.event_id::VARCHAR || ':' || (least(d.end_ms, e.end_ms) - greatest(d.start_ms, e.start_ms))::VARCHAR, ',' ORDER BY e.start_ms, e.event_id::VARCHAR), '') AS refs, count(e.event_id) > 0 AS has_dialogue
FROM days d LEFT JOIN (SELECT * FROM ev WHERE event_type = 'signup') e ON d.user_id = e.user_id AND greatest(d.start_ms, e.start_ms) < least(d.end_ms, e.end_ms) GROUP BY 1, 2""")
def evidence_units(spark, sf_dir):
    refs = F.array_join(F.transform("utterance_refs", lambda r: F.concat(r["utterance_id"], F.lit(":"), r["overlap_ms"].cast("string"))), ",")
    return _units(spark, sf_dir)[0].select("video_id", "start_ms", refs.alias("refs"), "has_dialogue")


@plan(f"""WITH {SPANS} SELECT event_id, greatest(start_ms, 1704672000000) - 1704672000000 AS start_ms, least(end_ms, 1705276800000) - 1704672000000 AS end_ms FROM ev WHERE end_ms > 1704672000000 AND start_ms < 1705276800000""")
def clip_intervals(spark, sf_dir):
    return iv.clip(spans(spark, sf_dir).select("event_id", "start_ms", "end_ms"), 1704672000000, 1705276800000)


SIDES = "p AS (SELECT user_id, start_ms - 1800000 AS s, end_ms + 1800000 AS e FROM ev WHERE event_type = 'click'), q AS (SELECT user_id, start_ms - 1800000 AS s, end_ms + 1800000 AS e FROM ev WHERE event_type = 'view')"


@plan(f"""WITH {SPANS}, {SIDES}, pts AS (SELECT user_id, s AS t FROM p UNION SELECT user_id, e FROM p UNION SELECT user_id, s FROM q UNION SELECT user_id, e FROM q),
seg AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM pts),
f AS (SELECT user_id, b - a AS len, EXISTS (SELECT 1 FROM p WHERE p.user_id = seg.user_id AND p.s < seg.b AND p.e > seg.a) AS x, EXISTS (SELECT 1 FROM q WHERE q.user_id = seg.user_id AND q.s < seg.b AND q.e > seg.a) AS y FROM seg WHERE b IS NOT NULL)
SELECT user_id, round(coalesce(sum(CASE WHEN x AND y THEN len END), 0)::DOUBLE / sum(CASE WHEN x OR y THEN len END), 9) AS iou FROM f GROUP BY user_id""")
def interval_iou(spark, sf_dir):
    ev = spans(spark, sf_dir).withColumns({"start_ms": F.col("start_ms") - 1_800_000, "end_ms": F.col("end_ms") + 1_800_000})
    return iv.sweep_iou(ev.where("event_type = 'click'"), ev.where("event_type = 'view'"), ["user_id"]).select("user_id", F.round("iou", 9).alias("iou"))


PAIRS = "pr AS (SELECT event_id, start_ms AS s, end_ms AS e, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS s2, lead(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS e2 FROM ev)"


@plan(f"WITH {SPANS}, {PAIRS} SELECT event_id, round(CASE WHEN greatest(e, e2) > least(s, s2) THEN greatest(0, least(e, e2) - greatest(s, s2))::DOUBLE / (greatest(e, e2) - least(s, s2)) ELSE 0 END, 9) AS iou FROM pr WHERE s2 IS NOT NULL")
def hull_iou(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("start_ms", "event_id")
    p = spans(spark, sf_dir).withColumns({"s2": F.lead("start_ms").over(w), "e2": F.lead("end_ms").over(w)}).where("s2 is not null")
    return p.select("event_id", F.round(iv.hull_iou(F.col("start_ms"), F.col("end_ms"), F.col("s2"), F.col("e2")), 9).alias("iou"))


SESSIONS = "ss AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_ms, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) > 21600000 THEN 1 ELSE 0 END AS new FROM ev))"


@plan(f"WITH {SPANS}, {SESSIONS} SELECT user_id, session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM ss GROUP BY 1, 2")
def user_sessions(spark, sf_dir):
    s = iv.sessionize(spans(spark, sf_dir), ["user_id"], 21_600_000, ["start_ms", "event_id"])
    return s.groupBy("user_id", "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


@plan(f"""WITH {SPANS}, {SESSIONS}, g AS (SELECT user_id, session, sum(CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END)::BIGINT AS score, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM ss GROUP BY 1, 2)
SELECT user_id, session, score, start_ms, end_ms, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, session) AS r FROM g) WHERE r = 1""")
def best_session(spark, sf_dir):
    ev = spans(spark, sf_dir).withColumn("score", F.when(F.col("event_type") == "purchase", 3).otherwise(1).cast("long"))
    return iv.best_session(iv.sessionize(ev, ["user_id"], 21_600_000, ["start_ms", "event_id"]), ["user_id"])


@plan(f"""WITH {SPANS}, c AS (SELECT DISTINCT user_id, floor(start_ms / 1800000)::BIGINT * 1800000 AS a FROM ev),
s AS (SELECT c.user_id, c.a, count(*) AS hits FROM c JOIN ev ON ev.user_id = c.user_id AND ev.end_ms > c.a AND ev.start_ms < c.a + 1800000 GROUP BY 1, 2)
SELECT user_id, a AS start_ms, hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, a) AS r FROM s) WHERE r = 1""")
def best_fixed_chunk(spark, sf_dir):
    return iv.busiest_chunk(spans(spark, sf_dir), ["user_id"], 1_800_000)


@plan(f"WITH {SPANS} SELECT event_type, min(value) AS least, quantile_cont(value, 0.5) AS median, round(avg(value), 6) AS mean, max(value) AS most FROM ev GROUP BY 1")
def duration_stats(spark, sf_dir):
    s = mx.duration_stats(spans(spark, sf_dir), ["event_type"], "value")
    return s.select("event_type", "least", "median", F.round("mean", 6).alias("mean"), "most")


@plan("SELECT event_id, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS code, ms AS back FROM (SELECT event_id, epoch_us(ts) // 1000 % 86400000 AS ms FROM events)")
def timecodes(spark, sf_dir):
    e = spans(spark, sf_dir).select("event_id", tc.from_ms(F.col("start_ms") % 86_400_000).alias("code"))
    return e.select("event_id", "code", tc.to_ms(F.col("code")).alias("back"))


@plan("SELECT event_id, 'utt_' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::VARCHAR, 4, '0') AS utterance_id FROM events")
def utterance_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cues = e.select("user_id", F.struct("ts", "event_id").alias("cue"), F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"), F.col("event_id").alias("text"))
    return sb.utterances(cues, ["user_id"]).select(F.col("text").alias("event_id"), "utterance_id")
