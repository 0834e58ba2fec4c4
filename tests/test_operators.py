"""Operators on small hand-made inputs."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import scores as sx
from evidentia.functions import text as tx
from evidentia.functions import timecode as tc
from evidentia.operators import audits as au
from evidentia.operators import episodes as ep
from evidentia.operators import graph as gr
from evidentia.operators import intervals as iv
from evidentia.operators import metrics as mx
from evidentia.operators import prompts as pr
from evidentia.operators import quantiles as qt
from evidentia.operators import registry as rg
from evidentia.operators import retrieval as rt
from evidentia.operators import sampling as sp
from evidentia.operators import scans as sc
from evidentia.operators import shots as sh
from evidentia.operators import training as tr
from evidentia.sources import files as fs
from evidentia.sources import subtitles as sb


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_clip(spark):
    df = spark.createDataFrame([(19000, 21000), (23000, 24500), (499000, 501000), (510000, 511000)], "start_ms long, end_ms long")
    assert rows(iv.clip(df, 20000, 500000), "start_ms") == [(0, 1000), (3000, 4500), (479000, 480000)]
    with pytest.raises(ValueError):
        iv.clip(df, 5, 5)


def test_srt_round_trip_and_errors(spark):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nworld\r\n\r\n00:00:03,000 --> 00:00:04,000\r\nNo number\r\n\r\nlonely\r\n"
    cues = sb.parse_srt(spark.createDataFrame([("v", text)], "video_id string, text string"))
    assert rows(cues.select("cue", "start_ms", "end_ms", "text"), "cue") == [(0, 1000, 2500, "Hello\nworld"), (1, 3000, 4000, "No number")]
    again = sb.parse_srt(sb.render_srt(cues, ["video_id"]))
    assert rows(again, "cue") == rows(cues, "cue")
    assert rows(sb.clip_srt(cues, ["video_id"], 1.5, 10))[0][1].startswith("1\n00:00:00,000 --> 00:00:01,000\nHello")
    with pytest.raises(Exception, match="invalid times"):
        sb.parse_srt(spark.createDataFrame([("1\n0:01 --> 0:02\nx",)], "text string")).collect()
    assert rows(sb.utterances(cues, ["video_id"]).select("utterance_id"), "utterance_id") == [("utt_0001",), ("utt_0002",)]


def test_transitions_of_a_log(spark):
    log = [(0, "frame:1 pts_time:5.25"), (1, "lavfi.scene_score=0.61"), (2, "noise"), (3, "frame:2 pts_time:9"), (4, "lavfi.scene_score=0.40")]
    df = spark.createDataFrame(log, "n int, line string")
    assert rows(sb.transitions(df), "time_s") == [(5.25, 0.61), (9.0, 0.4)]
    with pytest.raises(Exception, match="no score"):
        sb.transitions(df.where("n < 4")).collect()


def shots(spark, cuts, duration):
    b = spark.createDataFrame([("v", i, float(t), s) for i, (t, s) in enumerate(cuts)], "video_id string, seq int, time_s double, score double")
    return sh.build_shots(b, spark.createDataFrame([("v", float(duration))], "video_id string, duration_s double"))


def test_shots(spark):
    s = shots(spark, [(5, 0.6), (12, 0.4)], 20)
    assert rows(s.select("shot_id", "start_s", "end_s", "keyframe_s", "start_scene_score"), "shot_id") == [("shot_0001", 0, 5, 2.5, None), ("shot_0002", 5, 12, 8.5, 0.6), ("shot_0003", 12, 20, 16, 0.4)]
    s = shots(spark, [(-1, 0.5), (5, 0.4), (5, 0.7), (20, 0.9)], 20)
    assert rows(s.select("start_s", "start_scene_score"), "start_s") == [(0, None), (5, 0.7)]
    with pytest.raises(Exception, match="positive"):
        shots(spark, [(1, 0.5)], 0).collect()


def test_overlap_and_crossing(spark):
    s = spark.createDataFrame([("v", "a", 0, 5000), ("v", "b", 5000, 10000), ("v", "c", 10000, 12000)], "video_id string, shot_id string, start_ms long, end_ms long")
    u = spark.createDataFrame([("v", "u1", 4000, 6000, "x  <i>y"), ("v", "u2", 11000, 11000, "empty")], "video_id string, utterance_id string, start_ms long, end_ms long, text string")
    units = iv.evidence_units(s, u)
    got = {r.shot_id: r for r in units.collect()}
    assert [x.overlap_ms for x in got["a"].utterance_refs] == [1000] == [x.overlap_ms for x in got["b"].utterance_refs]
    assert got["c"].utterance_refs == [] and not got["c"].has_dialogue and got["a"].transcript == "x <i>y"
    assert rows(iv.alignment_summary(units, u)) == [("v", 3, 2, 2, 1, 1.0, 2, 1, 1)]
    # An empty interval is touched, but shares nothing.
    assert rows(iv.window_semi(s, spark.createDataFrame([("v", 11000, 11000)], "video_id string, start_ms long, end_ms long"), ["video_id"]).select("shot_id")) == [("c",)]
    assert rows(iv.overlap_join(s, u, ["video_id"]).select("shot_id", "right_utterance_id", "overlap_ms"), "shot_id") == [("a", "u1", 1000), ("b", "u1", 1000), ("c", None, None)]


@pytest.mark.parametrize("p, q, want", [([(0, 10)], [(5, 15)], 1 / 3), ([(0, 10), (5, 12)], [(20, 30)], 0.0), ([(0, 4), (2, 8), (10, 12)], [(1, 11)], 8 / 12), ([(3, 3)], [(3, 3)], 0.0)])
def test_iou(spark, p, q, want):
    side = lambda x: spark.createDataFrame([("k", *i) for i in x], "k string, start_ms long, end_ms long")
    assert rows(iv.sweep_iou(side(p), side(q), ["k"])) == [("k", pytest.approx(want))]


def test_contiguity(spark):
    df = spark.createDataFrame([("a", 0, 5, 9), ("a", 5, 9, 9), ("b", 0, 5, 9), ("b", 6, 9, 9), ("c", 0, 8, 9)], "v string, start_ms long, end_ms long, duration_ms long")
    assert [r[2] for r in rows(iv.contiguous(df, ["v"]), "v")] == [True, False, False]
    p = spark.createDataFrame([([3, 1, 2],), ([1, 3],), ([2, 2],), ([],)], "p array<int>")
    assert rows(p.select(iv.contiguous_positions(F.col("p"), True), iv.contiguous_positions(F.col("p"), False))) == [(True, True), (False, False), (True, False), (True, False)]


def decode(values):
    """Reference values in plain numpy, for five clips or more."""
    sm = np.convolve(values, np.ones(5) / 5, "same")
    on = np.flatnonzero(sm >= max(np.quantile(sm, 0.72), 0.52 * sm.max()))
    spans = []
    for part in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
        l, r = max(0, part[0] - 2), min(len(values), part[-1] + 3)
        if spans and l <= spans[-1][1]:
            spans[-1][1] = max(r, spans[-1][1])
        else:
            spans.append([l, r])
    best = sorted(spans, key=lambda s: -(0.55 * sm[s[0] : s[1]].mean() + 0.45 * sm[s[0] : s[1]].max()))[:3]
    return [(l * 2000, r * 2000, l + int(sm[l:r].argmax())) for l, r in best]


def test_proposals(spark):
    rng = np.random.default_rng(3)
    series = {"fixed": np.array([0, 0.1, 0.8, 0.9, 0.85, 0.1, 0])} | {f"r{i}": rng.random(rng.integers(5, 40)) for i in range(25)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "series string, clip long, score double")
    got = {}
    for r in sh.proposals(df).orderBy("series", "rank").collect():
        got.setdefault(r.series, []).append((r.start_ms, r.end_ms, r.anchor))
    assert got == {k: decode(v) for k, v in series.items()}


def test_fusion_grows_and_routes(spark):
    one = lambda a, b: spark.range(1).select(sx.noisy_or(F.lit(a), F.lit(b), F.lit(0.0))).first()[0]
    assert one(0.5, 0.5) > one(0.5, 0.0) and one(1.0, 0.0) == pytest.approx(0.52)
    r = spark.createDataFrame([("Which tree?", True), ("He says hello.", True), ("x", False)], "q string, d boolean").select(tx.route(F.col("q"), F.col("d")).alias("r")).select("r.top_k", "r.inspect_budget")
    assert rows(r) == [(6, 3), (5, 2), (6, 3)]


def test_graph(spark):
    n = spark.createDataFrame([("t", i, i * 10) for i in range(6)], "task_id string, pos long, start_ms long")
    e = spark.createDataFrame([("t", 2, "text", 0.9), ("t", 2, "text", 0.4), ("t", 3, "image", 0.5), ("t", 4, "image", 0.0), ("t", 9, "text", 1.0)], "task_id string, pos long, modality string, score double")
    u = gr.fuse(gr.update(e, n))
    top = gr.ranked(u)
    assert [r.pos for r in top.orderBy("rank").collect()] == [2, 3]
    assert rows(gr.reciprocal_rank(top, spark.createDataFrame([("t", 3), ("t", 5)], "task_id string, pos long"))) == [("t", 0.5)]
    p = gr.propagate(u, spark.createDataFrame([("t", 2, 9)], "task_id string, pos long, radius int"))
    got = {r.pos: r for r in p.collect()}
    assert got[5].context_score == pytest.approx(0.468 * np.exp(-2.1)) and got[2].sources == ["context", "text"] and got[0].sources == ["context"]
    assert rows(gr.select_adjacent(top, 2, 0.3)) == [("t", [2, 3])] and rows(gr.select_adjacent(top, 2, 0.88)) == [("t", [2])]


def test_bm25(spark):
    d = spark.createDataFrame([(0, "red car red"), (1, "blue car"), (2, "green tree")], "doc_id int, text string")
    q = spark.createDataFrame([(0, "find the red red car"), (1, "nothing")], "query_id int, query string")
    got = {(a, b): s for a, b, s in rows(rt.bm25(q, d))}
    assert set(got) == {(0, 0), (0, 1)} and got[0, 0] == 1.0
    idf = lambda df: np.log(1 + (3 - df + 0.5) / (df + 0.5))
    w = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (7 / 3)))
    assert got[0, 1] == pytest.approx(idf(2) * w(1, 2) / (2 * idf(1) * w(2, 3) + idf(2) * w(1, 3)))


@pytest.mark.parametrize("limits", [{}, {"MOST_TERMS": 12, "MATRIX": 50}])
def test_bm25_of_the_foremost(spark, monkeypatch, limits):
    """Each task leaves some k documents a query, and the k best are those of all pairs, copies and ties included."""
    for name, value in limits.items():
        monkeypatch.setattr(rt, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(1500)]
    texts[100:900:2] = ["w1 w2 w2 w3"] * 400
    docs = spark.createDataFrame([*enumerate(texts), (1500, None), (1501, ""), (1502, "of the")], "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(8)] + [(8, "W1, w2 w2"), (9, "of the nothing"), (10, None)], "query_id long, query string")
    order = [F.desc(F.round("score", 9)), F.col("doc_id")]
    ranked = lambda s: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in rt.top(s, ["query_id"], order, 5).collect())
    every, few = rt.bm25(queries, docs).cache(), rt.bm25(queries, docs, k=5).cache()
    assert ranked(few) == ranked(every) and {r[0] for r in ranked(few)} == set(range(9))
    assert every.count() > 5000 and few.count() <= 4 * 9 * 8  # 4 tasks of 5 a query, and some that are near the fifth


def test_bm25_query_adds_up_rows_of_one_document(spark, tmp_path):
    import duckdb

    from evidentia.plans import search

    docs = [(i, f"w{i % 7} w{i % 5} w{i % 3} w{i % 2}") for i in range(60)]
    docs += [(3, "w3 w1 w0 w0"), (3, "w1 w1"), (4, None), (4, None), (5, "w2"), (90, None), (90, "w4"), (91, ""), (91, "")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "w1 w3"), (1, "w4 w4 w2"), (1, "w2 w0"), (2, "w6")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = search.bm25_topk(spark, str(tmp_path)).select("item_id", "doc_id", "rank", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(search.ORACLE["bm25_topk"]).fetchall()) and len(got) >= 25


def test_bm25_query_shuffles_no_pairs(spark, tmp_path):
    from evidentia.plans import search

    spark.createDataFrame([(0, "red car red"), (1, "blue car")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "red car")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = search.bm25_topk(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "doc_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.cleaned(F.lit(" <b>Tom &amp; Jerry</b> ♪ &lt;x&gt; \n"))) == "Tom & Jerry"
    assert one(tx.meaningful(F.lit("one two three four"))) and not one(tx.meaningful(F.lit("(one two three four)")))
    assert one(tx.contains_all(F.lit("A Red Car"), F.lit("car red"))) and not one(tx.contains_all(F.lit("x"), F.lit(" ")))
    assert json.loads(one(tx.tool_call(F.lit('ok {"tool": "a", "arguments": {"b": 1}} end'))))["tool"] == "a"
    assert one(tx.tool_call(F.lit('{"tool": "a", "arguments": 3}'))) is None and one(tx.tool_call(F.lit("none"))) is None
    assert one(tx.leaks_labels(F.lit('{"target_segments": []}'))) and not one(tx.leaks_labels(F.lit('{"query": 1}')))
    assert one(tc.to_ms(F.lit("01:02:03,004"))) == 3723004 and one(tc.to_ms(F.lit("1:02:03,004"))) is None and one(tc.from_ms(F.lit(3723004))) == "01:02:03,004"
    assert one(tc.seconds_to_ms(F.lit(13.8125))) == 13812


REFS = "array<struct<utterance_id string, overlap_start_ms long, overlap_end_ms long, overlap_ms long>>"


def media(spark, **videos):
    """Names of the failed checks of each video, each with one change to sound records."""
    s, u, n, k, v = [], [], [], [], []
    for name, change in videos.items():
        shots_ = change.get("shots", [(0, "s1", 0.0, 5.0, "k1"), (1, "s2", 5.0, 10.0, "k2")])
        s += [(name, *x) for x in shots_]
        u += [(name, *x) for x in change.get("utts", [("u1", 1000, 2000)])]
        refs = [("u1", 1000, 2000, change.get("overlap", 1000))] if change.get("refs", True) else []
        n += [(name, p, i, int(a * 1000), int(b * 1000), f, refs if p == 0 else []) for p, i, a, b, f in change.get("units", shots_)]
        k += [(name, f) for f in change.get("frames", [x[4] for x in shots_])]
        v.append((name, 10000))
    frame = lambda rows_, kind: spark.createDataFrame(rows_, f"video_id string, {kind}")
    out = au.media_checks(
        frame(s, "pos long, shot_id string, start_s double, end_s double, keyframe_path string"), frame(u, "utterance_id string, start_ms long, end_ms long"),
        frame(n, f"pos long, shot_id string, start_ms long, end_ms long, keyframe_path string, utterance_refs {REFS}"), frame(k, "path string"), frame(v, "duration_ms long"),
    ).collect()
    assert len(out) == 7 * len(videos)
    return {name: {r.name for r in out if r.video_id == name and not r.passed} for name in videos}, {(r.video_id, r.name): r.details for r in out}


def test_media_audit(spark):
    sound = [(0, "s1", 0.0, 5.0, "k1"), (1, "s2", 5.0, 10.0, "k2")]
    got, details = media(
        spark, sound={}, gap={"shots": [sound[0], (1, "s2", 5.5, 10.0, "k2")], "units": sound}, off={"overlap": 999}, unlinked={"refs": False}, twice={"utts": [("u1", 1000, 2000)] * 2}, late={"utts": [("u1", 1000, 10001)]},
        frameless={"frames": ["k1"]}, spare={"frames": ["k1", "k2", "k3"]}, lapping={"shots": [sound[0], (1, "s2", 4.0, 10.0, "k2")]}, short={"shots": sound[:1]}, back={"shots": [(0, "s1", 0.0, 10.0, "k1"), (1, "s2", 10.0, 5.0, "k2"), (2, "s3", 5.0, 10.0, "k3")]}, empty={"shots": [], "utts": []}, moved={"units": [sound[0], (1, "s2", 5.0, 10.0, "k9")]},
    )
    assert got == {
        "sound": set(), "gap": {"shot_timeline_contiguous", "evidence_units_match_shots"}, "off": {"utterance_references_exact"}, "unlinked": {"all_utterances_linked"}, "twice": {"record_ids_unique"}, "late": {"utterances_within_timeline", "utterance_references_exact"},
        "frameless": {"one_keyframe_per_shot"}, "spare": {"one_keyframe_per_shot"}, "lapping": {"shot_timeline_contiguous"}, "short": {"shot_timeline_contiguous"}, "back": {"shot_timeline_contiguous"}, "empty": {"shot_timeline_contiguous"}, "moved": {"evidence_units_match_shots"},
    }
    assert details["unlinked", "all_utterances_linked"] == "u1" and details["twice", "record_ids_unique"] == "4" and details["frameless", "one_keyframe_per_shot"] == "1"
    many = media(spark, v={"utts": [(f"u{i:04}", 1000, 2000) for i in range(150)], "refs": False})[1]["v", "all_utterances_linked"]
    assert many == ",".join(f"u{i:04}" for i in range(100)) + " of 150"


def test_media_audit_query_names_every_unlinked_utterance(spark, tmp_path, monkeypatch):
    from evidentia.plans import evaluation

    monkeypatch.setattr(au, "LISTED", 1)
    spark.range(2000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.variant, r.name): r.details for r in evaluation.media_audit(spark, str(tmp_path)).collect()}
    assert got["unlinked", "all_utterances_linked"] == "utt_00000000,utt_00000999,utt_00001998" and got["sound", "all_utterances_linked"] == ""


def test_media_audit_of_versions_is_that_of_videos(spark):
    """Versions that share records are judged as if each were a video of its own."""
    frame = lambda rows_, kind: spark.createDataFrame([("v", *x) for x in rows_], f"video_id string, {kind}, held long")
    versions = ("sound", "gap", "late", "bare", "none")
    shots_ = frame([(0, "s1", 0.0, 5.0, "k1", 15), (1, "s2", 5.0, 10.0, "k2", 13), (1, "s2", 5.5, 10.0, "k2", 2)], "pos long, shot_id string, start_s double, end_s double, keyframe_path string")
    utts = frame([("u1", 1000, 2000, 11), ("u1", 1000, 10001, 4)], "utterance_id string, start_ms long, end_ms long")
    units = frame([(0, "s1", 0, 5000, "k1", [("u1", 1000, 2000, 1000)], 7), (0, "s1", 0, 5000, "k1", [], 8), (1, "s2", 5000, 10000, "k2", None, 15)], f"pos long, shot_id string, start_ms long, end_ms long, keyframe_path string, utterance_refs {REFS}")
    out = au.media_checks(shots_, utts, units, frame([("k1", 15), ("k2", 15)], "path string"), spark.createDataFrame([("v", 10000)], "video_id string, duration_ms long"), versions=versions).collect()
    assert len(out) == 7 * len(versions)
    assert {v: {r.name for r in out if r.version == v and not r.passed} for v in versions} == {
        "sound": set(), "gap": {"shot_timeline_contiguous", "evidence_units_match_shots"}, "late": {"utterances_within_timeline", "utterance_references_exact"}, "bare": {"all_utterances_linked"}, "none": {"shot_timeline_contiguous"},
    }
    assert {r.version: r.details for r in out if r.name == "utterance_references_exact"} == {"sound": "1", "gap": "1", "late": "1", "bare": "0", "none": "0"}


def test_media_audit_shuffles_what_variants_share_once(spark, tmp_path):
    from evidentia.plans import evaluation

    spark.range(30000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    sc = spark.sparkContext
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in (all_.apply(i) for all_ in [sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)] for i in range(all_.size()))}
    last = max(stages(), default=-1)
    audit = evaluation.media_audit(spark, str(tmp_path))
    assert "SortAggregate" not in audit._jdf.queryExecution().executedPlan().toString()
    assert len(audit.collect()) == 56 and sum(n for k, n in stages().items() if k > last) < 25 * 30000


def test_media_audit_has_few_exchanges(spark):
    frame = lambda kind: spark.createDataFrame([], f"video_id string, {kind}")
    df = au.media_checks(
        frame("pos long, shot_id string, start_s double, end_s double, keyframe_path string"), frame("utterance_id string, start_ms long, end_ms long"),
        frame(f"pos long, shot_id string, start_ms long, end_ms long, keyframe_path string, utterance_refs {REFS}"), frame("path string"), frame("duration_ms long"),
    )
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 40


def test_task_and_manifest_audit(spark):
    kind = "task_id string, video_id string, split string, query string, target_segments array<struct<start_ms long, end_ms long>>, shot_ids array<string>"
    good = ("a", "v", "train", "q", [(0, 5000)], ["s"])
    t = lambda *x: spark.createDataFrame([good, *x], kind)
    v = spark.createDataFrame([("v", 10000)], "video_id string, duration_ms long")
    passed = lambda df: {r.name: r.passed for r in au.task_checks(df, v).collect()}
    assert all(passed(t(("b", "v", "smoke", "q", [(0, 1)], ["s"]))).values())
    assert not any(passed(t(("b", "v", "test", "q", [(0, 1)], ["s"]))).values())
    errors = {(r.task_id, r.error) for r in au.task_errors(t(("a", "v", "train", " ", [(9000, 11000)], []), ("c", "w", "odd", "", [], None)), v).collect()}
    assert errors == {("a", "duplicate task_id"), ("a", "empty query"), ("a", "invalid target"), ("a", "no grounded shot evidence"), ("c", "unknown video_id")}
    f = spark.createDataFrame([("x", 4, "AB"), ("y", 5, "cd")], "path string, bytes long, sha256 string")
    want = spark.createDataFrame([("x", 4, "ab"), ("y", 6, "CE"), ("z", 1, "0")], "path string, bytes long, sha256 string")
    assert set(rows(au.artifact_errors(want, f))) == {("y", "size mismatch"), ("y", "sha256 mismatch"), ("z", "missing")}
    assert {r.name for r in au.manifest_checks(want, f, t(), v, 8, 1).collect() if not r.passed} == {"offline_package_capacity", "artifact_paths_and_sizes", "artifact_hashes"}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "tmp").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"1234")
    (tmp_path / "tmp" / "y.bin").write_bytes(b"1")
    assert rows(fs.listing(spark, str(tmp_path))) == [("a/x.bin", 4)]
    assert rows(fs.inventory(fs.listing(spark, str(tmp_path)))) == [("a", 1, 4)]
    assert rows(fs.hashes(spark, str(tmp_path / "a")).select("sha256"))[0][0].startswith("03AC6742")
    with pytest.raises(ValueError):
        fs.safe_path(str(tmp_path), "../x")
    (tmp_path / "l.jsonl").write_text('{"a": 2}\n\n{"a": 1}\n')
    assert rows(fs.read_ordered_jsonl(spark, str(tmp_path / "l.jsonl"), "a int"), "pos") == [(0, 2), (1, 1)]
    assert fs.read_jsonl(spark, str(tmp_path / "l.jsonl")).count() == 2
    np.savez(tmp_path / "e.npz", shot_ids=np.array(["p", "q"]), embeddings=np.eye(2, dtype=np.float16))
    assert rows(fs.read_npz(spark, str(tmp_path / "e.npz")).select("id", "embedding"), "id") == [("p", [1.0, 0.0]), ("q", [0.0, 1.0])]
    assert fs.read_vectors(spark, None).count() == 0
    out = spark.createDataFrame([(1, "x")], "a int, b string")
    fs.write_csv(out, str(tmp_path / "c"), bom=True)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfa,b")
    fs.write_jsonl(out, str(tmp_path / "j"))
    assert fs.read_json(spark, str(tmp_path / "j")).count() == 1
    digest = fs.combined_hash(spark.createDataFrame([("b", "02"), ("a", "01")], "name string, sha256 string")).first()
    import hashlib

    assert digest.sha256 == hashlib.sha256(b"a\x01b\x02").hexdigest().upper() and digest.files == 2


def test_means_round_half_to_even(spark):
    df = spark.createDataFrame([("a", 1.0)] + [("a", 0.0)] * 127 + [("b", 3.0)] + [("b", 0.0)] * 127, "k string, iou double")
    assert sorted(rows(mx.retrieval_metrics(df, ["k"]).select("k", "mean_iou"))) == [("a", 0.007812), ("b", 0.023438)] == [("a", round(1 / 128, 6)), ("b", round(3 / 128, 6))]
    assert sorted(rows(mx.overall_and_by(df, "k", {"iou": F.col("iou")}).where("k is not null").select("k", "iou"))) == [("a", 0.007812), ("b", 0.023438)]


def test_sampling_and_metrics(spark):
    df = spark.range(100)
    assert [r[0] for r in rows(sp.systematic(df.withColumn("k", F.lit(1)), ["id"], 15, ["k"]).select("id"), "id")] == list(range(0, 90, 6))
    parts = [{r[0] for r in sp.shard(df, ["id"], i, 3).collect()} for i in range(3)]
    assert set.union(*parts) == set(range(100)) and parts[1] == set(range(1, 100, 3))
    assert rows(sp.hash_sample(df, "id", 5)) == rows(sp.hash_sample(df.repartition(7), "id", 5))
    with pytest.raises(ValueError):
        sp.shard(df, ["id"], 3, 3)
    with pytest.raises(Exception, match="duplicate id"):
        mx.merge_shards([df, spark.range(1)], "id").collect()
    empty = spark.createDataFrame([], "s string, x int")
    assert rows(mx.overall_and_by(empty, "s", {"x": F.col("x")})) == [(None, 0, 0.0)]


def test_training(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id int, turn int, role string, text string")
    c = tr.chats(t).first()
    assert [m.role for m in c.messages] == ["system", "user", "assistant"] and len(c.prompt) == 2
    kind = "conv_id int, turn int, role string, tool string"
    ok = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 2, "tool", None), (1, 3, "assistant", "y"), (1, 4, "tool", None)]
    assert [r.name for r in tr.native_calls(spark.createDataFrame(ok, kind)).orderBy("turn").collect()] == [None, None, "x", None, "y"]
    for bad in ([*ok, (1, 5, "tool", None)], [(1, 0, "user", None)]):
        with pytest.raises(Exception, match="tool"):
            tr.native_calls(spark.createDataFrame(bad, kind)).collect()
    steps = spark.createDataFrame([("t", 1, "search", '{"q": 1}', "{}")], "task_id string, step int, tool string, arguments string, observation string")
    prompts = spark.createDataFrame([("t", [("user", "hi")])], f"task_id string, prompt array<{tr.MESSAGE}>")
    assert [m.role for m in tr.trajectory_chats(steps, prompts).first().messages] == ["user", "assistant", "tool"]


def test_segment_rewards(spark):
    seg = [("e", "a", "red car", True), ("e", "b", "tree", False), ("f", "b", "tree", False), ("f", "a", "red car", True), ("g", "a", "car", True)]
    segments = spark.createDataFrame(seg, "episode_id string, segment_id string, text string, target boolean")
    calls = [("e", 1, "search_transcript", "none", None, None), ("e", 2, "inspect_segment", None, "a", None), ("e", 3, "inspect_segment", None, "a", None), ("e", 4, "inspect_segment", None, "z", None), ("e", 5, "search_transcript", "car", None, None), ("e", 6, "fly", None, None, None), ("e", 7, "answer", None, None, ["a", "a"]), ("e", 8, "fly", None, None, None)]
    calls += [("f", k, "inspect_segment", None, "b", None) for k in range(1, 12)] + [("g", 1, "answer", None, None, ["a"])]
    df = spark.createDataFrame(calls, "episode_id string, step long, tool string, query string, segment_id string, segment_ids array<string>")
    got = {}
    for r in ep.segment_rewards(df, segments, 9).orderBy("step").collect():
        got.setdefault(r.episode_id, []).append((round(r.reward, 9), r.done))
    assert [x for x, _ in got["e"]] == [-0.10, 0.15, -0.15, -0.20, 0.05, -0.20, 1.0] and [d for _, d in got["e"]] == [False] * 6 + [True]
    assert [x for x, _ in got["f"]] == [-0.05, *[-0.15] * 7, -0.35] and got["f"][-1][1] and got["g"] == [(-0.5, True)]


def test_moment_rewards(spark):
    u = spark.createDataFrame([("e", 1, 1000, 2000, "The red car"), ("e", 2, 30000, 31000, "a red tree and a car"), ("n", 3, 0, 1000, "nothing")], "episode_id string, utterance_id int, start_ms long, end_ms long, text string")
    terms = spark.createDataFrame([("e", ["red", "car", "Tree!"]), ("n", ["red"])], "episode_id string, terms array<string>")
    moments = ep.found_moments(u, terms)
    assert rows(moments) == [("e", 30000, 31000, 1.0)]
    shots_ = spark.createDataFrame([("e", "s1", 0, 10000, "k1"), ("e", "s2", 20000, 40000, "k2"), ("e", "s3", 34000, 36000, None)], "episode_id string, shot_id string, start_ms long, end_ms long, keyframe string")
    targets = spark.createDataFrame([("e", 28000, 33000), ("n", 0, 9)], "episode_id string, start_ms long, end_ms long")

    def play(*tools, key="e", most=7):
        calls = spark.createDataFrame([(key, k, t) for k, t in enumerate(tools, 1)], "episode_id string, step long, tool string")
        return [(round(r.reward, 6), r.done) for r in ep.moment_rewards(ep.closed(calls, "submit"), moments, shots_, targets, most, 480000).orderBy("step").collect()]

    assert [x for x, _ in play("inspect", "search", "inspect", "audit", "submit", "search")] == [-0.3, -0.05, 0.0, 0.05, 2.7]
    assert play("search") == [(-0.05, False), (2.0, True)] and play("search", key="n") == [(-0.05, False), (-1.0, True)]
    # Expanded before it is looked at: of two shots the second is the middle one, without a keyframe.
    assert [x for x, _ in play("search", "expand", "inspect", "audit", "audit")] == [-0.05, -0.05, -0.05, -0.05, -0.3, round(2 * 5 / 15, 6)]
    assert play("search", "search", "search", most=3) == [(-0.05, False), (-0.3, False), (-0.8, True)]
    calls = spark.createDataFrame([("e", 1, "search"), ("f", 1, "submit")], "episode_id string, step long, tool string")
    assert sorted(rows(ep.closed(calls, "submit"))) == [("e", 1, "search"), ("e", 2, "submit"), ("f", 1, "submit")]


def test_team_results(spark):
    shots_ = spark.createDataFrame([("t", i, i * 1000, (i + 1) * 1000) for i in range(6)], "task_id string, pos long, start_ms long, end_ms long")
    scores = lambda m, s: [("t", i, m, float(x)) for i, x in enumerate(s)]
    chain = lambda x: gr.fuse(gr.update(spark.createDataFrame(x, "task_id string, pos long, modality string, score double"), shots_.select("task_id", "pos", "start_ms")))
    text, image = scores("text", [0, 0, 1, 0.9, 0, 0]), scores("image", [0, 0, 0.8, 1, 0.1, 0])
    good = shots_.where("pos in (2, 3)").select("task_id", "pos")
    r = ep.team_results(chain(text), chain(text + image), shots_, good, spark.createDataFrame([("t", 2000, 4000)], "task_id string, start_ms long, end_ms long")).first()
    assert (r.calls, r.selected, r.iou, r.f1, r.success) == (6, [2, 3], 1.0, 1.0, True) and r.process == pytest.approx(0.18 + 0.24 + 0.08)
    assert r.reward == pytest.approx(2 + 0.35 + 0.3 * r.audit_score + 0.2 + r.process - 0.025 * 5)
    low = ep.team_results(chain(scores("text", [0.1, 0, 0, 0, 0, 0])), chain(scores("text", [0.1, 0, 0, 0, 0, 0])), shots_, good, spark.createDataFrame([("t", 2000, 4000)], "task_id string, start_ms long, end_ms long")).first()
    assert (low.calls, low.selected, low.iou, low.success) == (6, [0], 0.0, False) and low.process == pytest.approx(-0.02 - 0.06)


def test_dispatch(spark):
    calls = [(None, "{}"), ("submit", None), ("fly", "{}"), ("submit", "{}"), ("search_visual", '{"query": "q", "top_k": "many"}'), ("inspect_keyframe", '{"shot_id": "a", "x": 1}'), ("expand_context", '{"shot_id": "a", "radius": -1}')]
    df = spark.createDataFrame(calls, "tool string, arguments string")
    assert [r.outcome for r in ep.dispatched(df.coalesce(1)).collect()] == ["parse_error", "parse_error", "unknown_tool", "invalid_arguments", "invalid_arguments", "invalid_arguments", "ok"]


def test_streams(spark, tmp_path):
    from evidentia.streaming import sessions as ss

    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'a' event_type, 2.0 value, 7L user_id union all select timestamp'2024-01-01 00:00:20', 'a', 1.0, 7L").write.parquet(str(tmp_path / "ev"))
    ev = lambda: spark.readStream.schema("ts timestamp, event_type string, value double, user_id long").parquet(str(tmp_path / "ev"))
    for name, df in (("win", ss.windowed_counts(ev(), "10 seconds", "1 minute")), ("gap", ss.gap_sessions(ev(), "5 seconds", "1 minute"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "win" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("win").count() == 2


def streamed(spark, folder, parts, schema):
    """A stream of one file a batch, in the order of parts."""
    import os
    import time

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:02}")
        at = time.time() - 1000 + 10 * i
        for f in os.listdir(f"{folder}/{i:02}"):
            os.utime(f"{folder}/{i:02}/{f}", (at, at))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drained(df, name, folder):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_streamed_sessions_are_those_of_the_table(spark, tmp_path):
    """Rows out of order within the bound give the batch query's sessions; the last of each user comes out by the watermark, and rows beyond it are dropped."""
    from evidentia.streaming import sessions as ss

    rng = np.random.default_rng(12)
    kind = "user_id long, start_ms long, end_ms long"
    data = [(int(rng.integers(3)), int(s), int(s + rng.integers(0, 900))) for s in np.sort(rng.integers(0, 60_000, 90))]
    order = np.argsort([s + rng.integers(0, 4000) for _, s, _ in data])  # at most 4 s out of order
    parts = [[data[i] for i in order[a : a + 18]] for a in range(0, 90, 18)]
    far = [[(9, 200_000, 200_001)], [(0, 100, 90_000), (9, 400_000, 400_001)], [(9, 500_000, 500_001)]]  # with a row that is much too late
    got = drained(ss.end_gap_sessions(streamed(spark, tmp_path / "in", parts + far, kind), 1500, "5 seconds"), "closed", tmp_path).where("user_id <> 9")
    batch = iv.sessionize(spark.createDataFrame(data, kind), ["user_id"], 1500, ["start_ms", "end_ms"])
    want = batch.groupBy("user_id", "session").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"), F.count("*").alias("n")).select("user_id", "a", "b", "n")
    assert sorted(rows(got)) == sorted(rows(want)) and want.count() > 12


def test_streamed_overlaps_are_those_of_the_tables(spark, tmp_path):
    from evidentia.streaming import sessions as ss

    rng = np.random.default_rng(13)
    side = lambda name, n: [(f"v{rng.integers(2)}", f"{name}{i}", int(s), int(s + rng.integers(0, 3000))) for i, s in enumerate(rng.integers(0, 50_000, n))]
    a, b = side("a", 60), side("b", 45)

    def cut(x, far):
        shuffled = sorted(x, key=lambda r: r[2] + rng.integers(0, 2000))
        return [shuffled[i : i + 15] for i in range(0, len(x), 15)] + [[("v0", "far", t, t + 1)] for t in far]

    kind = lambda name: f"video_id string, {name} string, start_ms long, end_ms long"
    left, right = streamed(spark, tmp_path / "a", cut(a, (300_000, 500_000)), kind("a")), streamed(spark, tmp_path / "b", cut(b, (300_000, 500_000, 700_000)), kind("b"))
    got = drained(ss.streamed_overlaps(left, right, ["video_id"], 3000, "60 seconds"), "shared", tmp_path).where("a <> 'far'")
    want = iv.overlap_join(spark.createDataFrame(a, kind("a")), spark.createDataFrame(b, kind("b")), ["video_id"])
    assert sorted(rows(got.select(*want.columns)), key=repr) == sorted(rows(want), key=repr) and want.where("right_b is null").count() > 5
    long = streamed(spark, tmp_path / "c", [[("v0", "x", 0, 9000)]], kind("a"))
    with pytest.raises(Exception, match="longer than 3000 ms"):
        drained(ss.streamed_overlaps(long, right, ["video_id"], 3000, "60 seconds"), "bad", tmp_path)


def test_ordered_lines_of_a_split_file(spark, tmp_path):
    """A file that is read in many tasks has the same places."""
    text = "".join(("\n", " \r\n", "")[i % 3] + json.dumps({"task_id": f"t{i}", "query": "é" * (i % 37)}) + ("\r\n" if i % 5 else "\n") for i in range(500))
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    (tmp_path / "b.jsonl").write_text('{"task_id": "last"}')
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for size in (before, "1000"):
        spark.conf.set(key, size)
        try:
            df = fs.load_tasks(spark, str(tmp_path / "*.jsonl"))
            got = rows(df.select("pos", "task_id", F.length("query")), "pos")
            assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 10 or size == before
        finally:
            spark.conf.set(key, before)
        assert got == [(i, f"t{i}", i % 37) for i in range(500)] + [(500, "last", None)]


def test_a_file_beyond_two_gib_is_hashed_in_blocks(spark, tmp_path):
    import hashlib

    n = (2 << 30) + 5
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(n)
    (tmp_path / "small.bin").write_bytes(b"x")
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(n >> 24):
        want.update(zeros)
    want.update(bytes(n & ((1 << 24) - 1)))
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in fs.hashes(spark, str(tmp_path)).collect()}
    assert got == {"big.bin": (n, want.hexdigest().upper()), "small.bin": (1, hashlib.sha256(b"x").hexdigest().upper())}
    assert [r.bytes for r in fs.hashes(spark, str(tmp_path), [f"{tmp_path}/small.bin", f"{tmp_path}/none"]).collect()] == [1]


def test_archives_are_read_in_blocks(spark, tmp_path):
    x = np.arange(700, dtype="float32").reshape(100, 7)
    np.savez(tmp_path / "a.npz", embeddings=x, shot_ids=np.array([f"s{i}" for i in range(100)]))
    np.savez_compressed(tmp_path / "b.npz", embeddings=np.asfortranarray(x[:9].astype("float64")))
    with np.load(tmp_path / "a.npz") as z:
        parts = list(fs.member_blocks(z, "embeddings", 100))
        assert len(parts) == 34 and (np.concatenate(parts) == x).all()
    got = {(r.path.rsplit("/", 1)[1], r.id): r.embedding for r in fs.read_npz(spark, str(tmp_path / "*.npz")).collect()}
    assert len(got) == 109 and got["a.npz", "s7"] == x[7].tolist() and got["b.npz", "8"] == x[8].tolist()


def test_registry(spark):
    from evidentia.operators import registry as rg

    u = spark.createDataFrame([("v", f"u{i}", i * 4000, i * 4000 + 1000, "(music)" if i == 1 else f"<i>these are four words {i}</i>") for i in range(8)], "video_id string, utterance_id string, start_ms long, end_ms long, text string")
    s = spark.createDataFrame([("v", f"s{i}", i * 5000, i * 5000 + 5000) for i in range(7)], "video_id string, shot_id string, start_ms long, end_ms long")
    t = rg.dialogue_registry(u, s, "train", "t", first=3)
    got = {r.task_id: r for r in t.collect()}
    assert set(got) == {"t_001", "t_002", "t_003"} and got["t_001"].start_ms == 0 and got["t_001"].shot_ids == ["s0"] and got["t_002"].shot_ids == ["s1", "s2"]
    assert rg.dialogue_registry(u, s, "val", "w", spread=2).count() == 2
    later = spark.createDataFrame([("w", "u0", 9000, 9500, "these are four words")], u.schema)
    both = {r.video_id: r.shot_ids for r in rg.dialogue_registry(u.unionByName(later), s.unionByName(spark.createDataFrame([("w", "z", 8000, 12000)], s.schema)), "train", "t").where("task_id = 't_001'").collect()}
    assert both == {"v": ["s0"], "w": ["z"]}  # one id in two videos
    r = rg.registry_report(t.unionByName(rg.dialogue_registry(u, s, "val", "w", spread=2))).first()
    assert r.videos == 1 and r.shared == {"train/val": 1} and r.splits["train"].tasks == 3
    raw = spark.createDataFrame([("q", "Find the Red car", [[1.5, 3.0]], [2, 1, 2]), ("r", "x", [], [1])], "qid string, query string, windows array<array<double>>, clips array<int>")
    a = rg.annotation_registry(raw, "val").collect()
    assert len(a) == 1 and a[0].clip_ids == [1, 2] and a[0].search_terms == ["find", "the", "red", "car"] and a[0].target_segments[0].end_ms == 3000


def test_audit_command(spark, tmp_path, capsys):
    import hashlib

    from evidentia import audit

    (tmp_path / "a.bin").write_bytes(b"1234")
    task = {"task_id": "t", "video_id": "v", "split": "train", "query": "q", "target_segments": [{"start_ms": 0, "end_ms": 5}], "evidence": {"shot_ids": ["s"]}}
    (tmp_path / "tasks.jsonl").write_text(json.dumps(task) + "\n")
    m = {"capacity": {"hard_limit_bytes": 10**6}, "tasks": {"path": "tasks.jsonl", "count": 1}, "videos": [{"video_id": "v", "duration_ms": 10, "artifacts": [{"path": "a.bin", "bytes": 4, "sha256": hashlib.sha256(b"1234").hexdigest().upper()}]}]}
    for change, status in (({}, 0), ({"bytes": 5}, 1), ({"sha256": "00"}, 1)):
        m["videos"][0]["artifacts"][0] |= change
        (tmp_path / "m.json").write_text(json.dumps(m))
        assert audit.main([str(tmp_path / "m.json"), "--root", str(tmp_path)]) == status
    m["videos"][0]["artifacts"][0] |= {"bytes": 4}
    (tmp_path / "m.json").write_text(json.dumps(m))
    assert audit.main([str(tmp_path / "m.json"), "--root", str(tmp_path), "--skip-hashes"]) == 0
    # Schemas of the manifest and of its tasks, and a path that leaves the package.
    (tmp_path / "schema.json").write_text(json.dumps({"required": ["capacity"], "type": "object", "properties": {"capacity": {"type": "object", "properties": {"hard_limit_bytes": {"type": "integer", "maximum": 10**6}}}}}))
    (tmp_path / "task.json").write_text(json.dumps({"type": "object", "properties": {"split": {"enum": ["train"]}, "query": {"minLength": 1}}}))
    m["tasks"]["schema"] = "task.json"

    def run(change=None):
        (tmp_path / "m.json").write_text(json.dumps(m | (change or {})))
        capsys.readouterr()
        status = audit.main([str(tmp_path / "m.json"), "--root", str(tmp_path), "--skip-hashes", "--schema", str(tmp_path / "schema.json")])
        out = json.loads(capsys.readouterr().out)
        return status, {c["name"] for c in out["checks"] if not c["passed"]}, len(out["checks"])

    assert run() == (0, set(), 8)
    assert run({"capacity": {"hard_limit_bytes": 10**7}}) == (1, {"manifest_json_schema"}, 8)
    (tmp_path / "tasks.jsonl").write_text(json.dumps(task | {"query": ""}) + "\n\n")
    assert run()[1] == {"task_json_schema", "task_schema_and_ranges"}
    (tmp_path / "tasks.jsonl").write_text(json.dumps(task) + "\n")
    m["videos"][0]["artifacts"].append({"path": "../x", "bytes": 1, "sha256": "0"})
    assert run()[:2] == (1, {"artifact_paths_and_sizes"})


def test_clip_command(spark, tmp_path):
    from evidentia import clip

    (tmp_path / "in.srt").write_text("1\n00:00:01,000 --> 00:00:03,000\nbefore\n\n2\n00:00:09,500 --> 00:00:12,000\nfirst\nlines\n\n3\n00:00:14,000 --> 00:00:30,000\nlast\n")
    args = ["--input", str(tmp_path / "in.srt"), "--output", str(tmp_path / "out" / "clip.srt"), "--start-seconds", "10", "--duration-seconds"]
    assert clip.main([*args, "5"]) == 0
    assert (tmp_path / "out" / "clip.srt").read_text() == "1\n00:00:00,000 --> 00:00:02,000\nfirst\nlines\n\n2\n00:00:04,000 --> 00:00:05,000\nlast\n"
    clip.main([*args[:5], "40", "--duration-seconds", "5"])
    assert (tmp_path / "out" / "clip.srt").read_text() == ""


def test_features_and_tasks(spark, tmp_path):
    np.savez(tmp_path / "f.npz", features=np.array([[3.0, 4.0], [0.0, 0.0]]))
    assert rows(fs.read_features(spark, str(tmp_path / "f.npz")).select("clip", "embedding"), "clip") == [(0, [0.6, 0.8]), (1, [0.0, 0.0])]
    (tmp_path / "t.jsonl").write_text('{"task_id": "a", "search_terms": ["x"], "target_start_ms": 1}\n')
    assert fs.load_tasks(spark, str(tmp_path / "t.jsonl")).first().search_terms == ["x"]


def test_ranks_within_cells(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), int(x), i) for i, (k, x) in enumerate(zip(rng.integers(0, 3, 3000), rng.zipf(1.3, 3000).clip(0, 10**9), strict=True))] + [(0, None, 3000), (0, 5, 3001)]
    df = spark.createDataFrame(data, "k int, x long, i int")
    nulls_first = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for rows_in_cell in (10, 100, 1 << 20):
        got = {r.i: r["__rank"] for r in sp.ranked(df, ["x", "i"], cell_rows=rows_in_cell).collect()}
        assert got == {r[2]: n for n, r in enumerate(sorted(data, key=nulls_first))}
        for r in sp.ranked(df, ["x", "i"], ["k"], rows_in_cell).where("k = 1").collect():
            got[r.i] = r["__rank"]
        assert [got[r[2]] for r in sorted((r for r in data if r[0] == 1), key=nulls_first)] == list(range(sum(r[0] == 1 for r in data)))
    same = spark.createDataFrame([(7, i) for i in range(50)], "x long, i int")
    assert [r["__rank"] for r in sp.ranked(same, ["x", "i"], cell_rows=5).orderBy("i").collect()] == list(range(50)) and sp.ranked(same.limit(0), ["x", "i"]).count() == 0


def mixed(spark, n, name, seed):
    """Intervals from empty to the whole timeline, some repeated, some without a bound, some before zero."""
    rng = np.random.default_rng(seed)
    width = np.where(rng.random(n) < 0.2, 0, 2 ** rng.uniform(0, 20, n)).astype(int)
    start = np.where(rng.random(n) < 0.2, rng.integers(0, 8, n) * 65536, rng.integers(-5000, 1 << 20, n))
    data = [(f"v{i % 2}" if i % 50 else None, f"{name}{i}", int(a), int(a + w)) for i, (a, w) in enumerate(zip(start, width, strict=True))]
    data += [("v0", f"{name}all", -5000, 1 << 21), ("v1", f"{name}none", None, 5), *data[:5]]
    return spark.createDataFrame(data, f"video_id string, {name} string, start_ms long, end_ms long")


def test_intervals_of_mixed_lengths(spark):
    a, b = mixed(spark, 250, "a", 2), mixed(spark, 200, "b", 3)
    pair = a.alias("x").join(b.select("video_id", F.col("b").alias("right_b"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).alias("y"), "video_id").where("start_ms is not null and s is not null")
    touch = sorted(rows(pair.where("end_ms > s and start_ms < e").select("a", "right_b")))
    share = sorted(rows(pair.where("greatest(start_ms, s) < least(end_ms, e)").select("a", "right_b", F.expr("least(end_ms, e) - greatest(start_ms, s)"))))
    assert sorted(rows(iv.touch_join(a, b, ["video_id"]).select("a", "right_b"))) == touch
    assert sorted(rows(iv.overlap_join(a, b, ["video_id"], "inner").select("a", "right_b", "overlap_ms"))) == share
    left = iv.overlap_join(a, b, ["video_id"])
    assert left.count() == len(share) + a.join(left.where("right_b is not null").select("a"), "a", "left_anti").count()
    hit = {x for x, _ in touch}
    assert sorted(rows(iv.window_semi(a, b, ["video_id"]).select("a"))) == sorted((r.a,) for r in a.collect() if r.a in hit)


def test_copies_of_an_interval_are_bounded(spark):
    """Whatever its length: two in bins of its class, two for each wider class of the other side."""
    a, b = mixed(spark, 300, "a", 4), mixed(spark, 300, "b", 5)
    classes = b.select(iv.length_class(F.col("start_ms"), F.col("end_ms"))).distinct().count()
    most = iv.binned(a, b, "start_ms", "end_ms", True, "start_ms", "end_ms").groupBy("a", "start_ms").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 2 * (classes + 1) <= 2 * 2 * (iv.CLASSES + 1)  # rows that are there twice
    one = b.where("b = 'ball'")
    assert iv.binned(a.distinct(), one, "start_ms", "end_ms", True, "start_ms", "end_ms").groupBy("a", "start_ms").count().agg(F.max("count")).first()[0] <= 4
    wide = spark.range(6).select(F.expr("pow(4, id)").cast("long").alias("n")).select(iv.length_class(F.lit(0), F.col("n")).alias("k"), iv.length_class(F.lit(0), F.col("n") + 1).alias("l")).collect()
    assert [(r.k, r.l) for r in wide] == [(k, k + 1) for k in range(6)]


def test_shots_yaml_cuts_and_rewards(spark, tmp_path):
    (tmp_path / "shots.jsonl").write_text('{"shot_id": "s1", "start_s": 0, "end_s": 13.8125, "keyframe_s": 0.0005, "keyframe_path": "k1"}\n\n{"shot_id": "s2", "start_s": 13.8125, "end_s": 20, "keyframe_s": 0.0015, "keyframe_path": "k2"}\n')
    assert rows(fs.load_shots(spark, str(tmp_path / "shots.jsonl")), "pos") == [(0, "s1", 0, 13812, 0, "k1"), (1, "s2", 13812, 20000, 2, "k2")]
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            fs.read_yaml(str(tmp_path / "c.yaml"))
    else:
        (tmp_path / "c.yaml").write_text("a:\n  b: 1\n")
        assert fs.read_yaml(str(tmp_path / "c.yaml")) == {"a": {"b": 1}}
    r = spark.createDataFrame([("a", "v", True, 1500, 4000, 1), ("b", "v", False, 0, 1, 2)], "task_id string, video_id string, success boolean, predicted_start_ms long, predicted_end_ms long, reward_parts int")
    assert rows(fs.cut_list(r)) == [("a", "v", 1.5, 2.5)]
    assert "reward_parts" not in pr.without_rewards(r).columns and len(pr.without_rewards(r).columns) == 5


def test_container_checks_and_missing_files(spark):
    good = [(10_050, 1, 1, "AA", "AA")]
    kind = "duration_ms long, video_streams int, audio_streams int, sha256 string, expected_sha256 string"
    failed = lambda row: {r.name for r in au.container_checks(spark.createDataFrame(row, kind), 10_000).collect() if not r.passed}
    assert failed(good) == set() and failed([(10_101, 1, 0, "AA", "AB")]) == {"media_duration_matches", "media_stream_layout", "media_hashes_match"}
    rows_ = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    assert rows(au.orphans(rows_, spark.createDataFrame([("a",)], "path string"), "path")) == [("b", 2)]


def test_packages_and_manifests(spark, tmp_path):
    for p, text in (("src/a.py", "x"), ("src/b.PYC", "x"), ("src/tmp/c.py", "x"), ("README.md", "read"), ("other/d.py", "x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    picked = [r.path for r in fs.package_selection(fs.listing(spark, str(tmp_path), ()), ["src"], ["README.md"], skip_suffixes=(".pyc",)).collect()]
    assert picked == ["README.md", "src/a.py"]
    listed = fs.write_package(str(tmp_path), picked, str(tmp_path / "out.zip"))
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.namelist() == [*picked, "manifest.json"] and json.loads(z.read("manifest.json"))["files"] == listed and listed[0]["bytes"] == 4
    with pytest.raises(ValueError, match="escapes"):
        fs.write_package(str(tmp_path), ["../x"], str(tmp_path / "bad.zip"))
    files = spark.createDataFrame([("v", "b.srt", 5, "B"), ("v", "a.mp4", 9, "A"), ("v", "x/keyframes/1.jpg", 3, "C"), ("v", "x/keyframes/2.jpg", 4, "D")], "video_id string, path string, bytes long, sha256 string")
    specs = rg.video_specs(spark.createDataFrame([("v", "train", 1000)], "video_id string, split string, duration_ms long"), files)
    m = rg.manifest(specs, spark.range(7), "d1", 10**9, "tasks.jsonl").first()
    assert [a.path for a in m.videos[0].artifacts] == ["a.mp4", "b.srt"] and tuple(m.videos[0].keyframe_inventory) == (2, 7) and (m.tasks["count"], m.capacity.hard_limit_bytes) == (7, 10**9)


def test_json_schema(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 1, "items": {"type": "integer", "maximum": 5}}, "b": {"type": "boolean"}, "c": {"type": "number", "minimum": 0.5}}}
    texts = ['{"a": [1, 2]}', '{"a": []}', '{"a": [9, "x"], "b": 1, "c": 0.25}', "[]", "nothing", None, '{"a": [5], "b": true, "c": 0.5, "more": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in au.json_errors(df, "i", "t", schema).collect():
        got.setdefault(r.i, []).append(r.error)
    assert {k: sorted(v) for k, v in got.items()} == {
        1: ["$.a: has too few items"], 2: ["$.a[]: is greater than 5", "$.a[]: is not of type integer", "$.b: is not of type boolean", "$.c: is less than 0.5"],
        3: ["$: is not of type object"], 4: ["not JSON"], 5: ["not JSON"],
    }


def test_json_schema_types(spark):
    """Booleans are not numbers or texts, a list of types is any of them, and 2.0 is an integer."""
    texts = ["true", "1", '"true"', "false", "2.0", "2.5", "null", '"x"', "[]", "1e3"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ok = lambda schema: [t for i, t in enumerate(texts) if i not in {r.i for r in au.json_errors(df, "i", "t", schema).collect()}]
    assert ok({"const": True}) == ["true"] and ok({"const": 1}) == ["1"] and ok({"const": "true"}) == ['"true"'] and ok({"const": None}) == ["null"]
    assert ok({"type": "integer"}) == ["1", "2.0", "1e3"] and ok({"type": "number"}) == ["1", "2.0", "2.5", "1e3"]
    assert ok({"type": ["boolean", "null"]}) == ["true", "false", "null"] and ok({"type": ["string", "array"]}) == ['"true"', '"x"', "[]"]
    assert ok({"enum": [True, 2, "x", None]}) == ["true", "2.0", "null", '"x"']


def test_text_embedding_on_executors(spark):
    def encoder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    got = {r.id: r.embedding for r in rt.embedded(df, "id", "t", encoder).collect()}
    assert got[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[2] == [0.0, 1.0]
    with pytest.raises(ValueError, match="blocks"):
        rt.cosine_scores(spark.range(rt.MOST_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("embedding")), df)


def test_streamed_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, at int, t string")
    got = {r.k: (r.sha256, r.files) for r in fs.ordered_digest(df, ["k"], "at", F.col("t").cast("binary"), b"|").collect()}
    assert got == {"a": (hashlib.sha256(b"x|y").hexdigest().upper(), 2), "b": (hashlib.sha256(b"z").hexdigest().upper(), 1)}
    assert fs.ordered_digest(df.limit(0), ["k"], "at", F.col("t").cast("binary")).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    sets = {"a": rng.normal(size=5000), "b": np.concatenate((np.full(3000, 2.0), rng.normal(2, 1e-9, 500), [1e300, -1e300])), "c": rng.integers(0, 3, 2000), "d": [7.0], "e": np.full(900, -1.0), "f": np.exp(rng.normal(0, 60, 3000)), None: [1.0, 2.0, 4.0]}
    data = [(k, float(x)) for k, v in sets.items() for x in v] + [("a", None), ("g", None)]
    df = spark.createDataFrame(data, "k string, x double").repartition(7)
    for q in (0.0, 0.5, 0.72, 1.0):
        for held in (4, 600, 1 << 16):
            got = {r.k: r["quantile"] for r in qt.quantiles(df, ["k"], "x", q, held=held).collect()}
            assert set(got) == set(sets) and all(got[k] == pytest.approx(np.quantile(v, q), rel=1e-12) for k, v in sets.items())
    assert [r["m"] for r in qt.quantiles(df.where("k = 'a'"), [], "x", 0.5, "m", held=100).collect()] == [pytest.approx(np.quantile(sets["a"], 0.5))]


def test_ranks_over_any_columns(spark):
    rng = np.random.default_rng(7)
    data = [("same", rng.choice(["b", "a", None, "ä", "Z"]), bool(i % 2), i) for i in range(400)]
    df = spark.createDataFrame(data, "c string, t string, b boolean, i int").repartition(5)
    want = [r[3] for r in sorted(data, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[2], r[3]))]
    for cell_rows in (30, 1 << 20):
        got = sp.ranked(df, ["c", "t", "b", "i"], cell_rows=cell_rows).collect()
        assert [r.i for r in sorted(got, key=lambda r: r["__rank"])] == want and sorted(r["__rank"] for r in got) == list(range(400))
        each = sp.ranked(df, ["i"], ["t"], cell_rows).collect()
        for t in ("b", "a", None, "ä", "Z"):
            assert [r["__rank"] for r in sorted((r for r in each if r.t == t), key=lambda r: r.i)] == list(range(sum(x[1] == t for x in data)))
    assert sorted(r["__rank"] for r in sp.ranked(df, ["c"], cell_rows=30).collect()) == list(range(400))


def test_scans_in_chunks(spark):
    rng = np.random.default_rng(9)
    data = [(k, i, float(rng.normal())) for k in ("x", "y", None) for i in range(41 if k else 7)]
    df = spark.createDataFrame(data, "k string, i long, v double").repartition(6)
    w = Window.partitionBy("k").orderBy("i")
    want = df.withColumns({"a": F.sum("v").over(w.rowsBetween(-2, 1)), "l": F.lag("v").over(w), "f": F.lead("v", 2).over(w), "s": F.sum("v").over(w), "m": F.max("v").over(w)})
    for chunk in (1, 2, 5, 100):
        got = sc.beside(df, ["k"], "i", 2, 2, lambda w: {"a": F.sum("v").over(w.rowsBetween(-2, 1)), "l": F.lag("v").over(w), "f": F.lead("v", 2).over(w)}, chunk)
        got = sc.running(sc.running(got, ["k"], "i", {"s": F.col("v")}, chunk), ["k"], "i", {"m": F.col("v")}, chunk, F.max)
        for x, y in zip(sorted(rows(got.select(*want.columns)), key=repr), sorted(rows(want), key=repr), strict=True):
            assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])


def test_a_long_series_is_decoded_in_chunks(spark):
    rng = np.random.default_rng(10)
    data = [(k, i, float(x)) for k, n in ((1, 300), (2, 4), (3, 1), (4, 77)) for i, x in enumerate(np.convolve(rng.random(n), np.ones(4) / 4, "same"))]
    df = spark.createDataFrame(data, "series int, clip long, score double")
    whole = rows(sh.proposals(df, limit=50), "series")
    assert len(whole) > 10
    for chunk in (1, 3, 16):
        assert sorted(rows(sh.proposals(df, limit=50, chunk=chunk))) == sorted(whole)
    below = spark.createDataFrame([(1, i, -float(x)) for i, x in enumerate([9, 8, 7, 2, 2, 2, 7, 8, 9, 9, 9])], "series int, clip long, score double")
    # All below zero: the peak of the smoothed scores alone, which is where fewest of the five are there.
    assert [(r.start_ms, r.end_ms, r.anchor) for r in sh.proposals(below, limit=5).collect()] == [(4000, 14000, 4)]


def test_sessions_in_chunks(spark):
    rng = np.random.default_rng(11)
    data = [(int(u), i, int(s), int(s + d)) for i, (u, s, d) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 9000, 200), rng.integers(0, 50, 200), strict=True))]
    df = spark.createDataFrame(data, "u int, i int, start_ms long, end_ms long")
    w = Window.partitionBy("u").orderBy("start_ms", "i")
    want = sorted(rows(df.withColumn("n", (F.col("start_ms") - F.lag("end_ms").over(w) > 60).cast("int")).withColumn("s", F.coalesce(F.sum("n").over(w), F.lit(0))).select("i", "s")))
    for cell_rows, chunk in ((1 << 20, 1 << 17), (20, 6)):
        assert sorted(rows(iv.sessionize(df, ["u"], 60, ["start_ms", "i"], cell_rows, chunk).select("i", "session"))) == want
