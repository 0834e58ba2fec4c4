"""Training data, trajectories and episodes on the conversations, events, benchmark and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import timecode as tc
from ..operators import episodes as ep
from ..operators import graph as gr
from ..operators import prompts as pr
from ..operators import training as tr
from ..session import checkpointed, new_path
from ..sources import files as fs
from ..sources import subtitles as sb
from .search import EVID, updated
from .tables import table

QUERIES, ORACLE = {}, {}


def plan(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@plan("""WITH f AS (SELECT conv_id, min(CASE WHEN role = 'assistant' THEN turn END) AS first FROM conversations GROUP BY 1)
SELECT c.conv_id, count(*) AS messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest, sum((first IS NULL OR turn < first)::BIGINT)::BIGINT AS prompt FROM conversations c JOIN f USING (conv_id) GROUP BY 1""")
def chat_export(spark, sf_dir):
    c = tr.chats(table(spark, sf_dir, "conversations"))
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return c.select("conv_id", F.size("messages").cast("long").alias("messages"), F.md5(text.cast("binary")).alias("digest"), F.size("prompt").cast("long").alias("prompt"))


# Steps of a user: an event is a call of the tool of its type; its value is the argument.
STEPS = "st AS (SELECT user_id, event_id AS step, event_type AS tool, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events)"


def steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value")


@plan(f"""WITH {STEPS}, m AS (SELECT user_id, step * 2 AS turn, 'assistant' AS role, tool FROM st UNION ALL SELECT user_id, step * 2 + 1, 'tool', NULL FROM st)
SELECT user_id, turn, CASE WHEN role = 'tool' THEN lag(tool) OVER (PARTITION BY user_id ORDER BY turn) END AS name FROM m""")
def tool_names(spark, sf_dir):
    s = steps(spark, sf_dir)
    m = s.select("user_id", (F.col("step") * 2).alias("turn"), F.lit("assistant").alias("role"), "tool").unionByName(s.select("user_id", (F.col("step") * 2 + 1).alias("turn"), F.lit("tool").alias("role"), F.lit(None).cast("string").alias("tool")))
    return tr.native_calls(m, "user_id").select("user_id", "turn", "name")


@plan(f"WITH {STEPS} SELECT user_id, count(*) AS calls, count(*) - count(DISTINCT (tool, k)) AS repeated FROM st GROUP BY 1")
def repeated_calls(spark, sf_dir):
    return tr.repeated_calls(steps(spark, sf_dir), "user_id", "step", ["tool", "k"])


@plan(f"WITH {STEPS} SELECT user_id, arg_max(CASE WHEN tool = 'purchase' THEN value END, CASE WHEN tool = 'purchase' THEN step END) AS last FROM st GROUP BY 1")
def last_submission(spark, sf_dir):
    return tr.last_of(steps(spark, sf_dir), "user_id", "step", "purchase", "value")


@plan("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 3 = 0 AS leaks, event_id % 4 <> 0 AS parsed FROM events")
def json_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    prompt = F.concat(F.lit('{"query": "x"'), F.when(F.col("event_id") % 3 == 0, F.lit(', "target_segments": []')).otherwise(F.lit("")), F.lit("}"))
    said = F.when(F.col("event_id") % 4 == 0, F.lit("no call")).otherwise(F.concat(F.lit('Call: {"tool": "inspect", "arguments": '), "props", F.lit("} done")))
    call = tx.tool_call(said)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), tx.leaks_labels(prompt).alias("leaks"), call.isNotNull().alias("parsed"))


@plan("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS j FROM events""")
def sorted_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.to_json(F.struct(*[F.col(c) for c in sorted(["user_id", "event_type", "event_id"])])).alias("j"))


@plan("""SELECT o_orderkey AS qid, (rint_ms) AS start_ms, rint_ms + 2000 AS end_ms, CASE WHEN o_orderkey % 2 = 0 THEN 'multi' ELSE 'single' END AS task_type, CASE WHEN o_orderkey % 2 = 0 THEN '3,5' ELSE '5' END AS clips
FROM (SELECT o_orderkey, (o_orderkey % 100) * 1000 AS rint_ms FROM orders WHERE o_orderkey % 5 <> 0)""")
def annotation_registry(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") % 100).cast("double")
    one = F.array(start, start + 2)
    raw = o.select(
        F.col("o_orderkey").alias("qid"), F.lit("Find the Red car").alias("query"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<array<double>>")).when(F.col("o_orderkey") % 2 == 0, F.array(one, one)).otherwise(F.array(one)).alias("windows"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(5), F.lit(3), F.lit(5))).otherwise(F.array(F.lit(5))).alias("clips"),
    )
    a = tr.annotations(raw)
    return a.select("qid", F.col("target_segments")[0]["start_ms"].alias("start_ms"), F.col("target_segments")[0]["end_ms"].alias("end_ms"), "task_type", F.array_join(F.transform("clip_ids", lambda x: x.cast("string")), ",").alias("clips"))


@plan("""SELECT 'cut_' || lpad(n::VARCHAR, 3, '0') AS task_id, 'Find the scene where someone says: "' || text[1:120] || '"' AS query, greatest(0, s - 1500) AS start_ms, s + 1700 AS end_ms
FROM (SELECT item_id AS n, text, item_id * 1000 AS s FROM benchmark)""")
def dialogue_tasks(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lit("v").alias("video_id"), F.col("item_id").alias("n"), (F.col("item_id") * 1000).alias("start_ms"), (F.col("item_id") * 1000 + 200).alias("end_ms"), "text")
    return tr.dialogue_tasks(b, "train", "cut").select("task_id", "query", "start_ms", "end_ms")


@plan("""SELECT item_id, item_id * 2000 AS start_ms, item_id * 2000 + 1500 AS end_ms, md5(trim(text)) AS digest FROM benchmark""")
def srt_round_trip(spark, sf_dir):
    one = F.regexp_replace("text", r"\n\s*\n", "\n")
    cues = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("video_id"), F.lit(0).alias("cue"), (F.col("item_id") * 2000).alias("start_ms"), (F.col("item_id") * 2000 + 1500).alias("end_ms"), one.alias("text"))
    back = sb.parse_srt(sb.render_srt(cues, ["video_id"]))
    return back.select(F.col("video_id").alias("item_id"), "start_ms", "end_ms", F.md5(F.trim("text").cast("binary")).alias("digest"))


# A user's events, twelve to an episode, as actions on ten segments.
@plan(f"""WITH {STEPS}, n AS (SELECT user_id, tool, k % 10 AS d, row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS n FROM st),
a AS (SELECT user_id || '-' || (n // 12) AS episode_id, n % 12 + 1 AS step, d, CASE tool WHEN 'view' THEN 'search_transcript' WHEN 'click' THEN 'inspect_segment' WHEN 'signup' THEN 'inspect_segment' WHEN 'purchase' THEN 'answer' ELSE 'jump' END AS tool FROM n),
o AS (SELECT *, min(CASE WHEN tool = 'answer' THEN step END) OVER (PARTITION BY episode_id) AS over, row_number() OVER (PARTITION BY episode_id, tool, d ORDER BY step) > 1 AS again,
count(DISTINCT CASE WHEN tool = 'inspect_segment' AND d IN (1, 2) THEN d END) OVER (PARTITION BY episode_id ORDER BY step) = 2 AS ready FROM a)
SELECT episode_id, step, tool, tool = 'answer' OR step = 12 AS done, round(CASE tool WHEN 'answer' THEN CASE WHEN ready THEN 1.0 ELSE -0.5 END WHEN 'jump' THEN -0.2
WHEN 'search_transcript' THEN -0.05 + CASE WHEN d IN (1, 2) THEN 0.1 * 2 / 3 ELSE 0 END ELSE -0.05 + CASE WHEN again THEN -0.1 WHEN d IN (1, 2) THEN 0.2 ELSE 0 END END + CASE WHEN step = 12 AND tool <> 'answer' THEN -0.2 ELSE 0 END, 6) AS reward
FROM o WHERE step <= coalesce(over, 12)""")
def episode_replays(spark, sf_dir):
    """Synthetic episodes; each has ten segments, two of which are its targets."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "search_transcript", "click", "inspect_segment", "signup", "inspect_segment", "purchase", "answer", "error", "jump")]), F.col("tool"))
    digit = (F.col("k") % 10).cast("string")
    a = steps(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("step")) - 1)
    episode = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("n") / 12).cast("string"))
    calls = a.select(episode.alias("episode_id"), (F.col("n") % 12 + 1).cast("long").alias("step"), kind.alias("tool"), F.concat(F.lit("car "), digit).alias("query"), F.concat(F.lit("s"), digit).alias("segment_id"), F.array(F.lit("s1"), F.lit("s2")).alias("segment_ids"))
    i = F.explode(F.sequence(F.lit(0), F.lit(9)))
    segments = calls.select("episode_id").distinct().select("episode_id", i.alias("i")).select("episode_id", F.concat(F.lit("s"), F.col("i")).alias("segment_id"), F.concat(F.lit("red car "), F.col("i")).alias("text"), F.col("i").isin(1, 2).alias("target"))
    return ep.segment_rewards(calls, segments, 12).select("episode_id", "step", "tool", "done", F.round("reward", 6).alias("reward"))


# A user's month: events are utterances, days are shots, of which every fifth has no keyframe. Purchases and errors are searched for; the
# target lies about the first of them. Users of odd number ask for an audit before they inspect. No list of actions ends with a submission.
@plan("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 - 1704067200000 AS s, epoch_us(ts) // 1000 - 1704067200000 + floor(value * 1000)::BIGINT AS e FROM events),
h AS (SELECT *, row_number() OVER w AS r, s - lag(e) OVER w > 15000 AS new FROM e WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
g AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY r) AS g FROM h),
b AS (SELECT user_id, greatest(0, arg_max(s, n)) AS lo, arg_max(e, n) AS hi FROM (SELECT user_id, g, struct_pack(n := count(*), early := -min(s)) AS n, min(s) - 2000 AS s, least(2678400000, max(e) + 2000) AS e FROM g GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT user_id, s - 3000 AS a, e + 3000 AS b FROM h WHERE r = 1),
d AS (SELECT user_id, lo, hi, a, b, greatest(0, lo // 86400000) AS d0, (hi - 1) // 86400000 AS d1 FROM b JOIN t USING (user_id)),
m AS (SELECT *, d0 + (least(d1, 30) - d0 + 1) // 2 AS mid, greatest(0, least(hi, b) - greatest(lo, a))::DOUBLE / (greatest(hi, b) - least(lo, a)) AS iou FROM d),
f AS (SELECT *, mid % 5 <> 0 AS seen FROM m)
SELECT user_id::VARCHAR AS episode_id, 1::BIGINT AS step, 'search' AS tool, -0.05 AS reward, NULL::DOUBLE AS iou FROM f
UNION ALL SELECT user_id::VARCHAR, 2, 'inspect', CASE WHEN seen THEN 0 ELSE -0.05 END, NULL FROM f WHERE user_id % 2 = 0
UNION ALL SELECT user_id::VARCHAR, 3, 'audit', CASE WHEN seen THEN 0.05 ELSE -0.05 END, NULL FROM f WHERE user_id % 2 = 0
UNION ALL SELECT user_id::VARCHAR, 2, 'audit', -0.3, NULL FROM f WHERE user_id % 2 = 1
UNION ALL SELECT user_id::VARCHAR, CASE WHEN user_id % 2 = 0 THEN 4 ELSE 3 END, 'submit', round(2 * iou + CASE WHEN user_id % 2 = 0 AND seen THEN 0.7 ELSE 0 END, 6), round(iou, 6) FROM f""")
def simple_episodes(spark, sf_dir):
    """Five-action episodes that a submission closes, of all users that have something to search for."""
    since = F.lit(1704067200000).cast("long")
    start = tc.stamp_ms(F.col("ts")) - since
    u = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").alias("utterance_id"), start.alias("start_ms"), (start + F.floor(F.col("value") * 1000)).cast("long").alias("end_ms"), F.format_string("Somebody: %s!", "event_type").alias("text"), "event_type")
    first = u.where(F.col("event_type").isin("purchase", "error")).groupBy("episode_id").agg(F.min(F.struct("start_ms", "utterance_id", "end_ms")).alias("f"))
    targets = first.select("episode_id", (F.col("f.start_ms") - 3000).alias("start_ms"), (F.col("f.end_ms") + 3000).alias("end_ms"))
    moments = ep.found_moments(u, first.select("episode_id", F.array(F.lit("purchase"), F.lit("ERROR?")).alias("terms")))
    day = first.select("episode_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30).cast("long"))).alias("d"))
    shots = day.select("episode_id", F.concat(F.lit("d"), F.col("d")).alias("shot_id"), (F.col("d") * 86_400_000).alias("start_ms"), ((F.col("d") + 1) * 86_400_000).alias("end_ms"), F.when(F.col("d") % 5 != 0, F.concat(F.lit("k"), F.col("d"))).alias("keyframe"))
    todo = F.when(F.col("episode_id").cast("long") % 2 == 0, F.array(*map(F.lit, ("search", "inspect", "audit")))).otherwise(F.array(*map(F.lit, ("search", "audit"))))
    calls = ep.closed(first.select("episode_id", F.posexplode(todo).alias("p", "tool")).select("episode_id", (F.col("p") + 1).cast("long").alias("step"), "tool"), "submit")
    out = ep.moment_rewards(calls, moments, shots, targets, 6, 2_678_400_000)
    return out.select("episode_id", "step", "tool", F.round("reward", 6).alias("reward"), F.round("iou", 6).alias("iou"))


# The team policy on the chain of each label. Its two best candidates are taken if they are near in score and place; the first one's
# surroundings are asked for if its score is low.
@plan(f"""WITH {EVID}, n AS (SELECT task_id, pos, least(1, coalesce(text_score, 0)) AS t, least(1, coalesce(visual_score, 0)) AS v, pos % 7 = 3 AS good FROM up),
x AS (SELECT *, 1 - (1 - 0.52 * t) AS f1, 1 - (1 - 0.52 * t) * (1 - 0.38 * v) AS f2 FROM n),
r1 AS (SELECT task_id, pos, good, row_number() OVER (PARTITION BY task_id ORDER BY f1 DESC, pos) AS r FROM x WHERE t > 0), r2 AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY f2 DESC, pos) AS r FROM x WHERE t > 0 OR v > 0),
rr AS (SELECT i.task_id, coalesce((SELECT 1.0 / min(r) FROM r1 WHERE r1.task_id = i.task_id AND good), 0) AS a, coalesce((SELECT 1.0 / min(r) FROM r2 WHERE r2.task_id = i.task_id AND good), 0) AS b FROM (SELECT DISTINCT task_id FROM n) i),
p AS (SELECT a.task_id, a.pos AS p0, CASE WHEN b.f2 >= 0.88 * a.f2 AND abs(a.pos - b.pos) <= 1 THEN b.pos END AS p1 FROM r2 a JOIN r2 b ON a.task_id = b.task_id AND a.r = 1 AND b.r = 2),
c AS (SELECT x.*, count(*) OVER (PARTITION BY x.task_id) AS k, least(p0, coalesce(p1, p0)) AS lead FROM x JOIN p ON p.task_id = x.task_id AND x.pos IN (p0, p1)),
w AS (SELECT task_id, max(k) AS k, bool_or(pos = lead AND f2 < 0.3) AS wide, max(CASE WHEN pos = lead THEN f2 END) AS low, max(lead) AS lead, sum(good::INT) AS hit FROM c GROUP BY 1),
au AS (SELECT c.task_id, avg(CASE WHEN wide THEN 1 - (1 - f2) * (1 - 0.1 * greatest(0.1, low) * CASE WHEN abs(c.pos - w.lead) <= 1 THEN exp(-0.7 * abs(c.pos - w.lead)) ELSE 0 END) ELSE f2 END) AS sem FROM c JOIN w USING (task_id) GROUP BY 1),
g AS (SELECT w.task_id, count(*) AS rel, sum((abs(x.pos - w.lead) <= 1)::INT) AS near FROM x JOIN w USING (task_id) WHERE good GROUP BY 1),
q AS (SELECT w.task_id, k, wide, hit, rel, hit::DOUBLE / (k + rel - hit) AS iou, CASE WHEN hit > 0 THEN 2.0 * (hit / k) * (hit / rel) / ((hit / k) + (hit / rel)) ELSE 0 END AS f1, 0.55 * sem + 0.45 AS score,
0.18 * a + 0.18 * greatest(0, b - a) + 0.12 * hit - 0.02 * (k - hit) + CASE WHEN wide THEN 0.12 * near / rel ELSE 0 END + CASE WHEN hit > 0 THEN 0.08 ELSE -0.06 END AS process FROM w JOIN rr USING (task_id) JOIN au USING (task_id) JOIN g USING (task_id))
SELECT task_id::VARCHAR AS episode_id, 4 + k + wide::INT AS step, round(iou, 4) AS iou, round(2 * iou + 0.35 * f1 + 0.3 * score + 0.2 + process - 0.025 * (3 + k + wide::INT), 4) AS reward FROM q""")
def policy_results(spark, sf_dir):
    """What the submitted intervals scored; targets are the shots of every seventh place."""
    both = checkpointed(gr.fuse(updated(spark, sf_dir).withColumns({c: F.least(F.lit(1.0), c) for c in ("text_score", "visual_score")})))
    heard = gr.fuse(both.withColumn("visual_score", F.lit(0.0)).withColumn("sources", F.array_intersect("sources", F.array(F.lit("text")))))
    shots = both.select("task_id", "pos", (F.col("pos") * 2000).alias("start_ms"), ((F.col("pos") + 1) * 2000).alias("end_ms"))
    good = shots.where("pos % 7 = 3")
    out = ep.team_results(heard, both, shots, good.select("task_id", "pos"), good.select("task_id", "start_ms", "end_ms"))
    return out.select(F.col("task_id").cast("string").alias("episode_id"), F.col("calls").alias("step"), F.round("iou", 4).alias("iou"), F.round("reward", 4).alias("reward"))


CALLS = ("search_visual", "inspect_keyframe", "expand_context", "submit", "fly")
ARGUMENTS = ('{"query": "x"}', '{"query": "x", "top_k": 3}', '{"shot_id": "a", "radius": "b"}', '{"shot_id": "a", "radius": 2}', "{}", '{"shot_ids": ["a"]}', '{"shot_id": "a"}')


@plan("""WITH c AS (SELECT event_id, event_id % 6 AS t, (event_id // 6) % 8 AS a FROM events)
SELECT event_id, CASE WHEN t = 5 OR a = 7 THEN 'parse_error' WHEN t = 4 THEN 'unknown_tool' WHEN t = 0 AND a IN (0, 1) OR t = 1 AND a = 6 OR t = 2 AND a IN (3, 6) OR t = 3 AND a = 5 THEN 'ok' ELSE 'invalid_arguments' END AS outcome FROM c""")
def dispatch_outcomes(spark, sf_dir):
    """Calls of every tool with every kind of arguments; none are null."""
    pick = lambda i, n, v: F.get(F.array(*map(F.lit, v)), (i % n).cast("int"))
    i = F.col("event_id")
    calls = table(spark, sf_dir, "events").select("event_id", pick(i, 6, CALLS).alias("tool"), pick(F.floor(i / 6), 8, ARGUMENTS).alias("arguments"))
    return ep.dispatched(calls).select("event_id", "outcome")


# Files: written to the shared folder by a sink and read back by a source.
@plan("SELECT doc_id, lang, n_chars, md5(text) AS digest FROM documents")
def jsonl_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    fs.write_jsonl(d, path := new_path(spark, "jsonl"))
    return fs.read_jsonl(spark, path, "doc_id long, lang string, n_chars long, text string").select("doc_id", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@plan("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    fs.write_csv(o, path := new_path(spark, "csv"), bom=True)
    return spark.read.csv(path, header=True, schema=o.schema)


@plan("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, max(lang) AS last FROM documents")
def report_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("lang").alias("last"))
    fs.write_report(d, path := new_path(spark, "report"))
    return fs.read_json(spark, path).select("n", "chars", "last")


@plan("SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, 'task_' || item_id AS task_id, text AS query, item_id * 1000 AS target_start_ms, item_id * 1000 + 500 AS target_end_ms, 'train' AS split FROM benchmark")
def task_file(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").orderBy("item_id")
    i = F.col("item_id")
    t = b.select(F.concat(F.lit("task_"), i.cast("string")).alias("task_id"), F.col("text").alias("query"), F.array(F.lit("a")).alias("search_terms"), (i * 1000).alias("target_start_ms"), (i * 1000 + 500).alias("target_end_ms"), F.lit("train").alias("split"))
    fs.write_report(t, path := new_path(spark, "tasks"))  # one file, in order
    return fs.load_tasks(spark, path).select(F.col("pos").cast("long").alias("pos"), "task_id", "query", "target_start_ms", "target_end_ms", "split")


@plan("SELECT 's' || l_orderkey || '-' || l_linenumber AS shot_id, round_even(l_extendedprice * 1000 / 16, 0)::BIGINT AS start_ms, round_even((l_extendedprice / 16 + 2.0625) * 1000, 0)::BIGINT AS end_ms FROM lineitem WHERE l_linenumber = 1")
def shot_file(spark, sf_dir):
    """Seconds to milliseconds, halves to even."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    at = F.col("l_extendedprice") / 16
    s = li.select(F.concat(F.lit("s"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("shot_id"), at.alias("start_s"), (at + 2.0625).alias("end_s"), (at + 1).alias("keyframe_s"), F.lit("k").alias("keyframe_path"))
    fs.write_jsonl(s, path := new_path(spark, "shots"))
    return fs.load_shots(spark, path).select("shot_id", "start_ms", "end_ms")


@plan("""SELECT event_id, role || '/' || tool AS call FROM (SELECT event_id, ['timeline', 'vision', 'auditor'][(event_id % 3)::INT + 1] AS role, ['search_visual', 'request_audit'][(event_id % 2)::INT + 1] AS tool FROM events)
WHERE (role || '/' || tool) NOT IN ('vision/search_visual', 'auditor/request_audit')""")
def role_violations(spark, sf_dir):
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    s = table(spark, sf_dir, "events").select("event_id", pick(3, "timeline", "vision", "auditor").alias("role"), pick(2, "search_visual", "request_audit").alias("tool"))
    return ep.outside_role(s).select("event_id", F.concat_ws("/", "role", "tool").alias("call"))


@plan("""SELECT d.doc_id, d.source || '/' || d.lang AS unit, CASE WHEN d.doc_id % 3 = 0 THEN 'a,b' ELSE '' END AS tags FROM documents d""")
def visual_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    units = d.select("doc_id", F.col("source").alias("video_id"), F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("shot_id"), F.concat_ws("/", "source", "lang").alias("unit"))
    tags = units.where("doc_id % 3 = 0").select(F.concat_ws(":", "video_id", "shot_id").alias("key"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return pr.with_tags(units, tags).select("doc_id", "unit", F.array_join("tags", ",").alias("tags"))


@plan("SELECT doc_id AS task_id, source AS video_id, lang AS query, max(doc_id % 50 = 7) OVER (PARTITION BY source) AS video_has_dialogue, 10 AS tool_budget FROM documents")
def public_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.col("source").alias("video_id"), F.col("lang").alias("query"), "n_chars")
    return pr.public_prompt(d, d.select("video_id", (F.col("task_id") % 50 == 7).alias("has_dialogue")))


@plan("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN coalesce(max(CASE WHEN event_type = 'purchase' THEN value END), -1) ELSE -1 END AS reward FROM events GROUP BY 1")
def final_rewards(spark, sf_dir):
    s = steps(spark, sf_dir)
    e = s.groupBy(F.col("user_id").alias("episode_id")).agg(F.bool_or(F.col("tool") == "purchase").alias("done"), F.max(F.when(F.col("tool") == "purchase", F.col("value"))).alias("reward"))
    return pr.final_rewards(e).select(F.col("episode_id").alias("user_id"), "reward")


@plan("""WITH k AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_quantity) AS s, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey AS task_id, unnest(s[2:]) AS shot_id, unnest(q[2:]) AS score FROM k""")
def saliency_rows(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("s"))
    rest = F.slice("s", 2, F.greatest(F.lit(0), F.size("s") - 1))
    t = k.select("task_id", F.transform(rest, lambda x: x["l_linenumber"]).alias("shot_ids"), F.transform(rest, lambda x: F.array(x["l_quantity"])).alias("saliency_scores"))
    return pr.saliency_rows(t).select("task_id", "shot_id", F.col("scores")[0].alias("score"))
