"""Subtitles, logs, packages and manifests on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as au
from ..operators import prompts as pr
from ..operators import registry as rg
from ..session import new_path
from ..sources import files as fs
from ..sources import subtitles as sb
from .tables import table

QUERIES, ORACLE = {}, {}


def plan(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, sql
        return fn

    return add


@plan("SELECT user_id AS video, event_id + 0.25::DOUBLE AS time_s, event_id % 1000 / 1000 AS score FROM events")
def log_transitions(spark, sf_dir):
    """Each event is three lines of its user's log: a time, a score, and one that says nothing."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    said = [F.concat(F.lit("frame:1 pts_time:"), i.cast("string"), F.lit(".25")), F.concat(F.lit("lavfi.scene_score="), F.format_string("%.3f", i % 1000 / 1000)), F.lit("size= 1kB")]
    log = e.select(F.col("user_id").alias("video"), F.posexplode(F.array(*said)).alias("k", "line"), i.alias("i")).select("video", "line", (F.col("i") * 3 + F.col("k")).alias("n"))
    return sb.transitions(log, ["video"])


@plan("""WITH c AS (SELECT item_id % 5 AS video_id, item_id, greatest(item_id * 700 - 4000, 0) AS s, least(item_id * 700 + 900 - 4000, 20500) AS e, text FROM benchmark WHERE item_id * 700 + 900 > 4000 AND item_id * 700 < 24500),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_id) AS n FROM c)
SELECT video_id, md5(string_agg(n || chr(10) || '00:00:' || lpad((s // 1000)::VARCHAR, 2, '0') || ',' || lpad((s % 1000)::VARCHAR, 3, '0') || ' --> 00:00:' || lpad((e // 1000)::VARCHAR, 2, '0') || ',' || lpad((e % 1000)::VARCHAR, 3, '0') || chr(10) || text || chr(10), chr(10) ORDER BY n)) AS digest FROM n GROUP BY 1""")
def subtitle_clips(spark, sf_dir):
    """Of each video the cues from second 4 to 24.5."""
    i = F.col("item_id")
    cues = table(spark, sf_dir, "benchmark").select((i % 5).alias("video_id"), i.alias("cue"), (i * 700).alias("start_ms"), (i * 700 + 900).alias("end_ms"), "text")
    return sb.clip_srt(cues, ["video_id"], 4.0, 20.5).select("video_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@plan("""WITH p AS (SELECT 600000 + p_partkey % 250 - 125 AS ms, p_size % 3 AS v, 1 + p_partkey % 2 AS a, upper(sha256(p_brand)) AS h, upper(sha256(CASE WHEN p_size > 25 THEN p_type ELSE p_brand END)) AS w FROM part)
SELECT 'media_duration_matches' AS name, abs(ms - 600000) <= 100 AS passed, ms::VARCHAR AS details FROM p UNION ALL SELECT 'media_stream_layout', v = 1 AND a = 1, v || '/' || a FROM p UNION ALL SELECT 'media_hashes_match', h = w, h FROM p""")
def container_audit(spark, sf_dir):
    digest = lambda c: F.upper(F.sha2(c.cast("binary"), 256))
    p = table(spark, sf_dir, "part").select(
        (600_000 + F.col("p_partkey") % 250 - 125).alias("duration_ms"), (F.col("p_size") % 3).alias("video_streams"), (1 + F.col("p_partkey") % 2).alias("audio_streams"),
        digest(F.col("p_brand")).alias("sha256"), digest(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand"))).alias("expected_sha256"),
    )
    return au.container_checks(p, 600_000)


@plan("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_assets(spark, sf_dir):
    return au.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


MANIFEST_SCHEMA = {
    "type": "object", "required": ["dataset_id", "capacity", "tasks"],
    "properties": {"capacity": {"type": "object", "required": ["hard_limit_bytes"], "properties": {"hard_limit_bytes": {"type": "integer", "minimum": 1}}}, "tasks": {"type": "object", "properties": {"count": {"type": "integer"}}}},
}
TASK_SCHEMA = {
    "type": "object", "required": ["task_id", "video_id", "split"],
    "properties": {"task_id": {"type": ["integer", "string"]}, "video_id": {"type": "string", "minLength": 1}, "split": {"enum": ["train", "val", "test", "smoke"]}, "query": {"type": "string", "pattern": "[^ ]"}},
}


@plan("""WITH f AS (SELECT doc_id, source, strlen(text) AS b FROM documents), t AS (SELECT o_orderkey % 7 + 1 AS n, o_custkey AS v, o_orderkey % 50 + 1 AS q FROM orders),
e AS (SELECT sum((doc_id % 41 = 0)::INT + (doc_id % 41 <> 0 AND doc_id % 43 = 0)::INT) AS p, sum((doc_id % 41 <> 0 AND doc_id % 47 = 0)::INT) AS h FROM f),
r AS (SELECT sum(CASE WHEN v % 50 = 0 THEN 1 ELSE (n = 7)::INT + (q = 1)::INT + (q > 45)::INT + (n = 6)::INT END) AS e FROM t),
l AS (SELECT count(*) AS n FROM (SELECT v FROM t WHERE n IN (1, 2, 3) GROUP BY v HAVING count(DISTINCT n) > 1))
SELECT 'offline_package_capacity' AS name, sum(b) <= 1000000000 AS passed, sum(b)::BIGINT::VARCHAR AS details FROM f WHERE doc_id % 41 <> 0 UNION ALL SELECT 'artifact_paths_and_sizes', p = 0, p::VARCHAR FROM e UNION ALL SELECT 'artifact_hashes', h = 0, h::VARCHAR FROM e
UNION ALL SELECT 'task_schema_and_ranges', e = 0 AND n = 0, e::VARCHAR FROM r, l UNION ALL SELECT 'video_level_split_isolation', n = 0, n::VARCHAR FROM l UNION ALL SELECT 'task_count', count(*) = 1000, count(*)::VARCHAR FROM t UNION ALL SELECT 'task_json_schema', false, sum((n = 7)::INT + (q = 1)::INT + (v % 3 = 0)::INT)::BIGINT::VARCHAR FROM t UNION ALL SELECT 'manifest_json_schema', false, '2'""")
def manifest_audit(spark, sf_dir):
    """Files are documents, of which some are not there, have another size or another hash; tasks are orders, with faults of each kind."""
    i, digest = F.col("doc_id"), F.upper(F.sha2(F.col("text").cast("binary"), 256))
    d = table(spark, sf_dir, "documents").select(i, F.concat_ws("/", "source", i.cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), digest.alias("sha256"))
    want = d.select("path", (F.col("bytes") + (i % 43 == 0).cast("int")).alias("bytes"), F.when(i % 47 == 0, "0").otherwise(F.lower("sha256")).alias("sha256"))
    n, q = F.col("o_orderkey") % 7 + 1, F.col("o_orderkey") % 50 + 1
    split = F.when(n == 7, "dev").when(n == 1, "train").when(n == 2, "val").when(n == 3, "test").otherwise("smoke")
    t = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("video_id"), split.alias("split"), F.when(q == 1, " ").otherwise("q").alias("query"),
        F.array(F.struct(F.lit(0).cast("long").alias("start_ms"), q.alias("end_ms"))).alias("target_segments"), F.when(n != 6, F.array(F.lit("s"))).alias("shot_ids"),
    )
    videos = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("video_id"), F.lit(45).cast("long").alias("duration_ms"))
    # Tasks as texts: a third names its video by a number, not a name. The manifest has neither a name nor a whole number of tasks.
    named = F.when(F.col("video_id") % 3 == 0, F.format_string('%d', "video_id")).otherwise(F.format_string('"%d"', "video_id"))
    texts = t.select("task_id", F.format_string('{"task_id": %d, "video_id": %s, "split": "%s", "query": "%s"}', "task_id", named, "split", "query").alias("text"))
    manifest = t.agg(F.format_string('{"capacity": {"hard_limit_bytes": 1e9}, "tasks": {"count": %d.5}}', F.count("*")).alias("text")).withColumn("key", F.lit("manifest"))
    schemas = {"manifest_json_schema": au.json_errors(manifest, "key", "text", MANIFEST_SCHEMA), "task_json_schema": au.json_errors(texts, "task_id", "text", TASK_SCHEMA)}
    return au.manifest_checks(want, d.where(i % 41 != 0).select("path", "bytes", "sha256"), t, videos, 1_000_000_000, 1000, schemas=schemas)


@plan("SELECT o_orderkey AS task_id, o_custkey AS video_id, o_orderkey / 8 AS start_s, (o_custkey + 500) / 1000 AS length_s FROM orders WHERE o_orderstatus = 'F'")
def cut_points(spark, sf_dir):
    k = F.col("o_orderkey") * 125
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("video_id"), (F.col("o_orderstatus") == "F").alias("success"), k.alias("predicted_start_ms"), (k + F.col("o_custkey") + 500).alias("predicted_end_ms"))
    return fs.cut_list(o)


@plan("SELECT o_orderkey AS task_id, o_totalprice AS reward FROM orders")
def public_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_totalprice").alias("reward"), F.struct("o_orderstatus", "o_custkey").alias("reward_parts"))
    return pr.without_rewards(o)


@plan("""WITH p AS (SELECT source || CASE WHEN doc_id % 7 = 0 THEN '/tmp/' ELSE '/' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PYC' WHEN 1 THEN '.py' ELSE '.md' END AS path, source FROM documents)
SELECT path FROM p WHERE (source IN ('src0', 'src1') OR path IN ('src7/27.PYC', 'src8/8.md')) AND NOT contains(path, '/tmp/') AND NOT suffix(path, '.PYC')""")
def package_files(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.when(i % 7 == 0, "/tmp/").otherwise("/"), i.cast("string"), F.when(i % 3 == 0, ".PYC").when(i % 3 == 1, ".py").otherwise(".md")).alias("path"))
    return fs.package_selection(d, ["src0", "src1/"], ["src7/27.PYC", "src8/8.md"], skip_suffixes=(".pyc",))


@plan("SELECT count(*) AS files, sum(strlen(n_name) + 1)::BIGINT AS bytes, upper(sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey))) AS sha256 FROM nation GROUP BY n_regionkey")
def file_hashes(spark, sf_dir):
    """A text file for each region, a line a nation; files counts its lines."""
    n = table(spark, sf_dir, "nation")
    path = new_path(spark, "nations")
    n.select("n_regionkey", "n_nationkey", F.col("n_name").alias("value")).repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").select("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    lines = spark.read.text(path).groupBy(F.input_file_name().alias("at")).agg(F.count("*").alias("files"))
    return fs.hashes(spark, path).join(lines, F.regexp_extract("path", "[^/]+/[^/]+$", 0) == F.regexp_extract("at", "[^/]+/[^/]+$", 0)).select("files", "bytes", "sha256")


@plan("""WITH t AS (SELECT c_custkey % 97 AS v, CASE c_custkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS s FROM customer), p AS (SELECT DISTINCT v, s FROM t)
SELECT s AS split, count(*) AS tasks, count(DISTINCT v) AS videos, (SELECT count(DISTINCT v) FROM t) AS all_videos, (SELECT string_agg(pair || '=' || n, ',' ORDER BY pair) FROM (SELECT a.s || '/' || b.s AS pair, count(*) AS n FROM p a JOIN p b ON a.v = b.v AND a.s < b.s GROUP BY 1)) AS shared FROM t GROUP BY 1""")
def registry_summary(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select((k % 97).alias("video_id"), F.when(k % 3 == 0, "test").when(k % 3 == 1, "train").otherwise("val").alias("split"))
    said = F.array_join(F.transform(F.map_entries("shared"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rg.registry_report(t).select(F.explode("splits").alias("split", "s"), F.col("videos").alias("all_videos"), said.alias("shared")).select("split", "s.tasks", "s.videos", "all_videos", "shared")


@plan("""WITH s AS (SELECT o_custkey AS v, o_orderkey AS k, o_orderkey * 1000 AS a, o_orderkey * 1000 + 1000 AS e FROM orders),
c AS (SELECT v, k, greatest(0, a + 200 - 1500) AS a, a + 700 + 1500 AS e FROM s), h AS (SELECT c.v, c.k, string_agg('s' || s.k, ',' ORDER BY s.a) AS shots FROM c JOIN s ON s.v = c.v AND s.a < c.e AND s.e > c.a GROUP BY 1, 2)
SELECT v::VARCHAR AS video_id, 'v_' || lpad((row_number() OVER (PARTITION BY v ORDER BY k))::VARCHAR, 3, '0') AS task_id, 'Find the scene where someone says: "many words of order ' || k || '"' AS query, a AS start_ms, e AS end_ms, shots FROM c JOIN h USING (v, k)""")
def dialogue_registry(spark, sf_dir):
    """A registry of tasks from each customer's orders as utterances, with the shots that they touch."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    video, name = F.col("o_custkey").cast("string").alias("video_id"), k.cast("string")
    said = o.select(video, name.alias("utterance_id"), (k * 1000 + 200).alias("start_ms"), (k * 1000 + 700).alias("end_ms"), F.concat(F.lit("many words of order "), name).alias("text"))
    units = o.select(video, F.concat(F.lit("s"), name).alias("shot_id"), (k * 1000).alias("start_ms"), (k * 1000 + 1000).alias("end_ms"))
    t = rg.dialogue_registry(said, units, "train", "v")
    return t.select("video_id", "task_id", "query", "start_ms", "end_ms", F.array_join("shot_ids", ",").alias("shots"))
