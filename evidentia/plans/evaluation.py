"""Metrics, samples, sets and audits on the orders, lineitem, documents and labels tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audits as au
from ..operators import intervals as iv
from ..operators import metrics as mx
from ..operators import prompts as pr
from ..operators import sampling as sp
from ..operators import training as tr
from ..session import checkpointed
from ..sources import files as fs
from .tables import table

QUERIES, ORACLE = {}, {}


def plan(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


SHARE = "li AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_quantity, l_quantity / 50 AS iou FROM lineitem)"


def shares(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("iou", F.col("l_quantity") / 50)


@plan(f"WITH {SHARE} SELECT l_returnflag, count(*) AS n, round_even(avg(iou), 6) AS mean_iou, round_even(avg((iou >= 0.3)::INT), 6) AS r1_30, round_even(avg((iou >= 0.5)::INT), 6) AS r1_50, round_even(avg((iou >= 0.7)::INT), 6) AS r1_70 FROM li GROUP BY 1")
def retrieval_metrics(spark, sf_dir):
    return mx.retrieval_metrics(shares(spark, sf_dir), ["l_returnflag"])


@plan("SELECT lang, source, count(*) AS n, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, round(avg(n_chars), 2) AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def policy_split_means(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    m = mx.grouped_means(d, ["lang", "source"], {"quality": 6, "toxic": 6, "n_chars": 6})
    return m.select("lang", "source", "n", F.round("quality", 4).alias("quality"), F.round("toxic", 4).alias("toxic"), F.round("n_chars", 2).alias("n_chars"))


@plan("SELECT o_orderstatus, count(*) AS n, round_even(avg((o_totalprice > 150000)::INT), 6) AS big, round_even(avg(o_totalprice), 6) AS price FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus))")
def overall_and_by_status(spark, sf_dir):
    return mx.overall_and_by(table(spark, sf_dir, "orders"), "o_orderstatus", {"big": F.col("o_totalprice") > 150000, "price": F.col("o_totalprice")})


@plan("SELECT l_linestatus, round(sum((l_discount > 0.05)::INT)::DOUBLE / greatest(1, sum(l_linenumber) + sum((l_discount > 0.05)::INT)), 9) AS rate FROM lineitem GROUP BY 1")
def ratio_of_sums(spark, sf_dir):
    bad = (F.col("l_discount") > 0.05).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(mx.ratio_of_sums(bad, F.col("l_linenumber") + bad), 9).alias("rate"))


@plan("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def merged_shards(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = [o.where(F.pmod("o_orderkey", F.lit(4)) == i) for i in range(4)]
    return mx.merge_shards(parts, "o_orderkey").groupBy("o_orderpriority").agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-6), 5) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def advantage_zscore(spark, sf_dir):
    a = mx.advantages(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")
    return a.select("l_orderkey", "l_linenumber", F.round("advantage", 5).alias("advantage"))


SETS = """fs AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey % 20)) AS f, list_distinct(list(l_partkey % 20)) AS t FROM lineitem GROUP BY 1),
h AS (SELECT *, len(list_intersect(f, t)) AS h FROM fs), pr AS (SELECT *, h::DOUBLE / greatest(1, len(f)) AS p, h::DOUBLE / greatest(1, len(t)) AS r FROM h)"""


@plan(f"WITH {SETS} SELECT k, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(2 * p * r / greatest(1e-8, p + r), 6) AS f1_floor FROM pr")
def set_prf1(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_suppkey") % 20).alias("f"), F.collect_list(F.col("l_partkey") % 20).alias("t"))
    p, r, f1, low = mx.set_scores(F.col("f"), F.col("t"))
    return s.select("k", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"), F.round(low, 6).alias("f1_floor"))


@plan("""WITH a AS (SELECT l_orderkey AS k, l_suppkey % 5 AS id, avg(l_quantity) / 4 AS m FROM lineitem GROUP BY 1, 2)
SELECT k, round((coalesce(max(CASE WHEN id = 0 THEN m END), 0) + coalesce(max(CASE WHEN id = 1 THEN m END), 0) + coalesce(max(CASE WHEN id = 9 THEN m END), 0)) / 3, 6) AS saliency FROM a GROUP BY k""")
def saliency_quality(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).cast("string").alias("id")).agg(F.collect_list("l_quantity").alias("q"))
    m = each.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("id", "q"))).alias("m"))
    return m.select("k", F.round(mx.saliency(F.col("m"), F.array(*map(F.lit, "019"))), 6).alias("saliency"))


@plan("SELECT text AS text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return au.duplicates(table(spark, sf_dir, "documents"), "text")


# A text is a video, its sources' numbers decide the split.
TASKS = "ta AS (SELECT doc_id AS task_id, md5(text) AS video_id, CASE WHEN replace(source, 'src', '')::INT < 14 THEN 'train' WHEN replace(source, 'src', '')::INT < 17 THEN 'val' WHEN replace(source, 'src', '')::INT < 19 THEN 'test' ELSE 'smoke' END AS split FROM documents)"


def tasks(spark, sf_dir):
    n = F.replace(F.col("source"), F.lit("src"), F.lit("")).cast("int")
    split = F.when(n < 14, "train").when(n < 17, "val").when(n < 19, "test").otherwise("smoke")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.md5(F.col("text").cast("binary")).alias("video_id"), split.alias("split"), F.col("lang").alias("query"), "n_chars")


@plan(f"WITH {TASKS} SELECT video_id, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits FROM ta WHERE split <> 'smoke' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    return au.split_leaks(tasks(spark, sf_dir)).select("video_id", F.array_join("splits", ",").alias("splits"))


@plan(f"WITH {TASKS} SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.video_id) AS videos FROM ta a JOIN ta b ON a.video_id = b.video_id AND a.split < b.split GROUP BY 1, 2")
def split_pairs(spark, sf_dir):
    t = tasks(spark, sf_dir).select("video_id", "split").distinct()
    a, b = t.withColumnRenamed("split", "split_a"), t.withColumnRenamed("split", "split_b")
    return a.join(b, "video_id").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("videos"))


@plan(f"WITH {TASKS} SELECT split, count(*) AS tasks, count(DISTINCT video_id) AS videos FROM ta GROUP BY 1")
def split_counts(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("split").agg(F.count("*").alias("tasks"), F.count_distinct("video_id").alias("videos"))


@plan(f"""WITH {TASKS}, x AS (SELECT t.*, d.lang, d.n_chars, v.n AS dur FROM ta t JOIN documents d ON d.doc_id = t.task_id LEFT JOIN (SELECT md5(text) AS video_id, min(n_chars) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1) v USING (video_id))
SELECT task_id, 'unknown video_id' AS error FROM x WHERE dur IS NULL UNION ALL SELECT task_id, 'invalid target' FROM x WHERE dur IS NOT NULL AND NOT (0 <= task_id % 700 AND task_id % 700 < 700 AND 700 <= dur)
UNION ALL SELECT task_id, 'no grounded shot evidence' FROM x WHERE dur IS NOT NULL AND task_id % 11 = 0""")
def task_audit(spark, sf_dir):
    t = tasks(spark, sf_dir)
    t = t.withColumns({"target_segments": F.array(F.struct((F.col("task_id") % 700).alias("start_ms"), F.lit(700).cast("long").alias("end_ms"))), "shot_ids": F.when(F.col("task_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("shot_0001")))})
    videos = t.where("task_id % 5 <> 0").groupBy("video_id").agg(F.min("n_chars").alias("duration_ms"))
    return au.task_errors(t, videos)


@plan("SELECT doc_id::VARCHAR AS path, 'missing' AS error FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id::VARCHAR, 'size mismatch' FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 17 = 0 UNION ALL SELECT doc_id::VARCHAR, 'sha256 mismatch' FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 19 = 0")
def artifact_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("bytes"), F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"))
    there = d.where("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 17 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("doc_id") % 19 == 0, F.lit("00")).otherwise(F.lower("sha256")).alias("sha256"))
    return au.artifact_errors(d.drop("doc_id"), there)


@plan("SELECT source AS top, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def package_inventory(spark, sf_dir):
    return fs.inventory(table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes")))


@plan("SELECT lang, upper(sha256(string_agg(doc_id::VARCHAR || ':' || upper(sha256(text)), '|' ORDER BY doc_id))) AS sha256 FROM documents GROUP BY lang")
def ordered_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.upper(F.sha2(F.col("text").cast("binary"), 256))).alias("p"))
    return fs.ordered_digest(d, ["lang"], "doc_id", F.col("p").cast("binary"), b"|").select("lang", "sha256")


@plan("SELECT upper(sha256(unhex(string_agg(hex(lpad(doc_id::VARCHAR, 9, '0')) || sha256(text), '' ORDER BY doc_id)))) AS sha256, count(*) AS files FROM documents")
def combined_hash(spark, sf_dir):
    return fs.combined_hash(table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 30")
def first_rows(spark, sf_dir):
    return sp.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 30)


@plan("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY l_returnflag) // 15) AS step FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE rn % step = 0 AND rn // step < 15""")
def systematic_sample(spark, sf_dir):
    return sp.systematic(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 15, ["l_returnflag"])


@plan("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '/42'), o_orderkey LIMIT 100")
def hash_sample(spark, sf_dir):
    return sp.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@plan("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn % 24 = 5")
def modulo_shard(spark, sf_dir):
    return sp.shard(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5, 24)


@plan("SELECT CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR || '/42'), 1, 8))::BIGINT % 100 < 20 THEN 'formal' ELSE 'benchmark' END AS source, count(*) AS n FROM orders GROUP BY 1")
def source_mixture(spark, sf_dir):
    return sp.mixture(table(spark, sf_dir, "orders"), "o_orderkey", 20).groupBy("source").agg(F.count("*").alias("n"))


@plan("SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("kind", "nation").agg(F.count("*").alias("n"))


@plan("SELECT quality, copy, count(*) AS n FROM (SELECT quality, unnest(generate_series(1, CASE quality WHEN 1 THEN 5 ELSE 2 END)) AS copy FROM labels) GROUP BY 1, 2")
def oversampled_mix(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return tr.mixed([(lab.where("quality = 1"), 5), (lab.where("quality = 0"), 2)]).groupBy("quality", F.col("copy").cast("long").alias("copy")).agg(F.count("*").alias("n"))


REQUESTS = "('0x' || substr(md5(o_orderkey::VARCHAR || '/42'), 1, 8))::BIGINT % 100 AS b, ('0x' || substr(md5(o_orderkey::VARCHAR || '/43'), 1, 8))::BIGINT % 2147483648 AS d"


@plan(f"""WITH r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 500 END AS named, {REQUESTS} FROM orders),
f AS (SELECT s_suppkey AS task_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS at, count(*) OVER () AS n FROM supplier), c AS (SELECT c_custkey + 1000000 AS task_id, row_number() OVER (ORDER BY c_custkey) - 1 AS at, count(*) OVER () AS n FROM customer)
SELECT request_id, task_id, 'formal' AS source FROM r JOIN f ON named = task_id UNION ALL SELECT request_id, task_id, 'benchmark' FROM r JOIN c ON named = task_id
UNION ALL SELECT request_id, task_id, 'formal' FROM r JOIN f ON named IS NULL AND b < 20 AND d % f.n = f.at UNION ALL SELECT request_id, task_id, 'benchmark' FROM r JOIN c ON named IS NULL AND b >= 20 AND d % c.n = c.at""")
def chosen_tasks(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 500).alias("task_id"))
    formal, other = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id")), table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("task_id"))
    return sp.chosen_tasks(requests, [("formal", formal, 20), ("benchmark", other, 80)])


@plan("""WITH r AS (SELECT l_returnflag AS method, l_linestatus, l_quantity / 50 AS iou, l_linenumber AS calls, (l_tax > 0.04)::INT AS e, (l_discount > 0.05)::INT AS a, (l_tax > 0.04 AND l_discount > 0.05)::INT AS s FROM lineitem),
x AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT 'eval', * FROM r WHERE l_linestatus = 'O')
SELECT scope, method, count(*) AS task_count, round(avg(iou), 6) AS mean_temporal_iou, round(avg((iou >= 0.5)::INT), 6) AS temporal_success_rate_iou_0_5, round(avg(e), 6) AS evidence_support_rate, round(avg(a), 6) AS audit_pass_rate, round(avg(s), 6) AS business_success_rate, round(avg(calls), 6) AS avg_tool_calls FROM x GROUP BY 1, 2""")
def evaluation_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e, a = F.col("l_tax") > 0.04, F.col("l_discount") > 0.05
    split = F.when(F.col("l_linestatus") == "O", "eval").otherwise("train")
    r = li.select(F.col("l_returnflag").alias("method"), split.alias("split"), (F.col("l_quantity") / 50).alias("temporal_iou"), F.col("l_linenumber").alias("tool_calls"), e.alias("evidence_supported"), a.alias("audit_passed"), F.when(e & a, True).alias("success"))
    s = mx.evaluation_summary(r)
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes])


#: What a task's JSON must be like.
TASK_SCHEMA = {
    "type": "object", "required": ["schema_version", "task_id", "split", "query", "target_segments"],
    "properties": {
        "schema_version": {"const": "task.v1"}, "task_id": {"type": "string", "minLength": 1}, "split": {"enum": ["smoke", "train", "val", "test"]}, "query": {"type": "string", "minLength": 1, "pattern": "^[a-z]*$"},
        "target_segments": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["start_ms", "end_ms"], "properties": {"start_ms": {"type": "integer", "minimum": 0}, "end_ms": {"type": "integer", "minimum": 1, "maximum": 900}}}},
    },
}


@plan("""WITH d AS (SELECT doc_id AS id, lang FROM documents)
SELECT id, 'not JSON' AS error FROM d WHERE id % 31 = 0
UNION ALL SELECT id, '$.schema_version: is not task.v1' FROM d WHERE id % 31 <> 0 AND id % 5 = 0
UNION ALL SELECT id, '$: task_id is a required property' FROM d WHERE id % 31 <> 0 AND id % 7 = 0
UNION ALL SELECT id, '$.split: is not one of its values' FROM d WHERE id % 31 <> 0 AND lang = 'es'
UNION ALL SELECT id, '$.query: is not of type string' FROM d WHERE id % 31 <> 0 AND id % 11 = 0
UNION ALL SELECT id, '$.query: is too short' FROM d WHERE id % 31 <> 0 AND id % 11 = 1
UNION ALL SELECT id, '$.query: does not match its pattern' FROM d WHERE id % 31 <> 0 AND id % 11 = 2
UNION ALL SELECT id, '$.target_segments: has too few items' FROM d WHERE id % 31 <> 0 AND id % 13 = 0
UNION ALL SELECT id, '$.target_segments[].start_ms: is less than 0' FROM d WHERE id % 31 <> 0 AND id % 13 NOT IN (0, 1) AND id % 100 < 3
UNION ALL SELECT id, '$.target_segments[].end_ms: is greater than 900' FROM d WHERE id % 31 <> 0 AND id % 13 NOT IN (0, 1) AND id % 1000 > 900
UNION ALL SELECT id, '$.target_segments[]: end_ms is a required property' FROM d WHERE id % 31 <> 0 AND id % 13 = 1""")
def task_schema_audit(spark, sf_dir):
    i, q = F.col("doc_id"), lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    split = F.when(F.col("lang") == "es", "dev").otherwise("train")
    query = F.when(i % 11 == 0, F.lit("17")).when(i % 11 == 1, F.lit('""')).when(i % 11 == 2, F.lit('"Two words"')).otherwise(q(F.lit("word")))
    one = F.format_string('{"start_ms": %d, "end_ms": %d}', i % 100 - 3, F.greatest(F.lit(1), i % 1000))
    segments = F.when(i % 13 == 0, F.lit("[]")).when(i % 13 == 1, F.lit('[{"start_ms": 5}]')).otherwise(F.concat(F.lit("["), one, F.lit(', {"start_ms": 1, "end_ms": 2}]')))
    text = F.concat(
        F.lit('{"schema_version": '), F.when(i % 5 == 0, F.lit("2")).otherwise(F.lit('"task.v1"')), F.when(i % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(', "task_id": '), q(i.cast("string")))),
        F.lit(', "split": '), q(split), F.lit(', "query": '), query, F.lit(', "target_segments": '), segments, F.lit("}"),
    )
    return au.json_errors(table(spark, sf_dir, "documents").select(i.alias("id"), F.when(i % 31 == 0, F.lit("{broken")).otherwise(text).alias("json")), "id", "json", TASK_SCHEMA)


@plan("SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY 1")
def success_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").where("toxic = 0")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"), F.round(F.avg("quality"), 6).alias("rate"))


@plan("""WITH s AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey % 9)) AS a, list_distinct(list(l_partkey % 9)) AS b FROM lineitem GROUP BY 1)
SELECT k, len(list_intersect(a, b)) AS both, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, len(list_distinct(list_concat(a, b))) AS any, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM s""")
def set_operations(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_suppkey") % 9).alias("a"), F.collect_set(F.col("l_partkey") % 9).alias("b"))
    n = lambda c: F.size(c).cast("long")
    return s.select("k", n(F.array_intersect("a", "b")).alias("both"), n(F.array_except("a", "b")).alias("only_a"), n(F.array_union("a", "b")).alias("any"), pr.contained("a", "b").alias("subset"))


@plan("""WITH f AS (SELECT l_orderkey AS k, l_suppkey % 4 AS v, min(l_linenumber) AS i FROM lineitem GROUP BY 1, 2)
SELECT k, string_agg(v::VARCHAR, ',' ORDER BY i, v) AS firsts, list_extract(list(v ORDER BY i, v), len(list(v)) // 2 + 1) AS middle FROM f GROUP BY k""")
def distinct_in_order(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 4).alias("v")))).alias("s"))
    s = s.select("k", F.array_distinct(F.transform("s", lambda x: x["v"])).alias("d"))
    return s.select("k", F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("firsts"), F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")).alias("middle"))


@plan("SELECT doc_id, 'lang is not one of its values' AS error FROM documents WHERE lang NOT IN ('en', 'de', 'fr')")
def schema_audit(spark, sf_dir):
    return au.schema_errors(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "text", "source"], {"lang": ("en", "de", "fr")})


#: Positions that a task of media_audit begins with.
MEDIA_ROWS = 1 << 17

# A shot a second for each order, an utterance over every third; "sound" is as it should be, every other variant has one fault, in the
# rows of some orders. A check's details are counts of the records that it saw, or the records that it names.
MEDIA = """n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
u AS (SELECT pos, n, 'utt_' || lpad(pos::VARCHAR, 8, '0') AS id, pos * 1000 + 250 AS s, least(n * 1000, pos * 1000 + 1750) AS e FROM n WHERE pos % 3 = 0),
c AS (SELECT (SELECT max(n) FROM n) AS shots, (SELECT count(*) FROM u) AS utts, (SELECT sum(1 + (e > (pos + 1) * 1000 AND pos + 1 < n)::INT) FROM u) AS refs)"""


@plan(f"""WITH {MEDIA}, v AS (SELECT unnest(['sound', 'gap', 'twice', 'frameless', 'late', 'moved', 'off', 'unlinked']) AS variant)
SELECT variant, 'shot_timeline_contiguous' AS name, variant <> 'gap' AS passed, shots::VARCHAR AS details FROM v, c
UNION ALL SELECT variant, 'record_ids_unique', variant <> 'twice', (shots + utts + (variant = 'twice')::INT)::VARCHAR FROM v, c
UNION ALL SELECT variant, 'one_keyframe_per_shot', variant <> 'frameless', (shots - CASE WHEN variant = 'frameless' THEN (SELECT count(*) FROM n WHERE pos % 1000 = 5) ELSE 0 END)::VARCHAR FROM v, c
UNION ALL SELECT variant, 'utterances_within_timeline', variant <> 'late', (utts + (variant = 'twice')::INT)::VARCHAR FROM v, c
UNION ALL SELECT variant, 'evidence_units_match_shots', variant NOT IN ('gap', 'moved'), shots::VARCHAR FROM v, c
UNION ALL SELECT variant, 'utterance_references_exact', variant NOT IN ('off', 'late'), (refs - CASE WHEN variant = 'unlinked' THEN (SELECT sum(1 + (e > (pos + 1) * 1000 AND pos + 1 < n)::INT) FROM u WHERE pos % 999 = 0) ELSE 0 END + CASE WHEN variant = 'twice' THEN 2 ELSE 0 END)::VARCHAR FROM v, c
UNION ALL SELECT variant, 'all_utterances_linked', variant <> 'unlinked', CASE WHEN variant = 'unlinked' THEN (SELECT string_agg(id, ',' ORDER BY id) FROM u WHERE pos % 999 = 0) ELSE '' END FROM v""")
def media_audit(spark, sf_dir):
    """Each variant is a version of one video; all are checked at once, what they share travels once, and every unlinked utterance is named."""
    faults = ("sound", "gap", "twice", "frameless", "late", "moved", "off", "unlinked")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-o.count() // MEDIA_ROWS))
    n = checkpointed(sp.ranked(o, ["k"]).select(F.col("__rank").alias("pos")).repartitionByRange(tasks, "pos"))
    total = n.agg((F.count("*") * 1000).alias("total"))
    shots = n.select("pos", (F.col("pos") * 1000).alias("start_ms"), ((F.col("pos") + 1) * 1000).alias("end_ms"))
    utts = n.where("pos % 3 = 0").join(F.broadcast(total)).select(F.col("pos").alias("utt"), (F.col("pos") * 1000 + 250).alias("start_ms"), F.least("total", F.col("pos") * 1000 + 1750).alias("end_ms"), "total")
    one = lambda df: df.withColumn("video", F.lit("v"))
    number = lambda form, c: F.format_string(form, c)
    spans = ["overlap_start_ms", "overlap_end_ms", "overlap_ms"]
    joined = iv.overlap_join(one(shots), one(utts.drop("total")), ["video"], "inner").select(*shots.columns, F.struct(number("utt_%08d", "right_utt").alias("utterance_id"), *spans).alias("ref"))
    refs = joined.unionByName(shots, allowMissingColumns=True).groupBy(*shots.columns).agg(F.collect_list("ref").alias("utterance_refs"))
    held, bits = F.col("held"), {v: F.lit(1 << k).cast("long") for k, v in enumerate(faults)}
    of_all = lambda df, *columns: df.select(F.lit("v").alias("video_id"), *columns, F.lit((1 << len(faults)) - 1).cast("long").alias("held"))
    named = [number("shot_%08d", "pos").alias("shot_id"), number("k/%08d.jpg", "pos").alias("keyframe_path")]
    hit, third = lambda k: F.col("pos") % 1000 == k, F.col("utt") == 3

    def but(df, variant, where, **changed):
        """Where a variant's records are others, they are parted from those of the rest."""
        b = bits[variant]
        parted = df.withColumn("held", F.explode(F.when(where, F.filter(F.array(held.bitwiseAND(F.bitwise_not(b)), held.bitwiseAND(b)), lambda x: x != 0)).otherwise(F.array(held))))
        return parted.withColumns({c: F.when(where & (held == b), x).otherwise(F.col(c)) for c, x in changed.items()})

    seconds = but(of_all(shots, "pos", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), *named), "gap", hit(7), start_s=F.col("start_s") + 0.5)
    heard = but(of_all(utts, "utt", number("utt_%08d", "utt").alias("utterance_id"), "start_ms", "end_ms", "total"), "late", third, end_ms=F.col("total") + 1)
    again = third & (held.bitwiseAND(bits["twice"]) != 0)
    heard = heard.withColumn("held", F.explode(F.when(again, F.array(held, bits["twice"])).otherwise(F.array(held)))).drop("utt", "total")
    loose = lambda r: F.substring(r["utterance_id"], 5, 8).cast("long") % 999 == 0
    units = but(of_all(refs, "pos", "start_ms", "end_ms", *named, "utterance_refs"), "moved", hit(7), keyframe_path=F.lit("elsewhere"))
    units = but(units, "off", hit(0), utterance_refs=F.transform("utterance_refs", lambda r: r.withField("overlap_ms", r["overlap_ms"] + 1)))
    units = but(units, "unlinked", F.exists("utterance_refs", loose), utterance_refs=F.filter("utterance_refs", lambda r: ~loose(r)))
    frames = of_all(shots, "pos", named[1].alias("path")).withColumn("held", F.when(hit(5), held.bitwiseAND(F.bitwise_not(bits["frameless"]))).otherwise(held)).drop("pos")
    videos = total.select(F.lit("v").alias("video_id"), F.col("total").alias("duration_ms"))
    return au.media_checks(seconds, heard, units, frames, videos, listed=None, versions=faults).drop("video_id").withColumnRenamed("version", "variant")


@plan("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def order_positions(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("pos"))
