"""Text, retrieval, fusion and ranking on the documents, benchmark, embeddings, pages and labels tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as sx
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import retrieval as rt
from ..operators import sampling as sp
from ..operators import shots as sh
from ..session import checkpointed
from . import timeline
from .tables import table

QUERIES, ORACLE = {}, {}


def plan(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


STOP = "('" + "', '".join(tx.STOP_WORDS) + "')"
TOKENS = f"tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: t NOT IN {STOP}) AS t FROM documents)"


@plan(f"""WITH {TOKENS}, d AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY term)
SELECT term, df, tf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, (SELECT count(*) AS n FROM documents)""")
def doc_tokens(spark, sf_dir):
    """Every term, however rare."""
    return rt.term_statistics(table(spark, sf_dir, "documents")).select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@plan(f"WITH {TOKENS}, p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk) SELECT doc_id, count(*) AS terms, sum(n)::BIGINT AS total, max(n) AS most, md5(string_agg(term || ':' || n, ',' ORDER BY term)) AS digest FROM (SELECT doc_id, dl, term, count(*) AS n FROM p GROUP BY ALL) GROUP BY doc_id")
def doc_postings(spark, sf_dir):
    p = rt.postings(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "tf"))), lambda x: F.concat_ws(":", x["term"], x["tf"].cast("string"))), ",")
    return p.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("total"), F.max("tf").alias("most"), F.md5(text.cast("binary")).alias("digest"))


@plan(f"""WITH {TOKENS}, n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: t NOT IN {STOP})) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT q.item_id, tf.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-6)))) AS raw FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY 1, 2),
m AS (SELECT *, raw / max(raw) OVER (PARTITION BY item_id) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m)
SELECT item_id, doc_id, rank::BIGINT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("query"))
    s = rt.bm25(q, table(spark, sf_dir, "documents"), query_id="item_id", k=10)
    return rt.top(s, ["item_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], 10, 10).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@plan("""WITH t AS (SELECT doc_id, lower(text) AS low, list_filter(string_split(lower(source || ' ' || lang), ' '), lambda x: x <> '') AS q FROM documents)
SELECT doc_id, len(list_filter(q, lambda x: contains(low, x))) = len(q) AND len(q) > 0 AS hit FROM t""")
def contains_all_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.contains_all(F.col("text"), F.concat_ws(" ", "source", "lang")).alias("hit"))


@plan("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z'']+')) >= 4 AND NOT (starts_with(text, '(') AND ends_with(text, ')')) AS ok FROM documents")
def meaningful_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.meaningful(F.col("text")).alias("ok"))


@plan("""WITH f AS (SELECT page_id, replace(regexp_replace(html, '<[^>]+>', '', 'g'), '♪', '') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM f""")
def stripped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.stripped(F.col("html")).cast("binary")).alias("digest"))


# The entities that the pages hold.
@plan("""WITH u AS (SELECT page_id, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM pages),
f AS (SELECT page_id, replace(regexp_replace(h, '<[^>]+>', '', 'g'), '♪', '') AS t FROM u) SELECT page_id, trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM f""")
def cleaned_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.cleaned(F.col("html")).alias("text"))


@plan("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')[1:120] AS head, length(array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')) AS n FROM documents")
def normalized_text(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", tx.normalized(F.col("text")).alias("t"))
    return n.select("doc_id", F.substring("t", 1, 120).alias("head"), F.length("t").cast("long").alias("n"))


@plan("SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')) AS digest FROM documents")
def normalized_digest(spark, sf_dir):
    """Of the whole normalised text; normalized_text gives its head and length."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalized(F.col("text")).cast("binary")).alias("digest"))


@plan("""WITH q AS (SELECT item_id, lower(text) AS t, item_id % 2 = 0 AS talk FROM benchmark),
v AS (SELECT item_id, talk, len(list_filter(regexp_split_to_array(translate(t, '?.', ''), '\\s+'), lambda w: w IN ('appearance', 'butterfly', 'color', 'flowers', 'forest', 'hide', 'look', 'scene', 'see', 'tree', 'visual', 'wear'))) > 0 OR NOT talk AS visual FROM q)
SELECT item_id, talk AS use_text, true AS use_image, CASE WHEN visual THEN 6 ELSE 5 END AS top_k, CASE WHEN visual THEN 3 ELSE 2 END AS inspect_budget, 1 AS context_radius FROM v""")
def routed_queries(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark")
    return q.select("item_id", tx.route(F.col("text"), F.col("item_id") % 2 == 0).alias("r")).select("item_id", "r.*")


# The query of a label is its first vector.
COSINES = """q AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
c AS (SELECT query_id, vec_id, label, list_cosine_similarity(v, embedding::DOUBLE[]) AS score FROM q, embeddings)"""


def cosines(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return rt.cosine_scores(q, e)


@plan(f"WITH {COSINES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM c) SELECT query_id, vec_id, rank::BIGINT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return rt.top(cosines(spark, sf_dir), ["query_id"], [F.desc(F.round("score", 9)), F.col("vec_id")], 10, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@plan(f"WITH {COSINES}, k AS (SELECT query_id, vec_id, least(1, greatest(0, (score - 0.15) / 0.20)) AS cal FROM c) SELECT query_id, round(avg(cal), 6) AS mean, round(avg(0.65 * cal + 0.35 * ((vec_id % 10) / 10.0)), 6) AS mixed, count(*) AS n FROM k GROUP BY query_id")
def calibrated_scores(spark, sf_dir):
    k = cosines(spark, sf_dir).withColumn("cal", sx.calibrated(F.col("score")))
    return k.groupBy("query_id").agg(F.round(F.avg("cal"), 6).alias("mean"), F.round(F.avg(sx.mixed(F.col("cal"), (F.col("vec_id") % 10) / 10.0)), 6).alias("mixed"), F.count("*").alias("n"))


@plan("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.norm(vx.doubles(F.col("embedding"))), 6).alias("norm"))


@plan("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)")
def missing_vectors(spark, sf_dir):
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return rt.vectors_of(tasks, table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("vec_id", "embedding"), "vec_id")[1].select(F.col("vec_id").alias("item_id"))


# Candidates: a label is a task, its vectors in order of id are the chain. Text evidence comes from the first dimension,
# image evidence from the second; every tenth vector has a second text score.
NODES = "nd AS (SELECT label AS task_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id, embedding FROM embeddings)"
EVID = f"""{NODES}, ev AS (SELECT task_id, pos, 'text' AS modality, greatest(0, embedding[1]::DOUBLE * 3) AS score FROM nd UNION ALL SELECT task_id, pos, 'image', greatest(0, embedding[2]::DOUBLE * 3) FROM nd UNION ALL SELECT task_id, pos, 'text', 0.3 FROM nd WHERE vec_id % 10 = 0),
up AS (SELECT task_id, pos, max(CASE WHEN modality = 'text' THEN score END) AS text_score, max(CASE WHEN modality = 'image' THEN score END) AS visual_score, list_sort(list_distinct(list(CASE WHEN score > 0 THEN modality END))) AS sources FROM ev GROUP BY 1, 2),
fu AS (SELECT *, 1 - (1 - least(1, greatest(0, 0.52 * text_score))) * (1 - least(1, greatest(0, 0.38 * visual_score))) AS fused FROM up),
rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(fused, 9) DESC, pos) AS rank FROM fu WHERE len(sources) > 0)"""


def nodes(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("task_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), "vec_id", "embedding")


def updated(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir)
    score = lambda i: F.greatest(F.lit(0.0), F.col("embedding")[i].cast("double") * 3)
    rows = n.select("task_id", "pos", F.explode(F.array(
        F.struct(F.lit("text").alias("modality"), score(0).alias("score")), F.struct(F.lit("image").alias("modality"), score(1).alias("score")),
        F.struct(F.lit("text").alias("modality"), F.when(F.col("vec_id") % 10 == 0, 0.3).otherwise(0.0).alias("score")),
    )).alias("e")).select("task_id", "pos", "e.*")
    return gr.fuse(gr.update(rows, n.select("task_id", "pos", F.col("pos").alias("start_ms"))))


@plan(f"WITH {EVID} SELECT task_id, pos, round(text_score, 6) AS text_score, round(visual_score, 6) AS visual_score, round(fused, 6) AS fused, array_to_string(sources, ',') AS sources FROM fu")
def noisy_or_fusion(spark, sf_dir):
    r6 = lambda c: F.round(c, 6).alias(c)
    return updated(spark, sf_dir).select("task_id", "pos", r6("text_score"), r6("visual_score"), r6("fused"), F.array_join("sources", ",").alias("sources"))


@plan(f"WITH {EVID} SELECT task_id, pos, rank::BIGINT AS rank, round(fused, 6) AS fused FROM rk WHERE rank <= 8")
def ranked_candidates(spark, sf_dir):
    return gr.ranked(updated(spark, sf_dir), 8).select("task_id", "pos", "rank", F.round("fused", 6).alias("fused"))


@plan(f"WITH {EVID}, f AS (SELECT task_id, min(rank) AS first FROM rk WHERE pos % 7 = 3 GROUP BY 1) SELECT DISTINCT nd.task_id, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS rr FROM nd LEFT JOIN f USING (task_id)")
def reciprocal_rank(spark, sf_dir):
    u = updated(spark, sf_dir)
    return gr.reciprocal_rank(gr.ranked(u), u.where("pos % 7 = 3")).select("task_id", F.round("rr", 6).alias("rr"))


@plan(f"""WITH {EVID}, ce AS (SELECT task_id, pos AS c, greatest(0.1, fused) AS sc FROM rk WHERE rank = 1 OR rank = 5),
g AS (SELECT n.task_id, n.pos, max(sc * exp(-0.7 * abs(n.pos - c))) AS gain FROM nd n JOIN ce ON ce.task_id = n.task_id AND abs(n.pos - c) <= 3 GROUP BY 1, 2)
SELECT fu.task_id, fu.pos, round(coalesce(gain, 0), 6) AS context_score, array_to_string(list_sort(CASE WHEN gain IS NOT NULL THEN list_append(sources, 'context') ELSE sources END), ',') AS sources FROM fu LEFT JOIN g ON g.task_id = fu.task_id AND g.pos = fu.pos""")
def propagated_context(spark, sf_dir):
    u = updated(spark, sf_dir)
    centres = gr.ranked(u).where("rank = 1 or rank = 5").select("task_id", "pos", F.lit(20).alias("radius"))
    return gr.propagate(u, centres).select("task_id", "pos", F.round("context_score", 6).alias("context_score"), F.array_join("sources", ",").alias("sources"))


@plan(f"""WITH RECURSIVE {EVID}, t AS (SELECT task_id, rank, pos, fused, max(fused) OVER (PARTITION BY task_id) AS top FROM rk WHERE rank <= 6),
go AS (SELECT task_id, rank, [pos] AS picked, true AS open FROM t WHERE rank = 1 UNION ALL
SELECT t.task_id, t.rank, CASE WHEN open AND fused >= 0.5 * top AND len(list_filter(picked, lambda p: abs(p - t.pos) <= 1)) > 0 THEN list_append(picked, t.pos) ELSE picked END, open AND fused >= 0.5 * top FROM go JOIN t ON t.task_id = go.task_id AND t.rank = go.rank + 1)
SELECT task_id, array_to_string(list_sort(arg_max(picked, rank)), ',') AS selected FROM go GROUP BY task_id""")
def adjacent_selection(spark, sf_dir):
    s = gr.select_adjacent(gr.ranked(updated(spark, sf_dir)), 6, 0.5)
    return s.select("task_id", F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("selected"))


@plan("""WITH l AS (SELECT l_orderkey, l_linenumber AS p, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS q FROM lineitem WHERE l_quantity > 10)
SELECT l_orderkey, coalesce(bool_and(p - q <= 1), true) AS loose, coalesce(bool_and(p - q = 1), true) AS strict FROM l GROUP BY l_orderkey""")
def temporal_continuity(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("p"))
    return p.select("l_orderkey", iv.contiguous_positions(F.col("p"), True).alias("loose"), iv.contiguous_positions(F.col("p"), False).alias("strict"))


# Nations are tasks; those that are a label of vectors have a series, the calibrated cosines of the label's query with all vectors in order, and the
# label's own vectors as targets.
CALIBRATED = COSINES + ", s0 AS (SELECT query_id AS series, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) - 1 AS clip, least(1, greatest(0, (score - 0.15) / 0.20)) AS score FROM c)"


@plan(f"""WITH p AS ({timeline.ORACLE["temporal_proposals"].replace(timeline.SERIES, CALIBRATED)}), b AS ({timeline.ORACLE["baseline_predictors"].replace(timeline.SERIES, CALIBRATED)}),
f AS (SELECT series, 'adaptive' AS method, start_ms AS s, end_ms AS e FROM p WHERE rank = 1 UNION ALL SELECT series, 'peak', peak_start_ms, peak_end_ms FROM b UNION ALL SELECT series, 'fixed', fixed_start_ms, fixed_end_ms FROM b),
t AS (SELECT label AS series, row_number() OVER (ORDER BY vec_id) - 1 AS clip, label FROM embeddings), i AS (SELECT f.series, method, any_value((e - s) // 2000) AS n, count(*) FILTER (clip * 2000 >= s AND clip * 2000 < e) AS hit, count(*) AS k FROM f JOIN t USING (series) JOIN nation ON n_nationkey = f.series GROUP BY 1, 2),
u AS (SELECT method, hit::DOUBLE / (n + k - hit) AS iou FROM i), g AS (SELECT count(*) AS missing, array_to_string(list_sort(list(n_nationkey))[1:20], ',') AS missing_ids FROM nation WHERE n_nationkey NOT IN (SELECT label FROM embeddings))
SELECT method, count(*) AS n, round_even(avg(iou), 6) AS mean_iou, round_even(avg((iou >= 0.3)::INT), 6) AS r1_30, round_even(avg((iou >= 0.5)::INT), 6) AS r1_50, round_even(avg((iou >= 0.7)::INT), 6) AS r1_70, any_value(missing) AS missing, any_value(missing_ids) AS missing_ids FROM u, g GROUP BY method""")
def heldout_ablation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    clips = checkpointed(sp.ranked(e.select("vec_id", F.col("label").cast("long").alias("series")), ["vec_id"]).withColumnRenamed("__rank", "clip"))
    scored = cosines(spark, sf_dir).join(clips.select("vec_id", "clip"), "vec_id")
    series = scored.select(F.col("query_id").cast("long").alias("series"), "clip", sx.calibrated(F.col("score")).alias("score"))
    targets = clips.select("series", (F.col("clip") * 2000).alias("start_ms"), ((F.col("clip") + 1) * 2000).alias("end_ms"))
    return sh.held_out(series, targets, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("series")))
