"""Candidates on a chain of shots: evidence of several modalities, fusion, ranking, propagation, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as sx

NODE = ["task_id", "pos"]


def update(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scores of nodes (task_id, pos, start_ms) from rows (task_id, pos, modality, score): of each modality the greatest.

    A modality is a source only with a score above 0; rows of unknown nodes are ignored. One aggregation with partial sums.
    """
    best = lambda m: F.max(F.when(F.col("modality") == m, F.col("score")))
    got = evidence.groupBy(*NODE).agg(
        best("text").alias("text_score"), best("image").alias("visual_score"), best("context").alias("context_score"),
        F.array_sort(F.collect_set(F.when(F.col("score") > 0, F.col("modality")))).alias("sources"),
    )
    zero = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))).alias(c)
    return nodes.join(got, NODE, "left").select(*nodes.columns, zero("text_score"), zero("visual_score"), zero("context_score"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def fuse(nodes: DataFrame, weights: tuple[float, float, float] = sx.TEXT_WEIGHTS) -> DataFrame:
    return nodes.withColumn("fused", sx.noisy_or(F.col("text_score"), F.col("visual_score"), F.col("context_score"), weights))


def ranked(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes with a source by fused score, then start; places beyond six decimals do not decide."""
    w = Window.partitionBy("task_id").orderBy(F.desc(F.round("fused", 9)), "start_ms", "pos")
    out = nodes.where(F.size("sources") > 0).withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= limit) if limit else out


def reciprocal_rank(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """1 / rank of the first relevant node of each task, 0 if there is none. relevant: task_id, pos."""
    first = ranking.join(relevant.select(*NODE).distinct(), NODE, "left_semi").groupBy("task_id").agg(F.min("rank").alias("first"))
    tasks = ranking.select("task_id").unionByName(relevant.select("task_id")).distinct()
    return tasks.join(first, "task_id", "left").select("task_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def propagate(nodes: DataFrame, centres: DataFrame, decay: float = 0.7, most: int = 3) -> DataFrame:
    """Nodes after centres (task_id, pos, radius) lent their score to the positions around them, least at the edge.

    The radius is clamped to 1..most, so a centre is expanded to at most 2 * most + 1 rows, which join on the position:
    no range join.
    """
    lent = centres.alias("c").join(nodes.alias("n"), [F.col(f"c.{k}") == F.col(f"n.{k}") for k in NODE]).select(
        F.col("n.task_id").alias("task_id"), F.col("n.pos").alias("at"), F.greatest(F.lit(0.1), F.col("fused")).alias("score"), F.greatest(F.lit(1), F.least(F.lit(most), F.col("radius"))).alias("radius")
    )
    spread = lent.select("task_id", "at", "score", F.explode(F.sequence(F.col("at") - F.col("radius"), F.col("at") + F.col("radius"))).alias("pos"))
    gain = spread.groupBy(*NODE).agg(F.max(F.col("score") * F.exp(-decay * F.abs(F.col("pos") - F.col("at")))).alias("gain"))
    out = nodes.join(gain, NODE, "left")
    return out.withColumns({
        "context_score": F.greatest("context_score", F.coalesce("gain", F.lit(0.0))),
        "sources": F.when(F.col("gain").isNotNull(), F.array_sort(F.array_union("sources", F.array(F.lit("context"))))).otherwise(F.col("sources")),
    }).drop("gain")


def select_adjacent(ranking: DataFrame, budget: int = 3, share: float = 0.88) -> DataFrame:
    """Per task the best node and those next to a selected one, from the top, as long as scores reach share of the best.

    An ordered fold over at most budget ranked nodes per task.
    """
    few = ranking.where(F.col("rank") <= budget).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "fused"))).alias("r"))
    fold = F.expr(
        f"""aggregate(slice(r, 2, greatest(1, size(r))), named_struct('open', true, 'picked', array(r[0].pos)),
            (a, x) -> named_struct(
                'open', a.open and x.fused >= {share} * r[0].fused,
                'picked', if(a.open and x.fused >= {share} * r[0].fused and exists(a.picked, p -> abs(p - x.pos) <= 1), concat(a.picked, array(x.pos)), a.picked)),
            a -> array_sort(a.picked))"""
    )
    return few.select("task_id", fold.alias("selected"))
