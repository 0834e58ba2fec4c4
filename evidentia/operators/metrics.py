"""Grouped quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles


def retrieval_metrics(df: DataFrame, on: list[str], iou: str = "iou") -> DataFrame:
    """Mean IoU and shares at or above 0.3, 0.5 and 0.7, six places, halves to even."""
    share = lambda t: F.bround(F.avg((F.col(iou) >= t).cast("double")), 6)
    return df.groupBy(*on).agg(F.count("*").alias("n"), F.bround(F.avg(iou), 6).alias("mean_iou"), share(0.3).alias("r1_30"), share(0.5).alias("r1_50"), share(0.7).alias("r1_70"))


def evaluation_summary(records: DataFrame, on: str = "method", split: str = "split", evaluation: str = "eval") -> DataFrame:
    """Means of each method over all of its tasks (scope all) and over those of the evaluation split alone (scope eval), in one pass.

    records: on, split, temporal_iou, tool_calls, and the flags evidence_supported, audit_passed, success (null: false).
    """
    flag = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    scope = F.when(F.col(split) == evaluation, F.array(F.lit("all"), F.lit("eval"))).otherwise(F.array(F.lit("all")))
    return records.withColumn("scope", F.explode(scope)).groupBy("scope", on).agg(
        F.count("*").alias("task_count"), F.avg("temporal_iou").alias("mean_temporal_iou"), F.avg((F.col("temporal_iou") >= 0.5).cast("double")).alias("temporal_success_rate_iou_0_5"),
        flag("evidence_supported").alias("evidence_support_rate"), flag("audit_passed").alias("audit_pass_rate"), flag("success").alias("business_success_rate"), F.avg("tool_calls").alias("avg_tool_calls"),
    )


def grouped_means(df: DataFrame, on: list[str], values: dict[str, int]) -> DataFrame:
    """Means of columns, each rounded to its number of places; flags count as 0 and 1."""
    return df.groupBy(*on).agg(F.count("*").alias("n"), *[F.bround(F.avg(F.col(c).cast("double")), places).alias(c) for c, places in values.items()])


def overall_and_by(df: DataFrame, by: str, sums: dict[str, Column], over: str = "n") -> DataFrame:
    """Means over everything (by is null) and by a column, in one pass; an empty table gives one row of zeros. Six places, halves to even."""
    aggs = [F.sum(c.cast("double")).alias(f"__{k}") for k, c in sums.items()]
    both = df.groupingSets([[], [F.col(by)]], by).agg(F.count("*").alias(over), F.grouping(by).alias("__all"), *aggs)
    found = both.where(f"__all = 1 or {by} is not null").select("__all", by, over, *[F.bround(F.coalesce(F.col(f"__{k}"), F.lit(0.0)) / F.greatest(F.lit(1), F.col(over)), 6).alias(k) for k in sums])
    none = df.sparkSession.range(1).join(found.where("__all = 1").select(F.lit(0).cast("long").alias("id")), "id", "left_anti")
    zeros = none.select(F.lit(None).cast(df.schema[by].dataType).alias(by), F.lit(0).cast("long").alias(over), *[F.lit(0.0).alias(k) for k in sums])
    return found.drop("__all").unionByName(zeros)


def ratio_of_sums(part: Column, whole: Column) -> Column:
    return F.sum(part) / F.greatest(F.lit(1), F.sum(whole))


def merge_shards(shards: list[DataFrame], key: str) -> DataFrame:
    """All shards' rows; an id in two rows is an error when the result is read."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    n = F.count("*").over(Window.partitionBy(key))
    checked = F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key]))
    return rows.withColumn(key, checked)


def advantages(df: DataFrame, on: list[str], reward: str = "reward") -> DataFrame:
    """Adds advantage: (reward - mean) / (population deviation + 1e-6) within a group."""
    w = Window.partitionBy(*on)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + 1e-6))


def set_scores(found: Column, truth: Column) -> tuple[Column, Column, Column, Column]:
    """Precision, recall and F1 of a set (0 where undefined), and F1 with a denominator of at least 1e-8."""
    a, b = F.array_distinct(found), F.array_distinct(truth)
    hit = F.size(F.array_intersect(a, b))
    p, r = hit / F.greatest(F.lit(1), F.size(a)), hit / F.greatest(F.lit(1), F.size(b))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 2 * p * r / F.greatest(F.lit(1e-8), p + r)


def saliency(scores: Column, wanted: Column) -> Column:
    """Mean over wanted ids of (mean of an id's annotations) / 4, 0 for an id without any. scores: map of id to array."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a) / 4
    each = F.transform(wanted, lambda k: F.coalesce(mean(scores[k]), F.lit(0.0)))
    return F.when(F.size(wanted) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(wanted)).otherwise(0.0)


def duration_stats(df: DataFrame, on: list[str], value: str) -> DataFrame:
    """Least, exact median, mean and greatest of a number per key; null for a key of nulls only."""
    plain = df.groupBy(*on).agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    middle = quantiles(df, on, value, 0.5, "median")
    same = [F.col(f"p.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in on]
    return plain.alias("p").join(middle.alias("m"), same, "left").select(*[F.col(f"p.`{c}`") for c in on], "least", "median", "mean", "most")
