"""Joins and projections around tasks: what a model may see, and what it must not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a task that its prompt shows; all others are labels.
PUBLIC = ("task_id", "video_id", "query", "video_has_dialogue", "tool_budget")


def with_tags(units: DataFrame, tags: DataFrame) -> DataFrame:
    """Units (video_id, shot_id) with the visual tags of rows (key 'video:shot', tags); none is an empty array."""
    split = tags.select(F.substring_index("key", ":", 1).alias("video_id"), F.expr("substring(key, locate(':', key) + 1)").alias("shot_id"), F.col("tags"))
    return units.join(split, ["video_id", "shot_id"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_rows(tags: DataFrame) -> DataFrame:
    """(key, tags) from one row with a map of them."""
    return tags.select(F.explode("tags").alias("key", "tags"))


def public_prompt(tasks: DataFrame, units: DataFrame, budget: int = 10) -> DataFrame:
    """What a task shows, by an allow-list; a video has dialogue if one of its units has."""
    talk = units.groupBy("video_id").agg(F.bool_or("has_dialogue").alias("video_has_dialogue"))
    seen = tasks.select("task_id", "video_id", "query").join(talk, "video_id", "left")
    return seen.select("task_id", "video_id", "query", F.coalesce("video_has_dialogue", F.lit(False)).alias("video_has_dialogue"), F.lit(budget).alias("tool_budget")).select(*PUBLIC)


def without_rewards(results: DataFrame) -> DataFrame:
    return results.drop("reward_parts")


def final_rewards(episodes: DataFrame) -> DataFrame:
    """Reward of each episode (episode_id, done, reward): -1 unless it is done and has one."""
    return episodes.select("episode_id", F.when(F.col("done"), F.coalesce("reward", F.lit(-1.0))).otherwise(F.lit(-1.0)).alias("reward"))


def saliency_rows(tasks: DataFrame) -> DataFrame:
    """(task_id, shot_id, scores) from two arrays that belong together by place; what has no partner is left out."""
    pairs = F.filter(F.arrays_zip("shot_ids", "saliency_scores"), lambda p: p["shot_ids"].isNotNull() & p["saliency_scores"].isNotNull())
    return tasks.select("task_id", F.explode(pairs).alias("p")).select("task_id", F.col("p.shot_ids").alias("shot_id"), F.col("p.saliency_scores").alias("scores"))


def contained(inner: str, outer: str):
    """Whether all of an array's values are in another's."""
    return F.size(F.array_except(inner, outer)) == 0
