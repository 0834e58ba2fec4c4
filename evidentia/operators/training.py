"""Training sets from ordered tool-use records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MESSAGE = "struct<role:string,content:string>"


def chats(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per conversation: messages in order, and the prompt: those before the first answer of the assistant."""
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content")))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    first = F.array_min(F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: x[order]))
    return grouped.select(key, messages.alias("messages"), F.transform(F.filter("m", lambda x: first.isNull() | (x[order] < first)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("prompt"))


def trajectory_chats(steps: DataFrame, prompts: DataFrame, key: str = "task_id") -> DataFrame:
    """SFT records: the prompt, then per step the call as JSON and the tool's answer. steps: key, step, tool, arguments, observation (JSON)."""
    call = F.format_string('{"tool": "%s", "arguments": %s}', "tool", "arguments")
    pair = F.array(F.struct(F.lit("assistant").alias("role"), call.alias("content")), F.struct(F.lit("tool").alias("role"), F.col("observation").alias("content")))
    grouped = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", pair.alias("pair")))).alias("s"))
    body = F.flatten(F.transform("s", lambda x: x["pair"]))
    return prompts.join(grouped, key, "left").select(key, F.concat(F.col("prompt"), F.coalesce(body, F.array().cast(f"array<{MESSAGE}>"))).alias("messages"), "prompt")


def native_calls(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Names each tool answer after the last call that none has answered; an answer without one, or a conversation without calls, is an error when read.

    messages: key, order, role, tool (of an assistant's call, else null). Adds name. A running count of calls and answers
    tells which call is open.
    """
    w = Window.partitionBy(key).orderBy(order)
    call = (F.col("role") == "assistant") & F.col("tool").isNotNull()
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(call, F.struct(order, "tool")), ignorenulls=True).over(prior)
    used = F.last(F.when(F.col("role") == "tool", F.col(order)), ignorenulls=True).over(prior)
    open_ = last.isNotNull() & (used.isNull() | (used < last[order]))
    calls = F.sum(call.cast("int")).over(Window.partitionBy(key))
    name = F.when(F.col("role") != "tool", F.lit(None).cast("string")).when(open_, last["tool"]).otherwise(F.raise_error(F.concat(F.lit("tool response without assistant call in "), F.col(key).cast("string"))))
    return messages.withColumn("name", F.when(calls > 0, name).otherwise(F.raise_error(F.concat(F.lit("no tool calls found in "), F.col(key).cast("string"))).cast("string")))


def repeated_calls(steps: DataFrame, key: str, order: str, signature: list[str]) -> DataFrame:
    """Per episode: calls, and those whose signature (tool and key-sorted arguments) was seen before."""
    rn = F.row_number().over(Window.partitionBy(key, *signature).orderBy(order))
    return steps.withColumn("__rn", rn).groupBy(key).agg(F.count("*").alias("calls"), F.sum((F.col("__rn") > 1).cast("long")).alias("repeated"))


def last_of(steps: DataFrame, key: str, order: str, tool: str, value: str, name: str = "tool") -> DataFrame:
    """The value of the last step with a tool, null for an episode without one."""
    return steps.groupBy(key).agg(F.max_by(F.when(F.col(name) == tool, F.col(value)), F.when(F.col(name) == tool, F.col(order))).alias("last"))


def mixed(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """All parts, each repeated a number of times, with what either lacks as null."""
    out = None
    for df, times in parts:
        many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        out = many if out is None else out.unionByName(many, allowMissingColumns=True)
    return out


def annotations(raw: DataFrame) -> DataFrame:
    """Registry rows from annotations (qid, query, windows in seconds, clip ids): milliseconds, sorted clips, terms, kind; those without windows are dropped."""
    terms = F.slice(F.filter(F.split(F.lower("query"), " "), lambda t: F.length(t) > 2), 1, 12)
    return raw.where(F.size("windows") > 0).select(
        "qid", "query", F.transform("windows", lambda w: F.struct(F.rint(w[0] * 1000).cast("long").alias("start_ms"), F.rint(w[1] * 1000).cast("long").alias("end_ms"))).alias("target_segments"),
        F.array_sort(F.array_distinct(F.col("clips"))).alias("clip_ids"), terms.alias("search_terms"), F.when(F.size("windows") > 1, "multi").otherwise("single").alias("task_type"),
    )


def dialogue_tasks(utterances: DataFrame, split: str, prefix: str, pad_ms: int = 1500) -> DataFrame:
    """One task per utterance (video_id, n, start_ms, end_ms, text): quoted text of 120 characters at most, its time padded, not below 0."""
    return utterances.select(
        F.format_string(f"{prefix}_%03d", "n").alias("task_id"), "video_id", F.lit(split).alias("split"),
        F.concat(F.lit('Find the scene where someone says: "'), F.substring("text", 1, 120), F.lit('"')).alias("query"),
        F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("start_ms"), (F.col("end_ms") + pad_ms).alias("end_ms"),
    )
