"""Deterministic samples, shards and mixtures.

Pseudo-random choices go by a hash of the row's key and a seed: the same rows in every run and on every cluster, which a
seeded generator over rows in arrival order is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import checkpointed


#: Rows that one task ranks, and bits of a row's place in its partition in monotonically_increasing_id.
CELL_ROWS, PLACE_BITS = 1 << 20, 33


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def systematic(df: DataFrame, order: list[str], n: int, on: list[str]) -> DataFrame:
    """Within each key, every max(1, size // n)-th row from the first, n at most. Ranks come from ranked(), so a key that has most rows is ranked in many tasks."""
    sizes = df.groupBy(*on).agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).alias("__step"))
    return ranked(df, order, on).join(sizes, on).where(f"__rank % __step = 0 and __rank / __step < {n}").select(*df.columns)


def draw(key: Column, seed: int) -> Column:
    """A hash in hex that orders rows at random."""
    return F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed))).cast("binary"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def bucket(key: Column, seed: int, of: int = 100) -> Column:
    """0 to of - 1 from a key, evenly."""
    return F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % of


def mixture(df: DataFrame, key: str, share: int, seed: int = 42) -> DataFrame:
    """Adds source: 'formal' for share per cent of the keys, else 'benchmark'."""
    return df.withColumn("source", F.when(bucket(F.col(key), seed) < share, "formal").otherwise("benchmark"))


def shard(df: DataFrame, order: list[str], index: int, of: int) -> DataFrame:
    """Rows index, index + of, ... of the whole order.

    The rank comes from ranked(): places within range partitions and their offsets, so no task sees all rows.
    """
    if not 0 <= index < of:
        raise ValueError(f"not a shard: {index} of {of}")
    return ranked(df, order).where(F.pmod(F.col("__rank"), F.lit(of)) == index).drop("__rank")


def ranked(df: DataFrame, order: list[str], on: Sequence[str] = (), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds __rank, from 0 in the order (nulls first), within each key of on if given; columns of any type that can be sorted.

    A table of more than cell_rows rows is range-partitioned by the whole order (bounds from a sample, ties parted by a hash of
    the other columns), sorted within partitions of some cell_rows rows and written out; a row's rank is its place in its partition and the sizes of those
    before. So no task holds more than a partition, whatever the first column is like; only rows that are equal in all columns stay together.
    """
    by = [F.col(f"`{c}`") for c in (*on, *order)]
    keys = [F.col(f"`{c}`") for c in on]
    cells = -(-df.count() // cell_rows)
    if cells <= 1:
        alone = Window.partitionBy(*keys) if on else Window.partitionBy(F.lit(0))
        return df.withColumn("__rank", (F.row_number().over(alone.orderBy(*[F.col(f"`{c}`") for c in order])) - 1).cast("long"))
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    sorted_ = df.withColumn("__tie", tie).repartitionByRange(cells, *by, "__tie").sortWithinPartitions(*by, "__tie").drop("__tie")
    placed = checkpointed(sorted_.withColumn("__id", F.monotonically_increasing_id()))  # the partition above PLACE_BITS bits of the place in it
    placed = placed.withColumn("__part", F.shiftright("__id", PLACE_BITS))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a partition
    whole = placed.join(before, "__part").withColumn("__rank", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    if on:
        first = whole.groupBy(*keys).agg(F.min("__rank").alias("__first"))
        same = [F.col(f"w.`{c}`").eqNullSafe(F.col(f"f.`{c}`")) for c in on]
        whole = whole.alias("w").join(first.alias("f"), same).select("w.*", "f.__first").withColumn("__rank", F.col("__rank") - F.col("__first"))
    return whole.select(*[F.col(f"`{c}`") for c in df.columns], "__rank")


def chosen_tasks(requests: DataFrame, pools: list[tuple[str, DataFrame, int]], key: str = "request_id", seed: int = 42) -> DataFrame:
    """A task for each request (key, task_id): the one that it names, else one drawn from a pool. Adds source, the pool's name.

    pools: (name, tasks (task_id), share in per cent), the last taking what is left. A drawn task is the pool's row whose place in
    the order of task_id a hash of the key gives. A request for a task that no pool has is left out.
    """
    listed, low = None, 0
    for k, (name, tasks, share) in enumerate(pools):
        high = 100 if k == len(pools) - 1 else low + share
        part = ranked(tasks.select("task_id"), ["task_id"]).select(F.lit(name).alias("source"), "task_id", F.col("__rank").alias("at"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        listed = part if listed is None else listed.unionByName(part)
        low = high
    sizes = listed.groupBy("source", "low", "high").agg(F.count("*").alias("n"))  # a row a pool
    named = requests.where("task_id is not null").join(listed.select("task_id", "source"), "task_id").select(key, "task_id", "source")
    free = requests.where("task_id is null").withColumn("b", bucket(F.col(key), seed))
    drawn = free.join(F.broadcast(sizes), (F.col("b") >= F.col("low")) & (F.col("b") < F.col("high"))).select(key, "source", F.pmod(bucket(F.col(key), seed + 1, 1 << 31), F.col("n")).alias("at"))
    return named.unionByName(drawn.join(listed.select("source", "at", "task_id"), ["source", "at"]).select(key, "task_id", "source"))


def oversampled(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
