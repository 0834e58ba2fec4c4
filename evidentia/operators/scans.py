"""Scans over long ordered series in many tasks: chunks of positions, neighbours from the next chunk, and what a chunk carries over.

A window function holds a key's rows in one task. Here a series is cut by position into chunks; a chunk gets copies of the few rows beside
it, or one row of totals of all chunks before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Positions of a chunk.
CHUNK = 1 << 17


def _chunk(at: Column, chunk: int) -> Column:
    return F.floor(at / chunk)


def beside(df: DataFrame, on: Sequence[str], at: str, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """Adds columns over a window of each row's neighbours, of which at most before rows behind it and after rows ahead count.

    at: positions from 0 without gaps within each key of on. A row is copied to the chunk beside its own if it is that near to it.
    """
    p = F.col(at)
    near = F.sequence(_chunk(F.greatest(F.lit(0), p - after), chunk), _chunk(p + before, chunk))
    copies = df.withColumn("__chunk", F.explode(near))
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in on], "__chunk").orderBy(at)
    made = columns(w)
    return copies.withColumns(made).where(F.col("__chunk") == _chunk(p, chunk)).drop("__chunk")


def running(df: DataFrame, on: Sequence[str], at: str, columns: dict[str, Column], chunk: int = CHUNK, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds running aggregates (how: sum, min or max) of columns up to each row, by position.

    Within a chunk they run from its begin; what the chunks before have in all is added from a table of a row a chunk.
    """
    keys = [F.col(f"`{c}`") for c in on]
    cut = df.withColumn("__chunk", _chunk(F.col(at), chunk))
    inside = cut.withColumns({k: how(v).over(Window.partitionBy(*keys, "__chunk").orderBy(at)) for k, v in columns.items()})
    totals = cut.groupBy(*keys, "__chunk").agg(*[how(v).alias(f"__{k}") for k, v in columns.items()])
    past = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*on, "__chunk", *[how(F.col(f"__{k}")).over(past).alias(f"__{k}") for k in columns])
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*on, "__chunk"]]
    joined = inside.alias("l").join(carried.alias("r"), same).select("l.*", *[f"r.__{k}" for k in columns])
    both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + b, F.min: F.least, F.max: F.greatest}[how]
    return joined.withColumns({k: both(F.col(f"__{k}"), F.col(k)) for k in columns}).drop("__chunk", *[f"__{k}" for k in columns])
