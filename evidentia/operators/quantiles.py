"""Exact quantiles by counting passes over shrinking ranges of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed

#: Values of a key that one task may hold at once.
HELD = 1 << 16
#: Cuts of a pass; a pass leaves about a CUTS-th of a key's values, or one value.
CUTS = 256


def _bucket(cuts: Column, v: Column) -> Column:
    """Twice the cuts below v, and one more if v is a cut: what lies between two cuts and what equals one are buckets of their own. By binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((CUTS + 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= F.size(cuts)) & (F.try_element_at(cuts, i + s) < v), i + s).otherwise(i))
    return F.transform(F.array(below), lambda i: 2 * i + (F.coalesce(F.try_element_at(cuts, i + 1) == v, F.lit(False))).cast("int"))[0]


def quantiles(df: DataFrame, on: Sequence[str], value: str, q: float, name: str = "quantile", held: int = HELD) -> DataFrame:
    """(on, name): the exact q-quantile of a number per key, between two values by linear interpolation; nulls are left out, a key of nulls only has no row.

    Keys of at most held values are sorted in their task. Larger ones are never held: a pass takes CUTS cuts from a mergeable sketch, counts the
    values between and at the cuts with their least and greatest, and goes on with the range that holds the wanted place, until it has at most
    held values or one. The cuts only decide how fast that is; places are counted, so the result is exact.
    """
    rows = df.select(*on, F.col(value).cast("double").alias("__v")).where("__v is not null")
    keys = [F.col(f"`{c}`") for c in on]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= held:
        return rows.groupBy(*keys).agg(F.percentile("__v", F.lit(q)).alias(name))
    rows = checkpointed(rows)
    place = F.lit(q) * (F.col("__n") - 1)
    wanted = F.array(*[F.struct(F.lit(k).alias("__k"), least(place).cast("long").alias("__at")) for k, least in enumerate((F.floor, F.ceil))])
    # __at: the place among the values from __lo to __hi, of which there are __n.
    open_ = checkpointed(sizes.withColumn("__w", F.explode(wanted)).select(*on, "__n", "__w.*", place.alias("__place"), F.lit(float("-inf")).alias("__lo"), F.lit(float("nan")).alias("__hi")))  # NaN is above all numbers
    done = None
    while True:
        found = open_.where((F.col("__n") <= held) | (F.col("__lo") == F.col("__hi")))
        done = found if done is None else done.unionByName(found)
        open_ = open_.where((F.col("__n") > held) & (F.col("__lo") != F.col("__hi")))
        if not open_.limit(1).count():
            break
        inside = _inside(rows, open_, on)
        cut = inside.groupBy(*keys, "__k").agg(F.percentile_approx("__v", [k / CUTS for k in range(CUTS + 1)], 16 * CUTS).alias("__c")).withColumn("__c", F.array_sort(F.array_distinct("__c")))
        each = _same(inside, cut, [*on, "__k"], ["__c"]).withColumn("__b", _bucket(F.col("__c"), F.col("__v")))
        counted = each.groupBy(*keys, "__k", "__b").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))  # 2 * CUTS + 3 rows a target at most
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys, "__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = _same(counted.withColumn("__before", before), open_, [*on, "__k"], ["__at", "__place"]).where("__before <= __at and __at < __before + __n")
        open_ = checkpointed(ranges.select(*on, "__n", "__k", (F.col("__at") - F.col("__before")).alias("__at"), "__place", "__lo", "__hi"))
    one = done.where("__lo = __hi").select(*on, "__k", "__place", F.col("__lo").alias("__x"))
    few = _inside(rows, done.where("__lo <> __hi"), on).groupBy(*keys, "__k", "__at", "__place").agg(F.array_sort(F.collect_list("__v")).alias("__s"))  # held values at most
    values = one.unionByName(few.select(*on, "__k", "__place", F.col("__s")[F.col("__at").cast("int")].alias("__x")))
    both = values.groupBy(*keys, "__place").agg(F.max(F.when(F.col("__k") == 0, F.col("__x"))).alias("__a"), F.max(F.when(F.col("__k") == 1, F.col("__x"))).alias("__b"))
    part = F.col("__place") - F.floor("__place")
    return both.select(*on, F.when(part == 0, F.col("__a")).otherwise((1 - part) * F.col("__a") + part * F.col("__b")).alias(name))


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], add: Sequence[str]) -> DataFrame:
    """left with right's columns add, joined on equal keys, nulls included."""
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in on]
    return left.alias("l").join(right.alias("r"), same or F.lit(True)).select(*[F.col(f"l.`{c}`") for c in left.columns], *[F.col(f"r.`{c}`") for c in add])


def _inside(rows: DataFrame, ranges: DataFrame, on: Sequence[str]) -> DataFrame:
    """The values of the ranges' keys that lie in them."""
    return _same(rows, ranges, on, ["__k", "__at", "__place", "__lo", "__hi"]).where("__v >= __lo and __v <= __hi")
