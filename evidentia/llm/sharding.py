"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame and SQL functions only.

The ring has a fixed number of cells. A shard owns the cells before each of its virtual nodes. It first serves keys of its
own cells, in ring order, up to its capacity; the rest continue clockwise as a queue that each virtual node of a shard with
room shortens. Since only the number of keys in a cell matters for that, the queue runs over counts of cells (a table of
fixed size), as one fold; rows then find their place by their rank in their cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MANY, SPREAD, documents, prepare

CELLS = 1 << 16
VIRTUAL_NODES = 256
OVERHEAD = 16


def _ring(spark: SparkSession, shards: int, virtual: int, cells: int) -> DataFrame:
    """cell -> the first virtual node at or after it (node: its cell, cells more if the ring begins anew) and its shard."""
    nodes = (
        spark.range(shards * virtual)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.col("id") % shards, F.floor(F.col("id") / shards), F.lit("node")).alias("h"))
        .groupBy(F.pmod("h", F.lit(cells)).alias("cell"))
        .agg(F.min(F.struct("h", "shard"))["shard"].alias("shard"))
    )
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)  # as a growing frame: a shrinking one costs its length for every row
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.when(F.col("shard").isNotNull(), F.struct(F.col("cell").alias("node"), "shard"))
    wrapped = F.first(at, ignorenulls=True).over(whole)
    own = F.coalesce(F.last(at, ignorenulls=True).over(ahead), F.struct((wrapped["node"] + cells).alias("node"), wrapped["shard"].alias("shard")))
    return spark.range(cells).withColumnRenamed("id", "cell").join(nodes, "cell", "left").select("cell", own.alias("o")).select("cell", "o.node", "o.shard")


def _pieces(ring: DataFrame, counts: DataFrame, shards: int, cells: int) -> DataFrame:
    """Which ranks [r0, r1) of a cell's keys go to which shard, from which place on (base)."""
    every = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    load = (
        ring.join(counts, "cell", "left")
        .select("cell", "node", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        .withColumn("total", F.sum("n").over(every))
        .withColumn("cap", F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0))
        .withColumn("prior", F.coalesce(F.sum("n").over(own), F.lit(0)))
        .withColumn("keep", F.greatest(F.lit(0), F.least("n", F.col("cap") - F.col("prior"))))
        .withColumn("over", F.col("n") - F.col("keep"))
        .withColumn("q", F.coalesce(F.sum("over").over(before), F.lit(0)))
        .select("cell", "node", "shard", "n", "cap", "prior", "keep", "over", "q")
    )
    # Two laps: what does not fit before the ring's end goes on at its start.
    steps = (
        load.groupBy("node", "shard").agg(F.sum("over").alias("add"))
        .unionByName(load.select((F.col("node") % cells).alias("node"), "shard").distinct().select((F.col("node") + cells).alias("node"), "shard", F.lit(0).cast("long").alias("add")))
        .unionByName(load.select((F.col("node") % cells).alias("node"), "shard").distinct().select("node", "shard", F.lit(0).cast("long").alias("add")))
        .groupBy("node", "shard").agg(F.sum("add").alias("add"))
        .agg(F.array_sort(F.collect_list(F.struct("node", "shard", "add"))).alias("steps"))
    )
    room = (
        load.groupBy("shard").agg((F.max("cap") - F.sum("keep")).alias("room"), F.sum("keep").alias("kept"))
        .agg(F.map_from_entries(F.collect_list(F.struct("shard", F.struct("room", "kept")))).alias("room"))
    )
    takes = (
        steps.join(room)
        .select(
            "steps",
            F.expr(f"transform(sequence(0, {shards - 1}), s -> coalesce(room[s].room, 0L))").alias("room"),
            F.expr(f"transform(sequence(0, {shards - 1}), s -> coalesce(room[s].kept, 0L))").alias("kept"),
        )
        .select(
            F.expr(
                """aggregate(steps,
                  named_struct('queue', 0L, 'done', 0L, 'room', room, 'kept', kept, 'takes', cast(array() as array<struct<q0:bigint,q1:bigint,shard:int,base:bigint>>)),
                  (a, x) -> named_struct(
                    'queue', a.queue + x.add - least(a.queue + x.add, a.room[x.shard]),
                    'done', a.done + least(a.queue + x.add, a.room[x.shard]),
                    'room', if(least(a.queue + x.add, a.room[x.shard]) > 0, transform(a.room, (r, i) -> if(i = x.shard, r - least(a.queue + x.add, r), r)), a.room),
                    'kept', if(least(a.queue + x.add, a.room[x.shard]) > 0, transform(a.kept, (k, i) -> if(i = x.shard, k + least(a.queue + x.add, a.room[i]), k)), a.kept),
                    'takes', if(least(a.queue + x.add, a.room[x.shard]) > 0,
                      concat(a.takes, array(named_struct('q0', a.done, 'q1', a.done + least(a.queue + x.add, a.room[x.shard]), 'shard', x.shard, 'base', a.kept[x.shard]))), a.takes)),
                  a -> a.takes)"""
            ).alias("takes")
        )
        .select(F.inline("takes"))
    )
    # Breaks of the queue, from either side, in order: between two breaks there is one cell and one take.
    breaks = load.where("over > 0").select("q", F.struct("cell", "q", "keep").alias("c"), F.lit(None).cast("struct<q0:bigint,shard:int,base:bigint>").alias("t")).unionByName(
        takes.select(F.col("q0").alias("q"), F.lit(None).cast("struct<cell:bigint,q:bigint,keep:bigint>").alias("c"), F.struct("q0", "shard", "base").alias("t"))
    )
    breaks = breaks.groupBy("q").agg(F.max("c").alias("c"), F.max("t").alias("t"))
    upto = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    end = load.agg(F.sum("over").alias("end"))
    moved = (
        breaks.select("q", F.last("c", ignorenulls=True).over(upto).alias("c"), F.last("t", ignorenulls=True).over(upto).alias("t"), F.lead("q").over(Window.orderBy("q")).alias("next"))
        .join(end)
        .select(
            F.col("c.cell").alias("cell"), (F.col("c.keep") + F.col("q") - F.col("c.q")).alias("r0"), (F.col("c.keep") + F.coalesce("next", "end") - F.col("c.q")).alias("r1"),
            F.col("t.shard").alias("shard"), (F.col("t.base") + F.col("q") - F.col("t.q0")).alias("base"),
        )
    )
    return load.where("keep > 0").select("cell", F.lit(0).cast("long").alias("r0"), F.col("keep").alias("r1"), "shard", F.col("prior").alias("base")).unionByName(moved)


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, virtual: int = VIRTUAL_NODES, cells: int = CELLS, many: int = MANY) -> DataFrame:
    """Shards of equal row counts, at most one apart (law rows): id, size, text_crc32, law, shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes (null: none) plus 16. A key is the id with the text's checksum, so a null or repeated id
    is no hot cell by itself. Equal texts of different ids are different keys, each placed by itself; equal rows take consecutive
    places in any order, and more than many of them travel as one. Rows move once, 40 bytes each, to rank them within their
    cell; every other table has a fixed size. Empty tables give empty ones; other columns are not read.
    """
    prepare(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = base.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text_crc32", "size")).withColumn("cell", F.pmod("h", F.lit(cells)).cast("long"))
    pieces = _pieces(_ring(df.sparkSession, shards, virtual, cells), rows.groupBy("cell").agg(F.count("*").alias("n")), shards, cells).withColumnRenamed("cell", "in_cell")
    key = ["h", "doc_id", "text_crc32", "size"]
    heavy = rows.groupBy("cell", *key).agg(F.count("*").alias("copies")).where(F.col("copies") > many)
    if not heavy.limit(1).count():
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(*key)) - 1)
        placed = ranked.join(pieces, (F.col("cell") == F.col("in_cell")) & (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")))
    else:  # ranks are those of the first of so many equal rows; those that a piece takes are told apart after the join
        before = Window.partitionBy("cell").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
        counted = rows.groupBy("cell", *key).agg(F.count("*").alias("copies")).withColumn("r", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        found = counted.join(pieces, (F.col("cell") == F.col("in_cell")) & (F.col("r") < F.col("r1")) & (F.col("r") + F.col("copies") > F.col("r0")))
        first, last = F.greatest("r", "r0"), F.least(F.col("r") + F.col("copies"), F.col("r1")) - 1
        step = found.withColumns({"first": first, "last": last}).withColumn("from", F.explode(F.sequence("first", "last", F.lit(SPREAD).cast("long"))))
        placed = step.drop("r").withColumn("r", F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + SPREAD - 1))))
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("r") - F.col("r0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
