"""Near-duplicate vectors: flat graphs on overlapping cluster shards, one union of adjacency lists, range-expanding searches, verified links."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import Lists, unit, usable
from .common import prepare, shared_checkpoint
from .components import components
from .graph import FlatGraph
from .negatives import stacked

#: A link.
LEAST = 0.95
#: Vectors that the clusters and the hot balls are fitted on, and vectors that recall is audited on: bounds of what is broadcast.
SAMPLE, AUDITED = 8192, 512
#: Vectors of a cluster on average, clusters that a vector is put in at first, members of a shard that one task takes whole; larger shards are dealt to pairs of halves of that.
CLUSTER, OVERLAP, SHARD = 768, 3, 4096
#: Coarse centroids; more clusters than that come from centroids of residuals.
COARSE = 1024
#: Members of a ball in the sample, and balls.
HOT, BALLS = 32, 512
#: The audited share of links that must be found; else clusters overlap more and lists are twice as long, in up to ROUNDS rounds.
RECALL, ROUNDS = 0.99, 3
#: What rounding may move an angle or a similarity in single precision.
ROUNDING = 1e-9


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def hot_balls(x: np.ndarray, reach: float, hot: int = HOT, most: int = BALLS) -> np.ndarray:
    """Centres of balls of the angle reach that hold at least hot of the sample, the fullest first; none is in another's members."""
    y = x.astype(np.float32)
    near = math.cos(reach)
    i, j = (np.concatenate(z) for z in zip(*[(lambda at: (at[0] + a, at[1]))(np.nonzero(y[a : a + 512] @ y.T >= near)) for a in range(0, len(y), 512)], strict=True))
    many, begin = np.bincount(i, minlength=len(x)), np.searchsorted(i, np.arange(len(x)))
    free, out = np.ones(len(x), bool), []
    for k in np.argsort(-many, kind="stable").tolist():
        if many[k] < hot or len(out) == most:
            break
        mine = j[begin[k] : begin[k] + many[k]]
        mine = mine[free[mine]]
        if len(mine) >= hot:
            c = unit(x[mine].mean(0, keepdims=True))
            mine = np.flatnonzero(free & (x @ c[0] >= near))
            if len(mine) >= hot:
                free[mine] = False
                out.append(c[0])
    return np.array(out).reshape(len(out), x.shape[1])


def local_least(n: int, a: np.ndarray, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The least rep of each node's component, the links being a to b."""
    label = rep.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, sample: int = SAMPLE, cluster: int = CLUSTER, overlap: int = OVERLAP, shard: int = SHARD, coarse: int = COARSE, hot: int = HOT, recall: float = RECALL) -> DataFrame:
    """A row for each vector: id, n_links (other vectors at a cosine of at least least, in double precision), component_id (least id reachable), kept (it is the id).

    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing; where dimensions differ, a shorter
    vector counts as continued by zeros. Rows of one id are one vector, the least usable one. Rows with a null id are returned each, without
    links: their component_id is null and they are kept. Other columns are not read; an empty table gives an empty one.

    Equal vectors are one node with their number. Balls of half a link's angle that hold many vectors (found in the sample) are linked
    throughout by the triangle inequality of angles, so their members are counted, not compared; members too far inside to be linked with anything
    outside go no further. Each other node is put in its nearest clusters; a shard builds a graph on its members, the lists of all shards are united,
    and each node is searched for in its shards from their medoids, expanding all that is in range. A pair is counted in the first
    shard that both are in, after its cosine is verified, and a shard gives each node a number and a label, so no pair leaves a task. The result is
    audited against brute force for a fixed number of vectors; if too few links are found, clusters overlap twice as much and searches are twice
    as long. If that is not enough after ROUNDS rounds, a warning says so.
    """
    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("v")).withColumn("v", F.when(usable(F.col("v")), F.col("v")))
    each = shared_checkpoint(rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v")))
    nodes = shared_checkpoint(each.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    found = spark.createDataFrame([], "node long, links long, label long")
    if n:
        points = nodes.select("node", "copies", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))).alias("v"))
        ids = nodes.select("node", "id")
        index = Balls(points, n, dim, least, sample, hot)
        for attempt in range(ROUNDS):
            found = _linked(index, ids, least, cluster, overlap << attempt, shard, coarse, attempt)
            share = audited_recall(points, found, n, least)
            if share >= recall:
                break
        else:
            warnings.warn(f"near_duplicate_vectors: audited recall {share:.4f} is below {recall}", stacklevel=2)
    # Labels are ids: components take the least.
    of = nodes.join(found, "node", "left").select("v", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "copies", F.coalesce("label", "id").alias("label"))
    known = each.join(of, "v", "left").select("id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long")).alias("n_links"), F.coalesce("label", "id").cast(kind).alias("component_id"))
    unnamed = rows.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(unnamed).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


class Balls:
    """The nodes with their balls: what later steps need of those that a ball does not settle, and the balls' own links."""

    def __init__(self, points: DataFrame, n: int, dim: int, least: float, sample: int, hot: int):
        self.spark, self.points, self.theta = points.sparkSession, points, math.acos(least)
        share = min(1 << 30, int((1 << 30) * 0.9 * sample / n) + 1)
        picked = points.where(F.pmod(F.xxhash64("node", F.lit("clusters")), F.lit(1 << 30)) < share).select("v").limit(sample).collect()
        self.sample = unit(np.array([r["v"] for r in picked] or [[1.0] + [0.0] * (dim - 1)]))
        half, theta = self.theta / 2 - ROUNDING, self.theta
        centres = hot_balls(self.sample, half, hot)
        shared = self.spark.sparkContext.broadcast(centres)

        def place(batches):
            centres = shared.value
            for b in batches:
                x = unit(stacked(b.column("v")))
                far = angles(x @ centres.T)
                ball = far.argmin(1)
                depth = far[np.arange(len(x)), ball]
                ball = np.where(depth <= half, ball, -1)
                around = [[(int(k), float(row[k])) for k in np.flatnonzero((row <= half + theta + ROUNDING) & (np.arange(len(row)) != own))] for row, own in zip(far, ball, strict=True)]
                kind = pa.list_(pa.struct([("ball", pa.int64()), ("depth", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("v"), pa.array(ball), pa.array(depth), pa.array([[{"ball": k, "depth": d} for k, d in r] for r in around], kind)], names=["node", "copies", "v", "ball", "depth", "around"])

        self.inside = self.stars = None
        self.open, self.n = points.withColumn("ball", F.lit(-1).cast("long")), n
        if len(centres):
            placed = shared_checkpoint(points.mapInArrow(place, "node long, copies long, v array<double>, ball long, depth double, around array<struct<ball: long, depth: double>>"))
            total = placed.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("size"), F.min("node").alias("first"))
            nearest = placed.select(F.explode("around").alias("a")).groupBy(F.col("a.ball").alias("ball")).agg(F.min("a.depth").alias("outside"))
            balls = shared_checkpoint(total.join(nearest, "ball", "left"))  # BALLS rows at most
            known = placed.join(F.broadcast(balls), "ball", "left")
            settled = F.col("ball").isNotNull() & (F.col("ball") >= 0) & (F.col("outside").isNull() | (F.col("depth") < F.col("outside") - theta - ROUNDING))
            self.inside = known.where("ball >= 0").select("node", (F.col("size") - F.col("copies")).alias("links"))
            self.stars = known.where("ball >= 0 and node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
            self.open = shared_checkpoint(known.where(~settled).select("node", "copies", "v", "ball"))
            self.n = self.open.count()


def _linked(index: Balls, ids: DataFrame, least: float, cluster: int, overlap: int, shard: int, coarse: int, attempt: int) -> DataFrame:
    """node, links, label (least id) of all nodes that have links, by shards of index.open and by balls."""
    spark = index.spark
    many = max(1, -(-index.n // cluster))
    lists = Lists(index.sample, many if many > coarse else min(many, max(1, len(index.sample) // 8)), coarse)
    overlap, beam = min(overlap, len(lists)), 32 << attempt
    shared = spark.sparkContext.broadcast(lists)

    def assign(batches):
        lists = shared.value
        for b in batches:
            step = max(1, (1 << 23) // len(lists))
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                near = np.sort(lists.nearest(unit(stacked(part.column("v"))), overlap), axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, overlap), pa.int32()), pa.array(near.ravel().astype(np.int64)))], names=[*part.schema.names, "shards"])

    dealt = shared_checkpoint(index.open.mapInArrow(assign, "node long, copies long, v array<double>, ball long, shards array<long>"))
    sizes = dealt.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("size"))
    large = shared_checkpoint(sizes.where(F.col("size") > shard).select("shard", F.ceil(F.col("size") / (shard // 2)).alias("parts")))
    split = large.limit(1).count() > 0

    def in_shards(rows: DataFrame) -> DataFrame:
        one = rows.withColumn("shard", F.explode("shards"))
        if not split:
            return one.withColumn("i", F.lit(0).cast("long")).withColumn("j", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long"))
        one = one.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        other = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.col("part")))
        return one.withColumn("k", F.explode(other)).withColumn("i", F.least("k", "part")).withColumn("j", F.greatest("k", "part")).drop("k", "parts")

    def build(key, table):
        node = table.column("node").to_numpy()
        near = FlatGraph(unit(stacked(table.column("v"))), beam=beam).build().near
        return pa.table([pa.array(node), pa.array([node[r[r >= 0]].tolist() for r in near], pa.list_(pa.int64()))], names=["node", "near"])

    united = in_shards(dealt.select("node", "v", "shards")).groupBy("shard", "i", "j").applyInArrow(build, "node long, near array<long>").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # DEGREE a shard at most

    def search(key, table):
        owner, i, j = (k.as_py() for k in key)
        node, copies, ball, part = (table.column(c).to_numpy() for c in ("node", "copies", "ball", "part"))
        raw, shards = stacked(table.column("v")), stacked(table.column("shards"))
        graph = FlatGraph(unit(raw), beam=beam)
        graph.near = _local(node, table.column("near").combine_chunks())
        a, b = graph.within(np.arange(len(node)), least - 1e-5)
        key = np.unique(np.minimum(a, b).astype(np.int64) * len(node) + np.maximum(a, b))
        a, b = key // len(node), key % len(node)
        at = [np.zeros(0, bool)]
        for s in range(0, len(a), 1 << 15):
            x, y = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
            both = np.where((shards[x][:, :, None] == shards[y][:, None, :]).any(2), shards[x], np.iinfo(np.int64).max).min(1) == owner
            if i != j:  # two parts of the shard: pairs within a part count where it meets the first other one
                both &= (part[x] != part[y]) | (np.where(part[x] == i, j, i) == np.where(part[x] == 0, 1, 0))
            both &= (ball[x] < 0) | (ball[x] != ball[y])
            both &= np.array([bool(c >= least) for c in pair_cosines(raw[x], raw[y])], bool)
            at.append(both)
        keep = np.concatenate(at)
        a, b = a[keep], b[keep]
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        some = links > 0
        return pa.table([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(local_least(len(node), a, b, node)[some])], names=["node", "links", "least"])

    parts = in_shards(dealt.join(united, "node")).groupBy("shard", "i", "j").applyInArrow(search, "node long, links long, least long")
    parts = shared_checkpoint(parts)
    links, stars = parts.select("node", "links"), parts.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    if index.inside is not None:
        links, stars = links.unionByName(index.inside), stars.unionByName(index.stars)
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(stars)
    least_id = label.join(ids, "node").groupBy("label").agg(F.min("id").alias("least_id"))
    named = label.join(least_id, "label").select("node", F.col("least_id").alias("label"))
    return shared_checkpoint(total.join(named, "node", "left"))


def pair_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows in double precision, each scaled by its largest component first."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _local(node: np.ndarray, near: pa.ListArray) -> np.ndarray:
    """The united lists as places among the shard's own nodes, the others left out."""
    order = np.argsort(node)
    flat, many = near.flatten().to_numpy(), np.diff(near.offsets.to_numpy())
    at = np.minimum(np.searchsorted(node[order], flat), len(node) - 1)
    ok = node[order][at] == flat
    row = np.repeat(np.arange(len(node)), many)[ok]
    many = np.bincount(row, minlength=len(node))
    out = np.full((len(node), max(1, many.max())), -1, np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = order[at[ok]]
    return out


def audited_recall(points: DataFrame, found: DataFrame, n: int, least: float, tried: int = AUDITED) -> float:
    """Share of the links of a fixed number of nodes, counted by brute force in one narrow pass, that were found; 1 if they have none."""
    share = min(1 << 30, int((1 << 30) * 0.9 * tried / n) + 1)
    mine = points.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) < share).select("node", "v").limit(tried).collect()
    if not mine:
        return 1.0
    shared = points.sparkSession.sparkContext.broadcast((np.array([r["node"] for r in mine]), unit(np.array([r["v"] for r in mine]))))

    def count(batches):
        node, q = shared.value
        total = np.zeros(len(q), np.int64)
        for b in batches:
            if b.num_rows:
                near = (q @ unit(stacked(b.column("v"))).T >= least) & (node[:, None] != b.column("node").to_numpy())
                total += near @ b.column("copies").to_numpy()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(total[at])], names=["node", "links"])

    true = points.mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    both = true.join(found, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0).cast("long"))))).first()  # tried rows at most
    return 1.0 if not both[0] else both[1] / both[0]


def op11_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
