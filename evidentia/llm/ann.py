"""Approximate nearest neighbours: inverted lists, scanned in blocks of rotated dimensions with early abandoning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, prepare, shared_checkpoint

#: Most vectors that the lists' centroids and the rotation are fitted on: the documented bound of the sample.
SAMPLE = 16384
#: Vectors of a list that one task scans at a time; longer lists are split.
CHUNK = 16384
#: Most coarse centroids; more lists than that come from centroids of residuals, so their number grows with the vectors'.
COARSE = 1024
#: Numbers in a matrix of queries by lists, and in one of queries by vectors.
MATRIX = 1 << 23
#: Numbers of the vectors, and of the queries, that a task of the exact check holds.
HELD = 1 << 22
#: A query probes as many lists, nearest first, as hold this share of the true neighbours of distinct queries tried on the sample.
FOUND, TRIED, LEAST_PROBES = 0.995, 128, 12
#: Columns of a block, and the test's bound: a candidate is abandoned if its partial distance over d of D dimensions is
#: above (1 + EPSILON / sqrt(d)) ** 2 * d / D of the distance to beat.
BLOCK, EPSILON = 16, 2.1
K, EVERY = 5, 50


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a list without members keeps its centroid."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


class Lists:
    """The lists' places: coarse centroids and, where there are to be more lists than those, centroids of what is left of a vector about its own."""

    def __init__(self, x: np.ndarray, lists: int, most: int):
        self.coarse = centroids(x, min(lists, most))
        self.fine = np.zeros((1, x.shape[1]))
        if lists > most:
            left = x - self.coarse[(x @ self.coarse.T).argmax(1)]
            self.fine = means(left, min(-(-lists // len(self.coarse)), max(1, len(x) // 8)))
        self.size = (self.fine * self.fine).sum(1)
        self.cross = self.coarse @ self.fine.T

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list that each vector is in."""
        c = (x @ self.coarse.T).argmax(1)
        f = (2 * (x - self.coarse[c]) @ self.fine.T - self.size).argmax(1)
        return c * len(self.fine) + f

    def nearest(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n lists that are nearest to each query, in order."""
        near = 2 * (q @ self.coarse.T)[:, :, None] + (2 * (q @ self.fine.T) - self.size)[:, None, :] - 2 * self.cross - (self.coarse * self.coarse).sum(1)[:, None]
        near = near.reshape(len(q), len(self))
        if n < len(self):
            some = np.argpartition(-near, n - 1, axis=1)[:, :n]
            return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
        return np.argsort(-near, axis=1, kind="stable")


def means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means; a centroid without members stays."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def probes_for(x: np.ndarray, lists: Lists, k: int, share: float) -> int:
    """How many lists hold the share of the k nearest of TRIED distinct rows of x, all others being candidates."""
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(9).permutation(len(x))]
    q = x[:TRIED]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    best = np.argpartition(-near, min(k, len(x) - 1), axis=1)[:, :k]
    of, place = lists.of(x), []
    for i in range(len(q)):  # a query at a time: there may be very many lists
        rank = np.empty(len(lists), np.int64)
        rank[lists.nearest(q[i : i + 1], len(lists))[0]] = np.arange(len(lists))
        place.append(rank[of[best[i]]])
    return 1 + int(np.quantile(np.concatenate(place), share, method="higher"))


def visited(lists: np.ndarray, sizes: np.ndarray, least: int, enough: bool = False) -> np.ndarray | None:
    """Of lists in order those that are not empty (enough: so many of them as hold the least number of vectors); None if they hold fewer."""
    lists = lists[sizes[lists] > 0]
    total = np.cumsum(sizes[lists])
    if enough:
        return lists[: np.searchsorted(total, least) + 1]
    return lists if len(lists) and total[-1] >= least else None


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision; the same for the same two vectors wherever they are scanned."""
    a, b = np.abs(q).max(), np.abs(x).max(1, keepdims=True)
    q, x = q / a, x / b
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def scan(q: np.ndarray, rotated: np.ndarray, near: float, k: int) -> np.ndarray:
    """Candidates of a rotated chunk that may be among the k nearest: blocks of columns, one test after each.

    near: the squared distance that is to be beaten (that of the k-th best so far). Candidates that the test abandons
    have a partial distance that a nearer vector has only with small probability, as a random rotation spreads distance evenly.
    """
    dim = len(q)
    left, partial, d = np.arange(len(rotated)), np.zeros(len(rotated)), 0
    while d < dim and len(left):
        end = min(dim, d + BLOCK)
        step = rotated[left, d:end] - q[d:end]
        partial = partial + (step * step).sum(1)
        d = end
        keep = partial <= near * (d / dim) * (1 + EPSILON / math.sqrt(d)) ** 2 + 1e-9 if d < dim else partial <= near + 1e-9
        left, partial = left[keep], partial[keep]
    if len(left) > k:
        last = np.partition(partial, k - 1)[k - 1]
        left = left[partial <= last + 1e-9]
    return left


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def distinct_vectors(rows: DataFrame, few: int) -> DataFrame:
    """v, ids of rows (id, v): each different vector with the least few of its ids, in order. A vector's copies are thinned out before the exchange."""
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= few)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, found: float = FOUND, sample: int = SAMPLE, coarse: int = COARSE, exact: bool = False) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score (cosine of the original vectors in double precision).

    Queries are the rows whose id is divisible by every; candidates all rows of other ids. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do null ids; where dimensions differ, a shorter vector counts as
    continued by zeros. Of rows with one id and different vectors the least vector counts; repeated rows are one candidate.
    Equal scores go to the smaller id. With fewer than k candidates all are returned; an empty table gives an empty one. Other
    columns are not read, so their names cannot clash.

    Copies of a vector are one entry of the index with its k + 1 least ids, and one query. The lists, some two for each root of the
    number of vectors, come from at most sample of them: coarse centroids, and beyond those the centroids of residuals. A long list is
    dealt to chunks by a hash of ids, so a popular list is not one task's; a query visits each chunk of its lists, keeping the best
    of each, and the best of all chunks are its result. Lists are visited until they hold k others, so none are missing.

    exact has a check follow: blocks of queries meet blocks of all vectors, and whatever is no farther than the last that the search
    found joins the result. That is quadratic in time; a task holds a block of each, and a query leaves a block with k + 1 rows at most.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    dim = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))).alias("v"))
    index = shared_checkpoint(distinct_vectors(rows, k + 1).select(F.col("ids")[0].alias("id"), "ids", "v"))
    n = index.count()
    share = min(1_000_000, int(1_000_000 * sample * 0.9 / n) + 1)
    picked = index.where(F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1_000_000)) < share).select("v").limit(sample).collect()
    turn = rotation(dim)
    fitted = unit(np.array([r["v"] for r in picked] or [[1.0] + [0.0] * (dim - 1)])) @ turn
    most = int(max(1, 2 * math.sqrt(n)))
    lists = Lists(fitted, most if most > coarse else min(most, max(1, len(fitted) // 8)), coarse)
    probes = min(len(lists), max(LEAST_PROBES, probes_for(fitted, lists, k, found)))
    shared = spark.sparkContext.broadcast((turn, lists))  # coarse and sample / 8 centroids at most

    def turned(batch, a, b):
        turn, lists = shared.value
        return lists, unit(np.stack(batch.column("v").slice(a, b - a).to_numpy(zero_copy_only=False))) @ turn

    def count(batches):
        total = np.zeros(len(shared.value[1]), np.int64)
        for b in batches:
            if b.num_rows:
                lists, x = turned(b, 0, b.num_rows)
                total += np.bincount(lists.of(x), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["list", "n"])

    sizes = np.zeros(len(lists), np.int64)
    for r in index.select("v").mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # a row a list
        sizes[r["list"]] = r["n"]
    known = spark.sparkContext.broadcast(sizes)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                lists, x = turned(b, 0, b.num_rows)
                of = lists.of(x)
                chunk = mix64(b.column("id").to_numpy().astype(np.uint64)) % np.ceil(known.value[of] / CHUNK).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(chunk.astype(np.int64)), b.column("ids"), b.column("v")], names=["list", "chunk", "ids", "v"])

    def probe(batches):
        for b in batches:
            step = max(1, MATRIX // len(shared.value[1]))
            for a in range(0, b.num_rows, step):
                lists, x = turned(b, a, min(b.num_rows, a + step))
                which = [visited(w, known.value, k + 1) for w in lists.nearest(x, probes)]
                few = [i for i, w in enumerate(which) if w is None]
                for i in few:  # these hold too few vectors: so many lists as hold enough
                    which[i] = visited(lists.nearest(x[i : i + 1], len(lists))[0], known.value, k + 1, enough=True)
                parts = [np.ceil(known.value[w] / CHUNK).astype(np.int64) for w in which]
                at = pa.array(np.repeat(np.arange(len(x)), [p.sum() for p in parts]) + a)
                chunks = np.concatenate([np.arange(m) for p in parts for m in p])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(w, p) for w, p in zip(which, parts, strict=True)])), pa.array(chunks), b.column("id").take(at), b.column("v").take(at)], names=["list", "chunk", "id", "v"])

    members = index.mapInArrow(assign, "list long, chunk long, ids array<long>, v array<double>")
    asked = rows.where(F.col("id") % every == 0).join(index.select("v", F.col("id").alias("of")), "v").select("id", "of")
    visits = index.join(asked.select(F.col("of").alias("id")).distinct(), "id", "left_semi").select("id", "v").mapInArrow(probe, "list long, chunk long, id long, v array<double>")

    def search(key, mine, asked):
        out = {"of": [], "vec_id": [], "score": []}
        if mine.num_rows and asked.num_rows:
            turn, _ = shared.value
            raw = np.stack(mine.column("v").to_numpy())
            copies = mine.column("ids").to_pylist()
            x = unit(raw) @ turn
            for of, q in zip(asked.column("id").to_pylist(), asked.column("v").to_numpy(), strict=True):
                at = (unit(q[None]) @ turn)[0]
                step = x[: 4 * k] - at
                seed = (step * step).sum(1)
                close = np.argsort(seed, kind="stable")[: k + 1]
                found = np.union1d(close, scan(at, x, seed[close[k]] if len(close) > k else np.inf, k + 1))
                score = cosines(q, raw[found])
                ids = np.array([i for f in found.tolist() for i in copies[f]], np.int64)
                score = np.repeat(score, [len(copies[f]) for f in found.tolist()])
                best = _best(ids, score, k + 1)
                out["of"] += [of] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += score[best].tolist()
        return pa.table(out, schema=pa.schema([("of", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    nearest = members.groupBy("list", "chunk").cogroup(visits.groupBy("list", "chunk")).applyInArrow(search, "of long, vec_id long, score double")
    best = nearest.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    if exact:
        best = confirmed(index, asked, shared_checkpoint(best.select("of", "vec_id", "score")), n, dim, k + 1)
    # The k + 1 nearest entries of a vector are those of all its copies; each leaves itself out.
    each = asked.join(best, "of").where("vec_id <> id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.select(F.col("id").alias("query_id"), "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def confirmed(index: DataFrame, asked: DataFrame, best: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """of, vec_id, score: the k nearest of each asked entry of the index among the ids of all entries, exactly. best: those that a search found."""
    block = max(1, HELD // dim)
    across, down = -(-n // block), -(-asked.select("of").distinct().count() // block)
    least = best.groupBy("of").agg(F.count("*").alias("m"), F.min("score").alias("least")).select("of", F.when(F.col("m") >= k, F.col("least")).otherwise(-2.0).alias("least"))
    part = lambda c, m, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    mine = index.select("ids", F.col("v").alias("x"), part("id", across, "across").alias("a")).withColumn("d", every(max(1, down)))
    theirs = index.join(least, F.col("id") == F.col("of")).select("of", "least", "v", part("id", max(1, down), "down").alias("d")).withColumn("a", every(across))

    def check(key, mine, theirs):
        out = {"of": [], "vec_id": [], "score": []}
        if mine.num_rows and theirs.num_rows:
            raw, copies = np.stack(mine.column("x").to_numpy()), mine.column("ids").to_pylist()
            x, q = unit(raw), np.stack(theirs.column("v").to_numpy())
            of, least = theirs.column("of").to_pylist(), theirs.column("least").to_numpy()
            step = max(1, MATRIX // len(x))
            for a in range(0, len(q), step):
                near = unit(q[a : a + step]) @ x.T
                for i, row in enumerate(near, a):
                    found = np.flatnonzero(row >= least[i] - 1e-9)
                    if len(found) > k:  # the block's own k-th is a bound as well, as each entry has an id at least
                        found = found[row[found] >= np.partition(row[found], len(found) - k)[len(found) - k] - 1e-9]
                    if len(found):
                        score = np.repeat(cosines(q[i], raw[found]), [len(copies[f]) for f in found])
                        ids = np.array([c for f in found for c in copies[f]], np.int64)
                        top = _best(ids, score, k)
                        out["of"] += [of[i]] * len(top)
                        out["vec_id"] += ids[top].tolist()
                        out["score"] += score[top].tolist()
        return pa.table(out, schema=pa.schema([("of", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    near = mine.groupBy("a", "d").cogroup(theirs.groupBy("a", "d")).applyInArrow(check, "of long, vec_id long, score double")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
