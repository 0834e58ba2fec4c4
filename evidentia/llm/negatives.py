"""Hard negatives by exact inner products: a pivot table brackets every score, and what the brackets leave is checked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, prepare, shared_checkpoint

#: Pivots, each also the centre of a cell of rows; they are chosen from a sample of at most SAMPLE rows, of which the scores also give
#: first bounds of what an anchor's results must reach. Both are bounds of what is broadcast, not of what is searched.
PIVOTS, SAMPLE = 16, 4096
#: Numbers in the vectors of a chunk of a cell, anchors of a block, and pairs that are bracketed at a time.
CHUNK_NUMBERS, ANCHORS, PAIRS = 1 << 22, 8192, 1 << 20
EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score is from LEAST to MOST hundredths of its positive's.
LEAST, MOST = 30, 90
SCALE = 256


def whole_numbers(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as a double; null for a vector that is null, holds a null or non-finite component, or has a scaled squared length of 2 ** 62 or more, with which scores would leave 64 bits."""
    x = F.transform(v, lambda c: c.cast("double") * scale)
    fine = ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    short = F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c) < float(1 << 62)
    return F.when(fine & short, F.transform(x, lambda c: F.floor(c)))


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """Places of k rows, each the farthest from those before it."""
    at = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(at) < min(k, len(x)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return np.array(at)


class PivotTable:
    """Pivots in the space of one more dimension, in which a row's length is the longest row's and an anchor's is its own: the nearer, the higher the inner product.

    With M the longest row's length, a row x becomes (x, sqrt(M * M - |x| ** 2)) and an anchor q becomes (q, 0), so their squared distance is M * M + |q| ** 2 - 2 q.x.
    """

    def __init__(self, sample: np.ndarray, most: int, pivots: int):
        self.most = float(most)
        rows = self.augmented(sample)
        self.at = rows[spread_out(rows, pivots)]
        self.size = (self.at * self.at).sum(1)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(1)))))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + self.size - 2 * x @ self.at.T))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._distances(self.augmented(x))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack((q, np.zeros(len(q)))))

    def slack(self, q: np.ndarray) -> np.ndarray:
        """More than rounding moves a bound of each anchor's scores."""
        return 1 + 1e-6 * (self.most + (q * q).sum(1))

    def bracket(self, size: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score at distances up to far and from near on, for anchors of the squared length in size."""
        return (self.most + size - far * far) / 2, (self.most + size - near * near) / 2


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by doubles where those hold every sum, else by 64-bit integers."""
    if len(q) and len(x) and float((q.astype(float) ** 2).sum(1).max()) * float((x.astype(float) ** 2).sum(1).max()) < float(1 << 104):
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def kth(found: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """In each row the k-th greatest of what is ok, as a double; minus infinity where there are fewer."""
    if found.shape[1] < k:
        return np.full(len(found), -np.inf)
    return np.partition(np.where(ok, found.astype(float), -np.inf), found.shape[1] - k, axis=1)[:, found.shape[1] - k]


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score for each positive score; of a negative positive score none is in it. Hundreds apart, so that no product leaves 64 bits."""
    hundreds, rest = positive // 100, positive % 100
    return LEAST * hundreds - (-LEAST * rest // 100), MOST * hundreds + MOST * rest // 100


def first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score, then id."""
    at = np.arange(len(ids))
    if len(ids) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def stacked(column) -> np.ndarray:
    """The rows of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def survivors(table: PivotTable, q: np.ndarray, of_q: np.ndarray, of_x: np.ndarray, mask: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """mask without the pairs whose score cannot be from least to most of the anchor, a pivot at a time; what is left must be checked."""
    size, slack = (q.astype(float) ** 2).sum(1)[:, None], table.slack(q.astype(float))[:, None]
    lo, hi = least[:, None] - slack, most[:, None] + slack
    # As distances from the anchor: between these two a row may be.
    near, far = np.sqrt(np.maximum(0.0, table.most + size - 2 * hi)), np.sqrt(np.maximum(0.0, table.most + size - 2 * np.maximum(lo, -1e300)))
    for p in range(of_q.shape[1]):
        a, b = of_q[:, p, None], of_x[None, :, p]
        mask &= (np.abs(a - b) <= far) & (a + b >= near)
        if not mask.any():
            break
    return mask


def checked(q: np.ndarray, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs in mask: all of a block's rows that any anchor has left, or pair by pair where they are few."""
    i, j = np.nonzero(mask)
    if len(i) * 32 < mask.size:
        return i, j, (q[i] * x[j]).sum(1) if len(i) else np.zeros(0, np.int64)
    some = np.flatnonzero(mask.any(0))
    place = np.zeros(mask.shape[1], np.int64)
    place[some] = np.arange(len(some))
    return i, j, scores(q, x[some])[i, place[j]]


def blocks(n: int, rows: int) -> list[tuple[int, int]]:
    step = max(1, PAIRS // max(1, rows))
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, pivots: int = PIVOTS, sample: int = SAMPLE, numbers: int = CHUNK_NUMBERS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (ids divisible by every) and each of its first positives, the hardest negatives.

    Scores are inner products of the vectors' whole numbers (whole_numbers), higher first, ties by smaller id. Positives are other rows of
    the anchor's label, negatives rows of other labels with 30 * positive_score <= 100 * negative_score <= 90 * positive_score; a positive
    without such rows, as every one of a negative score is, gives no row. Rows with a null id, label or vector, or a null or non-finite component, take no
    part, nor do vectors whose scores would leave 64 bits; an empty or shorter vector counts as continued by zeros. Of rows with one id the
    least by label and vector counts. An empty table gives an empty one. Other columns are not read, so their names cannot clash.

    The result is exact. Each row's distances to the pivots are stored with it; a row belongs to the cell of its nearest pivot. For an
    anchor, scores with the sampled rows bound what a result must reach, the triangle inequality over a cell's least and greatest
    distances says which cells it must visit, and over a row's stored distances which rows it must check. Cells are dealt to chunks by a
    hash of ids and anchors to blocks, so neither a popular cell nor the anchors of a large table are one task's; a chunk gives
    each anchor its first few rows only, and the first of all chunks are the result.
    """
    spark = df.sparkSession
    prepare(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole_numbers(F.col(f"`{vector_col}`")).alias("v")).where("id is not null and label is not null and v is not null")
    rows = shared_checkpoint(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"))
    n, asking, dim, most = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c))).first()
    if not asking:
        return spark.createDataFrame([], schema)
    dim = max(1, dim)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    share = min(1 << 30, int((1 << 30) * 0.9 * sample / n) + 1)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("pivots")), F.lit(1 << 30)) < share).limit(sample).collect()
    known = {"id": np.array([r["id"] for r in picked], np.int64), "label": np.array([r["label"] for r in picked], np.int64), "v": np.array([r["v"] for r in picked], np.int64).reshape(len(picked), dim)}
    table = PivotTable(known["v"].astype(float) if len(picked) else np.zeros((1, dim)), most, pivots)
    shared = spark.sparkContext.broadcast((table, known))  # sample and pivots at most

    def measure(batches):
        table, _ = shared.value
        for b in batches:
            x = stacked(b.column("v"))
            if len(x):
                d = table.of_rows(x.astype(float))
                stored = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), pa.array(d.argmin(1)), stored], names=["id", "label", "v", "cell", "d"])

    index = shared_checkpoint(rows.mapInArrow(measure, "id long, label long, v array<long>, cell long, d array<double>"))
    bounds = index.select("cell", F.posexplode("d").alias("p", "x")).groupBy("cell", "p").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()  # pivots squared at most
    cells = {"lo": np.full((len(table.at), len(table.at)), np.inf), "hi": np.zeros((len(table.at), len(table.at))), "parts": np.zeros(len(table.at), np.int64)}
    rows_a_chunk = max(1, numbers // dim)
    for r in bounds:
        cells["lo"][r["cell"], r["p"]], cells["hi"][r["cell"], r["p"]], cells["parts"][r["cell"]] = r["lo"], r["hi"], -(-r["n"] // rows_a_chunk)
    told = spark.sparkContext.broadcast(cells)
    groups = -(-asking // anchors)  # ids are dealt to blocks of anchors by a hash

    parts = F.element_at(F.array(*[F.lit(int(x)) for x in np.maximum(1, cells["parts"])]), F.col("cell").cast("int") + 1)
    members = index.withColumn("chunk", F.pmod(F.xxhash64("id"), parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = index.where(F.col("id") % every == 0)

    def visit(bounded):
        """Sends each anchor to the chunks of cells that may hold a score in its bounds."""

        def run(batches):
            table, known = shared.value
            cells = told.value
            for b in batches:
                for a, e in blocks(b.num_rows, len(known["id"]) + len(table.at) ** 2):
                    part = b.slice(a, e - a)
                    q = stacked(part.column("v"))
                    least, most = bounded(part, q, known)
                    size, of_q, slack = (q.astype(float) ** 2).sum(1)[:, None], stacked(part.column("d")), table.slack(q.astype(float))[:, None]
                    near = np.maximum(0.0, np.maximum(cells["lo"] - of_q[:, None, :], of_q[:, None, :] - cells["hi"]).max(2))
                    lo, hi = table.bracket(size, near, (of_q[:, None, :] + cells["hi"]).min(2))
                    go = (hi >= least[:, None] - slack) & (lo <= most[:, None] + slack) & (cells["parts"] > 0) & (least <= most)[:, None]
                    i, c = np.nonzero(go)
                    many = cells["parts"][c]
                    i, c, chunk = np.repeat(i, many), np.repeat(c, many), np.concatenate([np.arange(m) for m in many.tolist()] or [np.zeros(0, np.int64)])
                    block = mix64(part.column("id").to_numpy().astype(np.uint64)) % np.uint64(groups)
                    sent = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(chunk.astype(np.int64)), pa.array(block.astype(np.int32)[i]), *(sent.column(k) for k in ("id", "label", "v", "d")), pa.array(least[i]), pa.array(most[i]), *([sent.column("wanted")] if "wanted" in part.schema.names else [])], names=["cell", "chunk", "block", "id", "label", "v", "d", "least", "most", *(["wanted"] if "wanted" in part.schema.names else [])])

        return run

    def held(left, right):
        """(rows of x, block of anchors, pairs' mask with bounds) of a chunk."""
        table, _ = shared.value
        x, of_x, ids, label = stacked(left.column("v")), stacked(left.column("d")), left.column("id").to_numpy(), left.column("label").to_numpy()
        for a, e in blocks(right.num_rows, len(x)):
            part = right.slice(a, e - a)
            q, of_q = stacked(part.column("v")), stacked(part.column("d"))
            same = part.column("label").to_numpy()[:, None] == label
            yield x, of_x, ids, part, q, of_q, same, (part.column("least").to_numpy(), part.column("most").to_numpy()), table

    def reach(part, q, known):
        """Least score of an anchor's positives that the sample proves."""
        ok = (part.column("label").to_numpy()[:, None] == known["label"]) & (part.column("id").to_numpy()[:, None] != known["id"])
        return kth(scores(q, known["v"]), ok, positives), np.full(len(q), np.inf)

    def find_positives(key, left, right):
        out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if left.num_rows and right.num_rows:
            for x, of_x, ids, part, q, of_q, same, (least, most), table in held(left, right):
                anchor = part.column("id").to_numpy()
                i, j, s = checked(q, x, survivors(table, q, of_q, of_x, same & (anchor[:, None] != ids), least, most))
                cut = np.searchsorted(i, np.arange(len(q) + 1))
                for k in range(len(q)):
                    at = slice(cut[k], cut[k + 1])
                    best = first(ids[j[at]], s[at], positives)
                    out["anchor_id"] += [anchor[k]] * len(best)
                    out["positive_id"] += ids[j[at]][best].tolist()
                    out["positive_score"] += s[at][best].tolist()
        return pa.table(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    in_chunks = lambda visits: members.groupBy("cell", "chunk", "block").cogroup(visits.groupBy("cell", "chunk", "block"))
    sent = "cell long, chunk long, block int, id long, label long, v array<long>, d array<double>, least double, most double"
    # An anchor's distances are those of the anchor, not of the row it is too.
    queries = shared_checkpoint(asked.select("id", "label", "v").mapInArrow(_as_anchors(shared), "id long, label long, v array<long>, d array<double>"))
    found = in_chunks(queries.mapInArrow(visit(reach), sent)).applyInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    kept = shared_checkpoint(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))

    def reach_windows(part, q, known):
        """Bounds of all windows of an anchor, the lower ones raised to what the sample proves, which are also put in wanted."""
        wanted = part.column("wanted").to_pylist()
        other = part.column("label").to_numpy()[:, None] != known["label"]
        score = scores(q, known["v"])
        least, most = np.full(len(q), np.inf), np.full(len(q), -np.inf)
        for place in range(positives):
            lo, hi = windows(np.array([w[place] if place < len(w) else -1 for w in wanted], np.int64))
            some = lo <= hi
            proven = np.maximum(lo, kth(score, other & (score >= lo[:, None]) & (score <= hi[:, None]), negatives))
            least, most = np.where(some, np.minimum(least, proven), least), np.where(some, np.maximum(most, hi), most)
        return least, most

    def find_negatives(key, left, right):
        out: dict[str, list] = {"anchor_id": [], "place": [], "negative_id": [], "negative_score": []}
        if left.num_rows and right.num_rows:
            for x, of_x, ids, part, q, of_q, same, (least, most), table in held(left, right):
                anchor, wanted = part.column("id").to_numpy(), part.column("wanted").to_pylist()
                i, j, s = checked(q, x, survivors(table, q, of_q, of_x, ~same, least, most))
                floor = least - 1 - 1e-9 * np.abs(least)  # as a double it may be above the whole number that it stands for
                cut = np.searchsorted(i, np.arange(len(q) + 1))
                for k in range(len(q)):
                    mine, score = ids[j[cut[k] : cut[k + 1]]], s[cut[k] : cut[k + 1]]
                    for place, (lo, hi) in enumerate(zip(*windows(np.array(wanted[k], np.int64)), strict=True)):
                        at = np.flatnonzero((score >= max(lo, floor[k])) & (score <= hi))
                        best = at[first(mine[at], score[at], negatives)]
                        out["anchor_id"] += [anchor[k]] * len(best)
                        out["place"] += [place + 1] * len(best)
                        out["negative_id"] += mine[best].tolist()
                        out["negative_score"] += score[best].tolist()
        return pa.table(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    wanted = kept.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("wanted"))
    visits = queries.join(wanted.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", "d", "wanted").mapInArrow(visit(reach_windows), f"{sent}, wanted array<long>")
    found = in_chunks(visits).applyInArrow(find_negatives, "anchor_id long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(kept, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _as_anchors(shared):
    def run(batches):
        table, _ = shared.value
        for b in batches:
            q = stacked(b.column("v"))
            if len(q):
                d = table.of_anchors(q.astype(float))
                stored = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), stored], names=["id", "label", "v", "d"])

    return run


#: Rows whose id is divisible by RELABELLED have the next of LABELS labels.
RELABELLED, LABELS = 7, 10


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.withColumn("label", label))
