"""Lexical and vector retrieval."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import dealt, prepare


#: Most query vectors that are held against all vectors at once.
MOST_QUERIES = 10_000
#: Terms of queries, each counted for every query that holds it, that are broadcast at once.
MOST_TERMS = 1 << 20
#: Numbers in a matrix of documents by queries, with the weights that go into it.
MATRIX = 1 << 22


def _sorted_terms(docs: DataFrame, text: str, *keep: str) -> tuple[DataFrame, Column]:
    """Each document's terms as a sorted array s, and s moved by one place. The generator has s evaluated once, not for each of its uses."""
    rows = dealt(docs.select(*keep, text)).select(*keep, F.explode(F.array(F.sort_array(tx.tokens(F.col(text))))).alias("s"))
    return rows, F.concat(F.array(F.lit(None).cast("string")), F.col("s"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl): how often a term is in a document, and how many terms that has. A narrow map: a document's terms are counted in its row."""
    rows, moved = _sorted_terms(docs, text, key)
    begins = F.filter(F.transform(F.zip_with("s", moved, lambda x, p: x.eqNullSafe(p)), lambda same, i: F.when(~same, i)), lambda i: i.isNotNull())  # and the end
    runs = rows.where(F.size("s") > 0).select(key, "s", F.explode(F.array(begins)).alias("b"))
    pairs = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b") - 1), lambda i, j: F.struct(i.alias("i"), (j - i).cast("long").alias("tf")))
    each = runs.select(key, "s", F.explode(pairs).alias("p"))
    return each.select(key, F.col("s")[F.col("p.i")].alias("term"), "p.tf", F.size("s").cast("long").alias("dl"))


def term_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, tf, n, idf): documents that hold a term, how often it is there, and idf = ln(1 + (n - df + 0.5) / (df + 0.5)), n being all documents."""
    rows, moved = _sorted_terms(docs, text)
    terms = rows.select(F.explode(F.zip_with("s", moved, lambda x, p: F.struct(x.alias("term"), (~x.eqNullSafe(p)).cast("int").alias("first")))).alias("t")).where("t.term is not null")
    df = terms.groupBy("t.term").agg(F.sum("t.first").alias("df"), F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, query_id: str = "query_id", query: str = "query", key: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """(query_id, key, score): BM25 over the greatest score of the query; documents without a term of it are left out.

    With k only the documents that can be among a query's k best, ranked by score to nine places and then by key: each task
    keeps those of its own documents, so pairs of queries and documents are not shuffled. Repeated query terms count again.
    Terms of queries are broadcast, MOST_TERMS at once; queries that hold more are taken in blocks, which read the documents anew.
    Two narrow passes over the tokens: how many documents hold a term, then the scores. Of rows that share a key those of one
    length are one document, and the scores of all its lengths are added up; only such rows are shuffled.
    """
    prepare(docs.sparkSession)
    asked = postings(queries, query_id, query).groupBy(query_id, "term").agg(F.sum("tf").alias("times"))
    blocks = max(1, -(-asked.count() // MOST_TERMS))
    tokens = dealt(docs.select(key, text)).select(F.col(key), tx.tokens(F.col(text)).alias("t"), F.lit(1).cast("long").alias("rows"))
    shared, lengths = None, 1
    repeated = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if repeated.limit(1).count():
        alike = tokens.join(repeated, key, "left_semi").groupBy(key, F.when(F.col("t").isNotNull(), F.size("t")).alias("dl")).agg(F.flatten(F.collect_list("t")).alias("t"), F.count("*").alias("rows"))
        shared = alike.select(key, F.when(F.col("dl").isNotNull(), F.col("t")).alias("t"), "rows")
        lengths = shared.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        tokens = tokens.join(repeated, key, "left_anti")
    raw = reduce(DataFrame.unionByName, [_raw_scores(asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i), tokens, shared, lengths, k1, b, query_id, key, k) for i in range(blocks)])
    if k:
        scaled = raw.withColumn("best", F.max("raw").over(Window.partitionBy(query_id)))
    else:
        scaled = raw.join(F.broadcast(raw.groupBy(query_id).agg(F.max("raw").alias("best"))), query_id)
    return scaled.select(query_id, key, F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(F.col("raw")).alias("score"))


def _held_terms(tokens: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the term, tf) of those terms that lists of tokens hold, by row and place; and the length of each list (null: 0)."""
    dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten()
    at = pc.fill_null(pc.index_in(flat, value_set=terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    pair, tf = np.unique((np.repeat(np.arange(len(dl)), dl) * len(terms) + at)[at >= 0], return_counts=True)
    return pair // len(terms), pair % len(terms), tf, dl


def _raw_scores(asked: DataFrame, tokens: DataFrame, shared: DataFrame | None, lengths: int, k1: float, b: float, query_id: str, key: str, k: int | None) -> DataFrame:
    """(query_id, key, raw): sums of weights of the asked terms (query_id, term, times), which are collected; of documents (key, t, rows).

    t: the tokens of as many rows of one length. shared: documents whose key is there more than once, for some as often as lengths says.
    """
    spark, schema = tokens.sparkSession, T.StructType([asked.schema[query_id], tokens.schema[key], T.StructField("raw", T.DoubleType())])
    table = asked.toArrow()
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    coded = table["term"].combine_chunks().dictionary_encode()
    terms, place = coded.dictionary, coded.indices.to_numpy()
    whose = table[query_id].combine_chunks().dictionary_encode(null_encoding="encode")
    ids, n_terms, n_queries = whose.dictionary, len(terms), len(whose.dictionary)
    order = np.lexsort((whose.indices.to_numpy(), place))
    owner, times, holders = whose.indices.to_numpy()[order].astype(np.int64), table["times"].to_numpy()[order], np.bincount(place, minlength=n_terms)
    known = spark.sparkContext.broadcast(terms)

    def count(batches):
        total = np.zeros(n_terms + 3, np.int64)
        for batch in batches:
            _, term, _, dl = _held_terms(batch.column(0), known.value)
            n = batch.column(1).to_numpy()
            total[:n_terms] += np.bincount(term, minlength=n_terms)
            total[n_terms:] += n.sum(), n[batch.column(0).is_valid().to_numpy(zero_copy_only=False)].sum(), dl.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    found = np.zeros(n_terms + 3, np.int64)
    every = tokens if shared is None else tokens.unionByName(shared)
    for r in every.select("t", "rows").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        found[r["term"]] = r["n"]
    df, (n, there, total) = found[:n_terms], found[n_terms:]
    average = max(total / max(there, 1), 1e-6)
    weight = times * np.repeat(np.log(1 + (n - df + 0.5) / (df + 0.5)), holders)
    # Scores nearer than that, over a score that no document exceeds, may be equal to nine places.
    near = 4e-9 * lengths * (k1 + 1) * np.bincount(owner, weight, minlength=n_queries)
    model = spark.sparkContext.broadcast((terms, holders, owner, weight, near, ids))

    def score(batches, k=k):
        terms, holders, owner, weight, near, ids = model.value
        begin, least, held, fresh = np.cumsum(holders) - holders, np.full(n_queries, -np.inf), [], 0
        for batch in batches:
            doc, term, tf, dl = _held_terms(batch.column(1), terms)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * (dl // batch.column(2).to_numpy())[doc] / average))
            each = holders[term]
            steps = np.cumsum(np.bincount(doc, each, minlength=len(dl)) + n_queries)
            start = 0
            while start < len(dl):
                end = max(start + 1, int(np.searchsorted(steps, (steps[start - 1] if start else 0) + MATRIX, "right")))
                lo, hi = np.searchsorted(doc, (start, end))
                m = each[lo:hi]
                at = np.repeat(begin[term[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                raw = np.bincount(np.repeat(doc[lo:hi] - start, m) * n_queries + owner[at], weight[at] * np.repeat(part[lo:hi], m), minlength=(end - start) * n_queries).reshape(-1, n_queries)
                d, q = np.nonzero((raw > 0) & (raw >= least))
                rows = pa.table([pa.array(q), batch.column(0).take(pa.array(d + start)), pa.array(raw[d, q])], names=["q", "key", "raw"])
                start = end
                if not k:
                    yield from _named(rows, ids, schema)
                    continue
                held.append(rows)
                fresh += len(q)
                if fresh > 2 * k * n_queries:
                    rows, least = _foremost(pa.concat_tables(held), k, near)
                    held, fresh = [rows], 0
        if held:
            yield from _named(_foremost(pa.concat_tables(held), k, near)[0], ids, schema)

    single = tokens.mapInArrow(score, schema)
    if shared is None:
        return single
    return single.unionByName(shared.mapInArrow(lambda batches: score(batches, None), schema).groupBy(query_id, key).agg(F.sum("raw").alias("raw")))


def _named(rows: pa.Table, ids: pa.Array, schema: T.StructType) -> list[pa.RecordBatch]:
    return pa.table([ids.take(rows["q"].combine_chunks()), rows["key"], rows["raw"]], names=schema.names).to_batches()


def _foremost(rows: pa.Table, k: int, near: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Rows (q, key, raw) without those that have k before them however scores are scaled and rounded, and what a row of each q must reach.

    Before a row are those of equal raw and smaller key, and those that are greater by more than near.
    """
    rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("raw", "descending"), ("key", "ascending")]))
    q, raw, at = rows["q"].to_numpy(), rows["raw"].to_numpy(), np.arange(rows.num_rows)
    new = np.concatenate(([True], q[1:] != q[:-1]))
    changed = new | np.concatenate(([True], raw[1:] != raw[:-1]))
    rank, same = at - np.maximum.accumulate(np.where(new, at, 0)), at - np.maximum.accumulate(np.where(changed, at, 0))
    least = np.full(len(near), -np.inf)
    last = rank == k - 1
    least[q[last]] = raw[last] - near[q[last]]
    return rows.filter(pa.array((rank < k) | ((raw >= least[q]) & (same < k)))), least


def top(scores: DataFrame, on: list[str], order: list[Column], k: int | None, limit: int | None = None) -> DataFrame:
    """Rows ranked 1 to k per key; k is at least 1 and at most limit; None or 0 is all."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*on).orderBy(*order)).cast("long"))
    if not k:
        return ranked
    return ranked.where(F.col("rank") <= max(1, min(k, limit or k)))


def cosine_scores(queries: DataFrame, vectors: DataFrame, query_id: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine of every stored query vector and every vector. The queries are broadcast: more than MOST_QUERIES, which are counted before, are an error; they are to be given in blocks."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; give them in blocks")
    q = queries.select(query_id, vx.normalized(vx.doubles(F.col(vector))).alias("__q"))
    return vectors.select(key, vx.normalized(vx.doubles(F.col(vector))).alias("__v")).join(F.broadcast(q)).select(query_id, key, vx.dot(F.col("__q"), F.col("__v")).alias("score"))


def embedded(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(key, embedding): texts (null: empty) through an encoder that each task makes once, rows of length one; a narrow map."""
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        encode = encoder()
        for b in batches:
            if b.num_rows:
                x = np.asarray(encode([t or "" for t in b.column(1).to_pylist()]), np.float32)
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def vectors_of(tasks: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tasks with their stored vector, and those that have none."""
    return tasks.join(vectors, key), tasks.join(vectors, key, "left_anti")
