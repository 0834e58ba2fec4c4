"""Training-corpus pipeline: language ID, near-duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import langid, minhash, packing, secrets, suffixes
from evidentia.llm.common import delete_table, documents, prepare, shared_checkpoint, shared_table, slices

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language family is less likely than this is rejected, as are those without letters. Languages of a family share
#: words, so how sure the choice within it is does not count.
LEAST_SCORE = 0.5


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars to match."""
    return docs.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or of no likely language family.

    Null and empty texts have no letters. If no document has a language to learn from, only those without letters go. Null
    ids, sources and languages stay as they are; repeated rows are each judged alike; an empty table gives an empty one;
    columns beyond COLUMNS are left out, whatever their names.
    """
    prepare(spark)
    model = spark.sparkContext.broadcast(langid.train(docs))

    def likely(s: pd.Series) -> pd.Series:
        texts, out = [t or "" for t in s], []
        if not model.value.families:
            return pd.Series([langid.has_letter(t) for t in texts], dtype=bool)
        for a, b in slices([len(t) for t in texts]):
            lang, family, _ = model.value.decide(texts[a:b])
            out += [x != "und" and y >= LEAST_SCORE for x, y in zip(lang, family, strict=True)]
        return pd.Series(out, dtype=bool)

    return docs.select(*COLUMNS).where(F.pandas_udf(likely, "boolean")("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group (all rows of that id), and rows without an id.

    Null and empty texts are in no group and stay; an empty table gives an empty one; columns beyond COLUMNS are left out,
    whatever their names.
    """
    docs = docs.select(*COLUMNS)
    gone = shared_checkpoint(minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("id")).distinct())
    # Most documents stay, and a filter of fixed size tells so; only the others are shuffled.
    told = minhash.told_apart(docs.withColumnRenamed("doc_id", "id"), gone)
    rest = told.where("maybe").join(gone, "id", "left_anti")
    return told.where("not maybe").unionByName(rest).select(F.col("id").alias("doc_id"), *COLUMNS[1:])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand earlier; documents that lose all of their text go.

    A null text stays null and an empty one empty. Equal rows are one document, and each gets its result; a null id comes before
    all others; an empty table gives an empty one; columns beyond COLUMNS are left out, whatever their names.
    """
    docs = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("none"))
    cut = suffixes.remove_repeats(docs, extra=["lang", "source", "none"]).where("n_removed = 0 or kept_text <> ''")
    return _with_text(cut, F.when(~F.col("none"), F.col("kept_text")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; every row stays, null and empty texts and repeated rows as they are.

    An empty table gives an empty one; columns beyond COLUMNS are left out, whatever their names.
    """
    return _with_text(docs, secrets.redacted(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces (doc_id, piece, start, length, ids_crc32, ids) with their places (sequence_id, offset) in sequences of 2048.

    A null or empty text is the closing token alone; repeated rows and rows without an id are packed each for itself; an
    empty table gives an empty one; other columns are not read, whatever their names.
    """
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Trained models, components and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents, each written to the shared folder and read by the next; a table goes once the next is written."""
    docs, path = documents(spark, sf_dir).select(*COLUMNS), None
    for k, (_, stage) in enumerate(STAGES):
        made, before = stage(spark, docs, sf_dir), path
        if k < len(STAGES) - 1:
            docs, path = shared_table(made)
        if before:  # the last stage has its token pieces checkpointed by now
            delete_table(spark, before)
    return made
