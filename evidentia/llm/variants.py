"""Spelling variants: words one error apart, found by forward and backward automata of words that share a half."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt
from .automaton import Automaton
from .common import documents, prepare, shared_checkpoint, slices, text_sizes

#: Code points of a word at least, and its occurrences.
LETTERS, OFTEN = 6, 5
#: Of so many hashes of a document's word one is misspelt: a code point of it goes.
MISSPELT = 199
#: A word's form has at least so many times its occurrences.
TIMES = 5
#: Code points of the prefix or suffix that words of an automaton share at least: half of the least length.
SHARED = LETTERS // 2
#: Words of an automaton on average, words of one prefix or suffix that are not split further, and distinct words that a task counts before it sends them.
BUCKET, LARGE, HELD = 8192, 16384, 200_000

RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")


def misspelt(word: str, start: int) -> str:
    """The word, or without one code point where the hash, continued from that of what comes before it, says so."""
    h = zlib.crc32(word.encode(), start)
    return word if h % MISSPELT else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least LETTERS code points of all whole texts with how often they are there; each task counts before it sends."""
    prepare(df.sparkSession)

    def run(batches):
        total: Counter[str] = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for a, b in slices(text_sizes(batch.column(1))):
                for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    if text:
                        start = zlib.crc32(f"{key or ''}:".encode())
                        # bytes.lower is for A-Z only. A long text's runs are counted as they come.
                        for w, n in Counter(m.group() for m in RUN.finditer(text.encode().lower().decode())).items():
                            if len(w := misspelt(w, start)) >= LETTERS:
                                total[w] += n
                if len(total) >= HELD:
                    yield flushed()
        yield flushed()

    rows = dealt(df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of a group: direction, length, window, and what all its words share before and after the window."""
    before, after = F.expr("substring(word, 1, a)"), F.expr("right(word, greatest(l - b, 0))")
    return rows.withColumn("key", F.xxhash64("way", "l", "a", "b", before, after))


def _groups(words: DataFrame, large: int) -> DataFrame:
    """word, n, way, key, a, b, asks: the automata that a word belongs to, and the window of places of the error for which it looks there.

    Two words one error apart first differ at one place of the shorter (of either, if they are of one length). If that is in its second half
    they share SHARED code points from the start, else so many from the end: a forward and a backward group hold each pair, and the place
    says in which it counts. A group of too many words is split: by the shorter's length and whole half, then by halves of what is left of
    the window, the shared part growing, until it is small or its words differ in one place only. So each pair still has one group.
    """
    m = F.char_length("word")
    half = lambda length: F.floor(length / 2)
    ways = F.array(
        F.struct(F.lit(True).alias("way"), F.expr(f"xxhash64(true, substring(word, 1, {SHARED}))").alias("key"), half(m).alias("a"), (m + 1).cast("long").alias("b")),
        F.struct(F.lit(False).alias("way"), F.expr(f"xxhash64(false, right(word, {SHARED}))").alias("key"), F.lit(0).cast("long").alias("a"), half(m).alias("b")),
    )
    rows = words.select("word", "n", F.explode(ways).alias("g")).select("word", "n", "g.*", F.lit(True).alias("asks"))
    level, out = 0, None
    while True:
        heavy = shared_checkpoint(rows.groupBy("key").agg(F.count("*").alias("many"), *([F.max(F.col("b") - F.col("a")).alias("wide")] if level else [])).where((F.col("many") > large) & (F.col("wide") > 1 if level else F.lit(True))).select("key"))
        if not heavy.limit(1).count():
            small = rows.drop("l")
            return small if out is None else out.unionByName(small)
        small = rows.join(heavy, "key", "left_anti").drop("l")
        out = small if out is None else out.unionByName(small)
        split = rows.join(heavy, "key", "left_semi")
        if not level:  # by the shorter's length: a word is the shorter, or one longer than it
            split = split.withColumn("l", F.explode(F.array(m.cast("long"), m.cast("long") - 1))).where(F.col("l") >= LETTERS).withColumn("asks", F.col("l") == m)
            split = split.withColumn("a", F.when(F.col("way"), half(F.col("l"))).otherwise(F.lit(0))).withColumn("b", F.when(F.col("way"), F.col("l") + 1).otherwise(half(F.col("l"))))
        else:
            middle = half(F.col("a") + F.col("b"))
            split = split.withColumn("w", F.explode(F.array(F.struct(F.col("a").alias("x"), middle.alias("y")), F.struct(middle.alias("x"), F.col("b").alias("y"))))).withColumn("a", F.col("w.x")).withColumn("b", F.col("w.y")).drop("w")
        rows, level = shared_checkpoint(_keyed(split)), level + 1


def _near(key, table):
    """Each word's near words in one automaton's groups: their number, and the one of most occurrences."""
    forward = key[0].as_py()
    turn = (lambda w: w) if forward else (lambda w: w[::-1])
    n = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    words = sorted(n, key=turn)
    automaton = Automaton(map(turn, words))
    near, best = [0] * len(words), [None] * len(words)

    def met(i: int, j: int) -> None:
        near[i] += 1
        if best[i] is None or (-n[words[j]], words[j]) < best[i]:
            best[i] = (-n[words[j]], words[j])

    look = automaton.forward if forward else automaton.backward
    for w, a, b, asks in zip(*(table.column(c).to_pylist() for c in ("word", "a", "b", "asks")), strict=True):
        if asks:
            i = automaton.number(turn(w))
            for j, longer in look(w, a, b):
                met(i, j)
                if longer:  # a longer word does not look for shorter ones
                    met(j, i)
    some = [i for i, k in enumerate(near) if k]
    return pa.table({"word": [words[i] for i in some], "near": [near[i] for i in some], "best_n": [-best[i][0] for i in some], "best": [best[i][1] for i in some]}, schema=pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))


def near_words(words: DataFrame, bucket: int = BUCKET, large: int = LARGE) -> DataFrame:
    """word, n_near, best, best_n of distinct words (word, n) that have near words: one inserted, deleted or replaced code point apart."""
    prepare(words.sparkSession)
    buckets = max(1, -(-2 * words.count() // bucket))
    grouped = _groups(words, large).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    found = grouped.select("way", "bucket", "word", "n", "a", "b", "asks").groupBy("way", "bucket").applyInArrow(_near, "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")).select("word", "n_near", "b.best", (-F.col("b.n")).alias("best_n"))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN, times: int = TIMES, bucket: int = BUCKET, large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts of at least often occurrences, with the more frequent word of which each is a spelling.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case, of at least LETTERS code points, misspelt by rule (misspelt). A
    word's form is its near word of most occurrences (ties: first in code-point order) if it has at least times the word's, else null; the
    root follows forms to the last. Null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as
    they are there; an empty table gives an empty one. Other columns are not read. A word of any length is one word.

    Words are dealt to automata by what they share (_groups), forward ones by prefixes and backward ones by suffixes; a word looks for those
    that have its half exactly and one error in the rest. No pair leaves a task: a task gives each word the number of near words and the best.
    """
    words = shared_checkpoint(word_counts(df, id_col, text_col).where(F.col("n") >= often))
    known = words.join(near_words(words, bucket, large), "word", "left")
    formed = F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))
    table = shared_checkpoint(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    # Forms have times the occurrences, so a chain is short and ends; each round doubles what is followed.
    roots = shared_checkpoint(table.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        to = roots.select(F.col("word").alias("at"), F.col("root").alias("far"))
        new = shared_checkpoint(roots.join(to, F.col("root") == F.col("at"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        roots = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            break
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
