"""Near-duplicate documents by min-max hashing of word shingles, with links confirmed on full sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, mix64, per_document, prepare, shared_checkpoint, starts_of, word_codes, word_hashes
from .components import components

SHINGLE = 5
#: A link: PERCENT * size of the union <= 100 * size of the intersection.
PERCENT = 75
#: Permutations, each giving a minimum and a maximum; a band is two of them. At a similarity of 0.75, 32 bands of four values
#: miss a pair with the probability that miss_rate gives: 1e-4 for 3 of 4 shingles, nearing (1 - 0.75 ** 4) ** 32 = 5.2e-6 for large sets.
PERMUTATIONS, BANDS = 64, 32
#: Sets of so many shingles or fewer also have a bucket for each of their least shingles, which no pair of them escapes; bands alone
#: find pairs in which a set has more, and miss miss_rate(33, 44) = 6.5e-6 of those at the limit, or less.
SMALL = 43
#: Bits of the filter of ids that thins the texts out before they are joined with the candidates: its size is fixed.
ID_BITS = 1 << 22
#: Most shingles, and most sets, of a family of candidates that one task links.
FAMILY, FAMILY_SETS = 1 << 21, 1 << 16
#: Counters, as a power of two, of the sketch that orders shingles by frequency.
SKETCH_BITS = 18

_rng = np.random.default_rng(20240501)
MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
SPREAD = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of five lower-cased words (of all words, if fewer)."""
    words, n = [], []
    for t in texts:
        w = t.encode().lower().split()
        words += w
        n.append(len(w))
    codes, distinct = word_codes(words)
    h = word_hashes(distinct)[codes] if words else np.zeros(0, np.uint64)
    out, at = [], 0
    grams = sum((h[k : len(h) - SHINGLE + 1 + k] * SPREAD[k] for k in range(SHINGLE)), np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)) if len(h) >= SHINGLE else np.zeros(0, np.uint64)
    grams = mix64(grams)
    for k in n:
        if k >= SHINGLE:
            out.append(np.unique(grams[at : at + k - SHINGLE + 1]))
        elif k:
            out.append(mix64((h[at : at + k] * SPREAD[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set that is not empty."""
    n = np.array([len(s) for s in sets])
    x, at = np.concatenate(sets), starts_of(n)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for i in range(PERMUTATIONS):
        y = x * MULTIPLY[i] + ADD[i]
        band = i * BANDS // PERMUTATIONS
        for v in (np.minimum.reduceat(y, at), np.maximum.reduceat(y, at)):
            keys[:, band] = mix64(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + v + np.uint64(band))
    return keys.view(np.int64)


def miss_rate(both: int, either: int) -> float:
    """Chance that no band finds two sets with so many shingles in common, of so many in all: a minimum and a maximum are two of them."""
    band = (both / either * (max(1, both - 1) / max(1, either - 1))) ** (PERMUTATIONS // BANDS)
    return (1 - band) ** BANDS


def prefix_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the least shingles of a set: two sets that are similar enough share one."""
    return mix64(s[: _prefix(len(s), percent, 100)] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def _signatures(texts: list[str], percent: int):
    sets = shingle_sets(texts)
    full = [i for i, s in enumerate(sets) if len(s)]
    keys = band_keys([sets[i] for i in full]) if full else []
    digest, bands = [None] * len(sets), [None] * len(sets)
    for i, k in zip(full, keys, strict=True):
        digest[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k if len(sets[i]) > SMALL else np.concatenate((k, prefix_keys(sets[i], percent)))
    return [len(s) for s in sets], digest, bands


def _sets(texts: list[str]):
    sets = shingle_sets(texts)
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [s.tobytes() for s in sets]


class Labels:
    """Components of numbered nodes: a label for each, the members of each label; the smaller side of a union is relabelled."""

    def __init__(self, label: np.ndarray):
        self.label = label
        order = np.argsort(label, kind="stable")
        self.members = dict(enumerate(np.split(order, np.cumsum(np.bincount(label))[:-1])))
        self.largest = max(self.members, key=lambda k: len(self.members[k]))

    def join(self, labels: list[int]) -> None:
        to = max(labels, key=lambda k: len(self.members[k]))
        parts = [self.members[to]]
        for k in labels:
            if k != to:
                parts.append(self.members.pop(k))
                self.label[parts[-1]] = to
        self.members[to] = np.concatenate(parts)
        if to != self.largest and (self.largest not in self.members or len(self.members[to]) > len(self.members[self.largest])):
            self.largest = to


def link_family(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Least id of each set's component, every link among the sets counted; rows of one id are one node.

    Two sets that are similar enough share one of the rarest shingles of each, so a set is held against those of other
    components that share one of its. Sets that are in the largest component by then need not be, as all others are held
    against them. A set costs what the posting lists of its rarest shingles and its candidates' shingles do.
    """
    n = np.array([len(s) for s in sets], np.int64)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    row = np.repeat(np.arange(len(sets)), n)
    code = rarity[code]
    code = code[np.lexsort((code, row))]  # a set's shingles, rarest first
    at = np.cumsum(n) - n
    few = n - -(-n * percent // 100) + 1
    rare = np.arange(len(code)) - np.repeat(at, n) < np.repeat(few, n)
    owner = row[rare][by := np.argsort(code[rare], kind="stable")]
    begin = np.searchsorted(code[rare][by], np.arange(len(often) + 1))
    shared = np.add.reduceat(np.where(rare, np.diff(begin)[code] - 1, 0), at) > 0
    least, label = np.unique(ids, return_inverse=True)  # labels in order of ids
    parts = Labels(label)
    marked = np.zeros(len(often), bool)
    todo = shared.copy()
    while len(wait := np.flatnonzero(todo & (parts.label != parts.largest))):
        for i in wait.tolist():
            if parts.label[i] == parts.largest:
                continue
            todo[i] = False
            other = np.unique(np.concatenate([owner[begin[c] : begin[c + 1]] for c in code[at[i] : at[i] + few[i]].tolist()]))
            other = other[(parts.label[other] != parts.label[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            if not len(other):
                continue
            size = n[other]
            place = np.arange(size.sum()) + np.repeat(at[other] - np.cumsum(size) + size, size)
            mine = code[at[i] : at[i] + n[i]]
            marked[mine] = True
            both = np.add.reduceat(marked[code[place]], np.cumsum(size) - size, dtype=np.int64)
            marked[mine] = False
            near = np.unique(parts.label[other[100 * both >= percent * (size + n[i] - both)]])
            if len(near):
                parts.join([int(parts.label[i]), *near.tolist()])
    out = np.empty(len(sets), ids.dtype)
    for members in parts.members.values():
        out[members] = ids[members].min()
    return out


def _prefix(size: int, part: int, whole: int) -> int:
    """How many of its rarest shingles a set must look at if part / whole of it is in common."""
    return size - -(-size * part // whole) + 1


def _rare_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that can be similar enough: those that share one of their rarest shingles.

    Shingles are ordered by how often they are there, by a sketch of fixed size, then by hash: any order that all sets share
    finds all pairs, and with this one a shingle that a large group has in common is looked at last.
    """
    spark, bits = sets.sparkSession, SKETCH_BITS

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for x in b.column("set"):
                np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - bits)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counted = sets.select("set").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 1 << SKETCH_BITS at most
    often = np.zeros(1 << bits, np.int64)
    for r in counted:
        often[r["at"]] = r["n"]
    shared = spark.sparkContext.broadcast(often)

    def rarest(batches):
        often = shared.value
        for b in batches:
            rows, token, first = [], [], []
            for i, x in enumerate(b.column("set")):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                s = s[np.lexsort((s, often[(s >> np.uint64(64 - bits)).astype(np.int64)]))]
                k = _prefix(len(s), percent, 100)
                rows.append(np.full(k, i))
                token.append(s[:k].view(np.int64))
                first.append(np.arange(k) < _prefix(len(s), 2 * percent, 100 + percent))
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), b.column("n").take(pa.array(at)), pa.array(np.concatenate(token) if rows else [], pa.int64()), pa.array(np.concatenate(first) if rows else [], pa.bool_())], names=["id", "n", "token", "few"])

    plain = sets.select("id", (F.octet_length("set") / 8).cast("long").alias("n"), "set")
    kind = T.StructType([plain.schema["id"], *T.StructType.fromDDL("n long, token long, few boolean")])
    rare = plain.mapInArrow(rarest, kind).join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    x, y = rare.alias("x"), rare.where("few").alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | (F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id"))
    pair = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & smaller & (100 * F.col("y.n") >= percent * F.col("x.n")))
    return pair.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(compare, joined.select("a", "b").schema)


def told_apart(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds maybe: whether a row's id may be among ids (null: no), by a filter of ID_BITS bits: 65,536 rows however many ids there are."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    words = ids.select(place("id").alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    joined = docs.withColumn("p", place("id")).join(F.broadcast(words), F.floor(F.col("p") / 64) == F.col("w"), "left")
    found = F.col("id").isNotNull() & (F.coalesce("m", F.lit(0).cast("long")).bitwiseAND(F.expr("shiftleft(1L, cast(p % 64 as int))")) != 0)
    return joined.withColumn("maybe", found).drop("p", "w", "m")


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, digest, set, ...) of the wanted classes (id, digest, ...), from the texts of their ids."""
    texts = told_apart(rows, wanted.select("id")).where("maybe").join(wanted.select("id").distinct(), "id", "left_semi")
    made = per_document(texts, "id", "text", "digest binary, set binary", _sets)
    return made.join(wanted, ["id", "digest"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, family: int = FAMILY) -> DataFrame:
    """Near-duplicate groups of whole texts: id, n_shingles, component_id (least id reachable), kept (it is the id).

    Sets of SMALL shingles or fewer are found exactly, larger ones by their bands (see miss_rate). Documents of equal sets are one class, stood for by the least id, so exact copies cost nothing further. Classes that share
    a band's bucket, directly or over others, are a family; a family of at most family shingles (and FAMILY_SETS classes) is linked
    in one task, which holds sets against all that share one of their rarest shingles, on full sets. Larger families are linked in many tasks: every class with the least one of its
    buckets, then all pairs of different components that share one of their rarest shingles. Neither emits all pairs of a
    bucket, and neither loses a link.

    Texts without words are linked with nothing. Rows with one id count as one document (and are each returned); a null id
    takes no part: its component_id is null and it is kept. Other columns are not read.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = shared_checkpoint(per_document(rows, "id", "text", "n_shingles long, digest binary, bands array<long>", lambda texts: _signatures(texts, percent)))
    worded = signed.where("id is not null and digest is not null")
    classes = worded.groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("c")).select("digest", "c.id", F.col("c.n_shingles").alias("n"), "c.bands")
    keys = classes.select("id", "digest", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("id").alias("least")).where("many > 1").select("key", "least")
    members = shared_checkpoint(keys.join(buckets, "key").select("id", "digest", "n", "least").distinct())
    # A class meets the least of its leasts, and so do the others of them: one link a class, and few among leasts.
    met = members.groupBy("id").agg(F.collect_set("least").alias("l")).select("id", "l", F.array_min("l").alias("b"))  # a least for each key at most
    linked = met.select(F.col("id").alias("a"), "b").unionByName(met.select(F.explode("l").alias("a"), "b").distinct()).where("a <> b")
    of = components(linked).select(F.col("node").alias("id"), F.col("label").alias("family"))
    wanted = shared_checkpoint(members.select("id", "digest", "n").distinct().join(of, "id"))
    sizes = wanted.groupBy("family").agg(F.sum("n").alias("size"), F.count("*").alias("sets"))
    large = shared_checkpoint(sizes.where((F.col("size") > family) | (F.col("sets") > FAMILY_SETS)).select("family"))
    any_large = large.limit(1).count() > 0
    schema = T.StructType([T.StructField("node", df.schema[id_col].dataType), T.StructField("label", df.schema[id_col].dataType)])

    def link(table):
        ids = np.array(table.column("id").to_pylist())
        label = link_family(ids, [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")], percent)
        return pa.table([table.column("id"), pa.array(label.tolist(), table.schema.field("id").type)], names=["node", "label"])

    small = wanted.join(large, "family", "left_anti") if any_large else wanted
    labels = _sets_of(rows, small).select("id", "family", "set").groupBy("family").applyInArrow(link, schema).distinct()
    if any_large:
        sets = shared_checkpoint(_sets_of(rows, wanted.join(large, "family", "left_semi")))
        stars = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).join(sets.select(F.col("id").alias("b")).distinct(), "b", "left_semi").select("a", "b").distinct()
        links = shared_checkpoint(_confirmed(stars, sets, percent))
        more = shared_checkpoint(_confirmed(_rare_pairs(sets, components(links), percent), sets, percent))
        labels = labels.unionByName(components(links.unionByName(more)))
    labels = shared_checkpoint(labels)
    # One id with several texts is one document.
    several = shared_checkpoint(worded.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id"))
    if several.limit(1).count():
        spread = worded.join(several, "id").join(classes.select("digest", F.col("id").alias("rep")), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        labels = components(spread.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    of_class = classes.select("digest", F.col("id").alias("rep")).join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = signed.select("id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
