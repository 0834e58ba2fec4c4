"""Every registered query and the pipeline over texts of several megabytes."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from evidentia.llm import bpe, common, packing, queries, variants

RNG = random.Random(21)
PROSE = " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(1, 9))) for _ in range(300_000))
TEXTS = [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, "a" * 3_000_000, "#" * 2_000_000, base64.b64encode(RNG.randbytes(1_500_000)).decode(), "ab " * 700_000, PROSE, PROSE[1000:], "deadbeef" * 3 + " x", None, "", "plain words of one more document " * 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("hard")
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(101)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op5_ann", "nearest_vectors", "op9_packing", "op11_vector_dups", "op12_hard_negatives", "op13_spelling_variants")])
def test_queries(spark, folder, name):
    got = {r[0]: r for r in queries.QUERIES[name](spark, folder).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    raw = [(t or "").encode() for t in TEXTS]
    if name == "op2_suffix_dedup":
        assert [got[i].n_removed for i in (0, 3, 6)] == [1_999_999, 2_999_999, 2_099_997] and got[8].n_removed >= len(raw[8]) - 1
    if name == "op3_bpe":
        assert all(got[i].decoded_sha256 == hashlib.sha256(raw[i]).hexdigest() for i in got)
        assert got[5].n_tokens == len(bpe.bpe(packing.tokenizer_path("byte_bpe_multi_50k.tiktoken")).encode(TEXTS[5]))
    if name == "op4_lm_score":
        assert all(got[i].n_tokens == len(raw[i].split()) + 1 for i in got)
    if name == "op6_minhash":
        assert got[8].component_id == 7 and not got[8].kept and got[6].kept
    if name == "op8_sharding":
        assert all((r.size, r.text_crc32) == (len(raw[i]) + 16, zlib.crc32(raw[i])) for i, r in got.items())


def test_neighbours(spark, folder):
    assert queries.QUERIES["op5_ann"](spark, folder).count() == 15
    assert queries.QUERIES["op11_vector_dups"](spark, folder).count() == 101
    assert {r.anchor_id for r in queries.QUERIES["op12_hard_negatives"](spark, folder).collect()} <= {0, 100}


def test_words(spark, folder):
    assert queries.QUERIES["op13_spelling_variants"](spark, folder).where("n < 5 or length(word) < 6").count() == 0
    got = {r.word: r for r in variants.spelling_variants(common.documents(spark, folder), often=3).collect()}
    assert got["document"].n == 3 and got["document"].root == "document"


def test_packing_and_pipeline(spark, folder):
    pieces = queries.QUERIES["op9_packing"](spark, folder).collect()
    assert sorted({r.doc_id for r in pieces}) == list(range(len(TEXTS)))
    by = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        by.setdefault(r.doc_id, {})[r.start] = r
    assert {0, 1, 2, 4, 10, 11}.isdisjoint(by) and {3, 5, 6, 7, 9, 12} >= set(by) >= {7}
    for rows in by.values():
        assert np.concatenate([rows[s].ids for s in sorted(rows)])[-1] == 0
