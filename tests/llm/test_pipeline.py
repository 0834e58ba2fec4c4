"""The corpus pipeline's stages against what they must do."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from evidentia.llm import minhash, packing, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), [spark.read.parquet("/root/testdata/sf0.001/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def test_stages(stages, spark):
    texts = [{r.doc_id: r.text for r in s.collect()} for s in stages[:-1]]
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "secret_scan", "packing"]
    assert all(s.columns == COLUMNS for s in stages[1:-1])
    assert len(texts[1]) >= 0.97 * len(texts[0])
    kept = {r.doc_id for r in minhash.near_duplicates(stages[1]).where("kept").collect()}
    assert set(texts[2]) == kept and all(texts[2][i] == texts[1][i] for i in kept)
    seen = set()
    for i in sorted(texts[2]):
        raw = texts[2][i].encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert texts[3].get(i, "") == left
    path = packing.tokenizer_path("byte_bpe_50k.tiktoken")
    for i, t in texts[3].items():
        assert texts[4][i] == secrets._replaced(t, secrets.find(t, path), "<SECRET>")
    assert {r.doc_id for r in stages[5].collect()} == set(texts[4])
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_language_id_keeps_short_clean_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Reouti anatha.", "en", "s", 14), (2, "12", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    even = lambda p: np.append(np.zeros(cp.langid.DIM), np.log(p / (1 - p)) / 2)  # noqa: E731  (the same probability for any text)
    pair = [("en", "de", even(0.6))]
    for sure, want in ((0.7, [1]), (0.4, [])):
        model = cp.langid.Model(["f", "g", "h"], {"f": ["en", "de"], "g": ["x"], "h": ["y"]}, [even(sure), even((1 - sure) / 2), even((1 - sure) / 2)], pair)
        monkeypatch.setattr(cp.langid, "train", lambda docs, m=model: m)
        assert [r.doc_id for r in cp.identify_languages(spark, docs, "").collect()] == want


ODD = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "a plain text without an id", "en", None, 9), (3, "a plain text " * 20, "en", "s", 9), (3, "a plain text " * 20, "en", "s", 9), (4, "1234 5678", "en", "s", 9), (5, "key = qX7vJ2kLw9ZpT4mB8sYdR3nC", None, None, None)]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id int, p int, w int, m int, maybe int, none int, block int, piece int, length int, salt int, r int, ids int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *range(12)) for r in ODD], CLASH)


def test_odd_rows_and_clashing_columns(spark, odd):
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    found = {name: stage(spark, odd, "") for name, stage in cp.STAGES}
    assert ids(found["language_id"]) == [0, 3, 3, 5]  # no letters: 1, 2, 4
    assert ids(found["near_dedup"]) == ids(found["suffix_dedup"]) == ids(found["secret_scan"]) == ids(found["packing"]) == [0, 1, 2, 3, 3, 4, 5]
    assert all(found[n].columns == COLUMNS for n, _ in cp.STAGES[:-1])
    texts = {r.doc_id: r.text for r in found["secret_scan"].collect()}
    assert texts[1] is None and texts[2] == "" and texts[5] == "key = <SECRET>"
    cut = {r.doc_id: r for r in found["suffix_dedup"].collect()}
    assert cut[1].text is None and cut[1].n_chars is None and cut[2].text == "" and len(cut[3].text) < 260
    packed = {r.doc_id: r for r in found["packing"].collect()}
    assert packed[1].ids == packed[2].ids == [0] and packed[5].length == len(packed[5].ids)
    # Nothing to learn from: only documents without letters go.
    assert ids(cp.identify_languages(spark, odd.withColumn("lang", F.lit(None).cast("string")), "")) == [0, 3, 3, 5]


def test_every_stage_takes_an_empty_table(spark, odd):
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0


def test_run_deletes_its_tables_and_returns_readable_sequences(spark, tmp_path):
    from evidentia.llm.common import shared_folder

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 60)), "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    before = {p.name for p in Path(shared_folder(spark)).glob("table-*")} if "://" not in shared_folder(spark) else set()
    got = cp.run(spark, str(tmp_path)).collect()
    folder = shared_folder(spark).removeprefix("file:")
    assert {p.name for p in Path(folder).glob("table-*")} <= before
    tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    assert {r.doc_id: tokenizer.decode(r.ids[:-1]) for r in got} == {i: t for i, t, *_ in rows}
