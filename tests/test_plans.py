"""Every registered query with SQL against DuckDB on the small tables; those without must at least run."""

import collections
import hashlib
import math
import os
import re
from pathlib import Path

import duckdb
import pytest

from evidentia.functions import text as tx
from evidentia.plans import catalog

DATA = Path(os.environ.get("EVIDENTIA_TESTDATA", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = DATA / f"{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return round(float(v), 9) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows
    if name in catalog.ORACLE:
        q = duck.execute(catalog.ORACLE[name])
        found = [d[0] for d in q.description]
        assert sorted(found) == cols
        at = [found.index(c) for c in cols]
        assert rows == sorted((tuple(plain(x[i]) for i in at) for x in q.fetchall()), key=repr)


def test_doc_tokens_has_every_term(spark):
    texts = [r.text.lower() for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()]
    found = [[t for t in re.findall("[a-z0-9']+", x) if t not in tx.STOP_WORDS] for x in texts]
    df, tf = collections.Counter(t for x in found for t in set(x)), collections.Counter(t for x in found for t in x)
    rows = catalog.QUERIES["doc_tokens"](spark, str(DATA)).collect()
    assert {r.term: (r.df, r.tf) for r in rows} == {t: (df[t], tf[t]) for t in df} and min(df.values()) == 1


def test_normalized_digest_is_of_the_whole_text(spark):
    rows = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text").collect()
    want = {r.doc_id: hashlib.md5(" ".join(re.findall("[a-z0-9']+", r.text.lower())).encode()).hexdigest() for r in rows}
    assert {r.doc_id: r.digest for r in catalog.QUERIES["normalized_digest"](spark, str(DATA)).collect()} == want


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["series", "rank", "start_ms", "end_ms", "score", "anchor"]
    assert set(e.oracle_sql()) <= set(e.queries())
