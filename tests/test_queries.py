"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from mnemospark.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int, float)):
        return float(f"{float(v):.9g}")
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert df.columns
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    place = [want.columns.index(c) for c in order]
    theirs = sorted((tuple(plain(r[k]) for k in place) for r in want.fetchall()), key=repr)
    assert mine == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_signature_classes_keep_case_and_edges(spark, tmp_path):
    """The classes are those of the SQL: texts that differ in case or in white space at their ends are two."""
    texts = ["Run 1 job", "run 2 job", " run 3 job", "run  4\njob", "run 5 job ", None, ""]
    spark.createDataFrame([(k, t, "en", "a", 9) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["d5_signature_classes"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == c.sql(ORACLE_SQL["d5_signature_classes"]).fetchall() == [(7, 5)]
