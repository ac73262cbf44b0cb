"""Every registered query of the library runs and equals its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from lodestone.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    plan, sql = catalog.QUERIES[name]
    df = plan(spark, DATA)
    got = df.toPandas()
    if sql is None:
        assert len(got)
        return
    rel = duck.sql(sql)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    assert _rows(got, columns) == _rows(rel.df(), columns)


@pytest.mark.parametrize("name", ["hybrid_fusion_topk", "temporal_hybrid", "cdc_classify", "markdown_headings"])
def test_same_with_other_partitions(spark, name):
    plan, _ = catalog.QUERIES[name]
    first = _rows(plan(spark, DATA).toPandas(), sorted(plan(spark, DATA).columns))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = plan(spark, DATA)
        assert _rows(df.toPandas(), sorted(df.columns)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
