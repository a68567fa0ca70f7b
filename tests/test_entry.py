"""Driver contract: entry runs, every query has a callable, oracle keys are
a subset, and a sample of queries agrees with DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from inputs import SF001

TABLES = "documents labels".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "f1" in df.columns


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["per_label_metrics", "clean_text", "oversample_rows", "stratified_split",
                                  "annotator_examples", "encode_tokens", "threshold_advice"])
def test_oracle_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    ocols = rel.columns
    assert sorted(ocols) == cols
    want = sorted(tuple(str(r[ocols.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
