"""Every registered query next to its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def near(row):
    return tuple(f"{float(v):.6g}" if v.replace(".", "", 1).replace("-", "").replace("e", "").isdigit() and "." in v else v for v in row)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(near(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    order = [names.index(c) for c in cols]
    want = sorted(near(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_label_source_reads_the_rationales(spark):
    errors = {r.error for r in entry.queries()["label_source_credentials"](spark, SF).collect()}
    assert errors == {"sample id is missing", "sample id is not unique", "credential-like pattern"}


@pytest.mark.parametrize("name", ["feed_comments", "threshold_evaluation", "threshold_rounds", "scan_examples_jsonl", "following_topk", "teacher_audit", "bootstrap_ci"])
def test_large_side_equals_sql(spark, duck, name):
    """The same with no table small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query_equals_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
