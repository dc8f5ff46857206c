"""Each named query against its SQL in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from reelspan.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_and_types(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = con.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({catalog.oracle_sql()[name]})")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = dict(df.dtypes)
    assert [kinds[types[n]] for n in names] == [str(d[1]) for d in rel.description]
    assert plain(df.select(*names).collect()) == plain(rel.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["user_id", "sid", "n", "first_us", "last_us"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_only_queries(spark):
    for name in ("stream_stateful_drift", "held_back_audio"):
        assert catalog.queries()[name](spark, SF).count() > 0


def test_clock_texts_with_keys_beyond_two_to_the_20(spark, tmp_path):
    """As on 60 times sf0.1, whose part keys reach 1,199,999: the SQL goes on in KB."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    far = [rows.withColumn("l_partkey", F.col("l_partkey") + shift) for shift in (0, (1 << 20) - 100, 1 << 30)]
    far[0].union(far[1]).union(far[2]).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog.queries()["clock_texts"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()['clock_texts']})").fetchall()
    assert plain(df.collect()) == plain(want)
    assert sum(r[-1].endswith("KB") and float(r[-1][:-3]) >= 1024 for r in want) > 6000
