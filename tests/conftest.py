import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(folder)).config("spark.sql.warehouse.dir", str(folder / "warehouse")).config("spark.sql.autoBroadcastJoinThreshold", "10m").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    return folder


@pytest.fixture(scope="session")
def against_sql(spark, sf):
    """Compares a query's rows with those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")

    def check(query, sql):
        df = query(spark, sf)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        key = lambda row: [(v is None, str(v)) for v in row]
        want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in found.fetchall()), key=key)
        got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=key)
        assert got == want

    return check
