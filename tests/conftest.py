import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


SF = "/root/testdata/sf0.001"


def plain(v):
    import datetime

    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def same_as_oracle(spark, duck):
    """Checks a registered query against its SQL on the smallest tables."""

    def check(name, queries, oracle):
        df = queries[name](spark, SF)
        columns = sorted(df.columns)
        ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        r = duck.execute(oracle[name])
        theirs = [x[0] for x in r.description]
        assert sorted(theirs) == columns
        at = [theirs.index(c) for c in columns]
        assert ours == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)

    return check
