"""Every registered filing query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from ledgerspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def rows(frame):
    columns = sorted(frame.columns)
    shown = frame[columns].map(lambda v: "" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return columns, sorted(map(tuple, shown.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    assert rows(found) == rows(oracle.execute(catalogue.ORACLE_SQL[name]).df())
