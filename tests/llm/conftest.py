import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def duck(spark):
    """Runs SQL in DuckDB over given DataFrames; returns sorted rows."""

    def run(sql, **tables):
        db = duckdb.connect()
        for name, df in tables.items():
            db.register(name, df.toArrow())
        return sorted(db.execute(sql).fetchall(), key=str)

    return run


@pytest.fixture()
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
