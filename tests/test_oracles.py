"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from papertrail.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: What these look for occurs in no document of the fixture; others run the same operators over texts that hold it.
WITHOUT_HITS = {"entities_all", "phone_entities", "amount_max", "date_entities"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.9g}"
        return "null" if v is None or v is pd.NA else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = plans.queries()[name](spark, SF)
    assert df.columns and (df.count() > 0) != (name in WITHOUT_HITS)
