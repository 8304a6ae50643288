"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from permuta.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    clean = lambda v: None if v is None or v != v else float(f"{float(v):.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    result = duck.execute(queries.oracle_sql()[name])
    wanted = [c[0] for c in result.description]
    assert sorted(wanted) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(wanted, result.fetchall())


#: Queries on letters in long form; at 1 GB of documents a broadcast of them doesn't fit the driver.
LETTER_JOINS = ("motion", "motion_average", "motion_median", "motion_mode", "pareto_check", "rank_agreement", "item_motion_mean", "mean_displacement", "top_fraction")


@pytest.mark.parametrize("name", LETTER_JOINS)
def test_letters_are_not_broadcast(spark, name):
    """Neither as planned nor as replanned while it runs, though every table here is small enough."""
    found = queries.queries()[name](spark, SF)
    planned = found._jdf.queryExecution().executedPlan()
    assert "SortMergeJoin" in planned.toString()
    found.collect()
    assert "Broadcast" not in planned.toString()
