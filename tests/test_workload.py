"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from methgrid.plans import derived, workload

from .conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    return sorted((tuple(None if pd.isna(x) else round(float(x), 9) if isinstance(x, float) else x for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, con, name):
    got = workload.QUERIES[name](spark, SF).toPandas()
    if name in workload.ORACLE_SQL:
        assert rows(got) == rows(con.sql(workload.ORACLE_SQL[name]).df())
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["sample_groups", "sample_groups_removed", "groups_read", "names_read", "sample_groups_json"])
def test_groups_of_more_than_99999(spark, tmp_path, name):
    """Labels have more than five digits there, which no label may lose, and stand in the order of text in files."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS c_custkey, CAST(i % 25 AS INTEGER) AS c_nationkey, CASE WHEN i < 160000 THEN 'BIG' ELSE 'SMALL' END AS c_mktsegment FROM range(160100) r(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    got = workload.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(workload.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name, made", [("methylomes_consistent", {"sites", "chroms"}), ("request_shapes", {"sites", "chroms"}), ("binary_index_read", {"sites", "chroms"}), ("global_levels", {"sites", "chroms", "methylomes", "meta"})])
def test_only_what_a_query_needs_is_derived(spark, name, made):
    derived._MADE.clear()
    workload.QUERIES[name](spark, SF).collect()
    folder = derived.tables(spark, SF).folder
    assert set(os.listdir(folder.removeprefix("file:"))) == made
