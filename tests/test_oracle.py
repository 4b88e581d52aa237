"""Every engine query against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from locusframe.plans import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df: pd.DataFrame) -> list[str]:
    def f(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, float):
            return None if v != v else int(v) if v == int(v) else round(v, 6)
        return v

    return sorted(repr([f(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


#: Queries that find next to nothing in the smallest tables, as their radius does not follow the size.
LARGER = {"dbscan", "dbscan_with_border", "dbscan_objects"}


@pytest.fixture(scope="module")
def con(sf):
    def connect(folder):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return c

    return {folder: connect(folder) for folder in (sf, "/root/testdata/sf0.01")}


SLOW = {"spearman", "coloc_classes", "coloc_counts", "voronoi_total"}


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if os.environ.get("ALL_QUERIES") or n not in SLOW])
def test_matches_sql(spark, sf, con, name):
    folder = "/root/testdata/sf0.01" if name in LARGER else sf
    ours = catalog.queries()[name](spark, folder).toPandas()
    theirs = con[folder].execute(catalog.oracle_sql()[name]).df()
    assert len(ours) or name not in LARGER
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert norm(ours) == norm(theirs)
