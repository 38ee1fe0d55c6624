"""Every registered query against its SQL, on the small tables."""

import glob
import os

import duckdb
import pytest

from sectorlens.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    r = oracle.sql(ORACLE_SQL[name])
    columns = sorted(r.columns)
    assert sorted(df.columns) == columns
    want = sorted(tuple(repr(dict(zip(r.columns, x, strict=True))[c]) for c in columns) for x in r.fetchall())
    assert sorted(tuple(repr(x[c]) for c in columns) for x in rows) == want


def test_the_panel_has_a_million_firms(spark):
    from collections import Counter

    rows = QUERIES["synthetic_panel_cells"](spark, SF).collect()
    assert (len(rows), sum(x.released for x in rows)) == (180, 160)
    firms = Counter()
    for x in rows:
        firms[x.metric] += x.n_valid
    assert max(firms.values()) == 1_000_000


def test_boosting_rounds_and_depth_of_the_reference(spark, monkeypatch):
    from sectorlens.operators import gbdt

    seen, fit = [], gbdt.fit
    monkeypatch.setattr(gbdt, "fit", lambda rows, features, label, p: seen.append(p) or fit(rows, features, label, p))
    assert sum(x.n for x in QUERIES["gbdt_predictions"](spark, SF).collect()) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert (seen[0].trees, seen[0].depth) == (8, 3)
