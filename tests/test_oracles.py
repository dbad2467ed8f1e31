"""Every registered query against its SQL counterpart, on the smallest data."""

import math

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, float) else str(x)


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(cell(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def names():
    import re

    # Names are read from the sources: building the registry needs no session, importing it is cheap.
    from rewardframe.plans import catalog

    return sorted(catalog.QUERIES, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])


@pytest.mark.parametrize("name", names())
def test_query(name, spark, duck):
    from rewardframe.plans import catalog

    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: str(got[c].dtype) for c in got} == {c: str(want[c].dtype) for c in want}
    assert rows(got) == rows(want)
