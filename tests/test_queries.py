"""Every registered query against its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from heronflow import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the driver tables")


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return db


def plain(value):
    return ("nan" if math.isnan(value) else round(value, 5) + 0.0) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, database, name):
    out = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(out.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in out.collect())
    if name not in plans.ORACLE:
        assert got
        return
    found = database.execute(plans.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want
