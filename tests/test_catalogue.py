"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ledgerloom.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tmp_path, name):
    df = QUERIES[name](spark, DATA)
    df.write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE mine AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    if name not in ORACLES:
        return
    duck.execute(f"CREATE OR REPLACE TABLE wanted AS {ORACLES[name]}")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE mine").fetchall())
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE wanted").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("mine", "wanted"), ("wanted", "mine")):
        assert duck.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []
