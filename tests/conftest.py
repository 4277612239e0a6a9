"""One Spark session for all tests, and DuckDB over the same tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    s = session("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the tables of a folder as views."""
    import duckdb

    def connect(folder=f"{DATA}/sf0.001"):
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
        return c

    return connect


def rows(df):
    """Rows as sorted tuples in order of column name, with floats rounded."""
    names = sorted(df.columns)
    return canonical([[r[n] for n in names] for r in df.collect()])


def canonical(found):
    def plain(x):
        if isinstance(x, float):
            return round(x, 6)
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        if isinstance(x, bytearray):
            return bytes(x)
        return x

    return sorted((tuple(plain(x) for x in r) for r in found), key=repr)
