"""Every query with SQL against DuckDB on the smallest tables; the others for their shape."""

import pytest

import __spark_entry__ as entry
from tessera.plans import registry
from tests.conftest import DATA, canonical, rows

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck(SF).sql(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows(df) == canonical([[r[i] for i in order] for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_fold_keeps_the_order_of_ties(spark, tmp_path):
    """Lines of one order and number are folded as the table has them, within a file and over files."""
    line = "select {k}l l_partkey, 7l l_orderkey, 1 l_linenumber, {q}d l_quantity, 'N' l_returnflag, 0.04d l_discount, 'F' l_linestatus, 10d l_extendedprice"
    for file, lines in (("a", [(1, 40), (1, 34), (2, 34), (3, 40)]), ("b", [(2, 40), (3, 34)])):
        made = spark.sql(" union all ".join(line.format(k=k, q=q) for k, q in lines)).toPandas()
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        made.to_parquet(tmp_path / "lineitem.parquet" / f"part-{file}.parquet")
    got = registry.queries()["dedup_ordered_fold"](spark, str(tmp_path)).collect()
    assert {r["k"]: r["replaced"] for r in got} == {1: 0, 2: 1, 3: 0}


def test_fold_rounds_quantities_as_its_sql_does(spark, duck, tmp_path):
    """Fractions of a quantity are rounded half to even, not cut off, before articles are compared."""
    line = "select {k}l l_partkey, {n}l l_orderkey, 1 l_linenumber, {q}d l_quantity, 'N' l_returnflag, 0.04d l_discount, 'F' l_linestatus, 10d l_extendedprice"
    pairs = {1: (33.6, 34.4), 2: (33.4, 33.6), 3: (34.5, 33.9), 4: (33.5, 34.5), 5: (7.4, 26.6), 6: (-3.6, -4.4), 7: (2.5, 2.4)}
    lines = [line.format(k=k, n=n, q=q) for k, p in pairs.items() for n, q in enumerate(p)]
    spark.sql(" union all ".join(lines)).toPandas().to_parquet(tmp_path / "lineitem.parquet")
    got = {r["k"]: r["replaced"] for r in registry.queries()["dedup_ordered_fold"](spark, str(tmp_path)).collect()}
    c = duck()
    c.sql(f"create or replace view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet')")
    want = c.sql(f"select k, replaced from ({registry.oracle_sql()['dedup_ordered_fold']})").fetchall()
    assert got == dict(want) == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
