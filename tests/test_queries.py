import pytest

import __spark_entry__ as entry
from bramble.plans import queries
from tests.oracle import SF, compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["graph_id", "k", "dk_density", "dk_tail_degree", "dk_degeneracy"] and df.count() == 210


def test_supply_degeneracy_against_core_numbers(spark):
    from bramble.operators import peel
    from bramble.plans import tables

    one = queries.dk_supply(spark, SF.replace("0.01", "0.001")).select("graph_id", "k", "dk_degeneracy")
    two = peel.dk_degeneracy_from_cores(peel.core_numbers(tables.supply(spark, SF.replace("0.01", "0.001"))))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_supply_against_a_plain_peel(spark):
    """All three columns of the flagship query on sf0.01, for which SQL is too slow."""
    import duckdb

    edges = duckdb.sql(f"SELECT DISTINCT l_suppkey, 1000000 + l_partkey FROM '{SF}/lineitem.parquet'").fetchall()
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    m, n = len(edges), len(near)
    removed, left = [], {v: len(x) for v, x in near.items()}
    while left:
        d, v = min((d, v) for v, d in left.items())
        removed.append((n - len(removed), m, d))
        m -= d
        del left[v]
        for u in near[v]:
            if u in left:
                left[u] -= 1
    dense, tail, degenerate = {}, {}, {}
    best = worst = 0
    for s, e, d in removed:
        best, worst = max(best, -(-2 * e // s)), max(worst, d)
        dense[s - 1], degenerate[s - 1] = best, worst
    worst = 0
    for s, _, d in reversed(removed):
        tail[s - 1] = worst
        worst = max(worst, d)
    got = {r.k: (r.dk_density, r.dk_tail_degree, r.dk_degeneracy) for r in queries.dk_supply(spark, SF).collect()}
    assert got == {k: (dense[k], tail[k], degenerate[k]) for k in range(n)}


def test_peel_check_of_more_than_ten_million_edges(spark, tmp_path):
    """Every one of 3,200 suppliers delivered each of 3,188 parts: 10.2 million edges."""
    suppliers, parts = 3200, 3188
    rows = spark.range(suppliers * parts).selectExpr(f"id % {suppliers} AS l_suppkey", f"id div {suppliers} AS l_partkey")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    m = suppliers * parts
    assert queries.peel_check_supply(spark, str(tmp_path)).collect() == [(suppliers + parts, m, 0, 0, m, 1, 0)]
