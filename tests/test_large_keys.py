"""The order sheet of tables whose keys are so large that a position made of them leaves BIGINT."""

import datetime as dt

import pytest

from ordergate.operators.gate import run_gate
from ordergate.sources import testdata as TD

HOY = "2001-06-30"
SIX_GB = 53_999_990            # the last order keys of 360 times sf0.1


def tables(spark, folder, first, dangling=None):
    """Four orders of three lines each from order key ``first`` on; a line without an order, if its key is given."""
    at = dt.datetime(1997, 3, 4)
    lines = [(first + o, 7 + o, 3, n, float(10 * o + n), "R" if n == 2 else "N", at) for o in range(4) for n in (1, 2, 3)]
    if dangling is not None:
        lines.append((dangling, 7, 3, 1, 5.0, "N", at))
    made = {
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                            "l_returnflag string, l_shipdate timestamp_ntz"),
        "orders": ([(first + o, 11) for o in range(4)], "o_orderkey bigint, o_custkey bigint"),
        "customer": ([(11, "Customer#000000011", "TOYS")], "c_custkey bigint, c_name string, c_mktsegment string"),
        "part": ([(7 + o, "cold widget", "Brand#1", "ECONOMY", 900.5) for o in range(4)],
                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double"),
        "supplier": ([(3, "Supplier#000000003", 1)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "nation": ([(1, "PERU")], "n_nationkey int, n_name string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), lines[:12]


def key(line):
    order, part, supplier, number = line[:4]
    return ((order * 16 + number) * 100000 + part) * 10000 + supplier


@pytest.mark.parametrize("first", [1, 9_000_000, SIX_GB, 10**12])
def test_positions_at_any_size(spark, tmp_path, first):
    """A key sum beyond BIGINT gives the line's place in its file, not an error; cells follow from the exact key."""
    folder, lines = tables(spark, tmp_path / "t", first)
    got = sorted(TD.dirty_orders(spark, folder).collect(), key=lambda r: r["fila_origen"])
    exact = [key(x) * 64 + int(x[4]) for x in lines]
    fits = max(exact) <= TD.BIGINT_MAX
    assert fits == (first <= 9_000_000)
    assert [r["fila_origen"] for r in got] == (sorted(exact) if fits else list(range(12)))
    for r, x in zip(got, lines):
        k = key(x)
        assert r["pedido_id"] == (None if k % 997 == 0 else f"P{x[0]}-{x[3]}")
        assert (r["zona"], r["comercial"]) == (None if k % 83 == 0 else "PERU", None if k % 61 == 0 else "Supplier#000000003")
        assert r["cantidad"] == (0.0 if k % 131 == 0 else x[4] * 1000 if k % 4001 == 0 else
                                 -x[4] if x[5] == "R" and x[1] % 10 == 0 else x[4])
    res = run_gate(TD.dirty_orders(spark, folder), HOY, materialize=True)
    assert res.counts["crudas"] == 12 and res.unique_positions
    res.release()


def test_lines_that_are_not_sold_do_not_count(spark, tmp_path):
    """A line beyond BIGINT without an order is not in the sheet: positions stay the key sums."""
    folder, lines = tables(spark, tmp_path / "t", 1, dangling=SIX_GB)
    assert sorted(r["fila_origen"] for r in TD.dirty_orders(spark, folder).collect()) == [key(x) * 64 + int(x[4]) for x in lines]
