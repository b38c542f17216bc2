"""Workload and operator queries over whole tables: what lies past the first keys counts."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def table(name):
    return f"read_parquet('{SF}/{name}.parquet')"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, SF)


def test_solo_averages_are_of_all_orders(run):
    want = duckdb.sql(f"select 'q' || (o_orderkey % 12 % 4), avg(o_totalprice) from {table('orders')} where o_orderkey // 12 % 9 > 0 group by all").fetchall()
    assert {r["query"]: r["solo_ms"] for r in run("corun_solo_avg").collect()} == pytest.approx(dict(want), abs=1e-5)


def test_a_crash_in_a_late_order_leaves_its_combination_out(run):
    late = duckdb.sql(f"select distinct 'c' || (o_orderkey % 12) from {table('orders')} where o_orderkey % 12 = 5 and o_orderstatus = 'P'").fetchall()
    assert late and {r["combo"] for r in run("corun_speedup").collect()} == {f"c{i}" for i in range(12)} - {x for x, in late}


def test_every_customer_is_admitted_in_a_bounded_workload(run):
    rows = run("corun_admission").collect()
    keys = {x for x, in duckdb.sql(f"select c_custkey from {table('customer')}").fetchall()}
    assert len(rows) == len(keys) and {r["seq"] for r in rows} == keys and max(keys) >= 150
    of, total = {}, {}
    for r in rows:
        of.setdefault(r["workload"], []).append(r)
        total[r["workload"], r["batch"]] = total.get((r["workload"], r["batch"]), 0) + r["bytes"]
    assert max(map(len, of.values())) <= 100 and max(total.values()) <= 1_600_000_000


@pytest.mark.parametrize("name,rows", [
    ("project_alias", "select count(*) from {customer}"),
    ("expr_assoc", "select count(*) from {part}"),
    ("expr_neg", "select count(*) from {part}"),
    ("expr_pow", "select count(*) from {part}"),
    ("expr_div_int", "select count(*) from {part}"),
    ("expr_cast_dialect", "select count(*) from {part}"),
    ("join_left", "select count(*) from {customer}"),
    ("join_right", "select count(*) from {part}"),
    ("join_theta", "select count(*) from {nation} n, {region} r where n_regionkey > r_regionkey"),
    ("expr_interval", "select count(distinct o_orderstatus) from {orders}"),
])
def test_operator_reaches_every_row(run, name, rows):
    of = {t: table(t) for t in ("customer", "part", "nation", "region", "orders")}
    assert run(f"{name}").count() == duckdb.sql(rows.format(**of)).fetchall()[0][0]


def test_aggregated_operators_count_every_row(run):
    n = duckdb.sql(f"select count(*) from {table('lineitem')}").fetchall()[0][0]
    for name in ("expr_arith", "expr_cast"):
        assert sum(r["n"] for r in run(name).collect()) == n
    days = duckdb.sql(f"select cast(sum(date_diff('day', timestamp '1995-01-01', o_orderdate)) as bigint) from {table('orders')}").fetchall()[0][0]
    assert sum(r["days"] for r in run("expr_interval").collect()) == days


def test_duplicate_keys_count_every_pair(run):
    want = duckdb.sql(f"select count(*) from {table('part')} a join {table('part')} b on a.p_size = b.p_size").fetchall()[0][0]
    assert run("join_duplicate_keys").first()["n"] == want
