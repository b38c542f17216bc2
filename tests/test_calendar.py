"""Star sums keep orders of any date."""

import duckdb

from millrace.plans import ssb

SF = "/root/testdata/sf0.001"


def test_orders_before_1990_and_after_2009_count(spark, tmp_path):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "orders"):
        rows = "*" if t != "orders" else "* replace (case o_orderkey % 3 when 0 then o_orderdate - interval 30 year when 1 then o_orderdate + interval 30 year else o_orderdate end as o_orderdate)"
        c.execute(f"copy (select {rows} from read_parquet('{SF}/{t}.parquet')) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    want = c.execute(ssb.oracle("q4_1")).fetchall()
    got = [tuple(r) for r in ssb.frame(spark, str(tmp_path), "q4_1").collect()]
    assert got == want and min(r[0] for r in got) < 1990 and max(r[0] for r in got) > 2009


def test_no_orders_make_an_empty_calendar(spark, tmp_path):
    spark.read.parquet(f"{SF}/orders.parquet").limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    assert ssb.Views(spark, str(tmp_path))["ddate"].count() == 0
