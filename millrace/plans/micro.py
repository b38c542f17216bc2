"""One query per operator of the SQL surface, each with its oracle.

``SHARED`` texts run in both engines as they are (the Spark side through the
dialect); ``PAIRS`` differ in a form only one engine has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return dialect.run(spark, text)


N = "cast(count(*) as bigint) as n"
CENTS = "cast(round(l_extendedprice * 100) as bigint)"
_DAYS = "cast(sum(d) as bigint) as days, min(d) as lo, max(d) as hi"

SHARED: dict[str, str] = {}
PAIRS: dict[str, tuple[str, str]] = {}

# --- comparisons of a column with a literal, by type
_OPS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
for _name, _op in _OPS.items():
    SHARED[f"filter_{_name}_int"] = f"select p_size, {N} from part where p_size {_op} 25 group by p_size"
    SHARED[f"filter_{_name}_double"] = f"select l_returnflag, {N} from lineitem where l_discount {_op} 0.05 group by l_returnflag"
    SHARED[f"filter_{_name}_str"] = f"select p_brand, {N} from part where p_brand {_op} 'Brand#17' group by p_brand"

SHARED |= {
    # --- scans and projection
    "scan_project": "select s_suppkey, s_name, s_nationkey from supplier",
    "scan_no_where": "select r_regionkey, r_name from region",
    "scan_star": "select * from nation",
    "scan_qualified_star": "select n.*, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey",
    "project_alias": "select c_custkey as k, c_mktsegment as segment from customer",
    "project_constant": "select n_name, 7 as seven from nation",
    "case_insensitive": "SELECT N_NAME AS n_name FROM Nation WHERE n_REGIONKEY = 2",
    "select_distinct": "select distinct o_orderpriority, o_orderstatus from orders",
    # --- boolean structure
    "filter_and": f"select l_linestatus, {N} from lineitem where l_quantity < 25 and l_discount >= 0.03 and l_returnflag = 'R' group by l_linestatus",
    "filter_or": f"select l_linestatus, {N} from lineitem where l_quantity < 3 or l_quantity > 48 or l_returnflag = 'R' group by l_linestatus",
    "filter_nested": f"select p_type, {N} from part where (p_size < 10 and p_brand = 'Brand#3') or (p_size > 40 and (p_brand = 'Brand#5' or p_type = 'PROMO')) group by p_type",
    "filter_or_per_table": "select c_custkey, s_suppkey from customer, supplier where c_nationkey = s_nationkey and (c_mktsegment = 'BUILDING' or c_mktsegment = 'MACHINERY') and (s_suppkey = 1 or s_suppkey = 5)",
    "filter_lit_left": f"select p_size, {N} from part where 45 < p_size group by p_size",
    "filter_col_col": "select l_orderkey, l_partkey, l_linenumber from lineitem where l_suppkey = l_linenumber and l_quantity > l_linenumber",
    "filter_range": f"select {N} from lineitem where l_discount >= 0.02 and l_discount <= 0.04",
    "filter_str_range": f"select p_brand, {N} from part where p_brand >= 'Brand#12' and p_brand <= 'Brand#18' group by p_brand",
    "filter_like": "select p_partkey, p_name from part where p_name like '%red%'",
    "filter_not_like": f"select {N} from part where p_name not like 's%'",
    "filter_like_escape": "select n_nationkey, n_name from nation where n_name like 'NATION!_1_' escape '!'",
    "filter_is_null": "select n_nationkey from nation where nullif(n_regionkey, 3) is null",
    "filter_is_not_null": "select n_nationkey from nation where nullif(n_regionkey, 3) is not null",
    "filter_between": f"select p_size, {N} from part where p_size between 10 and 12 group by p_size",
    "filter_not_between": f"select p_size, {N} from part where p_size not between 3 and 48 group by p_size",
    "filter_in": f"select o_orderpriority, {N} from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by o_orderpriority",
    "filter_not_in": f"select o_orderstatus, {N} from orders where o_orderstatus not in ('F', 'P') group by o_orderstatus",
    "filter_in_subquery": f"select {N} from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    "filter_not": f"select {N} from orders where not (o_orderstatus = 'F' or o_totalprice > 100000)",
    "filter_exists": "select s_suppkey from supplier where exists (select 1 from nation where n_nationkey = s_nationkey and n_regionkey = 1)",
    "filter_not_exists": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "filter_text_with_angle": "select n_name, 'a < b > c' as t from nation where '<' <> '>' and n_nationkey < 3",
    "filter_long_literal": f"select {N} from part where p_name <> 'a literal that is a good deal longer than thirty-two bytes of text'",
    # --- expressions
    "expr_arith": f"select l_linenumber, cast(sum(x) as bigint) as x, min(x) as x_lo, max(x) as x_hi, cast(sum(y) as bigint) as y, min(y) as y_lo, max(y) as y_hi, {N} from (select l_linenumber, {CENTS} + 2 * l_linenumber - l_suppkey as x, ({CENTS} - l_partkey) * (l_linenumber + 1) as y from lineitem) e group by l_linenumber",
    "expr_assoc": "select p_partkey, p_size - 5 + 3 - 1 as a, p_size * 6 / 4 as b from part",
    "expr_nested": f"select cast(sum(({CENTS} * (100 - cast(round(l_discount * 100) as bigint)) + l_linenumber) * 2) as bigint) as x from lineitem",
    "expr_neg": "select p_partkey, -p_size as neg, +p_size as pos, p_size * -2 as twice from part",
    "expr_case": f"select case when l_quantity < 10 then 'few' when l_quantity < 30 then 'some' else 'many' end as how, {N} from lineitem group by case when l_quantity < 10 then 'few' when l_quantity < 30 then 'some' else 'many' end",
    "expr_case_simple": "select n_nationkey, case n_regionkey when 0 then 'zero' when 1 then 'one' end as r from nation",
    "expr_cast": f"select cast(l_quantity as integer) as q, cast(l_linenumber as varchar(10)) as t, {N} from lineitem group by cast(l_quantity as integer), cast(l_linenumber as varchar(10))",
    "expr_concat": "select n_name || '/' || cast(n_regionkey as varchar(5)) as t from nation",
    "expr_scalar_subquery": "select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part) and p_size = 7",
    "expr_coalesce": "select n_nationkey, coalesce(nullif(n_regionkey, 2), -1) as r from nation",
    # --- joins
    "join_inner": "select n_name, r_name from nation join region on n_regionkey = r_regionkey",
    "join_comma_n_way": f"select r_name, {N} from lineitem, orders, customer, nation, region where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = r_regionkey group by r_name",
    "join_left": "select c_custkey, count(o_orderkey) as n from customer left outer join orders on c_custkey = o_custkey group by c_custkey",
    "join_right": "select p_partkey, n_name from nation right outer join part on n_nationkey = p_size - 1",
    "join_full": "select a.n_name as a, b.p_size as b from (select n_nationkey, n_name from nation where n_nationkey > 3) a full outer join (select distinct p_size from part) b on a.n_nationkey = b.p_size",
    "join_cross": "select a.r_name as a, b.r_name as b from region a cross join region b",
    "join_using": "select n_name, cast(s as bigint) as s from nation join (select s_nationkey as n_nationkey, count(*) as s from supplier group by s_nationkey) using (n_nationkey)",
    "join_natural": "select n_name, k from nation natural join (select n_nationkey, n_regionkey, n_nationkey * 2 as k from nation where n_regionkey = 1)",
    "join_multikey": f"select {N} from lineitem a join (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'A') b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber",
    "join_self": "select a.n_name as a, b.n_name as b from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_theta": "select r.r_name, n.n_name from region r join nation n on n.n_regionkey > r.r_regionkey",
    # every pair is counted; the build side repeats a key once a brand, with its rows as a number, so that the join stays linear
    "join_duplicate_keys": "select cast(sum(b.c) as bigint) as n from (select p_size as k from part) a join (select p_size as k, p_brand, count(*) as c from part group by p_size, p_brand) b on a.k = b.k",
    "join_bushy": "select x.r_name, cast(sum(y.n) as bigint) as n from (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey) x join (select s_nationkey, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by s_nationkey) y on x.n_nationkey = y.s_nationkey group by x.r_name",
    # --- aggregation
    "agg_sum": f"select l_returnflag, l_linestatus, cast(sum({CENTS}) as bigint) as cents from lineitem group by l_returnflag, l_linestatus",
    "agg_avg": "select l_returnflag, round(avg(l_quantity), 6) as q from lineitem group by l_returnflag",
    "agg_count": f"select o_orderstatus, count(o_orderkey) as n from orders group by o_orderstatus",
    "agg_count_star": f"select o_orderstatus, {N} from orders group by o_orderstatus",
    "agg_count_nulls": "select count(nullif(n_regionkey, 1)) as some, count(*) as every from nation",
    "agg_min": "select p_brand, min(p_retailprice) as lo, min(p_name) as first from part group by p_brand",
    "agg_max": "select p_brand, max(p_retailprice) as hi, max(p_name) as last from part group by p_brand",
    "agg_count_distinct": "select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag",
    "agg_global": f"select cast(sum({CENTS}) as bigint) as s, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi from lineitem",
    "agg_empty": f"select cast(sum({CENTS}) as bigint) as s, count(*) as n from lineitem where l_quantity < 0",
    "agg_empty_grouped": f"select l_returnflag, count(*) as n from lineitem where l_quantity < 0 group by l_returnflag",
    "agg_having": f"select p_brand, {N} from part group by p_brand having count(*) > 70",
    "agg_expr": f"select l_returnflag, cast(sum({CENTS}) as bigint) + count(*) as x from lineitem group by l_returnflag",
    "agg_ratio": f"select l_returnflag, round(cast(sum({CENTS}) as double) / count(*), 4) as x from lineitem group by l_returnflag",
    "agg_group_expr": f"select l_linenumber % 3 as k, {N} from lineitem group by l_linenumber % 3",
    "agg_group_double": f"select l_discount as k, {N} from lineitem group by l_discount",
    "agg_ambiguous_keys": f"select a, b, {N} from (select cast(p_size as varchar(5)) as a, cast(p_partkey % 30 as varchar(5)) as b from part) group by a, b",
    "agg_large_sum": f"select cast(sum({CENTS} * 1000) as bigint) as s from lineitem",
    "agg_rollup": f"select o_orderstatus, o_orderpriority, {N} from orders group by rollup(o_orderstatus, o_orderpriority)",
    "agg_cube": f"select o_orderstatus, o_orderpriority, {N} from orders group by cube(o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": f"select o_orderstatus, o_orderpriority, {N} from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    # --- order
    "sort_one": "select n_name from nation order by n_name desc",
    "sort_two_mixed": "select n_regionkey, n_name from nation order by n_regionkey asc, n_name desc",
    "sort_three": f"select l_returnflag, l_linestatus, l_linenumber, {N} from lineitem group by l_returnflag, l_linestatus, l_linenumber order by l_returnflag, l_linestatus desc, n",
    "sort_alias": f"select p_brand as b, {N} from part group by p_brand order by n desc, b",
    "sort_aggregate": f"select p_brand, {N} from part group by p_brand order by count(*), p_brand",
    "sort_many_rows": "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey",
    "sort_nulls": "select n_nationkey, nullif(n_regionkey, 1) as r from nation order by r desc nulls last, n_nationkey",
    "limit_top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    # --- subqueries
    "sub_derived": f"select b, n from (select p_brand as b, {N} from part group by p_brand) x where n > 60",
    "sub_nested_agg": f"select max(n) as most, min(n) as least from (select o_custkey, {N} from orders group by o_custkey) x",
    "sub_scalar": f"select r_name, (select count(*) from nation where n_regionkey = r_regionkey) as n from region",
    "sub_pushdown_alias": "select k, s from (select l_suppkey as k, cast(sum(l_linenumber) as bigint) as s from lineitem group by l_suppkey) x where k < 20",
}

PAIRS |= {
    "filter_caret_ne": (f"select p_size, {N} from part where p_size ^= 1 group by p_size", f"select p_size, {N} from part where p_size <> 1 group by p_size"),
    "filter_any_eq": (f"select {N} from part where p_size = any (select n_nationkey from nation where n_regionkey = 1)", f"select {N} from part where p_size in (select n_nationkey from nation where n_regionkey = 1)"),
    "filter_any_lt": (f"select p_size, {N} from part where p_size < any (select n_nationkey from nation where n_regionkey = 2) group by p_size", f"select p_size, {N} from part where p_size < (select max(n_nationkey) from nation where n_regionkey = 2) group by p_size"),
    "filter_some_list": (f"select p_size, {N} from part where p_size = some (1, 3, 5) group by p_size", f"select p_size, {N} from part where p_size in (1, 3, 5) group by p_size"),
    "filter_all_ge": (f"select p_size, {N} from part where p_size >= all (select n_nationkey from nation) group by p_size", f"select p_size, {N} from part where p_size >= (select max(n_nationkey) from nation) group by p_size"),
    "filter_all_empty": (f"select {N} from part where p_size > all (select n_nationkey from nation where n_nationkey < 0)", f"select {N} from part"),
    "filter_all_ne": (f"select {N} from part where p_size <> all (select n_nationkey from nation)", f"select {N} from part where p_size not in (select n_nationkey from nation)"),
    "filter_regexp": ("select p_partkey, p_name from part where regexp_like(p_name, '^s.*g$')", "select p_partkey, p_name from part where regexp_matches(p_name, '^s.*g$')"),
    "filter_is_nan": (f"select {N} from lineitem where l_discount is not nan", f"select {N} from lineitem where not isnan(l_discount)"),
    "filter_is_infinite": (f"select {N} from lineitem where l_discount is infinite", f"select {N} from lineitem where isinf(l_discount)"),
    "filter_likec": ("select n_name from nation where n_name likec '%_2'", "select n_name from nation where n_name like '%_2'"),
    "expr_pow": ("select p_partkey, p_size ** 2 + 1 as x from part", "select p_partkey, power(p_size, 2) + 1 as x from part"),
    "expr_div_int": ("select p_partkey, p_size div 7 as q, p_size % 7 as r from part", "select p_partkey, cast(p_size // 7 as bigint) as q, p_size % 7 as r from part"),
    "expr_cast_dialect": ("select p_partkey, cast(p_retailprice as number(10, 2)) as d, cast(p_size as binary_double) as f, cast(p_brand as varchar2(20)) as t from part", "select p_partkey, cast(p_retailprice as decimal(10, 2)) as d, cast(p_size as double) as f, p_brand as t from part"),
    "expr_interval": (
        f"select o_orderstatus, {_DAYS} from (select o_orderstatus, cast(extract(day from (o_orderdate - timestamp '1995-01-01 00:00:00') day to second) as bigint) as d from orders) x group by o_orderstatus",
        f"select o_orderstatus, {_DAYS} from (select o_orderstatus, cast(date_diff('day', timestamp '1995-01-01 00:00:00', o_orderdate) as bigint) as d from orders) x group by o_orderstatus",
    ),
    "expr_quoted_name": ('select "n_name" as "n" from nation', "select n_name as n from nation"),
    "expr_sysdate": (f"select {N} from orders where o_orderdate < sysdate", f"select {N} from orders"),
    "agg_count_distinct_call": ("select l_returnflag, count_distinct(l_partkey) as n from lineitem group by l_returnflag", "select l_returnflag, count(distinct l_partkey) as n from lineitem group by l_returnflag"),
    "join_semi": ("select c_custkey from customer left semi join orders on c_custkey = o_custkey", "select c_custkey from customer where c_custkey in (select o_custkey from orders)"),
    "join_anti": ("select c_custkey from customer left anti join orders on c_custkey = o_custkey and o_totalprice > 300000", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)"),
    "trailing_semicolon": ("select r_name from region;", "select r_name from region"),
}

_MEANS = "round({sd}(l_quantity), 6) as sd, round({var}(l_quantity), 6) as var, round({sdp}(l_quantity), 6) as sd_all, round({varp}(l_quantity), 6) as var_all"
_FITS = "round(corr(l_quantity, l_extendedprice), 6) as corr, round(covar_pop(l_quantity, l_discount), 6) as cov, round(covar_samp(l_quantity, l_discount), 6) as cov_samp, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, regr_count(l_extendedprice, l_quantity) as n"

SHARED |= {
    # --- set operations and named subqueries
    "set_union": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "set_union_all": f"select k, {N} from (select c_nationkey as k from customer union all select s_nationkey from supplier) x group by k",
    "set_intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "set_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_suppkey % 3 = 0",
    "set_nested": "(select n_nationkey as k from nation where n_regionkey < 3 intersect select s_nationkey from supplier) union select n_nationkey from nation where n_regionkey = 4",
    "with_one": f"with big as (select o_custkey, {N} from orders group by o_custkey) select n, count(*) as customers from big group by n",
    "with_two": f"with a as (select c_nationkey as k, {N} from customer group by c_nationkey), b as (select n_name, n from a join nation on k = n_nationkey) select n_name, n from b where n > (select avg(n) from a)",
    "limit_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 7 offset 5",
    # --- statistics
    "agg_deviation": f"select l_returnflag, {_MEANS.format(sd='stddev', var='variance', sdp='stddev_pop', varp='var_pop')} from lineitem group by l_returnflag",
    "agg_regression": f"select l_returnflag, {_FITS} from lineitem group by l_returnflag",
    # --- windows, partitioned
    "window_rank": "select c_nationkey, c_custkey, r from (select c_nationkey, c_custkey, rank() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) x where r <= 3",
    "window_running": f"select o_custkey, o_orderkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as bigint) as cents from orders",
    "window_neighbours": "select l_orderkey, l_linenumber, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as before, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as after from lineitem",
    "window_share": f"select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as r, count(*) over (partition by n_regionkey) as n from nation",
}

PAIRS |= {
    "join_outer_sign": (
        "select c.c_custkey, o.o_orderkey, n_name from customer c, orders o, nation n where c.c_custkey = o.o_custkey(+) and o.o_totalprice (+) between 300000 and 400000 and n.n_nationkey = c.c_nationkey and c.c_acctbal > 0",
        "select c.c_custkey, o.o_orderkey, n_name from customer c join nation n on n.n_nationkey = c.c_nationkey left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice between 300000 and 400000 where c.c_acctbal > 0",
    ),
    "expr_time_zone": (
        f"select extract(hour from (o_orderdate at time zone '-05:00')) as h, cast(sum(extract(day from o_orderdate at time zone '-05:00')) as bigint) as days, {N} from orders group by extract(hour from (o_orderdate at time zone '-05:00'))",
        f"select cast(hour(o_orderdate - interval 5 hour) as integer) as h, cast(sum(day(o_orderdate - interval 5 hour)) as bigint) as days, {N} from orders group by hour(o_orderdate - interval 5 hour)",
    ),
    "set_minus": ("select n_nationkey as k from nation minus select s_nationkey from supplier", "select n_nationkey as k from nation except select s_nationkey from supplier"),
}


def queries() -> dict:
    out = {n: (lambda s, d, t=t: sql(s, d, t)) for n, t in SHARED.items()}
    return out | {n: (lambda s, d, t=t[0]: sql(s, d, t)) for n, t in PAIRS.items()}


def oracles() -> dict[str, str]:
    return dict(SHARED) | {n: t[1] for n, t in PAIRS.items()}
