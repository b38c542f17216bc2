"""Every query with an oracle against DuckDB, the dialect's rewrites, and a test for each defect that must not come back."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import predicates
from millrace.operators import encoding
from millrace.operators.star import StarQuery
from millrace.plans import analytics, dialect, micro, ssb

SF = "/root/testdata/sf0.001"
BASE = ssb.queries() | micro.queries() | analytics.queries()
SQL = ssb.oracles() | micro.oracles() | analytics.oracles()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in micro.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if type(v).__name__ == "Decimal" or isinstance(v, float):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(BASE))
def test_query_equals_oracle(spark, duck, name):
    df = BASE[name](spark, SF)
    result = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    at = [list(result.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(BASE) <= set(entry.queries())


@pytest.mark.parametrize("given,wanted", [
    ("select 1 from t where a ^= 2;", "select 1 from t where a <> 2"),
    ("select a ** 2 from t", "select power(a, 2) from t"),
    ("select f(a) ** -b.c from t", "select power(f(a), -b.c) from t"),
    ("select '^= ** (+)' -- ^=\n from t", "select '^= ** (+)' -- ^=\n from t"),
    ("select \"A b\" from t", "select `A b` from t"),
    ("select cast(a as number(10,2)), cast(b as varchar2(5)), number from t", "select cast(a as DECIMAL(10,2)), cast(b as VARCHAR(5)), number from t"),
    ("select 1 from t where x = any (1, 2)", "select 1 from t where (x = 1 OR x = 2)"),
    ("select 1 from t where x is not nan", "select 1 from t where NOT isnan(x)"),
    ("select x from a, b where a.k = b.k(+) and b.v ( + ) = 1 and a.x between 1 and 2 order by x", "select x from a LEFT JOIN b ON a.k = b.k AND b.v = 1 WHERE a.x between 1 and 2 order by x"),
    ("select 1 from a p, b q, c where p.k = q.k and q.j = c.j(+)", "select 1 from a p CROSS JOIN b q LEFT JOIN c ON q.j = c.j WHERE p.k = q.k"),
    ("select a.t at time zone '-05:00' from a", "select from_utc_timestamp(a.t, '-05:00') from a"),
])
def test_dialect_rewrites(given, wanted):
    assert " ".join(dialect.translate(given).split()) == " ".join(wanted.split())


@pytest.mark.parametrize("bad", ["select 1 from a, b where x = y (+)", "select 1 from a, b where a.x(+) = b.x(+)", "select 1 from a, b where a.x = 1 and c.x(+) = 2", "select 1 from (select 1 from a, b where a.x = b.x(+))", "select rownum from t", "select 1; select 2"])
def test_dialect_rejects(bad):
    with pytest.raises(dialect.DialectError):
        dialect.translate(bad)


def test_strict_subset(spark):
    with pytest.raises(dialect.DialectError):
        dialect.run(spark, "select case when 1 = 1 then 2 end", strict=True)


def test_quantifiers_with_nulls_and_empty_sets(spark):
    t = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    some, none, empty = (spark.createDataFrame(v, "y int") for v in ([(1,), (2,)], [(1,), (None,)], []))
    got = lambda f, op, v: sorted((r[0] for r in f(t, F.col("x"), op, v, "y").collect()), key=str)
    assert got(predicates.compare_any, "<", some) == [1] and got(predicates.compare_any, "=", none) == [1]
    assert got(predicates.compare_any, "<>", some) == [1, 2] and got(predicates.compare_any, ">", empty) == []
    assert got(predicates.compare_all, ">=", some) == [2] and got(predicates.compare_all, ">=", none) == []
    assert got(predicates.compare_all, "<", empty) == [1, 2, None] and got(predicates.compare_all, "<>", none) == []
    assert got(predicates.compare_all, "<>", empty) == [1, 2, None]


# --- defects of the original design


@pytest.fixture(scope="module")
def small(spark):
    fact = spark.createDataFrame([(1, 10, "1", "23"), (2, 20, "12", "3"), (2, 30, "12", "3"), (9, 5, "x", "y")], "k int, v int, a string, b string")
    dim = spark.createDataFrame([(1, "p"), (2, "q"), (2, "r")], "d int, name string")
    return fact, dim


def test_keys_that_concatenate_alike_stay_apart(small):
    assert StarQuery(small[0]).group_by("a", "b").agg(F.sum("v").alias("s")).build().count() == 3


def test_repeated_dimension_keys_multiply(small):
    rows = StarQuery(small[0]).join(small[1], "k", "d").group_by("name").agg(F.sum("v").alias("s")).order_by(F.col("s").desc(), F.col("name")).build().collect()
    assert [tuple(r) for r in rows] == [("q", 50), ("r", 50), ("p", 10)]


def test_every_sort_key_counts(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 2, 2), (0, 5, 5)], "a int, b int, c int")
    got = StarQuery(df).group_by("a", "b", "c").order_by(F.col("a"), F.col("b").desc(), F.col("c")).build().collect()
    assert [tuple(r) for r in got] == [(0, 5, 5), (1, 2, 2), (1, 2, 3), (1, 1, 1)]


def test_sort_has_no_row_limit(spark):
    rows = [r[0] for r in spark.range(5000).orderBy(F.col("id").desc()).collect()]
    assert rows == list(range(4999, -1, -1))


def test_sums_are_exact_and_null_when_empty(spark):
    big = spark.createDataFrame([(2**53,), (1,), (1,)], "v long")
    assert StarQuery(big).agg(F.sum("v").alias("s")).build().first()[0] == 2**53 + 2
    assert StarQuery(big).where(F.col("v") < 0).agg(F.sum("v").alias("s")).build().first()[0] is None


def test_an_item_that_is_not_grouped_is_rejected(small):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        small[0].createOrReplaceTempView("small_fact") or dialect.run(small[0].sparkSession, "select a, v from small_fact group by a")


def test_having(small):
    q = StarQuery(small[0]).group_by("a").agg(F.sum("v").alias("s")).having(F.col("s") > 20)
    assert [r["a"] for r in q.build().collect()] == ["12"]


def test_prefilter_gives_the_same(spark):
    for name in ("q2_1", "q3_1", "q4_1"):
        assert ssb.frame(spark, SF, name).collect() == ssb.frame(spark, SF, name, prefilter=True).collect()


def test_dictionary_or_filter_equals_plain(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}" if i % 5 else None) for i in range(100)], "id int, v string")
    coded, codes = encoding.dict_encode(df, "v")
    test = lambda c: (F.col(c) == "v1") | (F.col(c) > "v4")
    assert {r["id"] for r in encoding.dict_filter(coded, codes, test("value")).collect()} == {r["id"] for r in df.filter(test("v")).collect()}
    assert {tuple(r) for r in encoding.dict_decode(coded, codes, "v").select("id", "v").collect()} == {tuple(r) for r in df.collect()}


def test_run_lengths_and_prefix_sums_over_blocks(spark):
    vals = [1, 1, 2, 2, 2, None, None, 3, 3, 3, 3, 1]
    df = spark.createDataFrame(list(enumerate(vals)), "pos long, v int")
    runs = encoding.rle_encode(df, "pos", "v", block=5)
    assert sorted(tuple(r) for r in encoding.rle_decode(runs).collect()) == list(enumerate(vals)) or {tuple(r) for r in encoding.rle_decode(runs).collect()} == set(enumerate(vals))
    assert {(r["pos"], r["run_length"]) for r in runs.collect()} == {(0, 2), (2, 3), (5, 2), (7, 4), (11, 1)}  # a run goes on past its block
    got = {r["pos"]: r["prefix"] for r in encoding.prefix_sum(df, "pos", "v", block=5).collect()}
    total = 0
    for i, v in enumerate(vals):
        total += v or 0
        assert got[i] == total


# --- plans


def text_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = text_of(spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity < 5").select("l_partkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]" in plan and "l_comment" not in plan
    plan = text_of(ssb.frame(spark, SF, "q1_1"))
    assert "l_returnflag" not in plan and "l_shipdate" not in plan and "Python" not in plan and "CartesianProduct" not in plan


#: What the scans of each star query must be given, by column.
PUSHED = {
    "q1_1": ["LessThan(l_quantity,25.0)", "GreaterThan(l_discount", "GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"],
    "q1_2": ["GreaterThanOrEqual(l_quantity,26.0)", "LessThan(l_discount", "GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"],
    "q1_3": ["GreaterThanOrEqual(l_quantity,26.0)", "LessThan(l_discount", "GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"],
    "q2_1": ["EqualTo(p_brand,Brand#2)", "EqualTo(r_name,AMERICA)"],
    "q2_2": ["EqualTo(p_brand,Brand#7)", "GreaterThanOrEqual(p_size,21)", "EqualTo(r_name,ASIA)"],
    "q2_3": ["EqualTo(p_brand,Brand#7)", "EqualTo(p_size,39)", "EqualTo(r_name,EUROPE)"],
    "q3_1": ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate", "EqualTo(r_name,ASIA)"],
    "q3_2": ["GreaterThanOrEqual(o_orderdate", "EqualTo(n_name,NATION_11)"],
    "q3_3": ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"],
    "q3_4": ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"],
    "q4_1": ["In(p_brand", "EqualTo(r_name,AMERICA)"],
    "q4_2": ["In(p_brand", "GreaterThanOrEqual(o_orderdate", "EqualTo(r_name,AMERICA)"],
    "q4_3": ["EqualTo(p_brand,Brand#4)", "GreaterThanOrEqual(o_orderdate", "EqualTo(n_name,NATION_11)"],
}


@pytest.mark.parametrize("name", sorted(ssb.SPECS))
def test_star_conditions_reach_the_scans(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    pushed = " ".join(line.partition("PushedFilters:")[2] for line in text_of(ssb.frame(spark, SF, name)).splitlines())
    assert all(p in pushed for p in PUSHED[name]), pushed


def test_part_is_read_once_and_joins_before_the_orders(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    lines = text_of(ssb.frame(spark, SF, "q4_1")).splitlines()
    part = [i for i, line in enumerate(lines) if "part.parquet" in line]
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :|+-"))
    fact = next(i for i in joins if "lo_orderkey" in lines[i])
    assert len(part) == 1 and any(fact < j < part[0] and depth(j) > depth(fact) and "lo_partkey" in lines[j] for j in joins)


def test_scan_conditions_keep_every_row_that_counts(spark):
    """Without them each query gives the same."""
    from dataclasses import replace

    for name, spec in list(ssb.SPECS.items()):
        with_scan = ssb.frame(spark, "/root/testdata/sf0.01", name).collect()
        ssb.SPECS[name] = replace(spec, scan=())
        try:
            assert ssb.frame(spark, "/root/testdata/sf0.01", name).collect() == with_scan
        finally:
            ssb.SPECS[name] = spec


def test_dictionary_codes_follow_the_order_over_ranges(spark):
    values = [f"v{i:03}" for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id int, v string")
    coded, codes = encoding.dict_encode(df, "v", ranges=7)
    assert {r["id"]: r["code"] for r in coded.collect()} == {i: i for i in range(300)} | {999: None}
    assert "SinglePartition" not in text_of(coded)


def test_joins_on_encoded_keys_equal_plain_joins(spark):
    a = spark.createDataFrame([(i, f"v{i % 7}") for i in range(60)], "id int, v string")
    b = spark.createDataFrame([(f"v{i % 9}", i) for i in range(3, 20)], "v string, w int")
    got = encoding.dict_join(encoding.dict_encode(a, "v"), encoding.dict_encode(b, "v")).select("id", "w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, "v").select("id", "w").collect()))


def test_all_star_queries_stay_in_the_engine(spark):
    for name in ssb.SPECS:
        plan = text_of(ssb.frame(spark, SF, name))
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
