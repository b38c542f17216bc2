"""The Star Schema Benchmark over the driver's tables: views, and the thirteen queries as data.

Each query is one ``Spec``; ``frame`` builds it with ``StarQuery``, ``spark_sql``
and ``oracle`` render it as SQL. Sums are of integers: prices in cents, revenue
and profit in ten-thousandths.

The fact is two tables. ``frame`` cuts each by its own dimensions first (lines
by supplier and part, orders by customer and date) and joins what is left; the
supply cost comes with the part. The views compute most columns, which hides
conditions from the scan, so a spec also states them on the raw columns
(``scan``), as wide or wider; the exact ones follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.star import StarQuery
from ..sources.ssbgen import calendar, day_columns


@dataclass(frozen=True)
class Spec:
    measure: str
    name: str
    keys: tuple[str, ...] = ()
    fact: str = "true"
    date: str = "true"
    customer: str | None = None
    supplier: str | None = None
    part: str | None = None
    order: tuple[tuple[str, bool], ...] = ()  # (column, ascending)
    scan: tuple[tuple[str, str], ...] = ()  # (raw table, condition)


# The benchmark's queries, literals moved into the tables' domain.
_DISCOUNTED = {"measure": "lo_extendedprice * lo_discount", "name": "revenue"}
_BRAND = {"measure": "lo_revenue", "name": "revenue", "keys": ("d_year", "p_brand1"), "order": (("d_year", True), ("p_brand1", True))}
_YEARS = "d_year >= 1995 and d_year <= 2000"
_FLOW = {"measure": "lo_revenue", "name": "revenue", "order": (("d_year", True), ("revenue", False))}
_PROFIT = {"measure": "lo_revenue - lo_supplycost", "name": "profit"}
_MAKERS = "p_mfgr = 'MFGR#1' or p_mfgr = 'MFGR#2'"
SPECS = {
    "q1_1": Spec(**_DISCOUNTED, fact="lo_discount >= 1 and lo_discount <= 3 and lo_quantity < 25", date="d_year = 1996", scan=(("lineitem", "l_discount > 0.004 and l_discount < 0.036 and l_quantity < 25"), ("orders", "o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01'"),)),
    "q1_2": Spec(**_DISCOUNTED, fact="lo_discount >= 4 and lo_discount <= 6 and lo_quantity >= 26 and lo_quantity <= 35", date="d_yearmonthnum = 199701", scan=(("lineitem", "l_discount > 0.034 and l_discount < 0.066 and l_quantity >= 26 and l_quantity < 36"), ("orders", "o_orderdate >= '1997-01-01' and o_orderdate < '1997-02-01'"),)),
    "q1_3": Spec(**_DISCOUNTED, fact="lo_discount >= 5 and lo_discount <= 7 and lo_quantity >= 26 and lo_quantity <= 35", date="d_weeknuminyear = 6 and d_year = 1997", scan=(("lineitem", "l_discount > 0.044 and l_discount < 0.076 and l_quantity >= 26 and l_quantity < 36"), ("orders", "o_orderdate >= '1997-01-01' and o_orderdate < '1998-01-01'"),)),
    "q2_1": Spec(**_BRAND, part="p_category = 'MFGR#12'", supplier="s_region = 'AMERICA'", scan=(("part", "p_brand = 'Brand#2'"),)),
    "q2_2": Spec(**_BRAND, part="p_brand1 >= 'MFGR#2221' and p_brand1 <= 'MFGR#2228'", supplier="s_region = 'ASIA'", scan=(("part", "p_brand = 'Brand#7' and p_size >= 21 and p_size <= 28"),)),
    "q2_3": Spec(**_BRAND, part="p_brand1 = 'MFGR#2239'", supplier="s_region = 'EUROPE'", scan=(("part", "p_brand = 'Brand#7' and p_size = 39"),)),
    "q3_1": Spec(**_FLOW, keys=("c_nation", "s_nation", "d_year"), customer="c_region = 'ASIA'", supplier="s_region = 'ASIA'", date=_YEARS, scan=(("orders", "o_orderdate >= '1995-01-01' and o_orderdate < '2001-01-01'"),)),
    "q3_2": Spec(**_FLOW, keys=("c_city", "s_city", "d_year"), customer="c_nation = 'NATION_11'", supplier="s_nation = 'NATION_11'", date=_YEARS, scan=(("orders", "o_orderdate >= '1995-01-01' and o_orderdate < '2001-01-01'"),)),
    "q3_3": Spec(**_FLOW, keys=("c_city", "s_city", "d_year"), customer="c_city = 'NATION_11_1' or c_city = 'NATION_11_5'", supplier="s_city = 'NATION_11_1' or s_city = 'NATION_11_5'", date=_YEARS, scan=(("orders", "o_orderdate >= '1995-01-01' and o_orderdate < '2001-01-01'"),)),
    "q3_4": Spec(**_FLOW, keys=("c_city", "s_city", "d_year"), customer="c_city = 'NATION_17_7' or c_city = 'NATION_24_5'", supplier="s_city = 'NATION_9_0' or s_city = 'NATION_19_1'", date="d_yearmonth = 'Dec1997'", scan=(("orders", "o_orderdate >= '1997-12-01' and o_orderdate < '1998-01-01'"),)),
    "q4_1": Spec(**_PROFIT, keys=("d_year", "c_nation"), customer="c_region = 'AMERICA'", supplier="s_region = 'AMERICA'", part=_MAKERS, order=(("d_year", True), ("c_nation", True)), scan=(("part", "p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9', 'Brand#10')"),)),
    "q4_2": Spec(**_PROFIT, keys=("d_year", "s_nation", "p_category"), customer="c_region = 'AMERICA'", supplier="s_region = 'AMERICA'", part=_MAKERS, date="d_year = 1997 or d_year = 1998", order=(("d_year", True), ("s_nation", True), ("p_category", True)), scan=(("part", "p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9', 'Brand#10')"), ("orders", "o_orderdate >= '1997-01-01' and o_orderdate < '1999-01-01'"),)),
    "q4_3": Spec(**_PROFIT, keys=("d_year", "s_city", "p_brand1"), customer="c_region = 'AMERICA'", supplier="s_nation = 'NATION_11'", part="p_category = 'MFGR#14'", date="d_year = 1997 or d_year = 1998", order=(("d_year", True), ("s_city", True), ("p_brand1", True)), scan=(("part", "p_brand = 'Brand#4'"), ("orders", "o_orderdate >= '1997-01-01' and o_orderdate < '1999-01-01'"),)),
}

KEYS = {"customer": ("customer_ssb", "lo_custkey", "c_custkey"), "supplier": ("supplier_ssb", "lo_suppkey", "s_suppkey"), "part": ("part_ssb", "lo_partkey", "p_partkey"), "date": ("ddate", "lo_orderdate", "d_datekey")}


class Tables(dict):
    """Parquet tables of a folder, opened when first asked for. Kept, they are a catalog: later queries don't read the files' schemas again."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


class _Scans(dict):
    """Tables under the conditions of a spec's ``scan``."""

    def __init__(self, tables: Tables, scan: tuple[tuple[str, str], ...]):
        self.tables, self.scan = tables, dict(scan)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.tables[name].filter(self.scan[name]) if name in self.scan else self.tables[name]
        return self[name]


class Views(dict):
    """The star views as lazy DataFrames, made when first asked for; each query reads only the columns it uses."""

    NAMES = ("lineorder", "lineorder_cost", "customer_ssb", "supplier_ssb", "part_ssb", "ddate")

    def __init__(self, spark: SparkSession, sf_dir: str, scan: tuple[tuple[str, str], ...] = (), tables: Tables | None = None):
        self.spark, self.t = spark, _Scans(Tables(spark, sf_dir) if tables is None else tables, scan)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = _view(self.spark, self.t, self, name)
        return self[name]


def _view(spark: SparkSession, t: _Scans, v: Views, name: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    if name == "lines":
        return t["lineitem"].select(F.col("l_orderkey").alias("lo_orderkey"), F.col("l_linenumber").alias("lo_linenumber"), F.col("l_partkey").alias("lo_partkey"), F.col("l_suppkey").alias("lo_suppkey"), F.col("l_quantity").cast("int").alias("lo_quantity"), F.round(F.col("l_discount") * 100).cast("int").alias("lo_discount"), F.round(F.col("l_tax") * 100).cast("int").alias("lo_tax"), cents("l_extendedprice").alias("lo_extendedprice")).withColumn("lo_revenue", F.col("lo_extendedprice") * (100 - F.col("lo_discount")))
    if name == "heads":
        return t["orders"].select("o_orderkey", F.col("o_custkey").alias("lo_custkey"), (F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).alias("lo_orderdate"), F.col("o_orderpriority").alias("lo_orderpriority"))
    if name == "dated":  # the date dimension is a function of the day, so its columns are made in place
        return t["orders"].filter("o_orderdate is not null").select("*", F.col("o_orderdate").cast("date").alias("day")).select("o_orderkey", F.col("o_custkey").alias("lo_custkey"), *day_columns())
    if name == "lineorder":
        return v["lines"].join(v["heads"], F.col("lo_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    if name == "lineorder_cost":  # only queries with a supply cost join the parts for it
        costs = t["part"].select(F.col("p_partkey").alias("__part"), (60 * cents("p_retailprice")).alias("lo_supplycost"))
        return v["lineorder"].join(costs, F.col("lo_partkey") == F.col("__part")).drop("__part")
    if name in ("customer_ssb", "supplier_ssb"):
        p, key = name[0], {"c": "c_custkey", "s": "s_suppkey"}[name[0]]
        places = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        joined = t[name.removesuffix("_ssb")].join(places, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        return joined.select(key, F.col(f"{p}_name"), F.concat("n_name", F.lit("_"), (F.col(key) % 10).cast("string")).alias(f"{p}_city"), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"))
    if name == "part_ssb":
        return v["part_cost"].drop("lo_supplycost")
    if name == "part_cost":
        n = F.substring("p_brand", 7, 9).cast("int") - 1
        mfgr = F.concat(F.lit("MFGR#"), (F.floor(n / 5) + 1).cast("string"))
        category = F.concat(mfgr, (n % 5 + 1).cast("string"))
        return t["part"].select("p_partkey", "p_name", mfgr.alias("p_mfgr"), category.alias("p_category"), F.concat(category, F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("p_brand1"), "p_type", "p_size", (60 * cents("p_retailprice")).alias("lo_supplycost"))
    if name == "ddate":
        day = F.col("o_orderdate").cast("date")  # one row a day from the first order to the last
        span = t["orders"].agg(F.min(day).alias("first"), F.max(day).alias("last"))
        return calendar(span.select(F.explode(F.sequence("first", "last")).alias("day")))
    raise KeyError(name)


def _needs_cost(spec: Spec) -> bool:
    return "lo_supplycost" in spec.measure


def frame(spark: SparkSession, sf_dir: str, name: str, prefilter: bool = False, tables: Tables | None = None) -> DataFrame:
    """A query through the builder: lines and orders are each cut by their dimensions, then joined."""
    spec = SPECS[name]
    v = Views(spark, sf_dir, spec.scan, tables)
    lines = StarQuery(v["lines"], keys=spec.keys, prefilter=prefilter).where(F.expr(spec.fact))
    heads = StarQuery(v["dated"], keys=spec.keys, prefilter=prefilter).where(F.expr(spec.date))
    if spec.supplier:
        lines = lines.join(v["supplier_ssb"], "lo_suppkey", "s_suppkey", F.expr(spec.supplier))
    if spec.part or _needs_cost(spec):
        lines = lines.join(v["part_cost"], "lo_partkey", "p_partkey", F.expr(spec.part or "true"), take=("lo_supplycost",) if _needs_cost(spec) else ())
    if spec.customer:
        heads = heads.join(v["customer_ssb"], "lo_custkey", "c_custkey", F.expr(spec.customer))
    fact = lines.joined().join(heads.joined(), F.col("lo_orderkey") == F.col("o_orderkey"))
    q = StarQuery(fact).group_by(*spec.keys).agg(F.sum(F.expr(spec.measure)).cast("bigint").alias(spec.name))
    return q.order_by(*[F.col(c).asc() if up else F.col(c).desc() for c, up in spec.order]).build()


def select(spec: Spec) -> str:
    """The query as a comma join over the star views."""
    tables, conditions = ["lineorder_cost" if _needs_cost(spec) else "lineorder"], [] if spec.fact == "true" else [spec.fact]
    for side, (table, fact_key, key) in KEYS.items():
        condition = getattr(spec, side)
        if condition is not None:
            tables.append(table)
            conditions.append(f"{fact_key} = {key}")
            if condition != "true":
                conditions.append(f"({condition})")
    out = f"select {', '.join([*spec.keys, f'cast(sum({spec.measure}) as bigint) as {spec.name}'])} from {', '.join(tables)} where {' and '.join(conditions)}"
    if spec.keys:
        out += f" group by {', '.join(spec.keys)}"
    if spec.order:
        out += f" order by {', '.join(c + ('' if up else ' desc') for c, up in spec.order)}"
    return out


def spark_sql(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The query through the SQL front door."""
    from .dialect import run

    v, text = Views(spark, sf_dir), select(SPECS[name])
    for view in Views.NAMES:
        if view in text:
            v[view].createOrReplaceTempView(view)
    return run(spark, text + ";")


#: The star views for the oracle.
ORACLE_VIEWS = """
lineorder as (
    select l_orderkey as lo_orderkey, l_linenumber as lo_linenumber, o_custkey as lo_custkey, l_partkey as lo_partkey, l_suppkey as lo_suppkey,
           cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as integer) as lo_orderdate, o_orderpriority as lo_orderpriority,
           cast(l_quantity as integer) as lo_quantity, cast(round(l_extendedprice * 100) as bigint) as lo_extendedprice, cast(round(l_discount * 100) as integer) as lo_discount,
           cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as integer)) as lo_revenue, cast(round(l_tax * 100) as integer) as lo_tax
    from lineitem join orders on l_orderkey = o_orderkey),
lineorder_cost as (select lo.*, 60 * cast(round(p_retailprice * 100) as bigint) as lo_supplycost from lineorder lo join part on lo_partkey = p_partkey),
customer_ssb as (select c_custkey, c_name, n_name || '_' || (c_custkey % 10) as c_city, n_name as c_nation, r_name as c_region
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
supplier_ssb as (select s_suppkey, s_name, n_name || '_' || (s_suppkey % 10) as s_city, n_name as s_nation, r_name as s_region
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
brands as (select *, cast(substr(p_brand, 7) as integer) - 1 as n from part),
part_ssb as (select p_partkey, p_name, 'MFGR#' || (n // 5 + 1) as p_mfgr, 'MFGR#' || (n // 5 + 1) || (n % 5 + 1) as p_category,
    'MFGR#' || (n // 5 + 1) || (n % 5 + 1) || lpad(cast(p_size as varchar), 2, '0') as p_brand1, p_type, p_size from brands),
ddate as (select distinct cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as integer) as d_datekey, cast(year(o_orderdate) as integer) as d_year,
    cast(year(o_orderdate) * 100 + month(o_orderdate) as integer) as d_yearmonthnum, strftime(o_orderdate, '%b%Y') as d_yearmonth,
    cast(week(o_orderdate) as integer) as d_weeknuminyear, cast(month(o_orderdate) as integer) as d_monthnuminyear from orders)
"""


def oracle(name: str) -> str:
    return f"with {ORACLE_VIEWS} {select(SPECS[name])}"


def queries() -> dict:
    out = {}
    for n in SPECS:
        out[f"ssb_{n}"] = lambda s, d, n=n: frame(s, d, n)
        out[f"ssb_sql_{n}"] = lambda s, d, n=n: spark_sql(s, d, n)
    out["join_star_semi_prefilter"] = lambda s, d: frame(s, d, "q4_3", prefilter=True)
    return out


def oracles() -> dict[str, str]:
    return {f"{p}_{n}": oracle(n) for n in SPECS for p in ("ssb", "ssb_sql")} | {"join_star_semi_prefilter": oracle("q4_3")}
