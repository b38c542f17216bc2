"""Synthetic star-schema tables of any size, generated on the executors.

Every value is a hash of its row number, so a table is the same however it is
partitioned, and partitions can be made in parallel and again after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The benchmark's regions, priorities, ship modes, segments and rows per scale factor.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECI", "5-LOW"]
SHIP_MODES = ["REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
ROWS = {"customer": 30_000, "supplier": 2_000, "part": 200_000, "lineorder": 6_000_000}


def _pick(what: int, n: int):
    """0 to n - 1 by a hash of the row number; ``what`` tells columns apart."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(what)), F.lit(n)).cast("int")


def _of(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def dates(spark: SparkSession, start: str = "1992-01-01", days: int = 2557) -> DataFrame:
    """The date dimension of a calendar range: one row a day."""
    d = F.date_add(F.lit(start).cast("date"), F.col("id").cast("int"))
    return calendar(spark.range(days).select(d.alias("day")))


def calendar(days: DataFrame) -> DataFrame:
    """The date dimension of the dates in the column ``day``."""
    return days.select(*day_columns())


def day_columns() -> list[Column]:
    """The date dimension's columns, as functions of the column ``day``."""
    return [
        F.date_format("day", "yyyyMMdd").cast("int").alias("d_datekey"),
        F.date_format("day", "MMMM d, yyyy").alias("d_date"),
        F.date_format("day", "EEEE").alias("d_dayofweek"),
        F.date_format("day", "MMMM").alias("d_month"),
        F.year("day").alias("d_year"),
        (F.year("day") * 100 + F.month("day")).alias("d_yearmonthnum"),
        F.date_format("day", "MMMyyyy").alias("d_yearmonth"),
        F.dayofweek("day").alias("d_daynuminweek"),
        F.dayofmonth("day").alias("d_daynuminmonth"),
        F.dayofyear("day").alias("d_daynuminyear"),
        F.month("day").alias("d_monthnuminyear"),
        F.weekofyear("day").alias("d_weeknuminyear"),
        F.when(F.month("day").isin(12, 1), "Christmas").when(F.month("day").between(2, 4), "Spring").when(F.month("day").between(5, 8), "Summer").otherwise("Fall").alias("d_sellingseason"),
        (F.dayofweek("day") == 7).cast("int").alias("d_lastdayinweekfl"),
        (F.last_day("day") == F.col("day")).cast("int").alias("d_lastdayinmonthfl"),
        (F.date_format("day", "MMdd").isin("0101", "1225")).cast("int").alias("d_holidayfl"),
        F.dayofweek("day").between(2, 6).cast("int").alias("d_weekdayfl"),
    ]


def customer(spark: SparkSession, sf: float) -> DataFrame:
    nation = _pick(1, 25)
    return spark.range(1, int(ROWS["customer"] * sf) + 1).select(F.col("id").cast("int").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), F.concat(F.lit("NATION_"), nation, F.lit("_"), _pick(2, 10)).alias("c_city"), F.concat(F.lit("NATION_"), nation).alias("c_nation"), _of(REGIONS, nation % 5).alias("c_region"), _of(SEGMENTS, _pick(3, 5)).alias("c_mktsegment"))


def supplier(spark: SparkSession, sf: float) -> DataFrame:
    nation = _pick(4, 25)
    return spark.range(1, max(1, int(ROWS["supplier"] * sf)) + 1).select(F.col("id").cast("int").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), F.concat(F.lit("NATION_"), nation, F.lit("_"), _pick(5, 10)).alias("s_city"), F.concat(F.lit("NATION_"), nation).alias("s_nation"), _of(REGIONS, nation % 5).alias("s_region"))


def part(spark: SparkSession, sf: float) -> DataFrame:
    mfgr, category = F.concat(F.lit("MFGR#"), _pick(6, 5) + 1), _pick(7, 5) + 1
    return spark.range(1, max(1, int(ROWS["part"] * sf)) + 1).select(F.col("id").cast("int").alias("p_partkey"), mfgr.alias("p_mfgr"), F.concat(mfgr, category).alias("p_category"), F.concat(mfgr, category, F.lpad((_pick(8, 40) + 1).cast("string"), 2, "0")).alias("p_brand1"), (_pick(9, 50) + 1).alias("p_size"))


def lineorder(spark: SparkSession, sf: float, start: str = "1992-01-01", days: int = 2405) -> DataFrame:
    n = {t: max(1, int(r * sf)) for t, r in ROWS.items()}
    price = (_pick(10, 104_949) + 90_000).cast("long")
    discount = _pick(11, 11)
    day = F.date_add(F.lit(start).cast("date"), _pick(12, days))
    return spark.range(n["lineorder"]).select(
        (F.col("id") / 4).cast("long").alias("lo_orderkey"), (F.col("id") % 4 + 1).cast("int").alias("lo_linenumber"),
        (_pick(13, n["customer"]) + 1).alias("lo_custkey"), (_pick(14, n["part"]) + 1).alias("lo_partkey"), (_pick(15, n["supplier"]) + 1).alias("lo_suppkey"),
        F.date_format(day, "yyyyMMdd").cast("int").alias("lo_orderdate"), _of(PRIORITIES, _pick(16, 5)).alias("lo_orderpriority"),
        (_pick(17, 50) + 1).alias("lo_quantity"), price.alias("lo_extendedprice"), discount.alias("lo_discount"),
        (price * (100 - discount)).alias("lo_revenue"), (price * 60).alias("lo_supplycost"), _pick(18, 9).alias("lo_tax"), _of(SHIP_MODES, _pick(19, 7)).alias("lo_shipmode"),
    )
