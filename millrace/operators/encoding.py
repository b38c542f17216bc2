"""Run-length and dictionary encodings, filters and joins on encoded data, prefix sums.

Parquet encodes pages this way by itself; these transforms make the encodings
visible as tables. Windows run over blocks of the order column that hand on
their borders, so that no step sorts a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def rle_encode(df: DataFrame, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """``pos, value, run_length``: runs of equal values along ``order`` (unique, numeric); nulls are equal.

    A row starts a run if the one before it differs; runs are numbered by a
    running sum of starts and may span any number of blocks.
    """
    rows = carried(df.select(F.col(order).alias("pos"), F.col(value).alias("value")), "pos", F.struct("value"), "last", block=block)
    start = F.when(F.col("last").isNull() | ~F.col("value").eqNullSafe(F.col("last.value")), 1).otherwise(0)
    runs = prefix_sum(rows.select("pos", "value", start.alias("start")), "pos", "start", block=block, name="run")
    return runs.groupBy("run").agg(F.min("pos").alias("pos"), F.min("value").alias("value"), F.count(F.lit(1)).alias("run_length")).select("pos", "value", "run_length")


def rle_decode(runs: DataFrame) -> DataFrame:
    """``pos, value`` of the runs, positions counted on from each run's first (dense positions)."""
    return runs.select(F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("run_length") - 1)).alias("pos"), "value")


def rle_filter(runs: DataFrame, predicate: Column) -> DataFrame:
    """Runs whose value passes: the predicate is evaluated once a run."""
    return runs.filter(predicate)


#: Ranges that a column's distinct values are ranked in.
RANGES = 256


def dict_encode(df: DataFrame, value: str, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``code`` in place of ``value``, table of ``code, value``).

    Codes follow the values' order, from 0; null has none. Distinct values are
    ranked range by range, so that no task sorts them all: the range borders are
    ``ranges`` - 1 values with the least hashes, and each range starts at the
    count of those before it; borders and counts are all that the driver sees.
    """
    values = df.select(F.col(value).alias("value")).filter("value is not null").distinct()
    borders = sorted(r["value"] for r in values.orderBy(F.xxhash64("value"), "value").limit(ranges - 1).collect())
    at = F.lit(0) if not borders else F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= F.col("value")))
    placed = values.withColumn("__range", at)
    before, start = 0, {}
    for r, n in sorted(placed.groupBy("__range").count().collect()):
        start[r] = before
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in start.items() for x in pair]), F.col("__range")) if start else F.lit(0)
    codes = placed.select((F.row_number().over(Window.partitionBy("__range").orderBy("value")) - 1 + offset).cast("int").alias("code"), "value")
    coded = df.withColumnRenamed(value, "__v").join(codes, F.col("__v") == codes["value"], "left").drop("value", "__v")
    return coded, codes


def dict_decode(coded: DataFrame, codes: DataFrame, name: str) -> DataFrame:
    return coded.join(codes, "code", "left").drop("code").withColumnRenamed("value", name)


def dict_filter(coded: DataFrame, codes: DataFrame, predicate: Column) -> DataFrame:
    """Rows of ``coded`` whose value passes: the predicate (on ``value``) runs once a dictionary entry."""
    return coded.join(codes.filter(predicate).select("code"), "code", "left_semi")


def dict_join(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Joins two tables that ``dict_encode`` made on their encoded columns: values meet once an entry, rows by code.

    The column of the result is ``code``, the left one's.
    """
    (a, codes_a), (b, codes_b) = left, right
    same = codes_a.join(codes_b.withColumnRenamed("code", "__code"), "value").select("code", "__code")
    return a.join(same, "code").join(b.withColumnRenamed("code", "__code"), "__code").drop("__code")


def rle_join(runs: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Runs joined with the rows of ``other`` whose ``key`` is their value: a comparison a run, whose length goes on as a multiplicity."""
    return runs.join(other, F.col("value") == other[key])


#: Blocks whose totals add up in one task.
BLOCKS = 1 << 10


def prefix_sum(df: DataFrame, order: str, value: str, keys: tuple[str, ...] = (), block: int = BLOCK, name: str = "prefix", levels: int = 2) -> DataFrame:
    """Adds the running sum of ``value`` along ``order`` (numeric, unique within ``keys``), the row included.

    Sums within blocks of ``order`` run in parallel; each block's offset comes
    from the totals of the blocks before it, of which there is one row a block.
    With two ``levels`` those totals add up in blocks of ``BLOCKS`` in turn.
    Rows of one ``order`` should hold the same value; their sums then come in
    some order.
    """
    rows = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    totals = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    if levels > 1:
        up_to = prefix_sum(totals.withColumnRenamed("__block", "__at"), "__at", "__total", keys, BLOCKS, "__up_to", levels - 1)
        offsets = up_to.select(*keys, F.col("__at").alias("__block"), (F.col("__up_to") - F.coalesce("__total", F.lit(0))).alias("__offset"))
    else:
        before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inside", F.sum(value).over(inside))
    return rows.join(offsets, [*keys, "__block"]).withColumn(name, F.coalesce("__inside", F.lit(0)) + F.col("__offset")).drop("__block", "__inside", "__offset")


def carried(df: DataFrame, order: str, value: Column, name: str, keys: tuple[str, ...] = (), back: bool = False, own: bool = False, ties: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Adds the last non-null ``value`` before the row along ``order`` (numeric) within ``keys``; with ``back`` the first after it.

    ``own`` counts the row itself. Windows run over blocks of ``order``, so a key
    with all rows is the work of many tasks; what a block hands on is one row.
    ``ties`` order rows of the same ``order``.
    """
    turn = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    rows = df.withColumn("__v", value).withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    last = 0 if own else -1
    inside = Window.partitionBy(*keys, "__block").orderBy(*map(turn, (order, *ties))).rowsBetween(Window.unboundedPreceding, last)
    seen = F.when(F.col("__v").isNotNull(), F.struct(order, *ties))
    border = (F.min_by if back else F.max_by)("__v", seen)
    before = Window.partitionBy(*keys).orderBy(turn("__block")).rowsBetween(Window.unboundedPreceding, -1)
    borders = rows.groupBy(*keys, "__block").agg(border.alias("__border")).select(*keys, "__block", F.last("__border", ignorenulls=True).over(before).alias("__carried"))
    rows = rows.withColumn("__inside", F.last("__v", ignorenulls=True).over(inside))
    return rows.join(borders, [*keys, "__block"]).withColumn(name, F.coalesce("__inside", "__carried")).drop("__v", "__block", "__inside", "__carried")
