"""Delimited text with a closing delimiter on each row, to and from typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", strict: bool = False, bad_rows: str | None = None) -> DataFrame:
    """Columns of ``schema``; the empty column after the closing delimiter is dropped.

    Malformed numbers become null; ``bad_rows`` names a further column that holds
    the line of such a row (null for others), and ``strict`` fails on the first.
    """
    if len(sep) != 1:
        raise ValueError("the delimiter is one character")
    padded = T.StructType([*schema.fields, T.StructField("_closing", T.StringType(), True)])
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    if bad_rows and not strict:
        padded = padded.add(bad_rows, T.StringType())
        options["columnNameOfCorruptRecord"] = bad_rows
    return spark.read.csv(path, schema=padded, sep=sep, quote="", escape="", enforceSchema=True, **options).drop("_closing")


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    """One row a line, each field followed by the delimiter."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat(F.concat_ws(sep, *fields), F.lit(sep)).alias("value")).write.text(path)


def load_table(spark: SparkSession, tables: dict[str, T.StructType], table: str, path: str, target: str, sep: str = "|", sort_by: str | None = None) -> DataFrame:
    """Loads a text file into Parquet.

    With ``sort_by`` rows are range-partitioned and sorted by that column, so
    that run-length and dictionary pages and row-group statistics serve filters
    on it.
    """
    df = read_delimited(spark, path, tables[table.upper()], sep)
    if sort_by:
        df = column_sort(df, sort_by)
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def column_sort(df: DataFrame, key: str) -> DataFrame:
    """All columns reordered by one: a distributed sort, range partitions in key order."""
    return df.repartitionByRange(key).sortWithinPartitions(key)
