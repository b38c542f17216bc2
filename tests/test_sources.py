"""Schema files, delimited text, the catalog, the generator."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import delimited, schema, ssbgen
from millrace.sources.catalog import Catalog

TEXT = "SHOP|S_KEY:INTEGER|S_NAME:TEXT:12|S_SINCE:DATE|S_RATE:DECIMAL\nITEM|I_KEY:INTEGER|junk|I_NAME:TEXT:4\n"


def test_schema_round_trip():
    tables = schema.parse_schema(TEXT)
    assert list(tables) == ["SHOP", "ITEM"] and tables["ITEM"].names == ["I_KEY", "I_NAME"]
    assert tables["SHOP"]["S_NAME"].metadata["length"] == 12 and tables["SHOP"]["S_SINCE"].dataType.simpleString() == "int"
    assert schema.parse_schema(schema.format_schema(tables)) == tables
    with pytest.raises(schema.SchemaError):
        schema.parse_schema("T|A:BLOB")


def test_delimited_round_trip_and_sorted_load(spark, tmp_path):
    tables = schema.parse_schema(TEXT)
    rows = [(3, "c, 'q' \"x\"", 20240103, None), (1, "a", 20240101, 1.5), (2, None, 20240102, 2.25)]
    df = spark.createDataFrame(rows, "S_KEY int, S_NAME string, S_SINCE int, S_RATE double").withColumn("S_RATE", F.col("S_RATE").cast("decimal(18,2)"))
    delimited.write_delimited(df, f"{tmp_path}/text")
    line = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/text").collect())[0]
    assert line == "1|a|20240101|1.50|"
    got = delimited.load_table(spark, tables, "shop", f"{tmp_path}/text", f"{tmp_path}/shop", sort_by="S_KEY")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path), tables["SHOP"], "||")


def test_malformed_numbers_can_be_seen_or_fail(spark, tmp_path):
    (tmp_path / "item.tbl").write_text("1|nut|\nx2|bolt|\n")
    item = schema.parse_schema(TEXT)["ITEM"]
    got = {r["I_NAME"]: (r["I_KEY"], r["bad"]) for r in delimited.read_delimited(spark, f"{tmp_path}/item.tbl", item, bad_rows="bad").collect()}
    assert got == {"nut": (1, None), "bolt": (None, "x2|bolt|")}
    with pytest.raises(Exception, match="x2|MALFORMED"):
        delimited.read_delimited(spark, f"{tmp_path}/item.tbl", item, strict=True).collect()


def test_catalog(spark, tmp_path):
    (tmp_path / "item.tbl").write_text("1|nut|\n2|bolt|\n")
    cat = Catalog(spark, f"{tmp_path}/db")
    cat.create("d1", TEXT)
    assert cat.load("d1", "item", str(tmp_path / "item.tbl")).count() == 2
    again = Catalog(spark, f"{tmp_path}/db")
    assert again.restore("d1") == ["ITEM"] and again.list() == ["d1"]
    assert spark.sql("select I_NAME from item where I_KEY = 2").first()[0] == "bolt"
    with pytest.raises(ValueError):
        Catalog(spark, f"{tmp_path}/db").create("d1", TEXT)  # another session's
    assert Catalog(spark, f"{tmp_path}/db").list() == ["d1"]
    again.delete("d1")
    assert again.list() == [] and not (tmp_path / "db" / "d1").exists() and "create" in again.help()


def test_generator_is_the_same_however_partitioned(spark):
    one, two = ssbgen.lineorder(spark, 0.001), ssbgen.lineorder(spark, 0.001).repartition(7)
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert total(one) == total(two) and one.count() == 6000
    dims = ssbgen.customer(spark, 0.01), ssbgen.supplier(spark, 0.01), ssbgen.part(spark, 0.01), ssbgen.dates(spark)
    assert [d.count() for d in dims] == [300, 20, 2000, 2557]
    joined = one.join(dims[3], F.col("lo_orderdate") == F.col("d_datekey"))
    assert joined.count() == 6000
