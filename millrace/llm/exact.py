"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are compared as UTF-8 bytes. Level by level, a group of texts that agree
so far is split by its next bytes; a group leaves as soon as it is a single row
or its texts have ended. Only bytes decide: no digest is compared.

The digits grow (64, 256, 1024, ... bytes), so a text of n bytes takes about
log4(n / 64) levels. Each level aggregates (group, digit) with map-side
combining, so a digit shared by a third of all rows reaches the reducer as one
row a map task; the group's number joins back to its rows by a shuffle join that
adaptive execution may split at a hot digit. Whole texts are shuffled once, at
the first level; later levels hold only what is still undecided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, staged, without

FIRST_DIGIT = 64
GROWTH = 4


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its group of equal texts.

    Columns: ``doc_id, keep_id`` (largest id of the group), ``group_size,
    kept, text_sha256``. Defined cases: a null text equals the empty text; ids
    may repeat or be null (null ids lose to any other; rows that repeat the kept
    id are all marked kept; a group with null ids only has a null ``keep_id``
    and keeps its rows); an empty table gives an empty result; other columns of
    ``docs`` are ignored whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.lit(0).cast("long").alias("grp"), text.cast("binary").alias("rest"))
    done: list[DataFrame] = []
    width = FIRST_DIGIT
    while True:
        digit = F.substring("rest", 1, width)
        ended = F.length("rest") <= width
        keyed = rows.select("doc_id", "text_sha256", "grp", digit.alias("digit"), ended.alias("ended"), F.substring(F.col("rest"), width + 1, 2_147_483_647).alias("rest"))
        groups = keyed.groupBy("grp", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
        several = cut(groups.filter("n > 1").withColumn("next", F.monotonically_increasing_id()))
        tagged = several.select(F.col("grp").alias("g"), F.col("digit").alias("d"), F.col("ended").alias("e"), "n", "keep_id", "next")
        met = keyed.join(tagged.hint("merge"), (F.col("grp") == F.col("g")) & (F.col("digit") == F.col("d")) & (F.col("ended") == F.col("e")), "left")
        decided = F.col("n").isNull() | F.col("ended")
        # written once: what is decided with its answer, the rest with its bytes
        level = staged(met.select(
            "doc_id", "text_sha256", decided.alias("decided"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("next").alias("grp"), F.when(~decided, F.col("rest")).alias("rest"),
        ), "radix")
        done.append(level.filter("decided").select("doc_id", "keep_id", "group_size", "text_sha256"))
        if not several.filter("not ended").head(1):
            break
        rows = level.filter("not decided").select("doc_id", "text_sha256", "grp", "rest")
        width *= GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those that hold the largest id of their group of equal texts.

    Defined cases: as in ``exact_groups``; rows with a null id stay, and rows
    that repeat the kept id with the kept text; an id that other texts repeat is
    judged text by text.
    """
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select("doc_id", "text_sha256")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return without(docs, gone, id_col, F.sha2(text.cast("binary"), 256))
