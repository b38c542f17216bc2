"""Quantified comparisons and multiset predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _summary(values: DataFrame, column: str) -> DataFrame:
    """One row: least, greatest, distinct (2 stands for more), nulls, rows."""
    c = F.col(column)
    return values.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"), F.count(F.when(c.isNull(), 1)).alias("__nulls"), F.count(F.lit(1)).alias("__rows"))


def compare_any(df: DataFrame, left: Column, op: str, values: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` with ``left op ANY (values)``; a comparison that is unknown does not pass."""
    if op == "=":
        v = values.select(F.col(column).alias("__v"))
        return df.join(v, left == F.col("__v"), "left_semi")
    one = F.broadcast(_summary(values, column))  # a single row
    test = {"<": left < F.col("__hi"), "<=": left <= F.col("__hi"), ">": left > F.col("__lo"), ">=": left >= F.col("__lo"), "<>": (left != F.col("__lo")) | (left != F.col("__hi"))}[op]
    return df.join(one, test, "left_semi")


def compare_all(df: DataFrame, left: Column, op: str, values: DataFrame, column: str) -> DataFrame:
    """Rows with ``left op ALL (values)``: all pass if there are no values, none if a value is null (but for a null-free counterexample it is false anyway)."""
    if op == "<>":
        v = values.select(F.col(column).alias("__v"))
        one = F.broadcast(_summary(values, column))
        kept = df.join(v, left == F.col("__v"), "left_anti")
        return kept.join(one, (F.col("__rows") == 0) | ((F.col("__nulls") == 0) & left.isNotNull()), "left_semi")
    one = F.broadcast(_summary(values, column))
    test = {"<": left < F.col("__lo"), "<=": left <= F.col("__lo"), ">": left > F.col("__hi"), ">=": left >= F.col("__hi"), "=": (left == F.col("__lo")) & (left == F.col("__hi"))}[op]
    return df.join(one, (F.col("__rows") == 0) | ((F.col("__nulls") == 0) & test), "left_semi")


def compare_list(left: Column, op: str, values: list, every: bool) -> Column:
    """``left op ANY/ALL (list)`` over literals."""
    tests = [_OPS[op](left, F.lit(v)) for v in values]
    out = F.lit(every)
    for t in tests:
        out = (out & t) if every else (out | t)
    return out


def is_a_set(collection: Column) -> Column:
    """No element twice."""
    return F.size(F.array_distinct(collection)) == F.size(collection)


def is_empty(collection: Column) -> Column:
    return F.size(collection) == 0


def member_of(value: Column, collection: Column) -> Column:
    return F.array_contains(collection, value)


def submultiset_of(a: Column, b: Column) -> Column:
    """Each element of ``a`` occurs in ``b`` at least as often."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.forall(F.array_distinct(a), lambda x: times(a, x) <= times(b, x))


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))
