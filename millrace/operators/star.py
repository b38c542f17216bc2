"""Star queries: a fact table, dimensions on one key each, grouped sums, an order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StarQuery:
    """Immutable builder; every method returns a new query.

    Dimensions are filtered and pruned before they join. How a join runs is left
    to the planner, which broadcasts a side by its measured size;
    ``prefilter`` instead reduces the fact table by a left semi join with each
    filtered dimension whose columns are not in the result, so that such
    dimensions never widen the rows.
    """

    fact: DataFrame
    filters: tuple[Column, ...] = ()
    dimensions: tuple[tuple[DataFrame, str, str, tuple[Column, ...], tuple[str, ...]], ...] = ()
    keys: tuple[str, ...] = ()
    measures: tuple[Column, ...] = ()
    kept: Column | None = None
    order: tuple[Column, ...] = ()
    prefilter: bool = field(default=False)

    def where(self, *conditions: Column) -> StarQuery:
        return replace(self, filters=self.filters + conditions)

    def join(self, dimension: DataFrame, fact_key: str, key: str, *conditions: Column, take: tuple[str, ...] = ()) -> StarQuery:
        """``take`` names columns of the dimension that measures use."""
        return replace(self, dimensions=(*self.dimensions, (dimension, fact_key, key, conditions, take)))

    def group_by(self, *keys: str) -> StarQuery:
        return replace(self, keys=keys)

    def agg(self, *measures: Column) -> StarQuery:
        return replace(self, measures=measures)

    def having(self, condition: Column) -> StarQuery:
        return replace(self, kept=condition)

    def order_by(self, *order: Column) -> StarQuery:
        return replace(self, order=order)

    def with_prefilter(self) -> StarQuery:
        return replace(self, prefilter=True)

    def joined(self) -> DataFrame:
        """The fact rows that pass, with the columns of the dimensions that are grouped by or taken; not aggregated."""
        df = self.fact
        for c in self.filters:
            df = df.filter(c)
        for dimension, fact_key, key, conditions, take in self.dimensions:
            for c in conditions:
                dimension = dimension.filter(c)
            used = [c for c in dimension.columns if c in (*self.keys, *take) and c != key]
            dimension = dimension.select(F.col(key).alias("__key"), *used)
            how = "left_semi" if self.prefilter and not used else "inner"
            df = df.join(dimension, df[fact_key] == dimension["__key"], how)
            df = df if how == "left_semi" else df.drop("__key")
        return df

    def build(self) -> DataFrame:
        df = self.joined()
        df = df.groupBy(*self.keys).agg(*self.measures) if self.measures else df.select(*self.keys)
        if self.kept is not None:
            df = df.filter(self.kept)
        return df.orderBy(*self.order) if self.order else df
