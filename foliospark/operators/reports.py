"""Reports as data: coverage, license shares, years, shapes. Formatting is for whoever prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shares(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """n and pct of each value, null and empty being groups of their own. The total comes from the
    groups, so the rows are read once."""
    groups = df.groupBy(F.col(column).alias(name or column)).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n").alias("total"))
    return groups.crossJoin(F.broadcast(total)).select(name or column, "n", (F.col("n") * F.lit(100.0) / F.col("total")).alias("pct"))  # one row


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """total and pct_<column> present; null percentages for an empty table."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), *[F.try_divide(F.count(c).cast("double") * 100, total.cast("double")).alias(f"pct_{c}") for c in columns])


def year_counts(df: DataFrame, column: str = "pub_year") -> DataFrame:
    """Articles by year (a string), the missing year last."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(column).asc_nulls_last())


def shape(keys: Column) -> Column:
    """The class of a document by the set of its section keys."""
    def just(*names: str):
        return F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(names)])

    return F.when(just("Title"), "only_title").when(just("Abstract"), "only_abstract").when(just("Abstract", "Title"), "both").otherwise("more")
