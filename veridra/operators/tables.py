"""Operators on whole tables: unions and differences by column name, statistics of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*tables: DataFrame) -> DataFrame:
    """All rows, by column name; columns that a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of a that b lacks, by column name; NULLs are equal."""
    return a.select(sorted(a.columns)).subtract(b.select(sorted(a.columns))).select(a.columns)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that both have, by column name; NULLs are equal."""
    return a.select(sorted(a.columns)).intersect(b.select(sorted(a.columns))).select(a.columns)


def group_statistics(df: DataFrame, by: list[str], number: str, distinct: str | None = None) -> DataFrame:
    """For each group n, total, mean, median, stddev and variance (of a sample) of a column, and the
    number of distinct values of another."""
    more = [F.count_distinct(F.col(f"`{distinct}`")).alias("distinct")] if distinct else []
    c = F.col(f"`{number}`")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("stddev"), F.var_samp(c).alias("variance"), *more)


def most_frequent(df: DataFrame, by: str, value: str) -> DataFrame:
    """For each group the values that occur most often (all of equal ones), and how often."""
    n = df.groupBy(F.col(f"`{by}`").alias("group"), F.col(f"`{value}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("group").agg(F.max("n").alias("n")), ["group", "n"]).select("group", "value", "n")


def most_common_issues(violations: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent kinds of issues of a collection, by slot path and code; the bound is the
    feature. Ties are in order of path and code."""
    path = F.regexp_replace("path", r"\[\d+\]", "[]")
    return violations.groupBy(path.alias("path"), "code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path", "code").limit(k)
