"""The checks of a class on a stream. Checks of single records are the same columns as for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.plans.engine import Options, compile_class
from veridra.plans.model import Schema


def annotated(stream: DataFrame, s: Schema, cls: str, options: Options | None = None) -> DataFrame:
    """Each record with its issues; stateless."""
    return compile_class(s, cls, stream.schema, options).annotate(stream)


def violations(stream: DataFrame, s: Schema, cls: str, keys: list[str], options: Options | None = None) -> DataFrame:
    return compile_class(s, cls, stream.schema, options).violations(stream, keys)


def first_of_each(stream: DataFrame, columns: list[str], time_col: str, delay: str) -> DataFrame:
    """One record of each key; a key is forgotten when it is older than the watermark, so that state
    is bounded by the delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(columns)


def issue_counts(stream: DataFrame, s: Schema, cls: str, time_col: str, window: str = "1 hour", delay: str = "1 day", options: Options | None = None) -> DataFrame:
    """Issues by window of event time, slot path and code (an extension)."""
    found = compile_class(s, cls, stream.schema, options).annotate(stream).withWatermark(time_col, delay)
    each = found.select(F.col(time_col), F.explode("issues").alias("i"))
    return each.groupBy(F.window(time_col, window).alias("w"), F.col("i.path").alias("path"), F.col("i.code").alias("code")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "path", "code", "n")
