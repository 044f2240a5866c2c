"""References between tables: integrity, lookup, embedding, assembly from triples, depth of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.plans.resolve import closure


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose reference isn't NULL and finds no parent. Spark broadcasts the parents' keys if
    their size allows it."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("__pk")).distinct(), F.col(fk) == F.col("__pk"), "left_anti")


def reference_report(child: DataFrame, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """slot and number of orphans, for each (slot, parent, key)."""
    parts = [orphans(child, fk, parent, pk).agg(F.count(F.lit(1)).alias("n")).select(F.lit(fk).alias("slot"), "n") for fk, parent, pk in references]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def self_references(df: DataFrame, key: str, fk: str) -> DataFrame:
    """Rows that refer to themselves."""
    return df.filter(F.col(key) == F.col(fk))


def reference_object(c: Column, cls: str) -> Column:
    """A foreign key as an object that names its class."""
    return F.when(c.isNotNull(), F.struct(F.lit(cls).alias("@type"), c.alias("id")))


def embed(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str) -> DataFrame:
    """``child`` with the parent's row as a record, NULL where there is none."""
    p = parent.select(F.col(pk).alias("__pk"), F.struct(*parent.columns).alias(name))
    return child.join(p, F.col(fk) == F.col("__pk"), "left").drop("__pk")


def subjects(triples: DataFrame, type_predicate: str = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type") -> DataFrame:
    """Subjects with their type and a map from predicate to sorted objects; from (s, p, o)."""
    each = triples.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("objects"))
    kind = F.max(F.when(F.col("p") == type_predicate, F.get("objects", F.lit(0))))
    entry = F.when(F.col("p") != type_predicate, F.struct("p", "objects"))
    return each.groupBy("s").agg(kind.alias("type"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values"))


def too_deep(edges: DataFrame, limit: int = 100) -> DataFrame:
    """Ids whose chain of (child, parent) references is longer than the limit or returns to itself; chains are followed one step beyond the limit."""
    chains = closure(edges, limit + 1)
    return chains.groupBy("child").agg(F.max("depth").alias("depth"), F.max((F.col("child") == F.col("ancestor")).cast("int")).alias("cycle")).filter((F.col("depth") > limit) | (F.col("cycle") == 1)).select("child", "depth", (F.col("cycle") == 1).alias("circular"))


def sheet_relations(columns: DataFrame) -> DataFrame:
    """table, column and the table that the column's name refers to (``x_id`` to x or xs); from
    (table, column)."""
    named = columns.withColumn("stem", F.regexp_extract(F.lower("column"), r"^(.+)_id$", 1)).filter("stem <> ''")
    tables = columns.select(F.col("table").alias("target")).distinct().withColumn("stem", F.regexp_replace(F.lower("target"), "s$", ""))
    return named.withColumn("stem", F.regexp_replace("stem", "s$", "")).join(tables, "stem").filter(F.col("table") != F.col("target")).select("table", "column", "target")


def inverse(df: DataFrame, slot: str, key: str, name: str) -> DataFrame:
    """For each value that a slot refers to, the keys of the records that do."""
    return df.filter(F.col(slot).isNotNull()).groupBy(F.col(slot).alias("id")).agg(F.array_sort(F.collect_set(key)).alias(name))
