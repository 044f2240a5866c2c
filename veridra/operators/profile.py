"""Profiles of columns, and schemas inferred from them.

A table is profiled by one pass for all columns: each row becomes a (column, text) entry for each of
its cells, and entries are aggregated by column with map-side combination.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.plans.model import Class, Enum, Schema, Slot

#: Distinct samples that a profile keeps for a column.
SAMPLES = 100
#: A column is an enumeration with 2 to so many values that cover so much of it.
ENUM_VALUES, ENUM_COVER = 20, 0.8

#: Patterns by which the type of a text is told, in this order.
INTEGER, FLOAT = r"^[+-]?\d+$", r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"
DATETIME, DATE, TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}:\d{2}(:\d{2})?$"
URI, EMAIL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://\S+$", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
BOOLEAN_TEXTS, BITS = ("true", "false", "yes", "no"), ("1", "0")


def type_of(c: Column) -> Column:
    """The type of a text; "unknown" if it is empty, "bit" if it is 0 or 1, which stand for booleans
    among booleans and for integers among all else."""
    t = F.trim(c)
    return (
        F.when(c.isNull() | (t == ""), "unknown").when(t.isin(*BITS), "bit").when(F.lower(t).isin(*BOOLEAN_TEXTS), "boolean").when(t.rlike(INTEGER), "integer").when(t.rlike(FLOAT), "float")
        .when(t.rlike(DATETIME), "datetime").when(t.rlike(DATE), "date").when(t.rlike(TIME), "time").when(t.rlike(URI), "uri").when(t.rlike(EMAIL), "email").otherwise("string")
    )


def common_type(a: str, b: str) -> str:
    if a == b or b == "unknown":
        return a
    if a == "unknown":
        return b
    pair = {a, b}
    if "bit" in pair:  # "bit" and "boolean" is "boolean", and "bit" by itself stays open
        other = (pair - {"bit"}).pop()
        return other if other in ("boolean", "integer", "float") else "string"
    return "float" if pair == {"integer", "float"} else "datetime" if pair in ({"datetime", "date"}, {"datetime", "time"}) else "string"


def without_bits(types: Column) -> Column:
    """A set of types with what its bits stand for."""
    known = F.array_distinct(types)
    sure = F.size(F.array_except(known, F.array(F.lit("bit"), F.lit("boolean"), F.lit("unknown")))) > 0
    return F.array_distinct(F.transform(known, lambda t: F.when(t != "bit", t).when(sure, "integer").otherwise("boolean")))


def common_type_column(types: Column) -> Column:
    """The common type of a set of types, whatever their order: a fold over sorted names."""
    known = F.filter(without_bits(types), lambda t: t != "unknown")
    fits = lambda *names: F.size(F.array_except(known, F.array(*map(F.lit, names)))) == 0
    return F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, F.get(known, F.lit(0))).when(fits("integer", "float"), "float").when(fits("datetime", "date") | fits("datetime", "time"), "datetime").otherwise("string")


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column and text of every cell."""
    names = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for c in names])).alias("cell")).select("cell.*")


def type_votes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, type and its number of votes; empty cells don't vote."""
    counted = cells(df, columns).select("column", type_of(F.col("text")).alias("type")).filter("type <> 'unknown'").groupBy("column", "type").agg(F.count(F.lit(1)).alias("votes"))
    # at most a row for each column and type
    every = F.collect_set("type").over(Window.partitionBy("column"))
    stands = F.when(F.col("type") != "bit", F.col("type")).when(F.size(F.array_except(every, F.array(F.lit("bit"), F.lit("boolean")))) > 0, "integer").otherwise("boolean")
    return counted.select("column", stands.alias("type"), "votes").groupBy("column", "type").agg(F.sum("votes").alias("votes"))


def majority(votes: DataFrame) -> DataFrame:
    """column, its most voted type (the least name of equal ones) and its share."""
    w = Window.partitionBy("column")
    ranked = votes.withColumn("confidence", F.col("votes") / F.sum("votes").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "type")))
    return ranked.filter("rank = 1").select("column", "type", "confidence")


def confidence_of(votes: DataFrame, of: Column) -> DataFrame:
    """column and the share of its votes that a type admits: itself, and integers where floats are."""
    admitted = (F.col("type") == of) | ((of == "float") & (F.col("type") == "integer")) | (of == "string")
    return votes.groupBy("column").agg((F.sum(F.when(admitted, F.col("votes")).otherwise(0)) / F.sum("votes")).alias("confidence"))


def columns_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, non_empty, required, types, type, least and most number, distinct (exact) and the
    values if the column is an enumeration. Values are counted before they are gathered."""
    each = cells(df, columns).groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("text").isNotNull() & (F.trim("text") != "")
    number = F.when(full, F.col("text").try_cast("double"))
    profile = each.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("non_empty"), F.count_if(full).alias("distinct"),
        F.array_sort(F.collect_set(F.when(full, type_of(F.col("text"))))).alias("types"), F.min(number).alias("minimum"), F.max(number).alias("maximum"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("covered"),
    )
    few = each.filter(full).join(profile.filter((F.col("distinct") >= 2) & (F.col("distinct") <= ENUM_VALUES)).select("column"), "column", "left_semi").groupBy("column").agg(F.array_sort(F.collect_list("text")).alias("values"))
    out = profile.join(few, "column", "left")
    return out.select("column", "rows", "non_empty", (F.col("rows") == F.col("non_empty")).alias("required"), without_bits(F.col("types")).alias("types"), common_type_column(F.col("types")).alias("type"), "minimum", "maximum", "distinct", F.when(F.col("covered") >= F.col("rows") * ENUM_COVER, F.col("values")).alias("values"))


def samples(df: DataFrame, column: str, k: int = SAMPLES) -> DataFrame:
    """The first k distinct values in order, a bounded sample for people to look at."""
    return df.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct().orderBy("value").limit(k)


def occurrences(df: DataFrame, parent: str, child: str) -> DataFrame:
    """For a child element of a parent (one row per occurrence, child NULL if none): parents, least and
    most occurrences, required and multivalued."""
    each = df.groupBy(parent).agg(F.count(F.col(child)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("parents"), F.min("n").alias("least"), F.max("n").alias("most")).withColumns({"required": F.col("least") > 0, "multivalued": F.col("most") > 1})


def merged_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of several documents as one: how many have the column, the common type, and the trust
    in it, which grows with the number of documents."""
    n = F.col("documents")
    trust = F.when(n >= 10, 0.95).when(n >= 5, 0.8).when(n > 1, 0.5 + 0.1 * (n - 1)).otherwise(0.5)
    out = profiles.groupBy("column").agg(F.count(F.lit(1)).alias("documents"), F.sum("rows").alias("rows"), F.sum("non_empty").alias("non_empty"), F.array_sort(F.flatten(F.collect_set("types"))).alias("types"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"))
    return out.withColumns({"type": common_type_column(F.col("types")), "confidence": trust, "required": F.col("rows") == F.col("non_empty")})


# -- names and files --------------------------------------------------------------------------------


def delimiter(lines: list[str]) -> str:
    """Of comma, semicolon, tab and bar, the one that is in all of the first lines most, and as often
    in each if there is one."""
    lines = [x for x in lines[:10] if x.strip()]

    def worth(d: str) -> int:
        n = [x.count(d) for x in lines]
        if not n or not min(n):
            return 0
        return min(n) * (100 if len(set(n)) == 1 else 50 if max(n) - min(n) <= 1 else 10)

    return max(",;\t|", key=worth) if lines else ","


def has_header(first: list[str], second: list[str] | None) -> bool:
    """No cell of the first row is a number, and its cells are not longer than those of the second."""
    if not first or any(re.match(FLOAT, x.strip()) for x in first):
        return False
    mean = lambda row: sum(map(len, row)) / len(row)
    return not second or mean(first) <= mean(second) or any(re.match(FLOAT, x.strip()) for x in second)


def column_names(cells: list[str]) -> list[str]:
    """Names for columns: letters, digits and underscores; ``column_i`` where nothing is left."""
    out, seen = [], Counter()
    for i, x in enumerate(cells):
        name = re.sub(r"\W", "", re.sub(r"\s+", "_", x.strip())) or f"column_{i + 1}"
        seen[name.lower()] += 1
        out.append(name if seen[name.lower()] == 1 else f"{name}_{seen[name.lower()]}")
    return out


def singular(name: str) -> str:
    if name.endswith("ies"):
        return name[:-3] + "y"
    if name.endswith(("sses", "shes", "ches")):
        return name[:-2]
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else f"{name}_item"


def infer_class(df: DataFrame, name: str = "Row") -> tuple[Class, list[Enum]]:
    """A class for a table of scalars; its columns' profiles (a row each) come to the driver."""
    out, enums = Class(name), []
    for r in columns_profile(df).orderBy("column").collect():
        kind = {"unknown": "string", "email": "string"}.get(r["type"], r["type"])
        slot = Slot(r["column"], range=kind, required=r["required"])
        if r["values"] and kind == "string":
            enums.append(Enum(f"{name}_{r['column']}_enum", values=list(r["values"])))
            slot.range = enums[-1].name
        if kind in ("integer", "float"):
            slot.minimum_value, slot.maximum_value = r["minimum"], r["maximum"]
        if r["type"] == "email":
            slot.pattern = EMAIL
        out.attributes[slot.name] = slot
    return out, enums


def infer_schema(df: DataFrame, name: str = "Row") -> Schema:
    """A schema for a table; nested records become classes, arrays slots of many values."""
    s = Schema(id=f"urn:inferred:{name}", name=name)
    _infer_into(s, df, name)
    return s


def _infer_into(s: Schema, df: DataFrame, name: str) -> None:
    flat = [f for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    cls, enums = infer_class(df.select([F.col(f"`{f.name}`") for f in flat]), name) if flat else (Class(name), [])
    s.classes[name] = cls
    s.enums |= {e.name: e for e in enums}
    for f in df.schema.fields:
        kind, many = f.dataType, False
        inner = df.select(F.col(f"`{f.name}`").alias("x"))
        if isinstance(kind, T.ArrayType):
            kind, many = kind.elementType, True
            inner = inner.select(F.explode("x").alias("x"))
        elif not isinstance(kind, T.StructType | T.MapType):
            continue
        if isinstance(kind, T.StructType):
            child = "".join(w.capitalize() for w in (singular(f.name) if many else f.name).split("_"))
            _infer_into(s, inner.filter("x is not null").select("x.*"), child)
            cls.attributes[f.name] = Slot(f.name, range=child, multivalued=many, inlined=True)
        else:
            votes = [r["type"] for r in type_votes(inner).select("type").distinct().collect()]
            kind_name = reduce(common_type, sorted(votes), "unknown")
            cls.attributes[f.name] = Slot(f.name, range={"unknown": "string", "email": "string"}.get(kind_name, kind_name), multivalued=many)
        missing = df.filter(F.col(f"`{f.name}`").isNull()).isEmpty()
        cls.attributes[f.name].required = missing


class Builder:
    """A schema step by step."""

    def __init__(self, name: str):
        self.schema, self.current = Schema(id=f"urn:built:{name}", name=name), None

    def prefix(self, name: str, uri: str) -> Builder:
        self.schema.prefixes[name] = uri
        return self

    def class_(self, name: str, **more) -> Builder:
        self.current = self.schema.classes[name] = Class(name, **more)
        return self

    def slot(self, name: str, range: str = "string", **more) -> Builder:
        self.current.attributes[name] = Slot(name, range=range, **more)
        return self

    def enum(self, name: str, values: list[str]) -> Builder:
        self.schema.enums[name] = Enum(name, values=values)
        return self

    def build(self) -> Schema:
        return self.schema


def hints(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """column and notes on it: TYPE, ENUM, RANGE and FK_TO."""
    p = columns_profile(df)
    notes = F.array(
        F.concat(F.lit("TYPE:"), "type"),
        F.when(F.col("values").isNotNull(), F.concat(F.lit("ENUM:"), F.array_join("values", "|"))),
        F.when(F.col("minimum").isNotNull() & F.col("type").isin("integer", "float"), F.concat(F.lit("RANGE:"), F.col("minimum").cast("string"), F.lit("-"), F.col("maximum").cast("string"))),
        F.when(F.col("column").rlike("(?i).+_id$"), F.concat(F.lit("FK_TO:"), F.regexp_extract(F.lower("column"), "^(.+)_id$", 1))),
    )
    return p.select("column", F.array_compact(notes).alias("hints"))
