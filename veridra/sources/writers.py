"""Writers: records to files and databases, in parallel; text in one piece only for small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.plans import resolve
from veridra.plans.model import Schema
from veridra.sources.readers import TYPE


@dataclass
class Options:
    classes: list[str] | None = None
    mapping: dict[str, str] = field(default_factory=dict)
    limit: int | None = None
    nulls: bool = False
    mode: str = "errorifexists"


def selected(df: DataFrame, o: Options) -> DataFrame:
    """The rows and names that are written."""
    if o.classes and TYPE in df.columns:
        df = df.filter(F.col(f"`{TYPE}`").isin(o.classes))
    df = df.withColumnsRenamed(o.mapping)
    return df.limit(o.limit) if o.limit is not None else df


def _cell(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array_join(c.cast("array<string>"), ";") if not isinstance(kind.elementType, T.StructType) else F.to_json(c)
    return F.to_json(c) if isinstance(kind, T.StructType | T.MapType) else c.cast("string")


def csv_columns(df: DataFrame, s: Schema | None = None, cls: str | None = None) -> DataFrame:
    """Text cells: the class's slots first, then what else there is; many values joined by ;."""
    order = [c for c in (resolve.induced_slots(s, cls) if s and cls else []) if c in df.columns]
    order += [c for c in df.columns if c not in order and c != TYPE]
    return df.select([_cell(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in order])


def write_csv(df: DataFrame, path: str, s: Schema | None = None, cls: str | None = None, options: Options | None = None, delimiter: str = ",") -> None:
    o = options or Options()
    csv_columns(selected(df, o), s, cls).write.mode(o.mode).option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str, s: Schema | None = None, cls: str | None = None, options: Options | None = None) -> None:
    write_csv(df, path, s, cls, options, "\t")


def write_json(df: DataFrame, path: str, cls: str | None = None, options: Options | None = None) -> None:
    o = options or Options()
    out = selected(df, o)
    out = out.withColumn(TYPE, F.lit(cls)) if cls and TYPE not in out.columns else out
    out.write.mode(o.mode).option("ignoreNullFields", not o.nulls).json(path)


def to_yaml(df: DataFrame, options: Options | None = None, most: int = 10_000) -> str:
    """A small table as YAML; a larger one is an error, as the text is made on the driver."""
    import yaml

    o = options or Options()
    rows = selected(df, o).select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not o.nulls).lower()}).alias("r")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"YAML is written for at most {most} rows")
    return yaml.safe_dump([json.loads(r[0]) for r in rows], allow_unicode=True, sort_keys=False)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str = "records", options: Options | None = None) -> None:
    o = options or Options()
    selected(df, o).write.mode(o.mode).format("xml").option("rootTag", root_tag).option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "_text").save(path)


def triple_lines(df: DataFrame, s: Schema, cls: str, id_col: str, base: str) -> DataFrame:
    """N-Triples lines: a type and one triple for each value."""
    subject = F.concat(F.lit(f"<{base}"), F.url_encode(F.col(id_col).cast("string")), F.lit(">"))
    slots = resolve.induced_slots(s, cls)
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    kinds = {"integer": "integer", "float": "double", "double": "double", "boolean": "boolean", "date": "date", "datetime": "dateTime"}

    def objects(name: str, c: Column) -> Column:
        of = slots[name].range
        if of in s.classes:
            return F.concat(F.lit(f"<{base}"), F.url_encode(c.cast("string")), F.lit(">"))
        suffix = f"^^<http://www.w3.org/2001/XMLSchema#{kinds[of]}>" if of in kinds else ""
        return F.concat(F.lit('"'), escape(c.cast("string")), F.lit(f'"{suffix}'))

    uri = s.classes[cls].class_uri or f"{base}{cls}"
    parts = [F.array(F.struct(F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type").alias("p"), F.lit(f"<{resolve.expand(s, uri)}>").alias("o")))]


    def pairs(name: str) -> Column:
        p = resolve.expand(s, slots[name].slot_uri or f"{base}{name}")
        c = F.col(f"`{name}`")
        values = F.transform(c, lambda e: objects(name, e)) if isinstance(df.schema[name].dataType, T.ArrayType) else F.array(objects(name, c))
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda o: F.struct(F.lit(p).alias("p"), o.alias("o")))

    parts += [pairs(name) for name in slots if name in df.columns]
    each = df.select(subject.alias("s"), F.explode(F.filter(F.concat(*parts), lambda t: t["o"].isNotNull())).alias("t"))
    return each.select(F.concat("s", F.lit(" <"), "t.p", F.lit("> "), "t.o", F.lit(" .")).alias("value"))


def write_triples(df: DataFrame, path: str, s: Schema, cls: str, id_col: str, base: str, options: Options | None = None) -> None:
    o = options or Options()
    triple_lines(selected(df, o), s, cls, id_col, base).write.mode(o.mode).text(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict[str, str] | None = None, types: str | None = None) -> None:
    w = df.write
    w = w.option("createTableColumnTypes", types) if types else w
    w.jdbc(url, table, mode, properties or {})


def write_table(df: DataFrame, path: str, day_of: str | None = None, sort: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, partitioned by the day of a moment, rows sorted within files."""
    if day_of:
        df = df.withColumn(f"{day_of}_day", F.to_date(day_of)).repartition(f"{day_of}_day")
    df = df.sortWithinPartitions(*sort) if sort else df
    w = df.write.mode(mode).option("compression", "snappy")
    (w.partitionBy(f"{day_of}_day") if day_of else w).parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int = 10, mode: str = "errorifexists") -> None:
    """A table in the warehouse whose later joins on the key need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
