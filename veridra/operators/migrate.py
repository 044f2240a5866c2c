"""Transforms that carry records from one version of a schema to the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.functions.library import Typed, trim
from veridra.operators.checks import TRUE_TEXTS
from veridra.operators.schema_ops import Change, diff
from veridra.plans.engine import Options, compile_class
from veridra.plans.model import Schema


def _mapped(c: Column, kind: T.DataType, path: list[str], f: Callable[[Column, T.DataType], Column]) -> Column:
    """f at a path of field names, in every element of arrays on the way."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _mapped(e, kind.elementType, path, f))
    if not path:
        return f(c, kind)
    if isinstance(kind, T.StructType) and path[0] in kind.fieldNames():
        return c.withField(path[0], _mapped(c[path[0]], kind[path[0]].dataType, path[1:], f))
    return c


def at_path(df: DataFrame, path: str, f: Callable[[Column, T.DataType], Column]) -> DataFrame:
    head, *rest = path.split(".")
    return df.withColumn(head, _mapped(F.col(f"`{head}`"), df.schema[head].dataType, rest, f)) if head in df.columns else df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their new names; with dots, fields of records and of the elements of arrays."""
    df = df.withColumnsRenamed({a: b for a, b in names.items() if "." not in a})
    for a, b in names.items():
        if "." in a:
            path, _, last = a.rpartition(".")
            new = b.rpartition(".")[2]
            df = at_path(df, path, lambda c, kind, last=last, new=new: F.struct(*[c[f].alias(new if f == last else f) for f in kind.fieldNames()]) if isinstance(kind, T.StructType) else c)
    return df


def converted(c: Column, kind: T.DataType, to: str) -> Column:
    """To string, number, boolean or array; what can't be converted is NULL."""
    if to == "string":
        return F.to_json(c) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else c.cast("string")
    if to == "number":
        return c.cast("double") if isinstance(kind, T.NumericType | T.BooleanType) else c.try_cast("double")
    if to == "boolean":
        if isinstance(kind, T.NumericType):
            return c != 0
        return c if isinstance(kind, T.BooleanType) else F.lower(F.trim(c)).isin(*TRUE_TEXTS)
    return c if isinstance(kind, T.ArrayType) else F.array(c)


def convert(df: DataFrame, path: str, to: str) -> DataFrame:
    return at_path(df, path, lambda c, kind: converted(c, kind, to))


def upper(df: DataFrame, path: str) -> DataFrame:
    return at_path(df, path, lambda c, _: F.upper(c))


def lower(df: DataFrame, path: str) -> DataFrame:
    return at_path(df, path, lambda c, _: F.lower(c))


def trimmed(df: DataFrame, path: str) -> DataFrame:
    return at_path(df, path, lambda c, kind: trim(Typed(c, kind)))


def replaced(df: DataFrame, path: str, pattern: str, by: str) -> DataFrame:
    return at_path(df, path, lambda c, _: F.regexp_replace(c, pattern, by))


def with_default(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(value)) if name in df.columns else F.lit(value))


def merge(df: DataFrame, sources: list[str], target: str, by: str = " ") -> DataFrame:
    """The texts of several fields in one; these are dropped."""
    return df.withColumn("__merged", F.concat_ws(by, *[F.col(f"`{s}`").cast("string") for s in sources])).drop(*sources).withColumnRenamed("__merged", target)


def split(df: DataFrame, source: str, targets: list[str], by: str = " ") -> DataFrame:
    """A field's parts in several; missing ones are NULL, and the field is dropped."""
    parts = F.split(F.col(f"`{source}`"), F.lit(r"\Q" + by + r"\E"))
    return df.withColumn("__parts", parts).drop(source).withColumns({t: F.get("__parts", F.lit(i)) for i, t in enumerate(targets)}).drop("__parts")


def integrity(df: DataFrame, id_col: str = "id") -> DataFrame:
    """column, nulls and empty (arrays without elements) of every column, and rows without id, in a
    pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    sums = []
    for c, kind in kinds.items():
        empty = F.size(F.col(f"`{c}`")) == 0 if isinstance(kind, T.ArrayType) else F.lit(False)
        sums.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.count_if(empty).alias("empty"), F.lit(c == id_col).alias("is_id")))
    return df.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("c")).select("c.*")


@dataclass
class Step:
    """One step of a migration; ``apply`` takes and gives a table."""

    name: str
    apply: Callable[[DataFrame], DataFrame]


@dataclass
class Plan:
    """Steps from one schema to another, what changes break, and the risk."""

    old: Schema
    new: Schema
    changes: list[Change]
    steps: list[Step] = field(default_factory=list)

    @property
    def risk(self) -> str:
        breaking = sum(c.breaking for c in self.changes)
        return "high" if breaking > 5 else "medium" if breaking else "low"

    def run(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df

    def validated(self, df: DataFrame, cls: str) -> DataFrame:
        """The report of the new schema's checks on the migrated table."""
        out = self.run(df)
        return compile_class(self.new, cls, out.schema, Options()).report(out)


def plan(old: Schema, new: Schema, cls: str, renamed: dict[str, str] | None = None) -> Plan:
    """Steps for a class: renames, conversions of changed ranges, defaults of new slots, and removal
    of slots that are gone."""
    from veridra.plans.resolve import induced_slots

    before, after, renamed = induced_slots(old, cls), induced_slots(new, cls), renamed or {}
    out = Plan(old, new, diff(old, new))
    if renamed:
        out.steps.append(Step("rename", lambda df: rename(df, renamed)))
    target = {"integer": "number", "float": "number", "double": "number", "decimal": "number", "boolean": "boolean", "string": "string"}
    for name, slot in after.items():
        was = before.get({b: a for a, b in renamed.items()}.get(name, name))
        if was is None and slot.ifabsent is not None:
            out.steps.append(Step(f"default {name}", lambda df, n=name, v=slot.ifabsent: with_default(df, n, v)))
        elif was is not None and was.range != slot.range and slot.range in target:
            out.steps.append(Step(f"convert {name}", lambda df, n=name, t=target[slot.range]: convert(df, n, t)))
        elif was is not None and slot.multivalued and not was.multivalued:
            out.steps.append(Step(f"array {name}", lambda df, n=name: convert(df, n, "array")))
    gone = [n for n in before if n not in after and n not in renamed]
    if gone:
        out.steps.append(Step(f"drop {', '.join(gone)}", lambda df: df.drop(*gone)))
    return out
