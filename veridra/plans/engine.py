"""Compilation of a class to columns, and the plans over many records.

All checks of a record are one pass: a cheap disjunction decides whether a row has any issue, and only
such rows build the issue structs. Uniqueness and references, which look across rows, are separate
plans with one shuffle each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.functions.expressions import Compiler, any_of
from veridra.functions.expressions import Custom as CustomFunctions
from veridra.functions.library import Typed, truthy
from veridra.operators import checks, rules
from veridra.operators.checks import ERROR, WARNING, Check
from veridra.plans import resolve
from veridra.plans.model import Schema, Slot

ISSUE = "struct<severity:string,message:string,path:string,validator:string,code:string,context:map<string,string>>"


@dataclass
class Options:
    custom: list[checks.Custom] = field(default_factory=list)
    functions: CustomFunctions = field(default_factory=dict)
    conditionals: list[dict] = field(default_factory=list)
    rule_overrides: dict[str, dict] = field(default_factory=dict)
    apply_defaults: bool = False
    domain_rules: bool = False
    fail_fast: bool = False
    max_issues: int | None = None
    #: Columns of the frame that are no part of the record.
    ignore: tuple[str, ...] = ()


@dataclass
class Plan:
    schema: Schema
    cls: str
    checks: list[Check]
    #: For slots of many values: an array of issues (NULL elements among them) for each.
    arrays: list[Column]
    defaults: dict[str, Column]
    options: Options

    def prepared(self, df: DataFrame) -> DataFrame:
        """The records with defaults for what is absent."""
        if not self.defaults:
            return df
        present = {k: F.coalesce(F.col(f"`{k}`"), v) for k, v in self.defaults.items() if k in df.columns}
        return df.withColumns(present | {k: v for k, v in self.defaults.items() if k not in df.columns})

    def issues(self) -> Column:
        """The issues of a record, errors first, then by path."""
        empty = F.array().cast(f"array<{ISSUE}>")
        if not self.checks and not self.arrays:
            return empty
        some = F.array(*[F.when(F.coalesce(c.violated, F.lit(False)), c.issue()) for c in self.checks]).cast(f"array<{ISSUE}>") if self.checks else empty
        every = F.array_compact(F.concat(some, *[F.coalesce(a, empty) for a in self.arrays]) if self.arrays else some)
        out = F.array_sort(every, _earlier)
        if self.options.fail_fast:
            out = F.slice(out, 1, 1)
        elif self.options.max_issues is not None:
            out = F.slice(out, 1, self.options.max_issues)
        bad = self.violated()
        return F.when(bad, out).otherwise(empty)

    def violated(self) -> Column:
        parts = [F.coalesce(c.violated, F.lit(False)) for c in self.checks]
        parts += [F.coalesce(F.exists(a, lambda i: i.isNotNull()), F.lit(False)) for a in self.arrays]
        return any_of(parts)

    def annotate(self, df: DataFrame, name: str = "issues") -> DataFrame:
        """``df`` with an array of issues for each row."""
        return self.prepared(df).withColumn(name, self.issues())

    def violations(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """A row for each issue, with the record's key columns."""
        return self.prepared(df).select(*keys, F.explode(self.issues()).alias("issue")).select(*keys, "issue.*")

    def valid(self, df: DataFrame) -> DataFrame:
        """The records without an error."""
        errors = any_of([F.coalesce(c.violated, F.lit(False)) for c in self.checks if c.severity == ERROR] + [F.coalesce(F.exists(a, lambda i: i["severity"] == ERROR), F.lit(False)) for a in self.arrays])
        return self.prepared(df).filter(~errors)

    def report(self, df: DataFrame) -> DataFrame:
        """slot, code, severity and the number of issues; checks without any are left out.

        Checks of single values are counted as flags, without building a struct for any row.
        """
        sums = [F.sum(F.coalesce(c.violated, F.lit(False)).cast("long")).alias(f"c{i}") for i, c in enumerate(self.checks)]
        counted = self.prepared(df).agg(*sums) if sums else None
        parts = []
        if counted is not None:
            rows = F.array(*[F.struct(F.lit(c.slot).alias("slot"), F.lit(c.code).alias("code"), F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("n")) for i, c in enumerate(self.checks)])
            parts.append(counted.select(F.explode(rows).alias("r")).select("r.*"))
        if self.arrays:
            empty = F.array().cast(f"array<{ISSUE}>")
            found = F.array_compact(F.concat(*[F.coalesce(a, empty) for a in self.arrays]))
            many = self.prepared(df).select(F.explode(found).alias("i")).groupBy(F.regexp_extract("i.path", r"^\$\.([^\[.]*)", 1).alias("slot"), F.col("i.code").alias("code"), F.col("i.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(many)
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.groupBy("slot", "code", "severity").agg(F.sum("n").alias("n")).filter("n > 0")

    def summary(self, df: DataFrame) -> DataFrame:
        """One row: total, valid, invalid, errors, warnings. Issues are counted as flags, unless options
        bound the number of each record's issues."""
        if self.options.fail_fast or self.options.max_issues is not None:
            n = lambda severity: F.size(F.filter("issues", lambda i: i["severity"] == severity))
            rows = self.annotate(df).select(n(ERROR).alias("e"), n(WARNING).alias("w"))
        else:
            rows = self.prepared(df).select(self._count(ERROR).alias("e"), self._count(WARNING).alias("w"))
        return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("e") == 0).alias("valid"), F.count_if(F.col("e") > 0).alias("invalid"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"))

    def _count(self, severity: str) -> Column:
        flags = [F.coalesce(c.violated, F.lit(False)).cast("int") for c in self.checks if c.severity == severity]
        flags += [F.coalesce(F.size(F.filter(a, lambda i: i["severity"] == severity)), F.lit(0)) for a in self.arrays]
        return reduce(lambda x, y: x + y, flags, F.lit(0))


def _earlier(a: Column, b: Column) -> Column:
    """Order of two issues: errors first, then by path, code and message."""
    key = lambda i: ((i["severity"] != ERROR).cast("int"), i["path"], i["code"], i["message"])
    out = F.lit(0)
    for x, y in reversed(list(zip(key(a), key(b), strict=True))):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def _at(path: Column | str, suffix: str) -> Column | str:
    return path + suffix if isinstance(path, str) else F.concat(path, F.lit(suffix))


def _slot_checks(s: Schema, slot: Slot, kind: T.DataType, compiler: Compiler, options: Options, path: Column | str) -> tuple[list[Check], list[Column]]:
    """Checks of a slot's value, and for many values an array of issues; the compiler knows the record
    that holds the slot, and ``path`` is where the slot is."""
    c = compiler.name(slot.name).column
    out: list[Check] = []
    arrays: list[Column] = []
    add = lambda code, violated, message: out.append(Check(slot.name, code, violated, message, path=path))
    if slot.required or slot.identifier:
        add("required", c.isNull(), f"Required slot '{slot.name}' is missing")
    if isinstance(kind, T.ArrayType):
        if not slot.multivalued:
            add("cardinality_kind", c.isNotNull(), f"{slot.name} has one value, not many")
        low = slot.minimum_cardinality
        bad = ([F.size(c) < low] if low is not None else []) + ([F.size(c) > slot.maximum_cardinality] if slot.maximum_cardinality is not None else [])
        if bad:
            add("cardinality", c.isNotNull() & any_of(bad), f"{slot.name} has too few or too many values")
        if slot.unique:
            add("unique_elements", F.size(c) != F.size(F.array_distinct(c)), f"{slot.name} has a value twice")
        if each := _element_issues(s, slot, kind.elementType, compiler, options, path):
            arrays.append(F.flatten(F.transform(c, each)))
    else:
        if slot.multivalued:
            add("cardinality_kind", c.isNotNull(), f"{slot.name} has many values, not one")
        out += checks.value_checks(s, slot, c, kind, compiler, path)
        if slot.range in s.classes and isinstance(kind, T.StructType):
            more, some = _record_checks(s, slot.range, c, kind, options, path, slot.name)
            out += more
            arrays += some
    inner = Compiler(compiler.record, options.functions, {**compiler.given, "value": Typed(c, kind)})
    if slot.equals_expression:
        add("equals_expression", c.isNotNull() & ~inner.equal(Typed(c, kind), inner(slot.equals_expression)), f"{slot.name} is not equal to {slot.equals_expression}")
    for r in slot.rules:
        add("slot_rule", ~truthy(inner(r)), f"{slot.name}: {r} does not hold")
    for x in checks.depends_on(slot, compiler):
        x.path = path
        out.append(x)
    for x in options.custom:
        if x.concerns(slot):
            out.append(Check(slot.name, x.name, x.violated(c), x.message, path=path, validator=x.name))
    return out, arrays


def _element_issues(s: Schema, slot: Slot, kind: T.DataType, compiler: Compiler, options: Options, path: Column | str):
    """A function from an element and its place to the array of its issues, or None if nothing is asked
    of elements. Elements that are records are checked by their class, like records by themselves."""

    def found(e: Column, i: Column) -> tuple[list[Check], list[Column]]:
        at = F.concat(F.lit(path) if isinstance(path, str) else path, F.lit("["), i.cast("string"), F.lit("]"))
        each = checks.value_checks(s, slot, e, kind, compiler, at)
        if slot.range in s.classes and isinstance(kind, T.StructType):
            more, arrays = _record_checks(s, slot.range, e, kind, options, at, slot.name)
            return each + more, arrays
        return each, []

    some, arrays = found(F.lit(None).cast(kind), F.lit(0))
    if not some and not arrays:
        return None

    def issues(e: Column, i: Column) -> Column:
        each, arrays = found(e, i)
        empty = F.array().cast(f"array<{ISSUE}>")
        flat = F.array(*[F.when(F.coalesce(x.violated, F.lit(False)), x.issue()) for x in each]).cast(f"array<{ISSUE}>")
        return F.array_compact(F.concat(flat, *[F.coalesce(a, empty) for a in arrays]))

    return issues


def _record_checks(s: Schema, cls: str, record: Column, kind: T.StructType, options: Options, path: Column | str, label: str) -> tuple[list[Check], list[Column]]:
    """All checks of a record inside another one: its slots, conditions and rules. A record that is
    absent has none; expressions see the inner record's fields."""
    compiler = Compiler(kind, options.functions, {f.name: Typed(record[f.name], f.dataType) for f in kind.fields})
    out: list[Check] = []
    arrays: list[Column] = []
    for name, slot in resolve.induced_slots(s, cls).items():
        if name not in kind.fieldNames():
            if slot.required or slot.identifier:
                out.append(Check(name, "required", F.lit(True), f"Required slot '{name}' is missing", path=_at(path, f".{name}")))
            continue
        more, some = _slot_checks(s, slot, kind[name].dataType, compiler, options, _at(path, f".{name}"))
        out += more
        arrays += some
    inner = [c for trigger, rule in {k: v for c in reversed(resolve.ancestors(s, cls)) for k, v in s.classes[c].if_required.items()}.items() for c in checks.if_required(s, trigger, rule, compiler)]
    inner += [c for r in rules.compile_rules(s, cls, compiler, options.rule_overrides) for c in r.checks]
    for c in inner:
        c.path = _at(path, f".{c.slot}" if c.slot else "")
    out += inner
    for c in out:
        c.violated = record.isNotNull() & c.violated
        c.slot = f"{label}.{c.slot}" if c.slot else label
    return out, [F.when(record.isNotNull(), a) for a in arrays]


def compile_class(s: Schema, cls: str, record: T.StructType, options: Options | None = None) -> Plan:
    """The plan that checks records of a class; ``record`` is the type of the frame's rows.

    A nested record, or each of a list, is checked by its own class, with its path before that of its
    slots.
    """
    options = options or Options()
    resolve.class_of(s, cls)
    slots = resolve.induced_slots(s, cls)
    defaults: dict[str, Column] = {}
    if options.apply_defaults:
        before = Compiler(record, options.functions)
        defaults = {k: v for k, x in slots.items() if (v := checks.default_value(x, cls, before)) is not None}
        record = T.StructType([*record.fields, *(T.StructField(k, T.StringType()) for k in defaults if k not in record.fieldNames())])
    compiler = Compiler(record, options.functions)
    found: list[Check] = []
    arrays: list[Column] = []
    for name, slot in slots.items():
        if name not in record.fieldNames():
            if slot.required or slot.identifier:
                found.append(Check(name, "required", F.lit(True), f"Required slot '{name}' is missing"))
            continue
        kind = record[name].dataType
        more, some = _slot_checks(s, slot, kind, compiler, options, f"$.{name}")
        found += more
        arrays += some
    unknown = [f for f in record.fieldNames() if f not in slots and f not in options.ignore]
    severity = WARNING if s.allow_additional_properties else ERROR
    found += [Check(f, "unknown_slot", F.col(f"`{f}`").isNotNull(), f"{f} is no slot of {cls}", severity=severity) for f in unknown]
    for trigger, rule in {k: v for c in reversed(resolve.ancestors(s, cls)) for k, v in s.classes[c].if_required.items()}.items():
        found += checks.if_required(s, trigger, rule, compiler)
    for spec in options.conditionals:
        found += checks.conditional_checks(spec, compiler)
    for r in rules.compile_rules(s, cls, compiler, options.rule_overrides):
        found += r.checks
    if options.domain_rules:
        found += checks.domain_pack(cls, compiler)
    return Plan(s, cls, found, arrays, defaults, options)


def check_frame(df: DataFrame, s: Schema, cls: str, options: Options | None = None) -> Plan:
    return compile_class(s, cls, df.schema, options)


def rollup_report(violations: DataFrame) -> DataFrame:
    """Counts of issues by validator and severity with subtotals (an extension)."""
    return violations.rollup("validator", "severity").agg(F.count(F.lit(1)).alias("n"))
