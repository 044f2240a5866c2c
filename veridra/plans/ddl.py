"""Schemas as SQL tables, JSON Schema, Spark types and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.operators import checks
from veridra.plans import resolve
from veridra.plans.model import Schema, Slot


def sql_type(s: Schema, slot: Slot) -> str:
    of = checks.base_range(s, slot.range)
    if of in checks.INTEGERS:
        return "BIGINT"
    if of in checks.NUMBERS:
        return "DECIMAL(19,4)" if of == "decimal" else "DOUBLE PRECISION"
    return {"boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP", "time": "TIME"}.get(of, f"VARCHAR({slot.max_length})" if slot.max_length else "TEXT")


def create_tables(s: Schema) -> str:
    """A table for each concrete class, with keys, checks and references; many values have a table of
    their own."""
    out = []
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    for cls in (c for c in resolve.topological(s) if not s.classes[c].abstract):
        slots, identifier = resolve.induced_slots(s, cls), resolve.identifier_slot(s, cls)
        lines, extra = [], []
        for name, slot in slots.items():
            if slot.multivalued:
                key = identifier or "id"
                extra.append(f"CREATE TABLE {cls}_{name} (\n  {key} {sql_type(s, slots[key]) if key in slots else 'BIGINT'} NOT NULL,\n  {name} {sql_type(s, slot)} NOT NULL\n);")
                continue
            line = f"  {name} {sql_type(s, slot)}"
            line += " PRIMARY KEY" if slot.identifier else " NOT NULL" if slot.required else ""
            tests = ([f"{name} >= {slot.minimum_value}"] if slot.minimum_value is not None else []) + ([f"{name} <= {slot.maximum_value}"] if slot.maximum_value is not None else [])
            if slot.range in s.enums:
                tests.append(f"{name} IN ({', '.join(map(quoted, s.enums[slot.range].values))})")
            line += f" CHECK ({' AND '.join(tests)})" if tests else ""
            if slot.range in s.classes and (target := resolve.identifier_slot(s, slot.range)):
                line += f" REFERENCES {slot.range} ({target})"
            lines.append(line)
        lines += [f"  UNIQUE ({', '.join(k.unique_key_slots)})" for k in s.classes[cls].unique_keys.values()]
        out.append(f"CREATE TABLE {cls} (\n" + ",\n".join(lines) + "\n);")
        out += extra
    return "\n\n".join(out)


def json_schema(s: Schema, cls: str) -> dict:
    """A JSON Schema for records of a class; the classes that it refers to are definitions."""
    defs: dict[str, dict] = {}

    def of_slot(slot: Slot) -> dict:
        of = checks.base_range(s, slot.range)
        if of in s.enums:
            out: dict = {"type": "string", "enum": s.enums[of].values}
        elif of in s.classes:
            of_class(of)
            out = {"$ref": f"#/$defs/{of}"} if resolve.is_inlined(s, slot) else {"type": "string"}
        else:
            out = {"type": "integer" if of in checks.INTEGERS else "number" if of in checks.NUMBERS else "boolean" if of in checks.BOOLEANS else "string"}
            out |= {"format": {"date": "date", "datetime": "date-time", "time": "time", "uri": "uri"}[of]} if of in ("date", "datetime", "time", "uri") else {}
        names = {"pattern": "pattern", "minimum_value": "minimum", "maximum_value": "maximum", "min_length": "minLength", "max_length": "maxLength"}
        out |= {names[k]: getattr(slot, k) for k in names if getattr(slot, k) is not None}
        if slot.multivalued:
            out = {"type": "array", "items": out}
            out |= {k: v for k, v in (("minItems", slot.minimum_cardinality), ("maxItems", slot.maximum_cardinality)) if v is not None}
            out |= {"uniqueItems": True} if slot.unique else {}
        return out

    def of_class(name: str) -> None:
        if name in defs:
            return
        defs[name] = {}
        slots = resolve.induced_slots(s, name)
        defs[name] |= {"type": "object", "properties": {k: of_slot(v) for k, v in slots.items()}, "additionalProperties": s.allow_additional_properties}
        if need := [k for k, v in slots.items() if v.required or v.identifier]:
            defs[name]["required"] = need

    of_class(cls)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$ref": f"#/$defs/{cls}", "$defs": defs}


def to_spark(s: Schema, cls: str) -> T.StructType:
    from veridra.sources.readers import struct_type

    return struct_type(s, cls)


def select_valid(df: DataFrame, s: Schema, cls: str) -> DataFrame:
    """The query a schema stands for: rows that have all required slots and whose values are within
    their bounds, patterns and enumerations; optional slots may be NULL."""
    slots = {k: v for k, v in resolve.induced_slots(s, cls).items() if k in df.columns}
    out = df.select(*slots)
    for name, slot in slots.items():
        c = F.col(f"`{name}`")
        tests = ([c >= checks.bound(slot.minimum_value, df.schema[name].dataType)] if slot.minimum_value is not None else []) + ([c <= checks.bound(slot.maximum_value, df.schema[name].dataType)] if slot.maximum_value is not None else [])
        tests += [c.cast("string").rlike(checks.java_pattern(slot.pattern))] if slot.pattern else []
        tests += [c.cast("string").isin(s.enums[slot.range].values)] if slot.range in s.enums else []
        for t in tests:
            out = out.filter(t if slot.required else c.isNull() | t)
        if slot.required and not tests:
            out = out.filter(c.isNotNull())
    return out
