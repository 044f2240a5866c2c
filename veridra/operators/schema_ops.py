"""Algebra of schemas: merge, difference, patch. Schemas are small, so all of it is on the driver;
``diff_frame`` gives a difference as a table."""

from __future__ import annotations

import copy
import dataclasses
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from veridra.plans import model
from veridra.plans.model import Class, Schema, Slot

PARTS = ("prefixes", "classes", "slots", "types", "enums", "subsets")


def merge(a: Schema, b: Schema, how: str = "union") -> Schema:
    """union: everything, of equal names the first's with what only the second says; intersection: the
    names in both; override: the second's win; preserve: the first's win; strict: a conflict is an
    error."""
    out = dataclasses.replace(a)
    for part in PARTS:
        x, y = getattr(a, part), getattr(b, part)
        if how == "strict" and (clash := [k for k in x if k in y and x[k] != y[k]]):
            raise ValueError(f"{part} {', '.join(clash)} differ")
        if how == "intersection":
            merged = {k: x[k] for k in x if k in y}
        elif how == "override":
            merged = {**x, **y}
        else:
            merged = {**y, **x}
            if how == "union":
                merged = {k: _joined(x[k], y[k]) if k in x and k in y else v for k, v in merged.items()}
                merged = {k: merged[k] for k in [*x, *(k for k in y if k not in x)]}
        setattr(out, part, merged)
    return out


def _joined(x: Any, y: Any) -> Any:
    if not dataclasses.is_dataclass(x) or type(x) is not type(y):
        return x
    blank, out = type(x)(), {}
    for f in dataclasses.fields(x):
        a, b = getattr(x, f.name), getattr(y, f.name)
        if isinstance(a, list):
            out[f.name] = a + [e for e in b if e not in a]
        elif isinstance(a, dict):
            out[f.name] = {**b, **a}
        else:
            out[f.name] = b if a == getattr(blank, f.name) else a
    return type(x)(**out)


@dataclass(frozen=True)
class Change:
    kind: str  # added, removed, modified, renamed
    element: str  # class, slot, type, enum, prefix, subset, attribute
    name: str
    detail: str = ""
    breaking: bool = False


def _slot_changes(where: str, a: Slot, b: Slot) -> list[Change]:
    out = []
    for f in dataclasses.fields(Slot):
        x, y = getattr(a, f.name), getattr(b, f.name)
        if x == y:
            continue
        breaking = f.name in ("range", "multivalued", "pattern", "permissible_values") or (f.name in ("required", "identifier") and bool(y)) or (f.name == "minimum_value" and y is not None and (x is None or float(y) > float(x))) or (f.name == "maximum_value" and y is not None and (x is None or float(y) < float(x)))
        out.append(Change("modified", "slot", where, f"{f.name}: {x} -> {y}", breaking))
    return out


def diff(a: Schema, b: Schema) -> list[Change]:
    """What leads from one schema to the other."""
    out: list[Change] = []
    single = {"prefixes": "prefix", "classes": "class", "slots": "slot", "types": "type", "enums": "enum", "subsets": "subset"}
    for part in PARTS:
        x, y, element = getattr(a, part), getattr(b, part), single[part]
        out += [Change("removed", element, k, breaking=part not in ("prefixes", "subsets")) for k in x if k not in y]
        out += [Change("added", element, k) for k in y if k not in x]
        for k in x:
            if k not in y or x[k] == y[k]:
                continue
            if part == "classes":
                out += _class_changes(k, x[k], y[k])
            elif part == "slots":
                out += _slot_changes(k, x[k], y[k])
            elif part == "enums":
                gone, new = [v for v in x[k].values if v not in y[k].values], [v for v in y[k].values if v not in x[k].values]
                out.append(Change("modified", "enum", k, f"removed {gone}, added {new}", bool(gone)))
            else:
                out.append(Change("modified", element, k, f"{x[k]} -> {y[k]}", part == "types"))
    return out


def _class_changes(name: str, a: Class, b: Class) -> list[Change]:
    out = []
    for f in dataclasses.fields(Class):
        x, y = getattr(a, f.name), getattr(b, f.name)
        if x == y:
            continue
        if f.name == "attributes":
            out += [Change("removed", "attribute", f"{name}.{k}", breaking=True) for k in x if k not in y]
            out += [Change("added", "attribute", f"{name}.{k}", breaking=y[k].required) for k in y if k not in x]
            out += [c for k in x if k in y for c in _slot_changes(f"{name}.{k}", x[k], y[k])]
        elif f.name == "slots":
            out += [Change("removed", "class_slot", f"{name}.{k}", breaking=True) for k in x if k not in y]
            out += [Change("added", "class_slot", f"{name}.{k}") for k in y if k not in x]
        else:
            out.append(Change("modified", "class", name, f.name, f.name in ("is_a", "mixins", "abstract")))
    return out


def renames(a: Schema, b: Schema, least: float = 0.8) -> list[Change]:
    """Classes that were probably renamed: removed and added ones whose slots overlap enough."""
    from veridra.plans.resolve import induced_slots

    gone = {k: set(induced_slots(a, k)) for k in a.classes if k not in b.classes}
    new = {k: set(induced_slots(b, k)) for k in b.classes if k not in a.classes}
    out = []
    for k, x in gone.items():
        for n, y in new.items():
            if x | y and len(x & y) / len(x | y) >= least:
                out.append(Change("renamed", "class", k, n, True))
    return out


def severity(c: Change) -> str:
    return "breaking" if c.breaking else "minor" if c.kind in ("added", "modified") else "patch"


def diff_frame(spark: SparkSession, a: Schema, b: Schema) -> DataFrame:
    return spark.createDataFrame([dataclasses.astuple(c) for c in diff(a, b)], "kind string, element string, name string, detail string, breaking boolean")


def _walk(doc: Any, path: str) -> tuple[Any, str]:
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    for p in parts[:-1]:
        doc = doc[int(p)] if isinstance(doc, list) else doc[p]
    return doc, parts[-1]


def patch(s: Schema, operations: list[dict]) -> Schema:
    """A schema after JSON-patch operations (add, remove, replace, move, copy, test) on its mapping."""
    doc = copy.deepcopy(s.to_dict())

    def read(path: str) -> Any:
        at, key = _walk(doc, path)
        return at[int(key)] if isinstance(at, list) else at[key]

    def remove(path: str) -> Any:
        at, key = _walk(doc, path)
        return at.pop(int(key)) if isinstance(at, list) else at.pop(key)

    def add(path: str, value: Any) -> None:
        at, key = _walk(doc, path)
        if isinstance(at, list):
            at.insert(len(at) if key == "-" else int(key), value)
        else:
            at[key] = value

    for op in operations:
        kind, path = op["op"], op["path"]
        if kind == "test":
            if read(path) != op["value"]:
                raise ValueError(f"{path} is not {op['value']}")
        elif kind == "remove":
            remove(path)
        elif kind == "replace":
            remove(path)
            add(path, op["value"])
        elif kind == "add":
            add(path, op["value"])
        elif kind == "move":
            add(path, remove(op["from"]))
        elif kind == "copy":
            add(path, copy.deepcopy(read(op["from"])))
        else:
            raise ValueError(f"there is no operation {kind}")
    return model.schema(doc)


def patch_between(a: Schema, b: Schema) -> list[dict]:
    """Operations that lead from one schema to the other, by named element."""
    x, y, out = a.to_dict(), b.to_dict(), []
    safe = lambda k: str(k).replace("~", "~0").replace("/", "~1")
    for part in {**x, **y}:
        if not (isinstance(x.get(part), dict) and isinstance(y.get(part), dict)):
            if x.get(part) != y.get(part):
                out.append({"op": "remove", "path": f"/{part}"} if part not in y else {"op": "replace" if part in x else "add", "path": f"/{part}", "value": y[part]})
            continue
        for k in {**x[part], **y[part]}:
            p = f"/{part}/{safe(k)}"
            if k not in y[part]:
                out.append({"op": "remove", "path": p})
            elif k not in x[part]:
                out.append({"op": "add", "path": p, "value": y[part][k]})
            elif x[part][k] != y[part][k]:
                out.append({"op": "replace", "path": p, "value": y[part][k]})
    return out
