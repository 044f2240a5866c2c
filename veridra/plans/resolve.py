"""Inheritance, imports, prefixes and the graph of classes. All on the driver."""

from __future__ import annotations

import dataclasses
import os
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.plans import model
from veridra.plans.model import Class, Schema, Slot
from veridra.plans.shared import Scratch, store


class SchemaError(ValueError):
    pass


def parents(s: Schema, name: str) -> list[str]:
    c = s.classes[name]
    return [*([c.is_a] if c.is_a else []), *c.mixins]


def ancestors(s: Schema, name: str, seen: tuple[str, ...] = ()) -> list[str]:
    """The class and all it inherits from, nearest first. A cycle is an error."""
    if name in seen:
        raise SchemaError(f"class {name} inherits from itself: {' -> '.join([*seen, name])}")
    if name not in s.classes:
        raise SchemaError(f"class {name} is not defined")
    out = [name]
    for p in parents(s, name):
        out += [x for x in ancestors(s, p, (*seen, name)) if x not in out]
    return out


def linearised(s: Schema, name: str) -> list[str]:
    """C3 order: each class before those it inherits from, parents in the order they are named."""

    def merge(lists: list[list[str]]) -> list[str]:
        out = []
        while lists := [x for x in lists if x]:
            head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
            if head is None:
                raise SchemaError(f"the parents of {name} have no consistent order")
            out.append(head)
            lists = [[y for y in x if y != head] for x in lists]
        return out

    ancestors(s, name)  # finds cycles
    up = parents(s, name)
    return [name, *merge([*(linearised(s, p) for p in up), up])]


def descendants(s: Schema, name: str) -> list[str]:
    return [c for c in s.classes if c != name and name in ancestors(s, c)]


def children(s: Schema, name: str) -> list[str]:
    return [c for c in s.classes if name in parents(s, c)]


def roots(s: Schema) -> list[str]:
    return [c for c in s.classes if not parents(s, c)]


def leaves(s: Schema) -> list[str]:
    used = {p for c in s.classes for p in parents(s, c)}
    return [c for c in s.classes if c not in used]


def is_subclass_of(s: Schema, name: str, of: str) -> bool:
    return of in ancestors(s, name)


def common_ancestors(s: Schema, a: str, b: str) -> list[str]:
    theirs = set(ancestors(s, b))
    return [x for x in ancestors(s, a) if x in theirs]


def concrete(s: Schema) -> list[str]:
    return [k for k, c in s.classes.items() if not c.abstract]


def _overridden(base: Slot, usage: dict) -> Slot:
    known = {f.name for f in dataclasses.fields(Slot)}
    made = model.slot(base.name, usage)
    return dataclasses.replace(base, **{k: getattr(made, k) for k in usage if k in known and k != "name"})


def induced_slots(s: Schema, name: str) -> dict[str, Slot]:
    """The slots that a record of the class has: of its parent, its mixins, its own, as its usage
    changes them, and its attributes. What comes later wins."""
    ancestors(s, name)
    c, out = s.classes[name], {}
    for p in parents(s, name):
        out |= induced_slots(s, p)
    for x in c.slots:
        inherited = _slot_with_parents(s, x)
        out[x] = out.get(x) if x in out and x not in s.slots else inherited
    for x, usage in c.slot_usage.items():
        out[x] = _overridden(out.get(x) or _slot_with_parents(s, x), usage)
    out |= c.attributes
    return {k: dataclasses.replace(v, range=v.range or s.default_range) for k, v in out.items()}


def _slot_with_parents(s: Schema, name: str, seen: tuple[str, ...] = ()) -> Slot:
    if name in seen:
        raise SchemaError(f"slot {name} inherits from itself")
    own = s.slots.get(name) or Slot(name)
    for p in [*([own.is_a] if own.is_a else []), *own.mixins]:
        above = _slot_with_parents(s, p, (*seen, name))
        blank = Slot(own.name)
        own = dataclasses.replace(own, **{f.name: getattr(above, f.name) for f in dataclasses.fields(Slot) if f.name not in ("name", "is_a", "mixins") and getattr(own, f.name) == getattr(blank, f.name)})
    return own


def slot_ancestors(s: Schema, name: str) -> list[str]:
    out = [name]
    own = s.slots.get(name)
    for p in [*([own.is_a] if own and own.is_a else []), *(own.mixins if own else [])]:
        out += [x for x in slot_ancestors(s, p) if x not in out]
    return out


def identifier_slot(s: Schema, name: str) -> str | None:
    return next((k for k, v in induced_slots(s, name).items() if v.identifier), None)


def type_ancestors(s: Schema, name: str) -> list[str]:
    """The type and what it is based on, down to a built-in one."""
    out = [name]
    while out[-1] in s.types and s.types[out[-1]].base_type not in out:
        out.append(s.types[out[-1]].base_type)
    return out


def is_inlined(s: Schema, slot: Slot) -> bool:
    if slot.range not in s.classes:
        return False
    return slot.inlined if slot.inlined is not None else identifier_slot(s, slot.range) is None


def slot_users(s: Schema, slot: str) -> list[str]:
    return [c for c in s.classes if slot in induced_slots(s, c)]


def in_subset(s: Schema, subset: str) -> list[str]:
    return sorted(k for k, v in {**s.classes, **s.slots}.items() if subset in v.in_subset)


def class_for(s: Schema, keys: list[str], declared: str | None = None) -> str | None:
    """The class of a record: as declared, or the one with most slots among its keys (the first of
    equal ones), or the only root of trees."""
    if declared in s.classes:
        return declared
    overlap = {c: len(set(induced_slots(s, c)) & set(keys)) for c in concrete(s)}
    best = max(overlap, key=overlap.get, default=None)
    if best and overlap[best]:
        return best
    trees = [k for k, c in s.classes.items() if c.tree_root]
    return trees[0] if len(trees) == 1 else None


def topological(s: Schema) -> list[str]:
    """Classes after those that they inherit from."""
    out: list[str] = []
    for c in s.classes:
        out += [x for x in reversed(ancestors(s, c)) if x not in out]
    return out


def edges(s: Schema) -> list[tuple[str, str, str]]:
    """child, parent, kind (is_a, mixin or range) for each link between classes."""
    out = []
    for k, c in s.classes.items():
        out += [(k, c.is_a, "is_a")] * bool(c.is_a) + [(k, m, "mixin") for m in c.mixins]
        out += [(k, x.range, "range") for x in induced_slots(s, k).values() if x.range in s.classes]
    return out


def edge_frame(spark: SparkSession, s: Schema) -> DataFrame:
    return spark.createDataFrame(edges(s), "child string, parent string, kind string")


def closure(edge: DataFrame, max_depth: int = 100) -> DataFrame:
    """child, ancestor and least depth for every chain of (child, parent) edges, up to a depth.

    Chains double in length in each step, so there are as many steps as the logarithm of the depth;
    each is stored in the shared folder. It ends when a step adds no pair, so cycles do no harm.
    """
    with Scratch(edge.sparkSession) as scratch:
        known = scratch.store(edge.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
        n, reach = known.count(), 1
        while n and reach < max_depth:
            further = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
            longer = known.join(further, "ancestor").select("child", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).filter(F.col("depth") <= max_depth)
            known = scratch.store(known.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
            scratch.drop(most=1)
            before, n, reach = n, known.count(), 2 * reach
            if n == before:
                break
        return store(known)


def merged_imports(s: Schema, read: Callable[[str], Schema], seen: frozenset[str] = frozenset()) -> Schema:
    """The schema with all that it imports, by name; its own definitions win. Cycles are cut."""
    out = dataclasses.replace(s)
    for name in s.imports:
        if name in seen:
            continue
        other = merged_imports(read(name), read, seen | {name})
        for part in ("prefixes", "classes", "slots", "types", "enums", "subsets"):
            setattr(out, part, getattr(other, part) | getattr(out, part))
    out.imports = []
    return out


def read_relative(folder: str) -> Callable[[str], Schema]:
    def read(name: str) -> Schema:
        for end in ("", ".yaml", ".yml", ".json"):
            if os.path.isfile(path := os.path.join(folder, name + end)):
                return model.load(path)
        raise SchemaError(f"import {name} is not in {folder}")

    return read


# -- names with prefixes --------------------------------------------------------------------------


def expand(s: Schema, curie: str) -> str:
    prefix, colon, local = curie.partition(":")
    return s.prefixes[prefix] + local if colon and prefix in s.prefixes and not local.startswith("//") else curie


def contract(s: Schema, uri: str) -> str:
    """The shortest form: the longest prefix that fits."""
    fits = sorted((ref, p) for p, ref in s.prefixes.items() if ref and uri.startswith(ref))
    if not fits:
        return uri
    ref = max(fits, key=lambda x: len(x[0]))
    return f"{ref[1]}:{uri[len(ref[0]):]}"


def same_entity(s: Schema, a: str, b: str) -> bool:
    return expand(s, a) == expand(s, b)


def expand_column(s: Schema, c: Column) -> Column:
    prefix, local = F.regexp_extract(c, r"^([^:]*):", 1), F.regexp_extract(c, r"^[^:]*:(.*)$", 1)
    out = c
    for p, ref in s.prefixes.items():
        out = F.when((prefix == p) & ~local.startswith("//") & c.contains(":"), F.concat(F.lit(ref), local)).otherwise(out)
    return out


def contract_column(s: Schema, c: Column) -> Column:
    fits = [(p, ref) for p, ref in sorted(s.prefixes.items(), key=lambda x: (-len(x[1]), x[0])) if ref]
    return F.coalesce(*[F.when(c.startswith(ref), F.concat(F.lit(f"{p}:"), F.substr(c, F.lit(len(ref) + 1)))) for p, ref in fits], c)


# -- statistics and lint --------------------------------------------------------------------------


def statistics(s: Schema) -> dict[str, float]:
    sizes = [len(induced_slots(s, c)) for c in s.classes]
    return {
        "classes": len(s.classes), "abstract_classes": sum(c.abstract for c in s.classes.values()), "slots": len(s.slots), "types": len(s.types), "enums": len(s.enums),
        "roots": len(roots(s)), "leaves": len(leaves(s)), "max_depth": max((_depth(s, c) for c in s.classes), default=0), "mean_slots": sum(sizes) / len(sizes) if sizes else 0.0,
    }


def _depth(s: Schema, name: str) -> int:
    return 1 + max((_depth(s, p) for p in parents(s, name)), default=-1)


def usage(s: Schema) -> Counter:
    """How often each class, slot, type and enumeration is referred to."""
    n: Counter = Counter()
    for c in s.classes.values():
        n.update([*([c.is_a] if c.is_a else []), *c.mixins, *c.slots, *c.slot_usage])
        n.update(x.range for x in c.attributes.values() if x.range)
    n.update(x.range for x in s.slots.values() if x.range)
    return n


_PASCAL, _SNAKE = re.compile(r"[A-Z][A-Za-z0-9]*$"), re.compile(r"[a-z][a-z0-9_]*$")
#: Ranges that need no definition.
BUILT_IN = ("string", "str", "integer", "int", "float", "double", "decimal", "boolean", "bool", "date", "datetime", "time", "date_or_datetime", "uri", "uriorcurie", "curie", "ncname", "objectidentifier", "nodeidentifier")


def lint(s: Schema) -> list[tuple[str, str, str]]:
    """rule, element and message for each finding."""
    out = []
    out += [("naming", k, "a class name is in PascalCase") for k in s.classes if not _PASCAL.match(k)]
    slots = {**s.slots, **{k: v for c in s.classes.values() for k, v in c.attributes.items()}}
    out += [("naming", k, "a slot name is in snake_case") for k in slots if not _SNAKE.match(k)]
    out += [("documentation", k, "there is no description") for k, v in {**s.classes, **slots}.items() if not v.description]
    used = usage(s)
    out += [("unused", k, "it is never referred to") for k in [*s.slots, *s.types, *s.enums] if not used[k]]
    out += [("undefined_slot", f"{c.name}.{x}", "the slot is not defined") for c in s.classes.values() for x in c.slots if x not in s.slots]
    ranges = {*BUILT_IN, *s.types, *s.enums, *s.classes}
    out += [("invalid_range", k, f"the range {v.range} is not defined") for k, v in slots.items() if v.range and v.range not in ranges]
    out += [("metadata", part, f"the schema has no {part}") for part in ("id", "name", "description", "version") if not getattr(s, part)]
    return out


def without_unused(s: Schema) -> Schema:
    """The schema without slots, types and enumerations that nothing refers to."""
    used = usage(s)
    return dataclasses.replace(s, **{part: {k: v for k, v in getattr(s, part).items() if used[k]} for part in ("slots", "types", "enums")})


def class_of(s: Schema, name: str) -> Class:
    if name not in s.classes:
        raise SchemaError(f"class {name} is not defined")
    return s.classes[name]
