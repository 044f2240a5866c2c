"""Schemas: classes, slots, types, enumerations, rules. They live on the driver and are small."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Expr:
    """A fragment of constraints on one value, as combinators and rule conditions hold them."""

    range: str | None = None
    required: bool | None = None
    pattern: str | None = None
    minimum_value: Any = None
    maximum_value: Any = None
    equals_string: str | None = None
    equals_number: float | None = None
    equals_string_in: list[str] | None = None
    equals_expression: str | None = None
    minimum_cardinality: int | None = None
    maximum_cardinality: int | None = None
    any_of: list[Expr] = field(default_factory=list)
    all_of: list[Expr] = field(default_factory=list)
    exactly_one_of: list[Expr] = field(default_factory=list)
    none_of: list[Expr] = field(default_factory=list)

    def empty(self) -> bool:
        return self == Expr()


@dataclass
class StructuredPattern:
    syntax: str = ""
    kind: str = "regex"
    interpolated: bool = False
    partial_match: bool = False


@dataclass
class Slot:
    name: str = ""
    range: str | None = None
    description: str | None = None
    required: bool = False
    multivalued: bool = False
    identifier: bool = False
    unique: bool = False
    pattern: str | None = None
    structured_pattern: StructuredPattern | None = None
    minimum_value: Any = None
    maximum_value: Any = None
    min_length: int | None = None
    max_length: int | None = None
    minimum_cardinality: int | None = None
    maximum_cardinality: int | None = None
    permissible_values: list[str] | None = None
    equals_string_in: list[str] | None = None
    equals_expression: str | None = None
    rules: list[str] = field(default_factory=list)
    ifabsent: str | None = None
    inlined: bool | None = None
    inverse: str | None = None
    is_a: str | None = None
    mixins: list[str] = field(default_factory=list)
    slot_uri: str | None = None
    in_subset: list[str] = field(default_factory=list)
    annotations: dict[str, Any] = field(default_factory=dict)
    any_of: list[Expr] = field(default_factory=list)
    all_of: list[Expr] = field(default_factory=list)
    exactly_one_of: list[Expr] = field(default_factory=list)
    none_of: list[Expr] = field(default_factory=list)


@dataclass
class Conditions:
    """What a rule asks of a record: slots, expressions, and combinations of further conditions."""

    slot_conditions: dict[str, Expr] = field(default_factory=dict)
    expression_conditions: list[str] = field(default_factory=list)
    any_of: list[Conditions] = field(default_factory=list)
    all_of: list[Conditions] = field(default_factory=list)
    exactly_one_of: list[Conditions] = field(default_factory=list)
    none_of: list[Conditions] = field(default_factory=list)


@dataclass
class Rule:
    title: str = ""
    description: str | None = None
    priority: int = 0
    deactivated: bool = False
    preconditions: Conditions | None = None
    postconditions: Conditions | None = None
    elseconditions: Conditions | None = None


@dataclass
class UniqueKey:
    name: str = ""
    unique_key_slots: list[str] = field(default_factory=list)
    nulls_equal: bool = False
    primary: bool = False


@dataclass
class IfRequired:
    """If ``condition`` holds for the slot it is filed under, the other slots must be given."""

    condition: Expr = field(default_factory=Expr)
    then_required: list[str] = field(default_factory=list)


@dataclass
class Class:
    name: str = ""
    description: str | None = None
    is_a: str | None = None
    mixins: list[str] = field(default_factory=list)
    slots: list[str] = field(default_factory=list)
    attributes: dict[str, Slot] = field(default_factory=dict)
    slot_usage: dict[str, dict] = field(default_factory=dict)
    abstract: bool = False
    tree_root: bool = False
    class_uri: str | None = None
    in_subset: list[str] = field(default_factory=list)
    annotations: dict[str, Any] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    if_required: dict[str, IfRequired] = field(default_factory=dict)
    unique_keys: dict[str, UniqueKey] = field(default_factory=dict)


@dataclass
class Type:
    name: str = ""
    base_type: str = "string"
    uri: str | None = None
    pattern: str | None = None
    minimum_value: Any = None
    maximum_value: Any = None


@dataclass
class Enum:
    name: str = ""
    description: str | None = None
    values: list[str] = field(default_factory=list)


@dataclass
class Schema:
    id: str = ""
    name: str = ""
    description: str | None = None
    version: str | None = None
    default_range: str = "string"
    default_prefix: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    imports: list[str] = field(default_factory=list)
    classes: dict[str, Class] = field(default_factory=dict)
    slots: dict[str, Slot] = field(default_factory=dict)
    types: dict[str, Type] = field(default_factory=dict)
    enums: dict[str, Enum] = field(default_factory=dict)
    subsets: dict[str, str | None] = field(default_factory=dict)
    allow_additional_properties: bool = True

    def to_dict(self) -> dict:
        return _plain(dataclasses.asdict(self))


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v not in (None, [], {}, False, "") or k == "allow_additional_properties"}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _build(kind: type, data: dict | None, **given: Any) -> Any:
    """A dataclass from a mapping; keys that it doesn't know are not an error."""
    known = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: v for k, v in (data or {}).items() if k in known and v is not None} | given)


def expr(data: dict | Expr) -> Expr:
    if isinstance(data, Expr):
        return data
    return _build(Expr, data, **{k: [expr(x) for x in data.get(k) or []] for k in ("any_of", "all_of", "exactly_one_of", "none_of")})


def slot(name: str, data: dict | None) -> Slot:
    data = dict(data or {})
    pattern = data.get("structured_pattern")
    data["permissible_values"] = _values(data["permissible_values"]) if data.get("permissible_values") else None
    return _build(Slot, data, name=name, structured_pattern=_build(StructuredPattern, pattern) if pattern else None, **{k: [expr(x) for x in data.get(k) or []] for k in ("any_of", "all_of", "exactly_one_of", "none_of")})


def conditions(data: dict | None) -> Conditions | None:
    if data is None:
        return None
    return Conditions({k: expr(v) for k, v in (data.get("slot_conditions") or {}).items()}, list(data.get("expression_conditions") or []), *([conditions(x) for x in data.get(k) or []] for k in ("any_of", "all_of", "exactly_one_of", "none_of")))


def rule(data: dict) -> Rule:
    return _build(Rule, data, **{k: conditions(data.get(k)) for k in ("preconditions", "postconditions", "elseconditions")})


def _values(data: list | dict) -> list[str]:
    """Permissible values, given as a list of texts or mappings or as a mapping by text."""
    return [str(x.get("text")) if isinstance(x, dict) else str(x) for x in data]


def class_(name: str, data: dict | None) -> Class:
    data = data or {}
    return _build(
        Class, data, name=name,
        attributes={k: slot(k, v) for k, v in (data.get("attributes") or {}).items()},
        slot_usage={k: dict(v or {}) for k, v in (data.get("slot_usage") or {}).items()},
        rules=[rule(x) for x in data.get("rules") or []],
        if_required={k: IfRequired(expr(v.get("condition") or {}), list(v.get("then_required") or [])) for k, v in (data.get("if_required") or {}).items()},
        unique_keys={k: _build(UniqueKey, v if isinstance(v, dict) else {"unique_key_slots": v}, name=k) for k, v in (data.get("unique_keys") or {}).items()},
    )


def schema(data: dict) -> Schema:
    return _build(
        Schema, data,
        prefixes={k: v if isinstance(v, str) else v.get("prefix_reference", "") for k, v in (data.get("prefixes") or {}).items()},
        classes={k: class_(k, v) for k, v in (data.get("classes") or {}).items()},
        slots={k: slot(k, v) for k, v in (data.get("slots") or {}).items()},
        types={k: _build(Type, v, name=k) for k, v in (data.get("types") or {}).items()},
        enums={k: _build(Enum, v, name=k, values=_values((v or {}).get("permissible_values") or (v or {}).get("values") or [])) for k, v in (data.get("enums") or {}).items()},
        subsets={k: (v or {}).get("description") if isinstance(v, dict) else v for k, v in (data.get("subsets") or {}).items()},
        allow_additional_properties=((data.get("settings") or {}).get("validation") or {}).get("allow_additional_properties", data.get("allow_additional_properties", True)),
    )


def loads(text: str, kind: str = "yaml") -> Schema:
    """A schema from JSON or YAML text."""
    if kind == "json":
        return schema(json.loads(text))
    import yaml

    return schema(yaml.safe_load(text))


def load(path: str) -> Schema:
    with open(path, encoding="utf-8") as f:
        return loads(f.read(), "json" if path.endswith(".json") else "yaml")
