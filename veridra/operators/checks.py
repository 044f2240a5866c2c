"""Checks of one record, each a boolean column that is true where the record violates it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.functions.expressions import Compiler, all_of, any_of
from veridra.functions.library import Typed, truthy
from veridra.plans import resolve
from veridra.plans.model import Expr, IfRequired, Schema, Slot

ERROR, WARNING = "error", "warning"

#: Texts that count as true and as false when a cell is read.
TRUE_TEXTS, FALSE_TEXTS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
#: Patterns of formats that are known by name.
FORMATS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "url": r"^https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d+)?(?:/\S*)?$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
}

INTEGERS, NUMBERS = ("integer", "int", "long"), ("float", "double", "decimal")
BOOLEANS, TEXTS = ("boolean", "bool"), ("string", "str")


@dataclass
class Check:
    """violated is true or NULL where it says nothing; ``message`` may be a column."""

    slot: str
    code: str
    violated: Column
    message: Column | str
    severity: str = ERROR
    path: Column | str | None = None
    validator: str = ""
    context: dict[str, Column | str] | None = None

    def issue(self) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        context = self.context or {}
        pairs = [y for k, v in context.items() for y in (F.lit(k), as_column(v).cast("string"))]
        return F.struct(
            F.lit(self.severity).alias("severity"), as_column(self.message).alias("message"), as_column(self.path if self.path is not None else f"$.{self.slot}").alias("path"),
            F.lit(self.validator or self.code).alias("validator"), F.lit(self.code).alias("code"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("context"),
        )


def java_pattern(pattern: str) -> str:
    """Named groups of other dialects as Java spells them (its names have no underscores)."""
    return re.sub(r"\(\?P?<([A-Za-z_]\w*)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", pattern)


def group_names(pattern: str) -> dict[str, int]:
    """Number of each named group."""
    out, number, i = {}, 0, 0
    bare = re.sub(r"\\.", "..", pattern)
    bare = re.sub(r"\[[^\]]*\]", lambda m: "." * len(m[0]), bare)
    while (i := bare.find("(", i)) >= 0:
        if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:]):
            number += 1
            out[m[1]] = number
        elif bare[i : i + 2] != "(?":
            number += 1
        i += 1
    return out


def captures(c: Column, pattern: str) -> dict[str, Column]:
    """A column for each named group; NULL where the pattern doesn't match."""
    p = java_pattern(pattern)
    return {name: F.when(c.rlike(p), F.regexp_extract(c, p, n)) for name, n in group_names(pattern).items()}


def capture_map(c: Column, pattern: str) -> Column:
    """All captures of a row as a map."""
    got = captures(c, pattern)
    return F.when(c.rlike(java_pattern(pattern)), F.create_map(*[x for k, v in got.items() for x in (F.lit(k), v)]))


@dataclass
class Capture:
    """How a captured text becomes a value, and what is asked of it."""

    kind: str = "string"
    required: bool = False
    default: object = None
    minimum: float | None = None
    maximum: float | None = None
    max_length: int | None = None
    values: list[str] | None = None
    pattern: str | None = None


def typed_captures(c: Column, pattern: str, wanted: dict[str, Capture]) -> dict[str, tuple[Column, Column]]:
    """For each group its value and whether that is invalid."""
    out = {}
    for name, raw in captures(c, pattern).items():
        w = wanted.get(name, Capture())
        text = F.when(raw != "", raw)
        value = {"integer": lambda: text.try_cast("long"), "float": lambda: text.try_cast("double"), "boolean": lambda: to_boolean(text)}.get(w.kind, lambda: text)()
        bad = [text.isNotNull() & value.isNull()]
        bad += [text.isNull()] if w.required and w.default is None else []
        bad += [value < w.minimum] if w.minimum is not None else []
        bad += [value > w.maximum] if w.maximum is not None else []
        bad += [F.length(text) > w.max_length] if w.max_length is not None else []
        bad += [~text.isin(w.values)] if w.values else []
        bad += [~text.rlike(w.pattern)] if w.pattern else []
        out[name] = (F.coalesce(value, F.lit(w.default)) if w.default is not None else value, F.coalesce(any_of([F.coalesce(b, F.lit(False)) for b in bad]), F.lit(False)))
    return out


# -- types -------------------------------------------------------------------------------------


def to_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False)


def base_range(s: Schema, name: str | None) -> str:
    """The built-in type that a range comes down to; classes and unknown names stay as they are."""
    return resolve.type_ancestors(s, name or s.default_range)[-1]


def is_valid_type(c: Column, kind: T.DataType, of: str) -> Column:
    """Whether a value of Spark type ``kind`` is one of the built-in range; unknown ranges admit all."""
    text = isinstance(kind, T.StringType)
    if of in TEXTS:
        return F.lit(text)
    if of in INTEGERS:
        if isinstance(kind, T.IntegralType):
            return F.lit(True)
        return (c == F.floor(c)) if isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType) else c.rlike(r"^\s*[+-]?\d+\s*$") if text else F.lit(False)
    if of in NUMBERS:
        return F.lit(True) if isinstance(kind, T.NumericType) else c.try_cast("double").isNotNull() if text else F.lit(False)
    if of in BOOLEANS:
        return F.lit(True) if isinstance(kind, T.BooleanType) else F.lower(c).isin("true", "false") if text else F.lit(False)
    if of == "date":
        return F.lit(True) if isinstance(kind, T.DateType) else F.try_to_date(c, "yyyy-MM-dd").isNotNull() & c.rlike(FORMATS["date"]) if text else F.lit(False)
    if of == "datetime":
        return F.lit(True) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else (c.rlike(FORMATS["datetime"]) & F.try_to_timestamp(c).isNotNull()) if text else F.lit(False)
    if of == "date_or_datetime":
        return is_valid_type(c, kind, "date") | is_valid_type(c, kind, "datetime")
    if not text and of in ("time", "uri", "uriorcurie", "curie", "ncname"):
        return F.lit(False)
    patterns = {
        "time": r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$",
        "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$",
        "uriorcurie": r"^[A-Za-z_][A-Za-z0-9+._-]*:[^\s]*$",
        "curie": r"^(?!http)[^\s:]*:[^\s]*$",
        "ncname": r"^[\p{L}_][^\s:]*$",
    }
    return c.rlike(patterns[of]) if of in patterns else F.lit(True)


def convert(c: Column, of: str) -> Column:
    """A cell's text as a value of the range, NULL where it is none; dates stay text."""
    cell = F.nullif(F.trim(c), F.lit(""))
    if of in INTEGERS:
        return cell.try_cast("long")
    if of in NUMBERS:
        return cell.try_cast("double")
    return to_boolean(cell) if of in BOOLEANS else cell


def convert_many(c: Column, of: str) -> Column:
    """A cell's values, split at the first of ; | , that it holds."""
    parts = F.when(c.contains(";"), F.split(c, ";")).when(c.contains("|"), F.split(c, r"\|")).otherwise(F.split(c, ","))
    return F.transform(parts, lambda e: convert(e, of))


# -- constraints on a value ------------------------------------------------------------------------


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def bound(value: object, kind: T.DataType, of: str = "") -> Column:
    """A bound, which may be given as text, as a column that can be compared with the value."""
    if isinstance(kind, T.DateType):
        return F.lit(str(value)).cast("date")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.lit(str(value)).cast("timestamp")
    if of in ("date", "datetime", "time", "date_or_datetime"):
        return F.lit(str(value))
    return F.lit(float(value))


def comparable(c: Column, kind: T.DataType, of: str = "") -> Column:
    if is_numeric(kind):
        return c.cast("double")
    if isinstance(kind, T.StringType) and of not in ("date", "datetime", "time", "date_or_datetime"):
        return c.try_cast("double")
    return c


def full_pattern(p: str, kind: str, partial: bool) -> str:
    """A regex or glob as a Java pattern; a whole match unless ``partial``."""
    if kind == "glob":
        return "^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in p) + "$"
    if kind != "regex":
        raise ValueError(f"patterns of kind {kind} are not supported")
    return java_pattern(p) if partial else f"^(?:{java_pattern(p)})$"


def satisfied(s: Schema, c: Column, kind: T.DataType, e: Expr, compiler: Compiler) -> Column:
    """Whether a value meets all that a fragment asks; an empty one admits all. A NULL meets all but
    ``required``."""
    parts = []
    if e.range:
        of = base_range(s, e.range)
        parts.append(c.isin(s.enums[of].values) if of in s.enums else is_valid_type(c, kind, of))
    if e.pattern:
        parts.append(c.cast("string").rlike(java_pattern(e.pattern)))
    if e.equals_string is not None:
        parts.append(c.cast("string") == e.equals_string)
    if e.equals_number is not None:
        parts.append(F.abs(comparable(c, kind) - e.equals_number) < 1e-9)
    if e.equals_string_in:
        parts.append(c.cast("string").isin(e.equals_string_in))
    if e.equals_expression:
        parts.append(compiler.equal(Typed(c, kind), compiler(e.equals_expression)))
    if e.minimum_value is not None:
        parts.append(comparable(c, kind) >= bound(e.minimum_value, kind))
    if e.maximum_value is not None:
        parts.append(comparable(c, kind) <= bound(e.maximum_value, kind))
    if isinstance(kind, T.ArrayType):
        if e.minimum_cardinality is not None:
            parts.append(F.size(c) >= e.minimum_cardinality)
        if e.maximum_cardinality is not None:
            parts.append(F.size(c) <= e.maximum_cardinality)
    parts += [combined(s, c, kind, name, branches, compiler)[0] for name in ("any_of", "all_of", "exactly_one_of", "none_of") if (branches := getattr(e, name))]
    met = c.isNull() | all_of([F.coalesce(p, F.lit(False)) for p in parts])
    return (c.isNotNull() & met) if e.required else (c.isNull() & met) if e.required is False and not parts else met


def combined(s: Schema, c: Column, kind: T.DataType, name: str, branches: list[Expr], compiler: Compiler) -> tuple[Column, Column]:
    """Whether a combination holds, and how many of its branches do."""
    each = [satisfied(s, c, kind, e, compiler) for e in branches]
    n = sum((x.cast("int") for x in each[1:]), each[0].cast("int"))
    return {"any_of": n > 0, "all_of": n == len(each), "exactly_one_of": n == 1, "none_of": n == 0}[name], n


def value_checks(s: Schema, slot: Slot, c: Column, kind: T.DataType, compiler: Compiler, path: Column | str) -> list[Check]:
    """Checks of one value, or of one element of a slot of many values."""
    of = base_range(s, slot.range)
    out: list[Check] = []
    add = lambda code, violated, message, **more: out.append(Check(slot.name, code, c.isNotNull() & violated, message, path=path, validator=code, **more))
    if of in s.enums:
        values = s.enums[of].values
        add("enum", ~c.cast("string").isin(values), F.concat(F.lit(f"{slot.name} is not a value of {of}: "), c.cast("string")))
    elif of not in s.classes:
        valid = is_valid_type(c, kind, of)
        add("type", ~F.coalesce(valid, F.lit(False)), f"{slot.name} is not of type {slot.range}")
    if slot.permissible_values:
        add("enum", ~c.cast("string").isin(slot.permissible_values), f"{slot.name} has a value that is not permitted")
    for p in [slot.pattern, *(s.types[t].pattern for t in resolve.type_ancestors(s, slot.range or s.default_range) if t in s.types)]:
        if p:
            add("pattern", ~c.cast("string").rlike(java_pattern(p)), f"{slot.name} does not match {p}", context={"pattern": p})
    bounds = [(slot.minimum_value, slot.maximum_value), *((s.types[t].minimum_value, s.types[t].maximum_value) for t in resolve.type_ancestors(s, slot.range or "") if t in s.types)]
    for low, high in bounds:
        v = comparable(c, kind, of)
        beyond = ([v < bound(low, kind, of)] if low is not None else []) + ([v > bound(high, kind, of)] if high is not None else [])
        if beyond:
            add("range", any_of(beyond), F.concat(F.lit(f"{slot.name} is out of range: "), c.cast("string")), context={"minimum": str(low), "maximum": str(high)})
    if slot.min_length is not None or slot.max_length is not None:
        n = F.length(c.cast("string"))
        add("length", any_of(([n < slot.min_length] if slot.min_length is not None else []) + ([n > slot.max_length] if slot.max_length is not None else [])), f"{slot.name} is too short or too long")
    if slot.equals_string_in:
        add("equals_string_in", ~c.cast("string").isin(slot.equals_string_in), f"{slot.name} is not one of the texts that it may equal")
    if sp := slot.structured_pattern:
        add("structured_pattern", ~structured_match(c.cast("string"), sp, compiler), f"{slot.name} does not match {sp.syntax}")
    for name, code in (("any_of", "ANY_OF_CONSTRAINT_FAILED"), ("all_of", "ALL_OF_CONSTRAINT_FAILED"), ("exactly_one_of", "EXACTLY_ONE_OF_CONSTRAINT_FAILED"), ("none_of", "NONE_OF_CONSTRAINT_FAILED")):
        if branches := getattr(slot, name):
            holds, n = combined(s, c, kind, name, branches, compiler)
            add(code, ~holds, F.concat(F.lit(f"{slot.name}: "), n.cast("string"), F.lit(f" of {len(branches)} alternatives of {name} hold")))
    return out


def structured_match(c: Column, sp, compiler: Compiler) -> Column:
    """Whether a text matches; ``{name}`` in an interpolated pattern stands for the record's value."""
    if not sp.interpolated:
        return c.rlike(full_pattern(sp.syntax, sp.kind, sp.partial_match))
    parts = re.split(r"\{([A-Za-z_][\w.]*)\}", sp.syntax)
    pieces = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            pieces.append(F.lit(full_pattern(p, sp.kind, True).removeprefix("^").removesuffix("$") if sp.kind == "glob" else java_pattern(p)))
        else:
            pieces.append(F.concat(F.lit(r"\Q"), compiler.name(p).column.cast("string"), F.lit(r"\E")))
    whole = F.concat(*pieces)
    return F.rlike(c, whole if sp.partial_match and sp.kind == "regex" else F.concat(F.lit("^(?:"), whole, F.lit(")$")))


def detected_format(slot: Slot) -> str | None:
    """The known format that a slot's name or range suggests."""
    words = (slot.range or "").lower(), slot.name.lower()
    for name in ("email", "uuid", "datetime", "date", "url"):
        if words[0] == name or name in words[1] or (name == "url" and ("uri" in words[0] or "uri" in words[1])):
            return name
    return None


# -- conditions among slots ------------------------------------------------------------------------


def if_required(s: Schema, trigger: str, rule: IfRequired, compiler: Compiler) -> list[Check]:
    t = compiler.name(trigger)
    e = rule.condition
    cond = satisfied(s, t.column, t.kind, e, compiler) & (t.column.isNotNull() if e.required is not False else F.lit(True))
    return [Check(x, "conditional_required", cond & compiler.name(x).column.isNull(), f"{x} is required because of {trigger}") for x in rule.then_required]


def condition(spec: dict, compiler: Compiler) -> Column:
    """A condition as a mapping: its one key is the operator."""
    (op, arg), *_ = spec.items()
    if op in ("and", "or"):
        parts = [condition(x, compiler) for x in arg]
        return all_of(parts) if op == "and" else any_of(parts)
    if op == "not":
        return ~condition(arg, compiler)
    if op == "expression":
        return truthy(compiler(arg))
    if op in ("present", "absent"):
        c = compiler.name(arg).column
        return c.isNotNull() if op == "present" else c.isNull()
    name, value = arg
    c = compiler.name(name).column
    made = {
        "equals": lambda: c.eqNullSafe(F.lit(value)), "not_equals": lambda: ~c.eqNullSafe(F.lit(value)),
        "in": lambda: c.isin(value), "not_in": lambda: c.isNull() | ~c.isin(value),
        "matches": lambda: c.cast("string").rlike(java_pattern(value)),
        "greater_than": lambda: c > value, "less_than": lambda: c < value,
    }
    return F.coalesce(made[op](), F.lit(False))


def requirement(spec: dict, compiler: Compiler) -> tuple[str, Column]:
    """The slot that a requirement is about and whether it is violated."""
    (op, arg), *_ = spec.items()
    if op == "expression":
        return "", ~truthy(compiler(arg))
    name = arg if isinstance(arg, str) else arg[0]
    c = compiler.name(name).column
    return name, {"required": lambda: c.isNull(), "forbidden": lambda: c.isNotNull(), "must_equal": lambda: ~c.eqNullSafe(F.lit(arg[1])), "must_match": lambda: ~F.coalesce(c.cast("string").rlike(java_pattern(arg[1])), F.lit(False))}[op]()


def conditional_checks(spec: dict, compiler: Compiler) -> list[Check]:
    """{if: condition, then: [requirement], else: [requirement]}."""
    holds, out = condition(spec["if"], compiler), []
    for part, when in (("then", holds), ("else", ~holds)):
        for r in spec.get(part, []):
            name, violated = requirement(r, compiler)
            out.append(Check(name, f"conditional_{part}", when & violated, spec.get("message", f"{name} does not meet what the condition asks")))
    return out


def depends_on(slot: Slot, compiler: Compiler) -> list[Check]:
    """The annotation ``depends_on``: the slot may be given only if another has a value (``a=b``)."""
    spec = slot.annotations.get("depends_on")
    if not spec:
        return []
    other, _, value = str(spec).partition("=")
    o = compiler.name(other.strip()).column
    met = o.cast("string") == value.strip() if value else o.isNotNull()
    return [Check(slot.name, "dependency", compiler.name(slot.name).column.isNotNull() & ~F.coalesce(met, F.lit(False)), f"{slot.name} depends on {spec}")]


# -- packs of rules, custom checks, values from tables -------------------------------------------


def domain_pack(name: str, compiler: Compiler) -> list[Check]:
    """Rules for classes of some names; they hold where the record has the slots that they read."""
    have = set(compiler.record.fieldNames())
    c = lambda x: F.col(x)
    rules = {
        "Publication": [("publication_date", {"status", "publication_date"}, lambda: (c("status") == "published") & c("publication_date").isNull(), "a published work has a publication date")],
        "Person": [("age", {"age"}, lambda: (c("age") < 0) | (c("age") > 150), "an age is from 0 to 150"), ("email", {"email"}, lambda: ~c("email").rlike(FORMATS["email"]), "an email address has a name and a host")],
        "Organization": [("founded_date", {"founded_date"}, lambda: c("founded_date").cast("string") > F.current_date().cast("string"), "an organization is not founded in the future")],
        "Event": [],
    }
    out = [Check(slot, "domain_rule", F.coalesce(v(), F.lit(False)), message) for slot, needs, v, message in rules.get(name, []) if needs <= have]
    if {"start_date", "end_date"} <= have:
        out.append(Check("end_date", "domain_rule", F.coalesce(c("end_date").cast("string") < c("start_date").cast("string"), F.lit(False)), "it ends before it starts"))
    return out


@dataclass
class Custom:
    """A check by the user: a function from a slot's column to whether it is violated; a Pandas UDF
    where no column function will do."""

    name: str
    violated: Callable[[Column], Column]
    message: str
    slots: list[str] | None = None
    ranges: list[str] | None = None
    applies: Callable[[Slot], bool] | None = None

    def concerns(self, slot: Slot) -> bool:
        if self.applies:
            return self.applies(slot)
        return (self.slots is None or slot.name in self.slots) and (self.ranges is None or slot.range in self.ranges)


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and its values, from a table of permitted ones."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(F.col(value).cast("string"))).alias("values"))


def not_permitted(df: DataFrame, column: str, permitted: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not in a table of permitted ones; Spark chooses the join by size."""
    return df.filter(F.col(column).isNotNull()).join(permitted.select(F.col(value).alias("__permitted")).distinct(), F.col(column) == F.col("__permitted"), "left_anti")


def default_value(slot: Slot, cls: str, compiler: Compiler) -> Column | None:
    """What ``ifabsent`` stands for, or NULL."""
    spec = slot.ifabsent
    if spec is None:
        return None
    m = re.fullmatch(r"(\w+)(?:\((.*)\))?", spec.strip(), re.S)
    kind, arg = (m[1], m[2]) if m else ("string", spec)
    made = {
        "slot_name": lambda: F.lit(slot.name), "class_name": lambda: F.lit(cls), "class_slot_curie": lambda: F.lit(f"{cls}:{slot.name}"),
        "bnode": lambda: F.concat(F.lit("_:b"), F.expr("uuid()")), "string": lambda: F.lit(arg), "int": lambda: F.lit(int(arg)), "integer": lambda: F.lit(int(arg)), "float": lambda: F.lit(float(arg)),
        "boolean": lambda: F.lit(str(arg).lower() == "true"), "date": lambda: F.lit(arg).cast("date") if arg else F.current_date(), "datetime": lambda: F.lit(arg).cast("timestamp") if arg else F.current_timestamp(),
        "expression": lambda: compiler(arg).column, "default_value": lambda: F.lit(arg),
    }
    return made[kind.lower()]() if kind.lower() in made else F.lit(spec)


def masked(c: Column, keep: int = 4) -> Column:
    """Letters and digits as x and 0, but for the last few."""
    n = F.greatest(F.length(c) - keep, F.lit(0))
    return F.concat(F.regexp_replace(F.regexp_replace(F.substr(c, F.lit(1), n), r"\p{L}", "x"), r"\d", "0"), F.substr(c, n + 1))


#: What text meant as a query for another system may hold.
SUSPICIOUS = (
    r"(?i)\bunion\b.+\bselect\b", r"(?i)\binsert\s+into\b", r"(?i)\bdelete\s+from\b", r"(?i)\bupdate\b.+\bset\b", r"(?i)\bdrop\s+(table|database|schema)\b", r"(?i);\s*(drop|delete|update|insert)\b",
    r"(?i)\bor\b\s+'?\d+'?\s*=\s*'?\d+'?", r"--\s*$", r"/\*.*\*/", r"(?i)<script\b", r"\$\{.*\}", r"(?i)__schema\b",
)


def suspicious(c: Column) -> Column:
    """Whether a text looks like an injected query or script."""
    return any_of([c.rlike(p) for p in SUSPICIOUS])
