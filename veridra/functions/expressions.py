"""The expression language: text to a tree, and a tree to a column.

From weak to strong: ``value if condition else other`` is spelt ``condition ? value : other`` or
``if condition then value else other``; then or, and, comparisons, + and -, * / %, and the unary
operators. Names are bare or in braces and may have dots. Nothing is evaluated here; Catalyst folds
constants and shares common parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.functions.library import BOOLEAN, DOUBLE, FUNCTIONS, STRING, Typed, all_of, any_of, number, text, truthy

MAX_DEPTH, MAX_LENGTH = 100, 10_000

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<braced>\{[^{}]*\})|(?P<name>[A-Za-z_][\w.]*)|(?P<op>==|!=|<=|>=|&&|\|\||[-+*/%<>!(),?:])|(?P<end>$)|(?P<bad>.))""", re.S)


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    path: str


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class If:
    condition: object
    then: object
    other: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


#: Binary operators by strength, weakest first.
LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))


class _Parser:
    def __init__(self, source: str):
        if len(source) > MAX_LENGTH:
            raise ExpressionError(f"an expression has at most {MAX_LENGTH} characters")
        self.tokens, self.at, self.depth, pos = [], 0, 0, 0
        while True:
            m = _TOKEN.match(source, pos)
            pos, kind = m.end(), m.lastgroup
            if kind == "bad":
                raise ExpressionError(f"{m['bad']!r} at {m.start('bad')} is not expected")
            value = m[kind]
            self.tokens.append((kind, {"&&": "and", "||": "or", "!": "not"}.get(value, value) if kind == "op" else value))
            if kind == "end":
                return

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if value in values and kind in ("op", "name"):
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ExpressionError(f"{value!r} is missing before {self.tokens[self.at][1] or 'the end'!r}")

    def whole(self):
        tree = self.conditional()
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"{self.tokens[self.at][1]!r} is not expected")
        return tree

    def conditional(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ExpressionError(f"an expression is at most {MAX_DEPTH} levels deep")
        if self.take("if"):
            condition = self.conditional()
            self.need("then")
            then = self.conditional()
            self.need("else")
            tree = If(condition, then, self.conditional())
        else:
            tree = self.level(0)
            if self.take("?"):
                then = self.conditional()
                self.need(":")
                tree = If(tree, then, self.conditional())
            elif self.take("if"):
                condition = self.level(0)
                self.need("else")
                tree = If(condition, tree, self.conditional())
        self.depth -= 1
        return tree

    def level(self, n: int):
        if n == len(LEVELS):
            return self.unary()
        tree = self.level(n + 1)
        while op := self.take(*LEVELS[n]):
            tree = Binary(op, tree, self.level(n + 1))
        return tree

    def unary(self):
        if op := self.take("not", "-"):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise ExpressionError(f"an expression is at most {MAX_DEPTH} levels deep")
            tree = Unary(op, self.unary())
            self.depth -= 1
            return tree
        return self.primary()

    def primary(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Literal(float(value) if "." in value else int(value))
        if kind == "string":
            return Literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1]))
        if kind == "braced":
            return Name(value[1:-1].strip())
        if kind == "name":
            if value in ("true", "false", "null"):
                return Literal({"true": True, "false": False, "null": None}[value])
            if not self.take("("):
                return Name(value)
            args = []
            if not self.take(")"):
                args.append(self.conditional())
                while self.take(","):
                    args.append(self.conditional())
                self.need(")")
            return Call(value, tuple(args))
        if (kind, value) == ("op", "("):
            tree = self.conditional()
            self.need(")")
            return tree
        raise ExpressionError(f"{value or 'the end'!r} is not expected")


def parse(source: str):
    """The tree of an expression."""
    return _Parser(source).whole()


def show(tree, above: int = -1) -> str:
    """Text that parses to the same tree."""
    if isinstance(tree, Literal):
        if isinstance(tree.value, str):
            return '"' + tree.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
        return {True: "true", False: "false", None: "null"}[tree.value] if tree.value is None or isinstance(tree.value, bool) else repr(tree.value)
    if isinstance(tree, Name):
        return "{" + tree.path + "}"
    if isinstance(tree, Call):
        return f"{tree.name}({', '.join(map(show, tree.args))})"
    if isinstance(tree, Unary):
        return f"{'not ' if tree.op == 'not' else '-'}{show(tree.of, len(LEVELS))}"
    if isinstance(tree, If):
        out = f"if {show(tree.condition)} then {show(tree.then)} else {show(tree.other)}"
        return f"({out})" if above >= 0 else out
    mine = next(i for i, ops in enumerate(LEVELS) if tree.op in ops)
    out = f"{show(tree.left, mine)} {tree.op} {show(tree.right, mine + 1)}"
    return f"({out})" if mine < above else out


def names(tree) -> set[str]:
    """The names that an expression reads."""
    if isinstance(tree, Name):
        return {tree.path}
    parts = {Unary: lambda t: (t.of,), Binary: lambda t: (t.left, t.right), If: lambda t: (t.condition, t.then, t.other), Call: lambda t: t.args}.get(type(tree), lambda t: ())(tree)
    return set().union(*map(names, parts)) if parts else set()


Custom = dict[str, tuple[int, int, Callable[..., Column], object]]


class Compiler:
    """Trees to typed columns over a record type. Names that the record lacks are NULL."""

    def __init__(self, record: T.StructType, custom: Custom | None = None, given: dict[str, Typed] | None = None):
        self.record, self.functions, self.given = record, {**FUNCTIONS, **(custom or {})}, given or {}

    def name(self, path: str) -> Typed:
        if path in self.given:
            return self.given[path]
        if path in self.record.fieldNames():
            return Typed(F.col(f"`{path}`"), self.record[path].dataType)
        head, *rest = path.split(".")
        at = self.given.get(head) or (Typed(F.col(f"`{head}`"), self.record[head].dataType) if head in self.record.fieldNames() else None)
        for part in rest:
            if at is None or not (at.is_a(T.StructType) and part in at.kind.fieldNames() or at.is_a(T.MapType)):
                return Typed(F.lit(None), T.NullType())
            at = Typed(at.column[part], at.kind[part].dataType if at.is_a(T.StructType) else at.kind.valueType)
        return at or Typed(F.lit(None), T.NullType())

    def __call__(self, tree) -> Typed:
        if isinstance(tree, str):
            tree = parse(tree)
        if isinstance(tree, Literal):
            kind = {bool: BOOLEAN, int: T.LongType(), float: DOUBLE, str: STRING}.get(type(tree.value), T.NullType())
            return Typed(F.lit(tree.value), kind, tree.value)
        if isinstance(tree, Name):
            return self.name(tree.path)
        if isinstance(tree, Unary):
            of = self(tree.of)
            return Typed(~truthy(of), BOOLEAN) if tree.op == "not" else Typed(-number(of), of.kind if of.is_a(T.NumericType) else DOUBLE, -of.value if isinstance(of.value, int | float) and not isinstance(of.value, bool) else None)
        if isinstance(tree, If):
            then, other = self(tree.then), self(tree.other)
            return Typed(F.when(truthy(self(tree.condition)), then.column).otherwise(other.column), other.kind if then.is_a(T.NullType) else then.kind)
        if isinstance(tree, Call):
            return self.call(tree)
        return self.binary(tree.op, self(tree.left), self(tree.right))

    def call(self, tree: Call) -> Typed:
        if tree.name not in self.functions:
            raise ExpressionError(f"there is no function {tree.name}")
        least, most, f, kind = self.functions[tree.name]
        if not least <= len(tree.args) <= most:
            raise ExpressionError(f"{tree.name} takes {least} to {most} arguments, not {len(tree.args)}")
        args = [self(a) for a in tree.args]
        return Typed(f(*args), kind(*args) if callable(kind) else kind)

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("and", "or"):
            return Typed(truthy(a) & truthy(b) if op == "and" else truthy(a) | truthy(b), BOOLEAN)
        if op in ("==", "!="):
            same = self.equal(a, b)
            return Typed(same if op == "==" else ~same, BOOLEAN)
        if op in ("<", ">", "<=", ">="):
            x, y = (text(a), text(b)) if a.is_a(T.StringType) and b.is_a(T.StringType) else (a.column, b.column) if type(a.kind) is type(b.kind) else (number(a), number(b))
            return Typed({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], BOOLEAN)
        if op == "+" and (a.is_a(T.StringType) or b.is_a(T.StringType)):
            return Typed(F.concat(text(a), text(b)), STRING)
        x, y = number(a).cast("double"), number(b).cast("double")
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y)}[op](), DOUBLE)

    def equal(self, a: Typed, b: Typed) -> Column:
        """Null equals null; numbers are compared as doubles; different types never are equal, and
        arrays and records not even to themselves."""
        if a.is_a(T.NullType) or b.is_a(T.NullType):
            return (b if a.is_a(T.NullType) else a).column.isNull() if a.is_a(T.NullType) != b.is_a(T.NullType) else F.lit(True)
        if a.is_a(T.NumericType) and b.is_a(T.NumericType):
            return a.column.cast("double").eqNullSafe(b.column.cast("double"))
        if a.is_a(T.ArrayType, T.MapType, T.StructType) or type(a.kind) is not type(b.kind):
            return a.column.isNull() & b.column.isNull()
        return a.column.eqNullSafe(b.column)


def evaluate(df: DataFrame, expressions: dict[str, str], custom: Custom | None = None) -> DataFrame:
    """``df`` with a column for each expression; all are computed in one pass."""
    compiler = Compiler(df.schema, custom)
    return df.withColumns({name: compiler(source).column for name, source in expressions.items()})


def where(df: DataFrame, source: str, custom: Custom | None = None) -> DataFrame:
    """The rows for which the expression is true."""
    return df.filter(truthy(Compiler(df.schema, custom)(source)))


__all__ = ["Compiler", "ExpressionError", "all_of", "any_of", "evaluate", "names", "parse", "show", "where"]
