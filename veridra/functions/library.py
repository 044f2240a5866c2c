"""Functions of the expression language, each a function from columns to a column.

Errors are NULL: a zero divisor, the root of a negative number, a text that is no date. Arrays are
Spark arrays; numbers are doubles unless said otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats that ``date_parse`` tries in turn, as the language names them.
DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y")
#: The directives of these formats as Spark spells them.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%I": "hh", "%p": "a", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%"}


class Typed:
    """A column with its static type (None where it isn't known)."""

    def __init__(self, column: Column, kind: T.DataType | None = None, value: object = None):
        self.column, self.kind, self.value = column, kind, value

    def is_a(self, *kinds: type) -> bool:
        return isinstance(self.kind, kinds)


def java_format(text: str) -> str:
    """A strftime format in Spark's letters; other letters are quoted."""
    out, i = "", 0
    while i < len(text):
        if text[i : i + 2] in DIRECTIVES:
            out += DIRECTIVES[text[i : i + 2]]
            i += 2
        else:
            out += f"'{text[i]}'" if text[i].isalpha() else "''" if text[i] == "'" else text[i]
            i += 1
    return out


def truthy(x: Typed) -> Column:
    """Null, 0, the empty text and empty arrays, maps and records are false."""
    c = x.column
    if x.is_a(T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if x.is_a(T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if x.is_a(T.ArrayType, T.MapType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if x.is_a(T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def number(x: Typed) -> Column:
    return x.column if x.is_a(T.NumericType) else x.column.try_cast("double")


def whole(x: Typed) -> Column:
    return F.lit(int(x.value)) if isinstance(x.value, int | float) else x.column.try_cast("int")


def text(x: Typed) -> Column:
    return x.column if x.is_a(T.StringType) else x.column.cast("string")


# -- scalars -------------------------------------------------------------------------------------


def length(x: Typed) -> Column:
    if x.is_a(T.ArrayType, T.MapType):
        return F.coalesce(F.size(x.column), F.lit(0)).cast("long")
    return F.coalesce(F.octet_length(text(x)), F.lit(0)).cast("long")


def case(*args: Typed) -> Column:
    if len(args) < 3 or len(args) % 2 == 0:
        raise ValueError("case takes pairs of a condition and a value, and a default")
    out = args[-1].column
    for condition, value in reversed(list(zip(args[:-1:2], args[1:-1:2], strict=True))):
        out = F.when(truthy(condition), value.column).otherwise(out)
    return out


def contains(where: Typed, what: Typed) -> Column:
    if where.is_a(T.ArrayType):
        return F.array_contains(where.column, what.column)
    if where.is_a(T.MapType):
        return F.map_contains_key(where.column, what.column)
    return where.column.contains(what.column)


def trim(x: Typed) -> Column:
    return F.regexp_replace(text(x), r"(?U)^\s+|\s+$", "")


def split(x: Typed, at: Typed) -> Column:
    return F.split(text(x), F.concat(F.lit(r"\Q"), text(at), F.lit(r"\E")))


def join(x: Typed, by: Typed) -> Column:
    """NULL if an element is, since only texts can be joined."""
    return F.when(F.forall(x.column, lambda e: e.isNotNull()), F.array_join(x.column.cast("array<string>"), by.value if isinstance(by.value, str) else "")) if isinstance(by.value, str) else F.when(F.forall(x.column, lambda e: e.isNotNull()), F.concat_ws("", F.transform(x.column.cast("array<string>"), lambda e, i: F.concat(F.when(i > 0, text(by)).otherwise(""), e))))


def substring(x: Typed, start: Typed, n: Typed | None = None) -> Column:
    """Counts from 0, in characters."""
    at = whole(start) + 1
    return F.substr(text(x), at, whole(n)) if n else F.substr(text(x), at)


def date_parse(x: Typed, form: Typed | None = None) -> Column:
    forms = [form.value] if form else DATE_FORMATS
    return F.date_format(F.coalesce(*[F.try_to_date(text(x), java_format(f)) for f in forms]), "yyyy-MM-dd")


def _date(x: Typed) -> Column:
    return x.column if x.is_a(T.DateType) else x.column.cast("date") if x.is_a(T.TimestampType, T.TimestampNTZType) else F.coalesce(F.try_to_date(text(x), "yyyy-MM-dd"), F.try_to_timestamp(text(x)).cast("date"))


def _moment(x: Typed) -> Column:
    return x.column.cast("timestamp") if x.is_a(T.DateType, T.TimestampType, T.TimestampNTZType) else F.try_to_timestamp(text(x))


def _has_time(x: Typed) -> bool | None:
    """Whether it is a moment rather than a day; None if only its value tells."""
    return False if x.is_a(T.DateType) else True if x.is_a(T.TimestampType, T.TimestampNTZType) else None


def date_format(x: Typed, form: Typed) -> Column:
    return F.date_format(_moment(x), java_format(form.value))


def months_later(day: Column, months: Column) -> Column:
    """The same day of the month so many months on; the day itself where that month has no such day."""
    moved = F.add_months(day, months)
    return F.when(F.dayofmonth(moved) == F.dayofmonth(day), moved).otherwise(day)


def date_add(x: Typed, n: Typed, unit: Typed) -> Column:
    steps, name = whole(n), unit.value
    if name in ("months", "years"):
        return F.date_format(months_later(_date(x), steps * (12 if name == "years" else 1)), "yyyy-MM-dd")
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800}[name]
    if name in ("days", "weeks"):
        day = F.date_format(F.date_add(_date(x), steps * (seconds // 86_400)), "yyyy-MM-dd")
    else:
        day = F.lit(None).cast("string")
    moved = F.date_format(_moment(x) + F.make_dt_interval(secs=(steps * seconds).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss")
    timed = _has_time(x)
    if timed is None:
        return F.when(F.length(text(x)) > 10, moved).otherwise(day)
    return moved if timed else day


def date_diff(a: Typed, b: Typed, unit: Typed) -> Column:
    """From a to b, truncated."""
    name = unit.value
    if name in ("days", "weeks") and _has_time(a) is False and _has_time(b) is False:
        return F.floor(F.abs(F.datediff(_date(b), _date(a))) / (7 if name == "weeks" else 1)) * F.signum(F.datediff(_date(b), _date(a)).cast("double")).cast("long")
    return F.timestamp_diff({"days": "DAY", "weeks": "WEEK", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND"}[name], _moment(a), _moment(b))


def log(x: Typed, base: Typed | None = None) -> Column:
    v = number(x)
    if base is None:
        return F.when(v > 0, F.ln(v))
    b = number(base)
    return F.when((v > 0) & (b > 0) & (b != 1), F.ln(v) / F.ln(b))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != math.inf), c)


def round_(x: Typed, places: Typed | None = None) -> Column:
    return F.round(number(x).cast("double"), int(places.value) if places else 0)


# -- arrays: an aggregate inside a row -------------------------------------------------------------


def _numbers(x: Typed) -> Column:
    return x.column.cast("array<double>")


def array_sum(x: Typed) -> Column:
    """0 for an empty array, NULL if an element is."""
    return F.aggregate(_numbers(x), F.lit(0.0), lambda a, e: a + e)


def array_avg(x: Typed) -> Column:
    return F.when(F.size(x.column) > 0, array_sum(x) / F.size(x.column))


def array_count(x: Typed, which: Typed | None = None) -> Column:
    kind = which.value if which else None
    if kind == "non-null":
        return F.size(F.filter(x.column, lambda e: e.isNotNull())).cast("long")
    if kind == "non-empty":
        empty = (lambda e: F.size(e) == 0) if x.kind and isinstance(x.kind.elementType, T.ArrayType | T.MapType) else (lambda e: e.cast("string") == "")
        return F.size(F.filter(x.column, lambda e: e.isNotNull() & ~empty(e))).cast("long")
    if which is not None:
        return F.size(F.filter(x.column, lambda e: e.eqNullSafe(which.column))).cast("long")
    return F.size(x.column).cast("long")


def array_median(x: Typed) -> Column:
    s, n = F.array_sort(_numbers(x)), F.size(x.column)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def array_modes(x: Typed) -> Column:
    """All most frequent elements, least first."""
    counted = F.transform(F.array_distinct(x.column), lambda e: F.struct(F.size(F.filter(x.column, lambda y: y.eqNullSafe(e))).alias("n"), e.alias("e")))
    most = F.array_max(F.transform(counted, lambda p: p["n"]))
    return F.array_sort(F.transform(F.filter(counted, lambda p: p["n"] == most), lambda p: p["e"]))


def array_mode(x: Typed) -> Column:
    return F.get(array_modes(x), F.lit(0))


def array_variance(x: Typed) -> Column:
    mean = array_avg(x)
    return F.when(F.size(x.column) > 1, F.aggregate(_numbers(x), F.lit(0.0), lambda a, e: a + (e - mean) * (e - mean)) / (F.size(x.column) - 1))


def array_stddev(x: Typed) -> Column:
    return F.sqrt(array_variance(x))


def array_group(x: Typed, key: Typed) -> Column:
    """A map from the JSON text of a field to the elements that have it."""
    of = lambda e: F.coalesce(F.to_json(F.struct(e[key.value].alias("k"))), F.lit("null"))
    json_of = lambda e: F.coalesce(F.nullif(F.regexp_extract(of(e), r'^\{"k":(.*)\}$', 1), F.lit("")), F.lit("null"))
    keys = F.array_distinct(F.transform(x.column, json_of))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(x.column, lambda e: json_of(e) == k)))


DOUBLE, LONG, STRING, BOOLEAN = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def _math(f: Callable[[Column], Column]) -> Callable[[Typed], Column]:
    return lambda x: f(number(x).cast("double"))


def _element(x: Typed, *_: Typed) -> T.DataType | None:
    return x.kind.elementType if x.is_a(T.ArrayType) else None


#: name: (least arguments, most, function, type of the result or a function from arguments to it).
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column], object]] = {
    "len": (1, 1, length, LONG),
    "max": (1, 99, lambda *a: F.greatest(*map(number, a)) if len(a) > 1 else number(a[0]), DOUBLE),
    "min": (1, 99, lambda *a: F.least(*map(number, a)) if len(a) > 1 else number(a[0]), DOUBLE),
    "case": (3, 99, case, lambda *a: a[1].kind),
    "matches": (2, 2, lambda s, p: text(s).rlike(p.value) if isinstance(p.value, str) else F.rlike(text(s), text(p)), BOOLEAN),
    "contains": (2, 2, contains, BOOLEAN),
    "upper": (1, 1, lambda x: F.upper(text(x)), STRING),
    "lower": (1, 1, lambda x: F.lower(text(x)), STRING),
    "trim": (1, 1, trim, STRING),
    "starts_with": (2, 2, lambda x, p: F.startswith(text(x), text(p)), BOOLEAN),
    "ends_with": (2, 2, lambda x, p: F.endswith(text(x), text(p)), BOOLEAN),
    "replace": (3, 3, lambda x, a, b: F.replace(text(x), text(a), text(b)), STRING),
    "split": (2, 2, split, T.ArrayType(STRING)),
    "join": (2, 2, join, STRING),
    "substring": (2, 3, substring, STRING),
    "date_parse": (1, 2, date_parse, STRING),
    "date_format": (2, 2, date_format, STRING),
    "date_add": (3, 3, date_add, STRING),
    "date_diff": (3, 3, date_diff, LONG),
    "year": (1, 1, lambda x: F.year(_date(x)).cast("long"), LONG),
    "month": (1, 1, lambda x: F.month(_date(x)).cast("long"), LONG),
    "day": (1, 1, lambda x: F.dayofmonth(_date(x)).cast("long"), LONG),
    "now": (0, 0, lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), STRING),
    "today": (0, 0, lambda: F.date_format(F.current_date(), "yyyy-MM-dd"), STRING),
    "abs": (1, 1, _math(F.abs), DOUBLE),
    "sqrt": (1, 1, _math(lambda c: F.when(c >= 0, F.sqrt(c))), DOUBLE),
    "pow": (2, 2, lambda x, y: finite(F.pow(number(x).cast("double"), number(y).cast("double"))), DOUBLE),
    "sin": (1, 1, _math(F.sin), DOUBLE),
    "cos": (1, 1, _math(F.cos), DOUBLE),
    "tan": (1, 1, _math(F.tan), DOUBLE),
    "log": (1, 2, log, DOUBLE),
    "exp": (1, 1, _math(lambda c: finite(F.exp(c))), DOUBLE),
    "floor": (1, 1, _math(lambda c: F.floor(c).cast("long")), LONG),
    "ceil": (1, 1, _math(lambda c: F.ceil(c).cast("long")), LONG),
    "round": (1, 2, round_, DOUBLE),
    "mod": (2, 2, lambda x, y: F.try_mod(number(x).cast("double"), number(y).cast("double")), DOUBLE),
    "sum": (1, 1, array_sum, DOUBLE),
    "avg": (1, 1, array_avg, DOUBLE),
    "count": (1, 2, array_count, LONG),
    "median": (1, 1, array_median, DOUBLE),
    "mode": (1, 1, array_mode, _element),
    "modes": (1, 1, array_modes, lambda x: x.kind),
    "stddev": (1, 1, array_stddev, DOUBLE),
    "variance": (1, 1, array_variance, DOUBLE),
    "unique": (1, 1, lambda x: F.array_distinct(x.column), lambda x: x.kind),
    "group_by": (2, 2, array_group, lambda x, _: T.MapType(STRING, x.kind) if x.kind else None),
}


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
