"""Arrays of any number of dimensions: a flat ``data`` column and a ``shape``, as column functions.

Row-major order unless said otherwise. Shapes are Python sequences where they are static.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridra.functions.expressions import all_of


def shape_issues(shape: Column, wanted: Sequence[tuple[int | None, int | None]]) -> Column:
    """Whether a shape has another number of dimensions, or one out of its bounds (least, most)."""
    within = [((F.get(shape, F.lit(i)) >= low) if low is not None else F.lit(True)) & ((F.get(shape, F.lit(i)) <= high) if high is not None else F.lit(True)) for i, (low, high) in enumerate(wanted)]
    return ~((F.size(shape) == len(wanted)) & F.coalesce(all_of(within), F.lit(False)))


def size_fits(data: Column, shape: Column) -> Column:
    return F.size(data) == F.aggregate(shape, F.lit(1), lambda a, n: a * n.cast("int"))


def strides(shape: Sequence[int], column_major: bool = False) -> list[int]:
    out, step = [], 1
    for n in shape if column_major else reversed(shape):
        out.append(step)
        step *= n
    return out if column_major else out[::-1]


def flat_index(at: Sequence[Column | int], shape: Sequence[int], column_major: bool = False) -> Column:
    """The place of an index, NULL if it is out of bounds."""
    at = [F.lit(x) if isinstance(x, int) else x for x in at]
    inside = all_of([(x >= 0) & (x < n) for x, n in zip(at, shape, strict=True)])
    return F.when(inside, sum((x * s for x, s in zip(at, strides(shape, column_major), strict=True)), F.lit(0)))


def index_of(flat: Column, shape: Sequence[int], column_major: bool = False) -> Column:
    """The index of a place, as an array."""
    return F.array(*[F.floor(flat / s).cast("int") % n for s, n in zip(strides(shape, column_major), shape, strict=True)])


def get(data: Column, at: Sequence[Column | int], shape: Sequence[int], column_major: bool = False) -> Column:
    return F.get(data, flat_index(at, shape, column_major))


def put(data: Column, at: Sequence[Column | int], shape: Sequence[int], value: Column) -> Column:
    place = flat_index(at, shape)
    return F.transform(data, lambda x, i: F.when(i == place, value).otherwise(x))


def take_slice(data: Column, shape: Sequence[int], axis: int, at: int) -> Column:
    """The elements with index ``at`` on one axis; that dimension is dropped."""
    step = strides(shape)[axis]
    return F.filter(data, lambda _, i: F.floor(i / step).cast("int") % shape[axis] == at)


def reshape(data: Column, shape: Sequence[int], new: Sequence[int]) -> Column:
    if math.prod(shape) != math.prod(new):
        raise ValueError(f"{list(shape)} has not as many elements as {list(new)}")
    return data


def transpose(data: Column, shape: Sequence[int], axes: Sequence[int] | None = None) -> Column:
    """Axes in another order, reversed by default."""
    axes = list(axes) if axes is not None else list(range(len(shape)))[::-1]
    new, old = [shape[a] for a in axes], strides(shape)
    places = F.sequence(F.lit(0), F.lit(math.prod(shape) - 1))
    source = lambda i: sum((F.floor(i / s).cast("int") % n * old[a] for s, n, a in zip(strides(new), new, axes, strict=True)), F.lit(0))
    return F.transform(places, lambda i: F.get(data, source(i)))


def filled(shape: Sequence[int], value: Column) -> Column:
    return F.array_repeat(value, math.prod(shape))


def with_indices(data: Column, shape: Sequence[int], keep: Callable[[Column], Column]) -> Column:
    """index and value of the elements that are kept."""
    return F.filter(F.transform(data, lambda x, i: F.struct(index_of(i, shape).alias("index"), x.alias("value"))), lambda p: keep(p["value"]))


def elementwise(a: Column, b: Column, op: str) -> Column:
    """Two arrays of a size; a division by zero leaves the left element."""
    f = {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: F.when(y == 0, x).otherwise(F.try_divide(x, y))}[op]
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def add_scalar(a: Column, x: float) -> Column:
    return F.transform(a, lambda e: e + x)


def multiply_scalar(a: Column, x: float) -> Column:
    return F.transform(a, lambda e: e * x)


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    """The sum, without what is no number."""
    return F.aggregate(_doubles(a), F.lit(0.0), lambda s, e: s + F.coalesce(e, F.lit(0.0)))


def mean(a: Column) -> Column:
    """The sum over the number of all elements."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def _no_nan(a: Column) -> Column:
    return F.filter(_doubles(a), lambda e: e.isNotNull() & ~F.isnan(e))


def least(a: Column) -> Column:
    return F.array_min(_no_nan(a))


def most(a: Column) -> Column:
    return F.array_max(_no_nan(a))


def std_dev(a: Column) -> Column:
    """Of a sample; NULL for fewer than two."""
    m = mean(a)
    return F.when(F.size(a) > 1, F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, e: s + (e - m) * (e - m)) / (F.size(a) - 1)))


def sort(a: Column, ascending: bool = True) -> Column:
    """NULLs are first in rising order, last in falling."""
    return F.sort_array(a, ascending)


def sort_axis(data: Column, shape: Sequence[int], axis: int, ascending: bool = True) -> Column:
    """A matrix with its rows (axis 1) or columns (axis 0) sorted."""
    rows, columns = shape
    if axis == 1:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.sort_array(F.slice(data, r * columns + 1, columns), ascending)))
    return transpose(sort_axis(transpose(data, shape), (columns, rows), 1, ascending), (columns, rows))


def find(a: Column, wanted: Callable[[Column], Column]) -> Column:
    """The places of the elements that are wanted."""
    return F.filter(F.transform(a, lambda e, i: F.when(wanted(e), i)), lambda i: i.isNotNull())


def array_issues(data: Column, *, minimum: float | None = None, maximum: float | None = None, pattern: str | None = None, unique: bool = False, missing: float | None = None) -> Column:
    """place and code of each bad element; the missing value is exempt, NULL is an element too."""
    exempt = (lambda e: e.eqNullSafe(F.lit(missing))) if missing is not None else (lambda e: F.lit(False))
    codes = lambda e, i: F.array(
        F.when(e.isNull() & ~exempt(e), F.lit("missing")),
        F.when(~exempt(e) & (e < minimum), F.lit("minimum")) if minimum is not None else F.lit(None).cast("string"),
        F.when(~exempt(e) & (e > maximum), F.lit("maximum")) if maximum is not None else F.lit(None).cast("string"),
        F.when(~exempt(e) & ~e.cast("string").rlike(pattern), F.lit("pattern")) if pattern else F.lit(None).cast("string"),
        F.when(F.array_position(data, e) <= i, F.lit("unique")) if unique else F.lit(None).cast("string"),
    )
    return F.flatten(F.transform(data, lambda e, i: F.transform(F.array_compact(codes(e, i)), lambda c: F.struct(i.alias("place"), c.alias("code")))))
