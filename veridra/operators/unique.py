"""Unique keys: within a table, against a table, and on a stream of rows in order.

All keys of a class are checked in one shuffle: each row becomes one entry per key, and entries are
counted with map-side aggregation before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.functions.expressions import any_of
from veridra.plans import resolve
from veridra.plans.model import Schema, UniqueKey


def keys_of(s: Schema, cls: str) -> list[UniqueKey]:
    """The class's identifier as a key, and its unique keys with those that it inherits."""
    out = {}
    if identifier := resolve.identifier_slot(s, cls):
        out["identifier"] = UniqueKey("identifier", [identifier], primary=True)
    for c in reversed(resolve.ancestors(s, cls)):
        out |= s.classes[c].unique_keys
    return list(out.values())


def primary_key(s: Schema, cls: str) -> list[str]:
    """The slots of the first primary key, or of the identifier."""
    keys = keys_of(s, cls)
    return next((k.unique_key_slots for k in keys if k.primary), [])


def _present(columns: list[str], nulls_equal: bool) -> Column:
    """Keys with a NULL part are no duplicates unless NULLs are equal."""
    return F.lit(True) if nulls_equal else ~any_of([F.col(f"`{c}`").isNull() for c in columns])


def duplicates(df: DataFrame, columns: list[str], nulls_equal: bool = False) -> DataFrame:
    """The values of a key that occur more than once, and how often."""
    return df.filter(_present(columns, nulls_equal)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_report(df: DataFrame, keys: list[UniqueKey]) -> DataFrame:
    """key, values (as JSON) and n for the duplicates of all keys, in one shuffle."""
    entries = F.array(*[F.when(_present(k.unique_key_slots, k.nulls_equal), F.struct(F.lit(k.name).alias("key"), F.to_json(F.struct(*k.unique_key_slots), {"ignoreNullFields": "false"}).alias("values"))) for k in keys])
    return df.select(F.explode(F.array_compact(entries)).alias("e")).groupBy("e.key", "e.values").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def later_occurrences(df: DataFrame, columns: list[str], order: list[Column | str], nulls_equal: bool = False) -> DataFrame:
    """The rows whose key a row before them has, by an explicit order.

    Keys that occur once are sorted out first, by counts with map-side aggregation, so that only true
    duplicates are ranked.
    """
    return _ranked(df, columns, order, nulls_equal, lambda rank: rank > 1)


def _ranked(df: DataFrame, columns: list[str], order: list[Column | str], nulls_equal: bool, wanted: Callable[[Column], Column]) -> DataFrame:
    """The rows of keys that occur more than once whose rank among their key's is wanted."""
    n = duplicates(df, columns, nulls_equal).drop("n")
    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in columns]
    found = df.alias("a").join(n.alias("b"), same, "left_semi")
    name = "__rank"
    while name in df.columns:
        name = f"_{name}"
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in columns]).orderBy(*order))
    return found.withColumn(name, rank).filter(wanted(F.col(name))).drop(name)


def already_known(new: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """New rows whose key a known row has."""
    return new.join(known.select(*columns), columns, "left_semi")


def drop_later(df: DataFrame, columns: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; rows with a NULL part stay. Only keys that occur more than once are
    ranked, so neither the others nor rows without a key meet in a task."""
    n = duplicates(df, columns).drop("n")
    same = [F.col(f"a.`{c}`") == F.col(f"b.`{c}`") for c in columns]
    alone = df.alias("a").join(n.alias("b"), same, "left_anti")
    return alone.unionByName(_ranked(df, columns, order, False, lambda rank: rank == 1))
