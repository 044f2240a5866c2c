import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veridra.functions.expressions import Binary, Call, ExpressionError, If, Literal, Name, Unary, evaluate, names, parse, show, where


def value(spark, expression, **context):
    df = spark.createDataFrame([tuple(context.values())], list(context)) if context else spark.range(1).select()
    return evaluate(df, {"out": expression}).first()["out"]


CASES = [
    ("substring(t, 6)", {"t": "Hello World"}, "World"), ("substring(t, 0, 5)", {"t": "Hello World"}, "Hello"), ('join(w, "-")', {"w": ["Hello", "World"]}, "Hello-World"),
    ('date_parse("15/01/2024", "%d/%m/%Y")', {}, "2024-01-15"), ('date_parse("2024/02/30")', {}, None), ('date_add(d, 10, "days")', {"d": "2024-01-15"}, "2024-01-25"),
    ('date_add(d, 1, "months")', {"d": "2024-01-31"}, "2024-01-31"), ('date_add(d, 1, "years")', {"d": "2024-02-28"}, "2025-02-28"), ('date_add(d, 2, "hours")', {"d": "2024-01-15T23:00:00Z"}, "2024-01-16T01:00:00"),
    ("round(3.14159, 2)", {}, 3.14), ("round(-2.5)", {}, -3.0), ("mod(10, 3)", {}, 1.0), ("mod(-10, 3)", {}, -1.0), ("mod(1, 0)", {}, None), ("1 / 0", {}, None), ("7 % 4 * 2", {}, 6.0),
    ("sum(n)", {"n": [1, 2, 3, 4, 5]}, 15.0), ("avg(n)", {"n": [1, 2, 3, 4, 5]}, 3.0), ("count(n)", {"n": [1, 2, 3]}, 3), ("median(n)", {"n": [4, 1, 3, 2]}, 2.5), ("mode(n)", {"n": [1, 2, 2, 3, 2, 4]}, 2), ("modes(n)", {"n": [2, 1, 2, 1]}, [1, 2]),
    ('count(n, "non-null")', {"n": [1, None, 3, None, 5]}, 3), ("stddev(n)", {"n": [1]}, None), ("variance(n)", {"n": [1, 3]}, 2.0), ("unique(n)", {"n": [3, 1, 3]}, [3, 1]),
    ("len(t)", {"t": "é"}, 2), ('trim(t)', {"t": "  x \t"}, "x"), ('split(t, ".")', {"t": "a.b."}, ["a", "b", ""]), ("sqrt(-1)", {}, None), ("log(8, 2)", {}, 3.0), ("log(0)", {}, None), ("floor(-1.5)", {}, -2),
    ("null == null", {}, True), ('1 == "1"', {}, False), ("5 == 5.0", {}, True), ('"a" + 1', {}, "a1"), ('not "" and 1', {}, True), ("missing == null", {}, True), ("if 0 then 1 else 2", {}, 2), ("1 if 2 > 1 else 3", {}, 1), ("n[0]" and "contains(n, 2)", {"n": [1, 2]}, True),
    ('case(false, 1, 0, 2, 3)', {}, 3), ('date_diff("2024-01-01", "2024-01-15", "weeks")', {}, 2), ('matches("abc", "^a.c$")', {}, True), ("2 + 3 * 4 - -1", {}, 15.0),
]


@pytest.mark.parametrize("expression,context,expected", CASES)
def test_values(spark, expression, context, expected):
    got = value(spark, expression, **context)
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_errors():
    for bad in ("1 +", "(1", "f(", "1 2", "@", "unknown(1)", "len()", "x" * 10_001, "(" * 120 + "1" + ")" * 120):
        with pytest.raises(ExpressionError):
            tree = parse(bad)
            from pyspark.sql.types import StructType

            from veridra.functions.expressions import Compiler

            Compiler(StructType())(tree)


leaf = st.one_of(st.integers(0, 99).map(Literal), st.sampled_from(["a", "b.c"]).map(Name), st.text("xy\"\\\n", max_size=4).map(Literal), st.sampled_from([True, False, None]).map(Literal))
trees = st.recursive(leaf, lambda t: st.one_of(st.builds(Binary, st.sampled_from(["or", "and", "==", "<", "+", "-", "*", "/", "%"]), t, t), st.builds(Unary, st.sampled_from(["not", "-"]), t), st.builds(If, t, t, t), st.builds(lambda a: Call("max", (a,)), t)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_shown_text_parses_to_the_same_tree(tree):
    assert parse(show(tree)) == tree


def test_names_and_where(spark):
    assert names(parse("{a.b} + len(c) > 1 ? d : e")) == {"a.b", "c", "d", "e"}
    rows = [(i, random.Random(i).random()) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, x double")
    assert {r.i for r in where(df, "x * 2 > 1 and i % 2 == 0").collect()} == {i for i, x in rows if x * 2 > 1 and i % 2 == 0}
