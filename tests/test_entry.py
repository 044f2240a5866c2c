"""The registry with and without the training-data operators, and plans that run in steps."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from veridra.operators import profile, references, unique
from veridra.plans import engine, model, resolve
from veridra.sources import readers

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(k.startswith('op') for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [("veridra/llm",), ("veridra/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    for name in ("veridra", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    for name in gone:
        target = tmp_path / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    there = (tmp_path / "veridra/llm").is_dir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 100 and int(out[1]) > 100 and (int(out[2]) == 10) == there and out[3] == "False"


def test_lists_of_records_are_checked_by_their_class(spark):
    s = model.schema({"classes": {"Inner": {"attributes": {"a": {"range": "integer", "required": True}, "b": {"range": "integer", "maximum_value": 5, "equals_expression": "a + 1"}}}, "Outer": {"attributes": {"members": {"range": "Inner", "multivalued": True, "inlined": True}, "one": {"range": "Inner", "inlined": True}}}}})
    kind = "members array<struct<a:long,b:long>>, one struct<a:long,b:long>"
    df = spark.createDataFrame([([(1, 2), (None, 9), None], (None, 9)), ([], None), (None, (1, 2))], kind)
    plan = engine.check_frame(df, s, "Outer")
    found = [sorted((i.path, i.code) for i in r.issues) for r in plan.annotate(df).collect()]
    inner = [(".a", "required"), (".b", "equals_expression"), (".b", "range")]
    assert found == [sorted([(f"$.members[1]{p}", c) for p, c in inner] + [(f"$.one{p}", c) for p, c in inner]), [], []]
    assert plan.summary(df).first().asDict() == {"total": 3, "valid": 2, "invalid": 1, "errors": 6, "warnings": 0} and plan.valid(df).count() == 2


def test_chains_of_a_hundred_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(103)] + [(500, 501), (501, 500)], "child long, parent long")
    found = {(r.child, r.ancestor): r.depth for r in resolve.closure(edges, 101).filter("child in (0, 500)").collect()}
    assert found == {**{(0, i): i for i in range(1, 102)}, (500, 501): 1, (500, 500): 2}
    deep = {r.child: r.circular for r in references.too_deep(edges).collect()}
    assert deep == {0: False, 1: False, 2: False, 500: True, 501: True}


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (None, "a", 3), (None, "a", 4), (2, None, 5), (3, "c", 6)], "k int, l string, __rank int")
    assert sorted(r["__rank"] for r in unique.drop_later(df, ["k", "l"], ["__rank"]).collect()) == [1, 3, 4, 5, 6]
    assert [r["__rank"] for r in unique.later_occurrences(df, ["k", "l"], ["__rank"]).collect()] == [2]


def test_zero_and_one_are_integers_among_integers(spark):
    assert profile.infer_schema(spark.range(25).toDF("n"), "T").classes["T"].attributes["n"].range == "integer"
    df = spark.createDataFrame([("1", "yes", "0", "1"), ("0", "1", "x", "0.5")], "bits string, flags string, texts string, floats string")
    types = {r.column: r.type for r in profile.columns_profile(df).collect()}
    assert types == {"bits": "boolean", "flags": "boolean", "texts": "string", "floats": "float"}
    assert {profile.common_type(a, b) for a, b in (("bit", "integer"), ("integer", "bit"))} == {"integer"}


def test_cells_with_line_ends_are_an_option(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('id,text\n1,"two\nlines"\n')
    assert [r.text for r in readers.read_csv(spark, path, options=readers.Options(multi_line=True)).collect()] == ["two\nlines"]
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,n\n1,2\n2,x\n3,4\n")
    s = model.schema({"classes": {"Row": {"attributes": {"id": {"range": "integer"}, "n": {"range": "integer"}}}}})
    assert readers.rejected_rows(spark, path, s, readers.Options(cls="Row")) == 1
    assert spark.createDataFrame([(1,)], "x int").select(F.col("x")).count() == 1
