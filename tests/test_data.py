import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridra.operators import arrays, migrate, profile, schema_ops
from veridra.plans import engine, model
from veridra.sources import readers, writers
from veridra.streaming import validate

S = model.schema({"classes": {"Row": {"attributes": {"id": {"range": "integer"}, "name": {}, "ok": {"range": "boolean"}, "tags": {"multivalued": True}}}}})


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,ok,tags\n1," A, ""b""",yes,x;y\n2,,no,z\nthree,C,maybe,\n')
    df = readers.read_csv(spark, str(path), S)
    rows = sorted((tuple(r) for r in df.collect()), key=str)
    assert (1, 'A, "b"', True, ["x", "y"], "Row") in rows and (2, None, False, ["z"], "Row") in rows and len(rows) == 3
    assert readers.read_csv(spark, str(path), S, readers.Options(skip_invalid=True)).count() == 2
    assert readers.read_csv(spark, str(path), S, readers.Options(limit=1)).count() == 1
    writers.write_csv(df, str(tmp_path / "out"), S, "Row")
    again = readers.read(spark, str(tmp_path / "out"), S, kind="csv")
    assert sorted((tuple(r) for r in again.collect()), key=str) == rows


def test_json_xml_yaml_triples(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "x", "tags": ["a"]}, {"id": 2, "@type": "Other"}]))
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path / "a.json"), S, readers.Options(cls="Row")).collect()] == [(1, "x", None, ["a"], "Row")]
    (tmp_path / "a.xml").write_text("<rows><Row><id>1</id><name>x</name><tags>a</tags><tags>b</tags></Row></rows>")
    assert readers.read_xml(spark, str(tmp_path / "a.xml"), S, readers.Options(cls="Row")).first().tags == ["a", "b"]
    (tmp_path / "a.yaml").write_text("- {id: 1, name: x}\n- {id: 2}\n")
    df = readers.read_yaml(spark, str(tmp_path / "a.yaml"), S, readers.Options(cls="Row"))
    assert sorted(r.id for r in df.collect()) == [1, 2]
    assert "name: x" in writers.to_yaml(df)
    (tmp_path / "a.nq").write_text('<http://a> <http://p> "x\\"y"@en <http://g> .\n# no\n_:b <http://p> <http://o> .\n')
    got = readers.skolemised(readers.read_triples(spark, str(tmp_path / "a.nq")), "urn:b:")
    assert {(r.o, r.language, r.graph) for r in got.collect()} == {('x"y', "en", "http://g"), ("http://o", None, None)}
    writers.write_xml(df, str(tmp_path / "x"), "Row")
    writers.write_json(df, str(tmp_path / "j"), "Row")
    assert readers.read(spark, str(tmp_path / "j"), kind="jsonl").count() == 2


def test_tables(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 40_000).alias("ts"))
    writers.write_table(df, str(tmp_path / "t"), day_of="ts", sort=["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    writers.save_bucketed(df, "bucketed_rows", "k", 4)
    joined = spark.table("bucketed_rows").hint("merge").join(spark.table("bucketed_rows").select("k").distinct(), "k")
    assert joined.count() == 20


def test_inference(spark):
    df = spark.createDataFrame([(str(i), "a@b.org", "red" if i % 2 else "blue", 1.5 * i, [(i, "x")]) for i in range(2, 12)], "n string, mail string, color string, x double, items array<struct<id:int,label:string>>")
    s = profile.infer_schema(df, "Thing")
    a = s.classes["Thing"].attributes
    assert (a["n"].range, a["mail"].range, a["x"].range, a["items"].range, a["items"].multivalued) == ("integer", "string", "float", "Item", True)
    assert s.enums["Thing_color_enum"].values == ["blue", "red"]
    assert engine.check_frame(df, s, "Thing").violations(df, ["n"]).count() == 0
    assert profile.delimiter(["a;b;c", "1;2,5;3"]) == ";" and profile.singular("boxes") == "boxe" and profile.singular("cities") == "city"
    assert profile.column_names(["a b", "", "a b"]) == ["a_b", "column_2", "a_b_2"]
    assert profile.has_header(["id", "name"], ["1", "Alice"]) and not profile.has_header(["1", "x"], ["2", "y"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["1", "0", "2", "1.5", "2024-01-01", "2024-01-01T00:00:00", "x", "", "true"]), min_size=1, max_size=6))
def test_types_do_not_depend_on_order(values):
    kinds = {"": "unknown", "1": "boolean", "0": "boolean", "true": "boolean", "2": "integer", "1.5": "float", "2024-01-01": "date", "2024-01-01T00:00:00": "datetime", "x": "string"}
    from functools import reduce

    folds = {reduce(profile.common_type, [kinds[v] for v in random.Random(i).sample(values, len(values))], "unknown") for i in range(5)}
    assert len(folds) == 1 or "string" in folds


def test_arrays(spark):
    df = spark.createDataFrame([([float(i) for i in range(6)],)], "x array<double>")
    x, shape = F.col("x"), (2, 3)
    one = df.select(arrays.get(x, (1, 2), shape).alias("a"), arrays.get(x, (1, 3), shape).alias("b"), arrays.transpose(x, shape).alias("t"), arrays.take_slice(x, shape, 1, 0).alias("s"), arrays.sort_axis(F.reverse(x), shape, 0).alias("o"), arrays.elementwise(x, arrays.filled(shape, F.lit(0.0)), "divide").alias("d"), arrays.put(x, (0, 1), shape, F.lit(9.0)).alias("p"), arrays.shape_issues(F.array(F.lit(2), F.lit(3)), [(1, 2), (None, 2)]).alias("i")).first()
    assert (one.a, one.b, one.t, one.s) == (5.0, None, [0.0, 3.0, 1.0, 4.0, 2.0, 5.0], [0.0, 3.0])
    assert (one.o, one.d, one.p[1], one.i) == ([2.0, 1.0, 0.0, 5.0, 4.0, 3.0], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], 9.0, True)
    bad = spark.createDataFrame([([1.0, None, 7.0, 1.0],)], "x array<double>").select(arrays.array_issues(F.col("x"), maximum=5, unique=True).alias("i")).first().i
    assert {(r.place, r.code) for r in bad} == {(1, "missing"), (2, "maximum"), (3, "unique")}


def test_migration_and_algebra(spark):
    old = model.schema({"classes": {"P": {"attributes": {"id": {}, "age": {}, "gone": {}}}}})
    new = model.schema({"classes": {"P": {"attributes": {"id": {}, "years": {"range": "integer"}, "kind": {"ifabsent": "person"}}}}})
    plan = migrate.plan(old, new, "P", {"age": "years"})
    out = plan.run(spark.createDataFrame([("a", "7", "x")], "id string, age string, gone string")).first().asDict()
    assert out == {"id": "a", "years": 7.0, "kind": "person"} and plan.risk == "medium"
    df = spark.createDataFrame([([(" A ", 1)],)], "r array<struct<n:string,i:int>>")
    assert migrate.lower(migrate.trimmed(df, "r.n"), "r.n").first().r[0].n == "a"
    assert migrate.rename(df, {"r.n": "r.name"}).schema["r"].dataType.elementType.fieldNames() == ["name", "i"]
    assert {(c.kind, c.name) for c in schema_ops.diff(old, new)} == {("removed", "P.age"), ("removed", "P.gone"), ("added", "P.years"), ("added", "P.kind")}
    assert schema_ops.patch(old, schema_ops.patch_between(old, new)).to_dict() == new.to_dict()
    assert list(schema_ops.merge(old, new).classes["P"].attributes) == ["id", "years", "kind", "age", "gone"] or set(schema_ops.merge(old, new).classes["P"].attributes) == {"id", "years", "kind", "age", "gone"}
    assert schema_ops.renames(old, model.schema({"classes": {"Q": {"attributes": {"id": {}, "age": {}, "gone": {}}}}}))[0].detail == "Q"


def test_stream(spark, tmp_path):
    s = model.schema({"classes": {"E": {"attributes": {"k": {"range": "integer", "maximum_value": 5}, "ts": {"range": "datetime"}}}}})
    spark.range(10).select(F.col("id").alias("k"), F.timestamp_seconds(1_000_000 + F.col("id") * 600).alias("ts")).unionAll(spark.range(1).select(F.lit(1).cast("long"), F.timestamp_seconds(F.lit(1_000_700)))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("bad", validate.violations(stream, s, "E", ["k"])), ("first", validate.first_of_each(stream, ["k"], "ts", "1 hour"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("bad").count() == 4 and spark.table("first").count() == 10
    validate.issue_counts(stream, s, "E", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "counts")).trigger(availableNow=True).start().awaitTermination()
    assert sum(r.n for r in spark.table("counts").collect()) == 4


@pytest.mark.parametrize("name", ["a.ttl", "b.TRIG", "c.rdf"])
def test_rdf_formats_that_are_not_read_are_an_error(spark, tmp_path, name):
    (tmp_path / name).write_text("@prefix x: <http://x/> .\nx:a x:b x:c , x:d .\n")
    with pytest.raises(ValueError, match="not supported"):
        readers.read_triples(spark, str(tmp_path))


def test_cells_of_vectors_are_those_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from veridra.plans import queries

    ties = [0.31949999928474426, -0.13349999487400055, -0.27649998664855957, 0.0005, -0.0, 2147483.0]
    rows = [(1, ties), (2, [1.5, None, 2.0]), (3, [None, None]), (4, []), (5, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = sorted(tuple(r) for r in queries.d_cells(spark, str(tmp_path)).collect())
    assert found == sorted(con.execute(queries.SQL["d_cells"]).fetchall())
    assert found == [(1, "320;-134;-277;1;0;2147483008"), (2, "1500;2000"), (3, None), (4, ""), (5, None)]
