import pytest

from veridra.operators import checks, references, rules, unique
from veridra.plans import ddl, engine, model, resolve

PERSON = model.loads("""
name: people
id: urn:people
description: people
version: "1"
prefixes: {ex: "http://example.org/", long: "http://example.org/long/"}
enums: {Status: {permissible_values: {ACTIVE: {}, INACTIVE: {}}}}
types: {Percent: {base_type: float, minimum_value: 0, maximum_value: 100}}
classes:
  Named: {abstract: true, attributes: {id: {identifier: true}, name: {required: true}}}
  Tagged: {attributes: {tags: {multivalued: true, unique: true, minimum_cardinality: 1, maximum_cardinality: 2, pattern: "^[a-z]+$"}}}
  Person:
    is_a: Named
    mixins: [Tagged]
    slot_usage: {name: {min_length: 2}}
    attributes:
      age: {range: integer, minimum_value: 0, maximum_value: 150}
      email: {pattern: '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$'}
      status: {range: Status}
      share: {range: Percent}
      guardian: {}
      born: {range: date}
    unique_keys: {mail: [email]}
    if_required: {guardian: {condition: {pattern: "^G"}, then_required: [born]}}
    rules:
      - {title: minors, priority: 100, preconditions: {slot_conditions: {age: {maximum_value: 17}}}, postconditions: {slot_conditions: {guardian: {required: true}}}, elseconditions: {expression_conditions: ["{guardian} == null"]}}
""")
FIELDS = "id string, name string, age int, email string, status string, share double, guardian string, born string, tags array<string>"
GOOD = ("1", "John", 30, "j@x.org", "ACTIVE", 5.0, None, "2024-02-29", ["a"])


def codes(spark, row, schema=PERSON, options=None, fields=FIELDS):
    df = spark.createDataFrame([row], fields)
    return {(r.path, r.code) for r in engine.check_frame(df, schema, "Person", options).violations(df, ["id"]).collect()}


@pytest.mark.parametrize("change,expected", [
    ({}, set()), ({1: None}, {("$.name", "required")}), ({1: "J"}, {("$.name", "length")}), ({2: 151}, {("$.age", "range")}), ({3: "no"}, {("$.email", "pattern")}), ({4: "X"}, {("$.status", "enum")}),
    ({5: 101.0}, {("$.share", "range")}), ({7: "2024-02-30"}, {("$.born", "type")}), ({8: ["a", "a"]}, {("$.tags", "unique_elements")}), ({8: ["a", "B"]}, {("$.tags[1]", "pattern")}), ({8: []}, {("$.tags", "cardinality")}), ({8: ["a", "b", "c"]}, {("$.tags", "cardinality")}),
    ({2: 10}, {("$.guardian", "RULE_REQUIRED")}), ({6: "Mary"}, {("$", "RULE_EXPRESSION")}), ({2: 10, 6: "Gil", 7: None}, {("$.born", "conditional_required")}), ({0: None}, {("$.id", "required")}),
])
def test_one_violation_each(spark, change, expected):
    assert codes(spark, tuple(change.get(i, v) for i, v in enumerate(GOOD))) == expected


def test_types_from_text(spark):
    s = model.schema({"classes": {"Person": {"attributes": {k: {"range": v} for k, v in {"i": "integer", "f": "float", "b": "boolean", "d": "date", "t": "time", "n": "ncname", "u": "uri"}.items()}}}})
    df = spark.createDataFrame([("a", "5", "1.5", "true", "2024-01-01", "23:59:59", "x_1", "http://a/b"), ("b", "abc", "x", "yes", "not-a-date", "25:00:00", "a:b", "nothing")], "id string, i string, f string, b string, d string, t string, n string, u string")
    got = engine.check_frame(df, s, "Person", engine.Options(ignore=("id",))).violations(df, ["id"]).collect()
    assert {(r.id, r.path, r.code) for r in got} == {("b", f"$.{c}", "type") for c in "ifbdtnu"}


def test_unknown_slots_defaults_custom_and_limits(spark):
    df = spark.createDataFrame([("1", "x", None)], "id string, extra string, name string")
    s = model.schema({"classes": {"Person": {"attributes": {"id": {}, "name": {"ifabsent": "string(none)", "required": True}}}}})
    report = {(r.slot, r.severity) for r in engine.check_frame(df, s, "Person").report(df).collect()}
    assert report == {("extra", "warning"), ("name", "error")}
    s.allow_additional_properties = False
    plan = engine.check_frame(df, s, "Person", engine.Options(apply_defaults=True, custom=[checks.Custom("long", lambda c: c != "longer", "is not longer", slots=["name"])], fail_fast=True))
    assert [r.code for r in plan.violations(df, ["id"]).collect()] == ["unknown_slot"]
    assert plan.annotate(df).first().name == "none"
    assert engine.check_frame(df, s, "Person").summary(df).first().asDict() == {"total": 1, "valid": 0, "invalid": 1, "errors": 2, "warnings": 0}


def test_nested_records_and_empty_tables(spark):
    s = model.schema({"classes": {"Person": {"attributes": {"id": {}, "home": {"range": "Address"}}}, "Address": {"attributes": {"zip": {"pattern": "^[0-9]+$", "required": True}}}}})
    df = spark.createDataFrame([("1", ("x",)), ("2", (None,)), ("3", None)], "id string, home struct<zip:string>")
    assert {(r.id, r.path, r.code) for r in engine.check_frame(df, s, "Person").violations(df, ["id"]).collect()} == {("1", "$.home.zip", "pattern"), ("2", "$.home.zip", "required")}
    assert engine.check_frame(df, s, "Person").violations(df.limit(0), ["id"]).count() == 0
    assert engine.check_frame(df, s, "Person").report(df.limit(0)).count() == 0


def test_combinators_conditions_dependencies(spark):
    df = spark.createDataFrame([(1, "a", None), (5, "b", "z"), (9, None, "z")], "n int, t string, o string")
    c = checks.Compiler(df.schema)
    spec = {"if": {"or": [{"equals": ["t", "a"]}, {"not": {"present": "t"}}]}, "then": [{"required": "o"}, {"must_match": ["o", "^q"]}], "else": [{"forbidden": "o"}]}
    flags = df.select("n", *[x.violated.alias(f"{i}") for i, x in enumerate(checks.conditional_checks(spec, c))]).collect()
    assert [tuple(r) for r in flags] == [(1, True, True, False), (5, False, False, True), (9, False, True, False)]
    branches = [model.expr({"minimum_value": 5}), model.expr({"maximum_value": 5})]
    got = df.select(*[checks.combined(PERSON, df.n, df.schema["n"].dataType, k, branches, c)[0].alias(k) for k in ("any_of", "all_of", "exactly_one_of", "none_of")]).collect()
    assert [tuple(r) for r in got] == [(True, False, True, False), (True, True, False, False), (True, False, True, False)]


def test_patterns_and_captures(spark):
    assert checks.group_names(r"(?:x)(?P<a_b>\d)\((y)(?P<c>z)[(]") == {"a_b": 1, "c": 3}
    df = spark.createDataFrame([("k1-7",), ("none",)], "s string")
    assert [r[0] for r in df.select(checks.capture_map(df.s, r"(?P<key>k\d)-(?P<n_1>\d)")).collect()] == [{"key": "k1", "n_1": "7"}, None]
    assert checks.full_pattern("a.b*?", "glob", False) == r"^a\.b.*.$"
    assert checks.detected_format(model.Slot("contact_email")) == "email"


def test_rules_are_ordered_and_overridden(spark):
    s = model.schema({"classes": {"A": {"rules": [{"title": "x", "priority": 5}, {"title": "y", "priority": 20}]}, "B": {"is_a": "A", "rules": [{"title": "x", "priority": 1}, {"title": "z", "priority": 12}]}}})
    assert [(r.title, r.priority) for r in rules.effective_rules(s, "B")] == [("z", 12), ("y", 10), ("x", 1)]
    assert [r.title for r in rules.effective_rules(s, "B", {"z": {"deactivated": True}})] == ["y", "x"]


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "b", 1), (5, None, 1)], "i int, k string, v int")
    assert [tuple(r) for r in unique.duplicates(df, ["k", "v"]).collect()] == [("b", 1, 2)]
    assert {tuple(r) for r in unique.duplicates(df, ["k", "v"], nulls_equal=True).collect()} == {("a", None, 2), ("b", 1, 2)}
    assert {r.i for r in unique.later_occurrences(df, ["k"], ["i"]).collect()} == {2, 4}
    assert {r.i for r in unique.drop_later(df, ["k"], ["i"]).collect()} == {1, 3, 5}
    assert {r.key for r in unique.key_report(df, [model.UniqueKey("k", ["k"]), model.UniqueKey("i", ["i"])]).collect()} == {"k"}
    assert unique.primary_key(PERSON, "Person") == ["id"]


def test_references(spark):
    child = spark.createDataFrame([(1, 10), (2, 99), (3, None), (4, 4)], "id int, fk int")
    parent = spark.createDataFrame([(10, "x"), (10, "y"), (4, "z")], "pk int, t string")
    assert [r.id for r in references.orphans(child, "fk", parent, "pk").collect()] == [2]
    assert [r.id for r in references.self_references(child, "id", "fk").collect()] == [4]
    cycle = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "child int, parent int")
    assert {(r.child, r.circular) for r in references.too_deep(cycle, 10).collect()} == {(1, True), (2, True)}


def test_resolution():
    assert list(resolve.induced_slots(PERSON, "Person"))[:3] == ["id", "name", "tags"]
    assert resolve.linearised(PERSON, "Person") == ["Person", "Named", "Tagged"]
    assert resolve.contract(PERSON, "http://example.org/long/x") == "long:x" and resolve.expand(PERSON, "ex:y") == "http://example.org/y"
    assert resolve.class_for(PERSON, ["age", "email"]) == "Person" and resolve.lint(PERSON)
    with pytest.raises(resolve.SchemaError):
        resolve.ancestors(model.schema({"classes": {"A": {"is_a": "B"}, "B": {"is_a": "A"}}}), "A")
    assert "CHECK (age >= 0 AND age <= 150)" in ddl.create_tables(PERSON)
    assert ddl.json_schema(PERSON, "Person")["$defs"]["Person"]["required"] == ["id", "name"]
    assert resolve.statistics(PERSON)["max_depth"] == 1
