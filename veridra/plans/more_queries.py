"""More registered queries, one or a few operators each; see ``queries``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.operators import arrays, checks, migrate, profile, references, rules, schema_ops, tables, unique
from veridra.plans import ddl, engine, model, resolve
from veridra.plans.queries import LINE_ITEM, _compiler, _events, _matrix, expressions, table
from veridra.sources import readers, writers
from veridra.streaming import validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _found(df: DataFrame, attributes: dict, keys: list[str], code: str, more: dict | None = None, options: engine.Options | None = None) -> DataFrame:
    """The keys of the records that have an issue of a code, under a class of these attributes."""
    s = model.schema({"classes": {"Row": {"attributes": attributes, **(more or {})}}})
    o = options or engine.Options()
    o.ignore = tuple(df.columns)
    return engine.check_frame(df, s, "Row", o).violations(df, keys).filter(F.col("code") == code).select(*keys)


# -- checks of records --------------------------------------------------------------------------------

_ORDERS = model.schema({
    "enums": {"Flag": {"permissible_values": ["A", "R"]}},
    "classes": {
        "Line": {
            "attributes": {"l_linenumber": {"range": "integer", "required": True, "maximum_value": 6}, "l_quantity": {"range": "float", "maximum_value": 40}, "l_returnflag": {"range": "Flag"}, "l_tax": {"range": "float"}, "l_comment": {"required": True}},
            "rules": [{"title": "taxed", "preconditions": {"slot_conditions": {"l_returnflag": {"equals_string": "A"}}}, "postconditions": {"slot_conditions": {"l_tax": {"maximum_value": 0.05}}}}],
            "if_required": {"l_returnflag": {"condition": {"equals_string": "R"}, "then_required": ["l_note"]}},
        },
        "Order": {"attributes": {"l_orderkey": {"range": "integer"}, "lines": {"range": "Line", "multivalued": True, "inlined": True, "maximum_cardinality": 6}}},
    },
})


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS q, l_returnflag AS f, l_tax AS t FROM lineitem)
    SELECT l_orderkey, path, code, count(*) AS n FROM (
        SELECT l_orderkey, '$.lines[].l_linenumber' AS path, 'range' AS code FROM l WHERE n > 6
        UNION ALL SELECT l_orderkey, '$.lines[].l_quantity', 'range' FROM l WHERE q > 40
        UNION ALL SELECT l_orderkey, '$.lines[].l_returnflag', 'enum' FROM l WHERE f NOT IN ('A', 'R')
        UNION ALL SELECT l_orderkey, '$.lines[].l_tax', 'RULE_MAXIMUM' FROM l WHERE f = 'A' AND t > 0.05
        UNION ALL SELECT l_orderkey, '$.lines[].l_note', 'conditional_required' FROM l WHERE f = 'R'
        UNION ALL SELECT l_orderkey, '$.lines[].l_comment', 'required' FROM l
        UNION ALL SELECT l_orderkey, '$.lines', 'cardinality' FROM l GROUP BY l_orderkey HAVING count(*) > 6) GROUP BY ALL""")
def v_nested_list(spark, sf_dir):
    """Orders with their lines as a list of records: slots, rules and conditions of every line."""
    lines = F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_tax"))
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    found = engine.check_frame(df, _ORDERS, "Order").violations(df, ["l_orderkey"])
    return found.groupBy("l_orderkey", F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"), "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def v_nested_record(spark, sf_dir):
    """A record inside a record, checked by its class."""
    s = model.schema({"classes": {"Size": {"attributes": {"p_size": {"range": "integer", "maximum_value": 25}}}, "Part": {"attributes": {"p_partkey": {"range": "integer"}, "size": {"range": "Size", "inlined": True}}}}})
    df = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_size").alias("size"))
    return engine.check_frame(df, s, "Part").violations(df, ["p_partkey"]).filter("path = '$.size.p_size'").select("p_partkey")


@query("SELECT c_custkey, 'missing' AS why FROM customer UNION ALL SELECT c_custkey, 'null' FROM customer WHERE c_acctbal < 0")
def v_required_slots(spark, sf_dir):
    """A required slot that the records lack, and one that some leave NULL."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    s = model.schema({"classes": {"Row": {"attributes": {"c_custkey": {"range": "integer"}, "balance": {"range": "float", "required": True}, "email": {"required": True}}}}})
    found = engine.check_frame(df, s, "Row").violations(df, ["c_custkey"])
    return found.select("c_custkey", F.when(F.col("path") == "$.email", "missing").otherwise("null").alias("why"))


@query("""SELECT o_custkey, code FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS u FROM orders GROUP BY 1) JOIN (VALUES ('cardinality'), ('unique_elements'), ('cardinality_kind')) AS c(code)
    ON code = 'cardinality' AND (n < 5 OR n > 15) OR code = 'unique_elements' AND u < n OR code = 'cardinality_kind'""")
def v_cardinality(spark, sf_dir):
    """Slots of many values: how many, each once; and many values where one is asked for."""
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("orders"), F.collect_list("o_orderstatus").alias("statuses"), F.collect_list("o_orderstatus").alias("status"))
    s = model.schema({"classes": {"Row": {"attributes": {"o_custkey": {"range": "integer"}, "orders": {"range": "integer", "multivalued": True, "minimum_cardinality": 5, "maximum_cardinality": 15}, "statuses": {"multivalued": True, "unique": True}, "status": {}}}}})
    return engine.check_frame(df, s, "Row").violations(df, ["o_custkey"]).select("o_custkey", "code")


@query("SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY')")
def v_equals_string_in(spark, sf_dir):
    return _found(table(spark, sf_dir, "part"), {"p_type": {"equals_string_in": ["PROMO", "ECONOMY"]}}, ["p_partkey"], "equals_string_in")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <> l_suppkey % 7 + 1")
def v_equals_expression(spark, sf_dir):
    return _found(table(spark, sf_dir, "lineitem"), {"l_linenumber": {"range": "integer", "equals_expression": "{l_suppkey} % 7 + 1"}}, ["l_orderkey", "l_linenumber", "l_partkey"], "equals_expression")


@query("SELECT c_custkey, 'c_mktsegment' AS slot, 'warning' AS severity FROM customer")
def v_unknown_slots(spark, sf_dir):
    """Slots that the class lacks; a warning where the schema admits more."""
    s = model.schema({"allow_additional_properties": True, "classes": {"Row": {"attributes": {"c_custkey": {"range": "integer"}, "c_name": {}, "c_nationkey": {"range": "integer"}, "c_acctbal": {"range": "float"}}}}})
    df = table(spark, sf_dir, "customer")
    found = engine.check_frame(df, s, "Row").violations(df, ["c_custkey"])
    return found.select("c_custkey", F.substring("path", 3, 99).alias("slot"), "severity")


@query("SELECT event_id FROM events WHERE event_type <> 'purchase' AND value <= 300")
def v_dependency(spark, sf_dir):
    """A slot that may be given only where another has a value."""
    return _found(_events(spark, sf_dir), {"event_type": {}, "value": {"range": "float", "annotations": {"depends_on": "event_type=purchase"}}}, ["event_id"], "dependency")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 150 OR c_acctbal < 0")
def v_domain_rules(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("age"))
    s = model.schema({"classes": {"Person": {"attributes": {"c_custkey": {"range": "integer"}, "age": {"range": "float"}}}}})
    return engine.check_frame(df, s, "Person", engine.Options(domain_rules=True)).violations(df, ["c_custkey"]).filter("code = 'domain_rule'").select("c_custkey")


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'conditional_then' ELSE 'conditional_else' END AS code FROM part
    WHERE p_type = 'PROMO' AND p_size <> 7 OR p_type <> 'PROMO' AND NOT regexp_matches(p_brand, '^Brand#1')""")
def v_conditional_requirements(spark, sf_dir):
    """Requirements of a condition, on both of its sides."""
    df = table(spark, sf_dir, "part")
    spec = {"if": {"equals": ["p_type", "PROMO"]}, "then": [{"must_equal": ["p_size", 7]}], "else": [{"must_match": ["p_brand", "^Brand#1"]}]}
    s = model.schema({"classes": {"Row": {"attributes": {"p_partkey": {"range": "integer"}}}}})
    found = engine.check_frame(df, s, "Row", engine.Options(conditionals=[spec], ignore=tuple(df.columns))).violations(df, ["p_partkey"])
    return found.select("p_partkey", "code")


@query("SELECT c_custkey FROM customer WHERE length(c_mktsegment) % 2 = 1")
def v_custom(spark, sf_dir):
    """A check by the user."""
    odd = checks.Custom("odd_length", lambda c: F.length(c) % 2 == 1, "the text has an odd length", slots=["c_mktsegment"])
    return _found(table(spark, sf_dir, "customer"), {"c_mktsegment": {}}, ["c_custkey"], "odd_length", options=engine.Options(custom=[odd]))


@query("SELECT c_custkey, c_custkey % 8 < 5 AS bad FROM customer")
def v_suspicious(spark, sf_dir):
    """Texts that look like injected queries, and some that don't."""
    more = ["x'; drop table t", "1 union all select 2", "insert  into t values (1)", "delete from t", "update t set a = 1", "a union of sets", "please insert a coin", "updates"]
    text = F.concat("c_name", F.lit(" "), F.element_at(F.array(*map(F.lit, more)), (F.col("c_custkey") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", checks.suspicious(text).alias("bad"))


@query("SELECT path, code, n FROM (SELECT '$.l_discount' AS path, 'range' AS code, count(*) AS n FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05 UNION ALL SELECT '$.l_returnflag', 'enum', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') UNION ALL SELECT '$.l_tax', 'range', count(*) FROM lineitem WHERE l_tax > 0.07 UNION ALL SELECT '$.l_quantity', 'range', count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45) ORDER BY n DESC, path LIMIT 2")
def v_most_common(spark, sf_dir):
    """The two most frequent kinds of issues; the bound is the feature."""
    df = table(spark, sf_dir, "lineitem")
    return tables.most_common_issues(engine.check_frame(df, LINE_ITEM, "Line").violations(df, ["l_orderkey"]), 2)


@query("SELECT l_orderkey, l_linenumber, l_partkey, 1 AS n FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05 OR l_returnflag NOT IN ('A', 'R') OR l_tax > 0.07 OR l_quantity < 1 OR l_quantity > 45 OR l_shipdate < TIMESTAMP '1993-01-01' OR l_extendedprice < 0 OR NOT regexp_matches(l_linestatus, '^[OF]$') OR l_linenumber NOT BETWEEN 1 AND 7")
def v_limit(spark, sf_dir):
    """At most one issue for each record, as the option asks."""
    df = table(spark, sf_dir, "lineitem")
    plan = engine.check_frame(df, LINE_ITEM, "Line", engine.Options(max_issues=1))
    return plan.annotate(df).filter(F.size("issues") > 0).select("l_orderkey", "l_linenumber", "l_partkey", F.size("issues").alias("n"))


@query("SELECT c_custkey, 'x' || c_custkey || '@example.org' AS email FROM customer WHERE c_custkey % 3 <> 0")
def v_formats(spark, sf_dir):
    """Texts that have the format that their slot's name tells."""
    mail = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"), F.lit("@example.org"))).otherwise(F.col("c_name"))
    known = checks.FORMATS[checks.detected_format(model.Slot("email"))]
    return table(spark, sf_dir, "customer").select("c_custkey", mail.alias("email")).filter(F.col("email").rlike(known))


@query("SELECT c_custkey, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0")
def v_json_elements(spark, sf_dir):
    """The values of a path through an array of a JSON text."""
    nations = F.to_json(F.struct(F.array(F.struct(F.col("n_name").alias("name"))).alias("nations")))
    df = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select("c_custkey", F.get(readers.at_json_path(nations, "$.nations[*].name"), F.lit(0)).alias("name"))


# -- rules ----------------------------------------------------------------------------------------------

_INHERITED = model.schema({"classes": {
    "Base": {"attributes": {"o_totalprice": {"range": "float"}, "o_orderstatus": {}}, "rules": [{"title": "cheap", "priority": 100, "postconditions": {"slot_conditions": {"o_totalprice": {"maximum_value": 300000}}}}, {"title": "status", "priority": 1, "postconditions": {"slot_conditions": {"o_orderstatus": {"equals_string_in": ["F", "O"]}}}}]},
    "Order": {"is_a": "Base", "rules": [{"title": "status", "priority": 95, "postconditions": {"slot_conditions": {"o_orderstatus": {"equals_string": "F"}}}}]},
}})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'status' WHEN o_totalprice > 250000 THEN 'cheap' END AS first_rule FROM orders")
def r_inherited(spark, sf_dir):
    """Inherited rules cost ten a step, the nearest of one title stays, and overrides replace parts."""
    df = table(spark, sf_dir, "orders")
    lower = {"cheap": {"postconditions": model.Conditions(slot_conditions={"o_totalprice": model.expr({"maximum_value": 250000})})}}
    compiled = rules.compile_rules(_INHERITED, "Order", _compiler(df), lower)
    return df.select("o_orderkey", rules.first_violated(compiled).alias("first_rule"))


# -- functions ------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') AS h, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S') AS m, strftime(o_orderdate + INTERVAL 75 SECOND, '%Y-%m-%dT%H:%M:%S') AS s FROM orders""")
def f_times(spark, sf_dir):
    return expressions(spark, sf_dir, "orders", ["o_orderkey"], h='date_add(o_orderdate, 5, "hours")', m='date_add(o_orderdate, 90, "minutes")', s='date_add(o_orderdate, 75, "seconds")')


@query("SELECT l_orderkey, l_linenumber, l_partkey, date_diff('second', o_orderdate, l_shipdate) // 3600 AS h, date_diff('second', o_orderdate, l_shipdate) // 60 AS m, date_diff('second', o_orderdate, l_shipdate) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate")
def f_time_diff(spark, sf_dir):
    from veridra.functions.expressions import evaluate

    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate >= o_orderdate")
    return evaluate(df, {x: f'date_diff(o_orderdate, l_shipdate, "{u}")' for x, u in (("h", "hours"), ("m", "minutes"), ("s", "seconds"))}).select("l_orderkey", "l_linenumber", "l_partkey", "h", "m", "s")


@query("SELECT r_regionkey, TRUE AS this_day, TRUE AS now_is_today FROM region")
def f_now(spark, sf_dir):
    got = expressions(spark, sf_dir, "region", ["r_regionkey"], d="today()", n="now()")
    return got.select("r_regionkey", (F.col("d") == F.date_format(F.current_date(), "yyyy-MM-dd")).alias("this_day"), F.col("n").startswith(F.date_format(F.current_date(), "yyyy-MM-dd")).alias("now_is_today"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n FROM orders GROUP BY o_custkey")
def a_count_non_empty(spark, sf_dir):
    from veridra.functions.expressions import evaluate

    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")).alias("x"))
    return evaluate(df, {"n": 'count(x, "non-empty")'}).drop("x")


@query("SELECT p_partkey, (p_size + 2) * 3 = p_size * 3 + 6 AS same, '{p_size} + 2 * 3' AS shown FROM part")
def e_display(spark, sf_dir):
    """An expression read, shown as text and read again has the same values."""
    from veridra.functions.expressions import Compiler, parse, show

    df = table(spark, sf_dir, "part")
    tree = parse("(p_size + 2) * 3")
    same = Compiler(df.schema)(parse(show(tree))).column == F.col("p_size") * 3 + 6
    return df.select("p_partkey", same.alias("same"), F.lit(show(parse("p_size+2*3"))).alias("shown"))


# -- keys, references, sets -----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def u_primary(spark, sf_dir):
    """Values of a class's primary key that are not unique."""
    s = model.schema({"classes": {"Line": {"attributes": {"l_orderkey": {}, "l_linenumber": {}}, "unique_keys": {"pk": {"unique_key_slots": ["l_orderkey", "l_linenumber"], "primary": True}}}}})
    return unique.duplicates(table(spark, sf_dir, "lineitem"), unique.primary_key(s, "Line")).drop("n")


@query("SELECT event_type, path, code, n FROM (SELECT event_type, '$.value' AS path, 'conditional_required' AS code, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 300 GROUP BY 1)")
def t_violations(spark, sf_dir):
    """The issues of a stream's records; the same plan on a table."""
    df = _events(spark, sf_dir)
    return validate.violations(df, LINE_ITEM, "Event", ["event_type"]).groupBy("event_type", "path", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 300 THEN 1 ELSE 0 END AS n FROM events")
def t_annotated(spark, sf_dir):
    return validate.annotated(_events(spark, sf_dir), LINE_ITEM, "Event").select("event_id", F.size("issues").alias("n"))


@query("SELECT 'orders' AS \"table\", 'customer_id' AS \"column\", 'customers' AS target")
def j_sheet_relations(spark, sf_dir):
    rows = spark.createDataFrame([("orders", "customer_id"), ("orders", "total"), ("customers", "name"), ("customers", "customer_id")], "table string, column string")
    return references.sheet_relations(rows)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def s_intersect(spark, sf_dir):
    return tables.intersection(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT p_partkey FROM part WHERE p_partkey = p_size")
def j_self_references(spark, sf_dir):
    return references.self_references(table(spark, sf_dir, "part"), "p_partkey", "p_size").select("p_partkey")


# -- profiles -------------------------------------------------------------------------------------------


@query("""SELECT "column", CAST(3 AS BIGINT) AS documents, CAST(sum(rows) AS BIGINT) AS rows, "type" FROM (
    SELECT 'o_custkey' AS "column", count(*) AS rows, 'integer' AS "type" FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_totalprice', count(*), 'float' FROM orders GROUP BY o_orderstatus) GROUP BY 1, 4""")
def p_merged(spark, sf_dir):
    """Profiles of three documents (orders by status) as one."""
    df = table(spark, sf_dir, "orders")
    parts = [profile.columns_profile(df.filter(F.col("o_orderstatus") == x), ["o_custkey", "o_totalprice"]) for x in ("F", "O", "P")]
    return profile.merged_profiles(tables.union(*parts)).select("column", "documents", "rows", "type")


@query("SELECT 'p_partkey' AS \"column\", 1.0 AS confidence UNION ALL SELECT 'p_size', 1.0 UNION ALL SELECT 'p_brand', 0.0")
def p_confidence(spark, sf_dir):
    """The share of a column's values that integers admit."""
    votes = profile.type_votes(table(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_brand"])
    return profile.confidence_of(votes, F.lit("integer"))


@query("SELECT 'Nation' AS class, 'n_name' AS slot, 'Nation_n_name_enum' AS range, TRUE AS required WHERE (SELECT count(DISTINCT n_name) FROM nation) <= 20 UNION ALL SELECT 'Nation', 'n_name', 'string', TRUE WHERE (SELECT count(DISTINCT n_name) FROM nation) > 20 UNION ALL SELECT 'Nation', 'n_nationkey', 'integer', TRUE UNION ALL SELECT 'Nation', 'n_regionkey', 'integer', TRUE")
def p_table_schema(spark, sf_dir):
    """A schema inferred from a table, as rows."""
    s = profile.infer_schema(table(spark, sf_dir, "nation"), "Nation")
    return spark.createDataFrame([(c, k, v.range, v.required) for c, x in s.classes.items() for k, v in x.attributes.items()], "class string, slot string, range string, required boolean")


@query("SELECT * FROM (VALUES ('Order', 'lines', 'Line', TRUE), ('Order', 'o_orderkey', 'integer', FALSE), ('Line', 'l_linenumber', 'integer', FALSE), ('Line', 'l_quantity', 'float', FALSE)) AS t(class, slot, range, multivalued)")
def p_nested_schema(spark, sf_dir):
    """Lists of records become classes of their own."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    s = profile.infer_schema(df, "Order")
    return spark.createDataFrame([(c, k, v.range, v.multivalued) for c, x in s.classes.items() for k, v in x.attributes.items()], "class string, slot string, range string, multivalued boolean")


@query("SELECT 'n_nationkey' AS \"column\", 'TYPE:integer' AS hint UNION ALL SELECT 'n_regionkey', 'TYPE:integer'")
def p_hints(spark, sf_dir):
    return profile.hints(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")).select("column", F.get("hints", F.lit(0)).alias("hint"))


# -- arrays ---------------------------------------------------------------------------------------------

_D = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@query(f"SELECT vec_id, TRUE AS fits, FALSE AS bad_shape, TRUE AS bad_wide, x[20] AS reshaped, 7.0 AS put_value, 64 AS filled_size, [2, 3] AS index_19, list_sum(list_filter(x, lambda e: e > 0)) > 0 AS any_positive, len(list_filter(x, lambda e: e > 0)) AS kept FROM {_D}")
def n_shapes(spark, sf_dir):
    x, shape = F.col("x"), F.array(F.lit(8), F.lit(8))
    kept = arrays.with_indices(x, (8, 8), lambda e: e > 0)
    return _matrix(spark, sf_dir).select(
        "vec_id", arrays.size_fits(x, shape).alias("fits"), arrays.shape_issues(shape, [(8, 8), (1, None)]).alias("bad_shape"), arrays.shape_issues(shape, [(9, None), (None, 8)]).alias("bad_wide"),
        arrays.get(arrays.reshape(x, (8, 8), (4, 16)), (1, 3), (4, 16)).alias("reshaped"), arrays.get(arrays.put(x, (2, 3), (8, 8), F.lit(7.0)), (2, 3), (8, 8)).alias("put_value"),
        F.size(arrays.filled((8, 8), F.lit(0.0))).alias("filled_size"), arrays.index_of(F.lit(19), (8, 8)).alias("index_19"), (F.size(kept) > 0).alias("any_positive"), F.size(kept).cast("long").alias("kept"),
    )


@query(f"SELECT vec_id, round(list_sum([CASE WHEN x[65 - i] = 0 THEN x[i] ELSE x[i] / x[65 - i] END FOR i IN range(1, 65)]), 3) AS divided FROM {_D}")
def n_divide(spark, sf_dir):
    x = F.col("x")
    return _matrix(spark, sf_dir).select("vec_id", F.round(arrays.total(arrays.elementwise(x, F.reverse(x), "divide")), 3).alias("divided"))


# -- migration and schemas ------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS p_size, [p_brand] AS p_brand, 'EUR' AS currency FROM part")
def m_plan(spark, sf_dir):
    """A migration planned from two schemas: rename, conversion, many values, default, removal."""
    old = model.schema({"classes": {"Part": {"attributes": {"p_partkey": {"range": "integer"}, "p_size": {"range": "integer"}, "p_brand": {"range": "string"}, "p_type": {}}}}})
    new = model.schema({"classes": {"Part": {"attributes": {"id": {"range": "integer"}, "p_size": {"range": "string"}, "p_brand": {"range": "string", "multivalued": True}, "currency": {"ifabsent": "EUR"}}}}})
    return migrate.plan(old, new, "Part", {"p_partkey": "id"}).run(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type"))


@query("SELECT 'size' AS slot, 'range' AS code, 'error' AS severity, count(*) AS n FROM part WHERE p_size > 40")
def m_validated(spark, sf_dir):
    """The new schema's report on the migrated table."""
    old = model.schema({"classes": {"Part": {"attributes": {"p_size": {"range": "integer"}}}}})
    new = model.schema({"classes": {"Part": {"attributes": {"size": {"range": "integer", "maximum_value": 40}}}}})
    return migrate.plan(old, new, "Part", {"p_size": "size"}).validated(table(spark, sf_dir, "part").select("p_size"), "Part")


_PETS = model.schema({"enums": {"Kind": {"permissible_values": ["a", "b"]}}, "classes": {"Thing": {"abstract": True, "attributes": {"id": {"identifier": True}}}, "Animal": {"is_a": "Thing", "attributes": {"legs": {"range": "integer"}}}, "Dog": {"is_a": "Animal", "attributes": {"kind": {"range": "Kind"}, "owner": {"range": "Person"}}}, "Person": {"is_a": "Thing", "attributes": {"age": {"range": "integer"}}}}})


@query("SELECT * FROM (VALUES ('classes', 4.0), ('abstract_classes', 1.0), ('enums', 1.0), ('roots', 1.0), ('max_depth', 2.0)) AS t(what, n)")
def g_statistics(spark, sf_dir):
    found = resolve.statistics(_PETS)
    return spark.createDataFrame([(k, float(found[k])) for k in ("classes", "abstract_classes", "enums", "roots", "max_depth")], "what string, n double")


@query("SELECT * FROM (VALUES ('Kind', 1), ('Person', 1), ('Thing', 2), ('Animal', 1)) AS t(name, n)")
def g_usage(spark, sf_dir):
    found = resolve.usage(_PETS)
    return spark.createDataFrame([(k, found[k]) for k in ("Kind", "Person", "Thing", "Animal")], "name string, n int")


@query("SELECT * FROM (VALUES (0, 'Thing'), (1, 'Animal'), (2, 'Dog'), (3, 'Person')) AS t(place, class)")
def g_topological(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(resolve.topological(_PETS))), "place int, class string")


@query("SELECT * FROM (VALUES ('Hound', 'Dog')) AS t(new, old)")
def s_renames(spark, sf_dir):
    """Classes that were probably renamed."""
    doc = _PETS.to_dict()
    doc["classes"]["Hound"] = doc["classes"].pop("Dog") | {"name": "Hound"}
    return spark.createDataFrame([(c.detail, c.name) for c in schema_ops.renames(_PETS, model.schema(doc))], "new string, old string")


@query("SELECT 'Animal' AS class, 'legs' AS slot UNION ALL SELECT 'Animal', 'weight'")
def s_patch(spark, sf_dir):
    """A difference as operations, applied to the old schema."""
    doc = _PETS.to_dict()
    doc["classes"]["Animal"]["attributes"]["weight"] = {"name": "weight", "range": "float"}
    made = schema_ops.patch(_PETS, schema_ops.patch_between(_PETS, model.schema(doc)))
    return spark.createDataFrame([("Animal", k) for k in made.classes["Animal"].attributes], "class string, slot string")


@query("SELECT * FROM (VALUES ('n_nationkey', 'BIGINT'), ('n_name', 'VARCHAR(25)'), ('n_regionkey', 'BIGINT')) AS t(\"column\", type)")
def g_sql_types(spark, sf_dir):
    s = model.schema({"classes": {"Nation": {"attributes": {"n_nationkey": {"range": "integer"}, "n_name": {"max_length": 25}, "n_regionkey": {"range": "integer"}}}}})
    return spark.createDataFrame([(k, ddl.sql_type(s, v)) for k, v in resolve.induced_slots(s, "Nation").items()], "column string, type string")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def g_spark_types(spark, sf_dir):
    """JSON text read by the Spark type of a class."""
    s = model.schema({"classes": {"Row": {"attributes": {"c_custkey": {"range": "integer"}, "c_nationkey": {"range": "integer"}, "c_acctbal": {"range": "float"}}}}})
    text = table(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_nationkey", "c_acctbal")).alias("j"))
    return text.select(F.from_json("j", ddl.to_spark(s, "Row")).alias("r")).select("r.*").withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("SELECT * FROM (VALUES ('age', 'integer', 0), ('kind', 'string', 2)) AS t(slot, type, n_values)")
def g_json_schema(spark, sf_dir):
    defs = ddl.json_schema(_PETS, "Dog")["$defs"]
    found = [("age", defs["Person"]["properties"]["age"]), ("kind", defs["Dog"]["properties"]["kind"])] if "Person" in defs else []
    return spark.createDataFrame([(k, v["type"], len(v.get("enum", []))) for k, v in found], "slot string, type string, n_values int")


# -- reading and writing --------------------------------------------------------------------------------


@query("SELECT 2 AS rejected")
def l_rejected(spark, sf_dir):
    """Lines of a triples file that are no triples."""
    lines = spark.createDataFrame([("<http://x/1> <http://x/p> \"v\" .",), ("# a comment",), ("",), ("<http://x/1> v .",), ("nonsense",)], "value string")
    return readers.rejected_lines(lines).select(F.col("rejected").cast("int").alias("rejected"))


@query("SELECT c_custkey, c_name || ';' || c_mktsegment AS cell FROM customer")
def d_many_values(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("cell"))
    return writers.csv_columns(df).select(F.col("c_custkey").cast("long").alias("c_custkey"), "cell")
