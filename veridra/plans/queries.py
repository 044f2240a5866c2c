"""The registered queries over the tables, and their SQL. Keys begin with the kind of operator:
v checks, r rules, e and f expressions, a aggregates, u unique keys, j references, p profiles, n arrays,
m migration, s sets, l reading, d writing, g schema graph, t streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.functions.expressions import Compiler, evaluate
from veridra.operators import arrays, checks, migrate, profile, references, rules, tables, unique
from veridra.operators.checks import Capture
from veridra.plans import ddl, engine, model, resolve
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expressions(spark: SparkSession, sf_dir: str, name: str, keys: list[str], **given: str) -> DataFrame:
    return evaluate(table(spark, sf_dir, name), given).select(*keys, *given)


# -- the schemas that the queries use ---------------------------------------------------------------

LINE_ITEM = model.schema({
    "name": "lines", "default_range": "string",
    "enums": {"ReturnFlag": {"permissible_values": ["A", "R"]}, "Priority": {"permissible_values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}},
    "types": {"Quantity": {"base_type": "float", "minimum_value": 1, "maximum_value": 45}},
    "classes": {
        "Line": {
            "attributes": {
                "l_orderkey": {"range": "integer", "required": True}, "l_partkey": {"range": "integer", "required": True}, "l_suppkey": {"range": "integer", "required": True},
                "l_linenumber": {"range": "integer", "required": True, "minimum_value": 1, "maximum_value": 7},
                "l_quantity": {"range": "Quantity"}, "l_extendedprice": {"range": "float", "minimum_value": 0}, "l_discount": {"range": "float", "minimum_value": 0, "maximum_value": 0.05},
                "l_tax": {"range": "float", "maximum_value": "0.07"}, "l_returnflag": {"range": "ReturnFlag"}, "l_linestatus": {"pattern": "^[OF]$", "min_length": 1, "max_length": 1},
                "l_shipdate": {"range": "datetime", "minimum_value": "1993-01-01"},
            },
            "unique_keys": {"line": {"unique_key_slots": ["l_orderkey", "l_linenumber"]}},
        },
        "Order": {
            "attributes": {"o_orderkey": {"range": "integer", "identifier": True}, "o_custkey": {"range": "integer"}, "o_orderstatus": {"any_of": [{"equals_string": "F"}, {"equals_string": "O"}]}, "o_totalprice": {"range": "float"}, "o_orderdate": {"range": "datetime"}, "o_orderpriority": {"range": "Priority"}},
            "rules": [
                {"title": "finished", "priority": 10, "preconditions": {"slot_conditions": {"o_orderstatus": {"equals_string": "F"}}}, "postconditions": {"slot_conditions": {"o_totalprice": {"minimum_value": 1000}}}, "elseconditions": {"slot_conditions": {"o_orderpriority": {"pattern": "^[1-4]-"}}}},
                {"title": "large", "priority": 5, "preconditions": {"expression_conditions": ["{o_totalprice} > 200000"]}, "postconditions": {"any_of": [{"slot_conditions": {"o_orderpriority": {"equals_string": "1-URGENT"}}}, {"slot_conditions": {"o_orderstatus": {"equals_string_in": ["F", "P"]}}}]}},
            ],
        },
        "Event": {
            "attributes": {"event_id": {"range": "integer", "identifier": True}, "ts": {"range": "datetime"}, "user_id": {"range": "integer"}, "event_type": {}, "value": {"range": "float"}, "props": {}},
            "if_required": {"event_type": {"condition": {"equals_string": "purchase"}, "then_required": ["value"]}},
        },
    },
})


def _compiler(df: DataFrame) -> Compiler:
    return Compiler(df.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 300, None).otherwise(F.col("value")))


# -- checks of records --------------------------------------------------------------------------------

_LINE_SQL = """
    SELECT slot, code, 'error' AS severity, count(*) AS n FROM (
        SELECT 'l_discount' AS slot, 'range' AS code FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05
        UNION ALL SELECT 'l_tax', 'range' FROM lineitem WHERE l_tax > 0.07
        UNION ALL SELECT 'l_quantity', 'range' FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45
        UNION ALL SELECT 'l_linenumber', 'range' FROM lineitem WHERE l_linenumber NOT BETWEEN 1 AND 7
        UNION ALL SELECT 'l_extendedprice', 'range' FROM lineitem WHERE l_extendedprice < 0
        UNION ALL SELECT 'l_returnflag', 'enum' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')
        UNION ALL SELECT 'l_linestatus', 'pattern' FROM lineitem WHERE NOT regexp_matches(l_linestatus, '^[OF]$')
        UNION ALL SELECT 'l_shipdate', 'range' FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01'
    ) GROUP BY slot, code"""


@query(_LINE_SQL)
def flagship_validation_report(spark, sf_dir):
    """All checks of a class on line items, counted by slot and code in one pass."""
    df = table(spark, sf_dir, "lineitem")
    return engine.check_frame(df, LINE_ITEM, "Line").report(df)


@query("""
    SELECT count(*) AS total, count(*) FILTER (WHERE e = 0) AS valid, count(*) FILTER (WHERE e > 0) AS invalid, CAST(sum(e) AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings FROM (
        SELECT (l_discount < 0 OR l_discount > 0.05)::INT + (l_tax > 0.07)::INT + (l_quantity < 1 OR l_quantity > 45)::INT + (l_linenumber NOT BETWEEN 1 AND 7)::INT + (l_extendedprice < 0)::INT
             + (l_returnflag NOT IN ('A', 'R'))::INT + (NOT regexp_matches(l_linestatus, '^[OF]$'))::INT + (l_shipdate < TIMESTAMP '1993-01-01')::INT AS e FROM lineitem)""")
def v_summary_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return engine.check_frame(df, LINE_ITEM, "Line").summary(df)


@query("""
    SELECT o_orderkey, slot, code, severity FROM (
        SELECT o_orderkey, 'o_orderstatus' AS slot, 'ANY_OF_CONSTRAINT_FAILED' AS code, 'error' AS severity FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT o_orderkey, 'o_orderpriority', 'enum', 'error' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
        UNION ALL SELECT o_orderkey, 'o_totalprice', 'RULE_MINIMUM', 'error' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 1000
        UNION ALL SELECT o_orderkey, 'o_orderpriority', 'RULE_PATTERN', 'error' FROM orders WHERE o_orderstatus <> 'F' AND NOT regexp_matches(o_orderpriority, '^[1-4]-')
        UNION ALL SELECT o_orderkey, '', 'RULE_COMBINATION', 'error' FROM orders WHERE o_totalprice > 200000 AND NOT (o_orderpriority = '1-URGENT' OR o_orderstatus IN ('F', 'P')))""")
def v_issues_orders(spark, sf_dir):
    """Every issue of every order: combinators, enumerations and rules."""
    df = table(spark, sf_dir, "orders")
    found = engine.check_frame(df, LINE_ITEM, "Order").violations(df, ["o_orderkey"])
    return found.select("o_orderkey", F.regexp_replace("path", r"^\$\.?", "").alias("slot"), "code", "severity")


@query("SELECT event_type, count(*) AS missing FROM events WHERE value > 300 GROUP BY event_type")
def v_required(spark, sf_dir):
    s = model.schema({"classes": {"Event": {"attributes": {"event_type": {}, "value": {"range": "float", "required": True}}}}})
    df = _events(spark, sf_dir).select("event_type", "value")
    found = engine.check_frame(df, s, "Event").violations(df, ["event_type"]).filter("code = 'required' and path = '$.value'")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("missing"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(x, '^\\s*[+-]?\\d+\\s*$') THEN TRUE ELSE FALSE END AS is_int, TRY_CAST(x AS DOUBLE) IS NOT NULL AS is_float, lower(x) IN ('true', 'false') AS is_bool, regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$') AS is_uri
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN CAST(c_nationkey AS VARCHAR) || '.5' WHEN 2 THEN 'true' ELSE 'x:' || c_name END AS x FROM customer)""")
def v_types(spark, sf_dir):
    m = F.col("c_custkey") % 4
    text = F.when(m == 0, F.col("c_nationkey").cast("string")).when(m == 1, F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))).when(m == 2, "true").otherwise(F.concat(F.lit("x:"), "c_name"))
    df = table(spark, sf_dir, "customer").select("c_custkey", text.alias("x"))
    kind = df.schema["x"].dataType
    return df.select("c_custkey", *[checks.is_valid_type(F.col("x"), kind, of).alias(n) for n, of in (("is_int", "integer"), ("is_float", "float"), ("is_bool", "boolean"), ("is_uri", "uri"))])


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^https://')")
def v_pattern(spark, sf_dir):
    s = model.schema({"classes": {"Page": {"attributes": {"page_id": {"range": "integer"}, "url": {"pattern": "^https://"}}}}})
    df = table(spark, sf_dir, "pages").select("page_id", "url")
    return engine.check_frame(df, s, "Page").violations(df, ["page_id"]).select("page_id")


_URL = r"^(?P<scheme>https?)://(?P<host>[^/]+)/(?P<lang>[a-z]{2})/(?P<number>\d+)"


@query("""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/', 2) AS host,
    regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/', 3) AS lang, CAST(regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\\d+)', 1) AS BIGINT) AS number,
    CAST(regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\\d+)', 1) AS BIGINT) > 500 AS number_invalid FROM pages""")
def v_captures(spark, sf_dir):
    """Named captures, one of them typed and checked."""
    got = checks.typed_captures(F.col("url"), _URL, {"number": Capture("integer", maximum=500)})
    return table(spark, sf_dir, "pages").select("page_id", *[got[n][0].alias(n) for n in ("scheme", "host", "lang", "number")], got["number"][1].alias("number_invalid"))


@query("SELECT doc_id FROM documents WHERE length(text) NOT BETWEEN 50 AND 5000")
def v_length(spark, sf_dir):
    s = model.schema({"classes": {"Doc": {"attributes": {"doc_id": {"range": "integer"}, "text": {"min_length": 50, "max_length": 5000}}}}})
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return engine.check_frame(df, s, "Doc").violations(df, ["doc_id"]).select("doc_id")


_BRANCHES = [model.expr({"minimum_value": 41}), model.expr({"equals_expression": "p_type == \"PROMO\" ? p_size : -1"}), model.expr({"maximum_value": 10})]


@query("""SELECT p_partkey, n > 0 AS any_of, n = 3 AS all_of, n = 1 AS exactly_one_of, n = 0 AS none_of, CAST(n AS INT) AS n_ok
    FROM (SELECT p_partkey, (p_size >= 41)::INT + (p_type = 'PROMO')::INT + (p_size <= 10)::INT AS n FROM part)""")
def v_combinators(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    c, kind = F.col("p_size"), df.schema["p_size"].dataType
    each = {name: checks.combined(LINE_ITEM, c, kind, name, _BRANCHES, _compiler(df)) for name in ("any_of", "all_of", "exactly_one_of", "none_of")}
    return df.select("p_partkey", *[v[0].alias(k) for k, v in each.items()], each["any_of"][1].alias("n_ok"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 300")
def v_if_required(spark, sf_dir):
    df = _events(spark, sf_dir)
    return engine.check_frame(df, LINE_ITEM, "Event").violations(df, ["event_id"]).filter("code = 'conditional_required'").select("event_id")


@query("""SELECT p_partkey, NOT (p_size IN (1, 2, 3) OR p_retailprice > 1500) AS then_violated, p_brand = 'Brand#11' AND p_type NOT IN ('PROMO') AS forbidden_violated
    FROM part WHERE (p_type IN ('PROMO', 'ECONOMY') AND NOT (p_size IN (1, 2, 3) OR p_retailprice > 1500)) OR (p_brand = 'Brand#11' AND p_type NOT IN ('PROMO'))""")
def v_conditional(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    c = _compiler(df)
    ok = checks.condition({"or": [{"in": ["p_size", [1, 2, 3]]}, {"greater_than": ["p_retailprice", 1500]}]}, c)
    promo = checks.condition({"in": ["p_type", ["PROMO", "ECONOMY"]]}, c)
    brand = checks.condition({"and": [{"equals": ["p_brand", "Brand#11"]}, {"not_in": ["p_type", ["PROMO"]]}]}, c)
    return df.filter((promo & ~ok) | brand).select("p_partkey", (~ok).alias("then_violated"), brand.alias("forbidden_violated"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity > 1500 AS too_dear FROM lineitem WHERE l_extendedprice / l_quantity > 1500")
def v_slot_expression(spark, sf_dir):
    """A rule of a slot, which sees the record and the slot's own value."""
    s = model.schema({"classes": {"Line": {"attributes": {"l_extendedprice": {"range": "float", "rules": ["{value} / {l_quantity} <= 1500"]}}}}})
    df = table(spark, sf_dir, "lineitem")
    found = engine.check_frame(df, s, "Line", engine.Options(ignore=tuple(df.columns))).violations(df, ["l_orderkey", "l_linenumber", "l_partkey"]).filter("code = 'slot_rule'")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.lit(True).alias("too_dear"))


@query("SELECT p_partkey, p_name LIKE '% r%' AS glob, regexp_matches(p_name, p_brand || '|red') AS partial FROM part")
def v_structured_pattern(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    glob = checks.structured_match(F.col("p_name"), model.StructuredPattern("* r*", "glob", False, False), _compiler(df))
    sp = model.StructuredPattern("{p_brand}|red", "regex", True, True)
    return df.select("p_partkey", glob.alias("glob"), checks.structured_match(F.col("p_name"), sp, _compiler(df)).alias("partial"))


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def v_lookup(spark, sf_dir):
    permitted = spark.createDataFrame([("click",), ("view",), ("purchase",)], "name string")
    return checks.not_permitted(table(spark, sf_dir, "events"), "event_type", permitted, "name").select("event_type").distinct()


@query("SELECT c_mktsegment AS key, list(DISTINCT CAST(c_nationkey AS VARCHAR) ORDER BY CAST(c_nationkey AS VARCHAR)) AS values FROM customer GROUP BY 1")
def v_lookup_table(spark, sf_dir):
    return checks.lookup(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'none' ELSE 'Event' END AS cls FROM events")
def v_json_record(spark, sf_dir):
    """Records in JSON text: a value by path, and the class by its keys."""
    s = model.schema({"classes": {"Event": {"attributes": {"k": {"range": "integer"}}}}})
    df = readers.parsed_json(table(spark, sf_dir, "events"), "props", s)
    return df.select("event_id", readers.at_json_path(F.col("props"), "$.k").try_cast("long").alias("k"), F.coalesce("class", F.lit("none")).alias("cls"))


@query("SELECT event_id, coalesce(CASE WHEN value > 300 THEN NULL ELSE value END, 7.5) AS value, 'event_id' AS slot, 'Event' AS cls FROM events")
def v_defaults(spark, sf_dir):
    df = _events(spark, sf_dir)
    default = lambda spec: checks.default_value(model.Slot("event_id", ifabsent=spec), "Event", _compiler(df))
    return df.select("event_id", F.coalesce("value", default("float(7.5)")).alias("value"), default("slot_name").alias("slot"), default("class_name").alias("cls"))


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS name, upper(p_type) AS kind FROM part")
def v_replace(spark, sf_dir):
    return migrate.upper(migrate.replaced(table(spark, sf_dir, "part"), "p_name", "[aeiou]", "*"), "p_type").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(left(c_name, greatest(length(c_name) - 4, 0)), '[A-Za-z]', 'x', 'g'), '[0-9]', '0', 'g') || right(c_name, 4) AS masked FROM customer")
def v_mask(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", checks.masked(F.col("c_name")).alias("masked"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'enum' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'ANY_OF_CONSTRAINT_FAILED' END AS first_code
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR o_orderstatus NOT IN ('F', 'O')""")
def v_fail_fast(spark, sf_dir):
    """The first issue of each order, by severity and path, without rules."""
    s = model.schema({"enums": {"Priority": {"permissible_values": LINE_ITEM.enums["Priority"].values}}, "classes": {"Order": {"attributes": {"o_orderstatus": {"any_of": [{"equals_string": "F"}, {"equals_string": "O"}]}, "o_orderpriority": {"range": "Priority"}}}}})
    df = table(spark, sf_dir, "orders")
    plan = engine.check_frame(df, s, "Order", engine.Options(fail_fast=True, ignore=tuple(df.columns)))
    return plan.violations(df, ["o_orderkey"]).select("o_orderkey", F.col("code").alias("first_code"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 40 AND regexp_matches(p_brand, '^Brand#[12]') AND p_retailprice >= 900")
def v_valid_records(spark, sf_dir):
    s = model.schema({"classes": {"Part": {"attributes": {"p_partkey": {"range": "integer", "required": True}, "p_size": {"range": "integer", "minimum_value": 5, "maximum_value": 40}, "p_brand": {"pattern": "^Brand#[12]"}, "p_retailprice": {"range": "float", "minimum_value": 900}}}}})
    df = table(spark, sf_dir, "part")
    return engine.check_frame(df, s, "Part").valid(df).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 40 AND regexp_matches(p_brand, '^Brand#[12]')")
def g_select_valid(spark, sf_dir):
    s = model.schema({"classes": {"Part": {"attributes": {"p_partkey": {"range": "integer", "required": True}, "p_size": {"range": "integer", "minimum_value": 5, "maximum_value": 40}, "p_brand": {"pattern": "^Brand#[12]"}}}}})
    return ddl.select_valid(table(spark, sf_dir, "part"), s, "Part").select("p_partkey")


# -- rules ----------------------------------------------------------------------------------------------


def _rules(df: DataFrame) -> list[rules.CompiledRule]:
    return rules.compile_rules(LINE_ITEM, "Order", _compiler(df))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice < 1000 ELSE o_orderpriority = '5-LOW' END AS finished,
    o_totalprice > 200000 AND NOT (o_orderpriority = '1-URGENT' OR o_orderstatus IN ('F', 'P')) AS large FROM orders""")
def r_rules(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", *[r.violated().alias(r.rule.title) for r in _rules(df)])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 1000 OR o_orderstatus <> 'F' AND o_orderpriority = '5-LOW' THEN 'finished'
    WHEN o_totalprice > 200000 AND NOT (o_orderpriority = '1-URGENT' OR o_orderstatus IN ('F', 'P')) THEN 'large' END AS first_rule FROM orders""")
def r_first_violated(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", rules.first_violated(_rules(df)).alias("first_rule"))


@query("""SELECT 'finished' AS title, count(*) FILTER (WHERE o_orderstatus = 'F') AS matched, count(*) FILTER (WHERE o_orderstatus <> 'F') AS skipped,
        count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice < 1000 OR o_orderstatus <> 'F' AND o_orderpriority = '5-LOW') AS issues FROM orders
    UNION ALL SELECT 'large', count(*) FILTER (WHERE o_totalprice > 200000), count(*) FILTER (WHERE o_totalprice <= 200000),
        count(*) FILTER (WHERE o_totalprice > 200000 AND NOT (o_orderpriority = '1-URGENT' OR o_orderstatus IN ('F', 'P'))) FROM orders""")
def r_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return rules.rule_statistics(df, _rules(df))


# -- expressions and functions ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) + 0.0 AS net, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax + 0.0 END AS ratio, CAST(l_orderkey % 7 AS DOUBLE) AS rest, CAST(-l_linenumber AS BIGINT) AS negative FROM lineitem")
def e_arithmetic(spark, sf_dir):
    return expressions(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], net="{l_extendedprice} * (1 - l_discount) + 0.0", ratio="l_discount / l_tax + 0.0", rest="l_orderkey % 7", negative="-l_linenumber").withColumn("negative", F.col("negative").cast("long"))


@query("""SELECT p_partkey, p_size = 5 AS eq, p_brand <> 'Brand#11' AS ne, p_size < 10 OR p_type >= 'P' AS cmp, NOT (p_size > 20 AND p_retailprice <= 1200) AS logic,
    CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS size_name FROM part""")
def e_logic(spark, sf_dir):
    return expressions(spark, sf_dir, "part", ["p_partkey"], eq="p_size == 5", ne='p_brand != "Brand#11"', cmp='p_size < 10 or p_type >= "P"', logic="not (p_size > 20 && p_retailprice <= 1200)", size_name='if p_size > 25 then "big" else (p_size > 10 ? "middle" : "small")')


@query("""SELECT p_partkey, octet_length(encode(p_name)) AS n, upper(p_name) AS u, lower(p_type) AS lo, trim(p_name) AS t, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'd') AS ew, replace(p_name, ' ', '_') AS r,
    string_split(p_name, ' ') AS parts, array_to_string(string_split(p_name, ' '), '-') AS joined, substring(p_name, 1, 3) AS s3, substring(p_name, 4) AS rest, contains(p_name, 'e') AS has, regexp_matches(p_brand, '#[12]') AS m FROM part""")
def f_strings(spark, sf_dir):
    return expressions(spark, sf_dir, "part", ["p_partkey"], n="len(p_name)", u="upper(p_name)", lo="lower(p_type)", t='trim("  " + p_name + " ")', sw='starts_with(p_name, "a")', ew='ends_with(p_name, "d")', r='replace(p_name, " ", "_")', parts='split(p_name, " ")', joined='join(split(p_name, " "), "-")', s3="substring(p_name, 0, 3)", rest="substring(p_name, 3)", has='contains(p_name, "e")', m='matches(p_brand, "#[12]")')


@query("""SELECT c_custkey, abs(c_acctbal) AS a, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 9) END AS sq, pow(c_nationkey, 2) AS p, round(sin(c_nationkey), 9) AS si, round(cos(c_nationkey), 9) AS co, round(tan(c_nationkey), 9) AS ta,
    CASE WHEN c_nationkey > 0 THEN round(ln(c_nationkey), 9) END AS ln, CASE WHEN c_nationkey > 0 THEN round(ln(c_nationkey) / ln(2), 9) END AS lb, round(exp(c_nationkey / 10), 9) AS ex, CAST(floor(c_acctbal) AS BIGINT) AS fl, CAST(ceil(c_acctbal) AS BIGINT) AS ce,
    CAST(c_custkey % 7 AS DOUBLE) AS mo, greatest(c_acctbal, 0) AS mx, least(c_acctbal, 100) AS mn FROM customer""")
def f_math(spark, sf_dir):
    return expressions(spark, sf_dir, "customer", ["c_custkey"], a="abs(c_acctbal)", sq="round(sqrt(c_acctbal), 9)", p="pow(c_nationkey, 2)", si="round(sin(c_nationkey), 9)", co="round(cos(c_nationkey), 9)", ta="round(tan(c_nationkey), 9)", ln="round(log(c_nationkey), 9)", lb="round(log(c_nationkey, 2), 9)", ex="round(exp(c_nationkey / 10), 9)", fl="floor(c_acctbal)", ce="ceil(c_acctbal)", mo="mod(c_custkey, 7)", mx="max(c_acctbal, 0.0)", mn="min(c_acctbal, 100.0)")


@query("SELECT c_custkey, round(c_nationkey / 8, 1) AS r1, CASE WHEN c_nationkey > 20 THEN 'high' WHEN c_nationkey > 10 THEN 'middle' ELSE 'low' END AS band FROM customer")
def f_round_case(spark, sf_dir):
    return expressions(spark, sf_dir, "customer", ["c_custkey"], r1="round(c_nationkey / 8, 1)", band='case(c_nationkey > 20, "high", c_nationkey > 10, "middle", "low")')


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS plus_days, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') AS plus_weeks,
    strftime(CASE WHEN day(o_orderdate) <= day(last_day(o_orderdate + INTERVAL 1 MONTH)) THEN CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS plus_month,
    year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, strftime(o_orderdate, '%d/%m/%Y') AS shown, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders""")
def f_dates(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("text", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return evaluate(df, {"plus_days": 'date_add(day, 10, "days")', "plus_weeks": 'date_add(day, 2, "weeks")', "plus_month": 'date_add(day, 1, "months")', "y": "year(o_orderdate)", "m": "month(o_orderdate)", "d": "day(o_orderdate)", "shown": 'date_format(o_orderdate, "%d/%m/%Y")', "parsed": 'date_parse(text, "%d/%m/%Y")'}).select("o_orderkey", "plus_days", "plus_weeks", "plus_month", "y", "m", "d", "shown", "parsed")


@query("SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, CAST(trunc(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS weeks FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def f_date_diff(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("a", F.to_date("o_orderdate")).withColumn("b", F.to_date("l_shipdate"))
    return evaluate(df, {"days": 'date_diff(a, b, "days")', "weeks": 'date_diff(a, b, "weeks")'}).select("l_orderkey", "l_linenumber", "l_partkey", "days", "weeks")


@query("SELECT p_partkey, p_size * 3 AS tripled FROM part")
def f_custom(spark, sf_dir):
    custom = {"triple": (1, 1, lambda x: x.column.cast("long") * 3, None)}
    return evaluate(table(spark, sf_dir, "part"), {"tripled": "triple(p_size)"}, custom).select("p_partkey", "tripled")


# -- aggregates ------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS va, count(DISTINCT l_suppkey) AS u FROM lineitem GROUP BY l_returnflag""")
def a_group_stats(spark, sf_dir):
    found = tables.group_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_suppkey")
    return found.select("l_returnflag", "n", F.round("total", 2).alias("s"), F.round("mean", 6).alias("a"), F.col("median").alias("med"), F.round("stddev", 6).alias("sd"), F.round("variance", 6).alias("va"), F.col("distinct").alias("u"))


@query("WITH c AS (SELECT c_mktsegment AS g, c_nationkey AS v, count(*) AS n FROM customer GROUP BY 1, 2) SELECT g, v, n FROM c QUALIFY rank() OVER (PARTITION BY g ORDER BY n DESC) = 1")
def a_mode_ties(spark, sf_dir):
    return tables.most_frequent(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey").select(F.col("group").alias("g"), F.col("value").alias("v"), "n")


@query("""SELECT o_custkey, round(list_sum(x), 2) AS s, round(list_avg(x), 6) AS a, CAST(len(x) AS BIGINT) AS n, median AS med, CASE WHEN len(x) > 1 THEN round(sd, 6) END AS sd, CASE WHEN len(x) > 1 THEN round(va / 1000000, 4) END AS va, mode AS mo, CAST(len(list_distinct(st)) AS BIGINT) AS u
    FROM (SELECT o_custkey, list(o_totalprice) AS x, list(o_orderstatus) AS st, median(o_totalprice) AS median, stddev_samp(o_totalprice) AS sd, var_samp(o_totalprice) AS va,
        (SELECT min(s) FROM (SELECT o_orderstatus AS s, count(*) AS c FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1 QUALIFY rank() OVER (ORDER BY c DESC) = 1)) AS mode FROM orders o GROUP BY o_custkey)""")
def a_array_functions(spark, sf_dir):
    """The aggregate functions of the expression language on arrays inside records."""
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("x"), F.collect_list("o_orderstatus").alias("st"))
    return evaluate(df, {"s": "round(sum(x), 2)", "a": "round(avg(x), 6)", "n": "count(x)", "med": "median(x)", "sd": "round(stddev(x), 6)", "va": "round(variance(x) / 1000000, 4)", "mo": "mode(st)", "u": "len(unique(st))"}).drop("x", "st")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') AS non_null, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY o_custkey")
def a_array_count(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("v"))).alias("r")).select("o_custkey", F.col("r.v").alias("x"))
    return evaluate(df, {"non_null": 'count(x, "non-null")', "finished": 'count(x, "F")'}).drop("x")


@query("SELECT o_custkey, '\"' || o_orderstatus || '\"' AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def a_group_by(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("x"))
    grouped = evaluate(df, {"g": 'group_by(x, "o_orderstatus")'}).select("o_custkey", F.explode("g").alias("status", "rows"))
    return grouped.select("o_custkey", "status", F.size("rows").cast("long").alias("n"))


@query(f"SELECT code AS validator, severity, CAST(sum(n) AS BIGINT) AS n FROM ({_LINE_SQL}) GROUP BY ROLLUP (code, severity)")
def a_rollup(spark, sf_dir):
    """Issues by validator and severity, with subtotals (an extension)."""
    df = table(spark, sf_dir, "lineitem")
    return engine.rollup_report(engine.check_frame(df, LINE_ITEM, "Line").violations(df, ["l_orderkey"]))


# -- unique keys and references -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def u_duplicates(spark, sf_dir):
    return unique.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_LATER = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) {} 1"


@query(_LATER.format(">"))
def u_later(spark, sf_dir):
    return unique.later_occurrences(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(_LATER.format("="))
def u_first(spark, sf_dir):
    return unique.drop_later(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT 'line' AS key, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'part', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey, l_quantity HAVING count(*) > 1)""")
def u_all_keys(spark, sf_dir):
    keys = [*unique.keys_of(LINE_ITEM, "Line"), model.UniqueKey("part", ["l_partkey", "l_suppkey", "l_quantity"])]
    return unique.key_report(table(spark, sf_dir, "lineitem"), keys).groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def u_known(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return unique.already_known(table(spark, sf_dir, "orders"), known, ["o_custkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')")
def j_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return references.orphans(table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey")


@query("""SELECT 'l_orderkey' AS slot, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    UNION ALL SELECT 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def j_report(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return references.reference_report(t("lineitem"), [("l_orderkey", t("orders").filter("o_orderstatus <> 'P'"), "o_orderkey"), ("l_suppkey", t("supplier").filter("s_acctbal > 0"), "s_suppkey")])


@query("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j_embed(spark, sf_dir):
    nations = references.embed(table(spark, sf_dir, "nation"), "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey", "region")
    out = references.embed(table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey", "nation")
    return out.select("c_custkey", F.col("nation.n_name").alias("nation"), F.col("nation.region.r_name").alias("region"))


@query("SELECT c_custkey, 'Nation' AS type, c_nationkey AS id FROM customer")
def j_reference_object(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", references.reference_object(F.col("c_nationkey"), "Nation").alias("r")).select("c_custkey", F.col("r.`@type`").alias("type"), "r.id")


@query("SELECT c_nationkey AS id, list(c_custkey ORDER BY c_custkey) AS customers FROM customer GROUP BY 1")
def j_inverse(spark, sf_dir):
    return references.inverse(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "customers")


@query("SELECT 'http://x/' || c_custkey AS s, 'http://x/Customer' AS type, [c_mktsegment] AS segment, [c_name] AS name FROM customer")
def j_subjects(spark, sf_dir):
    """Records as triples, and assembled from them again."""
    t, kind = table(spark, sf_dir, "customer"), "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in ((kind, F.lit("http://x/Customer")), ("segment", F.col("c_mktsegment")), ("name", F.col("c_name")))])
    triples = t.select(F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string")).alias("s"), F.explode(rows).alias("t")).select("s", "t.p", "t.o")
    return references.subjects(triples, kind).select("s", "type", F.col("values")["segment"].alias("segment"), F.col("values")["name"].alias("name"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS child, CAST(p_partkey // 2 AS BIGINT) AS parent FROM part WHERE p_partkey > 1),
    c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON e.child = c.ancestor) SELECT child, least(max(depth), 6) AS depth FROM c GROUP BY child HAVING max(depth) > 5""")
def j_depth(spark, sf_dir):
    edges = table(spark, sf_dir, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    return references.too_deep(edges, 5).filter("not circular").select("child", "depth")


# -- profiles -----------------------------------------------------------------------------------------------------


@query("""SELECT 'k' AS "column", CASE WHEN lower(x) IN ('true', 'false', 'yes', 'no') THEN 'boolean' WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN 'integer' ELSE 'string' END AS type, count(*) AS votes
    FROM (SELECT json_extract_string(props, '$.k') AS x FROM events) WHERE x IS NOT NULL GROUP BY 2""")
def p_type_votes(spark, sf_dir):
    return profile.type_votes(table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")))


@query("""SELECT 'o_orderpriority' AS "column", count(*) AS rows, count(*) AS non_empty, TRUE AS required, 'string' AS type, count(DISTINCT o_orderpriority) AS "distinct", list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS values FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*), TRUE, 'string', count(DISTINCT o_orderstatus), list(DISTINCT o_orderstatus ORDER BY o_orderstatus) FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count(*), TRUE, 'integer', count(DISTINCT o_custkey), NULL FROM orders""")
def p_columns(spark, sf_dir):
    df = profile.columns_profile(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])
    return df.select("column", "rows", "non_empty", "required", "type", "distinct", "values")


@query("""SELECT 'o_totalprice' AS "column", min(o_totalprice) AS minimum, max(o_totalprice) AS maximum FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey) FROM orders""")
def p_ranges(spark, sf_dir):
    return profile.columns_profile(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]).select("column", "minimum", "maximum")


@query("SELECT count(*) AS parents, min(n) AS least, max(n) AS most, min(n) > 0 AS required, max(n) > 1 AS multivalued FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)")
def p_occurrences(spark, sf_dir):
    df = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return profile.occurrences(df, "c_custkey", "o_orderkey")


@query("""SELECT 'p_brand' AS "column", 'string' AS type, CAST(1.0 AS DOUBLE) AS confidence UNION ALL SELECT 'p_retailprice', 'float', 1.0""")
def p_majority(spark, sf_dir):
    return profile.majority(profile.type_votes(table(spark, sf_dir, "part"), ["p_brand", "p_retailprice"]))


@query("SELECT c_mktsegment AS value FROM customer GROUP BY 1 ORDER BY 1 LIMIT 100")
def p_samples(spark, sf_dir):
    """A bounded sample of distinct values, which is the feature."""
    return profile.samples(table(spark, sf_dir, "customer"), "c_mktsegment")


@query()
def p_inferred_schema(spark, sf_dir):
    """A schema inferred from a table, as rows."""
    s = profile.infer_schema(table(spark, sf_dir, "nation"), "Nation")
    rows = [(c, k, v.range, v.required, v.multivalued) for c, x in s.classes.items() for k, v in x.attributes.items()]
    return spark.createDataFrame(rows, "class string, slot string, range string, required boolean, multivalued boolean")


# -- arrays -------------------------------------------------------------------------------------------------------------


def _matrix(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


_D = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@query(f"SELECT vec_id, round(list_sum(x), 6) AS s, round(list_avg(x), 6) AS m, list_min(x) AS lo, list_max(x) AS hi, round(list_stddev_samp(x), 6) AS sd, CAST(len(list_filter(x, lambda e: e > 0)) AS INT) AS pos, len(list_filter(x, lambda e: e > 5)) = 0 AS all_small FROM {_D}")
def n_statistics(spark, sf_dir):
    x = F.col("x")
    return _matrix(spark, sf_dir).select("vec_id", F.round(arrays.total(x), 6).alias("s"), F.round(arrays.mean(x), 6).alias("m"), arrays.least(x).alias("lo"), arrays.most(x).alias("hi"), F.round(arrays.std_dev(x), 6).alias("sd"), F.size(F.filter(x, lambda e: e > 0)).alias("pos"), F.forall(x, lambda e: e <= 5).alias("all_small"))


@query(f"SELECT vec_id, x[2 * 8 + 3 + 1] AS at, x[17:24] AS row2, [x[i * 8 + 4] FOR i IN range(8)] AS column3, x[1 + 3 * 8 + 2] AS transposed, x[9] AS column_major FROM {_D}")
def n_index(spark, sf_dir):
    x, shape = F.col("x"), (8, 8)
    return _matrix(spark, sf_dir).select("vec_id", arrays.get(x, (2, 3), shape).alias("at"), arrays.take_slice(x, shape, 0, 2).alias("row2"), arrays.take_slice(x, shape, 1, 3).alias("column3"), F.get(arrays.transpose(x, shape), F.lit(2 * 8 + 3)).alias("transposed"), arrays.get(x, (0, 1), shape, column_major=True).alias("column_major"))


@query(f"""SELECT vec_id, round(list_sum([x[i] + x[65 - i] FOR i IN range(1, 65)]), 6) AS added, round(list_sum([x[i] - x[65 - i] FOR i IN range(1, 65)]) + 0.0, 6) + 0.0 AS subtracted, round(list_sum([x[i] * x[65 - i] FOR i IN range(1, 65)]), 6) AS multiplied,
    round(list_sum([x[i] * 2 + 1 FOR i IN range(1, 65)]), 6) AS scaled FROM {_D}""")
def n_elementwise(spark, sf_dir):
    x = F.col("x")
    r, total = F.reverse(x), lambda c, n: F.round(arrays.total(c), 6).alias(n)
    out = _matrix(spark, sf_dir).select("vec_id", total(arrays.elementwise(x, r, "add"), "added"), total(arrays.elementwise(x, r, "subtract"), "subtracted"), total(arrays.elementwise(x, r, "multiply"), "multiplied"), total(arrays.add_scalar(arrays.multiply_scalar(x, 2.0), 1.0), "scaled"))
    return out.withColumn("subtracted", F.col("subtracted") + 0.0)


@query(f"SELECT vec_id, list_sort(x) AS sorted, list_reverse_sort(x)[1] AS first_falling, list_sort(x[9:16]) AS row1, list_filter([CASE WHEN x[i + 1] < 0 THEN CAST(i AS INT) END FOR i IN range(64)], lambda i: i IS NOT NULL) AS negative FROM {_D}")
def n_sort_find(spark, sf_dir):
    x = F.col("x")
    return _matrix(spark, sf_dir).select("vec_id", arrays.sort(x).alias("sorted"), F.get(arrays.sort(x, False), F.lit(0)).alias("first_falling"), F.slice(arrays.sort_axis(x, (8, 8), 1), 9, 8).alias("row1"), arrays.find(x, lambda e: e < 0).alias("negative"))


@query(f"SELECT vec_id, count(*) AS issues FROM (SELECT vec_id, unnest(x) AS e FROM {_D}) WHERE e > 0.2 OR e < -0.2 GROUP BY vec_id")
def n_validate(spark, sf_dir):
    found = arrays.array_issues(F.col("x"), minimum=-0.2, maximum=0.2)
    return _matrix(spark, sf_dir).select("vec_id", F.size(found).cast("long").alias("issues")).filter("issues > 0")


# -- migration, sets, names ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, concat_ws(' ', p_brand, p_type) AS m, CAST(p_size AS VARCHAR) AS size, 'EUR' AS currency FROM part")
def m_migrate(spark, sf_dir):
    df = migrate.rename(table(spark, sf_dir, "part"), {"p_partkey": "id", "p_size": "size"})
    df = migrate.merge(migrate.split(df, "p_name", ["a", "b"]), ["p_brand", "p_type"], "m")
    return migrate.with_default(migrate.convert(df, "size", "string"), "currency", "EUR").select("id", "a", "b", "m", "size", "currency")


@query("SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS priority, split_part(o_orderpriority, '-', 1) IN ('1') AS urgent, [o_orderstatus] AS statuses FROM orders")
def m_convert(spark, sf_dir):
    df = migrate.split(table(spark, sf_dir, "orders"), "o_orderpriority", ["priority", "label"], "-").withColumn("urgent", F.col("priority")).withColumnRenamed("o_orderstatus", "statuses")
    for name, to in (("priority", "number"), ("urgent", "boolean"), ("statuses", "array")):
        df = migrate.convert(df, name, to)
    return df.select("o_orderkey", "priority", "urgent", "statuses")


@query("""SELECT 'event_id' AS "column", CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS empty, TRUE AS is_id UNION ALL SELECT 'value', count(*) FILTER (WHERE value > 300), 0, FALSE FROM events""")
def m_integrity(spark, sf_dir):
    return migrate.integrity(_events(spark, sf_dir).select("event_id", "value"), "event_id")


@query("SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier")
def s_union(spark, sf_dir):
    a = migrate.rename(table(spark, sf_dir, "customer"), {"c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"}).select(F.lit("customer").alias("source"), "nation", "balance", "segment")
    b = migrate.rename(table(spark, sf_dir, "supplier"), {"s_nationkey": "nation", "s_acctbal": "balance"}).select(F.lit("supplier").alias("source"), "nation", "balance")
    return tables.union(a, b)


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def s_except(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    return tables.difference(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), suppliers)


_PREFIXES = model.schema({"prefixes": {"h": "https://", "p": "http://", "blog": "https://blog."}})


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://blog.') THEN 'blog:' || substr(url, 14) WHEN starts_with(url, 'https://') THEN 'h:' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'p:' || substr(url, 8) ELSE url END AS curie, url AS back FROM pages")
def g_curie(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", resolve.contract_column(_PREFIXES, F.col("url")).alias("curie"))
    return df.withColumn("back", resolve.expand_column(_PREFIXES, F.col("curie")))


_ANIMALS = model.schema({"classes": {"Thing": {}, "Animal": {"is_a": "Thing"}, "Pet": {"abstract": True}, "Dog": {"is_a": "Animal", "mixins": ["Pet"]}, "Puppy": {"is_a": "Dog"}}})


@query("""SELECT * FROM (VALUES ('Animal', 'Thing', 1), ('Dog', 'Animal', 1), ('Dog', 'Pet', 1), ('Dog', 'Thing', 2), ('Puppy', 'Dog', 1), ('Puppy', 'Animal', 2), ('Puppy', 'Pet', 2), ('Puppy', 'Thing', 3)) AS t(child, ancestor, depth)""")
def g_closure(spark, sf_dir):
    return resolve.closure(resolve.edge_frame(spark, _ANIMALS))


@query("SELECT 'Cat' AS name, 'added' AS kind, FALSE AS breaking UNION ALL SELECT 'Puppy', 'removed', TRUE")
def s_schema_diff(spark, sf_dir):
    from veridra.operators.schema_ops import diff_frame, patch

    changed = patch(_ANIMALS, [{"op": "remove", "path": "/classes/Puppy"}, {"op": "add", "path": "/classes/Cat", "value": {"is_a": "Animal"}}])
    return diff_frame(spark, _ANIMALS, changed).select("name", "kind", "breaking")


# -- reading and writing ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CAST(x AS BIGINT) AS n, b IN ('yes') AS flag, string_split(many, ';') AS many FROM (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS x, CASE WHEN c_nationkey > 10 THEN 'yes' ELSE 'no' END AS b, c_mktsegment || ';' || c_name AS many FROM customer)")
def l_typed_cells(spark, sf_dir):
    """Text cells as typed values, many values in one cell split."""
    c = table(spark, sf_dir, "customer")
    df = c.select("c_custkey", F.col("c_nationkey").cast("string").alias("x"), F.when(F.col("c_nationkey") > 10, "yes").otherwise("no").alias("b"), F.concat("c_mktsegment", F.lit(";"), "c_name").alias("many"))
    return df.select("c_custkey", checks.convert(F.col("x"), "integer").alias("n"), checks.convert(F.col("b"), "boolean").alias("flag"), checks.convert_many(F.col("many"), "string").alias("many"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 50")
def l_map_limit(spark, sf_dir):
    """Renamed columns and the first rows; the limit is the feature."""
    df = table(spark, sf_dir, "orders").orderBy("o_orderkey").select("o_orderkey", "o_orderstatus")
    return writers.selected(df, writers.Options(mapping={"o_orderkey": "id", "o_orderstatus": "status"}, limit=50))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(x * 1000) AS INT)), ';') AS cell FROM embeddings")
def d_cells(spark, sf_dir):
    """Many values in one text cell, as a delimited file holds them. As in the SQL, the product is a float
    (with an integer, Spark makes it a double), and a vector of nothing but nulls has no cell."""
    values = F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("int"))
    some = (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNotNull())
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.when(some, values).alias("cell"))
    return writers.csv_columns(df).select(F.col("vec_id").cast("long").alias("vec_id"), "cell")


@query("""SELECT '<http://x/' || n_nationkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/Nation> .' AS value FROM nation
    UNION ALL SELECT '<http://x/' || n_nationkey || '> <http://x/n_name> "' || n_name || '" .' FROM nation""")
def d_triples(spark, sf_dir):
    s = model.schema({"classes": {"Nation": {"attributes": {"n_name": {}}}}})
    return writers.triple_lines(table(spark, sf_dir, "nation"), s, "Nation", "n_nationkey", "http://x/")


@query("SELECT 'http://x/' || n_nationkey AS s, 'http://x/n_name' AS p, n_name AS o FROM nation")
def l_triples(spark, sf_dir):
    """Triples written and parsed again."""
    return readers.parsed_triples(d_triples(spark, sf_dir)).filter(~F.col("p").endswith("#type")).select("s", "p", "o")


# -- streams ------------------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 300 GROUP BY 1")
def t_hourly_issues(spark, sf_dir):
    """Issues by hour of event time; the same plan runs on a stream (an extension)."""
    counts = validate.issue_counts(_events(spark, sf_dir), LINE_ITEM, "Event", "ts")
    return counts.filter("code = 'conditional_required'").select("start", "n")
