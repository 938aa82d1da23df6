"""Registered queries over JSON documents: values, CBOR, files, paths, pointers and schemas, beyond those of the main catalogue."""

from __future__ import annotations

from pathlib import Path as File

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.catalog import ORACLE_SQL, big, order_documents, query, table
from marlstone.functions import net
from marlstone.operators import json as J
from marlstone.operators import pointer, relational, validation
from marlstone.operators.pointer import Pointer, RelativePointer
from marlstone.plans import schema as S
from marlstone.plans.jsonpath import Function, Path
from marlstone.sources import cbor, files

C = F.col

#: Items of an order as the documents hold them, with their place.
ITEMS = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_partkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


def per_order(value: str, name: str) -> str:
    """SQL of one value for each order, from its items."""
    return f"WITH i AS ({ITEMS}) SELECT o_orderkey, {value} AS {name} FROM orders LEFT JOIN i ON o_orderkey = l_orderkey GROUP BY o_orderkey"


# -- values -----------------------------------------------------------------------------------


@query("SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 3 = 1 THEN ' ' || props ELSE replace(props, ':', '::') END) AS fine FROM events")
def json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(C("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(C("event_id") % 3 == 1, F.concat(F.lit(" "), "props")).otherwise(F.replace("props", F.lit(":"), F.lit("::")))
    return table(spark, sf_dir, "events").select("event_id", J.is_json(text).alias("fine"))


@query("""SELECT p_partkey, '{"t":' || CAST(to_json(p_name || chr(9) || '"' || p_type || chr(92) || chr(10) || p_brand || '/é') AS VARCHAR) || '}' AS doc FROM part""")
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(C("p_name"), F.lit('\t"'), C("p_type"), F.lit("\\\n"), C("p_brand"), F.lit("/é"))
    quoted = F.get(J.json_path(F.to_json(F.array(text)), "$[0]"), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", pointer.put(F.lit("{}"), "/t", quoted).alias("doc"))


@query("SELECT event_id, event_id % 2 = 0 AS same FROM events")
def json_sameness(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.concat(F.lit('{"k": '), (J.json_value(C("props"), "$.k", "bigint") + C("event_id") % 2).cast("string"), F.lit(".00}"))
    return table(spark, sf_dir, "events").select("event_id", J.json_same(C("props"), other).alias("same"))


@query("SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, '[' || CAST(c_nationkey AS VARCHAR) || ']' AS list FROM customer")
def json_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = J.parse(F.to_json(F.struct(C("c_name").alias("s"), C("c_nationkey").alias("n"), F.array("c_nationkey").alias("l"))))
    show = lambda p: J.stringified(pointer.get(v, p))
    return table(spark, sf_dir, "customer").select("c_custkey", show("/s").alias("name"), show("/n").alias("nation"), show("/l").alias("list"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'number' WHEN 3 THEN 'string' WHEN 4 THEN 'array' ELSE 'object' END AS kind, CAST(CASE event_id % 6 WHEN 3 THEN length(event_type) WHEN 4 THEN 2 WHEN 5 THEN 1 END AS BIGINT) AS size FROM events")
def json_kind_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = C("event_id") % 6
    text = F.when(turn == 0, "null").when(turn == 1, "true").when(turn == 2, C("value").cast("string")).when(turn == 3, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(turn == 4, "[1, 2]").otherwise(C("props"))
    v = J.parse(text)
    return table(spark, sf_dir, "events").select("event_id", J.json_kind(v).alias("kind"), big(J.json_length(v)).alias("size"))


def _head_sql(major: int, n: str) -> str:
    m = 32 * major
    return f"CASE WHEN {n} < 24 THEN printf('%02X', {m} + {n}) WHEN {n} < 256 THEN printf('%02X%02X', {m + 24}, {n}) WHEN {n} < 65536 THEN printf('%02X%04X', {m + 25}, {n}) ELSE printf('%02X%08X', {m + 26}, {n}) END"


@query(f"SELECT o_orderkey, 'A2616B' || {_head_sql(0, 'o_orderkey')} || '6173' || '61' || hex(o_orderstatus) AS bytes FROM orders")
def cbor_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(C("o_orderstatus").alias("s"), C("o_orderkey").alias("k")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(cbor.to_cbor(doc)).alias("bytes"))


@query(f"SELECT o_orderkey, '81' || {_head_sql(1, 'o_orderkey')} AS bytes, '[-' || CAST(o_orderkey + 1 AS VARCHAR) || ']' AS back FROM orders")
def cbor_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = cbor.to_cbor(F.concat(F.lit("[-"), (C("o_orderkey") + 1).cast("string"), F.lit("]")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(data).alias("bytes"), cbor.from_cbor(data).alias("back"))


@query("""WITH b AS (SELECT o_orderkey, (CAST(o_orderkey AS HUGEINT) + 1) * 100000000000000000000 + 7 AS n FROM orders), h AS (SELECT o_orderkey, n, to_hex(n) AS h FROM b)
SELECT o_orderkey, 'C2' || printf('%02X', 64 + (length(h) + 1) // 2) || lpad(h, CAST(2 * ((length(h) + 1) // 2) AS INT), '0') AS bytes, CAST(n AS VARCHAR) AS back, CAST(-n - 1 AS VARCHAR) AS negative FROM h""")
def cbor_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (C("o_orderkey").cast("decimal(38,0)") + 1) * F.lit(10**14).cast("decimal(15,0)") * 10**6 + 7
    data = cbor.to_cbor(n.cast("decimal(38,0)").cast("string"))
    minus = F.unhex(F.concat(F.lit("C3"), F.expr("substring(hex(x), 3)")))
    return table(spark, sf_dir, "orders").select("o_orderkey", data.alias("x")).select("o_orderkey", F.hex("x").alias("bytes"), cbor.from_cbor(C("x")).alias("back"), cbor.from_cbor(minus).alias("negative"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, printf('%d.%02d', l_partkey // 100, l_partkey % 100) AS back FROM lineitem")
def cbor_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("C482"), F.lit("21"), F.lit("1A"), F.lpad(F.hex("l_partkey"), 8, "0"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", big(C("l_linenumber")).alias("line"), cbor.from_cbor(F.unhex(text)).alias("back"))


# -- files ------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch_folder(spark, "lines")
    files.write_json_lines(table(spark, sf_dir, "nation"), folder)
    lines = files.read_json_lines(spark, folder)
    return lines.select(J.json_value(C("text"), "$.n_nationkey", "bigint").alias("k"), J.json_value(C("text"), "$.n_name").alias("name"))


@query("""WITH t AS (SELECT sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + 27) AS n FROM customer)
SELECT CAST(n AS BIGINT) AS bytes, CAST(ceil(n / 1000.0) AS BIGINT) AS pieces, CAST(least(n, 1000) AS BIGINT) AS longest, CAST(17 AS BIGINT) AS head FROM t""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch_folder(spark, "chunks")
    files.write_json_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name").coalesce(1), folder)
    only = "*.txt"
    pieces = files.read_chunks(spark, f"{folder}/{only}", 1000)
    head = files.read_head(spark, f"{folder}/{only}", 17).select(F.octet_length("content").alias("head"))
    found = pieces.agg(F.sum(F.octet_length("chunk")).alias("bytes"), F.count("*").alias("pieces"), F.max(F.octet_length("chunk")).alias("longest"))
    return found.join(F.broadcast(head)).select("bytes", "pieces", big(C("longest")).alias("longest"), big(C("head")).alias("head"))


# -- paths ------------------------------------------------------------------------------------


@query(per_order("max(CASE WHEN pos = 1 THEN l_partkey END)", "first").replace(" AS first FROM", " AS first, max(CASE WHEN pos = n THEN l_partkey END) AS last, CASE WHEN count(l_partkey) = 0 THEN 1 ELSE 3 END AS places FROM").replace("SELECT o_orderkey", "SELECT o_orderkey", 1).replace("CASE WHEN count(l_partkey) = 0 THEN 1 ELSE 3 END", "CAST(CASE WHEN count(l_partkey) = 0 THEN 1 ELSE 3 END AS BIGINT)"))
def path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.json_path(C("doc"), "$.items[0,-1].part")
    pick = lambda i: F.try_element_at(C("found"), F.lit(i)).cast("bigint")
    places = J.json_count(C("doc"), "$.items[0, -1]") + J.json_count(C("doc"), "$['o', 'missing']")
    return order_documents(spark, sf_dir).select("o_orderkey", found.alias("found"), big(places).alias("places")).select("o_orderkey", pick(1).alias("first"), pick(2).alias("last"), "places")


@query(per_order("count(l_quantity) FILTER (l_quantity <> 25)", "n"))
def path_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_documents(spark, sf_dir).select("o_orderkey", big(J.json_count(C("doc"), "$.items[?@.qty != 25]")).alias("n"))


@query(per_order("CAST(max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT)", "some").replace(" AS some FROM", " AS some, CAST(CASE WHEN count(l_quantity) > 0 THEN 1 ELSE 0 END AS BIGINT) AS deep FROM"))
def path_nested_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: big(J.json_count(C("doc"), p))
    return order_documents(spark, sf_dir).select("o_orderkey", n("$[?@[?@.qty > 45]]").alias("some"), n("$[?@..qty]").alias("deep"))


@query(per_order("count(l_quantity) FILTER (length(l_returnflag) = 1 AND l_quantity > 25)", "n").replace(" AS n FROM orders", " AS n, count(l_quantity) AS four, CAST(1 AS BIGINT) AS key FROM orders"))
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: big(J.json_count(C("doc"), p))
    return order_documents(spark, sf_dir).select("o_orderkey", n("$.items[?length(@.flag) == 1 && value(@.qty) > 25]").alias("n"), n("$.items[?count(@.*) == 4]").alias("four"), n("$[?key(@) == 'status']").alias("key"))


@query(per_order("count(l_quantity) FILTER (l_quantity / 2 > 20.25)", "n"))
def path_custom_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = Function(("value",), "value", lambda v: v / 2 if not isinstance(v, (str, list, dict, bool)) and v is not None else v)
    return order_documents(spark, sf_dir).select("o_orderkey", big(J.json_count(C("doc"), "$.items[?half(@.qty) > 20.25]", {"half": half})).alias("n"))


@query("SELECT event_id, event_id % 4 = 0 AS bad, event_id % 4 <> 0 AND CAST(json_extract(props, '$.k') AS BIGINT) = 50 AS failed FROM events")
def path_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def inverse(v):
        return 1 / (v - 50)

    text = F.concat(F.when(C("event_id") % 4 == 0, "{").otherwise(""), "props")
    error = J.path_error(text, "$[?inverse(@) > 0]", {"inverse": Function(("value",), "value", inverse)})
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(error.startswith("no JSON"), F.lit(False)).alias("bad"), F.coalesce(error.startswith("DivisionByZero") | error.startswith("ZeroDivision"), F.lit(False)).alias("failed"))


NATIONS = "SELECT r_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS pos FROM region JOIN nation ON n_regionkey = r_regionkey"


def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(C("n_name").alias("n"), C("n_nationkey").alias("a/b~")))).alias("nations"))
    return table(spark, sf_dir, "region").join(nations, C("r_regionkey") == C("n_regionkey")).select(big(C("r_regionkey")).alias("r"), F.to_json(F.struct("r_name", "nations")).alias("doc"))


@query(f"SELECT CAST(r_regionkey AS BIGINT) AS r, '/nations/' || CAST(pos - 1 AS VARCHAR) || '/a~1b~0' AS pointer, true AS normal, CAST(n_nationkey AS VARCHAR) AS value FROM ({NATIONS})")
def path_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = J.json_nodes(region_documents(spark, sf_dir), "doc", "$..['a/b~']", ["r"])
    return nodes.select("r", pointer.of_paths(C("path")).alias("pointer"), pointer.is_normal_path(C("path")).alias("normal"), "value")


@query(f"SELECT CAST(r_regionkey AS BIGINT) AS r, max(CASE WHEN pos = 2 THEN n_name END) AS second, max(CASE WHEN pos = 1 THEN n_name END) AS first, count(*) AS n FROM ({NATIONS}) GROUP BY r_regionkey")
def path_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = Path("$.nations[0].n")
    second, first = here.parent.parent.appending(1, "n"), Path(pointer.to_path("/nations/0/n"))
    value = lambda p: J.json_value(C("doc"), p.text)
    return region_documents(spark, sf_dir).select("r", value(second).alias("second"), value(first).alias("first"), big(J.json_count(C("doc"), here.parent.parent.text + "[*]")).alias("n"))


# -- pointers ---------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name AS slash, CAST(c_nationkey AS BIGINT) AS tilde, replace(replace(c_name || '/~', '~', '~0'), '/', '~1') AS encoded, c_name || '/~' AS decoded FROM customer")
def pointer_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = J.parse(F.to_json(F.struct(C("c_name").alias("a/b"), C("c_nationkey").alias("m~n"))))
    odd = F.concat("c_name", F.lit("/~"))
    at = lambda p, kind: F.try_variant_get(pointer.get(v, p), "$", kind)
    return table(spark, sf_dir, "customer").select("c_custkey", at("/a~1b", "string").alias("slash"), at("/m~0n", "bigint").alias("tilde"), pointer.encode_token(odd).alias("encoded"), pointer.decode_token(pointer.encode_token(odd)).alias("decoded"))


@query("""SELECT o_orderkey, '[' || CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) || ']' AS appended, '{"a":' || CAST(o_custkey AS VARCHAR) || '}' AS replaced, '[]' AS removed FROM orders""")
def pointer_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, own = F.to_json(F.array("o_orderkey")), C("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", pointer.put(doc, "/-", own).alias("appended"), pointer.put(F.lit('{"a":0}'), "/a", own).alias("replaced"), pointer.put(doc, "/0", None).alias("removed"))


@query(per_order("max(CASE WHEN pos = 1 THEN l_partkey END)", "part").replace(" AS part FROM orders", " AS part, any_value(o_orderstatus) AS status, any_value(o_orderkey) AS key FROM orders"))
def pointer_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Pointer.parse("/items") / 0
    name, rest = (base / "part").descend()
    up = RelativePointer.parse("2/status").apply(base)
    v = J.parse(C("doc"))
    at = lambda p, kind: F.try_variant_get(pointer.get(v, p), "$", kind)
    return order_documents(spark, sf_dir).select("o_orderkey", at(Pointer((name,)) / rest, "bigint").alias("part"), at(up, "string").alias("status"), at((base / "x").parent.parent.parent / "o", "bigint").alias("key"))


@query(r"SELECT page_id, regexp_replace(url, '#.*$', '') || '#/a~1b/0' AS url, regexp_replace(url, '#.*$', '') || '#/a~1b/0/c' AS deeper FROM pages")
def pointer_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pointer(("a/b", "0"))
    return table(spark, sf_dir, "pages").select("page_id", pointer.with_fragment(C("url"), p).alias("url"), pointer.with_fragment(C("url"), p / "c").alias("deeper"))


# -- schemas: keywords ------------------------------------------------------------------------


def fits(doc: Column, schema: dict, **more) -> Column:
    return validation.is_valid(doc, schema, **more)


def optional(**members: Column) -> Column:
    """JSON of an object; members that are null are left out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in members.items())))


K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("""SELECT o_orderkey, o_orderstatus IN ('O', 'F') AND o_totalprice >= 1000 AS prefix, o_orderstatus IN ('O', 'F') AND o_totalprice >= 1000 AND o_custkey % 2 = 0 AS rest, o_custkey <= 700 AS items,
  o_custkey % 3 <> 0 AS most FROM orders""")
def schema_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('["'), "o_orderstatus", F.lit('",'), C("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(","), C("o_custkey").cast("string"), F.lit("]"))
    numbers = F.to_json(F.when(C("o_custkey") % 3 == 0, F.array("o_custkey", F.lit(1), F.lit(2))).otherwise(F.array("o_custkey")))
    prefix = [{"enum": ["O", "F"]}, {"minimum": 1000}]
    return table(spark, sf_dir, "orders").select("o_orderkey", fits(doc, {"prefixItems": prefix}).alias("prefix"), fits(doc, {"prefixItems": prefix, "items": {"multipleOf": 2}}).alias("rest"), fits(numbers, {"items": {"maximum": 700}}).alias("items"), fits(numbers, {"maxItems": 2}).alias("most"))


@query(per_order("count(l_quantity) FILTER (l_quantity > 30) >= 2", "two").replace(" AS two FROM", " AS two, count(l_quantity) FILTER (l_quantity > 30) <= 1 AS at_most FROM"))
def schema_contains_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("["), F.array_join(J.json_path(C("doc"), "$.items[*].qty"), ","), F.lit("]"))
    high = {"contains": {"exclusiveMinimum": 30}}
    return order_documents(spark, sf_dir).select("o_orderkey", fits(doc, high | {"minContains": 2}).alias("two"), fits(doc, high | {"minContains": 0, "maxContains": 1}).alias("at_most"))


@query(f"SELECT event_id, {K} % 2 = 0 AS rest, event_id % 3 = 0 AS none FROM events")
def schema_unevaluated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = J.json_value(C("props"), "$.k", "bigint")
    doc = F.to_json(F.when(C("event_id") % 3 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), k)))
    first = {"allOf": [{"prefixItems": [{"const": 0}]}]}
    pair = F.to_json(F.array(F.lit(0), k))
    return table(spark, sf_dir, "events").select("event_id", fits(pair, first | {"unevaluatedItems": {"multipleOf": 2}}).alias("rest"), fits(doc, first | {"unevaluatedItems": False}).alias("none"))


@query("SELECT event_id, CASE WHEN event_type LIKE 'p%' THEN value >= 5 ELSE true END AS fine, event_type LIKE '%e%' AS closed FROM events")
def schema_pattern_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.create_map("event_type", "value"))
    return table(spark, sf_dir, "events").select("event_id", fits(doc, {"patternProperties": {"^p": {"minimum": 5}}}).alias("fine"), fits(doc, {"patternProperties": {"e": True}, "additionalProperties": False}).alias("closed"))


@query("SELECT o_orderkey, o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 AS required, o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 AS legacy, o_orderkey % 2 = 1 OR o_custkey > 700 AS schemas, (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) AS least, NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) AS most, o_orderkey % 2 = 1 AS no_a FROM orders")
def schema_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = optional(c=C("o_custkey"), a=F.when(C("o_orderkey") % 2 == 0, 1), b=F.when(C("o_orderkey") % 3 == 0, 1))
    need = {"a": ["b"]}
    return table(spark, sf_dir, "orders").select("o_orderkey", fits(doc, {"dependentRequired": need}).alias("required"), fits(doc, {"dependencies": need}).alias("legacy"), fits(doc, {"dependentSchemas": {"a": {"properties": {"c": {"exclusiveMinimum": 700}}}}}).alias("schemas"), fits(doc, {"minProperties": 3}).alias("least"), fits(doc, {"maxProperties": 2}).alias("most"), fits(doc, {"properties": {"a": False, "c": True}}).alias("no_a"))


TREE = {"$id": "http://x/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"data": True, "children": {"type": "array", "items": {"$dynamicRef": "#node"}}}}
STRICT = {"$id": "http://x/strict", "$dynamicAnchor": "node", "$ref": "tree", "unevaluatedProperties": False}


@query("SELECT event_id, event_id % 3 <> 0 AS strict, true AS open FROM events")
def schema_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.concat(F.lit('{"children": [{"children": [{"'), F.when(C("event_id") % 3 == 0, "daat").otherwise("data"), F.lit('": 1}]}]}'))
    others = {"http://x/tree": TREE}
    return table(spark, sf_dir, "events").select("event_id", fits(child, STRICT, others=others).alias("strict"), fits(child, TREE).alias("open"))


@query(f"SELECT event_id, {K} <= 60 AS anchor, {K} >= 10 AND {K} <= 60 AS base, {K} >= 10 AS def FROM events")
def schema_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = {"minimum": 10}, {"$anchor": "high", "maximum": 60}
    schema = lambda *refs: {"$id": "http://x/root", "$schema": S.DIALECT, "$comment": "two limits", "$defs": {"low": {"$id": "low", **low}, "high": high}, "properties": {"k": {"allOf": [{"$ref": r} for r in refs]}}}
    return table(spark, sf_dir, "events").select("event_id", fits(C("props"), schema("#high")).alias("anchor"), fits(C("props"), schema("http://x/low", "#/$defs/high")).alias("base"), fits(C("props"), schema("#/$defs/low")).alias("def"))


@query("SELECT o_orderkey, CAST(2 + 2 * CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 3 = 0 AS INT) AS BIGINT) AS notes, CAST(1 + CAST(o_orderkey % 2 = 0 AS INT) AS BIGINT) AS titles, CAST(0 AS BIGINT) AS none FROM orders")
def schema_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = optional(c=C("o_custkey"), a=F.when(C("o_orderkey") % 2 == 0, "x"), b=F.when(C("o_orderkey") % 3 == 0, 1))
    schema = {"title": "root", "description": "an order", "properties": {"a": {"title": "A", "contentEncoding": "base64"}, "b": {"deprecated": True, "unknown-word": 1}}}
    n = lambda **o: big(J.json_count(validation.output(doc, schema, "basic", S.Options(**o)), "$.annotations[*]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", n().alias("notes"), n(annotations=frozenset(["title"])).alias("titles"), n(annotations="none").alias("none"))


@query(f"SELECT event_id, {K} % 2 = 0 AS even, false AS unknown FROM events")
def schema_custom_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.Options(keywords={"even": lambda value, x: not value or x % 2 == 0})
    schema = {"properties": {"k": {"even": True}}}
    return table(spark, sf_dir, "events").select("event_id", fits(C("props"), schema, options=own).alias("even"), fits(C("props"), schema, options=S.Options(unknown="fail")).alias("unknown"))


@query("SELECT o_orderkey, o_totalprice <= 300000 AND o_orderstatus = 'O' AS valid, CAST(CAST(o_totalprice > 300000 AS INT) + CAST(o_orderstatus <> 'O' AS INT) AS BIGINT) AS detailed, CAST(CASE WHEN o_totalprice > 300000 OR o_orderstatus <> 'O' THEN 1 + CAST(o_totalprice > 300000 AS INT) + CAST(o_orderstatus <> 'O' AS INT) ELSE 0 END AS BIGINT) AS verbose FROM orders")
def schema_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"properties": {"o_totalprice": {"maximum": 300000}, "o_orderstatus": {"const": "O"}}}
    doc = F.to_json(F.struct("o_totalprice", "o_orderstatus"))
    errors = lambda form, p: big(J.json_count(F.concat(F.lit("["), validation.output(doc, schema, form), F.lit("]")), p))
    flag = J.json_value(validation.output(doc, schema, "flag"), "$.valid", "boolean")
    return table(spark, sf_dir, "orders").select("o_orderkey", flag.alias("valid"), errors("detailed", "$..[?@.error && (search(@.keywordLocation, 'maximum') || search(@.keywordLocation, 'const'))]").alias("d0"), errors("verbose", "$..error").alias("verbose"), F.when(~flag, 0).alias("z")).select("o_orderkey", "valid", F.greatest("d0", big(F.lit(0))).alias("detailed"), "verbose")


META = {"$id": "http://x/meta", "$vocabulary": {"https://json-schema.org/draft/2020-12/vocab/core": True, "https://json-schema.org/draft/2020-12/vocab/applicator": True, "https://json-schema.org/draft/2020-12/vocab/format-assertion": True}}


@query("SELECT event_id, event_id % 2 = 0 AS asserted, true AS annotated FROM events")
def schema_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"d": "'), F.when(C("event_id") % 2 == 0, "2024-02-29").otherwise("2023-02-29"), F.lit('"}'))
    schema = {"properties": {"d": {"format": "date", "maxLength": 3}}}  # the second word is of no vocabulary of the meta-schema
    plain = {"properties": {"d": {"format": "date"}}}
    return table(spark, sf_dir, "events").select("event_id", fits(doc, {"$schema": "http://x/meta"} | schema, others={"http://x/meta": META}).alias("asserted"), fits(doc, plain).alias("annotated"))


@query(f"SELECT event_id, {K} >= 20 AND {K} < 80 AS fine FROM events")
def schema_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = {"http://x/low": {"minimum": 20}}.get
    second = {"http://x/low": {"minimum": 90}, "http://x/high": {"exclusiveMaximum": 80}}.get
    schema = {"properties": {"k": {"allOf": [{"$ref": "http://x/low"}, {"$ref": "http://x/high"}]}}}
    return table(spark, sf_dir, "events").select("event_id", fits(C("props"), schema, options=S.Options(locators=(first, second))).alias("fine"))


@query(per_order("any_value(o_totalprice) > 20000.5 AND count(l_quantity) >= 2 AND coalesce(min(l_quantity) >= 2 AND max(l_quantity) <= 49, true)", "fine"))
def schema_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = S.Schema.load(str(File(__file__).parent / "schemas"))
    return order_documents(spark, sf_dir).select("o_orderkey", fits(C("doc"), {"$ref": "http://schemas.example/order"}, others=known).alias("fine"))


@query("SELECT c_custkey, c_custkey % 20 BETWEEN 3 AND 12 AS sized, c_custkey % 2 = 0 AS is_bytes FROM customer")
def schema_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = C("c_custkey") % 20
    head = F.when((size < 24), F.lpad(F.hex(size + 64), 2, "0"))
    data = F.unhex(F.concat(head, F.hex(F.expr("substring(concat(c_name, c_name), 1, int(c_custkey % 20))"))))
    text = F.unhex(F.concat(F.when(C("c_custkey") % 2 == 0, "4161").otherwise("6161")))
    return table(spark, sf_dir, "customer").select("c_custkey", validation.is_valid_cbor(data, {"type": "bytes", "minSize": 3, "maxSize": 12}).alias("sized"), validation.is_valid_cbor(text, {"type": "bytes"}).alias("is_bytes"))


@query(f"SELECT event_id, {K} >= 50 AS large, {K} % 5 = 0 AS tiny, {K} > 0 AS above, {K} % 2 = 0 AS same, event_id % 2 = 1 AS uniq FROM events")
def schema_exact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = J.json_value(C("props"), "$.k", "bigint").cast("string")
    number = lambda text, schema: fits(F.concat(F.lit("["), text, F.lit("]")), {"items": schema})
    same = F.concat(k, F.lit("."), F.repeat(F.lit("0"), 30), F.when(J.json_value(C("props"), "$.k", "bigint") % 2 == 0, "0").otherwise("1"))
    pair = F.concat(F.lit("[1, 1"), F.when(C("event_id") % 2 == 0, "e0]").otherwise(".5]"))
    return table(spark, sf_dir, "events").select("event_id", number(F.concat(k, F.lit("e30")), {"minimum": 50e30}).alias("large"), number(F.concat(k, F.lit("e-8")), {"multipleOf": 5e-8}).alias("tiny"), number(F.concat(k, F.lit("e-300")), {"exclusiveMinimum": 0}).alias("above"), number(same, {"type": "integer"}).alias("same"), fits(pair, {"uniqueItems": True}).alias("uniq"))


# -- schemas: formats -------------------------------------------------------------------------


def of_format(text: Column, name: str) -> Column:
    return validation.is_valid(F.to_json(F.struct(text.alias("t"))), {"properties": {"t": {"format": name}}}, S.Options(assert_formats=True))


Y, MO, D, H = "1990 + o_orderkey % 30", "1 + o_custkey % 13", "1 + o_orderkey % 31", "o_orderkey % 26"
DATE = f"printf('%04d-%02d-%02d', {Y}, {MO}, {D})"


@query(f"SELECT o_orderkey, try_cast({DATE} AS DATE) IS NOT NULL AS date, {H} < 24 AND o_custkey % 62 < 60 AS time, try_cast({DATE} AS DATE) IS NOT NULL AND {H} < 24 AS date_time, o_orderkey % 4 < 2 AS duration FROM orders")
def formats_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = C("o_orderkey"), C("o_custkey")
    date = F.format_string("%04d-%02d-%02d", 1990 + o % 30, 1 + c % 13, 1 + o % 31)
    time = F.format_string("%02d:%02d:30.5", o % 26, c % 62)
    span = F.element_at(F.array(F.lit("P3Y6M4DT12H30M5S"), F.lit("P4W"), F.lit("P1Y2W"), F.lit("PT")), (o % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", of_format(date, "date").alias("date"), of_format(F.concat(time, F.lit("-05:30")), "time").alias("time"), of_format(F.concat(date, F.lit("T"), F.format_string("%02d", o % 26), F.lit(":00:00Z")), "date-time").alias("date_time"), of_format(span, "duration").alias("duration"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS email, c_custkey % 3 <> 0 AS idn_email, c_custkey % 2 = 0 AS hostname, c_custkey % 2 = 0 AS idn_hostname, c_custkey % 300 < 256 AS ipv4, c_custkey % 3 <> 1 AS ipv6 FROM customer")
def formats_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey")
    mail = F.concat(F.when(k % 3 == 0, "a..").otherwise("a.b+"), k.cast("string"), F.lit("@example.com"))
    wide = F.concat(F.when(k % 3 == 0, "ü ").otherwise("ü"), k.cast("string"), F.lit("@bücher.example"))
    host = F.concat(F.when(k % 2 == 0, "h").otherwise("-h"), k.cast("string"), F.lit(".example"))
    idn = F.concat(F.when(k % 2 == 0, "bücher").otherwise("bücher〮"), k.cast("string"), F.lit(".example"))
    six = F.concat(F.when(k % 3 == 1, "fe80:::").otherwise("fe80::"), F.lower(net.ipv6_groups(k)))
    return table(spark, sf_dir, "customer").select("c_custkey", of_format(mail, "email").alias("email"), of_format(wide, "idn-email").alias("idn_email"), of_format(host, "hostname").alias("hostname"), of_format(idn, "idn-hostname").alias("idn_hostname"), of_format(F.concat(F.lit("10.0.7."), (k % 300).cast("string")), "ipv4").alias("ipv4"), of_format(six, "ipv6").alias("ipv6"))


@query("SELECT page_id, page_id % 2 = 0 AS uri, page_id % 3 <> 0 AS reference, page_id % 2 = 0 AS iri, page_id % 3 <> 0 AS iri_reference, page_id % 2 = 0 AS template FROM pages")
def formats_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, path = C("page_id"), F.expr("substring(url, instr(url, '://') + 3)")
    wide = F.concat(F.when(i % 2 == 0, C("url")).otherwise(path), F.lit("é"))
    bad = F.when(i % 3 == 0, F.lit("%zz")).otherwise(F.lit("%20"))
    return table(spark, sf_dir, "pages").select("page_id", of_format(F.when(i % 2 == 0, C("url")).otherwise(path), "uri").alias("uri"), of_format(F.concat(F.lit("/a/"), path, bad), "uri-reference").alias("reference"), of_format(wide, "iri").alias("iri"), of_format(F.concat(F.lit("/é/"), path, bad), "iri-reference").alias("iri_reference"), of_format(F.concat(F.lit("{+a"), i.cast("string"), F.when(i % 2 == 0, "*}").otherwise("")), "uri-template").alias("template"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS uuid, c_custkey % 4 < 2 AS pointer, c_custkey % 3 <> 0 AS relative, c_custkey % 2 = 0 AS regex, true AS zebra FROM customer")
def formats_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey")
    tail = F.lpad(F.hex(k), 12, "0")
    uuid = F.concat(F.lit("6ba7b810-9dad-11d1-80b4-"), F.when(k % 2 == 0, tail).otherwise(F.expr("substring(lpad(hex(c_custkey), 12, '0'), 2)")))
    place = F.concat(F.lit("/a~"), (k % 4).cast("string"), F.lit("/"), k.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", of_format(uuid, "uuid").alias("uuid"), of_format(place, "json-pointer").alias("pointer"), of_format(F.concat(F.when(k % 3 == 0, "0").otherwise("1"), (k % 7).cast("string"), F.lit("/x")), "relative-json-pointer").alias("relative"), of_format(F.concat(F.lit("(a"), k.cast("string"), F.when(k % 2 == 0, ")+").otherwise("+")), "regex").alias("regex"), of_format(C("c_name"), "zebra").alias("zebra"))


# -- table function ---------------------------------------------------------------------------


@query(f"SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(pos - 1 AS BIGINT) AS ord, '$[''nations''][' || CAST(pos - 1 AS VARCHAR) || '][''n'']' AS path, '\"' || n_name || '\"' AS value FROM ({NATIONS})")
def path_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = relational.nodes_function()
    docs = region_documents(spark, sf_dir)
    rows = docs.lateralJoin(nodes(C("doc").outer(), F.lit("$..n")))
    return rows.select("r", big(C("ord")).alias("ord"), "path", "value")


assert ORACLE_SQL  # the main catalogue is loaded first
