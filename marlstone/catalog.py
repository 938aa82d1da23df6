"""The library's registered queries and the SQL that gives the same rows.

Every query runs over whole tables. Result columns are plainly typed: bigint, double, string,
boolean, timestamp.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import encoding, hashing, ids, net, numeric, tempo, uri, uri_template
from marlstone.operators import json as J
from marlstone.operators import pointer, validation
from marlstone.plans.path_columns import compile_value
from marlstone.sources import cbor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Times in the tables have no zone.
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name) for f in df.schema.fields))


def big(c: Column) -> Column:
    return c.cast("bigint")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, doc): an order with its items as JSON; one shuffle on the order key."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part")))).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("o"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.coalesce("items", F.array().cast("array<struct<n:int,qty:double,flag:string,part:bigint>>")).alias("items")))
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left").select("o_orderkey", doc.alias("doc"))


# -- paths ------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def path_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.json_value(F.col("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def path_filter_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = J.json_value(F.col("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("SELECT o_orderkey, count(l_linenumber) FILTER (l_quantity > 40) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def path_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_documents(spark, sf_dir).select("o_orderkey", big(J.json_count(F.col("doc"), "$.items[?@.qty > 40]")).alias("n"))


@query("SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def path_wildcard_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_documents(spark, sf_dir).select("o_orderkey", big(J.json_count(F.col("doc"), "$.items[*].n")).alias("n"))


@query("SELECT o_orderkey, count(l_linenumber) FILTER (l_returnflag = 'R' AND (l_quantity < 10 OR l_quantity >= 45)) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def path_filter_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "$.items[?@.flag == 'R' && (@.qty < 10 || @.qty >= 45)]"
    return order_documents(spark, sf_dir).select("o_orderkey", big(J.json_count(F.col("doc"), p)).alias("n"))


@query("SELECT o_orderkey, count(l_linenumber) FILTER (NOT (l_returnflag = 'R')) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def path_filter_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_documents(spark, sf_dir).select("o_orderkey", big(J.json_count(F.col("doc"), "$.items[?!(@.flag == 'R')]")).alias("n"))


@query("SELECT o_orderkey, count(l_linenumber) FILTER (l_quantity * 1000 < o_totalprice) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def path_root_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order_documents(spark, sf_dir)
    scaled = F.to_json(F.struct(F.expr("transform(from_json(doc, 'items array<struct<qty:double>>').items, x -> named_struct('q', x.qty * 1000))").alias("items"), F.expr("get_json_object(doc, '$.total')").cast("double").alias("total")))
    return docs.select("o_orderkey", big(J.json_count(scaled, "$.items[?@.q < $.total]")).alias("n"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, CAST(len(embedding[2:9]) AS BIGINT) AS some FROM embeddings")
def path_index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings")
    at = lambda p: F.try_element_at(J.json_path(text, p), F.lit(1)).cast("float").cast("double")
    return e.select("vec_id", at("$[0]").alias("first"), at("$[-1]").alias("last"), big(F.size(J.json_path(text, "$[1:9]"))).alias("some"))


@query("SELECT event_id, json_extract(props, '$.missing') IS NOT NULL AS there, json_extract(props, '$.k') IS NOT NULL AS k_there FROM events")
def path_exists_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.exists(F.col("props"), "$.missing").alias("there"), J.exists(F.col("props"), "$.k").alias("k_there"))


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#0*[0-9]*5') AS whole, regexp_matches(c_name, '77') AS part FROM customer")
def path_match_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.array("c_name"))
    some = lambda p: F.size(J.json_path(doc, p)) > 0
    return table(spark, sf_dir, "customer").select("c_custkey", some("$[?match(@, 'Customer#0*[0-9]*5')]").alias("whole"), some("$[?search(@, '77')]").alias("part"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json(F.to_json(F.struct("text")))
    return table(spark, sf_dir, "documents").select("doc_id", big(J.json_length(compile_value("$.text", v))).alias("n"))


GEO = """SELECT r_regionkey AS r, '$[''nations''][' || CAST(pos - 1 AS VARCHAR) || '][''n'']' AS path, '"' || n_name || '"' AS value FROM (
  SELECT r_regionkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS pos FROM region JOIN nation ON n_regionkey = r_regionkey)"""


@query(GEO)
def path_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("n")))).alias("nations"))
    docs = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(big(F.col("r_regionkey")).alias("r"), F.to_json(F.struct("r_name", "nations")).alias("doc"))
    return J.json_nodes(docs, "doc", "$..n", ["r"]).select("r", "path", "value")


ORACLE_SQL["path_descendant"] = GEO.replace("r_regionkey AS r,", "CAST(r_regionkey AS BIGINT) AS r,", 1)


@query("SELECT o_orderkey, CAST(min(l_partkey) FILTER (l_linenumber = 2) AS BIGINT) AS part FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def pointer_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = J.parse(F.col("doc"))
    second = F.filter(J.json_path(F.col("doc"), "$.items[?@.n == 2].part"), lambda x: x.isNotNull())
    return order_documents(spark, sf_dir).where(pointer.get(v, "/o").isNotNull()).select("o_orderkey", F.array_min(F.transform(second, lambda x: x.cast("bigint"))).alias("part"))


@query("""SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"seen":true}' AS doc FROM events""")
def pointer_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", pointer.put(F.col("props"), "/seen", F.lit("true")).alias("doc"))


@query("SELECT event_id, '{}' AS doc FROM events")
def pointer_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", pointer.put(F.col("props"), "/k", None).alias("doc"))


@query("SELECT event_id, 'object' AS kind, 'number' AS k_kind, CAST(1 AS BIGINT) AS size FROM events")
def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = J.parse(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", J.json_kind(v).alias("kind"), J.json_kind(compile_value("$.k", v)).alias("k_kind"), big(J.json_length(v)).alias("size"))


@query("SELECT event_id, true AS same FROM events")
def cbor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = cbor.from_cbor(cbor.to_cbor(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", J.json_same(back, F.col("props")).alias("same"))


# -- schemas ----------------------------------------------------------------------------------

LINE = {
    "type": "object",
    "required": ["l_quantity", "l_discount"],
    "properties": {"l_quantity": {"type": "number", "minimum": 5, "exclusiveMaximum": 46}, "l_discount": {"maximum": 0.07}, "l_returnflag": {"enum": ["A", "N"]}, "l_linenumber": {"type": "integer"}},
}


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_quantity >= 5 AND l_quantity < 46 AND CAST(l_discount AS DECIMAL(12,4)) <= 0.07 AND l_returnflag IN ('A', 'N') AS valid FROM lineitem")
def schema_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct("l_quantity", "l_discount", "l_returnflag", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", big(F.col("l_linenumber")).alias("line"), validation.is_valid(doc, LINE).alias("valid"))


@query("""SELECT o_orderkey, '/o_totalprice' AS instance_location, '/properties/o_totalprice/maximum' AS keyword_location FROM orders WHERE o_totalprice > 300000
  UNION ALL SELECT o_orderkey, '/o_orderstatus', '/properties/o_orderstatus/const' FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT o_orderkey, '', '/properties' FROM orders WHERE o_totalprice > 300000 OR o_orderstatus <> 'O'""")
def schema_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"properties": {"o_totalprice": {"maximum": 300000}, "o_orderstatus": {"const": "O"}}}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_totalprice", "o_orderstatus")).alias("doc"))
    return validation.violations(rows, "doc", schema, ["o_orderkey"]).select("o_orderkey", "instance_location", "keyword_location")


@query("SELECT o_orderkey, (CAST(o_orderstatus = 'F' AS INT) + CAST(o_totalprice > 150000 AS INT)) = 1 AS one, o_orderstatus <> 'F' OR o_totalprice >= 1000 AS branch, NOT (o_orderstatus = 'P') AS other FROM orders")
def schema_applicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("t")))
    f, p = {"properties": {"s": {"const": "F"}}}, {"properties": {"t": {"exclusiveMinimum": 150000}}}
    fits = lambda s: validation.is_valid(doc, s)
    return table(spark, sf_dir, "orders").select("o_orderkey", fits({"oneOf": [f, p]}).alias("one"), fits({"if": f, "then": {"properties": {"t": {"minimum": 1000}}}}).alias("branch"), fits({"not": {"properties": {"s": {"const": "P"}}}}).alias("other"))


@query("SELECT o_orderkey, count(l_linenumber) = count(DISTINCT l_quantity) AS uniq, count(l_linenumber) FILTER (l_quantity > 30) BETWEEN 1 AND 2 AS some, count(l_linenumber) >= 3 AS many FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def schema_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_join(J.json_path(F.col("doc"), "$.items[*].qty"), ",")
    doc = F.concat(F.lit("["), items, F.lit("]"))
    fits = lambda s: validation.is_valid(doc, s)
    return order_documents(spark, sf_dir).select("o_orderkey", fits({"uniqueItems": True}).alias("uniq"), fits({"contains": {"exclusiveMinimum": 30}, "maxContains": 2}).alias("some"), fits({"minItems": 3}).alias("many"))


@query("SELECT c_custkey, length(c_name) BETWEEN 1 AND 18 AND regexp_matches(c_name, '^Customer#[0-9]+$') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid FROM customer")
def schema_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"properties": {"c_name": {"type": "string", "minLength": 1, "maxLength": 18, "pattern": "^Customer#[0-9]+$"}, "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}}, "additionalProperties": False, "propertyNames": {"maxLength": 12}}
    return table(spark, sf_dir, "customer").select("c_custkey", validation.is_valid(F.to_json(F.struct("c_name", "c_mktsegment")), schema).alias("valid"))


@query("SELECT event_id, false AS closed, true AS opened FROM events")
def schema_unevaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = {"$defs": {"empty": {"properties": {"other": True}}}, "allOf": [{"$ref": "#/$defs/empty"}], "unevaluatedProperties": False}
    opened = {"$defs": {"k": {"properties": {"k": {"type": "integer"}}}}, "allOf": [{"$ref": "#/$defs/k"}], "unevaluatedProperties": False}
    return table(spark, sf_dir, "events").select("event_id", validation.is_valid(F.col("props"), closed).alias("closed"), validation.is_valid(F.col("props"), opened).alias("opened"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0 AS valid FROM events")
def schema_multiple_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", validation.is_valid(F.col("props"), {"properties": {"k": {"multipleOf": 7}}}).alias("valid"))


# -- addresses --------------------------------------------------------------------------------

B = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"


@query(f"""SELECT page_id, regexp_extract(url, {B}, 2) AS scheme, regexp_extract(url, {B}, 4) AS authority, regexp_extract(url, {B}, 5) AS path,
  CASE WHEN regexp_extract(url, {B}, 6) <> '' THEN regexp_extract(url, {B}, 7) END AS query, CASE WHEN regexp_extract(url, {B}, 8) <> '' THEN regexp_extract(url, {B}, 9) END AS fragment FROM pages""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = uri.parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", *(p[n].alias(n) for n in uri.PARTS))


@query(r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def uri_query_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uri.query_item(F.col("url"), "page").alias("page"), uri.query_item(F.col("url"), "ref").alias("ref"))


@query(f"SELECT page_id, regexp_extract(url, {B}, 1) || regexp_extract(url, {B}, 3) || '/x/y' AS rooted, regexp_extract(url, {B}, 1) || regexp_extract(url, {B}, 3) || regexp_extract(url, {B}, 5) || '?z' AS asked FROM pages")
def uri_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uri.resolved(F.lit("/x/./w/../y"), F.col("url")).alias("rooted"), uri.resolved(F.lit("?z"), F.col("url")).alias("asked"))


@query(f"SELECT page_id, lower(regexp_extract(url, {B}, 2)) || '://' || lower(regexp_extract(url, {B}, 4)) || regexp_extract(url, {B}, 5) || regexp_extract(url, {B}, 6) || regexp_extract(url, {B}, 8) AS url FROM pages")
def uri_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.upper(F.substring(F.col("url"), 1, 5)), F.expr("substring(url, 6)"))
    return table(spark, sf_dir, "pages").select("page_id", uri.normalized(u).alias("url"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, true AS valid, true AS fine FROM pages")
def hostname_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = uri.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), net.is_hostname(h).alias("valid"), uri.is_uri(F.col("url")).alias("fine"))


@query("SELECT c_custkey, true AS mail, false AS bare, c_custkey % 300 < 256 AS four FROM customer")
def net_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("c_name", F.lit("#"), F.lit("."))
    four = F.concat(F.lit("10.0.7."), (F.col("c_custkey") % 300).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", net.is_email(F.concat(name, F.lit("@example.com"))).alias("mail"), net.is_email(name).alias("bare"), net.is_ipv4(four).alias("four"))


@query("SELECT p_partkey, url_encode(p_name) AS encoded, p_name AS decoded FROM part")
def percent_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = uri.percent_encode(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", e.alias("encoded"), uri.percent_decode(e).alias("decoded"))


@query("SELECT p_partkey, 'http://x.org/' || url_encode(p_name) || '?size=' || CAST(p_size AS VARCHAR) || '&brand=' || url_encode(p_brand) AS url FROM part")
def uri_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", uri_template.expand("http://x.org/{name}{?size,brand}", name=F.col("p_name"), size=F.col("p_size"), brand=F.col("p_brand")).alias("url"))


# -- digests, encodings, ids ------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2 FROM documents")
def hash_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", hashing.digest(t, "md5").alias("m"), hashing.digest(t, "sha1").alias("s1"), hashing.digest(t, "sha256").alias("s2"))


@query()
def hash_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.hmac(F.col("text"), b"key", "sha256").alias("h2"), hashing.hmac(F.col("text"), b"key", "sha512").alias("h5"))


@query("SELECT doc_id, base64(encode(text)) AS b64, rtrim(translate(base64(encode(text)), '+/', '-_'), '=') AS url, hex(encode(text)) AS b16 FROM documents")
def base_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", encoding.encode(t, "base64").alias("b64"), encoding.encode(t, "base64url").alias("url"), encoding.encode(t, "base16").alias("b16"))


@query("SELECT p_partkey, true AS b32, true AS crockford, true AS b62, true AS qp, true AS zlib FROM part")
def encoding_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, data = F.col("p_name"), F.encode("p_name", "UTF-8")
    back = lambda kind: (encoding.decode(encoding.encode(n, kind), kind, strict=False) == data)
    return table(spark, sf_dir, "part").select("p_partkey", back("base32").alias("b32"), back("base32crockford").alias("crockford"), back("base62").alias("b62"), (encoding.unquoted_printable(encoding.quoted_printable(n)) == n).alias("qp"), (hashing.decompress(hashing.compress(n)) == data).alias("zlib"))


def _uuid_sql(digest: str, version: int) -> str:
    return f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-{version}' || substr({digest}, 14, 3) || '-' || translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"


@query(f"SELECT c_custkey, {_uuid_sql("md5(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name))", 3)} AS three, {_uuid_sql("sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name))", 5)} AS five FROM customer")
def uuid_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ids.uuid_v3(F.col("c_name"), "dns").alias("three"), ids.uuid_v5(F.col("c_name"), "dns").alias("five"))


@query("SELECT event_id, date_trunc('millisecond', ts) AS at, CAST(7 AS BIGINT) AS version, 'rfc' AS variant FROM events")
def uuid_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ids.uuid_v7(F.col("ts").cast("timestamp"), F.lpad(F.hex("event_id"), 16, "0"))
    return table(spark, sf_dir, "events").select("event_id", ids.timestamp(u).cast("timestamp_ntz").alias("at"), big(ids.version(u)).alias("version"), ids.variant(u).alias("variant"))


@query("SELECT c_custkey, '[' || repeat('*', length(c_name)) || ']' AS redacted, substr(sha256(c_name), 1, 16) AS obscured FROM customer")
def privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.private(F.col("c_name"), "private", "public").alias("redacted"), hashing.private(F.col("c_name"), "sensitive", "sensitive").alias("obscured"))


# -- time -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(isoyear(o_orderdate) AS BIGINT) AS year_of_week, CAST(week(o_orderdate) AS BIGINT) AS week_of_year, CAST(isodow(o_orderdate) AS BIGINT) AS day_of_week, CAST(dayofyear(o_orderdate) AS BIGINT) AS day_of_year,
  CAST(day(last_day(o_orderdate)) AS BIGINT) AS days_in_month, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days_since_epoch FROM orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tempo.components(F.col("o_orderdate").cast("date"))
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(big(c[n]).alias(n) for n in ("year_of_week", "week_of_year", "day_of_week", "day_of_year")), big(tempo.days_in_month(F.year(d), F.month(d))).alias("days_in_month"), big(c["days_since_epoch"]).alias("days_since_epoch"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS month_on, o_orderdate + INTERVAL 1 YEAR + INTERVAL 20 DAY AS later FROM orders")
def calendar_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", tempo.add_calendar(d, months=1).alias("month_on"), tempo.add_calendar(d, years=1, days=20).alias("later"))


@query("SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS local, CAST(epoch(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') - epoch(ts) AS BIGINT) AS offset_s FROM events")
def zone_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tempo.to_zone(F.col("ts"), "America/New_York").alias("local"), big(tempo.zone_offset(F.col("ts"), "America/New_York")).alias("offset_s"))


@query("SELECT event_id, ts AS utc FROM events")
def zone_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = tempo.to_zone(F.col("ts"), "Asia/Tokyo")
    return table(spark, sf_dir, "events").select("event_id", tempo.resolve(local, "Asia/Tokyo", "reject", "latest").alias("utc"))


@query("""SELECT event_id, CAST(us // 3600000000 AS BIGINT) AS hours, CAST(us // 60000000 % 60 AS BIGINT) AS minutes, CAST(us % 1000000 AS BIGINT) AS micros FROM (SELECT event_id, abs(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)) AS us FROM events)""")
def duration_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tempo.between(F.col("ts"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", tempo.total(d, "hours").alias("hours"), tempo.component(d, "minutes", "hours").alias("minutes"), tempo.component(d, "microseconds", "seconds").alias("micros"))


@query("SELECT o_orderkey, o_orderdate AS parsed, strftime(o_orderdate, '%H:%M:%S') AS clock FROM orders")
def time_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")
    clock = tempo.format_time(tempo.parse_time(F.date_format(d, "HH:mm:ss")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tempo.instant_of(tempo.parse_offset_datetime(F.concat(text, F.lit("Z")))).alias("parsed"), clock.alias("clock"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_shipdate + to_months(13) + to_days(3) + to_hours(4) AS due, 'P1Y1M3DT4H' AS period FROM lineitem")
def period_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tempo.parse_period(F.lit("P1Y1M3DT4H"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", big(F.col("l_linenumber")).alias("line"), tempo.add_period(F.col("l_shipdate"), p).alias("due"), tempo.describe_period(p).alias("period"))


@query()
def zone_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tempo.zone_detail(F.col("ts"), "Europe/Berlin")
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).select("event_id", "d.designation", "d.standard_offset_s", "d.saving_s", "d.next_transition")


# -- numbers ----------------------------------------------------------------------------------

DEC = "CAST(l_extendedprice AS DECIMAL(12,2))"


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(round({DEC}, 0) AS DOUBLE) AS away, CAST(ceil({DEC}) AS DOUBLE) AS up, CAST(floor({DEC}) AS DOUBLE) AS down, CAST(trunc({DEC}) AS DOUBLE) AS cut, CAST(CASE WHEN abs({DEC} % 1) = 0.5 THEN 2 * round({DEC} / 2, 0) ELSE round({DEC}, 0) END AS DOUBLE) AS even FROM lineitem")
def round_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice").cast("decimal(12,2)")
    r = lambda rule: numeric.rounded(v, 0, rule).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", big(F.col("l_linenumber")).alias("line"), r("nearest_or_away").alias("away"), r("up").alias("up"), r("down").alias("down"), r("toward_zero").alias("cut"), r("nearest_or_even").alias("even"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(lcm(l_partkey, l_suppkey) AS BIGINT) AS l, CASE WHEN l_suppkey = 0 THEN l_partkey = 0 ELSE l_partkey % nullif(l_suppkey, 0) = 0 END AS multiple FROM lineitem")
def gcd_lcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", big(F.col("l_linenumber")).alias("line"), big(numeric.gcd(a, b)).alias("g"), big(numeric.lcm(a, b)).alias("l"), numeric.is_multiple(a, b).alias("multiple"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey & l_suppkey AS BIGINT) AS both, CAST(l_partkey | l_suppkey AS BIGINT) AS either, CAST(xor(l_partkey, l_suppkey) AS BIGINT) AS one, CAST(l_partkey << 3 AS BIGINT) AS up, CAST(l_partkey >> 2 AS BIGINT) AS down, CAST(CASE WHEN l_partkey = 0 THEN 0 ELSE length(bin(l_partkey)) END AS BIGINT) AS width FROM lineitem")
def bit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", big(F.col("l_linenumber")).alias("line"), a.bitwiseAND(b).alias("both"), a.bitwiseOR(b).alias("either"), a.bitwiseXOR(b).alias("one"), numeric.shift_left(a, 3).alias("up"), numeric.shift_right(a, 2).alias("down"), big(numeric.bit_width(a)).alias("width"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS VARCHAR) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def decimal_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(3,0)") - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(price).cast("decimal(38,4)").cast("string").alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 1000000007 * 1000000009 AS VARCHAR) AS product, CAST(CAST(o_custkey AS HUGEINT) * CAST(o_custkey AS HUGEINT) * CAST(o_custkey AS HUGEINT) AS VARCHAR) AS cube, CAST(o_orderkey // 7 AS VARCHAR) AS quotient FROM orders")
def big_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = numeric.big("multiply", numeric.big("multiply", F.col("o_orderkey"), F.lit("1000000007")), F.lit("1000000009"))
    return table(spark, sf_dir, "orders").select("o_orderkey", product.alias("product"), numeric.big("power", F.col("o_custkey"), F.lit("3")).alias("cube"), numeric.big("quotient", F.col("o_orderkey"), F.lit("7")).alias("quotient"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) % 7 AS DOUBLE) AS rest, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) = l_quantity AS whole FROM lineitem")
def decimal_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", big(F.col("l_linenumber")).alias("line"), numeric.truncating_remainder(v, F.lit(7).cast("decimal(3,0)")).cast("double").alias("rest"), numeric.is_integer(F.col("l_quantity")).alias("whole"))


# The catalogue's other modules register theirs here as well.
from marlstone import catalog_documents, catalog_functions  # noqa: E402, F401
