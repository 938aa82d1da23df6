"""Numbers of any size, odd texts and deep values: expressions and the Python evaluator agree, and no row stops a job."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.functions import ids, net, numeric, tempo, uri
from marlstone.operators import json as J
from marlstone.operators import pointer, relational, validation
from marlstone.operators.values import read, write
from marlstone.plans import schema as S
from marlstone.plans.jsonpath import Path
from marlstone.sources import cbor

SCHEMAS = [
    {"minimum": 1},
    {"exclusiveMinimum": 0},
    {"maximum": 1e30},
    {"exclusiveMaximum": 0.1},
    {"multipleOf": 1e-7},
    {"multipleOf": 0.01},
    {"multipleOf": 3},
    {"type": "integer"},
    {"enum": [1, 0.5, "1", None, True, 1e-400 if False else 1e-30]},
    {"const": 100},
    {"type": ["string", "null"]},
]
PATHS = ["$[?@ == 0]", "$[?@ == 0.0000000000000001]", "$[?@ > 1e30]", "$[?@ >= 1]", "$[?@ < 0.1]", "$[?@ != 100]", "$[?@ <= -5]", "$[?@ == 'a']", "$[?@ >= 'a']", "$[?@ == true]", "$[?@ <= null]", "$[?match(@, 'a')]"]


def numbers(n=160, seed=5):
    rng = random.Random(seed)
    out = ["0", "-0", "1", "1.0", "1e0", "100", "1E2", "0.1", "1e-1", "1e30", "1e400", "1e-400", "-1e400", "1e-13", "0.0000000000000001", "1e-7", "3e-7", "123456789012345678901234567890.5", "9" * 40, "1" + "0" * 5000]
    for _ in range(n):
        digits = str(rng.randint(1, 10 ** rng.randint(1, 25)))
        if rng.random() < 0.5:
            at = rng.randint(0, len(digits))
            digits = (digits[:at].lstrip("0") or "0") + "." + (digits[at:] or "0")
        if rng.random() < 0.4:
            digits += f"e{rng.randint(-400, 400)}"
        out.append(rng.choice(["", "-"]) + digits)
    return out


def test_schemas_of_any_number(spark):
    values = [*numbers(), '"a"', '"1"', "null", "true", "[1,1e0]", '{"a":1}', '"a\\n"', '"\\u0041"']
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    wrapped = F.concat(F.lit('{"m":'), "t", F.lit("}"))
    tests = [(f"v{k}", F.col("t"), s) for k, s in enumerate(SCHEMAS)] + [(f"m{k}", wrapped, {"properties": {"m": s}}) for k, s in enumerate(SCHEMAS)]
    for r in df.select("i", *(validation.is_valid(t, s).alias(n) for n, t, s in tests)).collect():
        for k, s in enumerate(SCHEMAS):
            want = S.Schema(s).is_valid(read(values[r["i"]]))
            assert r[f"v{k}"] is want and r[f"m{k}"] is want, (values[r["i"]][:50], s, want)


def test_unique_items_by_value(spark):
    rows = ["[1, 1e0]", "[1, 1.0]", "[1, 2]", "[[1.50], [1.5]]", "[[1.5], [2.5]]", '[{"a": 1.0}, {"a": 1}]', "[0.10, 0.1]", '["a", "\\u0061"]', "[1, true]"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(validation.is_valid(F.col("t"), {"uniqueItems": True})).collect()]
    assert got == [S.Schema({"uniqueItems": True}).is_valid(read(r)) for r in rows] == [False, False, True, False, True, False, False, False, True]


def test_paths_over_any_number(spark):
    values = [f"[{x}]" for x in numbers(seed=6)] + ['["a"]', '["a\\n"]', "[null]", "[true]", "[[1]]", '["b", "Z"]']
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    for r in df.select("i", *(J.json_path(F.col("t"), p).alias(f"p{k}") for k, p in enumerate(PATHS)), *(J.json_count(F.col("t"), p).alias(f"n{k}") for k, p in enumerate(PATHS))).collect():
        for k, p in enumerate(PATHS):
            want = Path(p).values(read(values[r["i"]]))
            assert [read(x) for x in r[f"p{k}"]] == want and r[f"n{k}"] == len(want), (values[r["i"]][:50], p)


def test_odd_texts_stop_nothing(spark):
    deep = lambda n: "[" * n + "]" * n
    rows = [deep(20_000), deep(900), deep(1001), '{"a":' * 700 + "1" + "}" * 700, '{"a": 1, "a": 2}', "{", "", "nul", '{"a": 1} ]', None, "9" * 6000]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    t = F.col("t")
    schema = {"properties": {"a": {"const": 2}}}
    strict = {**schema, "unevaluatedProperties": False}
    out = df.select("i", validation.is_valid(t, schema).alias("v"), validation.is_valid(t, strict).alias("u"), J.json_path(t, "$.a").alias("p"), J.json_path(t, "$..a").alias("d"), validation.output(t, schema).alias("o"), J.path_error(t, "$.a").alias("e"), cbor.to_cbor(t).alias("c"), pointer.put(t, "/b", F.lit("1")).alias("w")).orderBy("i").collect()
    assert [r["v"] for r in out] == [False, True, False, False, True, False, False, False, False, None, True]
    assert out[4]["p"] == ["2"] and out[4]["d"] == ["2"] and out[4]["u"] is True
    assert [bool(r["e"]) for r in out] == [True, False, True, False, False, True, True, True, False, False, False]
    assert len(out[3]["d"]) == 700 and out[9]["v"] is None
    broken = validation.violations(df, "t", schema, ["i"]).collect()
    assert {r["i"] for r in broken} == {0, 2, 3, 5, 6, 7, 8}
    assert J.json_nodes(df, "t", "$..a", ["i"]).count() > 700


def test_texts_that_end_in_a_line_feed(spark):
    from marlstone.plans import formats

    good = {"ipv4": "1.2.3.4", "ipv6": "::1", "hostname": "a.b", "email": "a@b.c", "uuid": "6fa459ea-ee8a-3ca4-894e-db77e160355e", "uri": "http://a/b", "json-pointer": "/a", "date": "2024-01-01", "duration": "P1D", "time": "12:00:00Z", "date-time": "2024-01-01T00:00:00Z", "uri-template": "{a}", "relative-json-pointer": "1/a"}
    for name, text in good.items():
        assert formats.CHECKS[name](text) and (name in ("uri-template", "json-pointer", "relative-json-pointer") or not formats.CHECKS[name](text + "\n")), name
    df = spark.createDataFrame([(t,) for t in [*good.values(), *(t + "\n" for t in good.values())]], "t string")
    t = F.col("t")
    checks = [net.is_ipv4(t), net.is_ipv6(t), net.is_hostname(t), net.is_email(t), ids.is_uuid(t), uri.is_uri(t), tempo.parse_date(t).isNotNull(), tempo.parse_datetime(t).isNotNull(), tempo.parse_period(t).isNotNull(), tempo.parse_offset_datetime(t).isNotNull()]
    for r in df.select("t", *(c.alias(f"c{i}") for i, c in enumerate(checks))).collect():
        if r["t"].endswith("\n"):
            assert not any(r[f"c{i}"] for i in range(len(checks))), r
    one = spark.createDataFrame([('["a\\n", "a"]',)], "t string")
    assert one.select(J.json_path(F.col("t"), "$[?match(@, 'a')]")).first()[0] == ['"a"']
    assert one.select(validation.is_valid(F.lit('"a\\n"'), {"pattern": "^a$"})).first()[0] is S.Schema({"pattern": "^a$"}).is_valid("a\n") is False


def test_multiples():
    for a, b, want in (("1e400", "1e-400", True), ("1e-400", "1e400", False), ("0.3", "0.1", True), ("7", "2", False), ("0", "5", True), ("1e6", "7", False), ("14e5", "7", True), ("5", "0", False)):
        assert S.is_multiple(Decimal(a), Decimal(b)) is want


def test_vocabularies_locators_and_annotations():
    words = {f"https://json-schema.org/draft/2020-12/vocab/{w}": True for w in ("core", "applicator", "format-assertion")}
    meta = {"$id": "http://x/meta", "$vocabulary": words}
    schema = {"$schema": "http://x/meta", "properties": {"a": {"format": "date", "maxLength": 1}}}
    assert S.Schema(schema, {"http://x/meta": meta}).is_valid({"a": "2024-01-01"})
    assert not S.Schema(schema, {"http://x/meta": meta}).is_valid({"a": "2024-13-01"})
    with pytest.raises(S.SchemaError):
        S.Schema({"$schema": "http://x/m"}, {"http://x/m": {"$vocabulary": {"http://x/unknown": True}}})
    asked = []
    chain = S.Options(locators=(lambda u: asked.append(u), lambda u: {"type": "integer"} if u == "http://x/i" else None))
    assert not S.Schema({"$ref": "http://x/i"}, options=chain).is_valid("a") and asked == ["http://x/i"]
    with pytest.raises(S.SchemaError):
        S.Schema({"$ref": "http://x/j"}, options=chain).is_valid(1)
    titled = {"title": "t", "description": "d"}
    shown = lambda a: [e["annotation"] for e in S.basic(S.Schema(titled, options=S.Options(annotations=a)).validate(1))]
    assert shown("all") == ["t", "d"] and shown("none") == [] and shown(frozenset(["title"])) == ["t"]


def test_decimal_styles(spark):
    cases = [("1234567.891", {}, "1,234,567.891"), ("-0.5", {"fraction": (2, 2)}, "-0.50"), ("2.345", {"fraction": (0, 2)}, "2.35"), ("-7", {"sign": "never"}, "7"), ("7", {"sign": "always", "point": "always"}, "+7."), ("1234.5", {"point": "never"}, "1,234"), ("0.00123456", {"significant": (1, 3)}, "0.00123"), ("12345", {"significant": (1, 2), "grouping": False}, "12000"), ("1234.5", {"separators": (".", ",")}, "1.234,5"), ("nan", {}, "NaN"), ("-inf", {}, "-∞"), ("0", {"sign": "always", "fraction": (1, 3)}, "0.0"), ("x", {}, None)]
    one = spark.range(1)
    assert [r for c in one.select(*(numeric.formatted(F.lit(t), **o).alias(f"c{i}") for i, (t, o, _) in enumerate(cases))).collect() for r in c] == [w for _, _, w in cases]
    assert str(numeric.pi(50)) == "3.1415926535897932384626433832795028841971693993751" and str(numeric.e(30)) == "2.71828182845904523536028747135"


def test_a_repeated_batch_writes_no_row_twice(spark, tmp_path):
    from marlstone.streaming import validate

    calls = []

    class Stream:
        def __getattr__(self, name):
            return lambda *a, **k: (calls.append(a[0]) if name == "foreachBatch" else None, self)[1]

    class Rows:
        writeStream = Stream()

    validate.split_stream(Rows(), "t", {"type": "integer"}, f"{tmp_path}/good", f"{tmp_path}/bad", "x")
    batch = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    for number in (0, 0, 1):
        calls[0](batch, number)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2 and spark.read.parquet(f"{tmp_path}/bad").count() == 4


def test_clocks_and_own_aggregates(spark):
    snap = tempo.Clock().snapshot()
    r = spark.range(1).select(snap.now().alias("a"), snap.now().alias("b"), tempo.Clock().now().alias("c")).first()
    assert r["a"] == r["b"] and abs((r["c"] - r["a"]).total_seconds()) < 120
    df = spark.createDataFrame([(i % 3, i) for i in range(1000)], "k int, x bigint")
    median = relational.Aggregate(list, lambda s, x: [*s, x], lambda a, b: a + b, lambda s: float(sorted(s)[len(s) // 2]), "double")
    got = {r["k"]: r["m"] for r in relational.aggregate(df, ["k"], F.col("x"), median, "m", most_groups=2).collect()}
    assert got == {k: float([i for i in range(1000) if i % 3 == k][len([i for i in range(1000) if i % 3 == k]) // 2]) for k in range(3)}
    assert relational.aggregate(df.limit(0), ["k"], F.col("x"), median, "m").count() == 0


def test_values_are_written_as_they_were_read():
    for text in ("1e400", "0.10", "12345678901234567890123456789012345678901234567890", '"\\u0000\\u001f/\\\\"', '{"a":[true,null]}'):
        assert read(write(read(text))) == read(text)
    assert json.loads(write({"a": 'x"\n'})) == {"a": 'x"\n'}
