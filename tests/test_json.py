"""Paths, pointers, CBOR and schemas."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions.uri_template import Template
from marlstone.operators import json as J
from marlstone.operators import validation
from marlstone.operators.pointer import Pointer, RelativePointer, get, put
from marlstone.operators.values import NOTHING
from marlstone.plans import schema as S
from marlstone.plans.jsonpath import Function, Path, PathError, normalized
from marlstone.plans.path_columns import Unsupported, compile_nodes
from marlstone.sources import cbor

DOCS = [{"a": [{"b": 1, "c": "x"}, {"b": 5.50}, {"b": 7, "c": "xyz"}, 3, None], "o": {"k-1": True, "z": [1, 2, 3]}, "n": None}, {"a": 5}, {"a": {"x": {"b": 9}}, "n": [[1, 2], [3]]}]
PATHS = ["$.a[*].b", "$.a[?@.b>1].b", "$.a[-1]", "$.a[::2]", "$.a[::-1]", "$.a[-3:-1]", "$['o']['k-1']", "$.a[?length(@.c)==3]", "$.a[?match(@.c,'x.*')]", "$.a[?!@.c]", "$.n", "$.a[?@.b==$.a[0].b]", "$.a[0,0]", "$.a[?count(@.*)==2 && (@.b<6 || @.c=='xyz')]", "$.a[?@.q==@.r]", "$.a[1:3:0]", "$.n[*][0]", "$..b", "$.a[?@==null]", "$.a[?@.b>=5.5]", "$.n[?@[0]>1]", "$.a[?@.b!=1]", "$.a[?!(@.b>1)]"]


def test_expressions_give_what_the_evaluator_gives(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(9, None), (10, "{bad")]
    df = spark.createDataFrame(rows, "id int, t string")
    for row in df.select("id", *(J.json_path(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(PATHS))).collect():
        for i, p in enumerate(PATHS):
            want = Path(p).values(DOCS[row["id"]]) if row["id"] < 3 else []
            assert [json.loads(x) for x in row[f"p{i}"]] == want, p
    with pytest.raises(Unsupported):
        compile_nodes("$..b", F.lit(None))


@pytest.mark.parametrize("bad", ["$.", "a", "$.a[", "$[?1]", "$[?length(@)]", "$[?@..a==1]", "$[?foo(@)]", "$ ", "$[01]", "$[?count(1)]", "$['\\x']"])
def test_malformed_paths(bad):
    with pytest.raises(PathError):
        Path(bad)


def test_own_functions_and_places(spark):
    double = Function(("value",), "value", lambda v: v * 2 if isinstance(v, (int, float)) else NOTHING)
    assert Path("$.a[?double(@.b) == 14].c", {"double": double}).values(DOCS[0]) == ["xyz"]
    assert [normalized(at) for _, at in Path("$..z[0]").nodes(DOCS[0])] == ["$['o']['z'][0]"]
    assert str(Pointer.of_path("$['a'][0]['~/']")) == "/a/0/~0~1" and Pointer.of_path("$..a") is None
    df = spark.createDataFrame([(1, json.dumps(DOCS[0])), (2, None)], "id int, t string")
    assert [tuple(r) for r in J.json_nodes(df, "t", "$.o.z[::-1]", ["id"]).collect()] == [(1, 0, "$['o']['z'][2]", "3"), (1, 1, "$['o']['z'][1]", "2"), (1, 2, "$['o']['z'][0]", "1")]


def test_pointers(spark):
    d = {"a": [1, {"b": None}], "": 2, "m~n": 3, "x/y": 4}
    for p, v in {"": d, "/a/0": 1, "/a/1/b": None, "/": 2, "/m~0n": 3, "/x~1y": 4, "/a/5": NOTHING, "/a/-": NOTHING, "/a/01": NOTHING}.items():
        assert Pointer.parse(p).get(d) == v or Pointer.parse(p).get(d) is v
        assert Pointer.parse(p).encoded == p
    assert Pointer.parse("/a/-").put(d, 9)["a"] == [1, {"b": None}, 9] and d["a"] == [1, {"b": None}]
    assert Pointer.parse("/a/0").put(d, NOTHING)["a"] == [{"b": None}]
    assert str(RelativePointer.parse("1/x").apply(Pointer.parse("/a/b"))) == "/a/x"
    assert str(RelativePointer.parse("0#").apply(Pointer.parse("/a/b"))) == "/a/b"
    df = spark.createDataFrame([(json.dumps(d),)], "t string")
    r = df.select(F.to_json(get(J.parse(F.col("t")), "/a/1")).alias("g"), put(F.col("t"), "/a/0", None).alias("p")).first()
    assert r["g"] == '{"b":null}' and json.loads(r["p"])["a"] == [{"b": None}]


def test_cbor(spark):
    from decimal import Decimal

    known = {"00": 0, "1818": 24, "1b000000e8d4a51000": 10**12, "c249010000000000000000": 2**64, "3bffffffffffffffff": -(2**64), "c349010000000000000000": -(2**64) - 1, "20": -1, "3863": -100, "f93c00": 1.0, "fb3ff199999999999a": 1.1, "f97bff": 65504.0, "fa47c35000": 100000.0, "f4": False, "f6": None, "4401020304": b"\1\2\3\4", "6449455446": "IETF", "83010203": [1, 2, 3], "a26161016162820203": {"a": 1, "b": [2, 3]}, "c48221196ab3": Decimal("273.15")}
    for h, v in known.items():
        assert cbor.decode(bytes.fromhex(h)) == v
        assert cbor.encode(v).hex() == h
    assert cbor.decode(bytes.fromhex("9f018202039f0405ffff")) == [1, [2, 3], [4, 5]]
    df = spark.createDataFrame([('{"b":[1.50,-3],"a":null}',), (None,), ("{",)], "t string")
    assert [r[0] for r in df.select(cbor.from_cbor(cbor.to_cbor(F.col("t")))).collect()] == ['{"a":null,"b":[1.50,-3]}', None, None]


TREE = {"$id": "http://x/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"data": True, "children": {"type": "array", "items": {"$dynamicRef": "#node"}}}}
STRICT = {"$id": "http://x/strict", "$dynamicAnchor": "node", "$ref": "tree", "unevaluatedProperties": False}
IF = {"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}
VALID = [
    ({"type": "integer"}, 1.0, True),
    ({"$ref": "#/$defs/a", "$defs": {"a": {"type": "string"}}}, 1, False),
    ({"properties": {"a": True}, "unevaluatedProperties": False, "allOf": [{"properties": {"b": True}}]}, {"a": 1, "b": 2}, True),
    ({"properties": {"a": True}, "unevaluatedProperties": False, "allOf": [{"properties": {"b": True}}]}, {"a": 1, "c": 2}, False),
    ({"prefixItems": [{"type": "string"}], "unevaluatedItems": False}, ["a", 1], False),
    ({"contains": {"type": "string"}, "unevaluatedItems": False}, ["a", "b"], True),
    (IF, {"a": 1}, False),
    (IF, {"c": 1}, True),
    ({"uniqueItems": True}, [1, 1.0], False),
    ({"uniqueItems": True}, [1, True], True),
    ({"multipleOf": 0.01}, 0.0075, False),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, 3, False),
    ({"minContains": 0, "contains": False}, [1], True),
    ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"a": 1}, False),
    ({"patternProperties": {"^x": {"type": "number"}}, "additionalProperties": False}, {"x1": 1, "y": 2}, False),
    ({"propertyNames": {"maxLength": 2}}, {"abc": 1}, False),
    ({"items": {"enum": [1, "a", None]}, "minItems": 2}, [1, None], True),
    ({"not": {"type": "string"}, "anyOf": [{"minimum": 3}, {"type": "null"}]}, None, True),
]


@pytest.mark.parametrize(("schema", "value", "want"), VALID)
def test_validator(schema, value, want):
    assert S.Schema(schema).is_valid(value) is want


def test_validation_columns(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (_, v, _) in enumerate(VALID)], "i int, t string")
    out = df.select("i", *(validation.is_valid(F.col("t"), s).alias(f"v{k}") for k, (s, _, _) in enumerate(VALID))).collect()
    for r in out:
        assert r[f"v{r['i']}"] is VALID[r["i"]][2], VALID[r["i"]]
        for k, (s, _, _) in enumerate(VALID):
            assert r[f"v{k}"] is S.Schema(s).is_valid(VALID[r["i"]][1]), (s, VALID[r["i"]][1])


def test_references_formats_and_output():
    assert not S.Schema(STRICT, {"http://x/tree": TREE}).is_valid({"children": [{"daat": 1}]})
    assert S.Schema(STRICT, {"http://x/tree": TREE}).is_valid({"children": [{"data": 1}]})
    strict = S.Options(assert_formats=True)
    for name, good, bad in (("date-time", "1998-12-31T23:59:60Z", "1998-12-31T22:59:60Z"), ("duration", "P1Y", "P"), ("email", "a@b", "a"), ("hostname", "a.b", "-a"), ("ipv6", "::1", "1"), ("uri", "http://a/", "/a"), ("iri", "http://é/", "é{"), ("uri-template", "{a}", "{a"), ("json-pointer", "/a~0", "a"), ("relative-json-pointer", "1#", "-1"), ("regex", "a+", "(a"), ("uuid", "6fa459ea-ee8a-3ca4-894e-db77e160355e", "x"), ("time", "12:00:00Z", "12:00:00")):
        assert S.Schema({"format": name}, options=strict).is_valid(good) and not S.Schema({"format": name}, options=strict).is_valid(bad)
        assert S.Schema({"format": name}).is_valid(bad)
    unit = S.Schema({"properties": {"a": {"type": "string", "minLength": 2}}, "required": ["b"]}).validate({"a": "x"})
    assert {e["keywordLocation"] for e in S.basic(unit)} == {"/properties", "/properties/a/minLength", "/required"}
    assert len(S.detailed(unit)["errors"]) == 2 and S.verbose(unit)["valid"] is False
    with pytest.raises(S.SchemaError):
        S.Schema({"type": "text"})


def test_templates():
    v = {"var": "value", "hello": "Hello World!", "path": "/foo/bar", "list": ["red", "green", "blue"], "keys": {"semi": ";", "dot": ".", "comma": ","}, "x": "1024", "y": "768", "empty": "", "undef": None}
    known = {"{var}": "value", "{hello}": "Hello%20World%21", "{+path}/here": "/foo/bar/here", "{#x,hello,y}": "#1024,Hello%20World!,768", "X{.list*}": "X.red.green.blue", "{/var:1,var}": "/v/value", "{;x,y,empty}": ";x=1024;y=768;empty", "{?x,y,empty}": "?x=1024&y=768&empty=", "{&list*}": "&list=red&list=green&list=blue", "{?keys*}": "?comma=%2C&dot=.&semi=%3B", "{keys}": "comma,%2C,dot,.,semi,%3B", "{?undef,y}": "?y=768", "{var:3}": "val", "{+keys}": "comma,,,dot,.,semi,;"}
    for t, want in known.items():
        assert Template(t).expand(v) == want
    assert Template("{?x,undef}{undef}").expand(v, partial=True) == "?x=1024{&undef}{undef}"


def test_stream_and_batch_agree(spark, tmp_path):
    from marlstone.streaming.validate import split_stream, validated

    df = spark.createDataFrame([(i, json.dumps({"k": i})) for i in range(20)], "id int, t string")
    df.write.parquet(f"{tmp_path}/in")
    schema = {"properties": {"k": {"minimum": 7}}}
    stream = spark.readStream.schema("id int, t string").parquet(f"{tmp_path}/in")
    split_stream(stream, "t", schema, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state").awaitTermination()
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/good").collect()} == {r["id"] for r in validated(df, "t", schema).where("valid").collect()} == set(range(7, 20))
