"""Validating rows against a JSON Schema.

`rules` compiles the keywords whose outcome an expression can give into expressions over a
VARIANT, one for each keyword of the root and of its members; `is_valid` uses them if they cover
the schema, else the validator in one vectorised function. `violations` gives a row per error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.json import UNSURE, parse, routed
from marlstone.operators.values import read, write
from marlstone.plans import schema as S
from marlstone.plans.jsonpath import i_regexp, pattern
from marlstone.plans.path_columns import NUMBER, Unsupported, bind, fitting, kind_is
from marlstone.plans.path_columns import _member as member_of

class Uncovered(ValueError):
    """A schema with keywords that have no expression."""


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", NUMBER)


def _literal(value: Any) -> Column:
    try:
        return fitting(value)
    except Unsupported as e:
        raise Uncovered(str(e)) from None


def _count(value: Any) -> Column:
    """A limit of sizes, which may be written as 2.0 or 1e9."""
    return F.lit(min(int(Decimal(str(value)).to_integral_value(ROUND_CEILING)), 1 << 40))


def _true(test: Column) -> Column:
    return test.eqNullSafe(F.lit(True))


class _Place:
    """A bound VARIANT that a schema is held against, and a bound text that tells its kind.

    For a member or item that is its JSON as the engine writes it, which tells numbers, texts and
    words as well; for a whole document, whose text may be written in other ways, its first letter.
    """

    def __init__(self, v: Column, told: Column, whole: bool = False):
        self.v, self.told, self.whole = v, told, whole

    def kind(self, name: str) -> Column:
        if name == "bytes":
            return F.lit(False)  # JSON has none
        letters = {"object": "{", "array": "[", "string": '"', "bool": "tf", "null": "n", "number": "-0123456789"}[name]
        return self.told.startswith(letters) if len(letters) == 1 else F.substring(self.told, 1, 1).isin(*letters)

    @property
    def number(self) -> Column:
        """The number, or null for any other kind."""
        return F.when(self.kind("number"), _number(self.v)) if self.whole else self.told.try_cast(NUMBER)

    @property
    def text(self) -> Column:
        return F.try_variant_get(self.v, "$", "string")

    def of_type(self, name: str) -> Column:
        if name == "integer":
            return bind(self.number, lambda n: n == F.floor(n))
        return self.kind({"boolean": "bool"}.get(name, name))

    def same_scalar(self, value: Any) -> Column:
        if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
            return self.number == _literal(value)
        if value is not None and not isinstance(value, (bool, str)):
            raise Uncovered("const of an array or object")
        if not self.whole:
            return self.told == write(value)
        if value is None:
            return self.kind("null")
        return self.kind("bool") & (F.try_variant_get(self.v, "$", "boolean") == value) if isinstance(value, bool) else self.kind("string") & (self.text == value)

    def enumerated(self, values: list) -> Column:
        """One of several values; texts and words among them are looked for together."""
        plain = [] if self.whole else [x for x in values if x is None or isinstance(x, (bool, str))]
        tests = [_true(self.same_scalar(x)) for x in values if not any(x is p for p in plain)]
        if plain:
            tests.append(_true(self.told.isin(*map(write, plain))))
        return _fold(tests, False)

    def members(self) -> Column:
        return F.when(self.kind("object"), F.try_variant_get(self.v, "$", "map<string,variant>"))

    def member(self, name: str) -> Column:
        return member_of(self.v, name)


def _of_text(v: Column, text: Column, f: Callable[[_Place], Column]) -> Column:
    """f of a whole document's place."""
    first = F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1)
    return bind(first, lambda k: f(_Place(v, k, whole=True)))


def _fold(tests: list[Column], every: bool) -> Column:
    if not tests:
        return F.lit(every)
    out = tests[0]
    for t in tests[1:]:
        out = out & t if every else out | t
    return out


def _holds(schema: Any, place: _Place) -> Column:
    """Whether a place fits; true or false, never null."""
    return F.lit(schema) if isinstance(schema, bool) else _fold([t for _, t in rules(schema, place)], True)


def _compile(schema: Any, v: Column) -> Column:
    """Whether a VARIANT that is not null fits; it and its JSON are bound, so each is found once."""
    if isinstance(schema, bool):
        return F.lit(schema)
    return bind(v, lambda x: bind(F.to_json(x), lambda t: _holds(schema, _Place(x, t))))


def _member_fits(schema: Any, v: Column) -> Column:
    """Whether a member or item is not there, or fits."""
    if isinstance(schema, bool):
        return F.lit(True) if schema else v.isNull()
    return bind(v, lambda x: x.isNull() | bind(F.to_json(x), lambda t: _holds(schema, _Place(x, t))))


LIMITS: dict[str, tuple[str, str]] = {"minimum": ("number", "__ge__"), "maximum": ("number", "__le__"), "exclusiveMinimum": ("number", "__gt__"), "exclusiveMaximum": ("number", "__lt__"), "minLength": ("string", "__ge__"), "maxLength": ("string", "__le__"), "minItems": ("array", "__ge__"), "maxItems": ("array", "__le__"), "minProperties": ("object", "__ge__"), "maxProperties": ("object", "__le__")}


def rules(schema: Any, place: _Place) -> list[tuple[str, Column]]:
    """(keyword, whether it holds) of each asserting keyword of a schema. Raises Uncovered."""
    v = place.v
    items = F.try_variant_get(v, "$", "array<variant>")
    out: list[tuple[str, Column]] = []

    def rule(word: str, of: str | None, test: Column) -> None:
        out.append((word, _true(test) if of is None else ~_true(place.kind(of)) | _true(test)))

    def each(sub: Any) -> Callable[[Column], Column]:
        return lambda x: _compile(sub, x)

    for word, value in schema.items():
        if word in LIMITS:
            of, op = LIMITS[word]
            measure = {"number": lambda: place.number, "string": lambda: F.char_length(place.text), "array": lambda: F.size(items), "object": lambda: F.size(place.members())}[of]()
            limit = _literal(value) if of == "number" else _count(value) if op == "__ge__" else F.lit(int(Decimal(str(value)).to_integral_value(ROUND_FLOOR)))
            rule(word, of, getattr(measure, op)(limit))
        elif word == "type":
            rule(word, None, _fold([_true(place.of_type(n)) for n in ([value] if isinstance(value, str) else value)], False))
        elif word in ("enum", "const"):
            rule(word, None, place.enumerated(value if word == "enum" else [value]))
        elif word == "multipleOf":
            rule(word, "number", F.lit(False) if value == 0 else place.number % _literal(value) == 0)
        elif word == "pattern":
            rule(word, "string", F.lit(False) if pattern(value) is None else place.text.rlike(i_regexp(value)))
        elif word == "required":
            rule(word, "object", _fold([place.member(n).isNotNull() for n in value], True))
        elif word == "dependentRequired":
            for n, needs in value.items():
                rule(word, "object", place.member(n).isNull() | _fold([place.member(m).isNotNull() for m in needs], True))
        elif word == "properties":
            for n, s in value.items():
                # What is no object has no such member.
                out.append((f"{word}/{n}", _true(_member_fits(s, place.member(n)))))
        elif word == "additionalProperties" and value is False:
            known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
            rest = F.array_except(F.map_keys(place.members()), known)
            for p in schema.get("patternProperties", {}):
                rest = F.filter(rest, _unlike(p))
            rule(word, "object", F.size(rest) == 0)
        elif word == "patternProperties":
            for p, s in value.items():
                rule(word, "object", F.forall(F.map_entries(place.members()), _fits(p, s)))
        elif word == "propertyNames":
            rule(word, "object", _names(F.map_keys(place.members()), value))
        elif word == "items":
            start = len(schema.get("prefixItems", []))
            rule(word, "array", F.forall(F.slice(items, F.lit(start + 1), F.greatest(F.size(items) - start, F.lit(0))), each(value)))
        elif word == "prefixItems":
            for i, s in enumerate(value):
                rule(f"{word}/{i}", "array", _member_fits(s, F.get(items, F.lit(i))))
        elif word == "contains":
            n = F.size(F.filter(items, each(value)))
            rule(word, "array", n >= _count(schema.get("minContains", 1)))
            if "maxContains" in schema:
                rule("maxContains", "array", n <= F.lit(int(Decimal(str(schema["maxContains"])).to_integral_value(ROUND_FLOOR))))
        elif word in ("minContains", "maxContains", "then", "else"):
            continue
        elif word == "uniqueItems":
            if value:
                texts = F.transform(items, lambda x: F.coalesce(F.when(kind_is(x, "number"), _number(x).cast("string")), F.to_json(x)))
                rule(word, "array", F.size(F.array_distinct(texts)) == F.size(texts))
        elif word in ("allOf", "anyOf"):
            rule(word, None, _fold([_holds(s, place) for s in value], word == "allOf"))
        elif word == "oneOf":
            rule(word, None, sum((_holds(s, place).cast("int") for s in value), F.lit(0)) == 1)
        elif word == "not":
            rule(word, None, ~_holds(value, place))
        elif word == "if":
            held = _holds(value, place)
            if "then" in schema:
                rule("then", None, ~held | _holds(schema["then"], place))
            if "else" in schema:
                rule("else", None, held | _holds(schema["else"], place))
        elif word == "$schema" and value.rstrip("#") != S.DIALECT:
            raise Uncovered("another meta-schema")
        elif word in ("title", "description", "default", "deprecated", "examples", "readOnly", "writeOnly", "$comment", "$schema", "$id", "contentEncoding", "contentMediaType", "format"):
            continue
        else:
            raise Uncovered(word)
    return out


def _unlike(p: str):
    return lambda n: ~n.rlike(i_regexp(p))


def _fits(p: str, s: Any):
    return lambda e: ~e["key"].rlike(i_regexp(p)) | _compile(s, e["value"])


def _names(names: Column, schema: Any) -> Column:
    """propertyNames, for what can be said of a string."""
    if isinstance(schema, bool):
        return F.lit(schema) | (F.size(names) == 0)
    tests = {"minLength": lambda n, x: F.char_length(n) >= int(x), "maxLength": lambda n, x: F.char_length(n) <= int(x), "pattern": lambda n, x: n.rlike(i_regexp(x)), "enum": lambda n, x: n.isin([y for y in x if isinstance(y, str)]), "const": lambda n, x: n == F.lit(x if isinstance(x, str) else None)}
    if not set(schema) <= set(tests):
        raise Uncovered("propertyNames")
    return F.forall(names, lambda n: _fold([tests[w](n, x) for w, x in schema.items()], True))


#: Decimals in nested items: equal values may be written differently, which only the validator sees through.
NESTED_DECIMALS = r"[\[,]\s*[\[{](?s:.*)\.[0-9]"


def _unsure(document: Any) -> str:
    return UNSURE + ("|" + NESTED_DECIMALS if "uniqueItems" in S.to_json(document) else "")


def _in_python(text: Column, built: S.Schema) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool | None:
            try:
                return None if t is None else built.is_valid(read(t))
            except (ValueError, RecursionError):
                return False

        return pd.Series([one(t) for t in s], dtype=object)

    return run(text)


def is_valid(text: Column, schema: Any, options: S.Options | None = None, others: dict[str, Any] | None = None) -> Column:
    """Whether a JSON text fits a schema (a value or JSON text); null for null, false for what is no JSON."""
    document = read(schema) if isinstance(schema, str) else schema
    built = S.Schema(document, others, options)
    if options is None and not others:
        try:
            return routed(text, lambda v, t: _of_text(v, t, lambda p: _holds(document, p)), lambda t: _in_python(t, built), _unsure(document))
        except Uncovered:
            pass
    return _in_python(text, built)


def is_valid_cbor(data: Column, schema: Any, options: S.Options | None = None, others: dict[str, Any] | None = None) -> Column:
    """Whether a CBOR value fits a schema, which may ask for bytes and their sizes; null for null, false for what is no CBOR."""
    from marlstone.sources.cbor import CborError, decode

    built = S.Schema(read(schema) if isinstance(schema, str) else schema, others, options)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(d: bytes | None) -> bool | None:
            try:
                return None if d is None else built.is_valid(decode(d))
            except (CborError, ValueError, RecursionError):
                return False

        return pd.Series([one(d) for d in s], dtype=object)

    return run(data)


def broken_rules(text: Column, schema: dict) -> Column:
    """array<string>: the keywords of a schema's rules that do not hold, as one expression over what the engine's parser keeps exactly. Raises Uncovered."""
    broken = lambda p: F.array_compact(F.array(*(F.when(~t, F.lit(w)) for w, t in rules(schema, p))))
    return bind(F.struct(text.alias("t"), parse(text).alias("v")), lambda s: _of_text(s["v"], s["t"], broken))


def output(text: Column, schema: Any, form: str = "basic", options: S.Options | None = None, others: dict[str, Any] | None = None) -> Column:
    """JSON of a validation's output: flag, basic, detailed or verbose."""
    built = S.Schema(read(schema) if isinstance(schema, str) else schema, others, options)
    shape = {"flag": lambda u: {"valid": u.valid}, "basic": lambda u: {"valid": u.valid, "errors" if not u.valid else "annotations": S.basic(u)}, "detailed": S.detailed, "verbose": S.verbose}[form]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else S.to_json(shape(built.validate(read(t))))
            except (ValueError, RecursionError):
                return S.to_json({"valid": False, "error": "no JSON"})

        return pd.Series([one(t) for t in s], dtype=object)

    return run(text)


def violations(df: DataFrame, text: str, schema: Any, keys: list[str], options: S.Options | None = None, others: dict[str, Any] | None = None) -> DataFrame:
    """(keys, keyword_location, absolute_location, instance_location, error): a row per error, found where the rows are.

    Rows that hold by the compiled rules are passed over inside the engine; only the others are explained.
    """
    document = read(schema) if isinstance(schema, str) else schema
    built = S.Schema(document, others, options)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    fields = ("keywordLocation", "absoluteKeywordLocation", "instanceLocation", "error")
    columns = ("keyword_location", "absolute_location", "instance_location", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                try:
                    unit = built.validate(read(t)) if t is not None else None
                except (ValueError, RecursionError):
                    rows.append(i)
                    found.append({"error": "no JSON", "keywordLocation": "", "absoluteKeywordLocation": "", "instanceLocation": ""})
                    continue
                for e in S.basic(unit) if unit is not None and not unit.valid else ():
                    rows.append(i)
                    found.append(e)
            taken = [b.column(k).take(pa.array(rows, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array([f[n] for f in found], pa.string()) for n in fields)], [*keys, *columns])

    texts = df.select(*keys, F.col(text).alias("_text"))
    if options is None and not others:
        try:
            t = F.col("_text")
            fits = bind(parse(t), lambda v: F.when(v.isNotNull(), _of_text(v, t, lambda p: _holds(document, p))))
            sure = ~t.rlike(_unsure(document)) & F.coalesce(fits, F.lit(False))
            texts = texts.where(t.isNotNull() & ~sure)
        except Uncovered:
            pass
    return texts.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} string" for c in columns))
