"""JSONPath compiled into expressions over VARIANT: everything but descendants, and functions of one's own.

A node list is an ARRAY<VARIANT>. Each segment maps the nodes to arrays of what its selectors
find and flattens these, so order and repeats are those of RFC 9535 - but for members of
objects under a wildcard, which VARIANT keeps in the order of their names. Absence is SQL's null,
a JSON null is a variant null; each comparison is brought to true or false before it is negated.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Context, Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.operators.values import write
from marlstone.plans.jsonpath import All, Call, Compare, Filter, Index, Literal, Name, Not, Path, Query, Slice, Some, Wild, i_regexp

EMPTY = "array<variant>"


class Unsupported(ValueError):
    """A path that has no expression over VARIANT; marlstone.operators.json evaluates it in Python."""


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _none() -> Column:
    return F.array().cast(EMPTY)


def _items(v: Column) -> Column:
    """Elements of an array, or null."""
    return F.try_variant_get(v, "$", "array<variant>")


def _member(v: Column, name: str) -> Column:
    if "'" in name or "\\" in name or '"' in name:
        return F.try_element_at(_members(v), F.lit(name))
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _members(v: Column) -> Column:
    """Members of an object as a map, or null."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _some(v: Column) -> Column:
    return F.when(v.isNull(), _none()).otherwise(F.array(v))


def _children(v: Column) -> Column:
    return F.coalesce(_items(v), F.map_values(_members(v)), _none())


def _slice(items: Column, s: Slice) -> Column:
    n, step = F.size(items), 1 if s.step is None else s.step
    if step == 0:
        return _none()
    place = lambda i: F.lit(i) if i >= 0 else n + i
    if step > 0:
        low = F.greatest(F.lit(0), F.least(place(s.start or 0), n))
        high = F.greatest(F.lit(0), F.least(n if s.end is None else place(s.end), n)) - 1
        some = low <= high
    else:
        low = F.greatest(F.lit(-1), F.least(n - 1 if s.start is None else place(s.start), n - 1))
        high = (F.lit(-1) if s.end is None else F.greatest(F.lit(-1), F.least(place(s.end), n - 1))) + 1
        some = low >= high
    return F.when(items.isNotNull() & some, F.transform(F.sequence(low, high, F.lit(step)), lambda i: F.get(items, i))).otherwise(_none())


def _select(sel: Any, v: Column, root: Column) -> Column:
    if isinstance(sel, Name):
        return _some(_member(v, sel.name))
    if isinstance(sel, Index):
        items = _items(v)
        return _some(F.get(items, F.lit(sel.index)) if sel.index >= 0 else F.try_element_at(items, F.lit(sel.index)))
    if isinstance(sel, Slice):
        return F.coalesce(_slice(_items(v), sel), _none())
    if isinstance(sel, Wild):
        return _children(v)
    if isinstance(sel, Filter):
        return F.filter(_children(v), lambda x: _holds(sel.test, x, root))
    raise Unsupported(str(sel))


def _found(selectors: tuple, root: Column) -> Callable[[Column], Column]:
    """What selectors find in a node, in their order."""
    if len(selectors) == 1:
        return lambda v: _select(selectors[0], v, root)
    return lambda v: F.concat(*(_select(x, v, root) for x in selectors))


def _nodes(q: Query, current: Column, root: Column) -> Column:
    here, segments = root if q.rooted else current, list(q.segments)
    if any(s.descend for s in segments):
        raise Unsupported("descendants")
    # Leading names lead to one place, which is read without making lists.
    while segments and len(segments[0].selectors) == 1 and isinstance(segments[0].selectors[0], Name):
        here = _member(here, segments.pop(0).selectors[0].name)
    if not segments:
        return _some(here)
    first, *rest = segments
    out = _select(first.selectors[0], here, root) if len(first.selectors) == 1 else bind(here, _found(first.selectors, root))
    for s in rest:
        out = F.flatten(F.transform(out, _found(s.selectors, root)))
    return out


def _one(q: Query, current: Column, root: Column) -> Column:
    """The value of a singular query, or SQL null."""
    v = root if q.rooted else current
    for s in q.segments:
        x = s.selectors[0]
        v = _member(v, x.name) if isinstance(x, Name) else (F.get(_items(v), F.lit(x.index)) if x.index >= 0 else F.try_element_at(_items(v), F.lit(x.index)))
    return v


#: Numbers of at most 18 digits, which is what reaches an expression, are exact in it.
NUMBER = "decimal(38,18)"


def fitting(value: Any) -> Column:
    """A number as NUMBER, if that holds it exactly. Raises Unsupported."""
    d = Decimal(str(value))
    if not d.is_finite() or abs(d) >= Decimal(10) ** 20 or d != d.quantize(Decimal(1).scaleb(-18), context=Context(prec=60)):
        raise Unsupported(f"{value} has too many digits")
    return F.lit(d.quantize(Decimal(1).scaleb(-18), context=Context(prec=60))).cast(NUMBER)


def kind_is(v: Column, name: str) -> Column:
    """Whether a VARIANT is of a kind, by one look at its type; false for absence."""
    return type_is(F.schema_of_variant(v), name)


def type_is(s: Column, name: str) -> Column:
    """Whether a VARIANT's type is of a kind."""
    if name == "number":
        test = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
    elif name in ("array", "object"):
        test = s.startswith(name.upper())
    else:
        test = s == {"null": "VOID", "bool": "BOOLEAN", "string": "STRING", "bytes": "BINARY"}[name]
    return test.eqNullSafe(F.lit(True))


def _read(v: Column, kind_of: str) -> Column:
    return F.try_variant_get(v, "$", kind_of)


OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
TURNED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _literal_kind(v: Any) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"


def _constant(v: Any) -> Column:
    return fitting(v) if _literal_kind(v) == "number" else F.lit(v)


def _with_literal(x: Any, op: str, value: Any, current: Column, root: Column) -> Column:
    """A query or call against a literal: one reading, of the literal's kind."""
    kind, plain = _literal_kind(value), "==" if op == "!=" else op
    if isinstance(x, Call):
        if x.name not in ("count", "length"):
            raise Unsupported(x.name)
        held = F.lit(False) if kind != "number" else OPERATIONS[plain](_call(x, current, root).cast(NUMBER), _constant(value))
    else:
        v = _one(x, current, root)
        written = F.to_json(v)  # tells the kind, and all of a value that is no array or object
        if kind == "number":
            held = OPERATIONS[plain](written.try_cast(NUMBER), _constant(value))
        elif kind == "string" and plain != "==":
            held = OPERATIONS[plain](F.when(written.startswith('"'), _read(v, "string")), F.lit(value))
        else:  # of kinds without order, only what is equal is at most, or at least, as large
            held = written == write(value) if plain in ("==", "<=", ">=") else F.lit(False)
    held = held.eqNullSafe(F.lit(True))
    return ~held if op == "!=" else held


def _compare(t: Compare, current: Column, root: Column) -> Column:
    left, right = t.left, t.right
    if isinstance(left, Literal) and isinstance(right, Literal):
        raise Unsupported("two literals")
    if isinstance(right, Literal):
        return _with_literal(left, t.op, right.value, current, root)
    if isinstance(left, Literal):
        return _with_literal(right, TURNED[t.op], left.value, current, root)
    if t.op not in ("<", ">"):
        raise Unsupported("equality of two places, which may hold arrays")
    sides = [(_call(x, current, root).cast(NUMBER), None) if isinstance(x, Call) else (None, _one(x, current, root)) for x in (left, right)]
    numbers = [n if v is None else F.when(kind_is(v, "number"), _read(v, NUMBER)) for n, v in sides]
    held = OPERATIONS[t.op](*numbers).eqNullSafe(F.lit(True))
    if all(v is not None for _, v in sides):
        texts = [F.when(kind_is(v, "string"), _read(v, "string")) for _, v in sides]
        held = held | OPERATIONS[t.op](*texts).eqNullSafe(F.lit(True))
    return held


def _argument_text(x: Any, current: Column, root: Column) -> Column:
    if isinstance(x, Literal):
        return F.lit(x.value) if isinstance(x.value, str) else F.lit(None).cast("string")
    if isinstance(x, Query):
        v = _one(x, current, root)
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    raise Unsupported(str(x))


def _call(c: Call, current: Column, root: Column) -> Column:
    if c.name == "count":
        return F.size(_nodes(c.args[0], current, root))
    if c.name == "length":
        if isinstance(c.args[0], Literal):
            v = c.args[0].value
            return F.lit(len(v) if isinstance(v, str) else None).cast("int")
        if not isinstance(c.args[0], Query):
            raise Unsupported("length of a call")
        v = _one(c.args[0], current, root)
        kind = F.schema_of_variant(v)
        return F.when(kind == "STRING", F.char_length(F.try_variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), F.size(_items(v))).when(kind.startswith("OBJECT"), F.size(_members(v)))
    if c.name in ("match", "search"):
        if not isinstance(c.args[1], Literal) or not isinstance(c.args[1].value, str):
            raise Unsupported("a pattern from the document")
        expression = i_regexp(c.args[1].value)
        from marlstone.plans.jsonpath import pattern

        if pattern(c.args[1].value) is None:
            return F.lit(False)
        text = _argument_text(c.args[0], current, root)
        return F.coalesce(text.rlike(rf"\A(?:{expression})\z" if c.name == "match" else expression), F.lit(False))
    raise Unsupported(c.name)


def _holds(t: Any, current: Column, root: Column) -> Column:
    if isinstance(t, (All, Some)):
        out = _holds(t.tests[0], current, root)
        for x in t.tests[1:]:
            out = out & _holds(x, current, root) if isinstance(t, All) else out | _holds(x, current, root)
        return out
    if isinstance(t, Not):
        return ~_holds(t.test, current, root)
    if isinstance(t, Compare):
        return _compare(t, current, root)
    if isinstance(t, Query):
        return _one(t, current, root).isNotNull() if t.singular else F.size(_nodes(t, current, root)) > 0
    if t.name in ("match", "search"):
        return _call(t, current, root)
    raise Unsupported(t.name)


def nodes_of(path: Path, root: Column) -> Column:
    """ARRAY<VARIANT> of a path's nodes in a bound VARIANT that is not null. Raises Unsupported."""
    return _nodes(path.query, root, root)


def compile_nodes(path: str | Path, document: Column) -> Column:
    """ARRAY<VARIANT> of a path's nodes in a VARIANT column; empty for a null document. Raises Unsupported."""
    p = path if isinstance(path, Path) else Path(path)
    return bind(document, lambda root: F.when(root.isNotNull(), _nodes(p.query, root, root)).otherwise(_none()))


def compile_value(path: str | Path, document: Column) -> Column:
    """VARIANT of a singular path; null where it leads nowhere."""
    p = path if isinstance(path, Path) else Path(path)
    if not p.query.singular:
        raise Unsupported(f"{p.text} may lead to several places")
    return _one(p.query, document, document) if all(isinstance(s.selectors[0], Name) for s in p.query.segments) else bind(document, lambda root: _one(p.query, root, root))
