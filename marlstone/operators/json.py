"""JSON text columns: parsing, paths, nodes, and scalar functions.

Paths that an expression can say run on VARIANT inside the engine; others - descendants, patterns
from the document, functions of one's own - run as one vectorised function per column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.values import read, same, write
from marlstone.plans.jsonpath import Function, Path, normalized
from marlstone.plans.path_columns import Unsupported, bind, compile_value, nodes_of

__all__ = ["Function", "exists", "is_json", "json_count", "json_kind", "json_length", "json_nodes", "json_path", "json_same", "json_value", "parse", "path_error", "routed", "to_text"]


def parse(text: Column) -> Column:
    """VARIANT of a JSON text, or null if it is none (or repeats a member's name)."""
    return F.try_parse_json(text)


def is_json(text: Column) -> Column:
    return parse(text).isNotNull()


def to_text(document: Column) -> Column:
    """JSON text of a VARIANT, struct, array or map."""
    return F.to_json(document)


#: Texts whose numbers the engine's parser does not keep exactly: exponents, and more than 18 digits.
UNSURE = r"[0-9][eE][+\-]?[0-9]|[0-9.]{19}"


def routed(text: Column, compiled: Callable[[Column, Column], Column], exact: Callable[[Column], Column], unsure: str = UNSURE) -> Column:
    """compiled(VARIANT, text) where the engine's parser keeps a text exactly; exact(text), in Python, for the other rows; null for null.

    Those are texts that the parser rejects - no JSON, or with repeated members - and texts that
    match `unsure`. The Python function gets null for all other rows, and must give null for it and
    something for these. Text and VARIANT are bound, so each is found once for all that compiled
    makes of them.
    """
    odd = parse(text).isNull() | text.rlike(unsure)
    kept = bind(text, lambda t: bind(parse(t), lambda v: F.when(v.isNotNull(), compiled(v, t))))
    return F.coalesce(exact(F.when(odd, text)), kept)


def _in_python(text: Column, path: Path) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            try:
                return None if t is None else [write(v) for v in path.values(read(t))]
            except (ValueError, RecursionError):
                return []

        return s.map(one)

    return run(text)


def _count_in_python(text: Column, path: Path) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            try:
                return None if t is None else len(path.values(read(t)))
            except (ValueError, RecursionError):
                return 0

        return pd.Series([one(t) for t in s], dtype="Int32")

    return run(text)


def json_path(text: Column, path: str, functions: dict[str, Function] | None = None) -> Column:
    """array<string>: the JSON of each node of a path in a JSON text, in order; empty if the text is no JSON."""
    p = Path(path, functions)
    none = F.array().cast("array<string>")
    try:
        return F.coalesce(routed(text, lambda v, _: F.transform(nodes_of(p, v), lambda x: F.to_json(x)), lambda t: _in_python(t, p)), none)
    except Unsupported:
        return F.coalesce(_in_python(text, p), none)


def json_count(text: Column, path: str, functions: dict[str, Function] | None = None) -> Column:
    """How many nodes a path has in a JSON text; their JSON is not written."""
    p = Path(path, functions)
    try:
        return F.coalesce(routed(text, lambda v, _: F.size(nodes_of(p, v)), lambda t: _count_in_python(t, p)), F.lit(0))
    except Unsupported:
        return F.coalesce(_count_in_python(text, p), F.lit(0))


def path_error(text: Column, path: str, functions: dict[str, Function] | None = None) -> Column:
    """Why a path gives nothing for a text: what the parser or a function of the path says; null where neither fails."""
    p = Path(path, functions)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                value = read(t)
            except (ValueError, RecursionError) as e:
                return f"no JSON: {e}"
            try:
                for _ in p.values(value):
                    pass
            except Exception as e:  # noqa: BLE001 - a function of the caller's own may raise anything
                return f"{type(e).__name__}: {e}"
            return None

        return pd.Series([one(t) for t in s], dtype=object)

    return run(text)


def json_value(text: Column, path: str, kind_of: str = "string") -> Column:
    """The value of a singular path as a Spark type, or null."""
    return F.try_variant_get(compile_value(path, parse(text)), "$", kind_of)


def exists(text: Column, path: str) -> Column:
    """Whether a path has any node; a JSON null is one."""
    p = Path(path)
    if p.query.singular:
        return compile_value(p, parse(text)).isNotNull()
    return json_count(text, path) > 0


def json_nodes(df: DataFrame, text: str, path: str, keys: list[str], functions: dict[str, Function] | None = None) -> DataFrame:
    """(keys, ord, path, value): a row for each node, with its normalized path and its JSON.

    Documents are read where they are; nothing is shuffled, and order is carried by ord.
    """
    p = Path(path, functions)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ords, paths, values = [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                try:
                    nodes = p.nodes(read(t)) if t is not None else []
                except (ValueError, RecursionError):
                    continue
                for n, (v, at) in enumerate(nodes):
                    rows.append(i)
                    ords.append(n)
                    paths.append(normalized(at))
                    values.append(write(v))
            taken = [b.column(k).take(pa.array(rows, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(ords, pa.int32()), pa.array(paths, pa.string()), pa.array(values, pa.string())], [*keys, "ord", "path", "value"])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, ord int, path string, value string")


def json_kind(document: Column) -> Column:
    """null, bool, number, bytes, string, array or object of a VARIANT; SQL null for absence."""
    k = F.schema_of_variant(document)
    return F.when(document.isNull(), F.lit(None).cast("string")).when(k == "VOID", F.lit("null")).when(k == "BOOLEAN", F.lit("bool")).when(k == "STRING", F.lit("string")).when(k == "BINARY", F.lit("bytes")).when(k.startswith("ARRAY"), F.lit("array")).when(k.startswith("OBJECT"), F.lit("object")).otherwise(F.lit("number"))


def json_length(document: Column) -> Column:
    """Code points of a string, bytes of a binary, size of an array or object; else null."""
    k = json_kind(document)
    return (
        F.when(k == "string", F.char_length(F.try_variant_get(document, "$", "string")))
        .when(k == "array", F.size(F.try_variant_get(document, "$", "array<variant>")))
        .when(k == "object", F.size(F.try_variant_get(document, "$", "map<string,variant>")))
        .when(k == "bytes", F.octet_length(F.try_variant_get(document, "$", "binary")))
    )


def json_same(a: Column, b: Column) -> Column:
    """Deep equality of two JSON texts: numbers by value, objects by their members."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str | None, t: str | None) -> bool | None:
            try:
                return None if s is None or t is None else same(read(s), read(t))
            except (ValueError, RecursionError):
                return None

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype=object)

    return run(a, b)


def stringified(document: Column) -> Column:
    """A value for display: strings without quotes, others as JSON."""
    return F.coalesce(F.when(json_kind(document) == "string", F.try_variant_get(document, "$", "string")), F.to_json(document))


