"""Relational forms beside the document operators: ranks, top rows, totals by levels, sets of rows, arrays as sequences, and aggregates and table functions of one's own."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.udtf import UserDefinedTableFunction

from marlstone.operators.values import read, write
from marlstone.plans.jsonpath import Path, normalized

# -- rows -------------------------------------------------------------------------------------


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by an order; each task keeps n of its own, so nothing is sorted whole."""
    return df.orderBy(*order).limit(n)


def top_of_each(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group by an order, with their rank; tasks drop the others before they are sent."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def running(value: Column, keys: list[str], *order: Column) -> Column:
    """Sum of a value over the rows of a group up to this one."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def before(value: Column, keys: list[str], *order: Column) -> Column:
    """The value of the row before this one in its group."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def levels(df: DataFrame, keys: list[str], aggregates: list[Column], every: bool = False) -> DataFrame:
    """Totals by all keys, by ever fewer of them, and overall (rollup); with `every`, by every choice of keys (cube). `level` tells the choice as bits, 1 for a key left out."""
    grouped = df.cube(*keys) if every else df.rollup(*keys)
    return grouped.agg(F.grouping_id().alias("level"), *aggregates)


def levels_of_values(df: DataFrame, keys: list[str], value: str, aggregates: list[Column], every: bool = False) -> DataFrame:
    """levels() whose aggregates see each value of a choice of keys once, with its number of rows there in `n`.

    So values are counted and sketched by plain aggregates. Beside a distinct aggregate Spark would
    keep a state of each other one, a sketch of 13 kB, for each value. Rows are counted before they
    are sent, and once more sent by their value alone, so the choices of keys need no shuffle.
    """
    bits = [(1 << i) - 1 for i in range(len(keys) + 1)] if not every else list(range(1 << len(keys)))
    kept = lambda bit, i: not bit >> (len(keys) - 1 - i) & 1
    choice = lambda bit: F.struct(F.lit(bit).cast("bigint").alias("level"), *(F.when(F.lit(kept(bit, i)), F.col(f"`{k}`")).alias(k) for i, k in enumerate(keys)))
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n")).repartition(value)
    chosen = counted.select(F.explode(F.array(*map(choice, bits))).alias("_choice"), value, "n").select("_choice.*", value, "n")
    return chosen.groupBy(*keys, "level", value).agg(F.sum("n").alias("n")).groupBy(*keys, "level").agg(*aggregates)


def distinct_about(value: Column, error: float = 0.01) -> Column:
    """About how many different values there are, by a sketch of fixed size."""
    return F.approx_count_distinct(value, error)


def in_both(a: DataFrame, b: DataFrame, repeats: bool = False) -> DataFrame:
    return a.intersectAll(b) if repeats else a.intersect(b)


def only_in_first(a: DataFrame, b: DataFrame, repeats: bool = False) -> DataFrame:
    return a.exceptAll(b) if repeats else a.subtract(b)


# -- sequences --------------------------------------------------------------------------------


def unique(items: Column) -> Column:
    """Items without repeats, in the order of their first places."""
    return F.array_distinct(items)


def associated(items: Column, key: Callable[[Column], Column]) -> Column:
    """map of items by a key; of several with one key the last stays."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    return F.aggregate(F.array_distinct(F.transform(keyed, lambda e: e["k"])), F.map_from_entries(F.slice(keyed, 1, 0)), lambda m, k: F.map_concat(m, F.map_from_arrays(F.array(k), F.array(F.element_at(F.filter(keyed, lambda e: e["k"] == k), -1)["v"]))))


def sorted_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items in the order of a key, equal ones in the order they had."""
    placed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda e: e["x"])


def any_satisfy(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def none_satisfy(items: Column, test: Callable[[Column], Column]) -> Column:
    return ~any_satisfy(items, test)


# -- functions of one's own -------------------------------------------------------------------


class Aggregate:
    """An aggregate of one's own: a first state, adding a value, merging two states, and the result of one."""

    def __init__(self, zero: Callable[[], Any], add: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], Any], kind: str | DataType):
        self.zero, self.add, self.merge, self.finish, self.kind = zero, add, merge, finish, kind


def aggregate(df: DataFrame, keys: list[str], value: Column, by: Aggregate, name: str = "value", most_groups: int = 100_000) -> DataFrame:
    """(keys, name): an aggregate of one's own for each group.

    Each task makes states of its own rows first, at most most_groups at a time; only states are
    sent. They are merged in two steps, by key and a part of it and then by key, so a hot key's
    states do not meet in one task at once.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def rows(states: dict, first: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in states], first.schema.field(i).type) for i in range(n)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [*keys, "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = row[:n]
                states[key] = by.add(states[key] if key in states else by.zero(), row[n])
            if len(states) >= most_groups:
                yield rows(states, b)
                states = {}
        if states:
            yield rows(states, b)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                state = pickle.loads(row[n])  # noqa: S301 - made by the tasks before
                states[row[:n]] = by.merge(states[row[:n]], state) if row[:n] in states else state
        if states:
            yield rows(states, b)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([by.finish(pickle.loads(s)) for s in b.column(n).to_pylist()])], [*keys, name])  # noqa: S301

    states = df.select(*keys, value.alias("_value")).mapInArrow(partial, f"{kinds}, state binary")
    some = states.repartition(*keys, F.pmod(F.hash("state"), F.lit(16))).mapInArrow(merged, f"{kinds}, state binary")
    kind = by.kind if isinstance(by.kind, str) else by.kind.simpleString()
    return some.repartition(*keys).mapInArrow(finished, f"{kinds}, `{name}` {kind}")


class _Nodes:
    """Rows of a path's nodes in a JSON text."""

    def eval(self, text: str, path: str):  # noqa: D102
        if text is None or path is None:
            return
        try:
            value = read(text)
        except (ValueError, RecursionError):
            return
        for i, (v, at) in enumerate(Path(path).nodes(value)):
            yield i, normalized(at), write(v)


def nodes_function() -> UserDefinedTableFunction:
    """Table function nodes(text, path) with rows (ord, path, value), for lateral joins and SQL."""
    return F.udtf(_Nodes, returnType="ord int, path string, value string")
