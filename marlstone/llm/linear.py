"""A small logistic model over named features, fitted on a bounded sample of labelled rows.

The bounds are parameters: rows of each class, and bytes of their texts, beyond which fewer rows
are drawn. Only fitting is bounded, and no text is left out or cut for its length; scores are
made from whole texts of all rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import materialise, slices

Featuriser = Callable[[str], Counter]


@dataclass
class Model:
    """Weights by feature, and the bias; both in log odds."""

    weights: dict[str, float]
    bias: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells fitted models apart in worker processes

    def log_odds(self, features: Counter) -> float:
        w = self.weights
        return self.bias + sum(w[f] * n for f, n in features.items() if f in w)


def held_out(id_col: str | Column) -> Column:
    """Whether a row is kept for testing: crc32 of its id as text leaves 0 by division by 5."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, bytes_per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most rows_per_class rows of each class, and how many labelled rows of each class the sample was drawn from.

    Rows are drawn by a hash of their id, never from the held-out fifth, from the ids that docs
    holds. Of an id with several labels the largest counts, of one with several texts the longest,
    then the first in order. Drawing ends where the texts reach bytes_per_class; each class has
    one row at least, however long.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    there = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.octet_length(text_col), F.lit(0))).alias("size"))
    known = materialise(known.join(there, "id"), "known")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    drawn = [known.where(F.col("label") == k).orderBy(*order).limit(rows_per_class) for k in (0, 1)]
    # A window over at most rows_per_class rows of each class.
    before = F.sum("size").over(Window.partitionBy("label").orderBy(*order)) - F.col("size")
    ids = materialise(drawn[0].unionByName(drawn[1]).withColumn("before", before).where(F.col("before") < bytes_per_class).select("id", "label", "size"), "drawn")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("size", F.octet_length("text"))
    # At most 2 * rows_per_class triples of integers are broadcast.
    found = texts.join(F.broadcast(ids), ["id", "size"]).groupBy("id", "label").agg(F.min("text").alias("text"))
    return materialise(found.select("label", "text"), "sample"), counts


def choose_features(sample: DataFrame, featuriser: Featuriser, most: int, least_rows: int, least_z: float = 0.0) -> dict[str, float]:
    """The features whose presence differs most between the classes, best first, each with the root of its likelihood ratio, which is a z score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(featuriser(text).keys())
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)], ["feature", "n0", "n1"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    if not t0 or not t1:
        return {}
    n0, n1 = F.col("n0"), F.col("n1")
    share = (n0 + n1) / F.lit(float(t0 + t1))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    g = part(n0, t0 * share) + part(n1, t1 * share) + part(t0 - n0, t0 * (1 - share)) + part(t1 - n1, t1 * (1 - share))
    z = F.sqrt(F.greatest(2 * g, F.lit(0.0)))
    counted = sample.mapInArrow(count, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = counted.where(n0 + n1 >= least_rows).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most)
    return {r["feature"]: r["z"] for r in best.collect()}


class _Ties:
    """Versions of sentences as a sparse matrix, and the gradient of the variance of their scores within each group.

    Only features whose count differs within a group take part: the others move no difference.
    """

    def __init__(self, groups: list[list[Counter]], place: dict[str, int]):
        rows, cols, vals, of = [], [], [], []
        for number, group in enumerate(groups):
            differ = {f for c in group for f in c if f in place and len({d[f] for d in group}) > 1}
            for c in group if differ else ():
                own = sorted(place[f] for f in differ if c[f])
                rows += [len(of)] * len(own)
                cols += own
                vals += [float(c[f]) for f in sorted((f for f in differ if c[f]), key=place.__getitem__)]
                of.append(number)
        self.rows, self.cols, self.vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals, np.float64)
        _, self.of = np.unique(np.array(of, np.int64), return_inverse=True)
        self.sizes, self.n = np.maximum(1, np.bincount(self.of)), len(of)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        scores = np.bincount(self.rows, weights=self.vals * w[self.cols], minlength=self.n)
        centred = scores - (np.bincount(self.of, weights=scores) / self.sizes)[self.of]
        return np.bincount(self.cols, weights=self.vals * centred[self.rows], minlength=len(w))


def fit(sample: DataFrame, counts: dict[int, int], featuriser: Featuriser, features: dict[str, float], l2: float = 1.0, sure_z: float = 0.0, ties: list[list[Counter]] | None = None, tie_weight: float = 0.0, steps: int = 200) -> Model:
    """Logistic regression over the chosen features, by accelerated gradient steps.

    features: names and z scores. A feature of less than sure_z, or than the best one's score if
    that is less, is charged more, by the fourth power of how far it falls short: the weak ones
    shrink, none is left out.

    ties: groups of feature counts whose scores should be equal; tie_weight times the variance of
    their scores within each group is added to the loss. Without labels of both classes the model
    gives the share of 1 among the labels, or a half.
    """
    total0, total1 = counts.get(0, 0), counts.get(1, 0)
    if not features or not total0 or not total1:
        share = (total1 + 0.5) / (total0 + total1 + 1)
        return Model({}, float(np.log(share / (1 - share))))
    place = {f: i for i, f in enumerate(features)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols, vals = [], []
            for text in b.column(1).to_pylist():
                own = [(place[f], n) for f, n in featuriser(text).items() if f in place]
                cols.append([i for i, _ in own])
                vals.append([float(n) for _, n in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["label", "cols", "vals"])

    table = sample.mapInArrow(encode, "label int, cols array<int>, vals array<float>").toArrow().combine_chunks()
    y = table.column("label").to_numpy().astype(np.float64)
    cols_array, vals_array = table.column("cols").combine_chunks(), table.column("vals").combine_chunks()
    rows = np.repeat(np.arange(len(y)), np.asarray(cols_array.value_lengths().fill_null(0)).astype(np.int64))
    cols, vals = cols_array.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vals_array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.lexsort((cols, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]

    size, n = len(features), len(y)
    tied = _Ties([] if not tie_weight else ties or [], place)
    scale = np.sqrt(np.maximum(1e-9, np.bincount(cols, weights=vals**2, minlength=size) / n))
    vals = vals / scale[cols]
    tied.vals = tied.vals / scale[tied.cols]
    positive, negative = max(1.0, y.sum()), max(1.0, n - y.sum())
    weight = np.where(y == 1, 0.5 * n / positive, 0.5 * n / negative)
    z = np.maximum(0.1, np.fromiter(features.values(), np.float64, size))
    charge = l2 * np.maximum(1.0, min(sure_z, z.max()) / z) ** 4
    w, b = np.zeros(size), 0.0
    m1, m2, t = np.zeros(size + 1), np.zeros(size + 1), 0
    for t in range(1, steps + 1):
        margin = np.bincount(rows, weights=vals * w[cols], minlength=n) + b
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        g = np.append(np.bincount(cols, weights=vals * error[rows], minlength=size) / n + charge * w / n, error.mean())
        if tied.n:
            g[:-1] += 2 * tie_weight * tied.gradient(w) / tied.n
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (1 - t / (steps + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    # The classes weighed the same in fitting; the bias returns to their share among the labels.
    b += float(np.log(total1 / total0))
    return Model({f: float(w[i] / scale[i]) for f, i in place.items() if w[i]}, b)
