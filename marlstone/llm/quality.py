"""Operator 9: a quality classifier whose evidence is combined with site and path posteriors.

A logistic model over style features gives each document the log odds of being good. Grouped
sums of these probabilities give each site (`source`) and each path of a site a posterior mean
under a beta prior: a path shrinks towards its site, a site towards the whole table, by prior
sizes that the method of moments fits to the spread between groups. A document's posterior adds
to its own log odds the damped difference between its path's and the table's log odds. Sparse
sites therefore stay near the global prior.

Null and empty texts are scored by the features of an empty text. Very long texts and words are
read whole, one row at a time. A null site or path is a group of its own. Repeated rows count as
often as they stand; a posterior of exactly the cut is kept. Further columns are kept by
keep_good, whatever their names, and ignored by score. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marlstone.llm._shared import fresh, materialise, maybe_broadcast, resident, slices
from marlstone.llm.bpe import Memo
from marlstone.llm.linear import Model, choose_features, fit, labelled_sample

LETTERS = re.compile(r"[^\W\d_]")
RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A word's outline: A for capitals, a for other letters, 0 for digits; runs become one."""
    flat = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1", flat)


def _shapes() -> Memo:
    return resident("shapes", lambda: Memo(shape, 100_000))


def step(x: float) -> int:
    """Which of ten steps, ever wider, a share lies in."""
    return 0 if x <= 0 else min(9, 1 + int(9 * math.sqrt(min(1.0, x))))


def features(text: str) -> Counter:
    """Style features of a text, each 0 or 1: steps of shares, and shapes of words by their share."""
    words = text.split()
    n = len(words)
    out = Counter([f"words:{min(14, n.bit_length())}"])
    if not n:
        return out
    by_shape = Counter(map(_shapes().__getitem__, words))
    for s, k in by_shape.items():
        out[f"shape:{s}:{step(k / n)}"] = 1
    repeats = sum(map(str.__eq__, words, words[1:]))
    out[f"repeats:{step(repeats / n)}"] = 1
    out[f"distinct:{step(len(set(words)) / n)}:{min(4, n.bit_length() // 3)}"] = 1
    out[f"length:{min(20, len(text) // n)}"] = 1
    plain = sum(k for s, k in by_shape.items() if s in ("a", "Aa", "a.", "a,", "Aa.", "Aa,"))
    out[f"plain:{step(plain / n)}"] = 1
    stops = sum(k for s, k in by_shape.items() if s.endswith((".", "!", "?")))
    out[f"stops:{step(stops / n)}"] = 1
    lines = text.split("\n")
    out[f"lines:{step(1 - len(set(lines)) / len(lines))}"] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = 5_000, bytes_per_class: int = 256 << 20, max_features: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most rows_per_class labelled rows of each class, or fewer where their texts exceed bytes_per_class."""
    sample, counts = labelled_sample(docs, labels, label, rows_per_class, bytes_per_class, id_col, text_col)
    return fit(sample, counts, features, choose_features(sample, features, max_features, least_rows=5, least_z=3.0), l2=1.0)


def _odds(model: Model, text: str | None) -> float:
    return max(-30.0, min(30.0, model.log_odds(features(text or ""))))


def evidence(docs: DataFrame, model: Model, id_col: str, text_col: str, site_col: str, path_col: str) -> DataFrame:
    """(id, site, path, odds, p) of every row: the classifier alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            odds = [_odds(model, t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(odds, pa.float64())], ["id", "site", "path", "odds"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, site string, path string, odds double")
    return out.withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))


def _prior_size(groups: DataFrame, mean: str, least: float = 2.0, most: float = 10_000.0) -> float:
    """Beta prior size by the method of moments: how far group means spread beyond what their sizes explain."""
    r = groups.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2).alias("v"), F.sum(F.col(mean) * (1 - F.col(mean))).alias("e"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("w")).first()
    if not r["w"] or r["v"] is None:
        return most
    between = max(1e-9, (r["v"] - r["e"]) / r["w"])
    return max(least, min(most, 1 / between - 1))


def posteriors(scored: DataFrame) -> DataFrame:
    """(site, path, n, site_mean, path_mean, global_mean): shrunken means of each path of each site.

    Sums are made per path first, on each task's own rows, and sites are sums of paths.
    """
    paths = materialise(scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = total["s"] / total["n"] if total["n"] else 0.5
    sites = materialise(paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("m", F.lit(float(overall))), "sites")
    k = _prior_size(sites, "m")
    sites = sites.withColumn("site_mean", (F.col("s") + k * F.col("m")) / (F.col("n") + k)).select(F.col("site").alias("of"), "site_mean")
    # Null-safe: rows without a site have a posterior as well.
    joined = materialise(paths.join(sites, F.col("site").eqNullSafe(F.col("of"))).drop("of"), "paths")
    k = _prior_size(joined, "site_mean")
    return joined.select("site", "path", "n", "site_mean", ((F.col("s") + k * F.col("site_mean")) / (F.col("n") + k)).alias("path_mean"), F.lit(float(overall)).alias("global_mean"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", damping: float = 0.5) -> DataFrame:
    """(id, classifier, site_mean, path_mean, score, predicted) of every row; score is the posterior of being good."""
    scored = materialise(evidence(docs, model, id_col, text_col, site_col, path_col), "evidence")
    groups = posteriors(scored).select(F.col("site").alias("of_site"), F.col("path").alias("of_path"), "site_mean", "path_mean", "global_mean")
    groups = maybe_broadcast(materialise(groups, "posteriors"), F.coalesce(F.length("of_site"), F.lit(0)) + F.coalesce(F.length("of_path"), F.lit(0)) + 48)
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    odds = F.col("odds") + damping * (logit(F.col("path_mean")) - logit(F.col("global_mean")))
    joined = scored.join(groups, F.col("site").eqNullSafe(F.col("of_site")) & F.col("path").eqNullSafe(F.col("of_path")))
    out = joined.select(F.col("id").alias(id_col), F.col("p").alias("classifier"), "site_mean", "path_mean", (1 / (1 + F.exp(-odds))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", damping: float = 0.5) -> DataFrame:
    """The rows of docs whose posterior is at least `least`, with all their columns.

    Each row is written once with its classifier's log odds beside it, so texts are read once. The
    posterior differs from the classifier by a term of the row's group alone: each group gets a
    threshold on the log odds. Names of added columns clash with none that docs brings.
    """
    odds, of_site, of_path, cut_of = map(fresh, ("odds", "site", "path", "cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            found = [_odds(model, t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, odds])

    rows = materialise(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(odds, DoubleType())])), "odds")
    scored = rows.select(F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), (1 / (1 + F.exp(-F.col(odds)))).alias("p"))
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    cut = F.lit(math.log(least / (1 - least))) - damping * (logit(F.col("path_mean")) - logit(F.col("global_mean")))
    groups = materialise(posteriors(scored).select(F.col("site").alias(of_site), F.col("path").alias(of_path), cut.alias(cut_of)), "cuts")
    groups = maybe_broadcast(groups, F.coalesce(F.length(of_site), F.lit(0)) + F.coalesce(F.length(of_path), F.lit(0)) + 24)
    joined = rows.join(groups, F.col(site_col).cast("string").eqNullSafe(F.col(of_site)) & F.col(path_col).cast("string").eqNullSafe(F.col(of_path)))
    return joined.where(F.col(odds) >= F.col(cut_of)).select(*(rows[c] for c in docs.columns))
