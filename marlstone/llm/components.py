"""Connected components of a table of links, by alternating stars over relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import join_counted, materialise


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each node hands its larger neighbours the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    moved = join_counted(both, least, "u", "n", 2 * n).where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in links (u, v): component is the smallest node reachable.

    Each round's links are written to the shared folder. Rounds end when the links stay as they
    are; then each node but a component's smallest has one link, to that smallest node.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, name)
    mark = None
    for _ in range(most_rounds):
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now := (r["n"], r["h"])) == mark or not r["n"]:
            break
        mark = now
        edges = materialise(_small(_large(edges, r["n"]), r["n"]), name)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
