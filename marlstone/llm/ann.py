"""Operator 8: approximate nearest neighbours by a robust-pruned directed graph in each shard.

Vectors are dealt out to shards by a hash; a shard is as large as a task's memory allows, since
every query is asked in every shard. In a shard, greedy searches from an entry point propose
neighbours for each vector; relaxed distance pruning keeps an edge only if no kept edge's end is
closer to the candidate by a factor alpha, so edges spread in direction. Beam search then answers
every query in every shard, and each query's best of all shards are ranked. Where a search ends
with fewer rows than were asked for, or a shard is no larger than a beam, the shard is scanned.

Nearness is the inner product. The graph lives in the space that turns it into distance, and equal
vectors of a shard are one node: vectors get one more coordinate, the root of what their squared
length lacks to the largest in the shard. Scores are inner products of the original vectors in
double precision.

Null vectors, zero vectors and those with null or non-finite components take no part, either as
queries or as candidates; nor do rows without id. Each row is a query or candidate of its own,
also where several share an id or are equal: only a query's own row is no candidate of it. Ties go
to the smaller id. Very long vectors make smaller shards; vectors of different length never meet,
as shards are made per length. Further columns are ignored. An empty table, or one without
queries, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import materialise


def lift(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to the largest length, with the coordinate that makes all of them as long."""
    squares = (x * x).sum(axis=1)
    most = squares.max()
    return np.column_stack([x, np.sqrt(np.maximum(0, most - squares))]).astype(np.float32) / np.float32(np.sqrt(most))


class Graph:
    """A directed graph over the rows of x (unit length), built in batches of growing size.

    A row of edges has room for `degree` neighbours and half as many edges back, which are added
    as they come; when the room is used up the row is pruned again. Free room holds the row itself.
    """

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 7):
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        n, self.room = len(x), degree + degree // 2
        self.edges = np.repeat(np.arange(n, dtype=np.int32)[:, None], self.room, axis=1)
        self.used = np.zeros(n, np.int32)
        self.entry = int(np.argmax(x @ x.mean(axis=0)))
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        # The first rows form a graph by themselves; each batch then joins the graph so far.
        start = min(n, 2 * degree)
        first = order[:start]
        self._connect(first, np.broadcast_to(first, (start, start)))
        done, size = start, start
        while done < n:
            batch = order[done : done + size]
            found, _ = self.search(x[batch], self.beam)
            self._connect(batch, found)
            done += len(batch)
            size = min(2048, done)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows of q together: (rows found, similarities), best first, beam columns.

        Each step opens the best unopened rows of every query that has one; rows already in the
        beam are not taken again.
        """
        n, m = len(self.x), len(q)
        beam = min(beam, n)
        ids = np.full((m, beam), -1, np.int32)
        sims = np.full((m, beam), -np.inf, np.float32)
        opened = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool) if m * n <= 64 << 20 else None
        if seen is None:
            step = max(1, (64 << 20) // n)
            parts = [self.search(q[i : i + step], beam) for i in range(0, m, step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids[:, 0], sims[:, 0] = self.entry, q @ self.x[self.entry]
        seen[:, self.entry] = True
        live = np.arange(m)
        while len(live):
            open_sims = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
            # Several rows are opened at a time: fewer steps, the same order of best first.
            picks = np.argpartition(-open_sims, min(3, beam - 1), axis=1)[:, :4]
            good = np.take_along_axis(open_sims, picks, axis=1) > -np.inf
            keep = good.any(axis=1)
            live, picks, good = live[keep], picks[keep], good[keep]
            if not len(live):
                break
            opened[live[:, None], picks] = True
            heads = np.where(good, ids[live[:, None], picks], self.entry)
            new = self.edges[heads].reshape(len(live), -1)
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            row, col = np.nonzero(fresh)
            # Of a row that several heads lead to, the first place counts.
            _, once = np.unique(row * n + new[row, col], return_index=True)
            row, col = row[once], col[once]
            fresh[:] = False
            fresh[row, col] = True
            near = np.full(new.shape, -np.inf, np.float32)
            near[row, col] = np.einsum("ij,ij->i", self.x[new[row, col]], q[live[row]])
            all_ids = np.concatenate([ids[live], np.where(fresh, new, -1)], axis=1)
            all_sims = np.concatenate([sims[live], near], axis=1)
            all_open = np.concatenate([opened[live], ~fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            opened[live] = np.take_along_axis(all_open, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def prune(self, rows: np.ndarray, candidates: np.ndarray) -> None:
        """Choose edges of rows from candidates (a row of them each; -1 or the row itself for none)."""
        x = self.x
        for i in range(0, len(rows), 256):
            r, c = rows[i : i + 256], candidates[i : i + 256]
            c = np.sort(c, axis=1)
            bad = (c < 0) | (c == r[:, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            vectors = x[c]
            far = 2 - 2 * np.einsum("ijk,ik->ij", vectors, x[r])
            far[bad] = np.inf
            order = np.argsort(far, axis=1, kind="stable")[:, : 4 * self.degree]
            c, far = np.take_along_axis(c, order, axis=1), np.take_along_axis(far, order, axis=1)
            vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
            between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
            alive, chosen = np.isfinite(far), np.repeat(r[:, None], self.degree, axis=1).astype(np.int32)
            taken = np.zeros(len(r), np.int64)
            lines = np.arange(len(r))
            for _ in range(self.degree):
                has = alive.any(axis=1)
                if not has.any():
                    break
                k = np.argmax(alive, axis=1)
                chosen[lines[has], taken[has]] = c[lines[has], k[has]]
                taken += has
                drop = self.alpha**2 * between[lines, k] <= far
                alive &= ~drop
                alive[lines, k] = False
            self.edges[r] = np.concatenate([chosen, np.repeat(r[:, None], self.room - self.degree, axis=1)], axis=1)
            self.used[r] = taken

    def _connect(self, batch: np.ndarray, candidates: np.ndarray) -> None:
        self.prune(batch, candidates)
        heads, tails = np.repeat(batch, self.degree), self.edges[batch, : self.degree].ravel()
        keep = heads != tails
        heads, tails = heads[keep], tails[keep]
        # Edges back: added where there is room for them, else chosen again among old and new.
        order = np.argsort(tails, kind="stable")
        heads, tails = heads[order], tails[order]
        rows, starts, counts = np.unique(tails, return_index=True, return_counts=True)
        fits = self.used[rows] + counts <= self.room
        place = np.arange(len(tails)) - np.repeat(starts, counts)
        added = np.repeat(fits, counts)
        self.edges[tails[added], (self.used[tails] + place)[added]] = heads[added]
        self.used[rows[fits]] += counts[fits].astype(np.int32)
        rows, starts, counts = rows[~fits], starts[~fits], counts[~fits]
        for low, high in ((0, 8), (8, 32), (32, 128), (128, len(tails))):
            these = (counts > low) & (counts <= high)
            if these.any():
                most = int(counts[these].max())
                at = starts[these][:, None] + np.arange(most)
                back = np.where(np.arange(most) < counts[these][:, None], heads[np.minimum(at, len(heads) - 1)], -1)
                step = max(1, (1 << 20) // (most + self.room))
                for i in range(0, len(back), step):
                    part = rows[these][i : i + step]
                    self.prune(part, np.concatenate([self.edges[part], back[i : i + step]], axis=1))


def valid(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def scan(exact: np.ndarray, queries: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest rows of exact for each query, by comparing all."""
    out = np.empty((len(queries), most), np.int64)
    step = max(1, (16 << 20) // len(exact))
    for i in range(0, len(queries), step):
        far = -(queries[i : i + step] @ exact.T)
        out[i : i + step] = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(exact) else np.arange(len(exact))
    return out


class Shard:
    """The rows of a shard, its distinct vectors, and their graph."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray, degree: int, beam: int):
        self.exact, group = np.unique(values, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((rows, ids, group))
        self.ids, self.rows = ids[order], rows[order]
        self.starts = np.searchsorted(group[order], np.arange(len(self.exact) + 1))
        self.graph = Graph(lift(self.exact), degree, beam)

    def answer(self, query_rows: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the k best rows of this shard for each query."""
        n, beam = len(self.exact), max(beam, 2 * k)
        if n <= beam:
            found = scan(self.exact, queries, n)
        else:
            q = np.column_stack([queries / np.sqrt((queries**2).sum(axis=1))[:, None], np.zeros(len(queries))]).astype(np.float32)
            found = self.graph.search(q, beam)[0].astype(np.int64)
            short = np.flatnonzero((found >= 0).sum(axis=1) <= k)
            if len(short):
                found[short] = -1
                found[short, : k + 1] = scan(self.exact, queries[short], k + 1)
        row, col = np.nonzero(found >= 0)
        at = found[row, col]
        scores = np.einsum("ij,ij->i", self.exact[at], queries[row])
        # Rows of one vector are one node; of them the k + 1 smallest ids can matter, one being the query's own row.
        several = np.minimum(self.starts[at + 1] - self.starts[at], k + 1)
        step = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
        place = np.repeat(self.starts[at], several) + step
        row, scores = np.repeat(row, several), np.repeat(scores, several)
        keep = self.rows[place] != query_rows[row]
        row, scores, other = row[keep], scores[keep], self.ids[place[keep]]
        # The k best of this shard: ties to the smaller id.
        order = np.lexsort((other, -scores, row))
        row, scores, other = row[order], scores[order], other[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        return row[keep], other[keep], scores[keep]


def search(vectors: DataFrame, k: int = 20, every: int = 20, shard_bytes: int = 96 << 20, degree: int = 32, beam: int = 320, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row whose id is divisible by `every`.

    Each shard is built and searched in one task, from its rows and all queries; queries are sent
    to the shards a block at a time by a shuffle, not by broadcast. Every vector is indexed. A
    shard's vectors and edges take shard_bytes, unless shard_rows says how many rows it has.
    """
    rows = vectors.where(valid(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialise(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    counted = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)

    def shards_of(dim: int, n: int) -> int:
        room = shard_rows or max(1, shard_bytes // (12 * dim + 6 * degree + 24))
        return max(1, -(-n // room))

    # One row for each length of vector that occurs; a table has one as a rule.
    shards = F.create_map(*[F.lit(x) for d, n in counted.items() for x in (d, shards_of(d, n))])
    spread = rows.withColumn("shards", shards[F.col("dim")])
    stored = spread.withColumn("shard", F.pmod(F.xxhash64("id", "row"), F.col("shards")).cast("int")).withColumn("query", F.lit(False))
    asked = spread.where(F.col("id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("query", F.lit(True))
    columns = ["dim", "shard", "query", "id", "row", "v"]
    dealt = stored.select(*columns).unionByName(asked.select(*columns)).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            dims, shard_of = np.asarray(b.column(0)), np.asarray(b.column(1))
            asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            change = np.flatnonzero((dims[1:] != dims[:-1]) | (shard_of[1:] != shard_of[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = [0, *change.tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                now = (int(dims[s]), int(shard_of[s]))
                if now != key:
                    key, parts, shard = now, [], None
                ids, own = np.asarray(b.column(3).slice(s, e - s)), np.asarray(b.column(4).slice(s, e - s))
                values = b.column(5).slice(s, e - s).flatten().to_numpy().reshape(e - s, now[0])
                if not asks[s]:
                    parts.append((ids, own, values))
                    continue
                if shard is None:
                    if not parts:
                        continue
                    shard = Shard(*(np.concatenate([p[i] for p in parts]) for i in range(3)), degree, max(64, 2 * degree))
                    parts = []
                row, other, scores = shard.answer(own, values, k, beam)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[row]), pa.array(other), pa.array(scores)], ["asked", "query_id", "id", "score"])

    near = dealt.mapInArrow(run, "asked bigint, query_id bigint, id bigint, score double")
    # Of each query row, k rows of each shard meet.
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
