"""Operator 10: near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles, as 64-bit hashes; from the set come a
   128-bit digest, its size, and a signature of minima. Texts with equal sets form one class,
   of which only the smallest id goes on.
2. Bands of the signature give bucket keys. Their number and width are the widest that miss a
   pair at the threshold with a chance below `miss`.
3. In each bucket, every member is paired with the smallest one. A pair's signatures are
   compared sixteen minima at a time; it is dropped once the posterior probability that its
   similarity reaches the threshold is below `miss` (uniform prior). Survivors are confirmed on
   their full sets. So a bucket of n copies costs n pairs.
4. Buckets that hold more than one component after that are searched for pairs between different
   components: first, in blocks, by the sequential test on the signatures alone, which leaves the
   members that have a plausible partner; then these, in blocks of bounded bytes, on their full
   sets. No row is written for a pair. Components are found again with these links. No bucket is
   capped and no pair is dropped but by the tests above.

Lower-casing is of A-Z alone; words are runs of bytes other than blanks and 09-0D. A text with
fewer words than a shingle has its whole sequence as its one shingle. Null, empty and blank
texts have an empty set and are linked with nothing, not even each other. Very long texts are read
whole, one at a time, at about 60 bytes of memory for each byte of text. A pair at exactly the
threshold is linked. A row without id joins the component of its copies; without copies its
component is null. Rows that share an id are documents of that id. Further columns are ignored by
link and kept by keep_first, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import as_bytes, fresh, join_counted, left_join_counted, materialise, mix64, resident, slices
from marlstone.llm.bpe import Memo
from marlstone.llm.components import components

MINIMA = 128
STEP = 16
BLOCK = 4096  # members whose signatures meet, 512 bytes each
HOT = 1_000_000  # rows of one key from which on it is joined apart
BLOCK_BYTES = 4 << 20  # of full sets that meet

_rng = np.random.default_rng(20)
_FACTORS = (_rng.integers(1 << 31, size=MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_OFFSETS = _rng.integers(1 << 32, size=MINIMA, dtype=np.uint32)


def _words() -> Memo:
    return resident("shingles", lambda: Memo(xxhash.xxh3_64_intdigest, 100_000))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, n)
    width = min(n, k)
    acc = mix64(h[: n - width + 1] + np.uint64(width))
    for j in range(1, width):
        acc = mix64(acc * np.uint64(0xA24BAED4963EE407) + h[j : n - width + 1 + j])
    return np.unique(acc)


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of a set under MINIMA hash functions."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _FACTORS + _OFFSETS
        np.minimum(out, (part ^ (part >> np.uint32(15))).min(axis=0), out=out)
    return out


def banding(threshold: float, miss: float) -> tuple[int, int]:
    """(bands, rows): the widest bands that miss a pair at the threshold with a chance below miss."""
    for rows in range(16, 0, -1):
        bands = MINIMA // rows
        if (1 - threshold**rows) ** bands < miss:
            return bands, rows
    return MINIMA, 1


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature (documents in rows)."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    acc = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for j in range(rows):
        acc = mix64(acc * np.uint64(0xA24BAED4963EE407) + parts[:, :, j])
    return acc.view(np.int64)


def least_matches(threshold: float, miss: float) -> list[int]:
    """After 16, 32, ... minima: how many must match for the similarity to reach the threshold with a posterior of miss at least.

    Under a uniform prior that posterior, with m of n matching, is the chance that a binomial
    count of n + 1 trials at the threshold is at most m.
    """
    out = []
    for n in range(STEP, MINIMA + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the pairs (rows of a and b) that no step of the sequential test rejects."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, MINIMA)


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sig) of every row, from its whole text; sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sizes, digests, sigs = [], [], []
            for text in as_bytes(b.column(1)):
                found = shingles(text, k)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "digest", "sig"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n bigint, digest binary, sig binary")


def _keyed(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(_matrix(b.column(2)), bands, rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))], ["rep", "n", "keys"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "rep bigint, n bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "rep", "n")


def _sizes_allow(a: str, b: str, percent: int) -> F.Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _plausible(pairs: DataFrame, classes: DataFrame, least: list[int]) -> DataFrame:
    """The pairs (a, b) whose signatures pass the sequential test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = survivors(_matrix(b.column(2)), _matrix(b.column(3)), least)
                yield b.select([0, 1]).take(pa.array(keep))

    sigs = classes.select("rep", "sig")
    rows = pairs.join(sigs.withColumnsRenamed({"rep": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"rep": "b", "sig": "sig_b"}), "b")
    return rows.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _texts_of(ids: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(id, text, digest) of the classes whose ids are given.

    Only these texts move: the ids are broadcast to the scan if they are at most broadcast_rows
    (8 bytes each), else they meet it in a shuffled join. The class's digest tells which row is
    meant if several share an id.
    """
    ids = materialise(ids.distinct(), "wanted")
    wanted = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return texts.join(classes.select(F.col("rep").alias("id"), "digest"), "id")


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, id_col: str, text_col: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, exactly; as links (u, v)."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = materialise(_texts_of(ids, docs, classes, id_col, text_col, broadcast_rows), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}

        def full(text: bytes, digest: bytes) -> np.ndarray | None:
            found = recent.get(digest)
            if found is None:
                found = shingles(text, k)
                if xxhash.xxh3_128_digest(found.tobytes()) != digest:
                    return None
                if len(recent) >= 32:
                    recent.clear()
                recent[digest] = found
            return found

        for b in slices(batches, "text_a"):
            keep = []
            for ta, da, tb, db in zip(as_bytes(b.column(2)), b.column(3).to_pylist(), as_bytes(b.column(4)), b.column(5).to_pylist(), strict=True):
                x, y = full(ta, da), full(tb, db)
                common = 0 if x is None or y is None else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    side = lambda s: texts.withColumnsRenamed({"id": s, "text": f"text_{s}", "digest": f"digest_{s}"})
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "digest_a", "text_b", "digest_b")
    return rows.mapInArrow(run, "u bigint, v bigint")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first `keys` columns of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            now = tuple(c[s] for c in cols)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """rows (with key and rep) once for each pair of blocks that their own block is part of, grouped by key and pair and sorted by it.

    A bucket is cut into blocks by a hash of the member; each pair of blocks is a group of its
    own, so no group exceeds two blocks however large the bucket.
    """
    columns = [c for c in rows.columns if c != "key"]
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _partners(t: pa.Table, sig: np.ndarray, bands: int, rows_per_band: int, percent: int, least: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(member, its plausible partners) of a group, as places in it: of other components, of sizes that can reach the similarity, and this bucket's to see to.

    Of the buckets that two members share, the one of the smallest key sees to the pair. Pairs of
    different components all have a member outside the largest one, so that one is not walked.
    """
    own, component, n = (t.column(c).to_numpy() for c in ("own", "component", "n"))
    crossed = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    names, of, sizes = np.unique(component, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    keys, own_key = band_keys(sig, bands, rows_per_band), t.column("key")[0].as_py()
    for x in np.flatnonzero(of != np.argmax(sizes)):
        other = (of != of[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if crossed:
            other &= own != own[x]
        y = np.flatnonzero(other)
        if len(y):
            y = y[survivors(np.broadcast_to(sig[x], (len(y), MINIMA)), sig[y], least)]
        if len(y):
            shared = np.where(keys[y] == keys[x], keys[x], np.iinfo(np.int64).max).min(axis=1)
            y = y[shared == own_key]
        if len(y):
            yield x, y


def _between_components(members: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, bands: int, rows_per_band: int, least: list[int], id_col: str, text_col: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Links (u, v) between different components within a bucket, confirmed on full sets; every such pair is looked at.

    Buckets with the same members count once. The first pass moves signatures alone; full sets are
    made of, and move with, the members that have a plausible partner. Of a member's links to one
    component, which all say the same, a group gives the closest.
    """
    labelled = members.join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = materialise(labelled.select("key", "rep", "component"), "labelled")
    mixed = labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(2), "rep").cast("decimal(20,0)")).alias("h2")).where("low < high")
    mixed = mixed.groupBy("size", "h1", "h2").agg(F.min("key").alias("key")).select("key", "size")
    rows = materialise(labelled.join(mixed, "key"), "mixed")
    signed = classes.select("rep", "n", "sig")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            sig = _matrix(t.column("sig").combine_chunks())
            live = np.zeros(len(sig), bool)
            for x, y in _partners(t, sig, bands, rows_per_band, percent, least):
                live[x], live[y] = True, True
            if live.any():
                yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[live]) for c in ("key", "rep", "component")], ["key", "rep", "component"])

    first = _in_blocks(rows.join(signed, "rep"), F.ceil(F.col("size") / BLOCK)).drop("size")
    live = materialise(first.mapInArrow(plausible, "key bigint, rep bigint, component bigint").distinct(), "live")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [shingles(t, k).tobytes() for t in as_bytes(b.column(1))]
            keep = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(found, b.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["rep", "full"]).filter(keep)

    texts = _texts_of(live.select(F.col("rep").alias("id")), docs, classes, id_col, text_col, broadcast_rows)
    sets = materialise(texts.mapInArrow(full_sets, "rep bigint, full binary").dropDuplicates(["rep"]), "sets")
    sized = live.join(signed, "rep")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum(8 * F.col("n") + 4 * MINIMA) / BLOCK_BYTES).alias("blocks_of"))
    second = _in_blocks(sized.join(blocks, "key").join(sets, "rep"), F.col("blocks_of")).drop("blocks_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            rep, component, n = (t.column(c).to_numpy() for c in ("rep", "component", "n"))
            # Numbers for the shingles of this group, members one after another.
            values, flat = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("full").to_pylist()]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            marked = np.zeros(len(values), bool)
            out: list[tuple[int, int]] = []
            for x, y in _partners(t, _matrix(t.column("sig").combine_chunks()), bands, rows_per_band, percent, least):
                own_shingles = flat[starts[x] : starts[x] + n[x]]
                marked[own_shingles] = True
                common = np.add.reduceat(marked[flat], starts, dtype=np.int64)[y]
                marked[own_shingles] = False
                union = n[x] + n[y] - common
                linked = (common > 0) & (100 * common >= percent * union)
                best: dict[int, tuple[float, int]] = {}
                for z, c, u in zip(y[linked].tolist(), common[linked].tolist(), union[linked].tolist(), strict=True):
                    best[component[z]] = max(best.get(component[z], (0.0, -int(rep[z]))), (c / u, -int(rep[z])))
                out.extend((int(rep[x]), -z) for _, z in best.values())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["u", "v"])

    return second.mapInArrow(run, "u bigint, v bigint")


def link(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    threshold = percent / 100
    bands, rows = banding(threshold, miss)
    least = least_matches(threshold, miss / (MINIMA // STEP))
    sketches = materialise(sketch(docs, k, id_col, text_col), "sketches")
    classes = sketches.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("n", "sig"), "id").alias("s"))
    classes = materialise(classes.select("digest", "rep", "copies", "s.n", "s.sig"), "classes")

    keyed = _keyed(classes, bands, rows)
    centres = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("size")).where("size > 1").select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"), "size")
    members = materialise(join_counted(keyed, centres, "key", "size", classes.count() * bands).drop("size"), "members")
    pairs = members.where((F.col("rep") != F.col("centre")) & _sizes_allow("n", "centre_n", percent)).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    plausible = materialise(_plausible(pairs, classes, least), "plausible")
    links = materialise(_confirm(plausible, docs, classes, k, percent, id_col, text_col), "links")
    found = materialise(components(links), "components")

    more = materialise(_between_components(members, found, docs, classes, k, percent, bands, rows, least, id_col, text_col), "links")
    if more.head(1):
        found = materialise(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")

    of_class = classes.select("digest", "rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component"))
    alone = sketches.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    own = sketches.where("n > 0").select("id", "n", "digest")
    own = left_join_counted(own, of_class, "digest", "copies", F.lit(120)) if sketches.count() >= HOT else own.join(of_class, "digest", "left")
    joined = own.select("id", "n", F.col("component").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, or any of them if several share it or none has one.

    Rows get a number of their own, stored with them, and are linked and removed by it: ids may be
    null or shared. Rows without words are in no group and all stay.
    """
    mine = fresh("row")
    rows = materialise(docs.withColumn(mine, F.monotonically_increasing_id()), "rows")
    found = materialise(link(rows, k, percent, id_col=mine, text_col=text_col, **more).select(F.col(mine).alias("row"), "component_id"), "found")
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    ids = rows.select(F.col(mine).alias("row"), F.col(id_col).cast("bigint").alias("id"))
    grouped = join_counted(found, several, "component_id", "n", found.count(), HOT)
    members = materialise(grouped.select("component_id", "row").join(ids, "row"), "members")
    # Tasks find the smallest of their own rows before any are sent.
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("f")).select(F.col("f.row").alias("row"))
    gone = members.join(first, "row", "left_anti").select(F.col("row").alias(mine))
    return rows.join(materialise(gone, "gone"), mine, "left_anti").select(*(rows[c] for c in docs.columns))
