"""Operator 6: mixing sources to target weights.

Each document gets a hash-random key. Within a source, documents are ordered by key; running
totals of their sizes are made in two steps, so that no task holds a source: the keys' range is
cut into buckets, bucket totals are summed up over the source, and each bucket adds its own
running total. A source's budget is its target in words. It is met exactly: whole epochs take
every document once more, and the rest takes documents in order of key until it is used up, the
last of them in part.

Null, empty and blank texts have size 0 and are never taken. Very long texts are counted whole,
inside the engine. A null source is a source of its own and comes last. Rows that share an id, and
equal rows, count as often as they stand, and are dealt out by id and content together, so a null
id that many rows share is no hot spot; among rows with one key the smaller id comes first.
Further columns are ignored by mix and kept by take, whatever their names. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import WORD, fresh, materialise, maybe_broadcast

WEIGHTS = (1, 2, 3)
REPEATS = 3


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rank from 1 by order in column `name`: ranges first, then places within them.

    No task holds more than one range; only a count for each range meets in one place.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    # A row for each partition: bounded by the number of shuffle partitions.
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, place, n, source_size, weight, target): targets by weight, at most `repeats` times a source's size, the excess shared again.

    A common level times the weight is each source's share. Each round caps the sources whose
    share is above their limit and raises the level for the others, until none is above. Only
    sums come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    out = ranked(totals, [F.col("source").asc_nulls_last()], "place")
    turn = ((F.col("place") - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    out = materialise(out.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * repeats), "sources")
    total = out.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("limit") if capped >= 0 else F.lit(False)
        r = out.agg(F.sum(F.when(above, 1).otherwise(0)).alias("k"), F.sum(F.when(above, F.col("limit")).otherwise(0)).alias("spent"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if r["k"] is None or r["k"] == capped or not r["w"]:
            break
        capped, level = r["k"], (total - r["spent"]) / r["w"]
    return out.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("limit").cast("double"))).drop("limit")


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, mark: Column | None = None) -> DataFrame:
    """(id, source, size, mark, key, copies): what mixing needs of the rows; the texts are read once.

    Rows that are equal in id, source and mark (the text's hash, unless another is given) are one
    entry that stands `copies` times; counting them begins on each task's own rows, so however often
    a row is repeated no task holds its copies. The key is drawn from id and mark together.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    mark = F.xxhash64(F.col(text_col)) if mark is None else mark
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), mark.alias("mark"))
    rows = rows.groupBy("id", "source", "size", "mark").agg(F.count("*").alias("copies"))
    return rows.withColumn("key", F.xxhash64(F.lit(seed), "id", "mark").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))


def plan(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mark: Column | None = None) -> DataFrame:
    """(id, source, size, mark, copies, source_size, target, epochs, part) of every distinct row.

    Each copy is taken `epochs` times whole; of the last, unfinished epoch the copies together get
    `part` words, one copy after another.
    """
    sizes = materialise(sized(docs, seed, id_col, text_col, source_col, mark), "sizes")
    budgets = materialise(sources(sizes, weights, repeats).withColumnRenamed("source", "of"), "budgets")
    budgets = maybe_broadcast(budgets, F.coalesce(F.length("of"), F.lit(0)) + 48)
    rows = sizes.join(budgets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Buckets of a source grow as the root of its rows beyond half a million, so neither a bucket
    # nor the list of a source's buckets outgrows a task.
    buckets = F.ceil(F.col("n") / F.greatest(F.lit(512.0), F.sqrt(F.col("n").cast("double")))).cast("bigint")
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("key", 32) * buckets, 31)).drop("n", "weight")
    rows = rows.withColumn("here", F.col("size") * F.col("copies"))
    totals = rows.groupBy("place", "bucket").agg(F.sum("here").alias("here"))
    before = totals.select("place", "bucket", (F.sum("here").over(Window.partitionBy("place").orderBy("bucket")) - F.col("here")).alias("before"))
    within = F.sum("here").over(Window.partitionBy("place", "bucket").orderBy("key", "id", "mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    rows = rows.join(before, ["place", "bucket"]).withColumn("before", F.col("before") + within)
    budget = F.least(F.round("target").cast("bigint"), F.col("source_size") * repeats)
    epochs = F.when(F.col("source_size") > 0, F.expr("least(cast(round(target) as bigint), source_size * %d) div source_size" % repeats)).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("here"), rest - F.col("before")))
    return rows.select("id", "source", "size", "mark", "copies", "source_size", "target", epochs.alias("epochs"), part.alias("part"))


def _times(df: DataFrame, n: Column, most: int = 1 << 16) -> DataFrame:
    """Each row of df n times; rows that stand often are dealt out in lots of `most` to several tasks."""
    times, lot = fresh("n"), fresh("lot")
    rows = df.withColumn(times, n.cast("bigint")).where(F.col(times) > 0)
    once = rows.where(F.col(times) <= most).withColumn(lot, F.col(times))
    many = rows.where(F.col(times) > most).withColumn(lot, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(`{times}` - 1) div {most}")))).repartition(lot)
    many = many.withColumn(lot, F.least(F.lit(most).cast("bigint"), F.col(times) - F.col(lot) * most))
    return once.unionByName(many).withColumn(lot, F.explode(F.sequence(F.lit(1), F.col(lot).cast("int")))).drop(times, lot)


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", **more) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: how many words of it the mix takes."""
    size, part = F.col("size"), F.col("part")
    full = F.when(size > 0, F.expr("part div size")).otherwise(F.lit(0))
    left = F.when(size > 0, part % size).otherwise(F.lit(0))
    own = F.col("epochs") * size
    some = F.when(left > 0, 1).otherwise(0)
    # Of a row's copies some are taken once more, one in part, and the others not.
    kinds = F.array(F.struct((own + size).alias("taken"), full.cast("bigint").alias("n")), F.struct((own + left).alias("taken"), some.cast("bigint").alias("n")), F.struct(own.alias("taken"), (F.col("copies") - full - some).cast("bigint").alias("n")))
    rows = plan(docs, seed, id_col=id_col, **more).withColumn("kind", F.explode(F.filter(kinds, lambda k: k["n"] > 0)))
    rows = rows.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("kind.taken").cast("bigint").alias("taken"), F.col("kind.n").alias("n"))
    return _times(rows, F.col("n")).select(id_col, "size", "source_size", "target", "taken")


def take(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The mix itself: rows of docs, whole, as often as the mix takes them.

    A document of which a part is taken counts once more if that is at least half of it, so each
    source meets its budget to within half a document. Texts stay as they are. Rows that are equal
    in all columns count together: which of them stands more often makes no difference.
    """
    held = {fresh(c): c for c in docs.columns}
    rows = docs.select(*(docs[c].alias(f) for f, c in held.items()))
    name = {c: f for f, c in held.items()}
    mark = F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in rows.schema[c].dataType.simpleString() or "variant" in rows.schema[c].dataType.simpleString() else F.col(c) for c in held))
    more["source_col"] = name[more.get("source_col", "source")]
    counts = plan(rows, seed, id_col=name[id_col], text_col=name[text_col], mark=mark, **more)
    extra = F.when(F.col("size") > 0, F.round(F.col("part") / F.col("size")).cast("bigint")).otherwise(F.lit(0))
    counts = materialise(counts.select(F.col("mark").alias("of"), F.col("id").alias("of_id"), F.when(F.col("size") > 0, F.col("epochs")).otherwise(0).alias("each"), extra.alias("extra"), "copies").where("each > 0 or extra > 0"), "copies")
    found = rows.withColumn("mark", mark).join(maybe_broadcast(counts, F.lit(40), 4 << 20), (F.col("mark") == F.col("of")) & F.col(name[id_col]).eqNullSafe(F.col("of_id")))
    # A row that stands once takes its extra turn itself; of equal rows one takes those of all.
    alone = _times(found, F.col("each") + F.when(F.col("copies") == 1, F.col("extra")).otherwise(0)).select(*held)
    equal = found.where("copies > 1 and extra > 0").groupBy("mark", "of_id").agg(F.first(F.struct(*held)).alias("row"), F.max("extra").alias("extra"))
    equal = _times(equal, F.col("extra")).select("row.*")
    return alone.unionByName(equal).select(*(F.col(f).alias(c) for f, c in held.items()))
