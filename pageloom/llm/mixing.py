"""Mixing sources to target weights by Efraimidis-Spirakis keys and prefix sums within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, content_key, cut, fresh

WEIGHTS, LIMIT = (5, 2, 1), 3
#: Rows of a source in one bucket of keys, about; prefix sums run within buckets, then over the buckets' sums.
BUCKET_ROWS = 4096
#: Sources whose totals are broadcast, at most, and rows of a source that are looked at to close what its prefix leaves.
SOURCES, CLOSING = 100_000, 1024
WORDS = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sizes (source, source_size) with target: shares of the total by weight, none over limit times the source.

    Weights repeat over the sources by code point, null last. What the limit cuts off is shared again by weight among the
    others until none is above. In closed form: sources are filled in the order of size by weight; the level is fixed at
    the first one that does not reach its limit. The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    each = sizes.select("source", "source_size", w.cast("double").alias("w"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, all_w = F.sum("source_size").over(whole), F.sum("w").over(whole)
    left = total - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (all_w - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = each.withColumn("level", level).withColumn("nth", F.row_number().over(order)).withColumn("full", F.col("level") * F.col("w") >= limit * F.col("source_size"))
    first = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(whole)
    fixed = ranked.withColumn("level", first["level"])
    target = F.when(F.col("full") | F.col("level").isNull(), F.lit(float(limit)) * F.col("source_size")).otherwise(F.col("level") * F.col("w"))
    return fixed.select("source", "source_size", target.alias("target"))


def _per_source(rows: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """For each source: size, target, epochs (whole times that it is taken), budget (what is left of the target), number of
    rows, and how many rows there are of each weight, to half a power of two."""
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    near = F.pow(F.lit(2.0), F.round(2 * F.log2("weight")) / 2)
    classes = rows.groupBy("source", near.alias("weight")).agg(F.count("*").alias("n"))
    counts = classes.groupBy("source").agg(F.sum("n").alias("source_rows"), F.collect_list(F.struct("weight", "n")).alias("classes"))
    per = totals.alias("t").join(counts.alias("c"), F.expr("t.source <=> c.source")).select("t.*", "c.source_rows", "c.classes")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return per.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))


def _bucket() -> Column:
    """The range of keys that a key is in, about BUCKET_ROWS rows each: the share of rows with smaller keys, as a row of
    weight w has a smaller one with probability 1 - exp(-key * w), times the number of buckets."""
    smaller = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["n"] * (1.0 - F.exp(-F.col("key") * c["weight"]))) / F.col("source_rows")
    return F.floor(smaller * F.ceil(F.col("source_rows") / BUCKET_ROWS)).cast("long")


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 42) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies): how often the mix takes each row of docs.

    size is the number of words (null text: 0). A source is taken in complete epochs first; for what is left of its target,
    rows are ordered by Efraimidis-Spirakis keys -ln(u) / weight and taken while their running size fits. u comes from a
    hash of doc_id, text and seed, so reruns agree; the weight is quality.weight of the doc_id (the greatest if there are
    several), else 1. Rows longer than the whole budget stand aside. Running sizes are summed within buckets, ranges of keys
    with about as many rows each, and over the buckets' sums. The prefix ends at the first row that is longer than the rest; of
    the rows behind it that aren't longer than the rest, the first CLOSING by their keys are taken one by one if they still
    fit, so that a long row doesn't keep a source from its target. Of the rows not taken then, the one whose size comes nearest
    to the rest joins if that brings the source nearer to its target. No source is taken over limit times. Empty texts are in
    the complete epochs only. Rows repeated in docs are mixed as one row each (their keys tie, and are told apart by a number).
    Other columns are ignored. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    weight = F.lit(1.0)
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.max(F.col("weight").cast("double")).alias("q_weight"))
        rows, weight = rows.join(q, rows.doc_id == q.q_id, "left"), F.coalesce(F.least(F.greatest("q_weight", F.lit(1e-6)), F.lit(1e6)), F.lit(1.0))
    rows = cut(rows.select("doc_id", "source", "size", "text_hash", weight.alias("weight")))
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash", F.lit(seed)), 11).cast("double") + 1.0) / float((1 << 53) + 1)
    keyed = rows.withColumn("key", -F.log(u) / F.col("weight"))
    joined = keyed.alias("k").join(bounded(_per_source(rows, weights, limit), SOURCES).alias("p"), F.expr("k.source <=> p.source")).drop(F.col("p.source"))
    joined = joined.withColumn("bucket", _bucket()).drop("classes")
    counted = joined.withColumn("run_size", F.when(F.col("size") <= F.col("budget"), F.col("size")).otherwise(0))
    sums = counted.groupBy("source", "bucket").agg(F.sum("run_size").alias("bucket_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(run), F.lit(0)).alias("before"))
    placed = counted.alias("j").join(starts.alias("s"), F.expr("j.bucket = s.bucket AND j.source <=> s.source")).select("j.*", "s.before")
    w = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.col("before") + F.sum("run_size").over(w)).withColumn("row", F.row_number().over(w))
    fits = (F.col("upto") <= F.col("budget")) & (F.col("run_size") > 0)
    taken = cut(summed.withColumn("fits", fits).drop("run_size", "before", "upto", "weight", "source_rows"))
    closing = bounded(_closing(taken), SOURCES)
    more = F.array_contains("c.taken", F.struct("t.bucket", "t.row"))
    out = taken.alias("t").join(closing.alias("c"), F.expr("t.source <=> c.source"), "left")
    copies = F.col("t.epochs") + F.when(F.col("t.fits") | F.coalesce(more, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return out.select("t.doc_id", "t.source", "t.text_hash", "t.size", "t.source_size", "t.target", copies.cast("long").alias("copies"))


def _closing(taken: DataFrame) -> DataFrame:
    """(source, taken: array of (bucket, row)): the rows that come after a source's prefix. At most CLOSING + 1 for each source."""
    rest = taken.groupBy("source").agg((F.first("budget") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("rest"))
    spare = taken.where("NOT fits AND size > 0").alias("a").join(bounded(rest, SOURCES).alias("r"), F.expr("a.source <=> r.source")).select("a.source", "a.size", "a.key", "a.bucket", "a.row", "r.rest")
    first = Window.partitionBy("source").orderBy("key", "bucket", "row")
    near = spare.where("size <= rest").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= CLOSING)
    listed = near.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("nth", "size", "bucket", "row"))).alias("rows"), F.first("rest").alias("rest"))
    place = "array<struct<bucket:bigint,row:int>>"
    start = F.struct(F.col("rest"), F.array().cast(place).alias("taken"))

    def step(state: Column, x: Column) -> Column:
        more = F.struct((state["rest"] - x["size"]).alias("rest"), F.concat(state["taken"], F.array(F.struct(x["bucket"], x["row"])).cast(place)).alias("taken"))
        return F.when(x["size"] <= state["rest"], more).otherwise(state)

    folded = cut(listed.select("source", F.aggregate("rows", start, step).alias("f")).select("source", "f.rest", "f.taken"))
    left = rest.alias("r").join(folded.alias("f"), F.expr("r.source <=> f.source"), "left").select("r.source", F.coalesce("f.rest", "r.rest").alias("rest"), F.coalesce("f.taken", F.array().cast(place)).alias("taken"))
    left = bounded(left, SOURCES)
    last = spare.drop("rest").alias("a").join(left.alias("l"), F.expr("a.source <=> l.source")).where(~F.array_contains("l.taken", F.struct("a.bucket", "a.row")))
    gap = F.abs(F.col("a.size") - F.col("l.rest"))
    best = last.where(gap < F.col("l.rest")).groupBy("a.source").agg(F.min(F.struct(gap.alias("gap"), "a.key", "a.bucket", "a.row")).alias("best"))
    return left.alias("l").join(best.alias("b"), F.expr("l.source <=> b.source"), "left").select("l.source", F.concat("l.taken", F.when(F.col("b.best").isNotNull(), F.array(F.struct("b.best.bucket", "b.best.row"))).otherwise(F.array()).cast(place)).alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' columns, whatever their names.

    Rows meet their plan by a hash of doc_id, source and text. Rows that repeat there share what the mix takes of them: all
    are taken as often as the least of them, and the first so many (by a hash of their other columns) once more. A null text
    counts as an empty one. An empty table gives an empty one.
    """
    k1, k2, low, more, nth, copy = fresh(docs, "k1", "k2", "low", "more", "nth", "copy")
    plan = mix(docs, quality, seed=seed)
    a, b = content_key("doc_id", "source", "text_hash")
    per = plan.groupBy(a.alias(k1), b.alias(k2)).agg(F.min("copies").alias(low), (F.sum("copies") - F.min("copies") * F.count("*")).alias(more))
    a, b = content_key("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = docs.withColumns({k1: a, k2: b}).join(per.where(F.col(low) + F.col(more) > 0), [k1, k2])
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy(k1, k2).orderBy(F.xxhash64(*plain))
    times = both.withColumn(nth, F.row_number().over(order)).withColumn(copy, F.col(low) + F.when(F.col(nth) <= F.col(more), 1).otherwise(0))
    return times.where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copy))).select(docs.columns)
