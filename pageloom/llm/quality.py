"""Quality classifier: interpolated modified Kneser-Ney over characters, trained on trusted text, by sharded count joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded, by_key, cut, fresh, released, stored
from .toxicity import chunks

#: Characters in a gram, bits of a character's code, codes around a text. Code points from OWN on share OWN codes by a hash.
ORDER, BITS, BEGIN, END, OWN = 4, 15, 1, 2, 1 << 14
#: Share of trusted documents, by language, whose perplexity passes; characters at the language's mean that temper short texts.
QUANTILE, TEMPER = 0.99, 50
#: One in FOLDS trusted texts (by a hash of the text) sets the threshold and is not trained on, in languages with LEAST or more.
FOLDS, LEAST = 5, 50
#: Bytes of text in a block, about: grams are told apart in a block before they meet the model.
BLOCK = 8 << 20
#: Bytes of text in a task that reads documents, at least: smaller partitions are put together.
TASK = 64 << 20
#: How hard the texts of a block are compressed before they are shuffled.
LEVEL = 6
#: Shards of grams, at least, and bytes of text for each.
SHARDS, SHARD_BYTES = 64, 256 << 20
#: Nodes of a plan that reads the same rows in the same tasks each time.
STEADY = {"LogicalRelation", "LocalRelation", "Project", "Filter"}
#: Rows of a table by language or of document ids that are broadcast, at most.
LANGUAGES, HELD_IDS = 100_000, 2_000_000


def codes(points: np.ndarray) -> np.ndarray:
    """A code of BITS bits for each code point."""
    mixed = (points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
    return np.where(points < OWN, points.astype(np.int64), OWN + mixed.astype(np.int64))


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character and at each text's end, and the text it is in. Grams look back over the begin."""
    data = [np.frombuffer((t or "").encode("utf-32-le"), "<u4") for t in texts]
    lengths = np.array([len(d) for d in data], np.int64) + order
    flat = np.full(int(lengths.sum()), BEGIN, np.int64)
    ends = np.cumsum(lengths)
    at = np.ones(len(flat), bool)
    for k in range(1, order):
        at[ends - lengths + k - 1] = False
    where = np.nonzero(at)[0]
    at[ends - 1] = False
    flat[at] = codes(np.concatenate([*data, np.zeros(0, np.uint32)]))
    flat[ends - 1] = END
    code = np.zeros(len(where), np.int64)
    for k in range(order):
        code = code << BITS | flat[where - order + 1 + k]
    return code, np.repeat(np.arange(len(texts)), lengths - order + 1)


def _languages(b: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    for lang, rows in b.groupby(b["lang"].fillna(""), sort=False):
        for lo, hi in chunks(rows["text"]):
            yield lang, rows.iloc[lo:hi]


def _counted(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, rows in _languages(b):
                gram, n = np.unique(grams(rows["text"].tolist(), order)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    return run


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as a table (lang, k, kind, code, value): kind "p" has the discounted share of a gram of k characters, kind
    "b" the weight that a context of k - 1 characters leaves to the shorter gram.

    Counts of the longest grams are summed by gram over all trusted text (combined in each task first). A shorter gram counts
    the different characters seen before it. Discounts come from the counts of counts, by language and length; each count
    is joined with them and with its context's sums, both sharded by key. A null language is the language ""; repeated rows
    count as often as they are there; no rows give an empty model.
    """
    bound_batches(trusted.sparkSession)
    counts = cut(trusted.select("lang", "text").mapInPandas(released(_counted(order)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    level, levels = counts, [counts.withColumn("k", F.lit(order))]
    for k in range(order - 1, 0, -1):
        level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
        levels.append(level.withColumn("k", F.lit(k)))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in range(1, 5))
    stats = every.groupBy("lang", "k").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = n1 / F.nullif(n1 + 2 * n2, F.lit(0.0))
    # where counts of counts are too few for the estimate, fixed discounts stand in
    bound = lambda value, i, spare: F.when((n1 > 0) & (n2 > 0) & (value > 0), F.least(value, F.lit(i - 0.05))).otherwise(F.lit(spare))
    discounts = stats.select(
        "lang", "k", bound(1 - 2 * y * n2 / F.nullif(n1, F.lit(0.0)), 1, 0.5).alias("d1"),
        bound(2 - 3 * y * n3 / F.nullif(n2, F.lit(0.0)), 2, 1.0).alias("d2"), bound(3 - 4 * y * n4 / F.nullif(n3, F.lit(0.0)), 3, 1.5).alias("d3"),
    )
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    cutoff = cut(every.join(discounts, ["lang", "k"]).select("lang", "k", "gram", F.shiftright("gram", BITS).alias("context"), "n", d.alias("d")))
    contexts = cutoff.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    shares = cutoff.join(contexts, ["lang", "k", "context"]).select("lang", "k", F.lit("p").alias("kind"), F.col("gram").alias("code"), ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
    return cut(shares.unionByName(contexts.select("lang", "k", F.lit("b").alias("kind"), F.col("context").alias("code"), (F.col("left") / F.col("total")).alias("value"))))


def _blocks(batches: Iterator[pa.RecordBatch], at_text: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of a task in blocks of about BLOCK bytes of text. Where a block ends follows from the rows alone."""
    first, size, number = TaskContext.get().partitionId() << 32, 0, -1
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(at_text)), 0).to_numpy().astype(np.int64)
        ends = size + np.cumsum(n)
        block = (ends - n) // BLOCK
        edges = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(block)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if block[lo] != number:
                if held:
                    yield first + number, held
                held, number = [], int(block[lo])
            held.append(b.slice(lo, hi - lo))
        size = int(ends[-1])
    if held:
        yield first + number, held


def _frames(batches: list[pa.RecordBatch], at_lang: int, at_text: int) -> Iterator[tuple[int, str, pd.DataFrame]]:
    """(first row's number of a batch in the block, language, its rows): a share of a batch at a time."""
    base = 0
    for b in batches:
        frame = pd.DataFrame({"lang": b.column(at_lang).to_pandas(), "text": b.column(at_text).to_pandas()})
        for lang, rows in _languages(frame):
            yield base, lang, rows
        base += b.num_rows


def _pack(grams_: np.ndarray) -> bytes:
    """Sorted grams as compressed differences."""
    return zstandard.compress(np.diff(grams_, prepend=0).astype("<i8").tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), "<i8"))


def _block_grams(order: int, shards: int):
    """The different grams of each block, by language and shard, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, 1):
            found: dict[str, list[np.ndarray]] = {}
            for _, lang, rows in _frames(held, 0, 1):
                found.setdefault(lang, []).append(np.unique(grams(rows["text"].tolist(), order)[0]))
            for lang, parts in found.items():
                gram = np.unique(np.concatenate(parts))
                shard = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards
                gram = gram[np.argsort(shard, kind="stable")]
                ends = np.cumsum(np.bincount(shard, minlength=shards))
                some = [(k, gram[a:e]) for k, (a, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if e > a]
                n = len(some)
                columns = [pa.array([k for k, _ in some], pa.int32()), pa.array([block] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array([_pack(g) for _, g in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "lang", "grams"])

    return run


def _different(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different grams of each shard and language, from all blocks."""
    for (shard, lang), rows in by_key(batches, ["shard", "lang"]):
        yield pd.DataFrame({"shard": shard, "lang": lang, "gram": np.unique(np.concatenate([_unpack(g) for g in rows["grams"]]))})


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of packed grams, each after its grams' shares: what each block's grams cost, -ln p in single precision."""
    shard, known, held = None, {}, []
    for b in batches:
        last = b.column("grams").is_valid().to_numpy(zero_copy_only=False)
        at, lang = b.column("shard").to_numpy(), b.column("lang").to_pylist()
        runs = np.nonzero(np.diff(at))[0] + 1
        for lo, hi in pairwise([0, *runs.tolist(), len(at)]):
            if lo == hi:
                continue
            if at[lo] != shard:
                shard, known, held = at[lo], {}, []
            values = lo + int((~last[lo:hi]).sum())  # shares come first
            if values > lo:
                held.append(b.slice(lo, values - lo))
            if values == hi:
                continue
            if held:
                table = pa.Table.from_batches(held)
                of = table["lang"].combine_chunks().dictionary_encode()
                code, gram, cost = of.indices.to_numpy(), table["gram"].to_numpy(), -np.log(table["p"].to_numpy())
                known, held = {name: (gram[code == k], cost[code == k]) for k, name in enumerate(of.dictionary.to_pylist())}, []
            costs = []
            for k in range(values, hi):
                keys, cost = known[lang[k]]
                costs.append(cost[np.searchsorted(keys, _unpack(b.column("grams")[k].as_py()))].astype("<f4").tobytes())
            part = b.slice(values, hi - values)
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("lang"), part.column("grams"), pa.array(costs, pa.binary())], ["block", "lang", "grams", "costs"])


def _packed(at_text: int):
    """Each block's rows as one compressed value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, at_text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                for b in held:
                    out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return run


def _summed(order: int, at_lang: int, at_text: int, names: list[str]):
    """Blocks' rows, each after its grams' values: the sum of -ln p and the number of grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            packed = np.nonzero(b.column("rows").is_valid().to_numpy(zero_copy_only=False))[0].tolist()
            for lo, hi in zip([0, *(k + 1 for k in packed)], [*packed, b.num_rows], strict=True):
                held.append(b.slice(lo, hi - lo))
                if hi < b.num_rows:
                    yield from rows_of(held, b.column("block")[hi].as_py(), b.column("rows")[hi].as_buffer())
                    held = []

    def rows_of(values: list[pa.RecordBatch], block: int, packed: pa.Buffer) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(packed) as stream:
            rows = list(stream)
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in values:
            for of, lang, gram, cost in zip(*(b.column(c).to_pylist() for c in ("block", "lang", "grams", "costs")), strict=True):
                if of != block:
                    raise RuntimeError("two reads of the documents differ; store them first")
                parts.setdefault(lang, []).append((_unpack(gram), np.frombuffer(cost, "<f4").astype("f8")))
        known = {}
        for lang, some in parts.items():
            gram, cost = (np.concatenate(x) for x in zip(*some, strict=True))
            by_gram = np.argsort(gram)
            known[lang] = gram[by_gram], cost[by_gram]
        total = sum(b.num_rows for b in rows)
        nll, n = np.zeros(total), np.zeros(total, np.int64)
        for base, lang, part in _frames(rows, at_lang, at_text):
            code, row = grams(part["text"].tolist(), order)
            keys, cost = known.get(lang, (np.zeros(0, np.int64), np.zeros(0)))
            at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
            if not len(keys) or (keys[at] != code).any():
                raise RuntimeError("two reads of the documents differ; store them first")
            place = base + part.index.to_numpy()
            nll[place] = np.bincount(row, weights=cost[at], minlength=len(part))
            n[place] = np.bincount(row, minlength=len(part))
        base = 0
        for b in rows:
            upto = base + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nll[base:upto]), pa.array(n[base:upto])], names)
            base = upto

    return run


def shares(found: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """found (lang, gram and other columns) with p, the share of each gram's last character: from the even share up, each length adds its own
    share to what it leaves. Length by length the grams meet the model's shards."""
    known = found.withColumn("p", F.lit(2.0**-BITS))
    for k in range(1, order + 1):
        code = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        part = lambda kind, name: model.where((F.col("k") == k) & (F.col("kind") == kind)).select("lang", F.col("code").alias(name), F.col("value").alias(f"v_{name}"))  # noqa: B023, E731
        both = known.withColumn("g", code).withColumn("c", F.shiftright(code, BITS)).join(part("p", "g"), ["lang", "g"], "left").join(part("b", "c"), ["lang", "c"], "left")
        p = F.when(F.col("v_c").isNull(), F.col("p")).otherwise(F.coalesce("v_g", F.lit(0.0)) + F.col("v_c") * F.col("p"))
        known = both.select(*found.columns, p.alias("p"))
    return known


def _steady(docs: DataFrame) -> bool:
    """Does every read of docs give the same rows to the same tasks? Only a plain read of files (or of rows in the plan) does:
    behind a shuffle or a join rows come in the order in which they happen to arrive."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    for node in nodes:
        if node.nodeName() not in STEADY:
            return False
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return plan.deterministic()


def scored(docs: DataFrame, model: DataFrame, nll: str = "nll", n: str = "n", order: int = ORDER) -> DataFrame:
    """docs with two more columns: the sum of -ln p over a text's characters and its end, and their number.

    By count joins in shards, the same way at every size. Each task first sums its documents' grams up to the different ones
    in a block of about BLOCK bytes of text, packed by shard (a hash of the gram). The different grams of each shard are joined
    with the model, length by length; what they cost comes back to the blocks that have them, packed again, where the texts of
    the block (packed into one value) look it up. A task holds one block and its grams, or one shard's different grams. docs is
    read twice and must give the same rows in the same tasks, as tables do; anything else than a plain read of files is stored in
    the shared folder first. Small partitions are put together. A null text is empty; a null language is "".
    """
    bound_batches(docs.sparkSession)
    docs = docs if _steady(docs) else stored(docs, "docs")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK)))
    at_text, at_lang = docs.columns.index("text"), docs.columns.index("lang")
    shards = max(SHARDS, total // SHARD_BYTES)
    found = stored(docs.select("lang", "text").mapInArrow(released(_block_grams(order, shards)), "shard int, block long, lang string, grams binary"), "grams")
    dealt = found.select("shard", "lang", "grams").repartition("shard").sortWithinPartitions("shard", "lang")
    known = shares(dealt.mapInPandas(released(_different), "shard int, lang string, gram long"), model, order)
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = known.select("shard", "lang", "gram", "p", blank("long", "block"), blank("binary", "grams")).unionByName(
        found.select("shard", "lang", blank("long", "gram"), blank("double", "p"), "block", "grams")
    )
    priced = both.repartition("shard").sortWithinPartitions("shard", F.col("grams").isNotNull(), "lang", "gram").mapInArrow(released(_priced), "block long, lang string, grams binary, costs binary")
    packed = docs.mapInArrow(released(_packed(at_text)), "block long, rows binary").select("block", blank("string", "lang"), blank("binary", "grams"), blank("binary", "costs"), "rows")
    # packed comes first, so its tasks have the numbers that they had as the grams were counted
    rows = packed.unionByName(priced.withColumn("rows", F.lit(None).cast("binary")))
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("rows").isNotNull())
    schema = docs.select("*", F.lit(0.0).alias(nll), F.lit(0).cast("long").alias(n)).schema
    for f in schema.fields:
        f.nullable = True
    return dealt.mapInArrow(released(_summed(order, at_lang, at_text, [*docs.columns, nll, n])), schema)


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, text) of documents that labels (doc_id, quality, toxic) calls good and not toxic."""
    ids = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").join(bounded(ids, HELD_IDS), "doc_id", "left_semi").select("lang", "text")


def _limits(docs: DataFrame, labels: DataFrame, quantile: float, order: int) -> tuple[DataFrame, DataFrame]:
    """(model, a row (name, mean, threshold) for each language)."""
    rows = trusted_text(docs, labels)
    sizes = bounded(rows.groupBy("lang").agg(F.count("*").alias("texts")), LANGUAGES)
    apart = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(FOLDS)) == 0
    held = (F.col("texts") >= LEAST) & F.coalesce(apart, F.lit(False))
    trusted = rows.join(sizes, "lang")
    model = train(trusted.where(~held).select("lang", "text"), order)
    judges = stored(trusted.where(held | (F.col("texts") < LEAST)).select("lang", "text"), "judges")
    known = cut(scored(judges, model, order=order).select(F.col("lang").alias("name"), "nll", "n"))
    means = bounded(known.groupBy("name").agg((F.sum("nll") / F.sum("n")).alias("mean")), LANGUAGES)
    of = known.join(means, "name").groupBy("name").agg(F.first("mean").alias("mean"), F.percentile_approx(_tempered("nll", "n", "mean"), quantile, 100000).alias("threshold"))
    return model, bounded(of, LANGUAGES)


def _tempered(nll: str, n: str, mean: str) -> Column:
    return F.exp((F.col(nll) + TEMPER * F.col(mean)) / (F.col(n) + TEMPER))


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, order: int, out: list[str]) -> DataFrame:
    model, limits = _limits(docs, labels, quantile, order)
    nll, n, name, mean, threshold = fresh(docs, "nll", "n", "name", "mean", "threshold")
    rows = scored(docs, model, nll, n, order)
    both = rows.join(limits.toDF(name, mean, threshold), F.coalesce(rows.lang, F.lit("")) == F.col(name), "left")
    found = [_tempered(nll, n, mean), F.col(threshold), F.coalesce(_tempered(nll, n, mean) <= F.col(threshold), F.lit(True))]
    return both.select(*docs.columns, *[c.alias(x) for c, x in zip(found, out, strict=True)])


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER) -> DataFrame:
    """docs with perplexity, threshold (by language) and keep, one row for each row of docs.

    perplexity is by character and tempered: TEMPER characters at the language's mean are added, so that short texts don't
    stand out by chance. threshold: the quantile over trusted documents of the language that the model has not seen (one in
    FOLDS; in languages with fewer than LEAST trusted documents all of them, which the model has seen). Null and empty texts
    have the end alone to judge. A language without trusted text has neither (null) and its documents stay. Columns of docs
    that are called perplexity, threshold or keep give way. Repeated rows are judged alike; an empty table gives an empty one.
    """
    out = ["perplexity", "threshold", "keep"]
    return _judged(docs.select([c for c in docs.columns if c.lower() not in out]), labels, quantile, order, out)


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' columns, whatever their names."""
    out = fresh(docs, "perplexity", "limit", "keep")
    return _judged(docs, labels, quantile, ORDER, out).where(F.col(out[2])).select(docs.columns)
