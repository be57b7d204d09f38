"""Source divergence audit: frequent terms by iceberg prefix refinement, then exact differences between sources."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, bounded, cut
from .words import Words, inside, numbered

#: Terms are runs of A-Z, a-z and what isn't ASCII.
TERM = inside((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes of the first prefixes (twice as many at each level), and bits of the table of kept prefixes that every task holds.
FIRST, BITS = 4, 1 << 26
#: Languages whose lists of sources are broadcast, at most; more are joined by a shuffle.
LANGS = 2_000

Filters = list[tuple[int, Broadcast]]


def _of_lang(langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of each row's language."""
    code = langs.dictionary_encode()
    each = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in code.dictionary.to_pylist()], np.uint64)
    return each[code.indices.to_numpy()] if len(each) else np.zeros(0, np.uint64)


def _passes(words: Words, salt: np.ndarray, length: int, bits: np.ndarray) -> np.ndarray:
    slot = words.hashed(length, salt[words.rows]) & np.uint64(64 * len(bits) - 1)
    return bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) != 0


def _prefixes(before: Filters, length: int):
    """For each prefix of so many bytes whose own prefix was kept: how many texts of a batch have it, and whether a term goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, salt = Words(b.column(2), TERM), _of_lang(b.column(0))
            if before:
                words = words.take(words.lengths > before[-1][0])
                words = words.take(_passes(words, salt, before[-1][0], before[-1][1].value))
            if not len(words.starts):
                continue
            h = words.hashed(length, salt[words.rows])
            number, first = numbered(h)
            n = len(first)
            pairs = pa.array(words.rows * n + number).unique().to_numpy()
            more = np.zeros(n, bool)
            more[number[words.lengths > length]] = True
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.bincount(pairs % n, minlength=n)), pa.array(more)], ["h", "n", "more"])

    return run


def _counted(filters: Filters):
    """Occurrences, and texts, of the terms whose prefixes were all kept, by language and source in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, salt = Words(b.column(2), TERM), _of_lang(b.column(0))
            keep, last = np.zeros(len(words.starts), bool), 0
            for length, bits in filters:
                these = np.flatnonzero((words.lengths > last) & (words.lengths <= length))
                keep[these[_passes(words.take(these), salt, length, bits.value)]] = True
                last = length
            words = words.take(keep)
            if not len(words.starts):
                continue
            number, first = words.distinct()
            n = len(first)
            pair, at = numbered(words.rows * n + number)
            row, term = words.rows[at], number[at]
            lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            cell, at = numbered(group[row] * n + term)
            each = np.bincount(cell, weights=np.bincount(pair, minlength=len(row)), minlength=len(at)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row[at])), b.column(1).take(pa.array(row[at])), words.texts(first[term[at]]), pa.array(each), pa.array(np.bincount(cell, minlength=len(at)))],
                ["lang", "source", "term", "n", "docs"],
            )

    return run


def _table(kept: DataFrame, bits: int) -> np.ndarray:
    """The kept prefixes as bits at the places that their hashes name: bits / 64 rows at most reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    rows = kept.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def frequent_terms(docs: DataFrame, least: int = 30, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """(lang, source, term, n, n_lang): how often each source, and its language, has each term that at least `least` of the
    language's rows hold. docs: (lang, source, text), null as ''; each row is a document, repeated rows too.

    Level by level (first, 2 first, 4 first, ... bytes) the rows with each byte prefix are counted; a prefix in fewer than
    `least` rows goes, and with it every term that begins so. Prefixes are told apart by 64-bit hashes of language and bytes,
    and a level hands the next one a table of fixed size with the kept ones: two prefixes that share a place can only keep
    too many, never too few, and what they keep is counted again as whole terms. Levels end when no kept prefix goes on.
    An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    filters: Filters = []
    length = first
    while True:
        found = rows.mapInArrow(_prefixes(filters, length), "h long, n long, more boolean")
        kept = cut(found.groupBy("h").agg(F.sum("n").alias("n"), F.max("more").alias("more")).where(F.col("n") >= least).select("h", "more"))
        filters.append((length, spark.sparkContext.broadcast(_table(kept, bits))))
        if kept.where("more").isEmpty():
            break
        length *= 2
    counted = rows.mapInArrow(_counted(filters), "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    out = cut(counted.select("*", F.sum("n").over(whole).alias("n_lang"), F.sum("docs").over(whole).alias("in_docs")).where(F.col("in_docs") >= least).drop("docs", "in_docs"))
    for _, held in filters:
        held.unpersist()
    return out


def share(count: str | Column, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), in decimals, so that no product overflows."""
    wide = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    above = (wide(count) + F.lit(5).cast("decimal(1,0)")) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", above, wide(total) + wide(kept) * F.lit(5).cast("decimal(1,0)")) + 1


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| over the terms of a task, for each pair of sources of a language; a row is a term with the sources that
    have it (places in the language's list), their p, and the p of a source that doesn't have it."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            rows = b.filter(pa.array(langs.indices.to_numpy() == k))
            none = np.array(rows.column(3)[0].as_py(), np.int64)
            p = np.tile(none, (rows.num_rows, 1))
            term = np.repeat(np.arange(rows.num_rows), np.diff(rows.column(1).offsets.to_numpy()))
            p[term, rows.column(1).flatten().to_numpy()] = rows.column(2).flatten().to_numpy()
            total = sums.setdefault(lang, np.zeros((len(none), len(none)), np.int64))
            for g in range(len(none)):
                total[g] += np.abs(p - p[:, g : g + 1]).sum(axis=0)
    for lang, total in sums.items():
        for g in range(len(total)):
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(total[g])], ["lang", "g", "s", "value"])


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from its other sources (part pair), and
    the terms that it has more of than the language, to rank `top` (part term). See frequent_terms for the terms that count.

    p of a term in a group is 1 + floor(10^9 (count + 5) / (N + 5 V)), N the group's occurrences of the V kept terms; a source
    without kept terms counts too. Values are sums of |p - q| in whole numbers. Ties of value go by the item's bytes. Null
    lang, source and text are ''; an empty table gives an empty one; other columns are ignored.

    A pair's sum is taken in tasks over rows of one term each, so neither a language nor a source is ever in one place; a task
    holds a sum for each pair of sources, as the result does.
    """
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    kept = frequent_terms(docs, least)
    of_terms = kept.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total"))
    of_groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(of_terms, "lang", "left").na.fill(0, ["own", "v", "total"])
    empty = F.when(F.col("v") > 0, share(F.lit(0), "own", "v"))
    langs = of_groups.withColumn("none", empty).groupBy("lang", "v", "total").agg(F.array_sort(F.collect_list(F.struct("source", "own", "none"))).alias("sources"))
    langs = bounded(langs, LANGS)
    here = langs.select("lang", "v", "total", F.posexplode("sources").alias("g", "s")).select("lang", "v", "total", "g", "s.source", "s.own")
    rated = kept.join(bounded(here, LANGS * 50), ["lang", "source"]).withColumn("p", share("n", "own", "v"))

    more = rated.withColumn("value", F.col("p") - share("n_lang", "total", "v")).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    rows = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p")).alias("have"))
    rows = rows.join(langs.where("v > 0"), "lang").select("lang", "have.g", "have.p", F.col("sources.none").alias("none"))
    sums = rows.mapInArrow(_differences, "lang string, g int, s int, value long").groupBy("lang", "g", "s").agg(F.sum("value").alias("value"))
    both = langs.select("lang", F.posexplode("sources").alias("g", "x"), "sources").select("lang", "g", F.col("x.source").alias("source"), F.posexplode("sources").alias("s", "y"))
    both = both.where("g <> s").join(sums, ["lang", "g", "s"], "left")
    pairs = both.select("lang", "source", F.col("y.source").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = lambda part, item: ["lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", "rank"]
    return pairs.select(*columns("pair", "item")).unionByName(terms.select(*columns("term", "term")))


#: The same rows in DuckDB SQL.
DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS n_lang
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
o AS (SELECT lang, source, sum(n)::HUGEINT AS own FROM e GROUP BY ALL),
p AS (SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000::HUGEINT * (e.n + 5)) // (o.own + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (e.n_lang + 5)) // (l.total + 5 * l.v) AS q
      FROM e JOIN o USING (lang, source) JOIN l USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM w WHERE part = 'pair' OR rank <= 50
"""
