"""Document fingerprints by winnowing, in native columns only."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a gram and grams in a window: any shared run of K + WINDOW - 1 words is sure to give a shared hash.
K, WINDOW = 3, 4
_TOP = (1 << 31) - 1
#: Rows in a range of documents, about; quantiles that bound ranges, at most; an id has bounds of its own if more than one of
#: HOT rows has it.
ROWS, QUANTILES, HOT = 1000, 4096, 256


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _rolled(word: Column, turn: int) -> Column:
    return F.shiftleft(word, turn).bitwiseOR(F.shiftrightunsigned(word, 64 - turn)) if turn else word


def _codes(hashes: Column, k: int) -> Column:
    """A long for each gram: its 32-bit hash, then the position counted down, so that the least of a window is the rightmost
    of its least hashes. The hash is the upper half of a cyclic polynomial, the rolling hash that turns by a bit as a word
    enters at one end and leaves at the other: word d of k counts turned by k - 1 - d bits."""
    part = lambda i, d: _rolled(F.get(hashes, i + d), k - 1 - d)
    gram = lambda i: reduce(Column.bitwiseXOR, [part(i, d) for d in range(k)])
    few = reduce(Column.bitwiseXOR, [F.coalesce(part(F.lit(0), d), F.lit(0).cast("long")) for d in range(k)])
    code = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(_TOP) - i)
    many = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: code(gram(i), i))
    return F.when(F.size(hashes) >= k, many).when(F.size(hashes) > 0, F.array(code(few, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _least(codes: Column, window: int) -> Column:
    last = F.greatest(F.size(codes) - window, F.lit(0))
    pick = lambda i: F.least(*[F.get(codes, i + d) for d in range(window)])
    return F.when(F.size(codes) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), pick))).otherwise(codes)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add the array of kept codes (hash and position in one long each) of a text column."""
    return (
        df.withColumn("_h", _word_hashes(F.col(text)))
        .withColumn("_c", _codes(F.col("_h"), k))
        .withColumn(out, _least(F.col("_c"), window))
        .drop("_h", "_c")
    )


def hashes(codes: Column) -> Column:
    return F.array_distinct(F.transform(codes, lambda c: F.shiftright(c, 31)))


def shown(codes: Column) -> Column:
    """hash:position for each kept gram, in the order of positions."""
    return F.concat_ws(",", F.transform(codes, lambda c: F.concat(F.lower(F.hex(F.shiftright(c, 31).bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(":"), (F.lit(_TOP) - c.bitwiseAND(F.lit(_TOP))).cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, codes): kept hashes and positions of each text. A null text is empty; an empty text has no codes; a text
    of fewer than k words is one gram of all its words. Rows repeat as in docs; other columns are ignored."""
    return with_fingerprint(docs.select("doc_id", "text"), "text", "codes", k, window).drop("text")


def _ranges(docs: DataFrame, rows_each: int = ROWS) -> Column:
    """The number of the range that a row (doc_id, hash) is in, by doc_id and then by hash: about `rows_each` rows in each.

    Up to QUANTILES quantiles of doc_id bound the ranges; with more rows each is cut evenly between its bounds. An id that
    holds a large share of the rows (there can be few) has bounds of its own and is cut by hash, as null ids are, which come
    before all others.
    """
    n, low, high, nulls = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    hot = docs.groupBy("doc_id").count().where(F.col("doc_id").isNotNull() & (F.col("count") > max(n // HOT, 4 * rows_each))).collect() if n > 4 * rows_each else []  # fewer than HOT
    total = max(1, min(QUANTILES, n // rows_each))
    inner = max(1, -(-n // (total * rows_each)))
    parts = max(1, -(-max([nulls, *(r["count"] for r in hot)]) // rows_each))
    size = max(inner, parts)
    share = F.shiftrightunsigned("hash", 11).cast("double") / float(1 << 53)
    of_hash = F.floor(share * parts)
    if low is None or n <= rows_each:
        return F.when(F.col("doc_id").isNull(), of_hash).otherwise(F.lit(size)).cast("long")
    shares = ",".join(str((i + 1) / total) for i in range(total - 1))
    found = docs.select(F.expr(f"percentile_approx(doc_id, array({shares}), 100000)")).first()[0] if total > 1 else []
    ends = sorted({low, high, *found, *(r.doc_id for r in hot), *(r.doc_id - 1 for r in hot if r.doc_id > low)})
    # 64 bounds in a group: the group first, then the bound in it
    groups = [ends[i : i + 64] for i in range(0, len(ends), 64)]
    table = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")
    nth = F.size(F.filter(table([g[-1] for g in groups[:-1]]), lambda x: x < F.col("doc_id")))
    group = F.get(F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>"), nth)
    bound = nth * 64 + F.size(F.filter(group, lambda x: x < F.col("doc_id")))
    after, upto = (F.get(table(ends), bound - d).cast("double") for d in (1, 0))
    place = F.coalesce((F.col("doc_id").cast("double") - after) / F.nullif(upto - after, F.lit(0.0)), F.lit(0.0))
    even = F.least(F.floor(place * inner), F.lit(inner - 1))
    alone = F.col("doc_id").isin([r.doc_id for r in hot]) if hot else F.lit(False)
    return F.when(F.col("doc_id").isNull(), of_hash).otherwise((bound + 1) * size + F.when(alone, of_hash).otherwise(even)).cast("long")


def with_next(docs: DataFrame, prepare, rows_each: int = ROWS) -> DataFrame:
    """Each row with the row that follows it in descending doc_id (then descending hash of the text; null ids last; after the
    last, the first): columns next_<name> for all columns of prepare(rows).

    Rows are dealt by ranges, sorted in each, and see the next row by a window over the range; the first row of each range is
    handed to the range before it. prepare runs after the rows are dealt.
    """
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    dealt = hashed.withColumn("place", F.shiftrightunsigned("hash", 1)).withColumn("bucket", _ranges(hashed, rows_each)).drop("hash")
    rows = prepare(dealt.repartition("bucket"))
    carried = [c for c in rows.columns if c not in ("bucket", "doc_id", "place")]
    order = [F.col("doc_id").desc_nulls_last(), F.col("place").desc(), F.col("text").desc()]
    w = Window.partitionBy("bucket").orderBy(*order)
    seen = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    lead = dealt.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "place", "text")).alias("top"))
    turn = Window.orderBy(F.col("bucket").desc())  # numbers alone, one for each range
    after = lead.select("bucket").select("bucket", F.coalesce(F.lead("bucket").over(turn), F.max("bucket").over(Window.partitionBy())).alias("then"))
    firsts = prepare(lead.select(F.col("bucket").alias("then"), F.col("top.text").alias("text"))).withColumnsRenamed({c: f"edge_{c}" for c in carried})
    edges = after.join(firsts, "then").drop("then").withColumnRenamed("bucket", "edge_bucket")
    out = seen.join(edges, (seen.bucket == edges.edge_bucket) & seen.next_text.isNull(), "left")
    return out.select(*rows.columns, *[F.coalesce(f"next_{c}", f"edge_{c}").alias(f"next_{c}") for c in carried])


def edited_report(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text (second half from the next document), and how alike they are.

    One row for each row of docs. A null text is an empty one; the only document is its own next; of equal doc_ids the one
    with the greater hash of its text comes first, and null ids come last; repeated rows follow each other. Other columns are
    ignored. An empty table gives an empty one.
    """
    rows = with_next(docs, lambda df: with_fingerprint(df, "text", "codes", k, window))
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = rows.select("doc_id", n.alias("n_chars"), F.concat(F.substr("text", F.lit(1), (n - half).cast("int")), F.substr("next_text", F.lit(1), half)).alias("edited"), "codes", "next_codes")
    both = with_fingerprint(edited, "edited", "edited_codes", k, window)
    kept = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "codes", "edited_codes", hashes(F.col("codes")).alias("h"), hashes(F.col("edited_codes")).alias("he"), hashes(F.col("next_codes")).alias("hn"))
    return kept.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("codes")).alias("fingerprint"), shown(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("he")).alias("near_edited"), likeness(F.col("h"), F.col("hn")).alias("near_next"),
    )
