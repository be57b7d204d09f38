"""Vocabularies as versioned tables: which words stand for which, looked up in texts by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T

#: Rows of a vocabulary that is broadcast, at most; a larger one meets the words in a shuffle.
BROADCAST_ROWS = 100_000


def fixed_vocabulary(spark, words: dict[str, str], kind: str) -> DataFrame:
    """A table (kind, word, stands_for, version 0) of a fixed list."""
    return spark.createDataFrame([(kind, k, v, 0) for k, v in words.items()], "kind string, word string, stands_for string, version int")


def vocabulary_at(entries: DataFrame, kind: str, version: int | None = None) -> DataFrame:
    """(word, stands_for) as of a version (null: the latest) of entries (kind, word, stands_for, version): the last entry of each
    word counts (of equal versions the smallest stands_for), a null stands_for takes the word out. Null words are left out."""
    known = entries.where((F.col("kind") == kind) & F.col("word").isNotNull())
    known = known if version is None else known.where(F.col("version") <= version)
    last = known.groupBy("word").agg(F.min_by("stands_for", F.struct((-F.col("version")).alias("v"), F.col("stands_for").isNull().alias("none"), F.col("stands_for").alias("s"))).alias("stands_for"))
    return last.where("stands_for IS NOT NULL")


def _unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where df has such columns."""
    taken = {x.lower() for x in df.columns}
    return ["_" * next(k for k in range(len(taken) + 1) if "_" * k + name not in taken) + name for name in names]


def _words(text: Column) -> Column:
    """The different words of a text without the punctuation that they end in."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_distinct(F.transform(parts, lambda w: F.regexp_replace(w, T.END_PUNCTUATION, "")))


def sized(vocabulary: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The vocabulary, marked for a broadcast if it has no more than so many rows (counted: one more at most is read)."""
    return F.broadcast(vocabulary) if vocabulary.limit(most + 1).count() <= most else vocabulary


def correct_texts(df: DataFrame, text: str, vocabulary: DataFrame, out: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with out: text corrected as text.corrected does it, by a vocabulary (word, stands_for; each word once).

    The different words of texts meet the vocabulary in a join (broadcast if its counted rows are at most `most`, else shuffled);
    a text comes back with the few words that are in it, found by two hashes of the text, so that texts that occur often travel
    once a task. Null texts stay null; an empty vocabulary leaves words as they are and makes single spaces.
    """
    *key, match = _unused(df, "text_hash", "text_check", "text_words")
    keyed = df.withColumns({key[0]: F.xxhash64(text), key[1]: F.xxhash64(F.lit(1), text)})
    spread = keyed.where(F.col(text).isNotNull()).select(*key, F.explode(_words(F.col(text))).alias("word"))
    hits = spread.join(sized(vocabulary, most).select("word", "stands_for"), "word")
    found = hits.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("word", "stands_for"))).alias(match))
    none = F.create_map().cast("map<string,string>")
    both = keyed.join(found, key, "left")
    return both.withColumn(out, T.corrected_by(F.col(text), F.coalesce(match, none))).drop(*key, match)


def vocabulary_hits(words: DataFrame, vocabulary: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(page_num, stands_for, n): how many of a page's words (without regard to case) the vocabulary (word in lower case, stands_for)
    puts under each heading, such as units or verbs. Pages without a hit have no row."""
    known = sized(vocabulary, most).select(F.col("word").alias("_known"), "stands_for")
    return words.select("page_num", F.lower("word").alias("_known")).join(known, "_known").groupBy("page_num", "stands_for").agg(F.count("*").alias("n"))
