"""Vocabulary queries: corrections and counts by tables of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import scoring, vocabularies

from .queries import _IN, TOK, _words, query

c = F.col
_BARE = "regexp_replace(w, '[.,;:!?]+$', '')"
_BENCHMARK_WORDS = r"bw AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM benchmark) WHERE w <> '')"


def _entries(spark, sf):
    """Every word of the benchmark in angles; the next version renames words of four characters and takes those of five out."""
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").distinct()
    first = words.select(F.lit("text").alias("kind"), "word", F.concat(F.lit("<"), c("word"), F.lit(">")).alias("stands_for"), F.lit(1).alias("version"))
    n = F.char_length("word")
    return first.unionByName(words.where(n.isin(4, 5)).select(F.lit("text").alias("kind"), "word", F.when(n == 4, "four").alias("stands_for"), F.lit(2).alias("version")))


_CORRECTED = r"""dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
fx AS (SELECT doc_id, string_agg(coalesce(s || substr(dw.w, length(voc.w) + 1), dw.w), ' ' ORDER BY k) AS corrected FROM dw LEFT JOIN voc ON """ + _BARE.replace("(w,", "(dw.w,") + """ = voc.w GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(corrected, '') END AS corrected FROM documents LEFT JOIN fx USING (doc_id)"""


def _texts(spark, sf, version, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    known = vocabularies.vocabulary_at(_entries(spark, sf), "text", version)
    return vocabularies.correct_texts(docs, "text", known, "corrected", most).select("doc_id", "corrected")


@query(f"WITH {_BENCHMARK_WORDS}, voc AS (SELECT w, CASE length(w) WHEN 4 THEN 'four' ELSE '<' || w || '>' END AS s FROM bw WHERE length(w) <> 5), {_CORRECTED}")
def correct_by_vocabulary(spark, sf):
    """The latest version, broadcast if it is small."""
    return _texts(spark, sf, None, vocabularies.BROADCAST_ROWS)


@query(f"WITH {_BENCHMARK_WORDS}, voc AS (SELECT w, '<' || w || '>' AS s FROM bw), {_CORRECTED}")
def correct_by_vocabulary_shuffled(spark, sf):
    """The first version, taken as too large for a broadcast."""
    return _texts(spark, sf, 1, 0)


_HEADINGS = f"vc AS (SELECT unnest({_IN(scoring.UNITS)}) AS w, 'unit' AS heading UNION ALL SELECT unnest({_IN(scoring.VERBS)}), 'verb')"


@query(TOK + f", {_HEADINGS} SELECT page_num, heading AS stands_for, count(*) AS n FROM tok JOIN vc ON lower(word) = vc.w GROUP BY ALL")
def vocabulary_hits(spark, sf):
    """Units and verbs of the page score, as a table."""
    known = vocabularies.fixed_vocabulary(spark, {w: "unit" for w in scoring.UNITS} | {w: "verb" for w in scoring.VERBS}, "page")
    return vocabularies.vocabulary_hits(_words(spark, sf), vocabularies.vocabulary_at(known, "page"))
