"""Texts found in words: best matching runs of words, labels from curated recipes, exact word sequences, differences of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import spans

# The least likeness of a match, and likenesses that tell kinds of differences apart.
MATCH, SAME, CLOSE = 0.7, 0.95, 0.75


def _page_words(words: DataFrame) -> DataFrame:
    pages = words.groupBy("page_num").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word"))).alias("w"))
    plain = lambda x: F.when(x.rlike(r"^[a-z0-9_]+\z"), x).otherwise(T.matching(x))
    return pages.select("page_num", F.transform("w", lambda x: plain(x["word"])).alias("w"))


def _tokens(text: str) -> Column:
    return F.filter(F.split(T.matching(F.col(text)), " "), lambda w: w != "")


def align_text_to_span(words: DataFrame, texts: DataFrame, least: float = MATCH, longest: int | None = None) -> DataFrame:
    """(page_num, text_id, start, end, score) for each of texts (page_num, text_id, text): the run of words whose word set is
    most like the text's (shared words by the larger set). Runs are 2 words shorter to 3 longer than the text, `longest` words
    at most if that is given; of equals the first, then the shortest. start and end are -1 below `least`, for texts without words, and on pages without words. A page's
    texts meet its words once, in an index of the places of each word. Null texts have no words; rows repeat as in texts; a
    null page_num meets no page; empty tables give none; other columns are ignored.
    """
    c = F.col
    tokens = F.coalesce(_tokens("text"), F.array().cast("array<string>"))
    wanted = texts.groupBy("page_num").agg(F.collect_list(F.struct("text_id", tokens.alias("tokens"))).alias("texts"))
    kind = lambda name: texts.schema[name].dataType.simpleString()
    both = wanted.join(_page_words(words), "page_num", "left").select("page_num", "w", "texts")
    return both.mapInArrow(spans.best_spans(least, longest), f"page_num {kind('page_num')}, text_id {kind('text_id')}, start int, end int, score double").select(c("page_num"), "text_id", "start", "end", "score")


def curated_labels(words: DataFrame, fields: DataFrame, least: float = MATCH, least_coverage: float = 0.0) -> DataFrame:
    """(page_num, spans, coverage, matches, labels): fields (page_num, field_no, label, text) of a page found one after another
    in its words (page_num, word_idx, word).

    Each field is looked for behind the one found before it (see align_text_to_span for the run that is taken); a field that is
    not found leaves the place as it was. spans holds (start, end, label, score) of the fields found, matches a row for each
    field (score 0 where it isn't found), labels the words' labels, O outside fields. coverage is the share of fields found;
    pages below least_coverage, and pages without words, are left out. Fields without words, null texts too, are not found.
    A page is the unit: its fields follow each other. Empty tables give none; other columns are ignored.
    """
    c = F.col
    tokens = F.coalesce(_tokens("text"), F.array().cast("array<string>"))
    row = F.struct(c("field_no").cast("int").alias("field_no"), "label", tokens.alias("tokens"))
    wanted = fields.groupBy("page_num").agg(F.sort_array(F.collect_list(row)).alias("fields"))
    both = wanted.join(_page_words(words), "page_num").select("page_num", "w", "fields")
    kind = fields.schema["page_num"].dataType.simpleString()
    found = both.mapInArrow(spans.matched_in_order(least, "O"), f"page_num {kind}, matches {spans.MATCHES}, labels array<string>")
    hits = F.filter("matches", lambda m: m["matched"])
    out = found.select(
        "page_num", F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label"), m["score"].alias("score"))).alias("spans"),
        (F.size(hits) / F.size("matches")).alias("coverage"), "matches", "labels",
    )
    return out.where(c("coverage") >= least_coverage)


def match_statistics(labelled: DataFrame) -> DataFrame:
    """(label, fields, matched, mean_score) over the fields of curated_labels' pages: how many there are and how many are found,
    and the mean score of those found (null if none)."""
    m = labelled.select(F.inline("matches"))
    return m.groupBy("label").agg(F.count("*").alias("fields"), F.count_if("matched").alias("matched"), F.avg(F.when(F.col("matched"), F.col("score"))).alias("mean_score"))


def coverage_summary(labelled: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """One row on curated_labels' pages: how many there are, are kept and skipped at this coverage, and the mean, least and most
    coverage (null without pages)."""
    c = F.col("coverage")
    kept = F.count_if(c >= least_coverage)
    return labelled.agg(F.count("*").alias("pages"), kept.alias("kept"), (F.count("*") - kept).alias("skipped"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))


def find_word_sequence(words: DataFrame, wanted: DataFrame, longest: int = 8) -> DataFrame:
    """(page_num, start, end): where the words of wanted (page_num, sequence: array of up to `longest`) first stand in a row,
    without regard to case and to . , ; : at their ends. Pages without the sequence have no row."""
    c = F.col
    plain = lambda x: F.regexp_replace(F.lower(x), "[.,;:]+$", "")
    w = Window.partitionBy("page_num").orderBy("word_idx").rowsBetween(0, longest - 1)
    ahead = words.select("page_num", "word_idx", F.collect_list(plain(c("word"))).over(w).alias("ahead"))
    asked = wanted.select("page_num", F.transform("sequence", plain).alias("sequence"))
    hits = ahead.join(asked, "page_num").where((F.size("sequence") > 0) & (F.slice("ahead", 1, F.size("sequence")) == c("sequence")))
    first = hits.groupBy("page_num").agg(F.min("word_idx").alias("start"), F.first(F.size("sequence")).alias("n"))
    return first.select("page_num", "start", (c("start") + c("n")).alias("end"))


def load_ocr_for_recipe(recipes: DataFrame, pages: DataFrame) -> DataFrame:
    """Recipes (source.page or page) with their page's columns; recipes whose page is not there are left out."""
    return recipes.join(pages, recipes["page"] == pages["page_num"]).drop(pages["page_num"])


def diff_lines(curated: DataFrame, found: DataFrame, close: float = CLOSE) -> DataFrame:
    """(page_num, curated_no, found_no, status, similarity): each curated line (page_num, line_no, text), in order, takes the
    free found line of its page that is most like it (shared words by the mean set size; the first of equals): match from SAME
    on, else mismatch; with no word shared by any it is missing. Found lines that are left are extra. A fold over a page's
    curated lines with the numbers of the lines taken: a page is the unit."""
    c = F.col
    row = F.struct(c("line_no").cast("int").alias("line_no"), T.word_set(T.comparable(c("text"))).alias("w"))
    lines = lambda df, name: df.groupBy("page_num").agg(F.sort_array(F.collect_list(row)).alias(name))
    both = lines(curated, "a").join(lines(found, "b"), "page_num", "full").select("page_num", "a", "b")
    kind = curated.schema["page_num"].dataType.simpleString()
    return both.mapInArrow(spans.paired_lines(SAME), f"page_num {kind}, curated_no int, found_no int, status string, similarity double")


def word_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(page_num, shared, only_left, only_right): how many different words (page_num, word) two tables share on a page."""
    side = lambda df, name: df.select("page_num", F.lower("word").alias("word")).distinct().withColumn(name, F.lit(1))
    both = side(left, "a").join(side(right, "b"), ["page_num", "word"], "full")
    return both.groupBy("page_num").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))
