"""Runs of labelling heuristics: gates, dry runs, counters by page, and statistics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import label_instruction_run  # noqa: F401 (a run like the others)


def applied(words: DataFrame, dry_run: bool = False) -> DataFrame:
    """words (label, new_label) with the new labels in place; a dry run leaves the labels as they are."""
    return words.drop("new_label") if dry_run else words.withColumn("label", F.col("new_label")).drop("new_label")


def change_counters(words: DataFrame) -> DataFrame:
    """(page_num, tokens_added, lines_labelled) of words (page_num, line_id, label, new_label): words whose label is new, and lines
    that hold one. Pages without a change have zeros; null labels are equal. The same whether or not the run is dry."""
    new = ~F.col("label").eqNullSafe(F.col("new_label"))
    line = words.groupBy("page_num", "line_id").agg(F.count_if(new).alias("n"))
    return line.groupBy("page_num").agg(F.sum("n").alias("tokens_added"), F.count_if(F.col("n") > 0).alias("lines_labelled"))


def instruction_counters(run: DataFrame) -> DataFrame:
    """(page_num, gated, tokens_added, lines_labelled) of label_instruction_run. As the counter of lines goes, it starts with the
    first picked line on which a label changes, and counts every picked line from there on."""
    new = ~F.col("label").eqNullSafe(F.col("new_label"))
    line = run.groupBy("page_num", "line_id").agg(F.first("gated").alias("gated"), F.count_if(new).alias("n"), F.bool_or("marked").alias("marked"))
    upto = Window.partitionBy("page_num").orderBy("line_id")
    counted = line.withColumn("seen", F.sum("n").over(upto))
    return counted.groupBy("page_num").agg(F.first("gated").alias("gated"), F.sum("n").alias("tokens_added"), F.count_if(F.col("marked") & (F.col("seen") > 0)).alias("lines_labelled"))


def run_statistics(counters: DataFrame) -> DataFrame:
    """One row on a run: pages, pages that changed, words and lines in all, and least, most and mean words of the changed pages (null
    where none changed). No pages give a row of zeros."""
    c, changed = F.col, F.col("tokens_added") > 0
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    some = F.when(changed, c("tokens_added"))
    return counters.agg(
        F.count("*").alias("pages"), F.count_if(changed).alias("pages_changed"), total("tokens_added").alias("tokens_added"), total("lines_labelled").alias("lines_labelled"),
        F.min(some).alias("least"), F.max(some).alias("most"), F.round(F.avg(some), 6).alias("mean"),
    )


def most_changed_pages(counters: DataFrame, n: int = 10) -> DataFrame:
    """The n pages with the most new labels; the smaller page number wins ties."""
    return counters.where("tokens_added > 0").orderBy(F.desc("tokens_added"), "page_num").limit(n).select("page_num", "tokens_added", "lines_labelled")
