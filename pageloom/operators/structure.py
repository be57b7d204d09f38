"""Metrics of labelled pages, filters on them with reasons, and checks of label distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import line_majority_label

# The thresholds of the structural filter, and the names of its reasons.
LIMITS = {"avg_token_conf": 0.60, "tokens": 80, "o_ratio": 0.92, "ingredient_lines": 2, "instruction_lines": 2, "labeled_ratio": 0.03}
REASONS = ["no_title", "few_ing", "few_instr", "low_conf", "high_o_ratio", "too_short", "low_labeled_ratio"]


def structural_metrics(lines: DataFrame, label: str = "label") -> DataFrame:
    """One row for each page of words with line_id: token confidence (0..1), share of unlabelled tokens, lines by label."""
    plain = F.col(label).isin("O", "NOTE")
    tokens = lines.groupBy("page_num").agg(
        (F.avg("conf") / 100).alias("avg_token_conf"), F.count("*").alias("total_tokens"),
        F.avg(plain.cast("int")).alias("o_ratio"), F.avg((~plain).cast("int")).alias("labeled_token_ratio"),
    )
    best = line_majority_label(lines)
    count = lambda name: F.count_if(F.col("label") == name)
    by_line = best.groupBy("page_num").agg(count("TITLE").alias("title_lines"), count("INGREDIENT_LINE").alias("ingredient_lines"), count("INSTRUCTION_STEP").alias("instruction_lines"))
    return tokens.join(by_line, "page_num")


def filter_structural(metrics: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Add reasons (all rules that a page breaks, in order) and keep."""
    c = F.col
    broken = [
        c("title_lines") < 1, c("ingredient_lines") < limits["ingredient_lines"], c("instruction_lines") < limits["instruction_lines"],
        c("avg_token_conf") < limits["avg_token_conf"], c("o_ratio") > limits["o_ratio"], c("total_tokens") < limits["tokens"], c("labeled_token_ratio") < limits["labeled_ratio"],
    ]
    reasons = F.array_compact(F.array(*(F.when(b, F.lit(r)) for b, r in zip(broken, REASONS, strict=True))))
    return metrics.withColumn("reasons", reasons).withColumn("keep", F.size("reasons") == 0)


def reject_histogram(filtered: DataFrame) -> DataFrame:
    return filtered.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("pages"))


def label_violations(words: DataFrame, label: str = "label", least: float = 0.02, most: float = 0.9) -> DataFrame:
    """(severity, violation): what is wrong with the labels of a whole table; no rows if nothing is."""
    one = words.agg(
        F.count("*").alias("n"), F.count_if(F.col(label) != "O").alias("labelled"),
        F.count_if(F.col(label) == "INGREDIENT_LINE").alias("ing"), F.count_if(F.col(label) == "INSTRUCTION_STEP").alias("ins"),
    )
    top = words.groupBy(label).agg(F.count("*").alias("k")).agg(F.max("k").alias("top"))
    c = F.col
    rules = [
        (c("n") == 0, "error", "no_tokens"), ((c("n") > 0) & (c("labelled") < least * c("n")), "error", "low_non_o_ratio"),
        ((c("n") > 0) & (c("ing") == 0), "error", "missing_ingredient"), ((c("n") > 0) & (c("ins") == 0), "error", "missing_instruction"),
        (c("top") > most * c("n"), "warning", "one_label_dominates"),
    ]
    found = F.array_compact(F.array(*(F.when(b, F.struct(F.lit(s).alias("severity"), F.lit(v).alias("violation"))) for b, s, v in rules)))
    return one.join(F.broadcast(top), F.lit(True)).select(F.inline(found))  # both sides are one row
