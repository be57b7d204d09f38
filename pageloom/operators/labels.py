"""Label statistics, evaluation, selection and splits over word tables (page_num, word_idx, label, label_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The older and the newer label sets.
LABELS_V2 = ["TITLE", "INGREDIENT_LINE", "INSTRUCTION_STEP", "TIME", "TEMP", "SERVINGS", "NOTE", "O"]
V3_OF_V2 = {"TITLE": "RECIPE_TITLE"}


def map_label_taxonomy(words: DataFrame) -> DataFrame:
    known = F.col("label").isin(LABELS_V2)
    return words.withColumn("label_v3", F.when(F.col("label") == "TITLE", V3_OF_V2["TITLE"]).when(known, F.col("label")).otherwise("O"))


def page_label_stats(words: DataFrame) -> DataFrame:
    n = lambda label: F.count_if(F.col("label") == label)
    out = words.groupBy("page_num").agg(F.count("*").alias("token_count"), F.count_if(F.col("label") != "O").alias("non_o"), n("INGREDIENT_LINE").alias("ingredient"), n("INSTRUCTION_STEP").alias("instruction"), n("TITLE").alias("title"))
    return out.withColumn("non_o_ratio", F.col("non_o") / F.col("token_count"))


def label_distribution(words: DataFrame, split: str) -> DataFrame:
    """Counts and percentages by split and over all splits (split null), in one pass."""
    n = words.rollup(split, "label").agg(F.count("*").alias("n"), F.grouping("label").alias("all_labels"), F.grouping(split).alias("all_splits"))
    whole = n.where("all_labels = 1").select(F.col(split).alias("s"), F.col("all_splits").alias("a"), F.col("n").alias("total"))
    over_all = n.where("all_labels = 0").groupBy("label").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias(split), "label", "n", F.lit(1).alias("all_splits"))
    both = n.where("all_labels = 0").select(F.col(split).cast("string").alias(split), "label", "n", F.lit(0).alias("all_splits")).unionByName(over_all)
    joined = both.join(whole, (F.col(split).eqNullSafe(F.col("s").cast("string"))) & (F.col("all_splits") == F.col("a")))
    return joined.select(split, "label", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def class_weights(words: DataFrame, labels: list[str]) -> DataFrame:
    """total / (number of labels * count), 1 for a label without words, scaled to mean 1."""
    n = words.groupBy("label").agg(F.count("*").alias("n"))
    table = words.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    every = table.join(n, "label", "left").withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row for each label
    raw = every.withColumn("raw", F.when(F.col("n") > 0, F.col("total") / (len(labels) * F.col("n"))).otherwise(1.0))
    return raw.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("raw") / F.avg("raw").over(Window.partitionBy()), 6).alias("weight"))


def confusion_matrix(words: DataFrame) -> DataFrame:
    return words.groupBy("label", "label_pred").agg(F.count("*").alias("n"))


def token_metrics(words: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support for each label."""
    n = confusion_matrix(words)
    true = n.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("label_pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = n.groupBy(F.col("label_pred").alias("p")).agg(F.sum("n").alias("predicted"))
    both = true.join(pred, F.col("label") == F.col("p"), "full")
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    pr, re = ratio(c("tp"), c("predicted")), ratio(c("tp"), c("support"))
    return both.select(F.coalesce("label", "p").alias("label"), F.round(pr, 6).alias("precision_"), F.round(re, 6).alias("recall_"), F.round(F.coalesce(2 * pr * re / F.nullif(pr + re, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"), c("support").alias("support"))


def page_accuracy(words: DataFrame) -> DataFrame:
    return words.groupBy("page_num").agg(F.avg((F.col("label") == F.col("label_pred")).cast("int")).alias("accuracy"))


def filter_recipe_coverage(stats: DataFrame, ratio: float = 0.4, ingredient: int = 60, instruction: int = 100, title: int = 3) -> DataFrame:
    return stats.where((F.col("non_o_ratio") >= ratio) | (F.col("ingredient") >= ingredient) | (F.col("instruction") >= instruction) | (F.col("title") > title))


def rank_pages_blended(stats: DataFrame, n: int, instruction: float = 0.6, ingredient: float = 0.4) -> DataFrame:
    """The n best pages by the blended count; the larger page number wins ties."""
    return stats.withColumn("blended", F.round(instruction * F.col("instruction") + ingredient * F.col("ingredient"), 6)).orderBy(F.desc("blended"), F.desc("page_num")).limit(n)


def top_tokens_per_label(words: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("page_num", "label_pred").orderBy(F.desc("conf"), "word_idx")
    return words.withColumn("token_rank", F.row_number().over(w)).where(F.col("token_rank") <= n).select("page_num", "label_pred", "token_rank", "word_idx", "word", "conf")


def split_random(pages: DataFrame, seed: int = 42, test: float = 0.1, validation: float = 0.15) -> DataFrame:
    """Pages ordered by md5(seed:page): int(n * test) are test, int(rest * validation) validation, the rest train.

    The rank is global in two steps: rows are counted by the first two digits of the digest (256 rows), then ranked in each.
    """
    ids = pages.select("page_num").distinct().withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_num").cast("string")))).withColumn("slot", F.substring("digest", 1, 2))
    sums = ids.groupBy("slot").agg(F.count("*").alias("n"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("slot").orderBy("digest", "page_num"))
    ranked = ids.join(F.broadcast(starts), "slot").withColumn("rank", rank)  # 256 rows at most
    n_test = F.floor(F.col("all") * test)
    n_val = F.floor((F.col("all") - n_test) * validation)
    return ranked.select("page_num", F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "validation").otherwise("train").alias("split"))


def header_vocabulary(words: DataFrame, least: int = 5, top: float = 0.15) -> DataFrame:
    """Upper-cased words that are seen `least` times or more with their centre in the top part of pages, over the whole corpus."""
    rows = words.where((F.col("y0") + F.col("y1")) / 2 < F.col("height") * top)
    return rows.groupBy(F.upper("word").alias("header_word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def words_to_word_level(tokens: DataFrame) -> DataFrame:
    """Of several predictions for a word, the most confident; the first wins ties."""
    w = Window.partitionBy("page_num", "word_idx").orderBy(F.desc("conf"), "pos")
    return tokens.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def words_to_first_piece(tokens: DataFrame) -> DataFrame:
    """Of several predictions for a word (page_num, word_idx, pos, ...) the first by pos, and of equal ones the most confident:
    the other mode of words_to_word_level. A grouped minimum, combined before the rows are shuffled."""
    rest = [x for x in tokens.columns if x not in ("page_num", "word_idx")]
    first = F.min_by(F.struct(*rest), F.struct("pos", (-F.col("conf")).alias("c"), *(x for x in rest if x not in ("pos", "conf"))))
    return tokens.groupBy("page_num", "word_idx").agg(first.alias("first_piece")).select("page_num", "word_idx", *(F.col("first_piece")[x].alias(x) for x in rest))


def collapse_check(words: DataFrame, limit: float = 0.9) -> DataFrame:
    """By page: the share of the most frequent predicted label, and whether it exceeds the limit."""
    n = words.groupBy("page_num", "label_pred").agg(F.count("*").alias("n"))
    share = n.groupBy("page_num").agg((F.max("n") / F.sum("n")).alias("share"))
    return share.withColumn("collapsed", F.col("share") > limit)


def collapse_runs(rounds: DataFrame, limit: float = 0.9, patience: int = 2) -> DataFrame:
    """rounds (round, label_pred, n) to (round, top_label, share, in_a_row, failed): the most frequent predicted label of each
    round (the first by name of equals) and its share; how many rounds in a row, up to this one, it was above the limit; and
    whether that is `patience` or more. A row for each round is sorted, no more."""
    c = F.col
    top = rounds.groupBy("round").agg(F.min_by("label_pred", F.struct((-c("n")).alias("n"), "label_pred")).alias("top_label"), (F.max("n") / F.sum("n")).alias("share"))
    order = Window.orderBy("round")
    marked = top.withColumn("healthy", F.sum((c("share") <= limit).cast("int")).over(order))
    runs = marked.withColumn("in_a_row", F.sum((c("share") > limit).cast("int")).over(Window.partitionBy("healthy").orderBy("round")))
    return runs.select("round", "top_label", "share", "in_a_row", (c("in_a_row") >= patience).alias("failed"))


def group_tokens(words: DataFrame, label: str = "label_pred") -> DataFrame:
    """(page_num, grouped): for each page a map from label to its words (word_idx, word, conf) in order. Pages without words
    have no row."""
    tokens = F.sort_array(F.collect_list(F.struct("word_idx", "word", "conf")))
    by_label = words.groupBy("page_num", F.col(label).alias("label")).agg(tokens.alias("tokens"))
    return by_label.groupBy("page_num").agg(F.map_from_entries(F.collect_list(F.struct("label", "tokens"))).alias("grouped"))


def top_instruction_pages(stats: DataFrame, n: int = 10) -> DataFrame:
    """The n pages with the most instruction words, more ingredient words and smaller pages first among equals."""
    return stats.orderBy(F.desc("instruction"), F.desc("ingredient"), "page_num").limit(n).select("page_num", "instruction", "ingredient")
