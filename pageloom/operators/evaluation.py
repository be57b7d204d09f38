"""Evaluation of predicted labels, statistics of titles and pages, and positions of words among others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import boxes

from .labels import page_accuracy


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def header_metrics(words: DataFrame, labels: list[str], header: str, title: str) -> DataFrame:
    """One row: precision, recall and F1 of each label of interest, and how often header and title are taken for each other.

    Rates are shares of all words with the true label (its row of the confusion table, each cell once).
    """
    t, p = F.col("label"), F.col("label_pred")
    cells = words.groupBy("label", "label_pred").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = []
    for x in labels:
        hit = total((t == x) & (p == x))
        pr, re = _share(hit, total(p == x)), _share(hit, total(t == x))
        f1 = F.coalesce(2 * pr * re / F.nullif(pr + re, F.lit(0.0)), F.lit(0.0))
        out += [F.round(pr, 6).alias(f"{x.lower()}_precision"), F.round(re, 6).alias(f"{x.lower()}_recall"), F.round(f1, 6).alias(f"{x.lower()}_f1")]
    a, b = total((t == header) & (p == title)), total((t == title) & (p == header))
    rates = [F.round(_share(a, total(t == header)), 6).alias("header_false_positive_rate"), F.round(_share(b, total(t == title)), 6).alias("title_false_negative_rate")]
    return cells.agg(*out, *rates, (a + b).alias("confusion_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"))


def label_boxes(words: DataFrame, label: str) -> DataFrame:
    """By page: union boxes of the words with the label truly (a0..a3) and by prediction (b0..b3); null where there are none."""
    def box(column: str, name: str) -> list[Column]:
        only = lambda c: F.when(F.col(column) == label, F.col(c))
        return [F.min(only("x0")).alias(f"{name}0"), F.min(only("y0")).alias(f"{name}1"), F.max(only("x1")).alias(f"{name}2"), F.max(only("y1")).alias(f"{name}3")]

    return words.groupBy("page_num").agg(*box("label", "a"), *box("label_pred", "b"))


def anchor_accuracy(words: DataFrame, label: str, threshold: float = 0.3) -> DataFrame:
    """One row: pages with the label, and those whose predicted box overlaps the true one by the threshold (IoU) or more."""
    both = label_boxes(words, label).where("a0 IS NOT NULL")
    iou = boxes.iou(tuple(F.col(f"a{i}") for i in range(4)), tuple(F.col(f"b{i}") for i in range(4)))
    one = both.select(F.coalesce(F.col("b0").isNotNull() & (iou >= threshold), F.lit(False)).alias("ok"))
    return one.agg(F.count("*").alias("pages_with"), F.count_if("ok").alias("pages_correct"), F.round(_share(F.count_if("ok"), F.count("*")), 6).alias("anchor_accuracy"))


def set_accuracy(words: DataFrame, label: str) -> DataFrame:
    """By page: is the set of words with the label exact, partly right or wrong, and the sizes of both sets and their overlap."""
    each = words.groupBy("page_num", "word").agg(F.max((F.col("label") == label).cast("int")).alias("t"), F.max((F.col("label_pred") == label).cast("int")).alias("p"))
    n = each.groupBy("page_num").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("n_overlap"))
    same = (F.col("n_true") == F.col("n_pred")) & (F.col("n_true") == F.col("n_overlap"))
    return n.withColumn("verdict", F.when(same, "exact").when(F.col("n_overlap") > 0, "partial").otherwise("wrong"))


def worst_pages(words: DataFrame, n: int = 5) -> DataFrame:
    return page_accuracy(words).orderBy("accuracy", "page_num").limit(n)


def label_counts_raw_vs_post(words: DataFrame, keep: Column) -> DataFrame:
    """By page and predicted label: words and mean confidence before and after a filter."""
    return words.groupBy("page_num", "label_pred").agg(
        F.count("*").alias("n_raw"), F.round(F.avg("conf"), 6).alias("conf_raw"),
        F.count_if(keep).alias("n_post"), F.round(F.avg(F.when(keep, F.col("conf"))), 6).alias("conf_post"),
    )


def align_to_subwords(pieces: DataFrame) -> DataFrame:
    """Of a word's pieces (page_num, word_id, pos, label) only the first keeps the label; the others' are null (masked)."""
    w = Window.partitionBy("page_num").orderBy("pos")
    new = F.lag("word_id").over(w).isNull() | (F.col("word_id") != F.lag("word_id").over(w))
    return pieces.withColumn("piece_label", F.when(new, F.col("label")))


def label_coverage_stats(pieces: DataFrame, masked: float = 0.95, labelled: float = 0.01, examples: float = 0.1) -> DataFrame:
    """One row: masked and open pieces, share of labelled ones, pages with a label, and which limits are broken."""
    page = pieces.groupBy("page_num").agg(F.count("*").alias("n"), F.count("piece_label").alias("k"), F.count_if(F.col("piece_label") != "O").alias("m"))
    one = page.agg(F.sum("n").alias("n"), F.sum("k").alias("unmasked"), F.sum("m").alias("m"), F.count("*").alias("pages"), F.count_if(F.col("m") > 0).alias("labelled_pages"))
    c = F.col
    out = one.select((c("n") - c("unmasked")).alias("masked"), "unmasked", F.round(_share(c("m"), c("unmasked")), 6).alias("non_o_ratio"), "pages", "labelled_pages", "n", "m")
    broken = F.array_compact(F.array(
        F.when(c("masked") > masked * c("n"), "masked"), F.when(c("m") < labelled * c("unmasked"), "non_o"), F.when(c("labelled_pages") < examples * c("pages"), "examples")
    ))
    return out.withColumn("violations", F.array_join(broken, ",")).drop("n", "m")


def label_share_of_pages(pieces: DataFrame) -> DataFrame:
    """(piece_label, pages, share): how many pages have a label on an open piece, and their share of all pages."""
    total = pieces.agg(F.countDistinct("page_num").alias("all"))
    each = pieces.where("piece_label IS NOT NULL").groupBy("piece_label").agg(F.countDistinct("page_num").alias("pages"))
    return each.join(F.broadcast(total), F.lit(True)).select("piece_label", "pages", (F.col("pages") / F.col("all")).alias("share"))  # one row


def page_summary(words: DataFrame) -> DataFrame:
    has = lambda x: F.bool_or(F.col("label") == x)
    return words.groupBy("page_num").agg(F.count("*").alias("n_words"), has("TITLE").alias("has_title"), has("INGREDIENT_LINE").alias("has_ingredients"), has("INSTRUCTION_STEP").alias("has_instructions"))


def titles(words: DataFrame, label: str = "TITLE") -> DataFrame:
    """The text of each page's title words, in order."""
    rows = F.sort_array(F.collect_list(F.struct("word_idx", "word")))
    return words.where(F.col("label") == label).groupBy("page_num").agg(F.array_join(F.transform(rows, lambda x: x["word"]), " ").alias("title"), F.count("*").alias("n_words"))


def title_patterns(found: DataFrame) -> DataFrame:
    """One row over titles: word counts, and shares that end in a period, are upper case or begin with a capital."""
    first, share = F.substring("title", 1, 1), lambda c: F.round(_share(F.count_if(c), F.count("*")), 6)
    upper = (F.upper("title") == F.col("title")) & (F.lower("title") != F.col("title"))
    return found.agg(
        F.count("*").alias("n_titles"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"), F.round(F.avg("n_words"), 6).alias("avg_words"),
        share(F.col("title").endswith(".")).alias("ends_period"), share(upper).alias("all_upper"), share((F.upper(first) == first) & (F.lower(first) != first)).alias("capital"),
    )


def title_geometry(words: DataFrame, label: str = "TITLE") -> DataFrame:
    """By page with title words: their position and height, and the height against the other words'."""
    t = F.col("label") == label
    of = lambda agg, c, side=t: F.round(agg(F.when(side, c)), 6)
    h = F.col("y1") - F.col("y0")
    out = words.groupBy("page_num").agg(
        of(F.min, F.col("y0")).alias("title_y"), of(F.min, F.col("y0") / F.col("height")).alias("title_y_share"), of(F.avg, h).alias("title_height"),
        of(F.min, F.col("x0")).alias("title_x0"), of(F.max, F.col("x1")).alias("title_x1"), F.round(F.avg(F.when(t, h)) / F.avg(F.when(~t, h)), 6).alias("height_ratio"),
    )
    return out.where("title_y IS NOT NULL")


def reading_order(words: DataFrame) -> DataFrame:
    """Add read_order (from 1, top to bottom, then left to right) and y_gap to the next word."""
    w = Window.partitionBy("page_num").orderBy("y0", "x0", "word_idx")
    return words.withColumns({"read_order": F.row_number().over(w), "y_gap": F.lead("y0").over(w) - F.col("y0")})


def near_ingredients(words: DataFrame, reach: int = 150, label: str = "TITLE") -> DataFrame:
    """Title words with is_near: does an ingredient word begin below the word's foot by less than `reach`?

    One sorted pass for each page over title feet and ingredient tops, rather than a join of both.
    """
    c, kind = F.col, F.col("label")
    rows = words.where(kind.isin(label, "INGREDIENT_LINE")).select("page_num", "word_idx", "label", F.when(kind == label, c("y1")).otherwise(c("y0")).cast("long").alias("at"))
    w = Window.partitionBy("page_num").orderBy("at").rangeBetween(1, reach - 1)
    seen = rows.withColumn("is_near", F.coalesce(F.max((kind == "INGREDIENT_LINE").cast("int")).over(w), F.lit(0)) == 1)
    return seen.where(kind == label).select("page_num", "word_idx", "is_near")


def standalone_caps(words: DataFrame, reach: int = 20) -> DataFrame:
    """Upper-case words with no mixed-case word (of two characters or more) whose centre is less than `reach` away in y."""
    caps = F.upper("word") == F.col("word")
    w = Window.partitionBy("page_num").orderBy("twice_mid").rangeBetween(1 - 2 * reach, 2 * reach - 1)
    mixed = F.max((~caps & (F.char_length("word") > 1)).cast("int")).over(w)
    return words.withColumn("twice_mid", (F.col("y0") + F.col("y1")).cast("long")).withColumn("mixed", mixed).where(caps & (F.col("mixed") == 0)).select("page_num", "word_idx", "word")


def sections_by_title(words: DataFrame, label: str = "TITLE") -> DataFrame:
    """Words with section: the number of runs of title words that began at or above them, 0 above the first title."""
    spans = Window.partitionBy("page_num").orderBy("y0", "x0", "word_idx")
    new = (F.col("label") == label) & (F.coalesce(F.lag("label").over(spans), F.lit("")) != label)
    return words.withColumn("new", new.cast("int")).withColumn("section", F.sum("new").over(spans)).drop("new")


def match_annotations(boxes_: DataFrame, lines: DataFrame, band: int = 64) -> DataFrame:
    """Lines with new_label: each annotation (page_num, ann_idx, ann_label, p0..p3) marks the line of its page it overlaps most (IoU > 0).

    The first of equal lines is taken; a line takes the label of its last annotation, and is left out where it has none. Boxes
    meet in bands of `band` units of height, so that a long page does not compare each box with each line; a pair that meets in
    two bands counts once, as a maximum is taken.
    """
    c = F.col
    bands = lambda top, foot: F.explode(F.sequence(F.floor(c(top) / band), F.floor(c(foot) / band))).alias("band")
    left = boxes_.select("page_num", "ann_idx", "ann_label", "p0", "p1", "p2", "p3", bands("p1", "p3"))
    right = lines.select("page_num", "line_id", "bx0", "by0", "bx1", "by1", bands("by0", "by1"))
    iou = F.round(boxes.iou(tuple(c(f"p{i}") for i in range(4)), (c("bx0"), c("by0"), c("bx1"), c("by1"))), 9)
    best = left.join(right, ["page_num", "band"]).withColumn("iou", iou).where("iou > 0").groupBy("page_num", "ann_idx", "ann_label").agg(F.max(F.struct("iou", (-c("line_id")).alias("k"))).alias("b"))
    return best.select("page_num", (-c("b.k")).alias("line_id"), "ann_idx", "ann_label").groupBy("page_num", "line_id").agg(F.max_by("ann_label", "ann_idx").alias("new_label"))
