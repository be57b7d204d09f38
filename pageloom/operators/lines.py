"""Grouping words to lines and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_gap(words: DataFrame, gap: float = 12, key: tuple[str, ...] = ("page_num",)) -> DataFrame:
    """Add line_id: in (mid_y, mid_x) order, a line begins where mid_y is more than `gap` below the word before."""
    mid = words.withColumns({"mid_y": (F.col("y0") + F.col("y1")) / 2, "mid_x": (F.col("x0") + F.col("x1")) / 2})
    w = Window.partitionBy(*key).orderBy("mid_y", "mid_x", "word_idx")
    starts = mid.withColumn("starts", (F.coalesce(F.col("mid_y") - F.lag("mid_y").over(w), F.lit(0.0)) > gap).cast("int"))
    return starts.withColumn("line_id", F.sum("starts").over(w)).drop("starts")


def line_features(lines: DataFrame, key: tuple[str, ...] = ("page_num",)) -> DataFrame:
    """One row for each line: text by x, box, mean height and width, mean confidence, number of words."""
    ordered = F.sort_array(F.collect_list(F.struct("x0", "word_idx", "word")))
    return lines.groupBy(*key, "line_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("line_text"), F.count("*").alias("n_words"),
        F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"),
        F.round(F.avg(F.col("y1") - F.col("y0")), 6).alias("avg_height"), F.round(F.avg(F.col("x1") - F.col("x0")), 6).alias("avg_width"), F.round(F.avg("conf"), 6).alias("avg_conf"),
    )


def nested_lines(lines: DataFrame, keep: tuple[str, ...] = (), key: tuple[str, ...] = ("page_num",)) -> DataFrame:
    """One row for each line of words with line_id: words (x0, word_idx, word and the columns named in keep) by x, their text, the
    line's box and its page's height. What is found out about a line goes to its words without a join: F.inline("words")."""
    words = F.sort_array(F.collect_list(F.struct("x0", "word_idx", "word", *keep)))
    rows = lines.groupBy(*key, "line_id").agg(words.alias("words"), F.first("height").alias("height"), F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    return rows.withColumn("line_text", F.array_join(F.col("words.word"), " "))


def line_majority_label(lines: DataFrame, key: tuple[str, ...] = ("page_num",)) -> DataFrame:
    """The most frequent label of each line; the one seen first wins ties."""
    n = lines.groupBy(*key, "line_id", "label").agg(F.count("*").alias("n"), F.min("word_idx").alias("first"))
    best = F.row_number().over(Window.partitionBy(*key, "line_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", best).where("rank = 1").select(*key, "line_id", "label", "n")


def label_runs(words: DataFrame, label: str = "label", key: tuple[str, ...] = ("page_num",)) -> DataFrame:
    """Add run: words in a row with equal labels share a number."""
    w = Window.partitionBy(*key).orderBy("word_idx")
    new = F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True)).cast("int")
    return words.withColumn("new", new).withColumn("run", F.sum("new").over(w)).drop("new")


def label_spans(words: DataFrame, label: str = "label", key: tuple[str, ...] = ("page_num",)) -> DataFrame:
    """Runs of equal labels: (page, label, start, end), end inclusive."""
    runs = label_runs(words, label, key)
    return runs.groupBy(*key, "run", F.col(label).alias("span_label")).agg(F.min("word_idx").alias("span_start"), F.max("word_idx").alias("span_end")).drop("run")


#: For each mode: columns that order a page's words, the position compared, and the tolerance (None: it depends on the page).
ANCHORED = {
    "anchor_center": (["y0", "x0", "word_idx"], "mid_y", 18.0),
    "anchor_relative": (["y0", "x0", "word_idx"], "mid_y", None),
    "anchor_reading_order": (["word_idx"], "y0", 20.0),
    "smoothed": (["mid_y", "x0", "word_idx"], "mid_y", None),
}


#: Starts that a fold gathers before it sets them aside, so that a step never copies all starts before it.
BLOCK = 64


def _line_starts(at: Column, tolerance: Column, smooth: bool) -> Column:
    """Places (from 1) of an array of positions where a line begins: where one is off the line's mark by more than the
    tolerance. The mark is the line's first position; with smooth, the mean of itself and each position in turn, across lines.

    Arrays can't grow in place, so starts are gathered in blocks: a step copies a block at most, or one reference a block.
    """
    empty = F.array().cast("array<int>")
    first = F.struct(F.lit(0).alias("i"), F.lit(None).cast("double").alias("mark"), F.array().cast("array<array<int>>").alias("full"), empty.alias("starts"))

    def step(state: Column, y: Column) -> Column:
        mark, i = state["mark"], state["i"] + 1
        state_of = lambda mark, full, starts: F.struct(i.alias("i"), mark.alias("mark"), full.alias("full"), starts.alias("starts"))
        opened = (F.coalesce(mark, y) + y) / 2 if smooth else y
        set_aside = state_of(opened, F.concat(state["full"], F.array(state["starts"])), F.array(i))
        added = state_of(opened, state["full"], F.concat(state["starts"], F.array(i)))
        same = state_of((mark + y) / 2 if smooth else mark, state["full"], state["starts"])  # most words: nothing else is looked at
        return F.when(mark.isNull() | (F.abs(y - mark) > tolerance), F.when(F.size(state["starts"]) >= BLOCK, set_aside).otherwise(added)).otherwise(same)

    return F.aggregate(at, first, step, lambda state: F.flatten(F.concat(state["full"], F.array(state["starts"]))))


def group_lines(words: DataFrame, mode: str = "gap", key: tuple[str, ...] = ("page_num",), relative: float = 0.015, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, word_idx, line_id): lines of a page, numbered from 0. Columns of words that are named in keep come along.

    "gap" is lines_gap. The other modes hold each word against a mark that depends on all words before it: a fold over the
    page's words in order, whose state is the mark and where lines began. A page is the unit, and its word count is bounded by
    paper. "anchor_relative" needs the column height; its tolerance is `relative` of it. "smoothed" takes 0.8 of the upper
    median height, 4 at least. Pages without words give no rows.
    """
    if mode == "gap":
        return lines_gap(words, key=key).select(*key, "word_idx", "line_id", *keep)
    order, position, fixed = ANCHORED[mode]
    mid = words.withColumn("mid_y", (F.col("y0") + F.col("y1")) / 2)
    sort = [F.col(c).cast("double").alias(f"o{k}") for k, c in enumerate(order) if c != "word_idx"]  # word_idx is last in every mode
    rest = [F.struct(*keep).alias("k")] if keep else []
    row = F.struct(*sort, F.col("word_idx").alias("w"), F.col(position).cast("double").alias("at"), *rest)
    size = {"anchor_relative": ["height"], "smoothed": [(F.col("y1") - F.col("y0")).cast("int").alias("h")]}.get(mode, [])
    mid = mid.select(*key, row.alias("row"), *size)  # made before they are collected: an aggregate would make each by interpretation
    of = {"r": F.sort_array(F.collect_list("row"))}
    if mode == "anchor_relative":
        of["height"], tolerance = F.max("height"), F.col("height") * relative
    elif mode == "smoothed":
        of["h"] = F.sort_array(F.collect_list("h"))
        tolerance = F.greatest(F.lit(4.0), F.floor(F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")) * 0.8).cast("double"))
    else:
        tolerance = F.lit(fixed)
    pages = mid.groupBy(*key).agg(*[x.alias(name) for name, x in of.items()])
    folded = pages.select(*key, "r", _line_starts(F.col("r.at"), tolerance, mode == "smoothed").alias("s"))
    end = lambda k: F.coalesce(F.get("s", k + 1), F.size("r") + 1)
    ids = F.flatten(F.transform("s", lambda start, k: F.array_repeat(k.cast("long"), end(k) - start)))  # slices would copy the page
    zipped = folded.select(*key, F.col("r.w").alias("word_idx"), ids.alias("line_id"), *([F.col("r.k").alias("k")] if keep else []))
    out = zipped.select(*key, F.inline(F.arrays_zip("word_idx", "line_id", *(["k"] if keep else []))))
    return out.select(*key, "word_idx", "line_id", "k.*") if keep else out
