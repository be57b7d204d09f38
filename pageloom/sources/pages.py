"""Page sources: JSON lines with required fields, and page, word and label tables projected from plain documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "book string, year int, page_num int, image_path string, width int, height int, words array<string>, bboxes array<array<int>>, confidences array<double>, text string"
REQUIRED = ["page_num", "image_path", "width", "height", "words", "bboxes"]


def read_pages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Pages with all required fields; broken lines and pages without a field are left out."""
    return spark.read.schema(PAGE_SCHEMA).option("mode", "PERMISSIVE").json(path).dropna(subset=REQUIRED)


def _split(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def _height(words: Column) -> Column:
    """A page is as high as its lines of nine words, and a margin."""
    return (100 + 30 * F.ceil(F.size(words) / 9)).cast("int")


def _word(raw: Column, i: Column) -> Column:
    """The word at place i: some places of every 29 hold fixed words."""
    out = raw
    for at, w in ((3, "1/2"), (4, "cup"), (5, "sugar"), (11, "Mix"), (17, "30"), (18, "minutes")):
        out = F.when(i % 29 == at, w).otherwise(out)
    return out


def _confidence(page: Column, i: Column) -> Column:
    return (page * 37 + i * 13) % 101


def word_table(docs: DataFrame) -> DataFrame:
    """One row for each word of a document, with a box, a confidence, labels and the page's height, laid out by fixed rules
    (see FIXTURES.md). Null and empty texts have no words."""
    split = docs.select(F.col("doc_id").alias("page_num"), F.col("source").alias("book"), _split().alias("split"))
    rows = split.select("page_num", "book", _height(F.col("split")).alias("height"), F.posexplode("split").alias("word_idx", "raw"))
    m, i = F.col("word_idx") % 29, F.col("word_idx")
    label = (
        F.when((m <= 2) & (F.col("line0") == 0), "TITLE").when(m.between(3, 5), "INGREDIENT_LINE")
        .when(m.between(11, 16), "INSTRUCTION_STEP").when(m.between(17, 18), "TIME").otherwise("O")
    )
    x0, y0 = 60 + 100 * (i % 9), 40 + 30 * F.col("line0") + (i * 7) % 5
    flip = (F.col("page_num") + i) % 7 == 0
    swap = F.when((F.col("label") == "O") & flip, "INGREDIENT_LINE").when((F.col("label") == "INGREDIENT_LINE") & ((F.col("page_num") + i) % 11 == 0), "O")
    boxes = {"x0": x0, "x1": x0 + 8 * F.least(F.char_length("word"), F.lit(11)), "y0": y0, "y1": y0 + 18}
    placed = rows.withColumn("line0", F.floor(i / 9).cast("int")).withColumn("word", _word(F.col("raw"), i)).withColumns(boxes)
    return placed.withColumns({"conf": _confidence(F.col("page_num"), i), "label": label}).withColumn("label_pred", swap.otherwise(F.col("label"))).drop("raw")


def page_table(docs: DataFrame) -> DataFrame:
    """One row for each document: words and confidences in order, the text by lines, and the page's size. Built in place, from
    arrays. A null or empty text is a page without words."""
    c = F.col
    rows = docs.select(c("doc_id").alias("page_num"), c("source").alias("book"), _split().alias("split"))
    words = F.transform("split", lambda w, i: _word(w, i))
    lines = F.transform("words", lambda w, i: F.concat(F.when(i == 0, "").when(i % 9 == 0, "\n").otherwise(" "), w))
    confidences = F.transform("split", lambda _, i: _confidence(c("page_num"), i))
    out = rows.select("page_num", "book", _height(c("split")).alias("height"), F.lit(1000).alias("width"), words.alias("words"), confidences.alias("confidences"))
    return out.withColumn("text", F.array_join(lines, ""))


def assemble_pages(words: DataFrame) -> DataFrame:
    """(page_num, words, bboxes, confidences) of recognised words (page_num, pos, text, conf, left, top, width, height): without
    blank words and those of negative confidence, from top to bottom, then from left to right, boxes as corners."""
    c = F.col
    kept = words.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("conf", F.lit(-1)) >= 0))
    row = F.struct("top", "left", "pos", c("text").alias("word"), "conf", (c("left") + c("width")).alias("right"), (c("top") + c("height")).alias("foot"))
    pages = kept.groupBy("page_num").agg(F.array_sort(F.collect_list(row)).alias("r"))
    boxes = F.transform("r", lambda x: F.array(x["left"], x["top"], x["right"], x["foot"]))
    return pages.select("page_num", F.transform("r", lambda x: x["word"]).alias("words"), boxes.alias("bboxes"), F.transform("r", lambda x: x["conf"]).alias("confidences"))
