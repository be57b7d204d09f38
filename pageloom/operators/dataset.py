"""Page records made ready for training, with counters that are taken in the pass that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Reasons to drop a page, in the order in which they are looked for.
REASONS = ("empty", "mismatch", "short", "unknown", "bad_bbox")


def process_records(pages: DataFrame, known: list[str], gone: str | None = "NOTE", least: int = 0) -> DataFrame:
    """Pages (words, bboxes, labels: arrays; width, height) with drop_reason (null: kept), filled (whether labels were missing and
    are O now), collapsed (how many labels were `gone` and are O now), label_ids (places in known), boxes in 0..1000, and of the
    kept labels non_o, non_o_ratio, ingredient, instruction and title.

    Reasons in order: empty (no words or no boxes), mismatch (numbers of words, boxes and labels differ), short (fewer than
    `least` words), unknown (a label that isn't known, null too), bad_bbox (a page without positive size, or a null box).
    collapsed counts the pages that come as far as their labels are looked at. The other columns pass.
    """
    c = F.col
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    n = size("words")
    missing = (n > 0) & (size("bboxes") > 0) & (size("labels") == 0)
    rows = pages.withColumn("filled", missing).withColumn("labels", F.when(missing, F.transform("words", lambda _: F.lit("O"))).otherwise(c("labels")))
    early = F.when((n == 0) | (size("bboxes") == 0), "empty").when((n != F.size("bboxes")) | (n != F.size("labels")), "mismatch").when(n < least, "short")
    rows = rows.withColumn("drop_reason", early)
    counted = F.when(c("drop_reason").isNull(), F.size(F.filter("labels", lambda x: x == F.lit(gone)))).otherwise(0)
    rows = rows.withColumn("collapsed", counted if gone else F.lit(0))
    rows = rows.withColumn("labels", F.transform("labels", lambda x: F.when(x == F.lit(gone), "O").otherwise(x)) if gone else c("labels"))
    strange = F.exists("labels", lambda x: F.coalesce(~x.isin(known), F.lit(True)))
    flat = F.coalesce((c("width") <= 0) | (c("height") <= 0), F.lit(True)) | F.exists("bboxes", lambda b: b.isNull() | (F.size(b) != 4))
    rows = rows.withColumn("drop_reason", F.coalesce("drop_reason", F.when(strange, "unknown").when(flat, "bad_bbox")))
    kept = c("drop_reason").isNull()
    scaled = lambda v, s: F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(v * 1000 / s))).cast("int")
    boxes = F.transform("bboxes", lambda b: F.transform(b, lambda v, k: scaled(v, F.when(k % 2 == 0, c("width")).otherwise(c("height")))))
    of = lambda *names: F.when(kept, F.size(F.filter("labels", lambda x: x.isin(*names))))
    rest = F.when(kept, F.size(F.filter("labels", lambda x: x != "O")))
    return rows.withColumns({
        "label_ids": F.when(kept, F.transform("labels", lambda x: F.array_position(F.array(*map(F.lit, known)), x).cast("int") - 1)),
        "boxes": F.when(kept, boxes), "non_o": rest, "non_o_ratio": rest / n,
        "ingredient": of("INGREDIENT_LINE"), "instruction": of("INSTRUCTION_STEP"), "title": of("TITLE", "RECIPE_TITLE"),
    })


def counters() -> list[Column]:
    """Aggregates over process_records' rows: pages by what became of them, labels collapsed, and words of the kept pages."""
    c, n = F.col, F.size("words")
    kept = c("drop_reason").isNull()
    zero = lambda x: F.coalesce(x, F.lit(0))
    return [
        F.count(F.lit(1)).alias("pages"), F.count_if(kept).alias("kept"), *(F.count_if(c("drop_reason") == r).alias(f"dropped_{r}") for r in REASONS),
        F.count_if("filled").alias("filled_missing_labels"), zero(F.sum("collapsed")).alias("note_collapsed"),
        zero(F.sum(F.when(kept, n))).alias("tokens"), F.min(F.when(kept, n)).alias("min_tokens"), F.max(F.when(kept, n)).alias("max_tokens"),
    ]


def write_processed(pages: DataFrame, path: str, known: list[str], gone: str | None = "NOTE", least: int = 0) -> dict[str, int | None]:
    """Write the kept pages of process_records to path and return the counters. They are observed on the rows as these are written,
    so the pages are read and worked on once; if tasks run again, the counters are those of the attempt that counts."""
    seen = Observation()
    rows = process_records(pages, known, gone, least).observe(seen, *counters())
    rows.where("drop_reason is null").drop("drop_reason").write.mode("overwrite").parquet(path)
    return seen.get
