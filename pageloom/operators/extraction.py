"""Recipes from labelled words: lines by label, title, ingredients, steps, confidences, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T

from .lines import line_features, lines_gap
from .titles import extract_title

# Prefixes of line ids, and the limits of section states.
PREFIX = {"TITLE": "ttl", "INGREDIENT_LINE": "ing", "INSTRUCTION_STEP": "ins"}
READY = {"title": (0.85, 1), "ingredients": (0.80, 3), "instructions": (0.80, 2)}


def lines_for_label(words: DataFrame, gap: float = 10) -> DataFrame:
    """Lines of each label of PREFIX by themselves: id, cleaned text, confidence (0..1), box and word count; empty lines are left out."""
    c, key = F.col, ("page_num", "label")
    rows = line_features(lines_gap(words.where(c("label").isin(*PREFIX)), gap, key), key)
    prefix = F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))[c("label")]
    out = rows.withColumns({
        "line": F.concat(prefix, F.lit("_"), F.lpad((c("line_id") + 1).cast("string"), 4, "0")), "line_text": T.clean_text(c("line_text")), "line_conf": F.round(c("avg_conf") / 100, 6)
    })
    return out.where("line_text <> ''").select("page_num", "label", "line_id", "line", "line_text", "line_conf", "n_words", "bx0", "by0", "bx1", "by1")


def extract_recipe(words: DataFrame, gap: float = 10, label: str = "TITLE") -> DataFrame:
    """One recipe for each page of words: title (the chain of extract_title over label), title_by, ingredients, instructions and
    confidences.

    Instructions become one paragraph if more than half of several lines end in neither . nor !. The overall confidence weighs
    what is present: the title 1 (whatever is left of its text), ingredients and instructions 1.5 each. A page with nothing to
    find has an empty title and empty lists, and confidences of 0; a page without words has no row.
    """
    c = F.col
    of = lambda x: F.sort_array(F.collect_list(F.when(c("label") == x, F.struct("line_id", "line_text", "line_conf"))))
    lines = lines_for_label(words.where(c("label").isin("INGREDIENT_LINE", "INSTRUCTION_STEP")), gap)
    found = lines.groupBy("page_num").agg(of("INGREDIENT_LINE").alias("i"), of("INSTRUCTION_STEP").alias("s"))
    named = extract_title(words, label).select("page_num", "title", F.round("conf", 6).alias("conf_title"), c("by").alias("title_by"))
    page = words.select("page_num").distinct().join(found, "page_num", "left").join(named, "page_num", "left")
    texts = lambda x: F.coalesce(F.transform(x, lambda r: r["line_text"]), F.array().cast("array<string>"))
    mean = lambda x: F.round(F.coalesce(F.aggregate(x, F.lit(0.0), lambda a, r: a + r["line_conf"]) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0)), 9)
    loose = F.size(F.filter("s", lambda r: ~r["line_text"].rlike(r"[.!]\s*$"))) / F.size("s") > 0.5
    out = page.select(
        "page_num", F.coalesce("title", F.lit("")).alias("title"), "title_by", texts("i").alias("ingredients"),
        F.when((F.size("s") > 1) & loose, F.array(F.array_join(texts("s"), " "))).otherwise(texts("s")).alias("instructions"),
        F.coalesce("conf_title", F.lit(0.0)).alias("conf_title"), mean("i").alias("conf_ingredients"), mean("s").alias("conf_instructions"),
    )
    weight = lambda there, w: F.when(there, w).otherwise(0.0)
    w = {"title": weight(c("title_by").isNotNull(), 1.0), "ingredients": weight(F.size("ingredients") > 0, 1.5), "instructions": weight(F.size("instructions") > 0, 1.5)}
    total = sum(w.values(), F.lit(0.0))
    return out.withColumn("conf_overall", F.round(F.coalesce(sum((c(f"conf_{k}") * x for k, x in w.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0)), F.lit(0.0)), 9))


def section_status(recipes: DataFrame) -> DataFrame:
    """State of each section (missing, needs-review, high-confidence), and ready: are all three of high confidence?"""
    c = F.col
    size = {"title": F.when(F.trim("title") != "", 1).otherwise(0), "ingredients": F.size("ingredients"), "instructions": F.size("instructions")}
    state = {f"{k}_status": F.when(size[k] == 0, "missing").when((size[k] < n) | F.coalesce(c(f"conf_{k}") < t, F.lit(False)), "needs-review").otherwise("high-confidence") for k, (t, n) in READY.items()}
    out = recipes.withColumns(state)
    return out.withColumn("ready", (c("title_status") == "high-confidence") & (c("ingredients_status") == "high-confidence") & (c("instructions_status") == "high-confidence"))


def confidence_chain(recipes: DataFrame, fields: list[str], tokens: DataFrame, default: float = 0.85) -> DataFrame:
    """recipes with overall_confidence and confidence_from: the mean of the fields that have a confidence ("fields"), else the mean
    confidence of the page's tokens (page_num, conf of 0 to 1; null: 0; "tokens"), else the default ("default")."""
    c = F.col
    known = F.array_compact(F.array(*(c(x).cast("double") for x in fields)))
    of_fields = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    mean = tokens.groupBy(c("page_num").alias("_page")).agg(F.avg(F.coalesce("conf", F.lit(0.0))).alias("_mean"))
    both = recipes.join(mean, c("page_num") == c("_page"), "left")
    source = F.when(F.size(known) > 0, "fields").when(c("_mean").isNotNull(), "tokens").otherwise("default")
    return both.withColumns({"overall_confidence": F.round(F.coalesce(of_fields, "_mean", F.lit(default)), 9), "confidence_from": source}).drop("_page", "_mean")


def recipe_to_markdown(recipes: DataFrame) -> DataFrame:
    none = F.array(F.lit("(not detected)"))
    some = lambda x: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, F.col(x)).otherwise(none)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Recipe"))
    bullets = F.array_join(F.transform(some("ingredients"), lambda x: F.concat(F.lit("- "), x)), "\n")
    steps = F.array_join(F.transform(some("instructions"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return recipes.withColumn("markdown", F.concat(F.lit("# "), title, F.lit("\n\n## Ingredients\n"), bullets, F.lit("\n\n## Instructions\n"), steps))


def recipe_quality(recipes: DataFrame, snapshot: str) -> DataFrame:
    """By snapshot: recipes, share with a title, mean title length, and mean numbers of ingredients and instructions."""
    titled = F.trim("title") != ""
    return recipes.groupBy(snapshot).agg(
        F.count("*").alias("recipes"), F.round(F.avg(titled.cast("int")), 6).alias("titled"), F.round(F.avg(F.when(titled, F.char_length("title"))), 6).alias("title_length"),
        F.round(F.avg(F.size("ingredients")), 6).alias("ingredients"), F.round(F.avg(F.size("instructions")), 6).alias("instructions"),
    )


def quality_difference(quality: DataFrame, snapshot: str, before: str, after: str) -> DataFrame:
    """(metric, before, after, change) from two rows of recipe_quality; a snapshot that is not there gives nulls."""
    metrics = ["recipes", "titled", "title_length", "ingredients", "instructions"]
    tidy = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    rows = quality.select(snapshot, tidy)
    side = lambda name: F.max(F.when(F.col(snapshot) == name, F.col("value")))
    return rows.groupBy("metric").agg(side(before).alias("before"), side(after).alias("after")).withColumn("change", F.col("after") - F.col("before"))


def apply_corrections(recipes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Recipes with corrected fields in place (null: not corrected) and changes: names of the fields that differ.

    Corrections (page_num, title, ingredients, instructions) of unknown pages give a row with the error "no_recipe".
    """
    fields = ["title", "ingredients", "instructions"]
    new = corrections.select("page_num", *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("corrected"))
    both = recipes.select("page_num", *fields, F.lit(True).alias("known")).join(new, "page_num", "full")
    differs = [F.when(F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]
    return both.select(
        "page_num", *(F.coalesce(f"new_{f}", f).alias(f) for f in fields), F.when(F.col("known").isNotNull(), F.array_compact(F.array(*differs))).alias("changes"),
        F.col("corrected").isNotNull().alias("corrected"), F.when(F.col("known").isNull(), "no_recipe").alias("error"),
    )


def export_corrections(recipes: DataFrame) -> DataFrame:
    """Correction records of edited recipes: trimmed texts, empty ones left out."""
    filled = lambda x: F.filter(F.transform(x, lambda t: F.trim(t)), lambda t: t != "")
    return recipes.select("page_num", F.struct(F.trim("title").alias("title"), filled("ingredients").alias("ingredients"), filled("instructions").alias("instructions")).alias("corrected"))
