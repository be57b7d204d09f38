"""Page selection, recipe-likeness, splits with constraints, merged label sources and checks of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

from .labels import rank_pages_blended
from .structure import LIMITS, filter_structural

# Patterns and limits that decide whether a page reads like a recipe.
FRACTION = r"\b\d+/\d+\b"
UNIT = r"\b(?:tsp|tbsp|teaspoon(?:ful)?s?|tablespoon(?:ful)?s?|cup|cups|oz|ounce|ounces|lb|lbs?|pint|pints|quart|quarts?)\b"
VERB = r"\b(beat|stir|mix|bake|boil|pour|add|serve|cook|strain)\b"
NEGATIVE = r"(table of contents|contents|index|chapter|illustrations)"
REJECT = {"title": 50, "ingredient": 5, "instruction": 10}
#: By how much each round relaxes a limit of the structural filter, and the value it stops at.
RELAX = {"avg_token_conf": (-0.05, 0.50), "tokens": (-10, 50), "o_ratio": (0.02, 0.98), "ingredient_lines": (-1, 1), "instruction_lines": (-1, 1), "labeled_ratio": (-0.005, 0.015)}


def recipe_like(text: Column) -> Column:
    """Does a text hold a fraction or a unit, and a cooking verb, and read unlike a table of contents? False for empty texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ~low.rlike(NEGATIVE) & (low.rlike(T.word_edges(FRACTION)) | low.rlike(T.word_edges(UNIT))) & low.rlike(T.word_edges(VERB))


# Fixed value: the version of the rules of the score.
SCORE_VERSION = 3


def score_prediction(words: DataFrame, texts: DataFrame, label: str = "label_pred") -> DataFrame:
    """By page: confidence that it is a recipe from counts of predicted labels, and whether it is one (its text must read like one);
    the counts, the score's parts and the version of its rules."""
    c, n = F.col, lambda *x: F.count_if(F.col(label).isin(*x))
    page = words.groupBy("page_num").agg(
        F.count("*").alias("n"), F.count_if(c(label) != "O").alias("k"), n("INGREDIENT_LINE").alias("ingredient"), n("INSTRUCTION_STEP").alias("instruction"),
        n("TITLE", "RECIPE_TITLE").alias("title"), F.avg(F.when(c(label) != "O", c("conf") / 100)).alias("mean"),
        F.max_by(F.when(c(label).isin("TITLE", "RECIPE_TITLE"), c("word")), F.when(c(label).isin("TITLE", "RECIPE_TITLE"), F.struct("conf", (-c("word_idx")).alias("k")))).alias("best_title"),
    )
    reject = (c("title") > REJECT["title"]) | (c("ingredient") < REJECT["ingredient"]) | (c("instruction") < REJECT["instruction"])
    part = lambda x, full: F.least(F.lit(1.0), c(x) / full)
    score = F.when(reject, 0.0).otherwise(0.45 * part("ingredient", 25.0) + 0.45 * part("instruction", 30.0) + 0.10 * (1.0 - part("title", 40.0)))
    out = page.join(texts.select("page_num", "text"), "page_num").withColumn("s", score)
    return out.select(
        "page_num", F.bround("s", 4).alias("recipe_confidence"), (~reject & recipe_like(c("text")) & (c("s") >= 0.35)).alias("is_recipe_page"), F.coalesce(F.trim("best_title"), F.lit("")).alias("best_title"),
        F.bround(F.coalesce("mean", F.lit(0.0)), 4).alias("avg_token_confidence"), F.bround(c("k") / c("n"), 4).alias("recipe_token_ratio"),
        *(c(k).alias(f"{k}_tokens") for k in ("ingredient", "instruction", "title")), F.bround(part("ingredient", 25.0), 4).alias("ingredient_score"),
        F.bround(part("instruction", 30.0), 4).alias("instruction_score"), F.bround(part("title", 40.0), 4).alias("title_penalty"), F.lit(SCORE_VERSION).alias("score_version"),
    )


def featured(scored: DataFrame, n: int = 10) -> DataFrame:
    """(rank, page_num, recipe_confidence, mode, status, default_page): the n recipe pages of the highest confidence, or, where
    there are none, the first n pages with a confidence of 0 ("fallback_any", "degraded"). The default page is the first. No pages
    give no rows."""
    c = F.col
    tier = c("is_recipe_page").cast("int")
    top = scored.select("page_num", "recipe_confidence", F.coalesce(tier, F.lit(0)).alias("tier")).withColumn("order", F.when(c("tier") == 1, -c("recipe_confidence")).otherwise(0.0))
    best = top.orderBy(F.desc("tier"), "order", "page_num").limit(n)
    w = Window.orderBy(F.desc("tier"), "order", "page_num")  # over n rows
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = best.withColumns({"rank": F.row_number().over(w), "best": F.max("tier").over(every), "default_page": F.first("page_num").over(every)}).where("tier = best")
    found = c("tier") == 1
    return ranked.select("rank", "page_num", F.when(found, c("recipe_confidence")).otherwise(0.0).alias("recipe_confidence"),
                         F.when(found, "curated_recipe").otherwise("fallback_any").alias("mode"), F.when(found, "ok").otherwise("degraded").alias("status"), "default_page")


def best_pages_by_label(words: DataFrame, labels: list[str], n: int = 5, label: str = "label_pred") -> DataFrame:
    """(label, rank, page_num, n): for each of the labels the n pages that hold most of it; the smaller page number wins ties, and
    pages without it fill up. Spark drops all but n rows a label and task before the rows meet (a group limit)."""
    page = words.groupBy("page_num").agg(*(F.count_if(F.col(label) == x).alias(f"n{k}") for k, x in enumerate(labels)))
    rows = page.select("page_num", F.inline(F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"n{k}").alias("n")) for k, x in enumerate(labels)))))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "page_num")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("label", "rank", "page_num", "n")


def limits_by_round(limits: dict[str, float] = LIMITS, rounds: int = 5) -> list[dict[str, float]]:
    out = [dict(limits)]
    for _ in range(rounds - 1):
        step = {k: (max if d < 0 else min)(stop, round(out[-1][k] + d, 6)) for k, (d, stop) in RELAX.items()}
        out.append(step)
    return out


def filter_structural_relaxing(metrics: DataFrame, least: int, limits: dict[str, float] = LIMITS, rounds: int = 5) -> DataFrame:
    """Pages that the structural filter keeps with the first limits, of `rounds` ever looser ones, that keep `least` pages (else the last)."""
    steps = limits_by_round(limits, rounds)
    first = F.coalesce(*(F.when(filter_keep(step), F.lit(k + 1)) for k, step in enumerate(steps)))
    tagged = metrics.select("page_num", F.array_compact(F.array(*(F.when(filter_keep(step), F.lit(k + 1)) for k, step in enumerate(steps)))).alias("passes"), first.alias("first"))
    kept = tagged.where("first IS NOT NULL").select("page_num", F.explode("passes").alias("round"))
    n = kept.groupBy("round").agg(F.count("*").alias("n"))
    chosen = n.agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("round"))), F.lit(rounds)).alias("round"))
    return kept.join(F.broadcast(chosen), "round").select("page_num", "round")  # one row


def filter_keep(limits: dict[str, float]) -> Column:
    c = F.col
    return (
        (c("title_lines") >= 1) & (c("ingredient_lines") >= limits["ingredient_lines"]) & (c("instruction_lines") >= limits["instruction_lines"]) & (c("avg_token_conf") >= limits["avg_token_conf"])
        & (c("o_ratio") <= limits["o_ratio"]) & (c("total_tokens") >= limits["tokens"]) & (c("labeled_token_ratio") >= limits["labeled_ratio"])
    )


def select_easy_pages(metrics: DataFrame, titles: int = 1, ingredient: tuple[int, int] = (1, 20), instruction: tuple[int, int] = (1, 20), conf: float = 0.4, o_ratio: float = 0.95, tokens: int = 30, n: int = 50) -> DataFrame:
    """The first n pages, by number, within all ranges."""
    c = F.col
    ok = (c("title_lines") == titles) & c("ingredient_lines").between(*ingredient) & c("instruction_lines").between(*instruction)
    return metrics.where(ok & (c("avg_token_conf") >= conf) & (c("o_ratio") <= o_ratio) & (c("total_tokens") >= tokens)).orderBy("page_num").limit(n)


def best_pages(metrics: DataFrame, n: int = 20) -> DataFrame:
    """The n best kept pages by confidence and share of labelled words; the smaller page number wins ties."""
    c = F.col
    score = c("avg_token_conf") * 0.6 + (1 - c("o_ratio")) * 0.2 + F.least(F.lit(1.0), c("labeled_token_ratio") * 10) * 0.2
    return filter_structural(metrics).where("keep").select("page_num", F.round(score, 6).alias("best_score")).orderBy(F.desc("best_score"), "page_num").limit(n)


def select_with_coverage(stats: DataFrame, n: int, share: float = 0.3, rich: int = 10) -> DataFrame:
    """The n best pages by the blended count; if fewer than `share` of them hold `rich` ingredient words, the poorest make way for the richest others.

    Both ranks run over at most n rows.
    """
    top = rank_pages_blended(stats, n)
    others = stats.join(top.select("page_num"), "page_num", "left_anti").where(F.col("ingredient") >= rich)
    one = top.agg(F.count("*").alias("n_top"), F.count_if(F.col("ingredient") >= rich).alias("n_rich"))
    need = F.when(F.col("n_rich") / F.col("n_top") < share, int(n * share) - F.col("n_rich")).otherwise(0)
    donors = others.orderBy(F.desc("ingredient"), F.desc("page_num")).limit(int(n * share)).select("page_num", F.row_number().over(Window.orderBy(F.desc("ingredient"), F.desc("page_num"))).alias("k"))
    poor = top.where(F.col("ingredient") < rich).select("page_num", F.row_number().over(Window.orderBy("instruction", "page_num")).alias("k"))
    swaps = donors.withColumnRenamed("page_num", "new_page").join(poor, "k").join(F.broadcast(one), F.lit(True)).where(F.col("k") <= need)  # one row
    kept = top.select("page_num").join(swaps.select("page_num"), "page_num", "left_anti")
    return kept.unionByName(swaps.select(F.col("new_page").alias("page_num")))


def global_rank(rows: DataFrame, slots: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add a rank over all rows, and n_all: rows are counted by slots (a few thousand at most), then ranked within each."""
    sums = rows.groupBy(*slots).agg(F.count("*").alias("n"))
    before = Window.orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*slots, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("n_all"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*slots).orderBy(*order))
    return rows.join(F.broadcast(starts), slots).withColumn(name, place).drop("before")


def digested(pages: DataFrame, seed: int) -> DataFrame:
    """Pages with a digest of seed and number, and a slot: its first two digits."""
    return pages.withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_num").cast("string")))).withColumn("slot", F.substring("digest", 1, 2))


def split_stratified(stats: DataFrame, seed: int = 42, test: float = 0.1, validation: float = 0.15, ingredient: int = 10, instruction: int = 10) -> DataFrame:
    """Test pages at random; validation takes some pages with ingredients (even beyond its size), some with instructions, then any.

    The two minimums are small numbers, so those pages are broadcast.
    """
    c = F.col
    ranked = global_rank(digested(stats.select("page_num", "ingredient", "instruction"), seed), ["slot"], ["digest", "page_num"])
    n_test = F.floor(c("n_all") * test)
    sized = ranked.withColumn("n_test", n_test).withColumn("n_val", F.floor((c("n_all") - c("n_test")) * validation)).drop("n_all")
    rest = sized.where(c("rank") > c("n_test"))
    first = lambda column, n: rest.where(c(column) > 0).orderBy("rank").limit(n).select("page_num")
    must = first("ingredient", ingredient).withColumn("tier", F.lit(0)).unionByName(first("instruction", instruction).withColumn("tier", F.lit(1))).groupBy("page_num").agg(F.min("tier").alias("tier"))
    tiered = rest.join(F.broadcast(must), "page_num", "left").withColumn("tier", F.coalesce("tier", F.lit(2)))
    placed = global_rank(tiered, ["tier", "slot"], ["digest", "page_num"], "place")
    inside = (c("tier") == 0) | (c("place") <= c("n_val"))
    done = placed.select("page_num", F.when(inside, "validation").otherwise("train").alias("split"))
    return done.unionByName(sized.where(c("rank") <= c("n_test")).select("page_num", F.lit("test").alias("split")))


def split_with_holdout(pages: DataFrame, holdout: DataFrame, seed: int = 42, test: float = 0.1, validation: float = 0.15) -> DataFrame:
    """Pages of the hold-out table are demo_eval; of the others int(n * test) are test and int(n * validation) validation."""
    c = F.col
    ids, held = pages.select("page_num").distinct(), holdout.select("page_num").distinct()
    ranked = global_rank(digested(ids.join(held, "page_num", "left_anti"), seed), ["slot"], ["digest", "page_num"])
    n_test, n_val = F.floor(c("n_all") * test), F.floor(c("n_all") * validation)
    split = F.when(c("rank") <= n_test, "test").when(c("rank") <= n_test + n_val, "validation").otherwise("train")
    return ranked.select("page_num", split.alias("split")).unionByName(ids.join(held, "page_num", "left_semi").withColumn("split", F.lit("demo_eval")))


def merge_label_sources(pages: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each page with the label of the first source that has it, the last record (pos) of a page within a source, else ocr_only."""
    named = [d.select("page_num", "pos", "page_label", F.lit(k).alias("priority"), F.lit(name).alias("label_source")) for k, (name, d) in enumerate(sources)]
    every = named[0]
    for d in named[1:]:
        every = every.unionByName(d)
    best = every.groupBy("page_num").agg(F.min_by(F.struct("label_source", "page_label"), F.struct("priority", (-F.col("pos")).alias("p"))).alias("b"))
    return pages.join(best, "page_num", "left").withColumns({"label_source": F.coalesce("b.label_source", F.lit("ocr_only")), "page_label": F.col("b.page_label"), "has_labels": F.col("b").isNotNull()}).drop("b")


def bbox_ranges(words: DataFrame, split: str, most: int = 1000) -> DataFrame:
    """By split: the least and the greatest coordinate, and pages with one outside 0..most."""
    low, high = F.least("x0", "y0", "x1", "y1"), F.greatest("x0", "y0", "x1", "y1")
    page = words.groupBy(split, "page_num").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    return page.groupBy(split).agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count_if((F.col("lo") < 0) | (F.col("hi") > most)).alias("pages_out"))


def every_nth(pages: DataFrame, n: int, most: int = 20) -> DataFrame:
    """The first, and then every n-th page by page_num, `most` in all."""
    first = pages.orderBy("page_num").limit(n * most)
    return first.withColumn("nth", F.row_number().over(Window.orderBy("page_num"))).where(F.col("nth") % n == 1).drop("nth")  # n * most rows
