"""Checks and views of recipe and page records: catalogue rows, validators, browsing, lookups and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

# What every catalogue row says, and the limits of a demo record.
CATALOG = {"category": "Historical", "servings": "Variable", "prep": "Variable", "cook": "Variable", "total": "See instructions"}
CATALOG_TAGS = ["1918", "fanny-farmer", "historical"]
DEMO = {"version": "demo_pred_v1", "tokens": 50, "lines": 5}
COORD_SPACES = ["px", "norm_1000"]


def issues(*rules: tuple[Column, Column | str]) -> Column:
    """The texts of the rules that a row breaks, in order; a null condition counts as broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), m if isinstance(m, Column) else F.lit(m)) for bad, m in rules)))


def recipe_catalog_row(recipes: DataFrame, book: str, year: int) -> DataFrame:
    """Catalogue records of extracted recipes (page_num, title, ingredients, instructions, conf_*): id, fixed fields, source and
    confidences; a recipe without title is named after its page."""
    c = F.col
    named = F.when(F.coalesce(c("title"), F.lit("")) == "", F.concat(F.lit("Recipe from page "), c("page_num").cast("string"))).otherwise(c("title"))
    return recipes.select(
        T.recipe_id(c("title"), c("page_num")).alias("id"), F.lit(book).alias("book"), F.lit(year).alias("year"), named.alias("title"), F.lit(CATALOG["category"]).alias("category"),
        F.array(*map(F.lit, CATALOG_TAGS)).alias("tags"), F.struct(*[F.lit(CATALOG[k]).alias(k) for k in ("prep", "cook", "total")]).alias("time"), F.lit(CATALOG["servings"]).alias("servings"),
        "ingredients", "instructions", F.array().cast("array<string>").alias("notes"), F.struct(c("page_num").alias("page")).alias("source"),
        F.struct(*[c(f"conf_{k}").alias(k) for k in ("title", "ingredients", "instructions")]).alias("field_confidence"),
    )


def display_record(catalog: DataFrame) -> DataFrame:
    """Catalogue records as they are shown: minutes of the total time, and the mean of five field confidences (1 where there is
    none; servings and time count as 1)."""
    f = F.col("field_confidence")
    known = [F.coalesce(f[k].cast("double"), F.lit(1.0)) for k in ("title", "ingredients", "instructions")]
    return catalog.withColumns({"total_minutes": T.minutes(F.col("time")["total"]), "confidence": (known[0] + known[1] + known[2] + 2) / 5})


def parse_corpus(pages: DataFrame, recipes: DataFrame, first: int, last: int) -> DataFrame:
    """(page_num, outcome, id, title) for each page of the range: recipe, not_recipe (by is_recipe, or an extraction without
    title, ingredients and instructions), or missing where there is no prediction (is_recipe null)."""
    c = F.col
    both = pages.where(c("page_num").between(first, last)).select("page_num", "is_recipe").join(recipes.select("page_num", "title", "ingredients", "instructions"), "page_num", "left")
    empty = (F.coalesce("title", F.lit("")) == "") & (F.coalesce(F.size("ingredients"), F.lit(0)) + F.coalesce(F.size("instructions"), F.lit(0)) <= 0)
    outcome = F.when(c("is_recipe").isNull(), "missing").when(~c("is_recipe") | empty, "not_recipe").otherwise("recipe")
    found = both.withColumn("outcome", outcome)
    named = F.when(F.coalesce(c("title"), F.lit("")) == "", F.concat(F.lit("Recipe from page "), c("page_num").cast("string"))).otherwise(c("title"))
    keep = c("outcome") == "recipe"
    return found.select("page_num", "outcome", F.when(keep, T.recipe_id(c("title"), c("page_num"))).alias("id"), F.when(keep, named).alias("title"))


def catalog_index(catalog: DataFrame) -> DataFrame:
    """(kind, name, n): the catalogue's totals ("recipes"), its categories and its tags, with how many recipes have each."""
    rows = catalog.select(F.explode(F.concat(
        F.array(F.struct(F.lit("total").alias("kind"), F.lit("recipes").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name"))),
        F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name"))),
    )).alias("x"))
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def index_rows(catalog: DataFrame) -> DataFrame:
    """(position, id, title, category, tags) by page: the index of a catalogue. Positions are numbered within pages' ranges of
    the sorted write, so here the page is the position."""
    return catalog.select(F.col("source.page").alias("position"), "id", "title", "category", "tags")


def validate_recipes(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """(id, message): what is wrong with records (missing fields, empty lists, an id that an earlier page has, an id that the
    index lacks), and ids that only the index has."""
    c = F.col
    short = lambda x: F.coalesce(F.size(x), F.lit(-1)) <= 0
    text = [(c(k).isNull(), f"Missing or invalid field '{k}'") for k in ("id", "book", "title", "category", "servings", "year")]
    conf = [c(f"conf_{k}") for k in ("title", "ingredients", "instructions")]
    flat = catalog.select(
        *("id", "book", "title", "category", "servings", "year", "tags", "ingredients", "instructions"), c("time.total").alias("total"), c("source.page").alias("page"),
        *[c(f"field_confidence.{k}").alias(f"conf_{k}") for k in ("title", "ingredients", "instructions")],
    )
    first = flat.groupBy(c("id").alias("first_id")).agg(F.min("page").alias("first_page"))
    known = index.select(c("id").alias("index_id")).distinct()
    both = flat.join(first, c("id") == c("first_id"), "left").join(known, c("id") == c("index_id"), "left")
    found = issues(
        *text, (c("tags").isNull(), "Missing or invalid field 'tags'"), (short("ingredients"), "Missing ingredients array"), (short("instructions"), "Missing instructions array"),
        (c("total").isNull(), "Missing time.total"), (c("page").isNull(), "Missing source.page"),
        (conf[0].isNull() | conf[1].isNull() | conf[2].isNull(), "field_confidence must include title, ingredients, instructions"), (F.coalesce(c("page") > c("first_page"), F.lit(False)), F.concat(F.lit("Duplicate id '"), c("id"), F.lit("'"))), (c("index_id").isNull(), "Missing from index"),
    )
    only = known.join(catalog.select(c("id").alias("index_id")), "index_id", "left_anti")
    missing = only.select(c("index_id").alias("id"), F.concat(F.lit("Index references missing id '"), c("index_id"), F.lit("'")).alias("message"))
    return both.select("id", F.explode(found).alias("message")).unionByName(missing)


def validate_page_record(pages: DataFrame) -> DataFrame:
    """(page_num, errors, warnings) of records of sections.sectioned_page."""
    c, has = F.col, lambda s: F.coalesce(F.exists("sections", lambda x: x["section"] == s), F.lit(False))
    conf = lambda k: c("recipe")[f"conf_{k}"]
    bad = lambda k: (conf(k).isNull() | (conf(k) < 0) | (conf(k) > 1), f"Invalid confidence.{k}")
    empty = lambda k: F.coalesce(F.size(c("recipe")[k]), F.lit(-1)) < 1
    title = F.coalesce(c("recipe")["title"], F.lit(""))
    errors = issues(
        (c("schema_version") != DEMO["version"], "Invalid schemaVersion"), (c("page.width").isNull() | c("page.height").isNull(), "Missing required page fields"), (~c("page.coord_space").isin(COORD_SPACES), "Invalid coordSpace"),
        (~has("ingredients"), "No ingredients section found"), (~has("instructions"), "No instructions section found"), (title.isin("", "Unknown Recipe"), "Title not extracted"),
        (empty("ingredients"), "No ingredients extracted"), (empty("instructions"), "No instructions extracted"), *map(bad, ("title", "ingredients", "instructions", "overall")),
    )
    warnings = issues((F.coalesce(F.size("tokens"), F.lit(0)) < DEMO["tokens"], "Low token count"), (F.coalesce(F.size("lines"), F.lit(0)) < DEMO["lines"], "Low line count"), (~has("title"), "No title section found"))
    return pages.select("page_num", errors.alias("errors"), warnings.alias("warnings"))


def validate_expected_title(found: DataFrame) -> DataFrame:
    """found (title, expected, keywords, page_num, expected_page) with warnings: the title neither holds nor is held by the
    expected one and no keyword is in it (no keywords: any title will do), or the pages differ."""
    c = F.col
    title, expected = F.lower(F.coalesce("title", F.lit(""))), F.lower("expected")
    hit = (F.size("keywords") == 0) | F.exists("keywords", lambda k: title.contains(F.lower(k)))
    fits = title.contains(expected) | expected.contains(title)
    pages = F.coalesce((c("page_num") != 0) & (c("expected_page") != 0) & (c("page_num") != c("expected_page")), F.lit(False))
    return found.withColumn("warnings", issues((~fits & ~hit, "title"), (pages, "page")))


def validate_label_ids(pages: DataFrame, n_labels: int) -> DataFrame:
    """(page_num, problem) for pages (words, label_ids) with ids outside 0 .. n_labels - 1 or as many ids as words are not."""
    outside = F.exists("label_ids", lambda x: (x < 0) | (x >= n_labels))
    found = issues((F.coalesce(outside, F.lit(False)), "id out of range"), (F.size("words") != F.size("label_ids"), "length mismatch"))
    return pages.select("page_num", F.explode(found).alias("problem"))


def browse_recipes(
    recipes: DataFrame, category: str | None = None, tag: str | None = None, ingredient: str | None = None, time: str | None = None, query: str = "", sort: str = "title"
) -> DataFrame:
    """Recipes (id, title, category, tags, ingredients, total_minutes, confidence) that pass all filters given, sorted by title,
    category or falling confidence (then by id). time: quick (to 30 minutes), mid (30 to 60) or slow (over 60)."""
    c = F.col
    holds = lambda text: F.exists("ingredients", lambda x: F.contains(F.lower(x), F.lit(text.lower())))
    out = recipes
    if category:
        out = out.where(c("category") == category)
    if tag:
        out = out.where(F.array_contains("tags", tag))
    if ingredient:
        out = out.where(holds(ingredient))
    if time:
        out = out.where({"quick": c("total_minutes") <= 30, "mid": c("total_minutes").between(30, 60), "slow": c("total_minutes") > 60}[time])
    if query.strip():
        out = out.where(F.contains(F.lower("title"), F.lit(query.lower())) | holds(query))
    return out.orderBy({"title": c("title"), "category": c("category"), "confidence": F.desc("confidence")}[sort], "id")


def index_difference(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(key, side) for keys that only one of two tables has: left or right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), key, "full")
    return both.where(F.col("a").isNull() | F.col("b").isNull()).select(key, F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


def page_lookup(splits: DataFrame, featured: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(page_num, split, place) of featured pages: where a page is in its split, counted from 0 by page. Pages are counted by
    ranges of `width` numbers, and ranked within each, so that no split is sorted in one task. A null split is a split."""
    slot = F.floor(F.col("page_num") / width)
    wanted = splits.join(featured.select("page_num").distinct().withColumn("wanted", F.lit(True)), "page_num", "left").withColumn("slot", slot)
    before = Window.partitionBy("split").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = wanted.groupBy("split", "slot").agg(F.count("*").alias("n"))
    starts = sizes.select("split", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = wanted.withColumn("nth", F.row_number().over(Window.partitionBy("split", "slot").orderBy("page_num"))).where("wanted")
    both = ranked.alias("r").join(starts.alias("s"), F.expr("r.split <=> s.split AND r.slot = s.slot"))
    return both.select("r.page_num", "r.split", (F.col("s.before") + F.col("r.nth") - 1).alias("place"))


def pick_page(splits: DataFrame, wanted: int | None, preferred: str = "validation") -> DataFrame:
    """One row (page_num, split): the wanted page if there is one, else the first page of the preferred split, else of train,
    val, validation, else of any."""
    c = F.col
    order = [preferred, "val" if preferred.startswith("val") and preferred != "val" else "validation", "train", "val", "validation"]
    tier = F.when(c("page_num") == wanted, -1) if wanted is not None else F.when(F.lit(False), -1)
    for k, name in enumerate(order):
        tier = tier.when(c("split") == name, k)
    return splits.withColumn("tier", tier.otherwise(len(order))).orderBy("tier", "page_num", "split").limit(1).select("page_num", "split")


def ensure_validation_split(pages: DataFrame, share: float = 0.1, seed: int = 42, least: int = 10) -> DataFrame:
    """pages (page_num, split) with a validation split: a filled one (validation, val or eval) is kept under its name; else a
    share of train, at least one page, by a hash of page and seed. An error with fewer than `least` train pages then."""
    n = {r.split: r["count"] for r in pages.groupBy("split").count().collect()}  # a row for each split
    if any(n.get(s) for s in ("validation", "val", "eval")):
        return pages
    if n.get("train", 0) < least:
        raise ValueError(f"{n.get('train', 0)} train pages are too few to split off validation")
    size = max(1, int(n["train"] * share))
    train = pages.where("split = 'train'").select("page_num", F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_num").cast("string"))).alias("h"))
    moved = train.orderBy("h", "page_num").limit(size).select("page_num", F.lit("validation").alias("moved"))
    both = pages.join(moved, "page_num", "left")
    return both.withColumn("split", F.when((F.col("split") == "train") & F.col("moved").isNotNull(), "validation").otherwise(F.col("split"))).drop("moved")


def gold_pred_join(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(page_num, place, gold, predicted): labels side by side, by place, cut to the shorter side of each page."""
    order = Window.partitionBy("page_num").orderBy("word_idx")
    side = lambda df, name: df.select("page_num", (F.row_number().over(order) - 1).alias("place"), F.col("label").alias(name))
    return side(gold, "gold").join(side(predicted, "predicted"), ["page_num", "place"])


def tokens_to_display(words: DataFrame) -> DataFrame:
    return words.select("page_num", F.concat(F.lit("tok-"), F.col("word_idx").cast("string")).alias("id"), F.col("word").alias("text"), "label", (F.col("conf") / 100).alias("score"), "x0", "y0", "x1", "y1")


def lines_to_display(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Lines of kinds_of_lines as display tokens; a line without text gets it from its words."""
    c = F.col
    bare = lines.where(F.coalesce("line_text", F.lit("")) == "").select("page_num", "line_id", F.posexplode("token_ids").alias("pos", "word_idx"))
    text = bare.join(words.select("page_num", "word_idx", "word"), ["page_num", "word_idx"]).groupBy("page_num", "line_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    made = text.select("page_num", "line_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("made"))
    both = lines.join(made, ["page_num", "line_id"], "left")
    shown = F.coalesce("made", "line_text")
    return both.select("page_num", F.concat(F.lit("line-"), c("line_id").cast("string")).alias("id"), shown.alias("text"), c("kind").alias("label"), c("line_conf").alias("score"), "bx0", "by0", "bx1", "by1")


def clean_words(pages: DataFrame) -> DataFrame:
    """pages (words and other arrays of the same length, here confidences) without blank words, and with misread words set
    right; arrays stay in step."""
    kept = F.filter(F.arrays_zip("words", "confidences"), lambda x: F.trim(x["words"]) != "")
    return pages.withColumn("k", kept).withColumns({"words": F.transform("k", lambda x: T.rewrite_misread(x["words"])), "confidences": F.transform("k", lambda x: x["confidences"])}).drop("k")


def metric_report(confusion: DataFrame) -> DataFrame:
    """(label, metric, value) in rows, from (label, label_pred, n): precision, recall, f1 and support by label, and accuracy,
    macro and weighted averages under the label "all"."""
    c = F.col
    side = lambda k, name: confusion.groupBy(c(k).alias("label")).agg(F.sum("n").alias(name))
    hit = confusion.where("label = label_pred").select("label", c("n").alias("tp"))
    rows = side("label", "support").join(side("label_pred", "predicted"), "label", "full").join(hit, "label", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    per = rows.withColumns({"precision": ratio(c("tp"), c("predicted")), "recall": ratio(c("tp"), c("support"))})
    per = per.withColumn("f1", F.coalesce(2 * c("precision") * c("recall") / F.nullif(c("precision") + c("recall"), F.lit(0.0)), F.lit(0.0)))
    names = ["precision", "recall", "f1"]
    tidy = lambda pairs: F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in pairs)))
    by_label = per.select("label", tidy([(m, c(m)) for m in (*names, "support")]))
    weighted = [F.sum(c(m) * c("support")) / F.sum("support") for m in names]
    whole = per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *[F.avg(m).alias(f"macro_{m}") for m in names], *[w.alias(f"weighted_{m}") for w, m in zip(weighted, names, strict=True)])
    return by_label.unionByName(whole.select(F.lit("all").alias("label"), tidy([(m, c(m)) for m in whole.columns])))


def upgrade_recipes(records: DataFrame, text: str = "value") -> DataFrame:
    """Recipe records of older and newer shapes, JSON objects in a text column, in one shape: the other columns, readable, title,
    ingredients, instructions, servings, yield, prep_time, cook_time and conf_title, conf_ingredients, conf_instructions, conf_overall.

    The texts are parsed once, as variants, and fields are taken by path, as records of several shapes have no schema in common.
    Newer names (prepTime, cookTime) go before older ones. A missing title is "", missing lists are empty, a missing confidence (or
    one that is no object) is 0.9 throughout; a confidence without one of its fields leaves that null. Numbers become texts. Texts
    that hold no JSON object, and null texts, have readable false and nothing else.
    """
    others = [x for x in records.columns if x != text]
    parsed = records.select(*others, F.try_parse_json(text).alias("_record"))
    v, got = F.col("_record"), lambda path, kind: F.try_variant_get("_record", path, kind)
    shape = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    readable, sure = shape(v), shape(got("$.confidence", "variant"))
    when = lambda x: F.when(readable, x)
    many = lambda k: when(F.coalesce(got(f"$.{k}", "array<string>"), F.array().cast("array<string>"))).alias(k)
    time = lambda new, old: when(F.coalesce(got(f"$.{new}", "string"), got(f"$.{old}", "string"))).alias(old)
    conf = lambda k: when(F.when(sure, got(f"$.confidence.{k}", "double")).otherwise(0.9)).alias(f"conf_{k}")
    return parsed.select(
        *others, readable.alias("readable"), when(F.coalesce(got("$.title", "string"), F.lit(""))).alias("title"), many("ingredients"), many("instructions"),
        *(when(got(f"$.{k}", "string")).alias(k) for k in ("servings", "yield")), time("prepTime", "prep_time"), time("cookTime", "cook_time"), *map(conf, ("title", "ingredients", "instructions", "overall")),
    )
