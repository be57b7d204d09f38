"""Sections of a page from labelled lines or tokens, and recipes from them in the shapes that demos and older tools use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

# Kinds of lines by label, texts and numbers of the simple and older recipes.
KINDS = {
    "RECIPE_TITLE": "TITLE_LINE", "TITLE": "TITLE_LINE", "PAGE_HEADER": "PAGE_HEADER", "SECTION_HEADER": "SECTION_HEADER",
    "INGREDIENT_LINE": "INGREDIENT_LINE", "INSTRUCTION_STEP": "INSTRUCTION_STEP",
}
NO_TITLE, UNTITLED, SERVINGS, MINUTES = "Unknown Recipe", "Untitled Recipe", "Serves 2-4", 45
NO_RECIPE = "No recipe detected on this page (front matter)."
SECTION_OF = {"TITLE_LINE": "title", "INGREDIENT_LINE": "ingredients", "INSTRUCTION_STEP": "instructions"}


def _lookup(table: dict[str, str], key: str) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(key)]


def kinds_of_lines(lines: DataFrame, order: tuple[str, ...] = ("y0", "x0", "word_idx"), tokens: bool = False) -> DataFrame:
    """One row for each line of words with line_id: kind (of its most frequent label; the one seen first wins ties), text in
    order, box, mean confidence (0..1) and the ids of its words; with tokens the words themselves too, and the page's height."""
    c = F.col
    more = [F.array("x0", "y0", "x1", "y1").alias("bbox"), "label", (c("conf") / 100).alias("conf")] if tokens else ["label"]
    token = F.struct(c("word_idx").alias("id"), c("word").alias("text"), *more).alias("token")
    row = F.struct(*[c(o).alias(f"o{k}") for k, o in enumerate(order)], token).alias("row")
    page = ["width", "height"] if tokens else ["width"]
    rows = lines.select("page_num", "line_id", *page, "x0", "y0", "x1", "y1", "conf", row)  # made before they are collected
    out = rows.groupBy("page_num", "line_id").agg(
        *[F.first(x).alias(x) for x in page], F.sort_array(F.collect_list("row")).alias("w"), F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"),
        F.max("y1").alias("by1"), (F.avg("conf") / 100).alias("line_conf"),
    )
    out = out.withColumn("tokens", c("w.token")).drop("w")
    seen = F.array_distinct("tokens.label")  # in order, so that the one seen first wins ties
    counted = F.transform(seen, lambda l, i: F.struct((-F.size(F.filter("tokens.label", lambda x: x.eqNullSafe(l)))).alias("n"), i.alias("first"), l.alias("label")))
    out = out.withColumn("label", F.array_min(counted)["label"])
    out = out.withColumns({"kind": F.coalesce(_lookup(KINDS, "label"), F.lit("OTHER")), "line_text": F.array_join("tokens.text", " "), "token_ids": c("tokens.id")})
    return out if tokens else out.drop("tokens")


def _sections(lines: Column, width: Column, spread: float, least: int) -> Column:
    """The sections of a page's lines (an array), by name and column."""
    found = []
    for kind, name in sorted(SECTION_OF.items(), key=lambda x: x[1]):
        part = F.filter(lines, lambda x: x["kind"] == kind)  # noqa: B023
        mid = lambda x: (x["bx0"] + x["bx1"]) / 2
        low, high = F.array_min(F.transform(part, mid)), F.array_max(F.transform(part, mid))
        two = (high - low > width * spread) & (F.size(part) >= least) if name == "ingredients" else F.lit(False)
        right = lambda x: two & (mid(x) >= (low + high) / 2)  # noqa: B023, E731
        for column, of in enumerate([F.filter(part, lambda x: ~right(x)), F.filter(part, right)] if name == "ingredients" else [part]):  # noqa: B023
            edge = lambda f, k: f(F.transform(of, lambda x: x[k])).alias(f"s{k[1:]}")  # noqa: B023, E731
            conf = F.aggregate(of, F.lit(0.0), lambda a, x: a + x["line_conf"]) / F.size(of)
            box = [edge(F.array_min, "bx0"), edge(F.array_min, "by0"), edge(F.array_max, "bx1"), edge(F.array_max, "by1")]
            row = F.struct(F.lit(name).alias("section"), F.lit(column).alias("column"), *box, conf.alias("section_conf"), F.transform(of, lambda x: x["line_id"]).alias("line_ids"))
            found.append(F.when(F.size(of) > 0, row))
    return F.array_compact(F.array(*found))


def page_lines(lines: DataFrame, spread: float = 0.4, least: int = 4, tokens: bool = False) -> DataFrame:
    """One row for each page of kinds_of_lines: width, lines (by line_id) and sections as arrays, so that all that is made of a
    page's lines is made of one pass; with tokens its height too, and its lines with their tokens."""
    line = F.struct("line_id", "kind", "bx0", "by0", "bx1", "by1", "token_ids", "line_conf", "line_text", *(["tokens"] if tokens else []))
    page = ["width", "height"] if tokens else ["width"]
    rows = lines.select("page_num", *page, line.alias("line"))
    pages = rows.groupBy("page_num").agg(*[F.first(x).alias(x) for x in page], F.sort_array(F.collect_list("line")).alias("lines"))
    return pages.withColumn("sections", _sections(F.col("lines"), F.col("width"), spread, least))


def build_sections(lines: DataFrame, spread: float = 0.4, least: int = 4) -> DataFrame:
    """(page_num, section, column, box, conf, line_ids): the title, the ingredients and the instructions of a page of
    kinds_of_lines. Ingredient lines whose centres spread over more than `spread` of the width are two columns (0 and 1), if
    there are `least` or more, cut in the middle of the spread. conf is the mean of the lines'."""
    return page_lines(lines, spread, least).select("page_num", F.inline("sections"))


def build_section_overlays(words: DataFrame, titles: DataFrame, padding: int = 8, spread: float = 250) -> DataFrame:
    """(page_num, section, column, box, conf, n_tokens): boxes around the recipe that titles (page_num, wanted) names.

    The title is the first title token that holds the wanted text or is held by it (both as T.title_key), else the first title
    token. The recipe's tokens begin below its foot and above the next title below. Ingredient centres that spread over more than
    `spread` pixels, of four tokens or more, are two columns. All boxes are padded. A page without a title token has no row.
    """
    c = F.col
    key = lambda x: T.title_key(x)
    heads = words.where("label = 'TITLE'").join(titles.select("page_num", key(c("wanted")).alias("want")), "page_num")
    fits = key(c("word")).contains(c("want")) | c("want").contains(key(c("word")))
    pick = heads.groupBy("page_num").agg(F.min_by(F.struct("word_idx", "x0", "y0", "x1", "y1", "conf"), F.struct((~fits).alias("other"), "word_idx")).alias("t"))
    below = words.where("label = 'TITLE'").join(pick, "page_num").where(c("y0") > c("t.y1")).groupBy("page_num").agg(F.min("y0").alias("next_y"))
    parts = words.where("label IN ('INGREDIENT_LINE', 'INSTRUCTION_STEP')").join(pick, "page_num").join(below, "page_num", "left")
    mine = parts.where((c("y0") > c("t.y1")) & F.coalesce(c("y0") < c("next_y"), F.lit(True))).drop("t")
    named = mine.withColumns({"section": F.when(c("label") == "INGREDIENT_LINE", "ingredients").otherwise("instructions"), "mid_x": (c("x0") + c("x1")) / 2})
    w = Window.partitionBy("page_num", "section")
    low, high = F.min("mid_x").over(w), F.max("mid_x").over(w)
    two = (c("section") == "ingredients") & (high - low > spread) & (F.count("*").over(w) >= 4)
    placed = named.withColumn("column", F.when(two & (c("mid_x") >= (low + high) / 2), 1).otherwise(0))
    whole = pick.select("page_num", F.lit("title").alias("section"), F.lit(0).alias("column"), *[c(f"t.{x}").alias(x) for x in ("x0", "y0", "x1", "y1", "conf")])
    every = placed.select(*whole.columns).unionByName(whole)
    return every.groupBy("page_num", "section", "column").agg(
        (F.min("x0") - padding).alias("sx0"), (F.min("y0") - padding).alias("sy0"), (F.max("x1") + padding).alias("sx1"), (F.max("y1") + padding).alias("sy1"),
        (F.avg("conf") / 100).alias("section_conf"), F.count("*").alias("n_tokens"),
    )


def _recipe(lines: Column, sections: Column, missing: float) -> Column:
    """The simple recipe of a page's lines and sections (arrays of page_lines)."""
    of = lambda kind: F.filter(lines, lambda x: x["kind"] == kind)
    texts = lambda x: F.transform(x, lambda r: r["line_text"])
    down = lambda kind: texts(F.sort_array(F.transform(of(kind), lambda x: F.struct(x["by0"].alias("by0"), x["line_id"].alias("line_id"), x["line_text"].alias("line_text")))))
    head = of("TITLE_LINE")
    title = F.when(F.size(head) > 0, F.array_join(texts(head), " ")).otherwise(NO_TITLE)

    def conf(name: str) -> Column:
        part = F.filter(sections, lambda x: x["section"] == name)
        return F.coalesce(F.aggregate(part, F.lit(0.0), lambda a, x: a + x["section_conf"]) / F.nullif(F.size(part), F.lit(0)), F.lit(missing))

    each = [conf(s) for s in ("title", "ingredients", "instructions")]
    named = [x.alias(f"conf_{s}") for x, s in zip(each, ("title", "ingredients", "instructions"), strict=True)]
    return F.struct(title.alias("title"), down("INGREDIENT_LINE").alias("ingredients"), down("INSTRUCTION_STEP").alias("instructions"), *named, ((each[0] + each[1] + each[2]) / 3).alias("conf_overall"))


def extract_recipe_simple(lines: DataFrame, missing: float = 0.9) -> DataFrame:
    """One recipe for each page of kinds_of_lines: title lines joined, ingredients and instructions from top to bottom, and the
    confidences of build_sections (`missing` where there is no section; overall their mean)."""
    return page_lines(lines).select("page_num", _recipe(F.col("lines"), F.col("sections"), missing).alias("r")).select("page_num", "r.*")


def extract_recipe_legacy(lines: DataFrame, meta: str = "META") -> DataFrame:
    """One recipe for each page of words with line_id: a line counts for every label that one of its words has. The title is the
    first title line; time and servings are read from the words of meta lines, with defaults; confidences are means over the
    words of the lines (of the title: over its words), 0 where there are none."""
    c = F.col
    has = lambda x: F.max((c("label") == x).cast("int"))
    words = F.sort_array(F.collect_list(F.struct("x0", "word_idx", "word")))
    rows = lines.groupBy("page_num", "line_id").agg(
        F.trim(F.array_join(F.transform(words, lambda w: w["word"]), " ")).alias("line_text"), F.sum("conf").alias("total"), F.count("*").alias("n"), has("TITLE").alias("t"),
        has("INGREDIENT_LINE").alias("i"), has("INSTRUCTION_STEP").alias("s"), has(meta).alias("m"), F.sum(F.when(c("label") == "TITLE", c("conf"))).alias("t_total"), F.count_if(c("label") == "TITLE").alias("t_n"),
    )
    texts = lambda k: F.transform(F.sort_array(F.collect_list(F.when(c(k) == 1, F.struct("line_id", "line_text")))), lambda r: r["line_text"])
    mean = lambda k: F.coalesce(F.sum(F.when(c(k) == 1, c("total"))) / F.nullif(F.sum(F.when(c(k) == 1, c("n"))), F.lit(0)) / 100, F.lit(0.0))
    pages = rows.groupBy("page_num").agg(
        F.coalesce(F.try_element_at(texts("t"), F.lit(1)), F.lit("")).alias("title"), texts("i").alias("ingredients"), texts("s").alias("instructions"), F.array_join(texts("m"), " ").alias("meta"),
        F.coalesce(F.sum("t_total") / F.nullif(F.sum("t_n"), F.lit(0)) / 100, F.lit(0.0)).alias("conf_title"), mean("i").alias("conf_ingredients"), mean("s").alias("conf_instructions"), mean("m").alias("conf_meta"),
    )
    total = F.coalesce(F.regexp_extract(T.time_text(c("meta")), r"(\d+)", 1).try_cast("int"), F.lit(MINUTES))
    named = {"title": F.when(c("title") == "", UNTITLED).otherwise(c("title")), "total_minutes": total, "servings": F.coalesce(T.servings_text(c("meta")), F.lit(SERVINGS))}
    return pages.withColumns(named).drop("meta")


def non_recipe_stub(pages: DataFrame, recipes: DataFrame) -> DataFrame:
    """A row for each page (page_num, is_recipe): its recipe, or where it is no recipe page an empty one with a message."""
    c = F.col
    none = F.array().cast("array<string>")
    both = pages.select("page_num", "is_recipe").join(recipes, "page_num", "left")
    pick = lambda name, empty: F.when(c("is_recipe"), F.coalesce(c(name), empty)).otherwise(empty).alias(name)
    conf = [pick(f"conf_{s}", F.lit(0.0)) for s in ("title", "ingredients", "instructions", "overall")]
    return both.select("page_num", "is_recipe", pick("title", F.lit("")), pick("ingredients", none), pick("instructions", none), *conf, F.when(~c("is_recipe"), NO_RECIPE).alias("message"))


def sectioned_page(lines: DataFrame, schema_version: str = "demo_pred_v1", missing: float = 0.9) -> DataFrame:
    """One nested record for each page of kinds_of_lines with tokens: size, tokens, lines, sections and the simple recipe."""
    c = F.col
    box = lambda x, p: F.array(*(x[f"{p}{k}"] for k in ("x0", "y0", "x1", "y1"))).alias("bbox")
    line = lambda x: F.struct(x["line_id"].alias("id"), x["kind"].alias("kind"), box(x, "b"), x["token_ids"].alias("token_ids"), x["line_conf"].alias("conf"), x["line_text"].alias("text"))
    section = lambda x: F.struct(x["section"].alias("section"), x["column"].alias("column"), box(x, "s"), x["line_ids"].alias("line_ids"), x["section_conf"].alias("conf"))
    none = F.size("sections") == 0
    return page_lines(lines, tokens=True).select(
        "page_num", F.lit(schema_version).alias("schema_version"), F.struct("width", "height", F.lit("px").alias("coord_space")).alias("page"),
        F.sort_array(F.flatten("lines.tokens")).alias("tokens"), F.transform("lines", line).alias("lines"), F.when(~none, F.transform("sections", section)).alias("sections"),
        _recipe(c("lines"), c("sections"), missing).alias("recipe"),
    )
