"""Recipe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import boxes
from pageloom.functions import text as T
from pageloom.operators import extraction, rules

from .labelling import LABELLED, _lines
from .queries import TOK, _pages, _words, query
from .titles import title_chain

XL = TOK + r""",
xs AS (SELECT *, (y0 + y1) / 2 AS mid_y, (x0 + x1) / 2 AS mid_x, CASE WHEN (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY page_num, label ORDER BY (y0 + y1) / 2, (x0 + x1) / 2, word_idx) > 10 THEN 1 ELSE 0 END AS s FROM tok WHERE label IN ('TITLE', 'INGREDIENT_LINE', 'INSTRUCTION_STEP')),
xn AS (SELECT *, sum(s) OVER (PARTITION BY page_num, label ORDER BY mid_y, mid_x, word_idx) AS line_id FROM xs),
xl AS (SELECT page_num, label, CASE label WHEN 'TITLE' THEN 'ttl' WHEN 'INGREDIENT_LINE' THEN 'ing' ELSE 'ins' END || '_' || lpad(CAST(CAST(line_id AS BIGINT) + 1 AS VARCHAR), 4, '0') AS line, line_id, regexp_replace(trim(regexp_replace(string_agg(word, ' ' ORDER BY x0, word_idx), '\s+', ' ', 'g')), '\s+([.,;:])', '\1', 'g') AS line_text,
  round(round(avg(conf), 6) / 100, 6) AS line_conf, count(*) AS n_words, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM xn GROUP BY page_num, label, line_id),
""" + title_chain("label = 'TITLE'") + r""",
rl AS (SELECT page_num, coalesce(list(line_text ORDER BY line_id) FILTER (label = 'INGREDIENT_LINE'), []) AS ingredients, coalesce(list(line_text ORDER BY line_id) FILTER (label = 'INSTRUCTION_STEP'), []) AS st,
  round(coalesce(avg(line_conf) FILTER (label = 'INGREDIENT_LINE'), 0), 9) AS conf_ingredients, round(coalesce(avg(line_conf) FILTER (label = 'INSTRUCTION_STEP'), 0), 9) AS conf_instructions FROM xl WHERE line_text <> '' GROUP BY page_num),
r0 AS (SELECT page_num, coalesce(title, '') AS title, xt.by AS title_by, coalesce(ingredients, []) AS ingredients, coalesce(st, []) AS st, coalesce(round(conf, 6), 0) AS conf_title, coalesce(conf_ingredients, 0) AS conf_ingredients, coalesce(conf_instructions, 0) AS conf_instructions
  FROM (SELECT DISTINCT page_num FROM tok) LEFT JOIN rl USING (page_num) LEFT JOIN xt USING (page_num)),
rc AS (SELECT * EXCLUDE (st), CASE WHEN len(st) > 1 AND len(list_filter(st, lambda x: NOT regexp_matches(x, '[.!]\s*$'))) / len(st) > 0.5 THEN [array_to_string(st, ' ')] ELSE st END AS instructions FROM r0),
rw AS (SELECT *, CASE WHEN title_by IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS wt, CASE WHEN len(ingredients) > 0 THEN 1.5::DOUBLE ELSE 0 END AS wi, CASE WHEN len(instructions) > 0 THEN 1.5::DOUBLE ELSE 0 END AS ws FROM rc),
ss AS (SELECT *, CASE WHEN trim(title) = '' THEN 'missing' WHEN conf_title < 0.85 THEN 'needs-review' ELSE 'high-confidence' END AS title_status, CASE WHEN len(ingredients) = 0 THEN 'missing' WHEN len(ingredients) < 3 OR conf_ingredients < 0.80 THEN 'needs-review' ELSE 'high-confidence' END AS ingredients_status,
  CASE WHEN len(instructions) = 0 THEN 'missing' WHEN len(instructions) < 2 OR conf_instructions < 0.80 THEN 'needs-review' ELSE 'high-confidence' END AS instructions_status FROM rw)
"""


def _recipes(spark, sf):
    return extraction.extract_recipe(_words(spark, sf))


@query(XL + "SELECT page_num, line, line_text, line_conf, n_words, bx0, by0, bx1, by1 FROM xl WHERE line_text <> ''")
def lines_for_label(spark, sf):
    return extraction.lines_for_label(_words(spark, sf)).drop("label", "line_id")


@query(XL + "SELECT page_num, title, title_by, array_to_string(ingredients, '|') AS ingredients, array_to_string(instructions, '|') AS instructions, conf_title, conf_ingredients, conf_instructions, round(coalesce((wt * conf_title + wi * conf_ingredients + ws * conf_instructions) / nullif(wt + wi + ws, 0), 0), 9) AS conf_overall FROM rw")
def extract_recipe(spark, sf):
    return _recipes(spark, sf).withColumns({"ingredients": F.array_join("ingredients", "|"), "instructions": F.array_join("instructions", "|")})


@query(XL + "SELECT page_num, title_status, ingredients_status, instructions_status, title_status = 'high-confidence' AND ingredients_status = 'high-confidence' AND instructions_status = 'high-confidence' AS ready FROM ss")
def section_status(spark, sf):
    return extraction.section_status(_recipes(spark, sf)).select("page_num", "title_status", "ingredients_status", "instructions_status", "ready")


@query(XL + "SELECT page_num, round((conf_title + conf_ingredients + conf_instructions) / 3, 9) AS mean_conf FROM rw")
def overall_confidence(spark, sf):
    return _recipes(spark, sf).select("page_num", F.round((F.col("conf_title") + F.col("conf_ingredients") + F.col("conf_instructions")) / 3, 9).alias("mean_conf"))


@query(XL + """, oc AS (SELECT doc_id AS page_num, CASE WHEN doc_id % 3 = 0 THEN conf_title END AS a, CASE WHEN doc_id % 3 < 2 THEN conf_ingredients END AS b FROM documents LEFT JOIN rw ON page_num = doc_id),
om AS (SELECT page_num, avg(conf / 100) AS m FROM tok WHERE page_num % 5 > 0 GROUP BY page_num)
SELECT page_num, round(coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), m, 0.85), 9) AS overall_confidence, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'fields' WHEN m IS NOT NULL THEN 'tokens' ELSE 'default' END AS confidence_from FROM oc LEFT JOIN om USING (page_num)""")
def overall_confidence_chain(spark, sf):
    """Fields without a confidence on some pages, words left out on others."""
    c = F.col
    pages = spark.read.parquet(f"{sf}/documents.parquet").select(c("doc_id").alias("page_num"))
    some = _recipes(spark, sf).select("page_num", F.when(c("page_num") % 3 == 0, c("conf_title")).alias("a"), F.when(c("page_num") % 3 < 2, c("conf_ingredients")).alias("b"))
    words = _words(spark, sf).where("page_num % 5 > 0").select("page_num", (c("conf") / 100).alias("conf"))
    return extraction.confidence_chain(pages.join(some, "page_num", "left"), ["a", "b"], words).select("page_num", "overall_confidence", "confidence_from")


@query(XL + """SELECT page_num, '# ' || coalesce(nullif(trim(title), ''), 'Recipe') || chr(10) || chr(10) || '## Ingredients' || chr(10) || CASE WHEN len(ingredients) > 0 THEN array_to_string(list_transform(ingredients, lambda x: '- ' || x), chr(10)) ELSE '- (not detected)' END
 || chr(10) || chr(10) || '## Instructions' || chr(10) || CASE WHEN len(instructions) > 0 THEN array_to_string(list_transform(instructions, lambda x, i: i || '. ' || x), chr(10)) ELSE '1. (not detected)' END AS markdown FROM rw""")
def recipe_to_markdown(spark, sf):
    return extraction.recipe_to_markdown(_recipes(spark, sf)).select("page_num", "markdown")


@query(XL + "SELECT book, count(*) AS recipes, round(avg((trim(title) <> '')::INT), 6) AS titled, round(avg(length(title)) FILTER (trim(title) <> ''), 6) AS title_length, round(avg(len(ingredients)), 6) AS ingredients, round(avg(len(instructions)), 6) AS instructions FROM rw JOIN page USING (page_num) GROUP BY book")
def recipe_quality(spark, sf):
    book = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num"), F.col("source").alias("book"))
    return extraction.recipe_quality(_recipes(spark, sf).join(book, "page_num"), "book")


@query(XL + """, q AS (SELECT page_num % 2 AS odd, count(*)::DOUBLE AS recipes, round(avg((trim(title) <> '')::INT), 6) AS titled, round(avg(length(title)) FILTER (trim(title) <> ''), 6) AS title_length, round(avg(len(ingredients)), 6) AS ingredients, round(avg(len(instructions)), 6) AS instructions FROM rw GROUP BY 1),
u AS (UNPIVOT q ON recipes, titled, title_length, ingredients, instructions INTO NAME metric VALUE v) SELECT a.metric, a.v AS before, b.v AS after, b.v - a.v AS change FROM u a JOIN u b ON a.metric = b.metric AND a.odd = 0 AND b.odd = 1""")
def recipe_quality_diff(spark, sf):
    """Even pages are the snapshot before, odd pages the one after."""
    r = _recipes(spark, sf).withColumn("snapshot", F.when(F.col("page_num") % 2 == 0, "before").otherwise("after"))
    return extraction.quality_difference(extraction.recipe_quality(r, "snapshot"), "snapshot", "before", "after")


_CORRECTED = XL + ", good AS (SELECT doc_id AS page_num, any_value(quality) AS q FROM labels WHERE quality = 1 GROUP BY doc_id), ap AS (SELECT coalesce(rw.page_num, good.page_num) AS page_num, CASE WHEN q IS NOT NULL AND rw.page_num IS NOT NULL THEN title || ' (checked)' ELSE title END AS new_title, CASE WHEN rw.page_num IS NULL THEN NULL WHEN q IS NOT NULL THEN 'title' ELSE '' END AS changes, q IS NOT NULL AND rw.page_num IS NOT NULL AS corrected FROM rw LEFT JOIN good ON rw.page_num = good.page_num)"


def _corrected(spark, sf):
    """Corrections of the pages labelled good: a mark behind their titles."""
    r = _recipes(spark, sf)
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("page_num"))
    fix = r.join(good, "page_num", "left_semi").select("page_num", F.concat("title", F.lit(" (checked)")).alias("title"), F.lit(None).cast("array<string>").alias("ingredients"), F.lit(None).cast("array<string>").alias("instructions"))
    return extraction.apply_corrections(r, fix)


@query(_CORRECTED + "SELECT page_num, new_title, changes, corrected FROM ap")
def apply_corrections(spark, sf):
    return _corrected(spark, sf).select("page_num", F.col("title").alias("new_title"), F.array_join("changes", ",").alias("changes"), "corrected")


@query(_CORRECTED + "SELECT count(*) AS pages, count(*) FILTER (corrected) AS corrected, count(*) FILTER (changes <> '') AS changed, round(count(*) FILTER (changes <> '') / count(*), 6) AS rate FROM ap")
def correction_stats(spark, sf):
    changed = F.count_if(F.size("changes") > 0)
    return _corrected(spark, sf).agg(F.count("*").alias("pages"), F.count_if("corrected").alias("corrected"), changed.alias("changed"), F.round(changed / F.count("*"), 6).alias("rate"))


_any = lambda t, ws: f"regexp_matches({t}, '{'|'.join(ws)}')"
_cat = lambda t: " ".join(f"WHEN {_any(t, ws)} THEN '{name}'" for name, ws in T.CATEGORIES.items())
_CATS = XL + f", tx AS (SELECT page_num, trim(lower(title)) AS a, trim(lower(title)) || ' ' || lower(array_to_string(ingredients, ' ')) AS b FROM rw), ca AS (SELECT *, CASE {_cat('a')} {_cat('b')} ELSE '{T.NO_CATEGORY}' END AS category FROM tx)"
_tag = ", ".join(f"CASE WHEN {_any('b', ws)}{' OR category = ' + chr(39) + 'Medicinal Cookery' + chr(39) if name == 'medicinal' else ''} THEN '{name}' END" for name, ws in T.TAGS.items())


@query(_CATS + "SELECT page_num, category FROM ca")
def categorize_recipe(spark, sf):
    return _recipes(spark, sf).select("page_num", T.category(F.col("title"), F.col("ingredients")).alias("category"))


@query(_CATS + f"SELECT page_num, concat_ws(',', '{T.FIRST_TAG}', {_tag}, CASE WHEN NOT {_any('b', T.MEAT)} AND category NOT IN ('Fish & Seafood', 'Meats & Poultry') THEN 'vegetarian' END) AS tags FROM ca")
def generate_tags(spark, sf):
    r = _recipes(spark, sf).withColumn("category", T.category(F.col("title"), F.col("ingredients")))
    return r.select("page_num", F.array_join(T.tags(F.col("title"), F.col("ingredients"), F.col("category")), ",").alias("tags"))


@query(_CATS + "SELECT category, count(*) AS recipes, min(page_num) AS first_page FROM ca GROUP BY category")
def categories_of_recipes(spark, sf):
    r = _recipes(spark, sf).withColumn("category", T.category(F.col("title"), F.col("ingredients")))
    return r.groupBy("category").agg(F.count("*").alias("recipes"), F.min("page_num").alias("first_page"))


@query(TOK + rf"SELECT page_num, nullif(regexp_extract(lower(text), '{T.MINUTES}', 1), '') || ' min' AS time_text, 'Serves ' || nullif(regexp_extract(lower(text), '{T.SERVES}', 1), '') AS servings FROM page")
def extract_time_and_servings(spark, sf):
    return _pages(spark, sf).select("page_num", T.time_text(F.col("text")).alias("time_text"), T.servings_text(F.col("text")).alias("servings"))


@query(TOK + r", m AS (SELECT page_num, coalesce(TRY_CAST(regexp_extract(lower(text), '(\d{1,6})\s*hr', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(lower(text), '(\d{1,6})\s*min', 1) AS BIGINT), 0) AS n FROM page) SELECT page_num, CASE WHEN n = 0 THEN 45 ELSE n END AS minutes FROM m")
def parse_time_to_minutes(spark, sf):
    return _pages(spark, sf).select("page_num", T.minutes(F.col("text")).alias("minutes"))


@query()
def ocr_postprocess_text(spark, sf):
    """Word boundaries differ between SQL engines beside accents; tests/test_text.py holds the rewrites."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num"), T.rewrite_misread_text(F.col("text")).alias("rewritten"))


@query()
def ocr_postprocess_word(spark, sf):
    """Word by word, without the collapse of white space; see ocr_postprocess_text."""
    return _words(spark, sf).select("page_num", "word_idx", T.rewrite_misread(F.col("word")).alias("rewritten"))


@query(LABELLED + ", g AS (SELECT page_num, line_id, min(x0) AS a0, min(y0) AS a1, max(x1) AS a2, max(y1) AS a3 FROM ln GROUP BY ALL) SELECT page_num, line_id, line_label, round(line_conf, 4) AS line_score, round(a0 / 1000 * 100, 4) AS x, round(a1 / height * 100, 4) AS y, round((a2 - a0) / 1000 * 100, 4) AS width, round((a3 - a1) / height * 100, 4) AS box_height FROM ll JOIN g USING (page_num, line_id)")
def export_annotation_tasks(spark, sf):
    x, y, w, h = boxes.percent(tuple(F.col(c) for c in ("bx0", "by0", "bx1", "by1")), F.lit(1000), F.col("height"))
    found = rules.label_lines(_lines(spark, sf))
    return found.select("page_num", "line_id", "line_label", F.round("line_conf", 4).alias("line_score"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(w, 4).alias("width"), F.round(h, 4).alias("box_height"))
