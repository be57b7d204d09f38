"""Labels by rule, and sections and recipes from lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import boxes
from pageloom.operators import lines, relabel, sections
from pageloom.operators import labels as label_operators

from .queries import LINES, TOK, _fold, _words, query

_VOCAB = "vocab AS (SELECT replace(upper(word), 'ẞ', 'SS') AS hw FROM tok JOIN page USING (page_num) WHERE (y0 + y1) / 2 < height * 0.15 GROUP BY 1 HAVING count(*) >= 5)"


@query(TOK + f""", {_VOCAB},
tt AS (SELECT tok.*, height, replace(upper(word), 'ẞ', 'SS') AS up, (y0 + y1) / 2 / height AS ys FROM tok JOIN page USING (page_num) WHERE label = 'INSTRUCTION_STEP'),
ing AS (SELECT page_num, min(y0) AS a, list(DISTINCT y0) AS tops FROM tok WHERE label = 'INGREDIENT_LINE' GROUP BY page_num),
mixed AS (SELECT page_num, list(DISTINCT y0 + y1) AS mids FROM tok WHERE replace(upper(word), 'ẞ', 'SS') <> word AND length(word) > 1 GROUP BY page_num),
f AS (SELECT tt.*, up IN (SELECT hw FROM vocab) AS common, len(list_filter(coalesce(tops, []), lambda t: t - y1 > 0 AND t - y1 < 150)) > 0 AS near, len(list_filter(coalesce(mids, []), lambda m: abs(m - y0 - y1) < 40)) = 0 AS alone FROM tt LEFT JOIN ing USING (page_num) LEFT JOIN mixed USING (page_num))
SELECT page_num, word_idx, CASE WHEN ys < 0.10 OR common OR regexp_matches(up, '{'|'.join(relabel.HEADER_PHRASES)}') OR regexp_matches(word, '^\\d+$') THEN 'PAGE_HEADER'
 WHEN ys > 0.10 AND ys < 0.25 AND up = word AND length(word) > 3 AND (regexp_matches(up, '{'|'.join(relabel.SECTION_WORDS)}') OR alone) THEN 'SECTION_HEADER'
 WHEN ys > 0.15 AND ys < 0.5 AND near THEN 'RECIPE_TITLE' WHEN regexp_matches(word, '\\p{{Ll}}') OR ys >= 0.4 THEN 'RECIPE_TITLE' ELSE 'SECTION_HEADER' END AS label_v3 FROM f""")
def relabel_titles_v3(spark, sf):
    """Steps stand for titles, as the tables have titles in the first line alone."""
    w = _words(spark, sf)
    out = relabel.relabel_titles_v3(w, label_operators.header_vocabulary(w), "INSTRUCTION_STEP")
    return out.where("label = 'INSTRUCTION_STEP'").select("page_num", "word_idx", "label_v3")


_MOCK = f"""mk AS (SELECT tok.*, CASE WHEN (y0 + y1) / 2 > 50 AND (y0 + y1) / 2 < 250 AND regexp_matches(word, '^\\p{{Lu}}') AND length(word) > 3 AND regexp_matches(word, '\\p{{Ll}}') THEN 1
  WHEN regexp_matches(word, '\\p{{Nd}}') OR lower(word) IN {tuple(relabel.MOCK_INGREDIENTS)} THEN 2 WHEN lower(word) IN {tuple(relabel.MOCK_VERBS)} THEN 3 ELSE 4 END AS k FROM tok)"""


@query(TOK + f", {_MOCK} SELECT page_num, word_idx, ['TITLE', 'INGREDIENT_LINE', 'INSTRUCTION_STEP', 'O'][k] AS label_mock, [0.92::DOUBLE, 0.88::DOUBLE, 0.86::DOUBLE, 0.85::DOUBLE][k] AS conf_mock FROM mk")
def mock_labels(spark, sf):
    return relabel.mock_labels(_words(spark, sf)).select("page_num", "word_idx", "label_mock", "conf_mock")


@query(TOK + "SELECT CASE label WHEN 'TIME' THEN 'O' ELSE label END AS label, count(*) AS n FROM tok GROUP BY 1")
def collapse_labels(spark, sf):
    """TIME stands for NOTE, which the tables lack."""
    return relabel.collapse_labels(_words(spark, sf), gone="TIME").groupBy("label").agg(F.count("*").alias("n"))


_MANUAL = "man AS (SELECT doc_id AS page_num, CAST(quality AS INT) AS word_idx, CASE WHEN toxic = 1 THEN 'NOTE' ELSE 'TITLE' END AS label FROM labels)"


@query(TOK + f", {_MANUAL} SELECT tok.page_num, tok.word_idx, coalesce(man.label, tok.label) AS label, CASE WHEN man.label IS NULL THEN 'suggested' ELSE 'manual' END AS by FROM tok LEFT JOIN man USING (page_num, word_idx) WHERE tok.word_idx < 3")
def override_labels(spark, sf):
    """Labelled documents stand for pages that someone has labelled: one word each, twice, of which the later row counts."""
    c = F.col
    known = spark.read.parquet(f"{sf}/labels.parquet").select(c("doc_id").alias("page_num"), c("quality").cast("int").alias("word_idx"), F.when(c("toxic") == 1, "NOTE").otherwise("TITLE").alias("label"))
    manual = known.withColumn("at", F.lit(2)).unionByName(known.withColumns({"label": F.lit("O"), "at": F.lit(1)}))
    return relabel.override_labels(_words(spark, sf).select("page_num", "word_idx", "label"), manual).where("word_idx < 3")


@query("SELECT CAST(event_type_rank AS INT) AS label_id, event_type AS label FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS event_type_rank FROM (SELECT DISTINCT event_type FROM events))")
def resolve_label_map(spark, sf):
    """The declared map is empty, so the next source, read from the events, gives the names."""
    from pyspark.sql import Window

    declared = spark.createDataFrame([], "label_id int, label string")
    types = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("label")).distinct()
    model = types.withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)  # a row for each label
    return relabel.resolve_label_map(declared, model)


_ITEMS = "it AS (SELECT l_orderkey * 8 + l_linenumber AS item, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem)"


def _items(spark, sf):
    c = F.col
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.select((c("l_orderkey") * 8 + c("l_linenumber")).alias("item"), (c("l_partkey") % 100).alias("x"), (c("l_suppkey") % 100).alias("y"))


@query(TOK + "SELECT page_num, word_idx, x0 - 4 AS px0, y0 - 4 AS py0, x1 + 4 AS px1, y1 + 4 AS py1 FROM tok")
def pad_bbox(spark, sf):
    out = boxes.padded(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), 4)
    return _words(spark, sf).select("page_num", "word_idx", *[x.alias(n) for x, n in zip(out, ("px0", "py0", "px1", "py1"), strict=True)])


@query(f"WITH {_ITEMS} SELECT item, x / 100 * 750 AS bx0, y / 100 * 1200 AS by0, x / 100 * 750 + 187.5::DOUBLE AS bx1, y / 100 * 1200 + 150::DOUBLE AS by1 FROM it")
def rect_to_bbox(spark, sf):
    """Rectangles of 25 by 12.5 percent, placed by the line items."""
    out = boxes.from_percent((F.col("x"), F.col("y"), F.lit(25), F.lit(12.5)), F.lit(750), F.lit(1200))
    return _items(spark, sf).select("item", *[x.alias(n) for x, n in zip(out, ("bx0", "by0", "bx1", "by1"), strict=True)])


# --- sections and recipes -----------------------------------------------------------------------------------------------

_REL = _fold("y0, x0, word_idx", "mid_y", "0.015::DOUBLE * max(height)", ("b.mark", "a.mark"))
_KIND = _REL.replace("SELECT page_num, unnest(ws) AS word_idx, unnest(ls) AS line_id FROM f", "") + """, li AS (SELECT tok.*, line_id FROM tok JOIN (SELECT page_num, unnest(ws) AS word_idx, unnest(ls) AS line_id FROM f) USING (page_num, word_idx)),
ct AS (SELECT page_num, line_id, label, count(*) AS n, min({'a': y0, 'b': x0, 'c': word_idx}) AS first FROM li GROUP BY ALL),
kd AS (SELECT page_num, line_id, CASE label WHEN 'TITLE' THEN 'TITLE_LINE' WHEN 'INGREDIENT_LINE' THEN label WHEN 'INSTRUCTION_STEP' THEN label ELSE 'OTHER' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY page_num, line_id ORDER BY n DESC, first) AS r FROM ct) WHERE r = 1),
kl AS (SELECT page_num, line_id, kind, string_agg(word, ' ' ORDER BY y0, x0, word_idx) AS line_text, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1, avg(conf) / 100 AS line_conf, (min(x0) + max(x1)) / 2 AS mx FROM li JOIN kd USING (page_num, line_id) GROUP BY ALL),
sc AS (SELECT *, CASE kind WHEN 'TITLE_LINE' THEN 'title' WHEN 'INGREDIENT_LINE' THEN 'ingredients' ELSE 'instructions' END AS section, max(mx) OVER w - min(mx) OVER w AS spread, (max(mx) OVER w + min(mx) OVER w) / 2 AS half, count(*) OVER w AS k FROM kl WHERE kind <> 'OTHER' WINDOW w AS (PARTITION BY page_num, kind)),
sec AS (SELECT page_num, section, CASE WHEN section = 'ingredients' AND spread > 0.4::DOUBLE * 1000 AND k >= 4 AND mx >= half THEN 1 ELSE 0 END AS "column", min(bx0) AS sx0, min(by0) AS sy0, max(bx1) AS sx1, max(by1) AS sy1, avg(line_conf) AS section_conf, list_sort(list(line_id)) AS line_ids FROM sc GROUP BY page_num, section, 3)
"""


def _kinds(spark, sf, tokens=False):
    w = _words(spark, sf).withColumn("width", F.lit(1000))
    keep = ("word", "label", "conf", "width", "x0", "y0", "x1", "y1") + (("height",) if tokens else ())
    return sections.kinds_of_lines(lines.group_lines(w, "anchor_relative", keep=keep), tokens=tokens)


@query(_KIND + "SELECT page_num, line_id, kind, line_text, bx0, by0, bx1, by1, line_conf FROM kl")
def kinds_of_lines(spark, sf):
    return _kinds(spark, sf).select("page_num", "line_id", "kind", "line_text", "bx0", "by0", "bx1", "by1", "line_conf")


@query(_KIND + """SELECT page_num, section, "column", sx0, sy0, sx1, sy1, section_conf, array_to_string(line_ids, ',') AS line_ids FROM sec""")
def build_sections(spark, sf):
    return sections.build_sections(_kinds(spark, sf)).withColumn("line_ids", F.array_join(F.transform("line_ids", lambda x: x.cast("string")), ","))


@query(_KIND + """, p AS (SELECT page_num, coalesce(string_agg(line_text, ' ' ORDER BY line_id) FILTER (kind = 'TITLE_LINE'), 'Unknown Recipe') AS title, coalesce(string_agg(line_text, '|' ORDER BY by0, line_id) FILTER (kind = 'INGREDIENT_LINE'), '') AS ingredients, coalesce(string_agg(line_text, '|' ORDER BY by0, line_id) FILTER (kind = 'INSTRUCTION_STEP'), '') AS instructions FROM kl GROUP BY page_num),
q AS (SELECT page_num, avg(section_conf) FILTER (section = 'title') AS a, avg(section_conf) FILTER (section = 'ingredients') AS b, avg(section_conf) FILTER (section = 'instructions') AS c FROM sec GROUP BY page_num),
z AS (SELECT p.*, coalesce(a, 0.9::DOUBLE) AS conf_title, coalesce(b, 0.9::DOUBLE) AS conf_ingredients, coalesce(c, 0.9::DOUBLE) AS conf_instructions FROM p LEFT JOIN q USING (page_num)) SELECT *, (conf_title + conf_ingredients + conf_instructions) / 3 AS conf_overall FROM z""")
def extract_recipe_simple(spark, sf):
    out = sections.extract_recipe_simple(_kinds(spark, sf))
    return out.withColumns({c: F.array_join(c, "|") for c in ("ingredients", "instructions")})


@query(_KIND + """, n AS (SELECT page_num, count(*) AS n_lines, count(*) FILTER (kind = 'TITLE_LINE') AS n_titles FROM kl GROUP BY page_num), s AS (SELECT page_num, count(*) AS n_sections FROM sec GROUP BY page_num), t AS (SELECT page_num, count(*) AS n_tokens FROM tok GROUP BY page_num)
SELECT page_num, n_tokens, n_lines, coalesce(n_sections, 0) AS n_sections, n_titles = 0 AS unknown FROM t JOIN n USING (page_num) LEFT JOIN s USING (page_num)""")
def sectioned_page(spark, sf):
    page = sections.sectioned_page(_kinds(spark, sf, tokens=True))
    return page.select("page_num", F.size("tokens").alias("n_tokens"), F.size("lines").alias("n_lines"), F.coalesce(F.size("sections"), F.lit(0)).alias("n_sections"), (F.col("recipe.title") == sections.NO_TITLE).alias("unknown"))


@query(TOK + r""", tk AS (SELECT *, CASE WHEN word_idx % 83 = 40 THEN 'TITLE' ELSE label END AS lab, regexp_replace(regexp_replace(trim(lower(word)), '[.,;:!?]', '', 'g'), '\s+', ' ', 'g') AS k FROM tok),
pk AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.page_num ORDER BY NOT (contains(k, want) OR contains(want, k)), word_idx) AS r FROM tk t JOIN (SELECT page_num, k AS want FROM tk WHERE word_idx = 40) USING (page_num) WHERE lab = 'TITLE') WHERE r = 1),
nx AS (SELECT t.page_num, min(t.y0) AS ny FROM tk t JOIN pk USING (page_num) WHERE t.lab = 'TITLE' AND t.y0 > pk.y1 GROUP BY t.page_num),
mn AS (SELECT t.*, CASE t.lab WHEN 'INGREDIENT_LINE' THEN 'ingredients' ELSE 'instructions' END AS section, (t.x0 + t.x1) / 2 AS mx FROM tk t JOIN pk p USING (page_num) LEFT JOIN nx USING (page_num) WHERE t.lab IN ('INGREDIENT_LINE', 'INSTRUCTION_STEP') AND t.y0 > p.y1 AND (ny IS NULL OR t.y0 < ny)),
cl AS (SELECT *, CASE WHEN section = 'ingredients' AND max(mx) OVER w - min(mx) OVER w > 250 AND count(*) OVER w >= 4 AND mx >= (max(mx) OVER w + min(mx) OVER w) / 2 THEN 1 ELSE 0 END AS col FROM mn WINDOW w AS (PARTITION BY page_num, section)),
al AS (SELECT page_num, section, col, x0, y0, x1, y1, conf FROM cl UNION ALL SELECT page_num, 'title', 0, x0, y0, x1, y1, conf FROM pk)
SELECT page_num, section, col AS "column", min(x0) - 8 AS sx0, min(y0) - 8 AS sy0, max(x1) + 8 AS sx1, max(y1) + 8 AS sy1, avg(conf) / 100 AS section_conf, count(*) AS n_tokens FROM al GROUP BY ALL""")
def build_section_overlays(spark, sf):
    """Every 83rd word is a title too, and each page wants the title at its word 40."""
    c = F.col
    w = _words(spark, sf).withColumn("label", F.when(c("word_idx") % 83 == 40, "TITLE").otherwise(c("label")))
    return sections.build_section_overlays(w, w.where("word_idx = 40").select("page_num", c("word").alias("wanted")))


@query(LINES + r""", lb AS (SELECT *, CASE label WHEN 'TIME' THEN 'META' ELSE label END AS lab FROM ln),
g AS (SELECT page_num, line_id, trim(string_agg(word, ' ' ORDER BY x0, word_idx)) AS t, sum(conf) AS total, count(*) AS n, bool_or(lab = 'TITLE') AS ti, bool_or(lab = 'INGREDIENT_LINE') AS i, bool_or(lab = 'INSTRUCTION_STEP') AS ins, bool_or(lab = 'META') AS m FROM lb GROUP BY ALL),
tt AS (SELECT page_num, sum(conf) / count(*) / 100 AS ct FROM lb WHERE lab = 'TITLE' GROUP BY page_num),
p AS (SELECT page_num, coalesce(arg_min(t, line_id) FILTER (ti), '') AS title, coalesce(string_agg(t, '|' ORDER BY line_id) FILTER (i), '') AS ingredients, coalesce(string_agg(t, '|' ORDER BY line_id) FILTER (ins), '') AS instructions, lower(coalesce(string_agg(t, ' ' ORDER BY line_id) FILTER (m), '')) AS meta,
  coalesce(sum(total) FILTER (i) / sum(n) FILTER (i) / 100, 0) AS conf_ingredients, coalesce(sum(total) FILTER (ins) / sum(n) FILTER (ins) / 100, 0) AS conf_instructions, coalesce(sum(total) FILTER (m) / sum(n) FILTER (m) / 100, 0) AS conf_meta FROM g GROUP BY page_num)
SELECT page_num, CASE title WHEN '' THEN 'Untitled Recipe' ELSE title END AS title, ingredients, instructions, coalesce(ct, 0) AS conf_title, conf_ingredients, conf_instructions, conf_meta,
 coalesce(TRY_CAST(nullif(regexp_extract(meta, '(\d{1,3})\s*(?:minutes|min|hrs|hours)', 1), '') AS INT), 45) AS total_minutes, 'Serves ' || coalesce(nullif(regexp_extract(meta, 'serves?\s*(\d+(?:-\d+)?)', 1), ''), '2-4') AS servings FROM p LEFT JOIN tt USING (page_num)""")
def extract_recipe_legacy(spark, sf):
    """TIME words stand for meta words."""
    c = F.col
    w = _words(spark, sf).withColumn("label", F.when(c("label") == "TIME", "META").otherwise(c("label")))
    out = sections.extract_recipe_legacy(lines.lines_gap(w))
    return out.withColumns({x: F.array_join(x, "|") for x in ("ingredients", "instructions")})
