"""Selection, split, source and check queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.operators import labels, lines, selection, structure

from .queries import _IN, STATS, STRUCT, TOK, _pages, _words, query


def _metrics(spark, sf):
    return structure.structural_metrics(lines.lines_gap(_words(spark, sf)))


def _stats(spark, sf):
    return labels.page_label_stats(_words(spark, sf))


LIKE = f"(NOT regexp_matches(lower(text), '{selection.NEGATIVE}') AND (regexp_matches(lower(text), '{selection.FRACTION}') OR regexp_matches(lower(text), '{selection.UNIT}')) AND regexp_matches(lower(text), '{selection.VERB}'))"


@query(f"SELECT doc_id AS page_num, {LIKE.replace('text', chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS recipe_like FROM documents")
def is_recipe_like(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num"), selection.recipe_like(F.col("text")).alias("recipe_like"))


@query(STATS + "SELECT page_num, title > 0 OR (ingredient >= 1 AND instruction >= 1) AS recipe_page FROM stats")
def is_recipe_page_simple(spark, sf):
    return _stats(spark, sf).select("page_num", ((F.col("title") > 0) | ((F.col("ingredient") >= 1) & (F.col("instruction") >= 1))).alias("recipe_page"))


SCORED = TOK + f""", sp0 AS (SELECT page_num, count(*) AS n, count(*) FILTER (label_pred <> 'O') AS k, count(*) FILTER (label_pred = 'INGREDIENT_LINE') AS ing, count(*) FILTER (label_pred = 'INSTRUCTION_STEP') AS ins, count(*) FILTER (label_pred = 'TITLE') AS ti,
  avg(conf / 100) FILTER (label_pred <> 'O') AS mean, arg_max(word, conf * 100000 - word_idx) FILTER (label_pred = 'TITLE') AS bt FROM tok GROUP BY page_num),
sp1 AS (SELECT sp0.*, text, ti > 50 OR ing < 5 OR ins < 10 AS rej FROM sp0 JOIN page USING (page_num)),
sp AS (SELECT *, CASE WHEN rej THEN 0.0::DOUBLE ELSE 0.45::DOUBLE * least(1.0::DOUBLE, ing / 25.0::DOUBLE) + 0.45::DOUBLE * least(1.0::DOUBLE, ins / 30.0::DOUBLE) + 0.10::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, ti / 40.0::DOUBLE)) END AS s FROM sp1),
pred AS (SELECT page_num, round_even(s, 4) AS recipe_confidence, NOT rej AND {LIKE} AND s >= 0.35 AS is_recipe_page, coalesce(trim(bt), '') AS best_title, round_even(coalesce(mean, 0), 4) AS avg_token_confidence, round_even(k / n, 4) AS recipe_token_ratio, ing AS ingredient_tokens, ins AS instruction_tokens, ti AS title_tokens,
  round_even(least(1.0::DOUBLE, ing / 25.0::DOUBLE), 4) AS ingredient_score, round_even(least(1.0::DOUBLE, ins / 30.0::DOUBLE), 4) AS instruction_score, round_even(least(1.0::DOUBLE, ti / 40.0::DOUBLE), 4) AS title_penalty, {selection.SCORE_VERSION} AS score_version FROM sp)
"""


def _scored(spark, sf):
    return selection.score_prediction(_words(spark, sf), _pages(spark, sf))


@query(SCORED + "SELECT * FROM pred")
def score_prediction(spark, sf):
    return _scored(spark, sf)


@query(SCORED + "SELECT page_num, recipe_confidence FROM pred ORDER BY is_recipe_page DESC, recipe_confidence DESC, page_num LIMIT 10")
def featured_pages(spark, sf):
    """Ten pages: recipe pages by confidence, then others."""
    return _scored(spark, sf).orderBy(F.desc("is_recipe_page"), F.desc("recipe_confidence"), "page_num").limit(10).select("page_num", "recipe_confidence")


_FEATURED = """fb AS (SELECT count(*) FILTER (is_recipe_page) AS recipes FROM ps), fr AS (SELECT page_num, CASE WHEN is_recipe_page THEN recipe_confidence ELSE 0 END AS recipe_confidence, is_recipe_page FROM ps, fb WHERE is_recipe_page OR recipes = 0),
fk AS (SELECT *, row_number() OVER (ORDER BY recipe_confidence DESC, page_num) AS rank FROM fr)
SELECT rank::INT AS rank, page_num, recipe_confidence, CASE WHEN is_recipe_page THEN 'curated_recipe' ELSE 'fallback_any' END AS mode, CASE WHEN is_recipe_page THEN 'ok' ELSE 'degraded' END AS status, (SELECT page_num FROM fk WHERE rank = 1) AS default_page FROM fk WHERE rank <= 10"""


@query(SCORED + ", ps AS (SELECT * FROM pred), " + _FEATURED)
def featured_status(spark, sf):
    return selection.featured(_scored(spark, sf))


@query(SCORED + ", ps AS (SELECT * FROM pred WHERE NOT is_recipe_page), " + _FEATURED)
def featured_fallback(spark, sf):
    """Without the recipe pages."""
    return selection.featured(_scored(spark, sf).where("NOT is_recipe_page"))


@query(TOK + """, bl AS (SELECT page_num, l.label, count(*) FILTER (tok.label_pred = l.label) AS n FROM tok, (SELECT unnest(['INGREDIENT_LINE', 'INSTRUCTION_STEP', 'TITLE']) AS label) l GROUP BY ALL),
bk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, page_num) AS rank FROM bl) SELECT label, rank::INT AS rank, page_num, n FROM bk WHERE rank <= 5""")
def best_pages_by_label(spark, sf):
    return selection.best_pages_by_label(_words(spark, sf), ["INGREDIENT_LINE", "INSTRUCTION_STEP", "TITLE"])


@query(TOK + f"SELECT min(page_num) AS first_page FROM page WHERE page_num >= 69 AND {LIKE}")
def first_recipe_page(spark, sf):
    return _pages(spark, sf).where((F.col("page_num") >= 69) & selection.recipe_like(F.col("text"))).agg(F.min("page_num").alias("first_page"))


@query("SELECT doc_id AS page_num, source AS book FROM documents WHERE doc_id BETWEEN 69 AND 535")
def filter_page_range(spark, sf):
    """The feature itself is a range of page numbers."""
    return spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").between(69, 535)).select(F.col("doc_id").alias("page_num"), F.col("source").alias("book"))


_OK = lambda s: f"title_lines >= 1 AND ingredient_lines >= {s['ingredient_lines']} AND instruction_lines >= {s['instruction_lines']} AND avg_token_conf >= {s['avg_token_conf']} AND o_ratio <= {s['o_ratio']} AND total_tokens >= {s['tokens']} AND labeled_token_ratio >= {s['labeled_ratio']}"
STRICT = {**structure.LIMITS, "avg_token_conf": 0.52, "tokens": 120, "o_ratio": 0.6}


@query(STRUCT + ", rd AS (" + " UNION ALL ".join(f"SELECT page_num, {k + 1} AS round FROM met WHERE {_OK(s)}" for k, s in enumerate(selection.limits_by_round(STRICT))) + "), ct AS (SELECT round, count(*) AS n FROM rd GROUP BY round) SELECT page_num, round FROM rd WHERE round = (SELECT coalesce(min(round) FILTER (n >= 150), 5) FROM ct)")
def filter_structural_relaxing(spark, sf):
    return selection.filter_structural_relaxing(_metrics(spark, sf), 150, STRICT)


@query(STRUCT + "SELECT page_num, avg_token_conf, o_ratio, total_tokens FROM met WHERE title_lines = 1 AND ingredient_lines BETWEEN 1 AND 20 AND instruction_lines BETWEEN 1 AND 20 AND avg_token_conf >= 0.4 AND o_ratio <= 0.95 AND total_tokens >= 30 ORDER BY page_num LIMIT 50")
def select_easy_pages(spark, sf):
    return selection.select_easy_pages(_metrics(spark, sf)).select("page_num", "avg_token_conf", "o_ratio", "total_tokens")


@query(STRUCT + "SELECT page_num, round(avg_token_conf * 0.6 + (1 - o_ratio) * 0.2 + least(1.0, labeled_token_ratio * 10) * 0.2, 6) AS best_score FROM met JOIN flt USING (page_num) WHERE len(reasons) = 0 ORDER BY best_score DESC, page_num LIMIT 20")
def best_pages(spark, sf):
    return selection.best_pages(_metrics(spark, sf))


@query(STATS + """, top AS (SELECT *, round(0.6 * instruction + 0.4 * ingredient, 6) AS bl FROM stats ORDER BY bl DESC, page_num DESC LIMIT 120), c AS (SELECT CASE WHEN count(*) FILTER (ingredient >= 400) / count(*) < 0.3 THEN 36 - count(*) FILTER (ingredient >= 400) ELSE 0 END AS need FROM top),
d AS (SELECT page_num, row_number() OVER (ORDER BY ingredient DESC, page_num DESC) AS k FROM stats WHERE ingredient >= 400 AND page_num NOT IN (SELECT page_num FROM top)), v AS (SELECT page_num, row_number() OVER (ORDER BY instruction, page_num) AS k FROM top WHERE ingredient < 400),
s AS (SELECT d.page_num AS n, v.page_num AS o FROM d JOIN v USING (k), c WHERE k <= need) SELECT page_num FROM top WHERE page_num NOT IN (SELECT o FROM s) UNION ALL SELECT n FROM s""")
def select_with_coverage(spark, sf):
    return selection.select_with_coverage(_stats(spark, sf), 120, rich=400)


@query(STATS + """, b AS (SELECT 'sections' AS batch, page_num, row_number() OVER (ORDER BY page_num) AS r, 6 AS k FROM stats WHERE title > 0 UNION ALL SELECT 'untitled', page_num, row_number() OVER (ORDER BY page_num), 10 FROM stats WHERE (ingredient > 5 OR instruction > 10) AND page_num % 3 > 0 AND page_num >= 38),
s AS (SELECT batch, page_num FROM b WHERE r % k = 1 AND r <= 20 * k) SELECT * FROM s UNION ALL SELECT 'fixed', page_num FROM stats WHERE page_num IN (5, 10, 15, 20, 25, 300, 320, 340, 550, 580)""")
def sample_stride(spark, sf):
    """Three batches: every 6th page with a title word, every 10th recipe page of those whose number is no multiple of 3 (which
    stand for untitled ones) from 38 on, 20 pages each, and ten fixed pages. The limits are the feature."""
    s = _stats(spark, sf)
    one = selection.every_nth(s.where("title > 0"), 6).select(F.lit("sections").alias("batch"), "page_num")
    two = selection.every_nth(s.where("(ingredient > 5 OR instruction > 10) AND page_num % 3 > 0 AND page_num >= 38"), 10).select(F.lit("untitled").alias("batch"), "page_num")
    three = s.where(F.col("page_num").isin([5, 10, 15, 20, 25, 300, 320, 340, 550, 580])).select(F.lit("fixed").alias("batch"), "page_num")
    return one.unionByName(two).unionByName(three)


@query(STATS + "SELECT page_num, instruction, ingredient FROM stats ORDER BY instruction DESC, ingredient DESC, page_num LIMIT 10")
def top_instruction_pages(spark, sf):
    return labels.top_instruction_pages(_stats(spark, sf))


@query("SELECT page_num FROM (SELECT DISTINCT doc_id AS page_num FROM documents) ORDER BY md5('7:' || page_num), page_num LIMIT 40")
def sample_pages(spark, sf):
    ids = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num")).distinct()
    return selection.digested(ids, 7).orderBy("digest", "page_num").limit(40).select("page_num")


@query(STATS + """, rk AS (SELECT page_num, ingredient, instruction, row_number() OVER (ORDER BY md5('42:' || page_num), page_num) AS r, count(*) OVER () AS n FROM stats), sz AS (SELECT *, floor(n * 0.1) AS nt, floor((n - floor(n * 0.1)) * 0.15) AS nv FROM rk), rest AS (SELECT * FROM sz WHERE r > nt),
i AS (SELECT page_num FROM rest WHERE ingredient > 0 ORDER BY r LIMIT 10), s AS (SELECT page_num FROM rest WHERE instruction > 0 ORDER BY r LIMIT 10),
p AS (SELECT *, row_number() OVER (ORDER BY tier, r) AS place FROM (SELECT *, CASE WHEN page_num IN (SELECT page_num FROM i) THEN 0 WHEN page_num IN (SELECT page_num FROM s) THEN 1 ELSE 2 END AS tier FROM rest))
SELECT page_num, CASE WHEN tier = 0 OR place <= nv THEN 'validation' ELSE 'train' END AS split FROM p UNION ALL SELECT page_num, 'test' FROM sz WHERE r <= nt""")
def split_stratified(spark, sf):
    return selection.split_stratified(_stats(spark, sf))


@query("""WITH ids AS (SELECT DISTINCT doc_id AS page_num FROM documents), h AS (SELECT DISTINCT doc_id AS page_num FROM labels WHERE toxic = 1), r AS (SELECT page_num, row_number() OVER (ORDER BY md5('42:' || page_num), page_num) AS r, count(*) OVER () AS n FROM ids WHERE page_num NOT IN (SELECT page_num FROM h))
SELECT page_num, CASE WHEN r <= floor(n * 0.1) THEN 'test' WHEN r <= floor(n * 0.1) + floor(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM r UNION ALL SELECT page_num, 'demo_eval' FROM ids WHERE page_num IN (SELECT page_num FROM h)""")
def split_with_holdout(spark, sf):
    held = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("page_num"))
    return selection.split_with_holdout(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num")), held)


_MERGED = """WITH src AS (SELECT doc_id AS page_num, 0 AS p, 'gold' AS s, CAST(quality AS VARCHAR) AS l FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1, 'corrections', 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 2, 'curated', lang FROM documents WHERE source IN ('books', 'wiki') UNION ALL SELECT doc_id, 3, 'weak', lang FROM documents WHERE n_chars >= 500),
b AS (SELECT page_num, arg_min(s, p) AS s, arg_min(l, p) AS l FROM src GROUP BY page_num), m AS (SELECT doc_id AS page_num, coalesce(s, 'ocr_only') AS label_source, l AS page_label, s IS NOT NULL AS has_labels FROM documents LEFT JOIN b ON b.page_num = doc_id) """


def _merged(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = lambda d, label: d.select(F.col("doc_id").alias("page_num"), F.lit(0).alias("pos"), label.alias("page_label"))
    sources = [
        ("gold", one(marks.where("quality = 1"), F.col("quality").cast("string"))), ("corrections", one(marks.where("toxic = 1"), F.lit("toxic"))),
        ("curated", one(docs.where("source IN ('books', 'wiki')"), F.col("lang"))), ("weak", one(docs.where("n_chars >= 500"), F.col("lang"))),
    ]
    return selection.merge_label_sources(docs.select(F.col("doc_id").alias("page_num")), sources)


@query(_MERGED + "SELECT * FROM m")
def merge_label_sources(spark, sf):
    return _merged(spark, sf)


@query(_MERGED + "SELECT label_source, count(*) AS pages FROM m GROUP BY label_source")
def union_sources(spark, sf):
    return _merged(spark, sf).groupBy("label_source").agg(F.count("*").alias("pages"))


@query(STATS + "SELECT CAST(sum(ingredient) AS BIGINT) AS ingredient, CAST(sum(instruction) AS BIGINT) AS instruction, round(sum(instruction) / sum(ingredient), 6) AS ratio, sum(instruction) / sum(ingredient) >= 0.2 AS ok FROM stats")
def validate_ratio(spark, sf):
    one = _stats(spark, sf).agg(F.sum("ingredient").alias("ingredient"), F.sum("instruction").alias("instruction"))
    ratio = F.col("instruction") / F.nullif(F.col("ingredient"), F.lit(0))
    return one.withColumns({"ratio": F.round(ratio, 6), "ok": ratio >= 0.2})


@query(TOK + "SELECT book, min(lo) AS least, max(hi) AS most, count(*) FILTER (lo < 0 OR hi > 1000) AS pages_out FROM (SELECT book, page_num, min(least(x0, y0, x1, y1)) AS lo, max(greatest(x0, y0, x1, y1)) AS hi FROM tok GROUP BY ALL) GROUP BY book")
def validate_bbox_ranges(spark, sf):
    return selection.bbox_ranges(_words(spark, sf), "book")


@query(TOK + f", r AS (SELECT unnest({_IN(['TITLE', 'INGREDIENT_LINE', 'TEMP', 'NOTE'])}) AS label) SELECT r.label, count(label_pred) AS n, count(DISTINCT page_num) AS pages, count(label_pred) > 0 AS ok FROM r LEFT JOIN tok ON tok.label_pred = r.label GROUP BY r.label")
def validate_required_labels(spark, sf):
    n = _words(spark, sf).groupBy("label_pred", "page_num").agg(F.count("*").alias("n")).groupBy(F.col("label_pred").alias("label")).agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
    wanted = spark.createDataFrame([("TITLE",), ("INGREDIENT_LINE",), ("TEMP",), ("NOTE",)], "label string")
    return wanted.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pages", F.lit(0)).alias("pages"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))


@query(TOK + f"SELECT page_num, word_idx, list_position({_IN(labels.LABELS_V2)}, label) - 1 AS label_id FROM tok")
def encode_labels(spark, sf):
    return _words(spark, sf).select("page_num", "word_idx", (F.array_position(F.array(*map(F.lit, labels.LABELS_V2)), F.col("label")).cast("int") - 1).alias("label_id"))
