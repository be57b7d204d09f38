"""The library's operators as queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import boxes
from pageloom.operators import labels, lines, scoring, structure
from pageloom.sources import pages as source
from pageloom.sources import readers

TOK = r"""
WITH raw AS (SELECT doc_id AS page_num, source AS book, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
pos AS (SELECT page_num, book, unnest(ws) AS raw, unnest(range(len(ws))) AS word_idx FROM raw),
t1 AS (SELECT page_num, book, word_idx, word_idx // 9 AS line0, CASE word_idx % 29 WHEN 3 THEN '1/2' WHEN 4 THEN 'cup' WHEN 5 THEN 'sugar' WHEN 11 THEN 'Mix' WHEN 17 THEN '30' WHEN 18 THEN 'minutes' ELSE raw END AS word FROM pos),
t2 AS (SELECT *, 60 + 100 * (word_idx % 9) AS x0, 60 + 100 * (word_idx % 9) + 8 * least(length(word), 11) AS x1, 40 + 30 * line0 + (word_idx * 7) % 5 AS y0, 58 + 30 * line0 + (word_idx * 7) % 5 AS y1,
  (page_num * 37 + word_idx * 13) % 101 AS conf,
  CASE WHEN word_idx % 29 <= 2 AND line0 = 0 THEN 'TITLE' WHEN word_idx % 29 BETWEEN 3 AND 5 THEN 'INGREDIENT_LINE' WHEN word_idx % 29 BETWEEN 11 AND 16 THEN 'INSTRUCTION_STEP' WHEN word_idx % 29 BETWEEN 17 AND 18 THEN 'TIME' ELSE 'O' END AS label FROM t1),
tok AS (SELECT *, CASE WHEN label = 'O' AND (page_num + word_idx) % 7 = 0 THEN 'INGREDIENT_LINE' WHEN label = 'INGREDIENT_LINE' AND (page_num + word_idx) % 11 = 0 THEN 'O' ELSE label END AS label_pred FROM t2),
page AS (SELECT d.doc_id AS page_num, any_value(d.source) AS book, 100 + 30 * coalesce(max(line0) + 1, 0) AS height, coalesce(list(word ORDER BY word_idx) FILTER (word IS NOT NULL), []) AS words,
  coalesce(list(conf ORDER BY word_idx) FILTER (word IS NOT NULL), []) AS confs,
  coalesce(string_agg(CASE WHEN word_idx = 0 THEN '' WHEN word_idx % 9 = 0 THEN chr(10) ELSE ' ' END || word, '' ORDER BY word_idx), '') AS text FROM documents d LEFT JOIN tok ON tok.page_num = d.doc_id GROUP BY d.doc_id)
"""
LINES = TOK + """,
mid AS (SELECT *, (y0 + y1) / 2 AS mid_y, (x0 + x1) / 2 AS mid_x FROM tok),
st AS (SELECT *, CASE WHEN mid_y - lag(mid_y) OVER (PARTITION BY page_num ORDER BY mid_y, mid_x, word_idx) > 12 THEN 1 ELSE 0 END AS s FROM mid),
ln AS (SELECT *, CAST(sum(s) OVER (PARTITION BY page_num ORDER BY mid_y, mid_x, word_idx) AS BIGINT) AS line_id FROM st)
"""
STATS = TOK + """,
stats AS (SELECT page_num, count(*) AS token_count, count(*) FILTER (label <> 'O') AS non_o, count(*) FILTER (label = 'INGREDIENT_LINE') AS ingredient, count(*) FILTER (label = 'INSTRUCTION_STEP') AS instruction,
  count(*) FILTER (label = 'TITLE') AS title, count(*) FILTER (label <> 'O') / count(*) AS non_o_ratio FROM tok GROUP BY page_num)
"""
FIELDS = TOK + """,
fld AS (SELECT *, len(words) AS token_count, len(list_distinct(words)) AS unique_token_count, list_sum(confs) / nullif(len(confs), 0) AS avg_confidence, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line_count FROM page)
"""
_IN = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
FEATURES = FIELDS + rf""",
feat AS (SELECT *, list_has_any(list_transform(words, lambda w: lower(w)), {_IN(scoring.UNITS)}) AS units, list_has_any(list_transform(words, lambda w: lower(w)), {_IN(scoring.VERBS)}) AS verbs,
  regexp_matches(lower(text), '{scoring.TIME}') AS time_hit, regexp_matches(lower(text), '{scoring.TEMP}') AS temp_hit, regexp_matches(lower(text), '{scoring.TOC}') AS toc,
  len(list_filter(words, lambda w: regexp_matches(w, '{scoring.NUMBER}'))) / greatest(1, token_count) AS numeric_density, least(1.0, line_count / greatest(1, token_count)) AS short_line_density,
  coalesce(avg_confidence < 40, false) AS low_conf, token_count < 50 AS few_tokens, trim(string_split(text, chr(10))[1]) AS top_line FROM fld),
feat2 AS (SELECT *, len(string_split_regex(top_line, '\s+')) <= 6 AND upper(top_line[1]) = top_line[1] AND lower(top_line[1]) <> top_line[1] AS title_like_ FROM feat),
feat3 AS (SELECT * EXCLUDE (title_like_), coalesce(title_like_, false) AS title_like FROM feat2)
"""
SCORE = """round(greatest(0.0, least(1.0, (CASE WHEN units THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN verbs THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN time_hit OR temp_hit THEN 0.2 ELSE 0 END)::DOUBLE + least(0.15::DOUBLE, numeric_density) + least(0.1::DOUBLE, short_line_density)
  + (CASE WHEN title_like THEN 0.1 ELSE 0 END)::DOUBLE - (CASE WHEN toc THEN 0.4 ELSE 0 END)::DOUBLE - (CASE WHEN few_tokens THEN 0.2 ELSE 0 END)::DOUBLE - (CASE WHEN low_conf THEN 0.1 ELSE 0 END)::DOUBLE)), 6)"""


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Words, a page's in one partition: documents are shuffled before they are split, so that no step by page shuffles words."""
    path = f"{sf}/documents.parquet"
    docs = spark.read.parquet(path)
    return source.word_table(docs.repartition(readers.page_partitions(spark, path), "doc_id"))


def _word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Words where they are read, for steps that take each on its own or combine them before a shuffle."""
    return source.word_table(spark.read.parquet(f"{sf}/documents.parquet"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return source.page_table(spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(FEATURES + f"SELECT page_num, {SCORE} AS score, {SCORE} >= 0.5 AS likely FROM feat3")
def detect_pages(spark, sf):
    return scoring.detect_pages(_pages(spark, sf)).select("page_num", "score", "likely")


@query(TOK + "SELECT page_num, word_idx, word, x0, y0, conf, label, label_pred FROM tok")
def scan_pages_parquet(spark, sf):
    return _word_rows(spark, sf).select("page_num", "word_idx", "word", "x0", "y0", "conf", "label", "label_pred")


@query(TOK + """, k AS (SELECT * FROM tok WHERE word_idx % 11 <> 5 AND word_idx % 13 <> 7) SELECT page_num, string_agg(word, ' ' ORDER BY y0, x0, word_idx) AS page_words, count(*) AS n, string_agg(x0 || ':' || y0 || ':' || x1 || ':' || y1, ' ' ORDER BY y0, x0, word_idx) AS boxes, sum(conf) AS total FROM k GROUP BY page_num""")
def assemble_pages_from_word_table(spark, sf):
    """Words with left, top, width and height, of which some are blank and some have a negative confidence."""
    c = F.col
    raw = _words(spark, sf).select(
        "page_num", c("word_idx").alias("pos"), F.when(c("word_idx") % 11 == 5, " ").otherwise(c("word")).alias("text"), F.when(c("word_idx") % 13 == 7, -1).otherwise(c("conf")).alias("conf"),
        c("x0").alias("left"), c("y0").alias("top"), (c("x1") - c("x0")).alias("width"), (c("y1") - c("y0")).alias("height"),
    )
    pages = source.assemble_pages(raw)
    shown = F.array_join(F.transform("bboxes", lambda b: F.array_join(F.transform(b, lambda x: x.cast("string")), ":")), " ")
    total = F.aggregate("confidences", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return pages.select("page_num", F.array_join("words", " ").alias("page_words"), F.size("words").cast("long").alias("n"), shown.alias("boxes"), total.alias("total"))


@query(r"SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', ''), '(\d+)', 1), '') AS BIGINT), 0) AS page_num FROM pages")
def page_num_from_path(spark, sf):
    stem = F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"\.[^.]*$", "")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.coalesce(F.regexp_extract(stem, r"(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("page_num"))


@query("SELECT DISTINCT doc_id AS page_num, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded FROM documents")
def list_pages(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded")).distinct()


@query(FIELDS + "SELECT page_num, token_count, unique_token_count, avg_confidence, line_count FROM fld")
def derive_page_fields(spark, sf):
    return scoring.derive_page_fields(_pages(spark, sf)).select("page_num", "token_count", "unique_token_count", "avg_confidence", "line_count")


@query(FEATURES + "SELECT page_num, units, verbs, time_hit, temp_hit, toc, round(numeric_density, 6) AS numeric_density, round(short_line_density, 6) AS short_line_density, low_conf, few_tokens, title_like FROM feat3")
def page_features(spark, sf):
    f = scoring.page_features(scoring.derive_page_fields(_pages(spark, sf)))
    return f.select("page_num", "units", "verbs", "time_hit", "temp_hit", "toc", F.round("numeric_density", 6).alias("numeric_density"), F.round("short_line_density", 6).alias("short_line_density"), "low_conf", "few_tokens", "title_like")


@query(TOK + r", c AS (SELECT page_num, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM page) SELECT page_num, substr(clean, 1, 250) || CASE WHEN length(clean) > 250 THEN '…' ELSE '' END AS excerpt FROM c")
def page_excerpt(spark, sf):
    return scoring.page_excerpt(_pages(spark, sf)).select("page_num", "excerpt")


@query(TOK + ", k AS (SELECT page_num, lower(word) AS keyword, count(*) AS n, min(word_idx) AS f FROM tok WHERE length(lower(word)) >= 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY n DESC, f) AS keyword_rank FROM k) SELECT page_num, keyword_rank, keyword, n FROM r WHERE keyword_rank <= 5")
def page_top_keywords(spark, sf):
    return scoring.page_top_keywords(_words(spark, sf))


@query(TOK + """, n AS (SELECT tok.page_num, word_idx, least(1000, greatest(0, x0)) AS nx0, least(1000, greatest(0, y0 * 1000 // height)) AS ny0, least(1000, greatest(0, CASE WHEN word_idx % 5 = 0 THEN x0 - 7 ELSE x1 END)) AS a, least(1000, greatest(0, y1 * 1000 // height)) AS b FROM tok JOIN page USING (page_num))
SELECT page_num, word_idx, nx0, ny0, greatest(nx0, a) AS nx1, greatest(ny0, b) AS ny1 FROM n""")
def normalize_bbox(spark, sf):
    """Every fifth box is turned round, its right edge before its left one."""
    c = F.col
    box = (c("x0"), c("y0"), F.when(c("word_idx") % 5 == 0, c("x0") - 7).otherwise(c("x1")), c("y1"))
    parts = boxes.normalized_box(box, F.lit(1000), c("height"))
    return _word_rows(spark, sf).select("page_num", "word_idx", *[x.alias(n) for x, n in zip(parts, ("nx0", "ny0", "nx1", "ny1"), strict=True)])


@query(TOK + "SELECT page_num, label, min(x0) AS ux0, min(y0) AS uy0, max(x1) AS ux1, max(y1) AS uy1 FROM tok GROUP BY ALL")
def union_bbox(spark, sf):
    return _words(spark, sf).groupBy("page_num", "label").agg(F.min("x0").alias("ux0"), F.min("y0").alias("uy0"), F.max("x1").alias("ux1"), F.max("y1").alias("uy1"))


@query(TOK + """, b AS (SELECT page_num, min(x0) FILTER (label = 'TITLE') AS a0, min(y0) FILTER (label = 'TITLE') AS a1, max(x1) FILTER (label = 'TITLE') AS a2, max(y1) FILTER (label = 'TITLE') AS a3, min(x0) AS b0, min(y0) AS b1, max(x1) AS b2, max(y1) AS b3 FROM tok GROUP BY page_num),
 i AS (SELECT *, greatest(0, least(a2, b2) - greatest(a0, b0)) * greatest(0, least(a3, b3) - greatest(a1, b1)) AS inter FROM b)
 SELECT page_num, round(inter / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - inter), 6) AS iou FROM i""")
def bbox_iou(spark, sf):
    only = lambda agg, c: agg(F.when(F.col("label") == "TITLE", F.col(c)))
    b = _words(spark, sf).groupBy("page_num").agg(only(F.min, "x0").alias("a0"), only(F.min, "y0").alias("a1"), only(F.max, "x1").alias("a2"), only(F.max, "y1").alias("a3"), F.min("x0").alias("b0"), F.min("y0").alias("b1"), F.max("x1").alias("b2"), F.max("y1").alias("b3"))
    return b.select("page_num", F.round(boxes.iou(tuple(F.col(f"a{i}") for i in range(4)), tuple(F.col(f"b{i}") for i in range(4))), 6).alias("iou"))


@query(LINES + "SELECT page_num, word_idx, line_id FROM ln")
def lines_gap(spark, sf):
    return lines.lines_gap(_words(spark, sf)).select("page_num", "word_idx", "line_id")


@query(LINES + "SELECT page_num, line_id, string_agg(word, ' ' ORDER BY x0, word_idx) AS line_text, count(*) AS n_words, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1, round(avg(y1 - y0), 6) AS avg_height, round(avg(x1 - x0), 6) AS avg_width, round(avg(conf), 6) AS avg_conf FROM ln GROUP BY page_num, line_id")
def line_features(spark, sf):
    return lines.line_features(lines.lines_gap(_words(spark, sf)))


@query(LINES + ", c AS (SELECT page_num, line_id, label, count(*) AS n, min(word_idx) AS f FROM ln GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_num, line_id ORDER BY n DESC, f) AS k FROM c) SELECT page_num, line_id, label, n FROM r WHERE k = 1")
def line_majority_label(spark, sf):
    return lines.line_majority_label(lines.lines_gap(_words(spark, sf)))


_SPANS = "SELECT page_num, {l} AS span_label, min(word_idx) AS span_start, max(word_idx) AS span_end FROM (SELECT *, sum(n) OVER (PARTITION BY page_num ORDER BY word_idx) AS run FROM (SELECT *, CASE WHEN {l} = lag({l}) OVER (PARTITION BY page_num ORDER BY word_idx) THEN 0 ELSE 1 END AS n FROM tok)) GROUP BY page_num, run, {l}"


@query(TOK + _SPANS.format(l="label"))
def label_spans(spark, sf):
    return lines.label_spans(_words(spark, sf))


@query(TOK + f", a AS ({_SPANS.format(l='label')}), b AS ({_SPANS.format(l='label_pred')}), m AS (SELECT count(*) AS hits FROM a JOIN b USING (page_num, span_label, span_start, span_end) WHERE span_label <> 'O') SELECT *, coalesce(hits / nullif(n_pred, 0), 0) AS precision_, coalesce(hits / nullif(n_true, 0), 0) AS recall_, coalesce(2 * hits / nullif(n_true + n_pred, 0), 0) AS f1 FROM (SELECT hits, (SELECT count(*) FROM a WHERE span_label <> 'O') AS n_true, (SELECT count(*) FROM b WHERE span_label <> 'O') AS n_pred FROM m)")
def span_metrics(spark, sf):
    w = _words(spark, sf)
    keys = ["page_num", "span_label", "span_start", "span_end"]
    a = lines.label_spans(w).where("span_label <> 'O'").withColumn("t", F.lit(1))
    b = lines.label_spans(w, "label_pred").where("span_label <> 'O'").withColumn("p", F.lit(1))
    one = a.join(b, keys, "full").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("hits"), F.count("t").alias("n_true"), F.count("p").alias("n_pred"))
    ratio = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    hits, n_true, n_pred = F.col("hits"), F.col("n_true"), F.col("n_pred")
    return one.withColumns({"precision_": ratio(hits, n_pred), "recall_": ratio(hits, n_true), "f1": ratio(2 * hits, n_true + n_pred)})


@query(TOK + "SELECT page_num, word_idx, CASE WHEN label = 'TITLE' THEN 'RECIPE_TITLE' ELSE label END AS label_v3 FROM tok")
def map_label_taxonomy(spark, sf):
    return labels.map_label_taxonomy(_word_rows(spark, sf)).select("page_num", "word_idx", "label_v3")


@query(STATS + "SELECT * FROM stats")
def page_label_stats(spark, sf):
    return labels.page_label_stats(_words(spark, sf))


@query(TOK + ", d AS (SELECT book, label, count(*) AS n FROM tok GROUP BY ALL UNION ALL SELECT NULL, label, count(*) FROM tok GROUP BY label) SELECT book, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY book), 6) AS percent FROM d")
def label_distribution(spark, sf):
    return labels.label_distribution(_word_rows(spark, sf), "book")


@query(STATS + "SELECT count(*) AS n_pages, round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM stats")
def dataset_stats(spark, sf):
    s = labels.page_label_stats(_words(spark, sf))
    return s.agg(F.count("*").alias("n_pages"), F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))


@query(TOK + f", l AS (SELECT unnest({_IN(labels.LABELS_V2)}) AS label), c AS (SELECT label, count(*) AS n FROM tok GROUP BY label), w AS (SELECT label, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN (sum(n) OVER ()) / (8 * n) ELSE 1.0 END AS r FROM l LEFT JOIN c USING (label)) SELECT label, n, round(r / avg(r) OVER (), 6) AS weight FROM w")
def class_weights(spark, sf):
    return labels.class_weights(_word_rows(spark, sf), labels.LABELS_V2)


@query(TOK + "SELECT label, label_pred, count(*) AS n FROM tok GROUP BY ALL")
def confusion_matrix(spark, sf):
    return labels.confusion_matrix(_word_rows(spark, sf))


@query(TOK + """, a AS (SELECT label, count(*) AS support, count(*) FILTER (label = label_pred) AS tp FROM tok GROUP BY label), b AS (SELECT label_pred AS label, count(*) AS predicted FROM tok GROUP BY 1),
 m AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM a FULL JOIN b USING (label))
 SELECT label, round(p, 6) AS precision_, round(r, 6) AS recall_, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM m""")
def token_metrics(spark, sf):
    return labels.token_metrics(_word_rows(spark, sf))


@query(TOK + "SELECT page_num, avg((label = label_pred)::INT) AS accuracy FROM tok GROUP BY page_num")
def page_accuracy(spark, sf):
    return labels.page_accuracy(_words(spark, sf))


@query(TOK + ", c AS (SELECT page_num, label_pred, count(*) AS n FROM tok GROUP BY ALL) SELECT page_num, max(n) / sum(n) AS share, max(n) / sum(n) > 0.9 AS collapsed FROM c GROUP BY page_num")
def collapse_check(spark, sf):
    return labels.collapse_check(_words(spark, sf))


@query(STATS + "SELECT page_num FROM stats WHERE non_o_ratio >= 0.4 OR ingredient >= 60 OR instruction >= 100 OR title > 3")
def filter_recipe_coverage(spark, sf):
    return labels.filter_recipe_coverage(labels.page_label_stats(_words(spark, sf))).select("page_num")


@query(STATS + "SELECT page_num, round(0.6 * instruction + 0.4 * ingredient, 6)::DOUBLE AS blended FROM stats ORDER BY blended DESC, page_num DESC LIMIT 250")
def rank_pages_blended(spark, sf):
    return labels.rank_pages_blended(labels.page_label_stats(_words(spark, sf)), 250).select("page_num", "blended")


@query(TOK + ", r AS (SELECT page_num, label_pred, row_number() OVER (PARTITION BY page_num, label_pred ORDER BY conf DESC, word_idx) AS token_rank, word_idx, word, conf FROM tok) SELECT * FROM r WHERE token_rank <= 20")
def top_tokens_per_label(spark, sf):
    return labels.top_tokens_per_label(_words(spark, sf))


_SPLIT = "SELECT page_num, CASE WHEN r <= floor(n * 0.1) THEN 'test' WHEN r <= floor(n * 0.1) + floor((n - floor(n * 0.1)) * 0.15) THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id AS page_num, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents))"


@query(_SPLIT)
def split_random(spark, sf):
    return labels.split_random(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num")))


@query(f"SELECT split, count(*) AS n, count(DISTINCT page_num) AS n_distinct FROM ({_SPLIT}) GROUP BY split")
def split_leakage_check(spark, sf):
    return split_random(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("page_num").alias("n_distinct"))


@query(TOK + "SELECT replace(upper(word), 'ẞ', 'SS') AS header_word, count(*) AS n FROM tok JOIN page USING (page_num) WHERE (y0 + y1) / 2 < height * 0.15 GROUP BY 1 HAVING count(*) >= 5")
def header_vocabulary(spark, sf):
    return labels.header_vocabulary(_word_rows(spark, sf))


@query(TOK + ", d AS (SELECT page_num, word_idx // 3 AS w, word_idx AS pos, label_pred, conf FROM tok), r AS (SELECT *, row_number() OVER (PARTITION BY page_num, w ORDER BY conf DESC, pos) AS k FROM d) SELECT page_num, w AS word_idx, pos, label_pred, conf FROM r WHERE k = 1")
def words_to_word_level(spark, sf):
    t = _words(spark, sf).select("page_num", F.floor(F.col("word_idx") / 3).alias("word_idx"), F.col("word_idx").alias("pos"), "label_pred", "conf")
    return labels.words_to_word_level(t)


@query(TOK + ", d AS (SELECT page_num, word_idx // 3 AS w, word_idx AS pos, label_pred, conf FROM tok), r AS (SELECT *, row_number() OVER (PARTITION BY page_num, w ORDER BY pos) AS k FROM d) SELECT page_num, w AS word_idx, pos, label_pred, conf FROM r WHERE k = 1")
def words_to_first_piece(spark, sf):
    t = _words(spark, sf).select("page_num", F.floor(F.col("word_idx") / 3).alias("word_idx"), F.col("word_idx").alias("pos"), "label_pred", "conf")
    return labels.words_to_first_piece(t)


@query("SELECT doc_id AS page_num FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gate_candidates(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").withColumnRenamed("doc_id", "page_num")


# --- structure, boxes back to pages, and lines by other rules -----------------------------------------------------------

STRUCT = LINES + """,
lc AS (SELECT page_num, line_id, label, count(*) AS n, min(word_idx) AS f FROM ln GROUP BY ALL),
lm AS (SELECT *, row_number() OVER (PARTITION BY page_num, line_id ORDER BY n DESC, f) AS r FROM lc),
by_line AS (SELECT page_num, count(*) FILTER (label = 'TITLE') AS title_lines, count(*) FILTER (label = 'INGREDIENT_LINE') AS ingredient_lines, count(*) FILTER (label = 'INSTRUCTION_STEP') AS instruction_lines FROM lm WHERE r = 1 GROUP BY page_num),
met AS (SELECT t.*, title_lines, ingredient_lines, instruction_lines FROM (SELECT page_num, sum(conf) / count(*) / 100 AS avg_token_conf, count(*) AS total_tokens, sum((label IN ('O', 'NOTE'))::INT) / count(*) AS o_ratio, sum((label NOT IN ('O', 'NOTE'))::INT) / count(*) AS labeled_token_ratio FROM tok GROUP BY page_num) t JOIN by_line USING (page_num)),
flt AS (SELECT page_num, list_filter([CASE WHEN title_lines < 1 THEN 'no_title' END, CASE WHEN ingredient_lines < 2 THEN 'few_ing' END, CASE WHEN instruction_lines < 2 THEN 'few_instr' END, CASE WHEN avg_token_conf < 0.60 THEN 'low_conf' END,
  CASE WHEN o_ratio > 0.92 THEN 'high_o_ratio' END, CASE WHEN total_tokens < 80 THEN 'too_short' END, CASE WHEN labeled_token_ratio < 0.03 THEN 'low_labeled_ratio' END], lambda x: x IS NOT NULL) AS reasons FROM met)
"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return structure.structural_metrics(lines.lines_gap(_words(spark, sf)))


@query(STRUCT + "SELECT page_num, avg_token_conf, total_tokens, o_ratio, labeled_token_ratio, title_lines, ingredient_lines, instruction_lines FROM met")
def structural_metrics(spark, sf):
    return _metrics(spark, sf)


@query(STRUCT + "SELECT page_num, array_to_string(reasons, ',') AS reject_reasons, len(reasons) = 0 AS keep FROM flt")
def filter_structural(spark, sf):
    return structure.filter_structural(_metrics(spark, sf)).select("page_num", F.array_join("reasons", ",").alias("reject_reasons"), "keep")


@query(STRUCT + "SELECT reason, count(*) AS pages FROM (SELECT unnest(reasons) AS reason FROM flt) GROUP BY reason")
def structural_reject_histogram(spark, sf):
    return structure.reject_histogram(structure.filter_structural(_metrics(spark, sf)))


@query(TOK + """, c AS (SELECT count(*) AS n, count(*) FILTER (label <> 'O') AS labelled, count(*) FILTER (label = 'INGREDIENT_LINE') AS ing, count(*) FILTER (label = 'INSTRUCTION_STEP') AS ins FROM tok), t AS (SELECT max(k) AS top FROM (SELECT count(*) AS k FROM tok GROUP BY label))
SELECT 'error' AS severity, 'no_tokens' AS violation FROM c WHERE n = 0 UNION ALL SELECT 'error', 'low_non_o_ratio' FROM c WHERE n > 0 AND labelled < 0.6 * n UNION ALL SELECT 'error', 'missing_ingredient' FROM c WHERE n > 0 AND ing = 0
UNION ALL SELECT 'error', 'missing_instruction' FROM c WHERE n > 0 AND ins = 0 UNION ALL SELECT 'warning', 'one_label_dominates' FROM c, t WHERE top > 0.4 * n""")
def validate_label_distribution(spark, sf):
    """With strict limits (60 % labelled, 40 % for one label), so that the tables break some."""
    return structure.label_violations(_words(spark, sf), least=0.6, most=0.4)


@query(TOK + "SELECT page_num, word_idx, CAST(trunc(least(1000, x0) / 1000.0 * 850) AS INT) AS px0, CAST(trunc(least(1000, x1) / 1000.0 * 850) AS INT) AS px1 FROM tok")
def denormalize_bbox(spark, sf):
    to_pixels = lambda c: boxes.pixels(F.least(F.lit(1000), F.col(c)), F.lit(850))
    return _word_rows(spark, sf).select("page_num", "word_idx", to_pixels("x0").alias("px0"), to_pixels("x1").alias("px1"))


@query(TOK + "SELECT page_num, word_idx, round(x0 / 1000 * 100, 6) AS x_pct, round(y0 / height * 100, 6) AS y_pct, round((x1 - x0) / 1000 * 100, 6) AS w_pct, round((y1 - y0) / height * 100, 6) AS h_pct FROM tok JOIN page USING (page_num)")
def percent_bbox(spark, sf):
    parts = boxes.percent(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(1000), F.col("height"))
    return _word_rows(spark, sf).select("page_num", "word_idx", *(F.round(p, 6).alias(n) for p, n in zip(parts, ("x_pct", "y_pct", "w_pct", "h_pct"), strict=True)))


@query(TOK + "SELECT page_num, label, count(*) AS n FROM tok WHERE label <> 'O' AND conf >= 60 GROUP BY ALL")
def filter_tokens(spark, sf):
    return _words(spark, sf).where("label <> 'O' AND conf >= 60").groupBy("page_num", "label").agg(F.count("*").alias("n"))


@query(TOK + "SELECT page_num, CASE WHEN c >= 0.9 THEN 'High' WHEN c >= 0.75 THEN 'Medium' ELSE 'Low' END AS bucket FROM (SELECT page_num, avg(conf) / 100 + 0.3 AS c FROM tok GROUP BY page_num)")
def confidence_bucket(spark, sf):
    mean = _words(spark, sf).groupBy("page_num").agg((F.avg("conf") / 100 + 0.3).alias("c"))
    return mean.select("page_num", F.when(F.col("c") >= 0.9, "High").when(F.col("c") >= 0.75, "Medium").otherwise("Low").alias("bucket"))


# Marks that depend on all words before a word: a fold over each page's words, in both engines.


def _fold(order: str, at: str, tolerance: str, mark: str) -> str:
    """line_id by a fold over the list of a page's words: the state is (mark, line number, line numbers so far)."""
    return TOK + f""", m AS (SELECT tok.*, (y0 + y1) / 2 AS mid_y, height FROM tok JOIN page USING (page_num)),
g AS (SELECT page_num, list(word_idx ORDER BY {order}) AS ws, list(({at})::DOUBLE ORDER BY {order}) AS ys, ({tolerance})::DOUBLE AS t FROM m GROUP BY page_num),
f AS (SELECT page_num, ws, list_reduce(list_transform(ys, lambda y: {{'mark': y, 'line': 0::BIGINT, 'all': [0::BIGINT], 't': t}}),
  lambda a, b: {{'mark': CASE WHEN abs(b.mark - a.mark) > t THEN {mark[0]} ELSE {mark[1]} END, 'line': a.line + (abs(b.mark - a.mark) > t)::BIGINT, 'all': list_append(a.all, a.line + (abs(b.mark - a.mark) > t)::BIGINT), 't': t}}).all AS ls FROM g)
SELECT page_num, unnest(ws) AS word_idx, unnest(ls) AS line_id FROM f"""


_ANCHOR, _HALF = ("b.mark", "a.mark"), ("(a.mark + b.mark) / 2", "(a.mark + b.mark) / 2")


@query(_fold("y0, x0, word_idx", "mid_y", "18", _ANCHOR))
def lines_anchor_center(spark, sf):
    return lines.group_lines(_words(spark, sf), "anchor_center")


@query(_fold("y0, x0, word_idx", "mid_y", "0.015::DOUBLE * max(height)", _ANCHOR))
def lines_anchor_relative(spark, sf):
    return lines.group_lines(_words(spark, sf), "anchor_relative")


@query(_fold("word_idx", "y0", "20", _ANCHOR))
def lines_anchor_reading_order(spark, sf):
    return lines.group_lines(_words(spark, sf), "anchor_reading_order")


@query(_fold("mid_y, x0, word_idx", "mid_y", "greatest(4, floor(0.8::DOUBLE * list_sort(list(y1 - y0))[count(*) // 2 + 1]))", _HALF))
def lines_smoothed(spark, sf):
    return lines.group_lines(_words(spark, sf), "smoothed")
