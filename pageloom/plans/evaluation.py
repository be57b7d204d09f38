"""Evaluation and position queries. The tables' predictions differ from the labels on ingredient lines and O only, so queries about titles take those."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import evaluation, lines

from .queries import LINES, TOK, _words, query

KEY = "INGREDIENT_LINE"
_prf = lambda x: f"""round(coalesce(tp_{x} / nullif(p_{x}, 0), 0), 6) AS {x}_precision, round(coalesce(tp_{x} / nullif(t_{x}, 0), 0), 6) AS {x}_recall, round(coalesce(2 * tp_{x} / nullif(p_{x} + t_{x}, 0), 0), 6) AS {x}_f1"""
_cnt = lambda x: f"count(*) FILTER (label = '{x}' AND label_pred = '{x}') AS tp_{x.lower()}, count(*) FILTER (label = '{x}') AS t_{x.lower()}, count(*) FILTER (label_pred = '{x}') AS p_{x.lower()}"


@query(TOK + f""", c AS (SELECT {_cnt('TITLE')}, {_cnt('INGREDIENT_LINE')}, {_cnt('O')}, count(*) FILTER (label = 'O' AND label_pred = 'INGREDIENT_LINE') AS a, count(*) FILTER (label = 'INGREDIENT_LINE' AND label_pred = 'O') AS b, count(*) AS total_tokens FROM tok)
SELECT {_prf('title')}, {_prf('ingredient_line')}, {_prf('o')}, round(coalesce(a / nullif(t_o, 0), 0), 6) AS header_false_positive_rate, round(coalesce(b / nullif(t_ingredient_line, 0), 0), 6) AS title_false_negative_rate, a + b AS confusion_count, total_tokens FROM c""")
def header_metrics(spark, sf):
    return evaluation.header_metrics(_words(spark, sf), ["TITLE", KEY, "O"], "O", KEY)


BOTH = TOK + ", bx AS (SELECT page_num, " + ", ".join(f"{f}({c}) FILTER ({l} = '{KEY}') AS {n}{i}" for l, n in (("label", "a"), ("label_pred", "b")) for i, (f, c) in enumerate((("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1")))) + " FROM tok GROUP BY page_num)"  # noqa: E741, F541


@query(BOTH + """, i AS (SELECT *, greatest(0, least(a2, b2) - greatest(a0, b0)) * greatest(0, least(a3, b3) - greatest(a1, b1)) AS inter FROM bx WHERE a0 IS NOT NULL), j AS (SELECT coalesce(b0 IS NOT NULL AND inter / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - inter) >= 0.3, false) AS ok FROM i)
SELECT count(*) AS pages_with, count(*) FILTER (ok) AS pages_correct, round(coalesce(count(*) FILTER (ok) / nullif(count(*), 0), 0), 6) AS anchor_accuracy FROM j""")
def title_anchor_accuracy(spark, sf):
    return evaluation.anchor_accuracy(_words(spark, sf), KEY)


@query(TOK + f""", e AS (SELECT page_num, coalesce(list(DISTINCT word) FILTER (label = '{KEY}'), []) AS t, coalesce(list(DISTINCT word) FILTER (label_pred = '{KEY}'), []) AS p FROM tok GROUP BY page_num), o AS (SELECT page_num, len(t)::BIGINT AS n_true, len(p)::BIGINT AS n_pred, len(list_intersect(t, p))::BIGINT AS n_overlap FROM e)
SELECT *, CASE WHEN n_true = n_pred AND n_true = n_overlap THEN 'exact' WHEN n_overlap > 0 THEN 'partial' ELSE 'wrong' END AS verdict FROM o""")
def title_set_accuracy(spark, sf):
    return evaluation.set_accuracy(_words(spark, sf), KEY)


@query(TOK + "SELECT page_num, round(avg((label = label_pred)::INT), 6) AS accuracy FROM tok GROUP BY page_num ORDER BY accuracy, page_num LIMIT 5")
def worst_pages(spark, sf):
    return evaluation.worst_pages(_words(spark, sf))


@query(TOK + "SELECT page_num, label_pred, count(*) AS n_raw, round(avg(conf), 6) AS conf_raw, count(*) FILTER (conf >= 60) AS n_post, round(avg(conf) FILTER (conf >= 60), 6) AS conf_post FROM tok GROUP BY ALL")
def label_counts_raw_vs_post(spark, sf):
    return evaluation.label_counts_raw_vs_post(_words(spark, sf), F.col("conf") >= 60)


def _pieces(spark, sf):
    """Three words in a row stand for the pieces of one."""
    return evaluation.align_to_subwords(_words(spark, sf).select("page_num", F.floor(F.col("word_idx") / 3).alias("word_id"), F.col("word_idx").alias("pos"), "label"))


PIECES = TOK + ", pc AS (SELECT page_num, word_idx AS pos, CASE WHEN word_idx % 3 = 0 THEN label END AS piece_label FROM tok)"


@query(PIECES + "SELECT * FROM pc")
def align_labels_to_subwords(spark, sf):
    return _pieces(spark, sf).select("page_num", "pos", "piece_label")


@query(PIECES + """, g AS (SELECT page_num, count(*) AS n, count(piece_label) AS k, count(*) FILTER (piece_label <> 'O') AS m FROM pc GROUP BY page_num), s AS (SELECT sum(n) AS n, sum(k) AS k, sum(m) AS m, count(*) AS pages, count(*) FILTER (m > 0) AS lp FROM g)
SELECT CAST(n - k AS BIGINT) AS masked, CAST(k AS BIGINT) AS unmasked, round(coalesce(m / nullif(k, 0), 0), 6) AS non_o_ratio, pages, lp AS labelled_pages, concat_ws(',', CASE WHEN n - k > 0.95 * n THEN 'masked' END, CASE WHEN m < 0.01 * k THEN 'non_o' END, CASE WHEN lp < 0.1 * pages THEN 'examples' END) AS violations FROM s""")
def label_coverage_stats(spark, sf):
    return evaluation.label_coverage_stats(_pieces(spark, sf))


@query(PIECES + " SELECT piece_label, count(DISTINCT page_num) AS pages, count(DISTINCT page_num) / (SELECT count(DISTINCT page_num) FROM pc) AS share FROM pc WHERE piece_label IS NOT NULL GROUP BY piece_label")
def label_share_of_pages(spark, sf):
    return evaluation.label_share_of_pages(_pieces(spark, sf))


@query(TOK + "SELECT page_num, count(*) AS n_words, bool_or(label = 'TITLE') AS has_title, bool_or(label = 'INGREDIENT_LINE') AS has_ingredients, bool_or(label = 'INSTRUCTION_STEP') AS has_instructions FROM tok GROUP BY page_num")
def page_summary(spark, sf):
    return evaluation.page_summary(_words(spark, sf))


TITLES = TOK + ", tt AS (SELECT page_num, string_agg(word, ' ' ORDER BY word_idx) AS title, count(*) AS n_words FROM tok WHERE label = 'TITLE' GROUP BY page_num)"


@query(TITLES + """SELECT count(*) AS n_titles, min(n_words) AS min_words, max(n_words) AS max_words, round(avg(n_words), 6) AS avg_words, round(avg((title LIKE '%.')::INT), 6) AS ends_period, round(avg((upper(title) = title AND lower(title) <> title)::INT), 6) AS all_upper, round(avg((upper(title[1]) = title[1] AND lower(title[1]) <> title[1])::INT), 6) AS capital FROM tt""")
def title_patterns(spark, sf):
    return evaluation.title_patterns(evaluation.titles(_words(spark, sf)))


@query(TOK + """SELECT page_num, min(y0) AS title_y, round(min(y0) / any_value(height), 6) AS title_y_share, round(avg(y1 - y0), 6) AS title_height, min(x0) AS title_x0, max(x1) AS title_x1, round(avg(y1 - y0) / any_value(oh), 6) AS height_ratio
 FROM tok JOIN page USING (page_num) LEFT JOIN (SELECT page_num, avg(y1 - y0) AS oh FROM tok WHERE label <> 'TITLE' GROUP BY page_num) USING (page_num) WHERE label = 'TITLE' GROUP BY page_num""")
def title_geometry(spark, sf):
    return evaluation.title_geometry(_words(spark, sf))


@query(TOK + "SELECT page_num, word_idx, row_number() OVER w AS read_order, lead(y0) OVER w - y0 AS y_gap FROM tok WINDOW w AS (PARTITION BY page_num ORDER BY y0, x0, word_idx)")
def ordering_mix(spark, sf):
    return evaluation.reading_order(_words(spark, sf)).select("page_num", "word_idx", "read_order", "y_gap")


@query(TOK + "SELECT page_num, word_idx, word, word LIKE '%.' AS stop, lead(y0) OVER (PARTITION BY page_num ORDER BY y0, x0, word_idx) - y0 AS y_gap FROM tok WHERE label = 'TITLE'")
def title_token_inspection(spark, sf):
    return evaluation.reading_order(_words(spark, sf).where("label = 'TITLE'")).select("page_num", "word_idx", "word", F.col("word").endswith(".").alias("stop"), "y_gap")


@query(TOK + "SELECT t.book, d.lang, count(*) AS n_words, round(avg(conf), 6) AS mean_conf FROM tok t JOIN documents d ON d.doc_id = t.page_num GROUP BY ALL")
def ocr_config_compare(spark, sf):
    lang = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_num"), "lang")
    by_page = _words(spark, sf).groupBy("page_num", "book").agg(F.count("*").alias("n"), F.sum("conf").alias("s"))
    return by_page.join(lang, "page_num").groupBy("book", "lang").agg(F.sum("n").alias("n_words"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_conf"))


@query(TOK + "SELECT a.page_num, a.word_idx, EXISTS (SELECT 1 FROM tok b WHERE b.page_num = a.page_num AND b.label = 'INGREDIENT_LINE' AND b.y0 - a.y1 > 0 AND b.y0 - a.y1 < 150) AS is_near FROM tok a WHERE a.label = 'TITLE'")
def near_ingredients(spark, sf):
    return evaluation.near_ingredients(_words(spark, sf))


@query(TOK + ", mixed AS (SELECT DISTINCT page_num, y0 + y1 AS m FROM tok WHERE upper(word) <> word AND length(word) > 1) SELECT page_num, word_idx, word FROM tok a WHERE upper(word) = word AND NOT EXISTS (SELECT 1 FROM mixed b WHERE b.page_num = a.page_num AND abs(b.m - (a.y0 + a.y1)) < 40)")
def standalone_caps_line(spark, sf):
    return evaluation.standalone_caps(_words(spark, sf))


@query(TOK + ", s AS (SELECT *, CASE WHEN label = 'TITLE' AND coalesce(lag(label) OVER (PARTITION BY page_num ORDER BY y0, x0, word_idx), '') <> 'TITLE' THEN 1 ELSE 0 END AS st FROM tok) SELECT page_num, word_idx, CAST(sum(st) OVER (PARTITION BY page_num ORDER BY y0, x0, word_idx) AS BIGINT) AS section FROM s")
def neighbour_sections(spark, sf):
    return evaluation.sections_by_title(_words(spark, sf)).select("page_num", "word_idx", "section")


@query(LINES + f""", a0 AS (SELECT page_num, run, label, min(word_idx) AS ann_idx, min(x0) - 3 AS p0, min(y0) - 3 AS p1, max(x1) + 3 AS p2, max(y1) + 3 AS p3 FROM (SELECT *, sum(n) OVER (PARTITION BY page_num ORDER BY word_idx) AS run FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY page_num ORDER BY word_idx) THEN 0 ELSE 1 END AS n FROM tok)) GROUP BY ALL),
 l AS (SELECT page_num, line_id, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM ln GROUP BY ALL),
 pr AS (SELECT a.page_num, ann_idx, label, line_id, greatest(0, least(p2, bx1) - greatest(p0, bx0)) * greatest(0, least(p3, by1) - greatest(p1, by0)) AS inter, (p2 - p0) * (p3 - p1) + (bx1 - bx0) * (by1 - by0) AS areas FROM a0 a JOIN l ON a.page_num = l.page_num AND label <> 'O'),
 b AS (SELECT *, row_number() OVER (PARTITION BY page_num, ann_idx ORDER BY round(inter / (areas - inter), 9) DESC, line_id) AS r FROM pr WHERE inter > 0)
 SELECT page_num, line_id, arg_max(label, ann_idx) AS new_label FROM b WHERE r = 1 GROUP BY ALL""")
def match_annotations(spark, sf):
    """Annotations are the boxes, a little padded, of runs of equally labelled words."""
    w = _words(spark, sf)
    ann = lines.label_runs(w).where("label <> 'O'").groupBy("page_num", "run", F.col("label").alias("ann_label")).agg(
        F.min("word_idx").alias("ann_idx"), (F.min("x0") - 3).alias("p0"), (F.min("y0") - 3).alias("p1"), (F.max("x1") + 3).alias("p2"), (F.max("y1") + 3).alias("p3")
    )
    return evaluation.match_annotations(ann, lines.line_features(lines.lines_gap(w)))
