"""Report queries: metrics as a whole, confusions, splits, corrections by version, patterns of titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import evaluation, reports
from pageloom.operators.labels import LABELS_V2

from .evaluation import TITLES
from .extraction import _CORRECTED, _corrected
from .queries import _IN, _SPLIT, TOK, _words, query, split_random

c = F.col
_METRICS = TOK + """, cm AS (SELECT label, label_pred, count(*) AS n FROM tok GROUP BY ALL),
ov AS (SELECT coalesce(sum(n) FILTER (label <> 'O' AND label = label_pred), 0) AS tp, coalesce(sum(n) FILTER (label <> 'O' AND label_pred <> 'O'), 0) AS pr, coalesce(sum(n) FILTER (label <> 'O'), 0) AS tr, coalesce(sum(n) FILTER (label = label_pred), 0) AS ok, sum(n) AS nn FROM cm),
mi AS (SELECT *, tp / nullif(pr, 0) AS p, tp / nullif(tr, 0) AS r FROM ov),
lt AS (SELECT label, sum(n) AS support, sum(n) FILTER (label = label_pred) AS tp FROM cm GROUP BY label), lp AS (SELECT label_pred AS label, sum(n) AS predicted FROM cm GROUP BY 1),
le AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM lt FULL JOIN lp USING (label)),
lm AS (SELECT label, support, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM le), lf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM lm),
al AS (SELECT 'micro' AS scope, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, tr AS support FROM mi UNION ALL SELECT 'accuracy', ok / nn, ok / nn, ok / nn, nn FROM ov
 UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM lf UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM lf)
"""


@query(_METRICS + "SELECT scope, round(p, 6) AS precision_, round(r, 6) AS recall_, round(f, 6) AS f1, support::BIGINT AS support FROM al")
def token_metrics_overall(spark, sf):
    return reports.overall_metrics(_words(spark, sf))


@query(_METRICS + f""", mk AS (SELECT p, r, f FROM al WHERE scope = 'micro'), hd AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS line_no, unnest(['# Token classification report', 'Precision: ' || printf('%.3f', round(p, 6)), 'Recall: ' || printf('%.3f', round(r, 6)), 'F1: ' || printf('%.3f', round(f, 6)), '', '## Per-label']) AS line FROM mk)
SELECT line_no::INT AS line_no, line FROM hd UNION ALL SELECT (5 + row_number() OVER (ORDER BY list_position({_IN(LABELS_V2)}, label)))::INT, '- ' || label || ': P=' || printf('%.3f', round(p, 6)) || ', R=' || printf('%.3f', round(r, 6)) || ', F1=' || printf('%.3f', round(f, 6)) || ', support=' || support::BIGINT FROM lf""")
def metric_report_markdown(spark, sf):
    return reports.metrics_markdown(_words(spark, sf), LABELS_V2)


@query(_METRICS + f""", nm AS (SELECT label, list_position({_IN(LABELS_V2)}, label) AS spot FROM le), cells AS (SELECT a.label AS t, a.spot AS ta, b.spot AS pa, coalesce(n, 0)::BIGINT AS n FROM nm a CROSS JOIN nm b LEFT JOIN cm ON cm.label = a.label AND cm.label_pred = b.label)
SELECT 0 AS line_no, ',' || string_agg(label, ',' ORDER BY spot) AS line FROM nm UNION ALL SELECT (dense_rank() OVER (ORDER BY ta))::INT, line FROM (SELECT ta, t || ',' || string_agg(n::VARCHAR, ',' ORDER BY pa) AS line FROM cells GROUP BY ta, t)""")
def confusion_csv(spark, sf):
    return reports.confusion_csv(_words(spark, sf), LABELS_V2)


@query(_METRICS + f"SELECT label, label_pred, n FROM cm WHERE label <> label_pred ORDER BY n DESC, list_position({_IN(LABELS_V2)}, label), list_position({_IN(LABELS_V2)}, label_pred) LIMIT 5")
def top_confusions(spark, sf):
    return reports.top_confusions(_words(spark, sf), LABELS_V2)


_LEAKY = f"lk AS ({_SPLIT} UNION ALL SELECT doc_id, 'validation' FROM documents WHERE doc_id % 50 = 0)"


def _leaky(spark, sf):
    """The random split, with every 50th page in the validation split once more."""
    again = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 50 = 0").select(c("doc_id").alias("page_num"), F.lit("validation").alias("split"))
    return split_random(spark, sf).unionByName(again)


@query(f"WITH {_LEAKY} SELECT page_num, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM lk GROUP BY page_num HAVING count(DISTINCT split) > 1")
def split_overlaps(spark, sf):
    return reports.split_overlaps(_leaky(spark, sf)).select("page_num", F.array_join("splits", ",").alias("splits"))


@query(f"WITH {_LEAKY}, o AS (SELECT count(*) AS k FROM (SELECT page_num FROM lk GROUP BY 1 HAVING count(DISTINCT split) > 1)) SELECT 'holdout' AS missing, k AS overlapping, (SELECT count(*) FROM lk) AS n, false AS ok FROM o")
def split_check(spark, sf):
    return reports.check_splits(_leaky(spark, sf), ["train", "validation", "test", "holdout"])


@query(_CORRECTED + ", v AS (SELECT *, 'v' || (page_num % 3) AS version FROM ap) SELECT version, count(*) AS pages, count(*) FILTER (corrected) AS corrected, count(*) FILTER (changes <> '') AS changed, round(count(*) FILTER (changes <> '') / count(*), 6) AS rate, count(*) FILTER (changes LIKE '%title%') AS title_changed, count(*) FILTER (changes LIKE '%ingredients%') AS ingredients_changed, count(*) FILTER (changes LIKE '%instructions%') AS instructions_changed FROM v GROUP BY version")
def corrections_by_version(spark, sf):
    return reports.corrections_by_version(_corrected(spark, sf).withColumn("version", F.concat(F.lit("v"), c("page_num") % 3)))


_V3 = "v3 AS (SELECT *, CASE WHEN label = 'TITLE' THEN 'RECIPE_TITLE' WHEN label = 'TIME' THEN 'SECTION_HEADER' WHEN label = 'O' AND line0 = 0 THEN 'PAGE_HEADER' ELSE label END AS label_v3 FROM tok)"


@query(TOK + f", {_V3} SELECT page_num, count(*) AS tokens, count(*) FILTER (label_v3 <> 'O') AS non_o, count(*) FILTER (label_v3 <> 'O') / count(*) AS non_o_ratio, count(*) FILTER (label_v3 <> 'O') > 0 AS has_labels, count(*) FILTER (label_v3 = 'PAGE_HEADER') AS page_header_count, count(*) FILTER (label_v3 = 'SECTION_HEADER') AS section_header_count, count(*) FILTER (label_v3 = 'RECIPE_TITLE') AS recipe_title_count, count(*) FILTER (label_v3 = 'INGREDIENT_LINE') AS ingredient_count, count(*) FILTER (label_v3 = 'INSTRUCTION_STEP') AS instruction_count FROM v3 GROUP BY page_num")
def header_statistics(spark, sf):
    """Times stand for section headers, other words of the first line for page headers."""
    new = F.when(c("label") == "TITLE", "RECIPE_TITLE").when(c("label") == "TIME", "SECTION_HEADER").when((c("label") == "O") & (c("line0") == 0), "PAGE_HEADER").otherwise(c("label"))
    return reports.header_statistics(_words(spark, sf).withColumn("label_v3", new))


_KNOWN = [x for x in LABELS_V2 if x != "TIME"]


@query(TOK + f"SELECT page_num, word_idx, list_position({_IN(_KNOWN)}, label) - 1 AS label_id FROM tok WHERE page_num NOT IN (SELECT page_num FROM tok WHERE label = 'TIME')")
def encode_pages(spark, sf):
    """TIME is unknown here, so pages that have it go."""
    return reports.encode_pages(_words(spark, sf), _KNOWN).select("page_num", "word_idx", "label_id")


@query(TOK + f"SELECT page_num, word_idx, coalesce(list_position({_IN(_KNOWN)}, label), list_position({_IN(_KNOWN)}, 'O')) - 1 AS label_id FROM tok")
def encode_pages_v3(spark, sf):
    """TIME is unknown here, and taken for O."""
    return reports.encode_pages(_words(spark, sf), _KNOWN, "O").select("page_num", "word_idx", "label_id")


_LONG = TITLES + ", tb AS (SELECT tt.*, source AS book FROM tt JOIN documents ON doc_id = page_num), tw AS (SELECT regexp_replace(unnest(string_split_regex(lower(title), '\\s+')), '\\.+$', '') AS word FROM tt)"


def _titles(spark, sf):
    return evaluation.titles(_words(spark, sf))


@query(_LONG + ", n AS (SELECT n_words, count(*) AS k FROM tt GROUP BY 1) SELECT min(n_words) AS least, max(n_words) AS most, round(sum(n_words * k) / sum(k), 6) AS mean, (SELECT n_words FROM n ORDER BY k DESC, n_words LIMIT 1) AS mode FROM n")
def title_lengths(spark, sf):
    return reports.title_lengths(_titles(spark, sf))


@query(_LONG + f", k AS (SELECT *, len(list_intersect(string_split_regex(lower(title), '\\s+'), {_IN(reports.KINDS)})) > 0 AS kind FROM tt) SELECT page_num, CASE WHEN lower(title) LIKE 'how to%' THEN 'how to' WHEN kind AND n_words > 1 THEN 'described kind' WHEN kind THEN 'kind' ELSE 'none' END AS pattern FROM k")
def title_classes(spark, sf):
    return reports.title_classes(_titles(spark, sf)).select("page_num", "pattern")


@query(_LONG + " SELECT word, count(*) AS n FROM tw WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10")
def common_title_words(spark, sf):
    return reports.common_title_words(_titles(spark, sf))


@query(_LONG + ", n AS (SELECT word, count(*) AS n FROM tw WHERE word <> '' GROUP BY word) SELECT word, n FROM n WHERE n >= 0.01 * (SELECT sum(n) FROM n)")
def heavy_title_words(spark, sf):
    """Sketches by book, combined."""
    book = spark.read.parquet(f"{sf}/documents.parquet").select(c("doc_id").alias("page_num"), c("source").alias("book"))
    return reports.heavy_title_words(_titles(spark, sf).join(book, "page_num"), "book")
