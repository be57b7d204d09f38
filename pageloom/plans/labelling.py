"""Rule labels and block labels as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import lines, rules, scoring

from .queries import _IN, LINES, _words, query

FACTS = LINES + rf""",
lt AS (SELECT page_num, line_id, string_agg(word, ' ' ORDER BY x0, word_idx) AS line_text, min(y0) AS by0 FROM ln GROUP BY page_num, line_id),
lf0 AS (SELECT lt.*, height, list_filter(string_split_regex(regexp_replace(line_text, '{rules.PUNCTUATION}', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS tokens FROM lt JOIN page USING (page_num)),
lf AS (SELECT *, len(tokens) AS n_tok, upper(line_text[1]) = line_text[1] AND lower(line_text[1]) <> line_text[1] AS first_upper, upper(line_text) = line_text AND lower(line_text) <> line_text AS all_caps, by0 / height AS y_pos,
  len(list_filter(tokens, lambda t: regexp_matches(t, '^\d+(/\d+)?$'))) > 0 AS quantity, list_has_any(list_transform(tokens, lambda t: lower(t)), {_IN(scoring.UNITS)}) AS unit,
  regexp_matches(lower(line_text), '{rules.PREP}') AS prep, coalesce(list_contains({_IN(scoring.VERBS)}, lower(tokens[1])), false) AS verb_first,
  len(list_filter(tokens, lambda t: list_contains({_IN(scoring.VERBS)}, lower(t)))) AS verb_hits, regexp_matches(line_text, '\.\s*$') AS sentence_end,
  regexp_matches(lower(line_text), '{scoring.TIME}') AS time_hit, regexp_matches(lower(line_text), '{scoring.TEMP}') AS temp_hit, regexp_matches(lower(line_text), '{rules.SERVINGS}') AS servings_hit, regexp_matches(lower(line_text), '{rules.NOTE}') AS note_start FROM lf0)
"""
_one = lambda x: "+".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for of, _, w, c in rules.RULES if of == x) or "0"
SCORES = FACTS + ", sc AS (SELECT *, " + ", ".join(f"{_one(x)} + {'CASE WHEN n_tok <= 1 THEN -10 ELSE 0 END' if x != 'O' else '0'} AS score_{x.lower()}" for x in rules.ORDER) + " FROM lf)"
_keys = ",".join(f"(score_{x.lower()} + 1000) * 10 + {7 - k}" for k, x in enumerate(rules.ORDER))
_sig = " ".join(
    f"WHEN '{x}' THEN concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{s}' END" for of, s, _, c in rules.RULES if of == x and s) + ", CASE WHEN n_tok <= 1 THEN 'very_short' END)" for x in rules.ORDER[:-1]
)
LABELLED = SCORES + f""", bk AS (SELECT *, greatest({_keys}) AS bkey FROM sc),
ll AS (SELECT *, {_IN(rules.ORDER)}[8 - bkey % 10] AS line_label, 1 / (1 + exp(-3 * (bkey // 10 - 1000) / 100)) AS line_conf FROM bk),
tl AS (SELECT ln.page_num, ln.line_id, word_idx, line_label, line_conf, least(1.0::DOUBLE, line_conf + 0.2::DOUBLE * conf / 100) AS token_conf FROM ln JOIN ll USING (page_num, line_id))
"""
PREDS = FACTS + rf""", pr AS (SELECT page_num, line_id, line_text, length(line_text) >= 2 AND regexp_matches(line_text, '{rules.QUANTITY_START}') AS quantity_line, length(line_text) >= 3 AND regexp_matches(lower(line_text), '{rules.QUANTITY_UNIT}') AS quantity_unit,
 length(line_text) >= 3 AND regexp_matches(lower(line_text), '{rules.opening_verb(rules.END_VERBS)}') AS ends_block, length(line_text) >= 3 AND regexp_matches(lower(line_text), '{rules.opening_verb(rules.STEP_VERBS)}') AS step_line, length(trim(line_text)) < 50 AND by0 / height < 0.15 AS title_area FROM lf),
b0 AS (SELECT page_num, min(line_id) AS block_start FROM pr WHERE NOT title_area AND (quantity_line OR quantity_unit) GROUP BY page_num),
blk AS (SELECT page_num, any_value(block_start) AS block_start, coalesce(min(line_id) FILTER (ends_block AND line_id > block_start), max(line_id) + 1) AS block_end FROM pr JOIN b0 USING (page_num) GROUP BY page_num)
"""


def _lines(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """The lines of each page with their words, in one pass over the words."""
    return lines.nested_lines(lines.lines_gap(_words(spark, sf)), keep)


def _score(label: str):
    name = label.split("_")[0].lower()

    def run(spark, sf):
        return rules.rule_scores(rules.line_facts(_lines(spark, sf))).select("page_num", "line_id", (F.col(f"score_{label.lower()}") / 100).alias("score"))

    run.__name__ = f"score_{name}"
    query(SCORES + f"SELECT page_num, line_id, score_{label.lower()} / 100 AS score FROM sc")(run)


for _label in rules.ORDER[:-1]:
    _score(_label)


@query(LABELLED + f"SELECT page_num, line_id, line_label, round(line_conf, 6) AS line_conf, CASE line_label {_sig} ELSE '' END AS signals FROM ll")
def label_lines(spark, sf):
    return rules.label_lines(_lines(spark, sf)).select("page_num", "line_id", "line_label", F.round("line_conf", 6).alias("line_conf"), F.array_join("signals", ",").alias("signals"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return rules.labels_of_words(rules.label_lines(_lines(spark, sf, "conf")))


@query(LABELLED + "SELECT page_num, word_idx, line_label AS token_label, round(token_conf, 6) AS token_conf FROM tl")
def assign_token_labels(spark, sf):
    return _labelled(spark, sf).select("page_num", "word_idx", F.col("line_label").alias("token_label"), F.round("token_conf", 6).alias("token_conf"))


QUALITY = LABELLED + ", lq AS (SELECT page_num, round(avg(line_conf), 6) AS avg_line_confidence FROM ll GROUP BY page_num), tq AS (SELECT page_num, round(avg(token_conf), 6) AS avg_token_confidence, round(avg((line_label <> 'O')::INT), 6) AS coverage, count(*) FILTER (line_label = 'INGREDIENT_LINE') AS ing, count(*) FILTER (line_label = 'INSTRUCTION_STEP') AS ins FROM tl GROUP BY page_num)"


@query(QUALITY + "SELECT page_num, avg_line_confidence, avg_token_confidence, coverage FROM lq JOIN tq USING (page_num)")
def page_label_quality(spark, sf):
    return rules.page_label_quality(_labelled(spark, sf))


@query(QUALITY + "SELECT page_num FROM lq JOIN tq USING (page_num) WHERE avg_line_confidence >= 0.6 AND ing >= 3 AND ins >= 3")
def filter_highconf(spark, sf):
    t = rules.page_label_quality(_labelled(spark, sf), ("INGREDIENT_LINE", "INSTRUCTION_STEP"))
    return t.where("avg_line_confidence >= 0.6 AND n_ingredient_line >= 3 AND n_instruction_step >= 3").select("page_num")


@query(LABELLED + "SELECT page_num, count(*) AS n_words, string_agg(line_label, ',' ORDER BY word_idx) AS token_labels FROM tl WHERE page_num IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY page_num")
def weak_label_pages(spark, sf):
    candidates = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("page_num"))
    ordered = F.sort_array(F.collect_list(F.struct("word_idx", "line_label")))
    return _labelled(spark, sf).join(candidates, "page_num", "left_semi").groupBy("page_num").agg(F.count("*").alias("n_words"), F.array_join(F.transform(ordered, lambda x: x["line_label"]), ",").alias("token_labels"))


@query(PREDS + "SELECT page_num, line_id, quantity_line, quantity_unit, ends_block, step_line, title_area FROM pr")
def quantity_predicates(spark, sf):
    return rules.quantity_predicates(_lines(spark, sf)).select("page_num", "line_id", "quantity_line", "quantity_unit", "ends_block", "step_line", "title_area")


@query(PREDS + "SELECT page_num, word_idx, CASE WHEN label = 'O' AND line_id >= block_start AND line_id < block_end AND length(line_text) >= 3 THEN 'INGREDIENT_LINE' ELSE label END AS new_label FROM ln JOIN pr USING (page_num, line_id) LEFT JOIN blk USING (page_num)")
def label_ingredient_block(spark, sf):
    return rules.block_words(rules.quantity_predicates(_lines(spark, sf, "label"))).select("page_num", "word_idx", "new_label")


@query(PREDS + """, last AS (SELECT page_num, max(word_idx) FILTER (label = 'INGREDIENT_LINE') AS li FROM tok GROUP BY page_num), ls AS (SELECT page_num, line_id, min(word_idx) AS st FROM ln GROUP BY ALL)
SELECT page_num, word_idx, CASE WHEN length(line_text) >= 3 AND ((label = 'O' AND (step_line OR coalesce(st > li, false))) OR (label = 'TITLE' AND coalesce(st > li, false))) THEN 'INSTRUCTION_STEP' ELSE label END AS new_label FROM ln JOIN pr USING (page_num, line_id) JOIN last USING (page_num) JOIN ls USING (page_num, line_id)""")
def label_instruction_lines(spark, sf):
    return rules.step_words(rules.quantity_predicates(_lines(spark, sf, "label"))).select("page_num", "word_idx", "new_label")
