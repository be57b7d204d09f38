"""Runs of the labelling heuristics as queries."""

from __future__ import annotations

from pageloom.operators import heuristics, rules

from .labelling import PREDS, _lines
from .queries import query

_BLOCK = PREDS + """, hb AS (SELECT ln.page_num, ln.line_id, coalesce(label = 'O' AND line_id >= block_start AND line_id < block_end AND length(line_text) >= 3, false) AS hit FROM ln JOIN pr USING (page_num, line_id) LEFT JOIN blk USING (page_num)),
cnt AS (SELECT page_num, count(*) FILTER (hit) AS tokens_added, count(DISTINCT line_id) FILTER (hit) AS lines_labelled FROM hb GROUP BY page_num)
"""
_STEPS = PREDS + """, last AS (SELECT page_num, max(word_idx) FILTER (label = 'INGREDIENT_LINE') AS li, count(*) FILTER (label = 'INGREDIENT_LINE') < 5 AS gated FROM tok GROUP BY page_num), ls AS (SELECT page_num, line_id, min(word_idx) AS st FROM ln GROUP BY ALL),
mk AS (SELECT page_num, line_id, word_idx, label, gated, NOT gated AND length(line_text) >= 3 AND (step_line OR coalesce(st > li, false)) AS marked, coalesce(st > li, false) AS after FROM ln JOIN pr USING (page_num, line_id) JOIN last USING (page_num) JOIN ls USING (page_num, line_id)),
nl AS (SELECT *, marked AND (label = 'O' OR after AND label = 'TITLE') AS hit FROM mk),
lc AS (SELECT page_num, line_id, any_value(gated) AS gated, bool_or(marked) AS marked, count(*) FILTER (hit) AS n FROM nl GROUP BY page_num, line_id),
cu AS (SELECT *, sum(n) OVER (PARTITION BY page_num ORDER BY line_id) AS seen FROM lc),
cnt AS (SELECT page_num, any_value(gated) AS gated, sum(n)::BIGINT AS tokens_added, count(*) FILTER (marked AND seen > 0) AS lines_labelled FROM cu GROUP BY page_num)
"""
_REPORT = "SELECT count(*) AS pages, count(*) FILTER (tokens_added > 0) AS pages_changed, coalesce(sum(tokens_added), 0)::BIGINT AS tokens_added, coalesce(sum(lines_labelled), 0)::BIGINT AS lines_labelled, min(tokens_added) FILTER (tokens_added > 0) AS least, max(tokens_added) FILTER (tokens_added > 0) AS most, round(avg(tokens_added) FILTER (tokens_added > 0), 6) AS mean FROM cnt"


def _block(spark, sf):
    return heuristics.change_counters(rules.block_words(rules.quantity_predicates(_lines(spark, sf, "label"))))


def _steps(spark, sf):
    return rules.step_words(rules.quantity_predicates(_lines(spark, sf, "label")), ingredients=5)


@query(_BLOCK + "SELECT page_num, tokens_added, lines_labelled FROM cnt")
def ingredient_block_counters(spark, sf):
    return _block(spark, sf)


@query(_BLOCK + _REPORT)
def ingredient_block_report(spark, sf):
    return heuristics.run_statistics(_block(spark, sf))


@query(_BLOCK + "SELECT page_num, tokens_added, lines_labelled FROM cnt WHERE tokens_added > 0 ORDER BY tokens_added DESC, page_num LIMIT 10")
def ingredient_block_top_pages(spark, sf):
    return heuristics.most_changed_pages(_block(spark, sf))


@query(_STEPS + "SELECT page_num, word_idx, gated, CASE WHEN hit THEN 'INSTRUCTION_STEP' ELSE label END AS label FROM nl")
def instruction_line_run(spark, sf):
    """Only pages with five ingredient words or more are labelled."""
    return heuristics.applied(_steps(spark, sf)).select("page_num", "word_idx", "gated", "label")


@query(_STEPS + "SELECT page_num, gated, tokens_added, lines_labelled FROM cnt")
def instruction_line_counters(spark, sf):
    return heuristics.instruction_counters(_steps(spark, sf))


@query(_STEPS + _REPORT)
def instruction_line_report(spark, sf):
    return heuristics.run_statistics(heuristics.instruction_counters(_steps(spark, sf)))
