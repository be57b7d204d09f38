"""Titles and section headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import titles

from .queries import TOK, _IN, _words, query

_CAPS = r"(NOT regexp_matches(w, '^\p{L}+$') OR (regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}')))"
#: Runs of n to m words in a row: names are formatted in.
_RUNS = """ahead AS (SELECT t.page_num, page.height, word_idx AS s, list(word) OVER w AS ws, list(y0) OVER w AS ys FROM tok t JOIN page USING (page_num) WINDOW w AS (PARTITION BY t.page_num ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
runs AS (SELECT page_num, height, s, n, s + n AS e, ws[1:n] AS run, array_to_string(ws[1:n], ' ') AS txt, list_sum(ys[1:n]) / n / height * 100 AS y FROM ahead, unnest(range(2, 7)) AS u(n) WHERE n <= len(ws))"""
#: On every other page the first words are a header in capitals, which the tables lack.
HEADED = TOK.replace("ELSE raw END AS word", "ELSE CASE WHEN page_num % 2 = 0 AND word_idx < 3 THEN ['BREAD', 'AND', 'MAKING'][word_idx + 1] ELSE raw END END AS word")
_HEAD = HEADED + ", " + _RUNS + rf""",
hd AS (SELECT * FROM runs WHERE s < 50 AND y <= 5 AND len(list_filter(run, lambda w: NOT {_CAPS})) = 0 AND list_has_any(run, {_IN(titles.CONNECTORS)})),
head AS (SELECT page_num, s AS "start", e AS "end", txt AS header FROM (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY s, n) AS r FROM hd) WHERE r = 1)
"""


def _foods(marks: str) -> str:
    return f"len(list_filter(run, lambda w: list_contains({_IN(titles.FOOD)}, regexp_replace(lower(w), '[{marks}]+$', ''))))"


_V1 = HEADED + ", " + _RUNS + rf""",
ing AS (SELECT page_num, word_idx AS i FROM tok WHERE label = 'INGREDIENT_LINE'),
c1 AS (SELECT *, CASE WHEN len(list_filter(run, lambda w: NOT {_CAPS})) = 0 AND list_has_any(run, {_IN(titles.CONNECTORS_V1)}) THEN -10 ELSE 0 END + CASE WHEN lower(txt) LIKE 'how to%' THEN 10 ELSE 0 END
  + 5 * {_foods('.,')} + CASE WHEN txt LIKE '%.' THEN 3 ELSE 0 END + CASE WHEN y < 10 THEN 5 WHEN y < 20 THEN 2 ELSE 0 END + CASE WHEN n <= 4 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(run[1], '^\p{{Lu}}') THEN 1 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM ing WHERE ing.page_num = runs.page_num AND i >= e AND i < e + 50) THEN 3 ELSE 0 END - CASE WHEN regexp_matches(run[1], '^\d{{1,3}}$') THEN 5 ELSE 0 END AS score
  FROM runs WHERE n <= 5 AND y <= 30 AND NOT regexp_matches(lower(txt), '{'|'.join(titles.NOT_TITLES)}')),
t1_ AS (SELECT page_num, s AS "start", e AS "end", txt AS title, score FROM (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY y < 5, score DESC, s, n) AS r FROM c1 WHERE score >= 10) WHERE r = 1)
"""
_V2 = _HEAD + rf""",
b AS (SELECT page_num, count(*) AS n_words, nullif(min(word_idx) FILTER (label = 'INGREDIENT_LINE'), 0) AS ing FROM tok GROUP BY page_num),
c2 AS (SELECT runs.*, CASE WHEN lower(txt) LIKE 'how to%' THEN 15 ELSE 0 END + 5 * {_foods('.,;:')} + CASE WHEN txt LIKE '%.' THEN 3 ELSE 0 END + CASE WHEN y <= 15 THEN 5 WHEN y <= 20 THEN 2 ELSE 0 END + CASE WHEN n <= 4 THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(run[1], '^\p{{Lu}}') THEN 1 ELSE 0 END + CASE WHEN head."end" IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN e < ing THEN 3 ELSE 0 END AS score
  FROM runs JOIN b USING (page_num) LEFT JOIN head USING (page_num)
  WHERE n <= 5 AND y BETWEEN 5 AND 30 AND s >= coalesce(head."end", 0) AND e <= coalesce(ing, least(n_words, 150)) AND len(list_filter(run, lambda w: NOT {_CAPS})) > 0),
t2_ AS (SELECT page_num, s AS "start", e AS "end", txt AS title, score FROM (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY score DESC, s, n) AS r FROM c2 WHERE score >= 12) WHERE r = 1)
"""


def headed(spark, sf):
    words = F.element_at(F.array(*map(F.lit, ("BREAD", "AND", "MAKING"))), F.col("word_idx") + 1)
    return _words(spark, sf).withColumn("word", F.when((F.col("page_num") % 2 == 0) & (F.col("word_idx") < 3), words).otherwise(F.col("word")))


@query(_HEAD + 'SELECT page_num, "start", "end", header FROM head')
def detect_section_header(spark, sf):
    return titles.detect_section_header(headed(spark, sf))


@query(_V1 + 'SELECT page_num, "start", "end", title, score FROM t1_')
def detect_title_v1(spark, sf):
    return titles.detect_title_v1(headed(spark, sf))


@query(_V2 + 'SELECT page_num, "start", "end", title, score FROM t2_')
def detect_title_v2(spark, sf):
    w = headed(spark, sf)
    return titles.detect_title_v2(w, titles.detect_section_header(w))


@query(_V2 + """SELECT label_v3, count(*) AS n, count(DISTINCT page_num) AS pages FROM (SELECT tok.page_num, CASE WHEN word_idx >= t2_."start" AND word_idx < t2_."end" THEN 'RECIPE_TITLE' WHEN word_idx >= head."start" AND word_idx < head."end" THEN 'SECTION_HEADER' ELSE label END AS label_v3
 FROM tok LEFT JOIN head USING (page_num) LEFT JOIN t2_ USING (page_num)) GROUP BY label_v3""")
def apply_title_labels(spark, sf):
    w = headed(spark, sf)
    headers = titles.detect_section_header(w)
    out = titles.apply_title_labels(w, headers, titles.detect_title_v2(w, headers))
    return out.groupBy("label_v3").agg(F.count("*").alias("n"), F.countDistinct("page_num").alias("pages"))


def _map(words: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"


def _fixed(text: str, words: dict[str, str]) -> str:
    """SQL for T.corrected."""
    bare = "regexp_replace(w, '[.,;:!?]+$', '')"
    return f"array_to_string(list_transform(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> ''), lambda w: coalesce({_map(words)}[{bare}] || substr(w, length({bare}) + 1), w)), ' ')"


_QUOTES = T.QUOTES.replace("'", "''")


def _clean(text: str) -> str:
    plain = f"trim(trim({text}), '{_QUOTES}')"
    return _fixed(f"regexp_replace(trim(regexp_replace({plain}, '\\s+', ' ', 'g')), '\\s+([.,;:])', '\\1', 'g')", T.TITLE_WORDS)


_HEURISTIC = rf"""
cand AS (SELECT page_num, list({{'x0': x0, 'i': word_idx, 'y0': y0, 'x1': x1, 'y1': y1, 'w': word, 'm': (y0 + y1) / 2}} ORDER BY y0, x0, word_idx) AS l FROM tok
  WHERE y0 > 50 AND y0 < 400 AND length(word) > 1 AND regexp_matches(word, '^[\p{{Lu}}(]') AND NOT list_contains({_IN(titles.STEP_STARTS)}, word) GROUP BY page_num),
fold AS (SELECT page_num, list_reduce(list_transform(l, lambda x: {{'line': [x], 'total': x.m, 'done': false}}), lambda a, b:
  CASE WHEN a.done THEN a
   WHEN abs(b.total - a.total / len(a.line)) <= 12 THEN {{'line': list_concat(a.line, b.line), 'total': a.total + b.total, 'done': b.line[1].w LIKE '%.' OR len(a.line) >= 7}}
   WHEN len(a.line) >= 2 AND len(list_filter(a.line, lambda x: x.w LIKE '%.')) > 0 THEN {{'line': a.line, 'total': a.total, 'done': true}}
   ELSE b END).line AS line FROM cand),
h AS (SELECT page_num, list_sort(line) AS line FROM fold WHERE len(line) >= 2),
ht AS (SELECT page_num, {_clean("array_to_string(list_transform(line, lambda x: x.w), ' ')")} AS title, len(line) AS n_tokens, list_min(list_transform(line, lambda x: x.x0)) AS tx0, list_min(list_transform(line, lambda x: x.y0)) AS ty0,
  list_max(list_transform(line, lambda x: x.x1)) AS tx1, list_max(list_transform(line, lambda x: x.y1)) AS ty1, 0.5::DOUBLE AS conf FROM h)
"""


@query(TOK + "," + _HEURISTIC + "SELECT * FROM ht")
def extract_title_heuristic(spark, sf):
    return titles.extract_title_heuristic(_words(spark, sf))


def title_chain(labelled: str) -> str:
    """SQL for extract_title: xt, a title for each page, from the words of tok that a condition calls labelled, or from ht."""
    return _HEURISTIC + f""",
lab AS (SELECT *, (y0 + y1) / 2 AS mid, count(*) FILTER (y0 < 350) OVER (PARTITION BY page_num) AS up FROM tok WHERE {labelled}),
kept AS (SELECT *, first_value(mid) OVER (PARTITION BY page_num ORDER BY word_idx) AS mid1 FROM lab WHERE y0 < 350 OR up = 0),
on_line AS (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY x0, word_idx) AS nth, coalesce(bool_or(word LIKE '%.') OVER (PARTITION BY page_num ORDER BY x0, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM kept WHERE abs(mid - mid1) <= 12),
mt AS (SELECT page_num, any_value(up) AS up, {_clean("string_agg(word, ' ' ORDER BY x0, word_idx)")} AS title, count(*) AS n_tokens, min(x0) AS tx0, min(y0) AS ty0, max(x1) AS tx1, max(y1) AS ty1, avg(conf) / 100 AS conf FROM on_line WHERE NOT over AND nth <= 8 GROUP BY page_num),
xt AS (SELECT page_num, title, n_tokens, tx0, ty0, tx1, ty1, conf, 'model' AS by FROM mt WHERE NOT ((up = 0 OR up >= 8) AND page_num IN (SELECT page_num FROM ht))
 UNION ALL SELECT page_num, title, n_tokens, tx0, ty0, tx1, ty1, conf, 'heuristic' FROM ht WHERE page_num NOT IN (SELECT page_num FROM mt WHERE NOT (up = 0 OR up >= 8)))
"""


@query(TOK + "," + title_chain("label = 'INSTRUCTION_STEP' AND page_num % 3 > 0 OR label = 'TITLE' AND page_num % 3 = 0") + "SELECT * FROM xt")
def extract_title(spark, sf):
    """Title labels of every third page; elsewhere steps stand for titles, so that crowded and low ones occur."""
    c = F.col
    label = F.when((c("page_num") % 3 > 0) & (c("label") == "INSTRUCTION_STEP"), "RECIPE_TITLE").when((c("page_num") % 3 == 0) & (c("label") == "TITLE"), "RECIPE_TITLE").otherwise("O")
    return titles.extract_title(_words(spark, sf).withColumn("label", label))


@query(f"SELECT doc_id, {_fixed('text', T.TITLE_WORDS)} AS corrected FROM (SELECT doc_id, replace(replace(coalesce(text, ''), 'the ', 'chese, '), 'de ', 'Mlk. ') AS text FROM documents)")
def correct_title(spark, sf):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("the "), F.lit("chese, ")), F.lit("de "), F.lit("Mlk. "))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.correct_title(text).alias("corrected"))


@query(f"SELECT doc_id, {_fixed('text', T.INGREDIENT_WORDS)} AS corrected FROM (SELECT doc_id, replace(replace(coalesce(text, ''), 'the ', 'sngar; '), 'de ', 'Loup ') AS text FROM documents)")
def correct_ingredient(spark, sf):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("the "), F.lit("sngar; ")), F.lit("de "), F.lit("Loup "))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.correct_ingredient(text).alias("corrected"))


_ID = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(t)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"""


@query(rf"SELECT doc_id, {_ID} AS slug FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 60) AS t FROM documents)")
def slugify(spark, sf):
    """Slugs of the first 60 characters, the titles of this query."""
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.slug(F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("slug"))


@query(rf"""SELECT p_partkey, CASE WHEN t = '' THEN 'recipe-' || p_partkey WHEN {_ID} = '' THEN 'recipe' ELSE {_ID} END || '-p' || lpad(p_partkey::VARCHAR, greatest(4, length(p_partkey::VARCHAR))::INT, '0') AS recipe_id
 FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '!?' ELSE p_name END AS t FROM part)""")
def make_recipe_id(spark, sf):
    """Some names are made empty or plain punctuation, for the two fallbacks."""
    title = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, "!?").otherwise(F.col("p_name"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", T.recipe_id(title, F.col("p_partkey")).alias("recipe_id"))
