"""Pages without words: every table may hold some."""

import random
import re
import time

import duckdb
import pytest

import __spark_entry__ as entry
from pageloom.operators import titles

TEXTS = "(0, '', 'a'), (1, NULL, 'a'), (2, chr(9) || ' ' || chr(10), 'b'), (3, 'Mix', NULL), (4, 'INDEX of soups and 20 cakes', 'b'), (5, repeat('stir two cups of milk 30 min ', 9), 'a')"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder with six documents, of which three have no words, and a connection that sees its tables."""
    sf, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.execute(f"COPY (SELECT doc_id::BIGINT AS doc_id, text, 'en' AS lang, source, length(text) AS n_chars FROM (VALUES {TEXTS}) v(doc_id, text, source)) TO '{sf}/documents.parquet'")
    con.execute(f"COPY (SELECT doc_id::BIGINT AS doc_id, 1 AS quality, toxic FROM (VALUES (0, 1), (3, 0), (5, 1)) v(doc_id, toxic)) TO '{sf}/labels.parquet'")
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return str(sf), con


def check(spark, odd, name):
    sf, con = odd
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    show = lambda df: sorted("|".join(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(want.columns)].itertuples(index=False))
    assert show(got) == show(want)


@pytest.mark.parametrize("name", ["detect_pages", "incremental_rescore", "page_explain", "page_features", "report_top_markdown", "scan_candidates_csv", "stream_ingest_pages"])
def test_features_of_pages_without_words(spark, odd, name):
    check(spark, odd, name)


def test_pages_without_words_are_counted(spark, odd):
    check(spark, odd, "validate_service_tables")
    rows = {r.check_name: r.observed for r in entry.queries()["validate_service_tables"](spark, odd[0]).collect()}
    assert rows == {"pages": 6, "least_words": 0, "words_null": 0}


def _titles_v1(words):
    """detect_title_v1 of one page's (word, y0, label), height 100, run by run."""
    best = None
    for start in range(len(words)):
        for n in range(2, min(5, len(words) - start) + 1):
            run, end = [w for w, _, _ in words[start : start + n]], start + n
            title, y = " ".join(run), sum(y for _, y, _ in words[start:end]) / n
            if y > 30 or re.search("|".join(titles.NOT_TITLES), title.lower()):
                continue
            capital = all(not re.fullmatch("[A-Za-z]+", w) or w.isupper() for w in run)
            score = -10 * (capital and any(w in titles.CONNECTORS_V1 for w in run)) + 10 * title.lower().startswith("how to") + 5 * sum(w.lower().rstrip(".,") in titles.FOOD for w in run)
            score += 3 * title.endswith(".") + (5 if y < 10 else 2 if y < 20 else 0) + 2 * (n <= 4) + title[0].isupper() - 5 * bool(re.fullmatch(r"\d{1,3}", run[0]))
            score += 3 * any(label == "INGREDIENT_LINE" for _, _, label in words[end : end + 50])
            key = (y < 5, -score, start, n)
            if score >= titles.LEAST_V1 and (best is None or key < best[0]):
                best = (key, (start, end, title, score))
    return best and best[1]


def test_titles_of_words_in_any_place(spark):
    """Words lie high or low in no order, so that runs reach over words that are too low, and into the last ones."""
    random.seed(4)
    some = ["How", "to", "To", "how", "BREAD", "AND", "soup.", "Cake,", "page", "7", "milk", "Salt.", "Pie", "boston"]
    pages = {p: [(random.choice(some), random.choice([0, 3, 8, 15, 29, 31, 45, 90]), random.choice(["O"] * 30 + ["INGREDIENT_LINE"])) for _ in range(random.choice([1, 2, 4, 9, 40, 120]))] for p in range(150)}
    rows = [(p, 100, i, w, y, label) for p, words in pages.items() for i, (w, y, label) in enumerate(words)]
    words = spark.createDataFrame(rows, "page_num long, height int, word_idx int, word string, y0 int, label string")
    got = {r.page_num: (r.start, r.end, r.title, r.score) for r in titles.detect_title_v1(words).collect()}
    want = {p: _titles_v1(words) for p, words in pages.items()}
    assert got == {p: t for p, t in want.items() if t} and 50 < len(got) < 150


def test_titles_of_a_long_page(spark):
    """What lies ahead of a word is not gone through anew for each word."""
    words = spark.range(60000).selectExpr("1L AS page_num", "200000 AS height", "int(id) AS word_idx", "'Soup' AS word", "int(id) AS y0", "CASE WHEN id = 59999 THEN 'INGREDIENT_LINE' ELSE 'O' END AS label")
    begin = time.time()
    assert titles.detect_title_v1(words).count() == 1
    assert time.time() - begin < 15


@pytest.mark.parametrize("name", ["build_sections", "extract_recipe_simple", "sectioned_page", "validate_page_record"])
def test_a_page_is_made_of_one_pass(spark, odd, name):
    """Words are made and grouped to lines once, whatever is made of a page's lines."""
    check(spark, odd, name)
    plan = entry.queries()[name](spark, odd[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Join" not in plan
