"""Folds without SQL, on small cases against plain loops."""

import re
import time
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import alignment, relabel, spans
from pageloom.plans import records as records_plans
from pageloom.plans.extraction import _recipes
from pageloom.plans.queries import _words
from pageloom.sources import readers


def norm(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip()


def brute_span(text, words, start):
    target = norm(text).split()
    best = (-1, -1, 0.0)
    for i in range(start, len(words)):
        for n in range(max(1, len(target) - 2), min(len(target) + 3, len(words) - i) + 1):
            a, b = set(target), set(norm(" ".join(words[i : i + n])).split())
            score = len(a & b) / max(len(a), len(b)) if a and b else 0.0
            if score > best[2]:
                best = (i, i + n, score)
    return best if best[2] >= 0.7 else None


def test_curated_labels(spark):
    r = np.random.default_rng(4)
    pool = ["Mix", "flour,", "two", "cups", "of", "the", "milk.", "bake", "Cake", "slow", "(hot)"]
    pages, fields = {}, {}
    for p in range(6):
        pages[p] = [str(x) for x in r.choice(pool, 40)]
        at = sorted(int(x) for x in r.integers(0, 34, 4))
        fields[p] = [" ".join(pages[p][a : a + 5]) if k != 2 else "nothing like it here" for k, a in enumerate(at)] + ["", " . "]
    words = spark.createDataFrame([(p, i, w) for p, ws in pages.items() for i, w in enumerate(ws)], "page_num long, word_idx int, word string")
    rows = spark.createDataFrame([(p, k, "TITLE" if k == 0 else "INGREDIENT_LINE", t) for p, ts in fields.items() for k, t in enumerate(ts)], "page_num long, field_no int, label string, text string")
    got = {x.page_num: x for x in alignment.curated_labels(words, rows).collect()}
    for p, ts in fields.items():
        cursor, want = 0, []
        for k, t in enumerate(ts):
            hit = brute_span(t, pages[p], cursor) if norm(t) else None
            if hit:
                want.append((hit[0], hit[1], "TITLE" if k == 0 else "INGREDIENT_LINE", round(hit[2], 9)))
                cursor = hit[1]
        assert [(s.start, s.end, s.label, round(s.score, 9)) for s in got[p].spans] == want
        assert got[p].coverage == len(want) / len(ts)
        assert [(m.field_no, m.matched) for m in got[p].matches] == [(k, any(k2 == k for k2 in found)) for k in range(len(ts)) for found in [found_fields(ts, pages[p])]]
        labels = ["O"] * len(pages[p])
        for start, end, label, _ in want:
            labels[start:end] = [label] * (end - start)
        assert got[p].labels == labels
    assert alignment.curated_labels(words, rows.limit(0)).count() == 0
    assert alignment.curated_labels(words.limit(0), rows).count() == 0
    odd = rows.unionByName(spark.createDataFrame([(0, 90, "O", None), (99, 0, "TITLE", "no page"), (None, 0, "TITLE", "x")], rows.schema))
    again = {x.page_num: x for x in alignment.curated_labels(words, odd).collect()}
    assert set(again) == set(pages) and again[0].spans == got[0].spans and not again[0].matches[-1].matched
    kept = alignment.curated_labels(words, rows, least_coverage=0.5)
    assert {x.page_num for x in kept.collect()} == {p for p in pages if got[p].coverage >= 0.5}
    stats = {x.label: x for x in alignment.match_statistics(alignment.curated_labels(words, rows)).collect()}
    assert stats["INGREDIENT_LINE"].fields == sum(len(ts) - 1 for ts in fields.values())
    summary = alignment.coverage_summary(alignment.curated_labels(words, rows), 0.5).first()
    assert (summary.pages, summary.kept + summary.skipped) == (6, 6) and summary.least == min(x.coverage for x in got.values())


def found_fields(texts, words):
    cursor, out = 0, []
    for k, t in enumerate(texts):
        hit = brute_span(t, words, cursor) if norm(t) else None
        if hit:
            out.append(k)
            cursor = hit[1]
    return out


def test_best_run_is_that_of_all_runs():
    r = np.random.default_rng(8)
    for _ in range(300):
        words = [norm(x) for x in r.choice(["a", "b", "c", "d e", "...", "f", "a b c"], int(r.integers(0, 200)))]
        text = " ".join(r.choice(["a", "b", "c", "d", "e", "zz"], int(r.integers(1, 9))))
        cursor = int(r.integers(0, len(words) + 1))
        want = brute_span(text, words, cursor)
        got = spans.PageIndex(words).best(text.split(), cursor, 0.7)
        assert got == want


def test_a_long_page_takes_little_time():
    words = [f"w{k % 50}" for k in range(20_020)]
    index, begin = spans.PageIndex(words), time.process_time()
    for k in range(200):
        assert index.best(words[k * 90 : k * 90 + 6], 0, 0.7)[2] == 1.0
        assert index.best([f"w{k % 50}", "x", "y"], 0, 0.7) is None
    assert time.process_time() - begin < 20


def test_curated_query(spark):
    """The query's rows on short pages, against loops over the words and recipes that it reads."""
    sf = "/root/testdata/sf0.001"
    short = {p: sorted((w.word_idx, w.word) for w in ws) for p, ws in groupby(sorted(_words(spark, sf).collect(), key=lambda w: w.page_num), lambda w: w.page_num) for ws in [list(ws)] if len(ws) < 120}
    got = {x.page_num: x for x in records_plans.curated_labels(spark, sf).collect()}
    checked = 0
    for x in _recipes(spark, sf).collect():
        if x.page_num in short:
            texts = [t for t in [x.title, *x.ingredients, *x.instructions] if t]
            if texts:
                found = found_fields(texts, [w for _, w in short[x.page_num]])
                assert (got[x.page_num].n_fields, got[x.page_num].n_found) == (len(texts), len(found))
                checked += 1
    assert checked > 20


def likeness(a, b):
    a, b = ({w for w in re.sub(r"[^a-z0-9\s]", "", x.lower()).split() if w} for x in (a, b))
    return 1.0 if not a and not b else len(a & b) / ((len(a) + len(b)) / 2)


def test_diff_lines(spark):
    curated = {1: ["two cups flour", "one egg", "salt", "bake it slowly now"], 2: ["a b"], 3: []}
    found = {1: ["one egg.", "bake it now", "two cups of flour", "left over"], 2: [], 3: ["extra"]}
    table = lambda d: spark.createDataFrame([(p, i, t) for p, ts in d.items() for i, t in enumerate(ts)], "page_num long, line_no int, text string")
    got = {tuple(x) for x in alignment.diff_lines(table(curated), table(found)).collect()}
    want = set()
    for p in curated:
        used = set()
        for i, t in enumerate(curated[p]):
            free = [(-likeness(t, f), j) for j, f in enumerate(found[p]) if j not in used]
            s, j = min(free) if free else (0, None)
            if s < 0:
                used.add(j)
                want.add((p, i, j, "match" if s <= -0.95 else "mismatch", -s))
            else:
                want.add((p, i, None, "missing", 0.0))
        want |= {(p, None, j, "extra", None) for j in range(len(found[p])) if j not in used}
    assert got == want


def test_readers(spark, tmp_path):
    folder = tmp_path / "recipes"
    folder.mkdir()
    (folder / "a-p0001.json").write_text('{\n "id": "a-p0001", "title": "A", "source": {"page": 1}, "ingredients": ["x"]\n}')
    (folder / "b.json").write_text('{"id": "b", "title": "B"}')
    (folder / "index.json").write_text('{"id": "index", "source": {"page": 9}}')
    (folder / "broken.json").write_text("{")
    assert [(r.id, r.file) for r in readers.scan_recipes_dir(spark, str(folder)).collect()] == [("a-p0001", "a-p0001.json")]
    (tmp_path / "c.csv").write_text("image_path,page_num,recipe_score\np,1,0.9\nq,2,0.2\nr,x,0.9\ns,3,0.5\n")
    assert {r.page_num for r in readers.scan_candidates_csv(spark, str(tmp_path / "c.csv")).collect()} == {1, 3}
    box = '{"type": "rectanglelabels", "value": {"x": 10, "y": 50, "width": 20, "height": 5, "rectanglelabels": ["TITLE"]}}'
    (tmp_path / "a.json").write_text(f'[{{"data": {{"page_num": 7, "width": 200, "height": 100}}, "annotations": [{{"result": []}}, {{"result": [{{"type": "choices"}}, {box}]}}]}}, {{"data": {{"page_num": 8}}, "annotations": []}}]')
    assert [tuple(r) for r in readers.scan_annotations(spark, str(tmp_path / "a.json")).collect()] == [(7, 1, "TITLE", 20.0, 50.0, 60.0, 55.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  “Chlcken, tost.” ",), ("",), ("x_y Don't -- Stop!",)], "t string")
    rows = df.select(T.correct_title(T.strip_quotes(F.col("t"))).alias("a"), T.slug(F.col("t")).alias("b"), T.title_key(F.col("t")).alias("c"), T.comparable(F.col("t")).alias("d")).collect()
    assert [r.a for r in rows] == ["Chicken, toast.", "", "x_y Don't -- Stop!"]
    assert rows[2].b == "x-y-dont-stop" and rows[2].c == "x_y don't -- stop" and rows[2].d == "xy dont stop"
    assert relabel.label_column(df.withColumnRenamed("t", "ner_tags")).columns == ["ner_tags", "labels"]
    ids = spark.createDataFrame([("", 12), ("A b!", 12345), ("!?", 3)], "t string, p long").select(T.recipe_id(F.col("t"), F.col("p")).alias("i"))
    assert [r.i for r in ids.collect()] == ["recipe-12-p0012", "a-b-p12345", "recipe-p0003"]
