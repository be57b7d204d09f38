"""Reports on small labelled cases and odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageloom.operators import labels, records, reports

NAMES = ["O", "TITLE", "INGREDIENT_LINE", "INSTRUCTION_STEP"]
WORDS = "page_num long, word_idx int, label string, label_pred string"


def pairs(spark, true, pred):
    name = lambda x: None if x == "-" else NAMES[int(x)]
    return spark.createDataFrame([(1, i, name(t), name(p)) for i, (t, p) in enumerate(zip(true, pred, strict=True))], WORDS)


def plain(true, pred):
    ts, ps = [NAMES[int(x)] for x in true], [NAMES[int(x)] for x in pred]
    div = lambda a, b: a / b if b else 0.0
    f1 = lambda p, r: div(2 * p * r, p + r)
    inner = [(t, p) for t, p in zip(ts, ps, strict=True) if t != "O"]
    tp = sum(t == p for t, p in inner)
    p, r = div(tp, sum(q != "O" for _, q in inner)), div(tp, len(inner))
    each = {}
    for x in {*ts, *ps}:
        hit = sum(t == q == x for t, q in zip(ts, ps, strict=True))
        a, b = div(hit, ps.count(x)), div(hit, ts.count(x))
        each[x] = (a, b, f1(a, b), ts.count(x))
    n = len(ts)
    macro = [div(sum(v[k] for v in each.values()), len(each)) for k in range(3)]
    weighted = [div(sum(v[k] * v[3] for v in each.values()), n) for k in range(3)]
    right = div(sum(t == q for t, q in zip(ts, ps, strict=True)), n)
    return {"micro": (p, r, f1(p, r), len(inner)), "macro avg": (*macro, n), "weighted avg": (*weighted, n), "accuracy": (right, right, right, n)}, each


CASES = [("01230123", "01230123"), ("0000123", "0000231"), ("011223", "011333"), ("0123", "0133"), ("0000", "0000"), ("000", "111"), ("0011123333", "0011123333"), ("", "")]


@pytest.mark.parametrize(("true", "pred"), CASES)
def test_metrics(spark, true, pred):
    words = pairs(spark, true, pred)
    want, each = plain(true, pred)
    got = {r.scope: (r.precision_, r.recall_, r.f1, r.support) for r in reports.overall_metrics(words).collect()}
    assert got == {k: tuple(round(x, 6) for x in v) for k, v in want.items()}
    assert {r.label: (r.precision_, r.recall_, r.f1, r.support) for r in labels.token_metrics(words).collect()} == {k: tuple(round(x, 6) for x in v) for k, v in each.items()}
    text = [r.line for r in reports.metrics_markdown(words, NAMES).orderBy("line_no").collect()]
    assert text[1] == f"Precision: {want['micro'][0]:.3f}" and len(text) == 6 + len(each)
    csv = [r.line for r in reports.confusion_csv(words, NAMES).orderBy("line_no").collect()]
    seen = [x for x in NAMES if x in each]
    count = Counter(zip(true, pred, strict=True))
    rows = [",".join([t, *(str(count[str(NAMES.index(t)), str(NAMES.index(p))]) for p in seen)]) for t in seen]
    assert csv == ([",".join(["", *seen]), *rows] if seen else [])
    wrong = sorted(((-n, int(t), int(p)) for (t, p), n in count.items() if t != p))[:2]
    assert sorted((-r.n, NAMES.index(r.label), NAMES.index(r.label_pred)) for r in reports.top_confusions(words, NAMES, 2).collect()) == wrong


def test_null_labels_do_not_count(spark):
    got = {r.scope: r.support for r in reports.overall_metrics(pairs(spark, "01-1", "0-11")).collect()}
    assert got == {"micro": 1, "macro avg": 2, "weighted avg": 2, "accuracy": 2}


def test_splits(spark):
    rows = [(1, "train"), (1, "train"), (2, "test"), (2, "train"), (3, None), (None, "test"), (None, "train")]
    splits = spark.createDataFrame(rows, "page_num long, split string")
    assert {r.page_num: r.splits for r in reports.split_overlaps(splits).collect()} == {2: ["test", "train"], None: ["test", "train"]}
    assert tuple(reports.check_splits(splits, ["train", "validation"]).first()) == ("validation", 2, 7, False)
    assert tuple(reports.check_splits(splits.where("page_num = 1"), ["train"]).first()) == ("", 0, 2, True)
    assert tuple(reports.check_splits(splits.limit(0), ["train"]).first()) == ("train", 0, 0, False)


def test_encoded_pages(spark):
    words = spark.createDataFrame([(1, 0, "O", None), (1, 1, "TITLE", None), (2, 0, "ODD", None), (2, 1, "O", None), (3, 0, None, None)], WORDS)
    assert {(r.page_num, r.word_idx): r.label_id for r in reports.encode_pages(words, NAMES).collect()} == {(1, 0): 0, (1, 1): 1}
    assert {(r.page_num, r.word_idx): r.label_id for r in reports.encode_pages(words, NAMES, "O").collect()} == {(1, 0): 0, (1, 1): 1, (2, 0): 0, (2, 1): 0, (3, 0): 0}
    assert reports.encode_pages(words.limit(0), NAMES).count() == 0


def test_titles(spark):
    rows = [(1, "How to make Tea.", 4, "a"), (2, "Green TEA", 2, "a"), (3, "Tea", 1, "b"), (4, "Cake.", 1, "b"), (5, "", 0, "b"), (6, None, None, None), (7, "cake... pie", 2, "a")]
    titles = spark.createDataFrame(rows, "page_num long, title string, n_words int, book string")
    assert {r.page_num: r.pattern for r in reports.title_classes(titles).collect()} == {1: "how to", 2: "described kind", 3: "kind", 4: "none", 5: "none", 6: "none", 7: "none"}
    assert tuple(reports.title_lengths(titles.where("n_words > 0")).first()) == (1, 4, 2.0, 1)
    count = Counter(w.lower().rstrip(".") for _, t, *_ in rows if t for w in t.split())
    assert [(r.word, r.n) for r in reports.common_title_words(titles, 3).collect()] == sorted(count.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert {r.word: r.n for r in reports.heavy_title_words(titles, "book", 0.2).collect()} == {w: n for w, n in count.items() if n >= 0.2 * sum(count.values())}
    assert reports.common_title_words(titles.limit(0)).count() == 0


def test_heavy_words_beyond_what_a_sketch_tracks(spark):
    """A thousand rare words in sketches of 64: the frequent ones are found, over by no more than the stated bound."""
    rows = [(k, f"rare{k} big" if k % 4 == 0 else f"rare{k} other{k % 3}", k % 5) for k in range(1000)]
    titles = spark.createDataFrame(rows, "page_num long, title string, day int")
    true = Counter(w for _, t, _ in rows for w in t.split())
    got = {r.word: r.n for r in reports.heavy_title_words(titles, "day", 0.1, 64).collect()}
    assert {w for w, n in true.items() if n >= 200} <= set(got)
    assert all(n - true[w] <= 3.5 / 64 * 2000 for w, n in got.items())


STATS = "id string, page_num int, ingredient int, instruction int, title int"


@pytest.mark.parametrize(
    ("counts", "n", "want"),
    [([(1, 50, 10), (2, 10, 50), (3, 30, 30), (4, 0, 60), (5, 60, 0)], 3, {2, 3, 4}), ([(100, 20, 20), (50, 20, 20), (75, 20, 20)], 2, {100, 75}), ([(1, 100, 0), (2, 0, 67)], 1, {2})],
)
def test_pages_by_blended_count(spark, counts, n, want):
    table = spark.createDataFrame([(str(p), p, a, b, 0) for p, a, b in counts], STATS)
    assert {r.page_num for r in labels.rank_pages_blended(table, n).collect()} == want
    assert labels.rank_pages_blended(table, 10).count() == len(counts)


def test_versions(spark):
    rows = [("a", True, ["title"]), ("a", True, []), ("a", False, []), ("b", True, ["title", "ingredients"]), (None, False, None)]
    table = spark.createDataFrame(rows, "version string, corrected boolean, changes array<string>")
    got = {r.version: tuple(r)[1:] for r in reports.corrections_by_version(table).collect()}
    assert got == {"a": (3, 2, 1, 0.333333, 1, 0, 0), "b": (1, 1, 1, 1.0, 1, 1, 0), None: (1, 0, 0, 0.0, 0, 0, 0)}
    assert reports.header_statistics(spark.createDataFrame([(1, "O"), (2, "RECIPE_TITLE"), (2, None)], "page_num int, label_v3 string")).where(F.col("has_labels")).first().page_num == 2


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_places_of_pages(spark, width):
    rows = [(p, ["train", "test", None][p % 7 % 3]) for p in range(0, 400, 3)]
    splits = spark.createDataFrame(rows, "page_num long, split string").repartition(5)
    wanted = spark.createDataFrame([(p,) for p in (0, 9, 9, 33, 300, 399, 1000)], "page_num long")
    places = {p: sum(q < p for q, t in rows if t == s) for p, s in rows}
    assert {r.page_num: (r.split, r.place) for r in records.page_lookup(splits, wanted, width).collect()} == {p: (dict(rows)[p], places[p]) for p in (0, 9, 33, 300, 399)}
