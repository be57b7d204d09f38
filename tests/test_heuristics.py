"""Runs of heuristics, vocabularies as tables and the title chain on small cases with known results."""

from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import extraction, heuristics, labels, records, rules, selection, vocabularies

WORDS = "page_num long, line_id long, word_idx int, word string, label string, x0 int, y0 int, x1 int, y1 int, conf int, height int"


def _page(spark, page, lines, tags=None, height=1000, top=300):
    """Lines of words, each line 40 below the one before."""
    rows, k = [], 0
    for n, line in enumerate(lines):
        for x, w in enumerate(line.split()):
            y = top + 40 * n
            rows.append((page, n, k, w, tags[k] if tags else "O", 60 * x, y, 60 * x + 50, y + 20, 90, height))
            k += 1
    return spark.createDataFrame(rows, WORDS)


def _predicates(words):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ")
    return rules.quantity_predicates(words.groupBy("page_num", "line_id").agg(text.alias("line_text"), F.min("y0").alias("by0"), F.first("height").alias("height")))


def test_ingredient_runs_count_and_can_be_dry(spark):
    words = _page(spark, 1, ["1 cup sugar"])
    found = rules.label_ingredient_block(words, _predicates(words))
    counters = heuristics.change_counters(found)
    assert [tuple(r) for r in counters.collect()] == [(1, 3, 1)]
    assert {r.label for r in heuristics.applied(found, dry_run=True).collect()} == {"O"}
    assert {r.label for r in heuristics.applied(found).collect()} == {"INGREDIENT_LINE"}
    kept = _page(spark, 2, ["1 cup sugar"], ["TITLE", "O", "INGREDIENT_LINE"])
    both = found.unionByName(rules.label_ingredient_block(kept, _predicates(kept)))
    n = heuristics.change_counters(both)
    assert sorted(tuple(r) for r in n.collect()) == [(1, 3, 1), (2, 1, 1)]
    assert heuristics.run_statistics(n).first().asDict() == {"pages": 2, "pages_changed": 2, "tokens_added": 4, "lines_labelled": 2, "least": 1, "most": 3, "mean": 2.0}
    assert [r.page_num for r in heuristics.most_changed_pages(n, 1).collect()] == [1]
    nothing = heuristics.run_statistics(n.limit(0)).first()
    assert (nothing.pages, nothing.tokens_added, nothing.least, nothing["mean"]) == (0, 0, None, None)


def test_instruction_runs_need_ingredients(spark):
    lines, labels = ["1 cup sugar and salt", "Serve cold", "Very good"], ["INGREDIENT_LINE"] * 5 + ["TITLE", "O", "O", "O"]
    rich = _page(spark, 1, lines, labels)
    poor = _page(spark, 2, lines, ["O"] + labels[1:])
    both = rich.unionByName(poor)
    run = heuristics.label_instruction_run(both, _predicates(both))
    got = {r.page_num: (r.gated, r.tokens_added, r.lines_labelled) for r in heuristics.instruction_counters(run).collect()}
    assert got == {1: (False, 4, 2), 2: (True, 0, 0)}
    assert [r.new_label for r in run.where("page_num = 1").orderBy("word_idx").collect()] == ["INGREDIENT_LINE"] * 5 + ["INSTRUCTION_STEP"] * 4
    assert run.where("page_num = 2 AND NOT new_label <=> label").count() == 0


def test_vocabulary_versions(spark):
    rows = [("t", "bred", "bread", 1), ("t", "bred", "breed", 2), ("t", "tost", "toast", 1), ("t", "tost", None, 2), ("u", "bred", "other", 1), ("t", None, "x", 1), ("t", "same", "b", 1), ("t", "same", "a", 1)]
    entries = spark.createDataFrame(rows, "kind string, word string, stands_for string, version int")
    at = lambda v: {r.word: r.stands_for for r in vocabularies.vocabulary_at(entries, "t", v).collect()}
    assert at(1) == {"bred": "bread", "tost": "toast", "same": "a"}
    assert at(None) == at(2) == {"bred": "breed", "same": "a"}
    assert at(0) == {}


def test_corrections_by_a_table(spark):
    texts = ["Hot bred, and  tost.", "bred bred bred", "", " \n ", None, "Bred", "new!word new!"] + ["bred tost"] * 50
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "id int, t string, Text_Hash int")
    words = dict(T.TITLE_WORDS)
    for more in ({}, {"new": "old"}):  # an added word changes results
        table = vocabularies.vocabulary_at(vocabularies.fixed_vocabulary(spark, words | more, "t"), "t")
        want = [r.c for r in df.select("id", T.corrected(F.col("t"), words | more).alias("c")).orderBy("id").collect()]
        for most in (1000, 0):  # broadcast and shuffled
            got = vocabularies.correct_texts(df, "t", table, "c", most).orderBy("id")
            assert got.columns == ["id", "t", "Text_Hash", "c"]
            assert [r.c for r in got.collect()] == want
        assert want[6] == ("new!word old!" if more else "new!word new!")
    assert [r.c for r in vocabularies.correct_texts(df, "t", table.limit(0), "c").orderBy("id").limit(2).collect()] == ["Hot bred, and tost.", "bred bred bred"]
    assert vocabularies.correct_texts(df.limit(0), "t", table, "c").count() == 0


def test_vocabulary_hits(spark):
    words = _page(spark, 1, ["1 Cup of cups", "Mix well"])
    table = lambda more: vocabularies.vocabulary_at(vocabularies.fixed_vocabulary(spark, {"cup": "unit", "mix": "verb"} | more, "p"), "p")
    count = lambda t: {r.stands_for: r.n for r in vocabularies.vocabulary_hits(words, t).collect()}
    assert count(table({})) == {"unit": 1, "verb": 1}
    assert count(table({"cups": "unit"})) == {"unit": 2, "verb": 1}


def test_recipes_take_the_title_chain(spark):
    steps = ["Apple Pie.", "1 cup sugar", "Bake well."]
    label = ["TITLE", "TITLE", "INGREDIENT_LINE", "INGREDIENT_LINE", "INGREDIENT_LINE", "INSTRUCTION_STEP", "INSTRUCTION_STEP"]
    by_label = _page(spark, 1, steps, label)
    low = _page(spark, 2, steps, label, top=420)  # labels too low on the page, and no heuristic title there
    unlabelled = _page(spark, 3, ["Chese Tost.", "plain words"])
    other = _page(spark, 4, ["Apple Pie.", "x", "x", "x", "x", "Low Words"], ["O", "O", "O", "O", "O", "O", "TITLE", "TITLE"])
    nothing = _page(spark, 5, ["plain words"])
    words = by_label.unionByName(low).unionByName(unlabelled).unionByName(other).unionByName(nothing)
    got = {r.page_num: r for r in extraction.extract_recipe(words).collect()}
    assert {k: (r.title, r.title_by, r.conf_title) for k, r in got.items()} == {
        1: ("Apple Pie.", "model", 0.9), 2: ("Apple Pie.", "model", 0.9), 3: ("Cheese Toast.", "heuristic", 0.5), 4: ("Apple Pie.", "heuristic", 0.5), 5: ("", None, 0.0)
    }
    assert (got[1].ingredients, got[1].instructions, got[1].conf_overall) == (["1 cup sugar"], ["Bake well."], 0.9)
    assert (got[3].ingredients, got[3].conf_overall, got[5].conf_overall) == ([], 0.5, 0.0)
    assert extraction.extract_recipe(words.limit(0)).count() == 0


def test_confidence_chain(spark):
    recipes = spark.createDataFrame([(1, 0.5, None), (2, None, None), (3, None, None), (4, 0.4, 0.8)], "page_num long, a double, b double")
    tokens = spark.createDataFrame([(2, 0.2), (2, None), (4, 0.1)], "page_num long, conf double")
    got = {r.page_num: (r.overall_confidence, r.confidence_from) for r in extraction.confidence_chain(recipes, ["a", "b"], tokens).collect()}
    assert got == {1: (0.5, "fields"), 2: (0.1, "tokens"), 3: (0.85, "default"), 4: (0.6, "fields")}


def test_featured_pages_fall_back(spark):
    rows = [(1, 0.2, False), (2, 0.5, True), (3, 0.9, True), (4, 0.9, True), (5, 0.99, None)]
    scored = spark.createDataFrame(rows, "page_num long, recipe_confidence double, is_recipe_page boolean")
    show = lambda df: [(r["rank"], r.page_num, r.recipe_confidence, r.status, r.default_page) for r in df.orderBy("rank").collect()]
    assert show(selection.featured(scored)) == [(1, 3, 0.9, "ok", 3), (2, 4, 0.9, "ok", 3), (3, 2, 0.5, "ok", 3)]
    assert show(selection.featured(scored.where("page_num IN (1, 5)"))) == [(1, 1, 0.0, "degraded", 1), (2, 5, 0.0, "degraded", 1)]
    assert show(selection.featured(scored.limit(0))) == []


def test_best_pages_are_cut_before_the_shuffle(spark):
    words = spark.createDataFrame([(p, "A" if k < p % 7 else "B") for p in range(40) for k in range(7)], "page_num long, label_pred string")
    best = selection.best_pages_by_label(words, ["A", "C"], 3)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.label, r["rank"], r.page_num, r.n) for r in best.collect())
    assert got == [("A", 1, 6, 6), ("A", 2, 13, 6), ("A", 3, 20, 6), ("C", 1, 0, 0), ("C", 2, 1, 0), ("C", 3, 2, 0)]


def test_first_pieces(spark):
    rows = [(1, 0, 1, "a", 5), (1, 0, 0, "b", 1), (1, 0, 0, "c", 3), (1, None, 2, None, None), (2, 0, 4, "d", None)]
    got = labels.words_to_first_piece(spark.createDataFrame(rows, "page_num long, word_idx long, pos long, label_pred string, conf int"))
    assert got.columns == ["page_num", "word_idx", "pos", "label_pred", "conf"]
    assert {(r.page_num, r.word_idx): (r.pos, r.label_pred, r.conf) for r in got.collect()} == {(1, 0): (0, "c", 3), (1, None): (2, None, None), (2, 0): (4, "d", None)}


def test_records_of_several_shapes(spark):
    texts = [
        '{"title": "A", "ingredients": ["x", "y"], "instructions": null, "servings": 4, "prepTime": "5", "prep_time": "6", "confidence": {"title": 0.5}}',
        '{"prep_time": 6, "confidence": 3, "ingredients": "none"}', "[1]", "{", None, "",
    ]
    got = records.upgrade_recipes(spark.createDataFrame([(k, t, "t") for k, t in enumerate(texts)], "id int, value string, source string")).orderBy("id").collect()
    a, b = got[0], got[1]
    assert (a.source, a.title, a.ingredients, a.instructions, a.servings, a.prep_time, a.conf_title, a.conf_overall) == ("t", "A", ["x", "y"], [], "4", "5", 0.5, None)
    assert (b.title, b.ingredients, b.servings, b.prep_time, b.conf_title, b.conf_overall) == ("", [], None, "6", 0.9, 0.9)
    assert [(r.readable, r.title, r.ingredients, r.conf_title) for r in got[2:]] == [(False, None, None, None)] * 4
