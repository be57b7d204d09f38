"""Small cases of the findings of the third round."""

import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pageloom.operators import alignment, labeler, rules, scoring, selection


@pytest.fixture
def table(spark, tmp_path):
    def write(*docs):
        rows = [(i, text, "de", "web", len(text)) for i, text in docs]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", ["kinds_of_lines", "build_sections", "extract_recipe_simple", "sectioned_page", "validate_page_record", "lines_to_display", "detect_title_v1"])
def test_words_are_not_shuffled(spark, table, name):
    """Only documents are shuffled (by page), never the many more rows of words."""
    sf = table((1, "Ein Wort " * 40), (2, "drei"))
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all("doc_id" in line for line in shuffles), shuffles
    assert df.count() >= 0


def test_edges_of_words_are_ascii(spark):
    """120 für holds "120 f" at the edge of an ASCII word, as in SQL, whatever the JVM takes for a letter."""
    words = ["120", "für"]
    page = spark.createDataFrame([(1, "120 für", words, [50, 50])], "page_num int, text string, words array<string>, confidences array<int>")
    got = scoring.page_features(scoring.derive_page_fields(page)).first()
    assert got.temp_hit and not got.time_hit
    line = spark.createDataFrame([(1, 0, "120 für", 40, 130), (1, 1, "120 fx", 40, 130), (1, 2, "é350 f", 40, 130)], "page_num int, line_id int, line_text string, by0 int, height int")
    labels = {r.line_id: r.line_label for r in rules.label_lines(line).collect()}
    assert labels[0] == labels[2] == "TEMP" and labels[1] != "TEMP"
    likes = spark.range(1).select(selection.recipe_like(F.lit("cup éstir")).alias("edge"), selection.recipe_like(F.lit("cup xstir")).alias("none")).first()
    assert likes.edge and not likes.none


def test_page_of_ten_words_has_both_problems(spark, table):
    """An id of 9 is the tenth: a page that is one id too short still has it."""
    sf = table((35, " ".join("abcdefghij")), (70, " ".join("abcdefghi")))
    got = {(r.page_num, r.problem) for r in entry.queries()["validate_label_ids"](spark, sf).collect()}
    assert got == {(35, "id out of range"), (35, "length mismatch"), (70, "length mismatch")}


def test_lines_of_a_long_page_are_paired_fast(spark):
    """2,000 lines against 2,000: the fold that looked through all taken lines at each step took minutes."""
    rng = random.Random(3)
    line = lambda: "1 2 cup sugar " + " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(4)))
    rows = lambda: [(1, i, line()) for i in range(2000)]
    a, b = (spark.createDataFrame(rows(), "page_num long, line_no int, text string") for _ in range(2))
    begun = time.monotonic()
    got = alignment.diff_lines(a, b).collect()
    assert time.monotonic() - begun < 30
    found = [r.found_no for r in got if r.curated_no is not None]
    assert len(got) == 2000 and sorted(found) == list(range(2000))  # all share words, so each finds one


def test_lines_are_paired_as_by_looking_at_all(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(4)))
    rows = lambda: [(p, i, line()) for p in range(40) for i in range(rng.randrange(9))]
    a, b = rows(), rows()
    table = lambda x: spark.createDataFrame(x, "page_num long, line_no int, text string")
    want = set()
    for p in range(40):
        free = {i: set(t.split()) for q, i, t in b if q == p}
        for _, i, t in [x for x in a if x[0] == p]:
            w = set(t.split())
            scores = [(-(1.0 if not w and not f else len(w & f) / ((len(w) + len(f)) / 2)), j) for j, f in free.items()]
            s, j = min(scores, default=(0, None))
            want.add((p, i, j, "match" if s <= -0.95 else "mismatch", -s) if s < 0 else (p, i, None, "missing", 0.0))
            if s < 0:
                del free[j]
        want |= {(p, None, j, "extra", None) for j in free}
    assert {tuple(r) for r in alignment.diff_lines(table(a), table(b)).collect()} == want


def test_lexicon_is_hashed_once():
    """100 batches of few words against 200,000: a table built anew for each batch took many times longer."""
    n = 200_000
    model = labeler.lookup(pa.array([f"w{i}" for i in range(n)]), pa.array(["A"] * n), pa.array([0.5] * n))
    batch = pa.record_batch([pa.array(["w7", None, "other", "w199999", "w7"])], ["_key"])
    begun = time.monotonic()
    for _ in range(100):
        label, confidence = model(batch)
    assert time.monotonic() - begun < 1
    assert label.to_pylist() == ["A", "O", "O", "A", "A"] and confidence.to_pylist() == [0.5, 0.0, 0.0, 0.5, 0.5]


def test_workers_give_memory_back():
    """What Arrow's pool no longer uses goes back when a task's batches are done."""
    from pageloom.llm import common

    asked = []
    was, common.release = common.release, lambda: asked.append(1)
    try:
        assert list(common.released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and asked
    finally:
        common.release = was


def test_spans_of_many_tokens_are_as_in_sql(spark, table):
    """Five words of 12 to 20 tokens: SQL looks at runs of 14 words at most. Repeated words make early long runs as good."""
    rng = random.Random(9)
    docs = []
    for i in range(60):
        words = [rng.choice(["a", "b-c", "--", "d", "a", "e.f", "İx", "ΣΑΣ", "ß"]) for _ in range(60)]
        for k in (20, 21, 22, 24, 25):
            words[k] = "-".join(rng.choice("pqrstuvwxyz") for _ in range(rng.randrange(1, 6)))
        words[26:40] = words[8:22]
        docs.append((i, " ".join(words)))
    sf = table(*docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(entry.oracle_sql()["align_text_to_span"]).fetchall()}
    got = {tuple(r) for r in entry.queries()["align_text_to_span"](spark, sf).select("page_num", "text_id", "start", "end", "score").collect()}
    assert len(want) == 60 and got == want


@pytest.mark.parametrize(
    "name",
    ["filter_highconf", "assign_token_labels", "page_label_quality", "label_ingredient_block", "label_instruction_lines", "ingredient_block_counters", "ingredient_block_report", "ingredient_block_top_pages"]
    + ["instruction_line_run", "instruction_line_counters", "instruction_line_report"],
)
def test_words_are_gone_through_once(spark, table, name):
    """Lines hold their words, so that labels go from one to the other without a second pass over the words and a join."""
    sf = table((1, "Ein Wort " * 40), (2, "drei"))
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1 and "Join" not in plan, plan
    assert df.count() >= 0


@pytest.mark.parametrize("name", ["detect_title_v2", "apply_title_labels"])
def test_title_runs_are_made_of_few_words(spark, table, name):
    """Words outside a page's limits are left out before runs are made of them, and words aren't sorted to meet their page's row."""
    sf = table((1, "Ein Wort " * 40), (2, "BREAD AND drei vier fünf sechs Tea. acht"))
    df = entry.queries()[name](spark, sf)
    assert df.count() >= 0
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [k for k, line in enumerate(plan) if "collect_list" in line and "windowspecdefinition" in line and "-1" not in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = lambda k: plan[k + 1 : next((j for j in range(k + 1, len(plan)) if depth(plan[j]) <= depth(plan[k])), len(plan))]
    assert any("strategy=shuffle_hash" in x for k in made for x in below(k)), plan


def test_files_are_written_in_large_chunks(monkeypatch):
    """Known stems are hashed anew for each chunk: 6 MB of texts are one for files, where 2 MB were."""
    from pageloom.llm import tokens

    seen = []
    monkeypatch.setattr(tokens, "encode", lambda texts, *_: seen.append(len(texts)) or ([], []))
    batch = pa.record_batch([pa.array(range(6)), pa.array(["x" * (1 << 20)] * 6)], ["doc_id", "text"])
    list(tokens._chunks(batch, "", "bytes", 0, tokens.FILE_CHUNK))
    assert seen == [6]
