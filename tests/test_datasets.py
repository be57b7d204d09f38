"""Records, labellers and sessions on small cases: odd rows, loads of a model, restarts of a stream."""

import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.operators import dataset, labeler
from pageloom.sources import sinks
from pageloom.streaming import sessions

PAGE = "page_num long, width int, height int, words array<string>, bboxes array<array<int>>, labels array<string>, extra string"
KNOWN = ["TITLE", "INGREDIENT_LINE", "INSTRUCTION_STEP", "O"]
BOX = [10, 20, 30, 40]


def plain_records(pages, least):
    """What the rules say, page by page."""
    out, n = {}, {}
    bump = lambda k, by=1: n.__setitem__(k, n.get(k, 0) + by)
    for num, width, height, words, boxes, labels, _ in pages:
        words, boxes, labels = words or [], boxes or [], labels or []
        if not words or not boxes:
            out[num] = "empty"
            continue
        if not labels:
            bump("filled")
            labels = ["O"] * len(words)
        if len(words) != len(boxes) or len(words) != len(labels):
            out[num] = "mismatch"
        elif len(words) < least:
            out[num] = "short"
        else:
            bump("note", labels.count("NOTE"))
            labels = ["O" if x == "NOTE" else x for x in labels]
            if any(x not in KNOWN for x in labels):
                out[num] = "unknown"
            elif not width or width <= 0 or not height or height <= 0 or any(b is None or len(b) != 4 for b in boxes):
                out[num] = "bad_bbox"
            else:
                out[num] = [KNOWN.index(x) for x in labels]
    return out, n


@pytest.fixture(scope="module")
def pages():
    good = (["1", "cup", "sugar"], [BOX] * 3, ["TITLE", "O", "INGREDIENT_LINE"])
    return [
        (1, 100, 200, *good, "x"), (2, 100, 200, None, [BOX], ["O"], None), (3, 100, 200, [], [], [], "x"), (4, 100, 200, ["a"], None, ["O"], "x"),
        (5, 100, 200, ["a", "b"], [BOX] * 2, None, "x"), (6, 100, 200, ["a", "b"], [BOX], ["O", "O"], "x"), (7, 100, 200, ["a", "b"], [BOX] * 2, ["O"], "x"),
        (8, 100, 200, ["a"], [BOX], ["O"], "x"), (9, 100, 200, ["a", "b"], [BOX] * 2, ["NOTE", "TIME"], "x"), (10, 0, 200, ["a", "b"], [BOX] * 2, ["NOTE", "O"], "x"),
        (11, 100, None, ["a", "b"], [BOX] * 2, ["O", "O"], "x"), (12, 100, 200, ["a", "b"], [BOX, None], ["O", "O"], "x"), (13, 100, 200, ["a", "b"], [BOX] * 2, ["NOTE", None], "x"),
        (14, 100, 200, ["a", "b"], [[-5, 0, 300, 500], BOX], ["NOTE", "INSTRUCTION_STEP"], "x"), (1, 100, 200, *good, "x"),
    ]


def test_records(spark, pages, tmp_path):
    table = spark.createDataFrame(pages, PAGE)
    want, n = plain_records(pages, 2)
    got = dataset.process_records(table, KNOWN, least=2).collect()
    assert len(got) == len(pages)
    assert {r.page_num: r.drop_reason or r.label_ids for r in got} == want
    assert sum(r.filled for r in got) == n["filled"] and sum(r.collapsed for r in got) == n["note"]
    clamped = next(r for r in got if r.page_num == 14)
    assert clamped.boxes[0] == [0, 0, 1000, 1000] and clamped.boxes[1] == [100, 100, 300, 200] and (clamped.non_o, clamped.non_o_ratio, clamped.instruction) == (1, 0.5, 1)
    counts = dataset.write_processed(table, f"{tmp_path}/out", KNOWN, least=2)
    reasons = [x for x in (r.drop_reason for r in got)]
    assert counts["pages"] == len(pages) and counts["kept"] == reasons.count(None) == spark.read.parquet(f"{tmp_path}/out").count()
    assert [counts[f"dropped_{r}"] for r in dataset.REASONS] == [reasons.count(r) for r in dataset.REASONS]
    assert (counts["filled_missing_labels"], counts["note_collapsed"], counts["min_tokens"], counts["max_tokens"]) == (n["filled"], n["note"], 2, 3)
    none = dataset.write_processed(table.limit(0), f"{tmp_path}/none", KNOWN)
    assert (none["pages"], none["kept"], none["tokens"], none["min_tokens"]) == (0, 0, 0, None)
    kept = dataset.process_records(table, [*KNOWN, "NOTE"], gone=None).where("page_num = 10 or page_num = 14").collect()
    assert sum(r.collapsed for r in kept) == 0


def test_counters_take_one_scan(spark, pages, tmp_path):
    place = f"{tmp_path}/in"
    spark.createDataFrame(pages, PAGE).coalesce(1).write.parquet(place)
    rows = spark.read.parquet(place)
    tracker, before = spark.sparkContext.statusTracker(), spark.range(1).count()
    spark.sparkContext.setJobGroup("one-pass", "")
    dataset.write_processed(rows, f"{tmp_path}/out", KNOWN)
    jobs = tracker.getJobIdsForGroup("one-pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert before == 1 and len(jobs) == 1


WORDS = "page_num long, word_idx int, word string, label string"


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    loads, sizes = tmp_path / "loads", tmp_path / "sizes"
    loads.mkdir(), sizes.mkdir()
    rows = [(p, i, None if i == 7 else "w" * (i % 4), "O") for p in range(40) for i in range(50)]
    words = spark.createDataFrame(rows, WORDS).repartition(16)

    def load():
        (Path(loads) / f"{os.getpid()}-{os.urandom(4).hex()}").touch()

        def model(batch):
            (Path(sizes) / f"{batch.num_rows}-{os.urandom(4).hex()}").touch()
            n = [len(w or "") for w in batch.column(0).to_pylist()]
            return pa.array([f"L{k}" for k in n]), pa.array([k / 4 for k in n])

        return model

    def pids(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * b.num_rows)], ["pid"])

    out = labeler.label_with(words, f"test-{os.urandom(4).hex()}", load, ["word"], where=F.length("word") > 0, rows=30)
    got = out.collect()
    assert len(got) == len(rows)
    assert all((r.pred_label, r.confidence) == ((f"L{len(r.word)}", len(r.word) / 4) if r.word else ("O", 0.0)) for r in got)
    made = [p.name.split("-")[0] for p in loads.iterdir()]
    assert len(made) == len(set(made)), "a worker loaded twice"
    assert len(made) <= spark.sparkContext.defaultParallelism * 2 and words.mapInArrow(pids, "pid long").distinct().count() >= 1
    assert max(int(p.name.split("-")[0]) for p in sizes.iterdir()) <= 30
    assert out.limit(0).count() == 0 and labeler.label_with(words.limit(0), "none", load, ["word"]).count() == 0
    with pytest.raises(ValueError, match="already"):
        labeler.label_with(out, "again", load, ["word"])


@pytest.mark.parametrize("most", [1000, 1])
def test_lexicon(spark, most):
    rows = [(1, 0, "Salt", "A"), (1, 1, "salt", "B"), (1, 2, "SALT", "A"), (1, 3, "cup", "B"), (1, 4, "cup", "A"), (1, 5, "rare", "A"), (1, 6, None, "A"), (1, 7, "cup", None)]
    words = spark.createDataFrame(rows, WORDS)
    table = labeler.lexicon(words, 2)
    assert {r.word: (r.label, round(r.confidence, 6)) for r in table.collect()} == {"salt": ("A", 0.666667), "cup": ("A", 0.5)}
    got = {r.word_idx: (r.pred_label, round(r.confidence, 6)) for r in labeler.labelled(words, labeler.lexicon_labeler(table, most, F.col("word_idx") != 2)).collect()}
    assert got == {0: ("A", 0.666667), 1: ("A", 0.666667), 2: ("O", 0.0), 3: ("A", 0.5), 4: ("A", 0.5), 5: ("O", 0.0), 6: ("O", 0.0), 7: ("A", 0.5)}
    more = table.unionByName(spark.createDataFrame([("rare", "C", 1.0)], table.schema))
    assert labeler.labelled(words, labeler.lexicon_labeler(more, most)).where("word = 'rare'").first().pred_label == "C"


def test_default_labeler(spark):
    words = spark.createDataFrame([(1, 0, "Cake", 100, 120), (1, 1, "cup", 400, 420), (1, 2, "zzz", 400, 420)], "page_num long, word_idx int, word string, y0 int, y1 int")
    assert [r.pred_label for r in labeler.labelled(words).orderBy("word_idx").collect()] == ["TITLE", "INGREDIENT_LINE", "O"]


EVENTS = "session_id long, status string, error string, ts timestamp"
FIRST = "(1, 'uploaded', null, timestamp'2024-01-01'), (1, 'pred_done', 'no', timestamp'2024-01-02'), (2, 'uploaded', null, null), (3, 'lost', null, timestamp'2024-01-01'), (null, 'ocr_done', null, timestamp'2024-01-01')"
SECOND = "(1, 'ocr_done', null, timestamp'2024-01-03'), (2, 'failed', 'disk', timestamp'2024-01-02'), (2, 'failed', 'net', timestamp'2024-01-02'), (2, 'pred_done', null, timestamp'2024-01-05'), (4, 'failed', null, timestamp'2024-01-01')"


def rows_of(spark, values):
    return spark.sql(f"SELECT CAST(a AS long) AS session_id, b AS status, CAST(c AS string) AS error, d AS ts FROM VALUES {values} AS t(a, b, c, d)")


def test_sessions_by_stage_and_after_a_restart(spark, tmp_path):
    first, second = rows_of(spark, FIRST), rows_of(spark, SECOND)
    want = {1: ("pred_done", None, 3), 2: ("failed", "net", 4), 3: (None, None, 1), 4: ("failed", None, 1), None: ("ocr_done", None, 1)}
    whole = {r.session_id: (r.status, r.error, r.n_events) for r in sessions.session_status(first.unionByName(second)).collect()}
    assert whole == want
    assert sessions.session_status(first.limit(0)).count() == 0
    spot = lambda x: f"{tmp_path}/{x}"
    start = lambda: sessions.track(spark.readStream.schema(EVENTS).parquet(spot("in")), spot("out"), spot("check")).awaitTermination()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    first.coalesce(1).write.parquet(spot("in"))
    start()
    assert {r.session_id: r.status for r in sessions.tracked(spark, spot("out")).collect()} == {1: "pred_done", 2: "uploaded", 3: None, None: "ocr_done"}
    second.coalesce(1).write.mode("append").parquet(spot("in"))
    start()
    start()  # nothing new has come
    assert {r.session_id: (r.status, r.error, r.n_events) for r in sessions.tracked(spark, spot("out")).collect()} == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_stages_go_on_after_a_restart(spark, tmp_path):
    spot = lambda x: f"{tmp_path}/{x}"
    schema = "page_num long, text string"
    steps = [("ocr_done", lambda p: p.select("page_num", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")), ("pred_done", lambda w: w.where("word <> 'bad'"))]
    start = lambda s: sessions.ingest_stages(spark.readStream.schema(schema).parquet(spot("in")), s, spot("out"), spot("check")).awaitTermination()
    spark.createDataFrame([(1, "a b"), (2, None), (3, "bad"), (1, "a b")], schema).coalesce(1).write.parquet(spot("in"))
    start(steps)
    spark.createDataFrame([(1, "a b"), (4, "c")], schema).coalesce(1).write.mode("append").parquet(spot("in"))
    start(steps)
    got = {r.session_id: (r.status, r.error) for r in sessions.session_status(spark.read.parquet(spot("out/events"))).collect()}
    assert got == {1: ("pred_done", None), 2: ("failed", "no rows of ocr_done"), 3: ("failed", "no rows of pred_done"), 4: ("pred_done", None)}
    assert sorted(r.word for r in spark.read.parquet(spot("out/pred_done")).collect()) == ["a", "b", "c"]
    only = f"{tmp_path}/only"
    sessions.ingest_stages(spark.readStream.schema(schema).parquet(spot("in")), steps[:1], only, spot("check2")).awaitTermination()
    assert {r.status for r in sessions.session_status(spark.read.parquet(f"{only}/events")).collect()} == {"ocr_done", "failed"}


def test_of_two_writers_one_fails(spark, tmp_path):
    path, fine = f"{tmp_path}/table", F.lit(True)
    with pytest.raises(ValueError, match="no commit"):
        sinks.current(spark, path)
    sinks.safe_overwrite(spark.range(3), path, fine)
    seen = sinks.latest(spark, path)  # both writers begin here
    sinks.safe_overwrite(spark.range(4), path, fine, after=seen)
    with pytest.raises(sinks.Outrun):
        sinks.safe_overwrite(spark.range(5), path, fine, after=seen)
    assert sinks.current(spark, path).count() == 4 and sinks.latest(spark, path) == seen + 1

    def meanwhile(df):  # another writer commits between this one's look at the manifest and its commit
        (Path(path) / "manifest" / str(seen + 2)).write_text(f"{path}/other")
        return df

    files = sinks._manifest
    calls = []

    def raced(spark, path):
        found = files(spark, path)
        calls.append(1)
        if len(calls) == 2:
            meanwhile(None)
        return found

    sinks._manifest = raced
    try:
        with pytest.raises(sinks.Outrun):
            sinks.safe_overwrite(spark.range(6), path, fine)
    finally:
        sinks._manifest = files
    assert sinks.latest(spark, path) == seen + 2
