"""Training records with counters, labellers that are plugged in, and upload sessions as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators import dataset, extraction, labeler
from pageloom.operators.labels import LABELS_V2
from pageloom.sources import pages as source
from pageloom.sources import sinks
from pageloom.streaming import sessions

from .extraction import XL
from .queries import _IN, TOK, _words, query

c = F.col

#: Page records with faults of every kind: no labels on every 7th page, a box too few on every 11th, an unknown label for TIME on
#: every 13th, no width on every 17th, and a NOTE at place 20 of every 29 words.
_RECORDS = (
    TOK + f""",
w0 AS (SELECT page_num, word_idx, height, CASE WHEN page_num % 17 = 6 THEN 0 ELSE 1000 END AS width, x0, y0, x1, y1,
  CASE WHEN label = 'O' AND word_idx % 29 = 20 THEN 'NOTE' WHEN label = 'TIME' AND page_num % 13 = 4 THEN 'MYSTERY' ELSE label END AS lb FROM tok JOIN (SELECT page_num, height FROM page) USING (page_num)),
w1 AS (SELECT *, CASE WHEN page_num % 7 = 3 OR lb = 'NOTE' THEN 'O' ELSE lb END AS fin,
  {" + ".join(f"least(1000, greatest(0, floor({v} * 1000 / nullif({s}, 0))))" for v, s in (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height")))} AS box FROM w0),
p0 AS (SELECT d.doc_id AS page_num, count(word_idx) AS n, count(word_idx) - CASE WHEN d.doc_id % 11 = 5 AND count(word_idx) > 0 THEN 1 ELSE 0 END AS nb, count(*) FILTER (lb = 'NOTE') AS notes, bool_or(fin = 'MYSTERY') AS strange,
  sum(box) AS box_sum, sum(list_position({_IN(LABELS_V2)}, fin) - 1) AS id_sum, count(*) FILTER (fin <> 'O') AS non_o, count(*) FILTER (fin = 'INGREDIENT_LINE') AS ingredient, count(*) FILTER (fin = 'INSTRUCTION_STEP') AS instruction, count(*) FILTER (fin = 'TITLE') AS title
  FROM documents d LEFT JOIN w1 ON w1.page_num = d.doc_id GROUP BY d.doc_id),
p1 AS (SELECT *, n > 0 AND nb > 0 AND page_num % 7 = 3 AS filled, CASE WHEN n = 0 OR nb = 0 THEN 'empty' WHEN n <> nb THEN 'mismatch' WHEN n < 5 THEN 'short' END AS early FROM p0),
p2 AS (SELECT *, coalesce(early, CASE WHEN strange THEN 'unknown' WHEN page_num % 17 = 6 THEN 'bad_bbox' END) AS drop_reason, CASE WHEN early IS NULL AND NOT filled THEN notes ELSE 0 END AS collapsed FROM p1)
"""
)


def _records(spark, sf) -> DataFrame:
    label = F.when((c("label") == "O") & (c("word_idx") % 29 == 20), "NOTE").when((c("label") == "TIME") & (c("page_num") % 13 == 4), "MYSTERY").otherwise(c("label"))
    row = F.struct("word_idx", "word", label.alias("label"), F.array("x0", "y0", "x1", "y1").alias("box"))
    made = _words(spark, sf).groupBy("page_num").agg(F.sort_array(F.collect_list(row)).alias("w"), F.first("height").alias("height"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(c("doc_id").alias("page_num"))
    boxes = F.transform("w", lambda x: x["box"])
    return docs.join(made, "page_num", "left").select(
        "page_num", F.when(c("page_num") % 17 == 6, 0).otherwise(1000).alias("width"), "height", F.transform("w", lambda x: x["word"]).alias("words"),
        F.when(c("page_num") % 11 == 5, F.slice(boxes, 1, F.greatest(F.size("w") - 1, F.lit(0)))).otherwise(boxes).alias("bboxes"),
        F.when(c("page_num") % 7 != 3, F.transform("w", lambda x: x["label"])).alias("labels"),
    )


@query(_RECORDS + "SELECT page_num, drop_reason, filled, collapsed, " + ", ".join(f"CASE WHEN drop_reason IS NULL THEN {x} END AS {x}" for x in ("non_o", "ingredient", "instruction", "title", "id_sum", "box_sum")) + " FROM p2")
def process_record(spark, sf):
    done = dataset.process_records(_records(spark, sf), LABELS_V2, least=5)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    return done.select("page_num", "drop_reason", "filled", "collapsed", "non_o", "ingredient", "instruction", "title", total("label_ids").alias("id_sum"), total(F.flatten("boxes")).alias("box_sum"))


@query(_RECORDS + "SELECT count(*) AS pages, count(*) FILTER (drop_reason IS NULL) AS kept, " + ", ".join(f"count(*) FILTER (drop_reason = '{r}') AS dropped_{r}" for r in dataset.REASONS) + ", count(*) FILTER (filled) AS filled_missing_labels, sum(collapsed) AS note_collapsed, sum(n) FILTER (drop_reason IS NULL) AS tokens, min(n) FILTER (drop_reason IS NULL) AS min_tokens, max(n) FILTER (drop_reason IS NULL) AS max_tokens FROM p2")
def dataset_counters(spark, sf):
    """Counted in the pass that writes the records."""
    found = dataset.write_processed(_records(spark, sf), sinks.shared_folder(spark), LABELS_V2, least=5)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


_LEXICON = TOK + """, lx AS (SELECT lower(word) AS w, label, count(*) AS n FROM tok WHERE page_num IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
lt AS (SELECT *, sum(n) OVER (PARTITION BY w) AS total, row_number() OVER (PARTITION BY w ORDER BY n DESC, label) AS r FROM lx),
lex AS (SELECT w, label, n / total AS confidence FROM lt WHERE r = 1 AND total >= 5)
"""


def _lexicon(spark, sf):
    words, good = _words(spark, sf), spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select(c("doc_id").alias("page_num"))
    return words, labeler.lexicon(words.join(good, "page_num", "left_semi"))


@query(_LEXICON + "SELECT w AS word, label, confidence FROM lex")
def labeler_lexicon(spark, sf):
    return _lexicon(spark, sf)[1]


@query(_LEXICON + "SELECT page_num, word_idx, CASE WHEN length(word) > 1 THEN coalesce(lex.label, 'O') ELSE 'O' END AS pred_label, CASE WHEN length(word) > 1 THEN coalesce(confidence, 0) ELSE 0 END AS confidence FROM tok LEFT JOIN lex ON w = lower(word)")
def labeler_model(spark, sf):
    """A lexicon of the trusted pages as the plugged-in model; words of one letter never reach it."""
    words, table = _lexicon(spark, sf)
    out = labeler.labelled(words, labeler.lexicon_labeler(table, where=F.char_length("word") > 1))
    return out.select("page_num", "word_idx", "pred_label", "confidence")


_EVENTS = f"""WITH e AS (SELECT event_id // 3 AS session_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'ocr_done' WHEN 'click' THEN 'pred_done' WHEN 'error' THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type = 'error' THEN props END AS err, ts FROM events),
k AS (SELECT *, coalesce(list_position({_IN(sessions.STAGES)}, status), 0) AS stage FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n_events, row_number() OVER (PARTITION BY session_id ORDER BY stage DESC, ts DESC, err DESC NULLS LAST) AS nth FROM k)
SELECT session_id, CASE WHEN stage > 0 THEN status END AS status, err AS error, n_events FROM r WHERE nth = 1"""


def _events(rows: DataFrame) -> DataFrame:
    """Three events in a row are a session's; purchases are no stage."""
    kind = c("event_type")
    status = F.when(kind == "signup", "uploaded").when(kind == "view", "ocr_done").when(kind == "click", "pred_done").when(kind == "error", "failed").otherwise(kind)
    return rows.select(F.floor(c("event_id") / 3).alias("session_id"), status.alias("status"), F.when(kind == "error", c("props")).alias("error"), "ts")


@query(_EVENTS)
def session_status(spark, sf):
    return sessions.session_status(_events(spark.read.parquet(f"{sf}/events.parquet")))


@query(_EVENTS)
def stream_session_status(spark, sf):
    """The same from a stream with a state for each session."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    place = sinks.shared_folder(spark)
    sessions.track(_events(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return sessions.tracked(spark, f"{place}/out")


def stages(recipe: bool = True) -> list[sessions.Step]:
    """Words of a page, their labels, and its recipe."""
    steps = [("ocr_done", lambda pages: source.word_table(pages.withColumnRenamed("page_num", "doc_id"))), ("pred_done", lambda words: words.drop("label_pred"))]
    return [*steps, ("recipe", extraction.extract_recipe)] if recipe else steps


@query(XL + ", hw AS (SELECT DISTINCT page_num FROM tok) SELECT doc_id AS page_num, CASE WHEN rw.page_num IS NOT NULL THEN 'pred_done' ELSE 'failed' END AS status, CASE WHEN rw.page_num IS NOT NULL THEN NULL WHEN hw.page_num IS NULL THEN 'no rows of ocr_done' ELSE 'no rows of recipe' END AS error, rw.title, len(rw.ingredients) AS n_ingredients FROM documents LEFT JOIN rw ON rw.page_num = doc_id LEFT JOIN hw ON hw.page_num = doc_id")
def stream_ingest_stages(spark, sf):
    """Documents arrive as files and go from words to labels to recipes; each page's status comes from its events."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    place = sinks.shared_folder(spark)
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet").withColumnRenamed("doc_id", "page_num")
    sessions.ingest_stages(arriving, stages(), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    status = sessions.session_status(spark.read.parquet(f"{place}/out/events")).withColumnRenamed("session_id", "page_num")
    recipes = spark.read.parquet(f"{place}/out/recipe").select("page_num", "title", F.size("ingredients").alias("n_ingredients"))
    return status.join(recipes, "page_num", "left").select("page_num", "status", "error", "title", "n_ingredients")
