"""Upload sessions: pages that pass through optional stages as they arrive, and each session's status kept as a stream's state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Stages in rising order; a session that failed stays so.
STAGES = ["uploaded", "ocr_done", "pred_done", "failed"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ranked(events: DataFrame) -> DataFrame:
    """events with rank, -1 for a status that is no stage, and no error but of failures."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("status")).cast("int") - 1, F.lit(-1))
    return events.select("session_id", "status", "ts", F.when(F.col("status") == "failed", F.col("error")).alias("error"), rank.alias("rank"))


def session_status(events: DataFrame) -> DataFrame:
    """(session_id, status, error, n_events): each session's furthest stage in events (session_id, status, error, ts), whatever
    the order in which they come; failed is the last, with the error of the latest failure (of equals the greatest text).
    Statuses that are no stage count as events alone; a session with no other has a null status. Null ids are a session."""
    top = F.max(F.when(F.col("rank") >= 0, F.struct("rank", "ts", "error")))
    found = _ranked(events).groupBy("session_id").agg(top.alias("t"), F.count("*").alias("n_events"))
    return found.select("session_id", F.get(F.array(*map(F.lit, STAGES)), F.col("t.rank")).alias("status"), F.col("t.error").alias("error"), "n_events")


class Furthest(StatefulProcessor):
    """A session's furthest stage so far: its rank, time and error, and the number of events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("furthest", "rank int, ts long, error string, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        best, n = (-1, -1, None), 0
        if self.state.exists():
            *best, n = self.state.get()
        order = lambda x: (x[0], x[1], x[2] is not None, x[2] or "")
        for r in rows:
            n += 1
            if r.rank >= 0:
                best = max(tuple(best), (r.rank, r.ts, r.error), key=order)
        self.state.update((*best, n))
        yield Row(session_id=key[0], rank=best[0], error=best[2], n_events=n)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for queries that start here; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def track(events: DataFrame, out: str, checkpoint: str):
    """Start a query over a stream of events (session_id, status, error, ts) that appends a session's status whenever events of it
    come. State is one row a session. It stops once everything that has arrived is done; started again with the same
    checkpoint, it goes on where it stopped. tracked(out) has the latest status of each session."""
    kind = events.schema["session_id"].dataType.simpleString()
    rows = _ranked(events).withColumn("ts", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-1)))
    with _rocks(events.sparkSession):
        states = rows.groupBy("session_id").transformWithState(Furthest(), f"session_id {kind}, rank int, error string, n_events long", "Append", "None")
        return states.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tracked(spark: SparkSession, out: str) -> DataFrame:
    """(session_id, status, error, n_events) as session_status gives it, from what track has written: the row with most events."""
    last = spark.read.parquet(out).groupBy("session_id").agg(F.max_by(F.struct("rank", "error"), "n_events").alias("x"), F.max("n_events").alias("n_events"))
    return last.select("session_id", F.get(F.array(*map(F.lit, STAGES)), F.when(F.col("x.rank") >= 0, F.col("x.rank"))).alias("status"), F.col("x.error").alias("error"), "n_events")


Step = tuple[str, Callable[[DataFrame], DataFrame]]


def ingest_stages(arriving: DataFrame, steps: list[Step], out: str, checkpoint: str, key: str = "page_num"):
    """Start a query that takes each batch of a stream of pages through steps (stage, work), each working on the rows of the one
    before; a step that is left out of the list is a stage that isn't run. Rows of a stage go to out/<stage>, and a row
    (session_id, status, error, ts) for each page and stage to out/events; a page for which a step gives no row has failed
    there, and goes no further. Batches have folders of their own, so one that runs again writes over itself; pages that an
    earlier batch has are passed over. It stops once everything that has arrived is done.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put = lambda df, stage: df.write.mode("overwrite").parquet(f"{out}/{stage}/batch={number}")
        event = lambda df, stage, error=None: df.select(F.col(key).alias("session_id"), F.lit(stage).alias("status"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("ts"))
        new = batch.dropDuplicates([key])
        if number > 0:
            done = spark.read.parquet(f"{out}/uploaded").where(F.col("batch") < number).select(key)
            new = new.join(done, key, "left_anti")
        put(new, "uploaded")
        rows = spark.read.parquet(f"{out}/uploaded/batch={number}")
        events = event(rows, "uploaded")
        for stage, work in steps:
            put(work(rows), stage)
            made = spark.read.parquet(f"{out}/{stage}/batch={number}")
            keys = made.select(key).distinct()
            events = events.unionByName(event(keys, stage)).unionByName(event(rows.select(key).distinct().join(keys, key, "left_anti"), "failed", f"no rows of {stage}"))
            rows = made
        put(events, "events")

    return arriving.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
