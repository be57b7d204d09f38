"""Incremental work: pages that arrive as files, and results that are computed again only where they are missing or old."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest(arriving: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "page_num"):
    """Start a query that applies `work` to each batch of a stream and appends rows with new keys to the table `out`.

    A batch that runs again after a failure writes to its own folder again, so rows aren't doubled. Keys are held against the
    written batches before it, not against state that grows. It stops once everything that has arrived is done.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = work(batch.dropDuplicates([key]))
        if number > 0:
            done = spark.read.parquet(out).where(F.col("batch") < number).select(key)
            new = new.join(done, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Buckets of a table of results, fixed when it is made.
BUCKETS = 64


def save_results(results: DataFrame, table: str, version: int, key: str = "page_num", path: str | None = None, buckets: int = BUCKETS) -> None:
    """Append results of one version to a table that is partitioned by version and bucketed by key; made if it isn't there.

    A version that gets results twice keeps both, so hand in those of keys it doesn't have (`rescore`, reused false). Rows are
    dealt by key once, here, and no reader shuffles them again. All appends must use the same number of buckets.
    """
    rows = results.withColumn("version", F.lit(version)).repartition(buckets, key)
    writer = rows.write.mode("append").partitionBy("version").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def rescore(pages: DataFrame, stored: DataFrame, work: Callable[[DataFrame], DataFrame], version: int, key: str = "page_num") -> DataFrame:
    """Results for all pages: stored ones of the current version as they are, others by `work`; reused says which.

    If `stored` is a table of save_results, only files of that version are read and its rows stay where they are: pages come
    to the buckets for both joins. Pages with a null key are worked on; stored rows without a page are left out.
    """
    valid = stored.where(F.col("version") == version).drop("version")
    fresh = work(pages.join(valid.select(key), key, "left_anti")).withColumn("reused", F.lit(False))
    return valid.join(pages.select(key), key, "left_semi").withColumn("reused", F.lit(True)).unionByName(fresh)
