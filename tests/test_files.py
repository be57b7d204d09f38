"""Readers, writers and incremental work on small files."""

import pytest
from pyspark.sql import functions as F

from pageloom.sources import pages, sinks
from pageloom.streaming import ingest


def test_read_pages(spark, tmp_path):
    good = '{"page_num": 1, "image_path": "a", "width": 5, "height": 6, "words": ["x"], "bboxes": [[0, 0, 1, 1]], "extra": 1}'
    (tmp_path / "a.jsonl").write_text(good + '\n\n{"page_num": 2}\nnot json\n')
    assert [r.page_num for r in pages.read_pages_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == [1]


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_write(spark, tmp_path, form):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k long, v array<string>")
    sinks.write(df, str(tmp_path / form), form)
    back = spark.read.format(form).options(header=True).load(str(tmp_path / form))
    assert back.count() == 2 and set(back.columns) == {"k", "v"}


def test_split_dataset(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "page_num long, split string")
    sizes = {r.split: r.n for r in sinks.write_split_dataset(df, str(tmp_path / "d"), ["O", "TITLE"]).collect()}
    assert sizes == {"train": 2, "test": 1}


def test_safe_overwrite(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda n: spark.range(n).withColumn("split", F.lit("validation"))
    sinks.safe_overwrite(rows(3), path, F.col("split") == "validation")
    with pytest.raises(ValueError):
        sinks.safe_overwrite(rows(9), path, F.col("split") == "none")
    assert sinks.current(spark, path).count() == 3
    sinks.safe_overwrite(rows(4), path, F.col("split") == "validation")
    assert sinks.current(spark, path).count() == 4


def test_ingest(spark, tmp_path):
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    add = lambda keys, mode: spark.createDataFrame([(k,) for k in keys], "page_num long").write.mode(mode).parquet(src)
    run = lambda: ingest.ingest(spark.readStream.schema("page_num long").parquet(src), lambda b: b.withColumn("twice", 2 * F.col("page_num")), out, mark).awaitTermination()
    add([1, 2, 2], "overwrite")
    run()
    add([2, 3], "append")
    run()
    assert sorted((r.page_num, r.twice) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_rescore(spark):
    page = spark.createDataFrame([(1,), (2,), (3,)], "page_num long")
    stored = spark.createDataFrame([(1, 0.5, 3), (2, 0.1, 2), (9, 0.9, 3)], "page_num long, score double, version int")
    got = ingest.rescore(page, stored, lambda p: p.withColumn("score", F.lit(1.0)), 3).collect()
    assert sorted((r.page_num, r.score, r.reused) for r in got) == [(1, 0.5, True), (2, 1.0, False), (3, 1.0, False)]


def _above(plan: str, mark: str) -> list[list[str]]:
    """For each line of a plan that holds the mark, the lines of the operators above it."""
    stack, found = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        stack = [x for x in stack if x[0] < depth] + [(depth, line)]
        if mark in line:
            found.append([x for _, x in stack[:-1]])
    return found


def test_rescore_from_buckets(spark, tmp_path):
    """Stored rows aren't shuffled, only files of the version are read, and a second round reuses what the first one saved."""
    table, page = f"results_{tmp_path.name.replace('-', '_')}", spark.range(1000).withColumnRenamed("id", "page_num")
    worked = lambda p: p.withColumn("score", F.col("page_num") / 2)
    for low, high, version in ((0, 300, 2), (200, 500, 3), (2000, 2010, 3)):
        ingest.save_results(worked(spark.range(low, high).withColumnRenamed("id", "page_num")), table, version, path=str(tmp_path / "t"), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ingest.rescore(page, spark.table(table), worked, 3)
        above = _above(got._jdf.queryExecution().executedPlan().toString(), "Bucketed: true")
        assert len(above) == 2 and not any("Exchange" in x for lines in above for x in lines)
        rows = got.collect()
        assert len(rows) == 1000 and {r.page_num for r in rows if r.reused} == set(range(200, 500))
        assert all(r.score == r.page_num / 2 for r in rows)
        ingest.save_results(got.where("not reused").drop("reused"), table, 3, path=str(tmp_path / "t"), buckets=4)
        spark.catalog.refreshTable(table)
        again = ingest.rescore(page, spark.table(table), worked, 3)
        assert again.where("reused").count() == 1000 and again.where("not reused").count() == 0
        assert ingest.rescore(page, spark.table(table), worked, 4).where("not reused").count() == 1000
        odd = spark.createDataFrame([(None,), (250,), (250,)], "page_num long")
        got = [(r.page_num, r.reused) for r in ingest.rescore(odd, spark.table(table), worked, 3).collect()]
        assert sorted(got, key=str) == [(250, True), (None, False)]  # a stored row comes once, whatever repeats among the pages
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"drop table if exists {table}")
