"""Writers: plain files, split datasets with their counts, and tables that are replaced only once the new data is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a local master (tests)
    has the warehouse; a cluster can't share that, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/pages-{uuid.uuid4().hex}"


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Write as parquet, json (one object a line) or csv (with a header; nested columns as JSON)."""
    out = _flat(df) if form == "csv" else df
    writer = out.write.mode(mode).format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)


def write_split_dataset(pages: DataFrame, path: str, labels: list[str]) -> DataFrame:
    """Write pages (with split) by split under path/data, the label ids under path/labels, and the split sizes under path/splits; return the sizes."""
    spark = pages.sparkSession
    pages.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    spark.createDataFrame(list(enumerate(labels)), "label_id int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
    sizes = spark.read.parquet(f"{path}/data").groupBy("split").agg(F.count("*").alias("n"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/splits")
    return spark.read.parquet(f"{path}/splits")


def _manifest(spark: SparkSession, path: str):
    """(file system, folder, numbers of the commits in it)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    return files, folder, sorted(int(n) for n in names if n.isdigit())


class Outrun(RuntimeError):
    """Another writer committed in the meantime."""


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last commit, 0 if there is none."""
    return max(_manifest(spark, path)[2], default=0)


def safe_overwrite(df: DataFrame, path: str, check: Column, after: int | None = None) -> str:
    """Write df as a new version under path, count the rows that satisfy the check, and commit it if there are any.

    A commit is a manifest file with the next number that is made only if it isn't there yet: of two writers that began after
    the same commit the later one fails with Outrun, and can look at the new table before it tries again. `after` is the commit
    that df was made from (the last one as this begins, if it isn't given). Readers take current(path); a version that fails
    the check or the race is never current, and earlier versions stay.
    """
    spark = df.sparkSession
    after = latest(spark, path) if after is None else after
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    if spark.read.parquet(version).where(check).isEmpty():
        raise ValueError(f"no row of {version} satisfies the check")
    files, folder, numbers = _manifest(spark, path)
    if max(numbers, default=0) != after:
        raise Outrun(f"{path} has commit {max(numbers)}, this one was made after {after}")
    files.mkdirs(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder, str(after + 1))
    try:
        out = files.create(place, False)
    except Exception as gone:
        if files.exists(place):
            raise Outrun(f"{path} has commit {after + 1} already") from gone
        raise
    out.write(bytearray(version, "utf-8"))
    out.close()
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table of the last commit."""
    number = latest(spark, path)
    if not number:
        raise ValueError(f"{path} has no commit")
    return spark.read.parquet(spark.read.option("wholetext", True).text(f"{path}/manifest/{number}").first().value)
