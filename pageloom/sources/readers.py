"""Readers of recipe folders, candidate files and annotation exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECIPE = (
    "id string, book string, year int, title string, category string, tags array<string>, time struct<prep:string,cook:string,total:string>, servings string, "
    "ingredients array<string>, instructions array<string>, notes array<string>, source struct<page:int,pdf_url:string>"
)
CANDIDATE = "page_num int, recipe_score double"
ANNOTATIONS = (
    "data struct<page_num:int,width:int,height:int>, annotations array<struct<result:array<struct<"
    "type:string,value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>>>>>"
)


#: Bytes of a stored table of documents whose words one task takes: about a million words.
PAGE_BYTES = 4 << 20


def page_partitions(spark: SparkSession, path: str) -> int:
    """How many partitions a stored table of pages is dealt to, so that what a task holds does not follow the table's size.

    Pages then stay where they are: joins by page and word or line are told to make do with rows that are partitioned by page
    alone, in place of shuffling all words by all keys.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // PAGE_BYTES))


def scan_recipes_dir(spark: SparkSession, path: str) -> DataFrame:
    """Recipes of a folder with one JSON file each, and file (its name). index.json and files without a source page are left
    out; a file that is no JSON gives no row."""
    rows = spark.read.schema(RECIPE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_name").alias("file"))
    return rows.where((F.col("file") != "index.json") & F.col("source.page").isNotNull())


def scan_candidates_csv(spark: SparkSession, path: str, least: float = 0.5) -> DataFrame:
    """(page_num, recipe_score) of a candidate file's pages that score `least` or more; other columns of the file are left out."""
    every = spark.read.option("header", True).csv(path).select(F.col("page_num").try_cast("int").alias("page_num"), F.col("recipe_score").try_cast("double").alias("recipe_score"))
    return every.where((F.col("recipe_score") >= least) & F.col("page_num").isNotNull())


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(page_num, ann_idx, ann_label, p0, p1, p2, p3) of an export (a JSON array of tasks): the rectangles of each task's last
    annotation, in pixels of its page. Results that are no rectangles or have no label are left out."""
    c = F.col
    tasks = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path).where(F.size("annotations") > 0)
    last = tasks.select("data", F.posexplode(F.element_at("annotations", -1)["result"]).alias("ann_idx", "r"))
    v, w, h = c("r.value"), c("data.width"), c("data.height")
    rows = last.where((c("r.type") == "rectanglelabels") & (F.size(v["rectanglelabels"]) > 0))
    x0, y0 = v["x"] / 100 * w, v["y"] / 100 * h
    box = [x0.alias("p0"), y0.alias("p1"), (x0 + v["width"] / 100 * w).alias("p2"), (y0 + v["height"] / 100 * h).alias("p3")]
    return rows.select(c("data.page_num").alias("page_num"), "ann_idx", F.element_at(v["rectanglelabels"], 1).alias("ann_label"), *box)
