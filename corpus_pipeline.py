"""The corpus pipeline: documents -> quality -> near-duplicates -> secrets -> mixing -> packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import mixing, quality, secrets, simhash, tokens
from pageloom.llm.common import remove, table_path
from pageloom.llm.queries import quality_weights, table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier keeps (see quality.judged).

    Null and empty texts, and languages without trusted text, stay or go by what their end alone costs, and stay where there is
    no threshold; null ids have no label but are judged; repeated rows are judged alike; an empty table gives an empty one;
    other columns pass, whatever their names. labels decides which texts are trusted.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words, a Jaccard likeness of 0.8 or more (see simhash.drop_similar).

    Null, empty and blank texts are one group; the smallest doc_id stays (null ids last), of equal ids the smallest hash of the
    text; rows with the same id and text are one; an empty table gives an empty one; other columns pass, whatever their names.
    """
    return simhash.drop_similar(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets masked and n_chars counted anew (see secrets.redact).

    Null texts stay null, empty ones empty; ids, repeats and other columns pass as they are; an empty table gives an empty one.
    """
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it (see mixing.mixed_documents).

    Null and empty texts have no words and come in whole epochs alone; a null source is the last source; keys that tie are
    settled by id and text; repeated rows share what the mix takes of them; an empty table gives an empty one; other columns
    pass, whatever their names.
    """
    return mixing.mixed_documents(docs, quality_weights(table(spark, sf_dir, "labels")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of packed ids, with their CRC-32 (see tokens.pack).

    Null and empty texts are an end id; null ids stay null; repeated rows have sequences of their own; an empty table gives an
    empty one; other columns are left out.
    """
    return tokens.with_crc(tokens.pack(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Stages 1 and 5 can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again; a stage's table is removed
    once the next one's is written. Odd rows: see the stages."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            break
        path = table_path(spark, f"stage-{name}")
        docs.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
