"""Labellers that can be plugged in: a model is loaded once in each Python worker and labels words in bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .relabel import mock_labels

#: (labels, confidences) of the rows of a batch.
Model = Callable[[pa.RecordBatch], tuple[pa.Array, pa.Array]]
#: Words in a batch that a model gets, and words of a lexicon that every task holds, at most.
ROWS, LEXICON = 4096, 1_000_000
_LOADED: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The worker's model of this name, loaded when it is first asked for."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def label_with(words: DataFrame, name: str, load: Callable[[], Model], needs: list[str], where: Column | None = None, rows: int = ROWS) -> DataFrame:
    """words with pred_label and confidence by a model. load runs once in each Python worker and gives a function from a record
    batch of the columns `needs` (of at most `rows` rows) to labels and confidences; name must differ between models, and a model
    of another version needs another name. Words that don't meet `where` (or for which it is null), a cheap filter ahead of the
    model, never reach Python: they are O with confidence 0, by a second read of words. Rows repeat as in words; an empty table gives an empty one.
    """
    if {"pred_label", "confidence"} & {x.lower() for x in words.columns}:
        raise ValueError("words have a column pred_label or confidence already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                label, confidence = loaded(name, load)(part.select(needs))
                yield pa.RecordBatch.from_arrays([*part.columns, label.cast(pa.string()), confidence.cast(pa.float64())], [*part.schema.names, "pred_label", "confidence"])

    out = StructType(list(words.schema.fields)).add("pred_label", "string").add("confidence", "double")
    if where is None:
        return words.mapInArrow(run, out)
    fits = F.coalesce(where, F.lit(False))
    rest = words.where(~fits).withColumns({"pred_label": F.lit("O"), "confidence": F.lit(0.0)})
    return words.where(fits).mapInArrow(run, out).unionByName(rest)


def labelled(words: DataFrame, labeler: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """words with pred_label and confidence, by any function that adds them; without one, by place and wording (mock_labels)."""
    if labeler is not None:
        return labeler(words)
    return mock_labels(words).withColumnsRenamed({"label_mock": "pred_label", "conf_mock": "confidence"})


def lexicon(words: DataFrame, least: int = 5, label: str = "label") -> DataFrame:
    """(word, label, confidence): the most frequent label (of equals the first by name) of each lower-case word with `least`
    occurrences or more, and its share of them. Words or labels that are null don't count."""
    each = words.where(F.col(label).isNotNull() & F.col("word").isNotNull()).groupBy(F.lower("word").alias("word"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "label"))
    top = each.groupBy("word").agg(best.alias("b"), F.sum("n").alias("total")).where(F.col("total") >= least)
    return top.select("word", F.col("b.label").alias("label"), (-F.col("b.n") / F.col("total")).alias("confidence"))


def lookup(names: pa.Array, labels: pa.Array, confidences: pa.Array) -> Model:
    """A model that looks words up. Their places are hashed once, so that a batch costs its own words alone, whatever the size of
    the lexicon; unknown and null words are O with confidence 0."""
    place = {w: i for i, w in enumerate(names.to_pylist())}

    def model(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
        coded = batch.column(0).dictionary_encode()
        at = pa.array([place.get(w) for w in coded.dictionary.to_pylist()], pa.int64()).take(coded.indices)
        return labels.take(at).fill_null("O"), confidences.take(at).fill_null(np.float64(0))

    return model


def lexicon_labeler(table: DataFrame, most: int = LEXICON, where: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A labeller that looks words up in a lexicon (word, label, confidence); others are O with confidence 0. A lexicon of at most
    `most` words is a model that every worker loads once; a larger one is joined by a shuffle on the word. Words that don't meet
    `where` aren't looked up."""
    held = table.select("word", "label", "confidence").limit(most + 1).toArrow()
    if held.num_rows > most:

        fits = F.lit(True) if where is None else F.coalesce(where, F.lit(False))

        def joined(words: DataFrame) -> DataFrame:
            known = table.select(F.col("word").alias("_key"), F.col("label").alias("pred_label"), "confidence")
            both = words.withColumn("_own", F.lower("word")).join(known, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")
            return both.withColumns({"pred_label": F.when(fits, F.coalesce("pred_label", F.lit("O"))).otherwise("O"), "confidence": F.when(fits, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0)})

        return joined
    shipped = table.sparkSession.sparkContext.broadcast(tuple(held[x].combine_chunks() for x in ("word", "label", "confidence")))

    def load() -> Model:
        return lookup(*shipped.value)

    name = f"lexicon-{uuid.uuid4().hex}"
    return lambda words: label_with(words.withColumn("_key", F.lower("word")), name, load, ["_key"], where).drop("_key")
