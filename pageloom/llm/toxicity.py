"""Toxicity: linear classifiers on hashed words, trained with the non-negative positive-unlabelled risk."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, bounded, by_key

#: Hashed features; bytes of a word that make its prefix feature.
DIM, PREFIX = 1 << 22, 6
#: Most confirmed toxic documents that the steps of the risk read; unlabelled documents of a part, about; classifiers
#: (defaults of train's arguments).
POSITIVES, UNLABELLED, MODELS = 6000, 6000, 3
#: Weights are summed in whole numbers of this part of one, so that sums don't depend on their order.
UNIT = 1 << 32
#: A feature is in so many confirmed documents at least, and so many times more frequent there.
LEAST, RATIO = 5, 4
#: Confirmed ids that are broadcast, at most (8 bytes each); more are joined by a shuffle.
HELD_IDS = 2_000_000
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once: hashes of the words (runs of letters, digits and non-ASCII bytes; A-Z lowered) and of
    their first bytes. Polynomial hashes of all words at once, over the bytes of all texts."""
    data = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    inside = _WORD[raw]
    step = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts = np.nonzero(step == 1)[0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.nonzero(step == -1)[0]
    at = np.repeat(starts, ends - starts)
    pos = np.nonzero(inside)[0]
    off = pos - at
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int((ends - starts).max()) + 1, _BASE, dtype=np.uint64))
        each = (_LOWER[raw[pos]] + np.uint64(1)) * powers[off]
        first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
        whole = np.add.reduceat(each, first)
        each[off >= PREFIX] = 0
        head = np.add.reduceat(each, first) ^ np.uint64(0xABCDEF)
        mix = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)).astype(np.int64)
        rows = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
        key = np.unique(np.concatenate([rows * DIM + mix(whole), rows * DIM + mix(head)]))
    return key // DIM, key % DIM


def chunks(texts: pd.Series, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` characters each."""
    at, size = 0, 0
    for k, n in enumerate(texts.str.len().fillna(0).astype(int)):
        if size and size + n > limit:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


Pairs = tuple[np.ndarray, np.ndarray, int]


def risk_and_gradient(
    w: np.ndarray, b: float, positive: Pairs, unlabelled: Pairs, prior: float, counts: np.ndarray | None = None
) -> tuple[float, float, np.ndarray]:
    """(risk, bracket, direction) of a logistic classifier (weights, bias) over documents given as (row, feature, documents).
    An unlabelled row stands for as many equal documents as counts says (1 without it).

    risk is prior * E+[l(+)] + max(0, bracket) with bracket = Eu[l(-)] - prior * E+[l(-)]. direction is the gradient of the
    risk in (weights, bias); where the bracket is negative it is the gradient of -bracket, as the non-negative estimator
    asks for, to bring it back above zero.
    """
    (ip, jp, n_p), (iu, ju, n_u) = positive, unlabelled
    share = np.full(n_u, 1 / n_u) if counts is None else counts / counts.sum()
    zp, zu = np.bincount(ip, weights=w[jp], minlength=n_p) + b, np.bincount(iu, weights=w[ju], minlength=n_u) + b
    sp, su = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (zp, zu))
    bracket = share @ np.logaddexp(0, zu) - prior * np.logaddexp(0, zp).mean()
    dp, du = -prior * sp / n_p, su * share  # of the bracket
    if bracket >= 0:
        dp = dp + prior * (sp - 1) / n_p
    else:
        dp, du = -dp, -du
    grad = np.bincount(jp, weights=dp[ip], minlength=len(w)) + np.bincount(ju, weights=du[iu], minlength=len(w))
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, bracket), bracket, np.append(grad, dp.sum() + du.sum())


def _pairs(rows: list[np.ndarray]) -> Pairs:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int64), len(rows)


def fit_nnpu(
    rows_p: list[np.ndarray], rows_u: list[np.ndarray], n: int, prior: float, counts: np.ndarray | None = None, rounds: int = 300, rate: float = 0.1, decay: float = 3e-4
) -> tuple[np.ndarray, float]:
    """(weights of n features, bias) that make the non-negative PU risk small, by Adam steps; a row is its features' numbers,
    and an unlabelled one stands for `counts` documents."""
    positive, unlabelled = _pairs(rows_p), _pairs(rows_u)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        grad = risk_and_gradient(w, b, positive, unlabelled, prior, counts)[2] + np.append(decay * w, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have each feature."""
    total = np.zeros(DIM, np.int32)
    for b in batches:
        for lo, hi in chunks(b.column(0).to_pandas()):
            total += np.bincount(features(b.column(0)[lo:hi].to_pylist())[1], minlength=DIM).astype(np.int32)
    f = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(total[f].astype(np.int64))], ["f", "n"])


def _counted_in(names: np.ndarray):
    """The same for some features only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = _slots(names), np.zeros(len(names) + 1, np.int64)
        for b in batches:
            for lo, hi in chunks(b.column(0).to_pandas()):
                total += np.bincount(slot[features(b.column(0)[lo:hi].to_pylist())[1]], minlength=len(names) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(total[:-1])], ["f", "n"])

    return run


def _slots(names: np.ndarray) -> np.ndarray:
    """The place of each feature in names; len(names) for others."""
    slot = np.full(DIM, len(names), np.int32)
    slot[names] = np.arange(len(names), dtype=np.int32)
    return slot


def _frequencies(texts: DataFrame, run) -> tuple[np.ndarray, np.ndarray]:
    """(features, texts that have them), over all texts; at most DIM rows reach the driver."""
    rows = texts.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    f, n = rows["f"].to_numpy().astype(np.int64), rows["n"].to_numpy()
    order = np.argsort(f)
    return f[order], n[order]


def _listed(texts: pa.Array, slot: np.ndarray, n: int) -> Iterator[tuple[int, int, pa.Array]]:
    """Ranges of texts with their features among n known ones: sorted places as unsigned 32-bit integers, in bytes."""
    for lo, hi in chunks(texts.to_pandas()):
        row, f = features(texts[lo:hi].to_pylist())
        at = slot[f]
        row, at = row[at < n], at[at < n]
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        yield lo, hi, pa.array([np.sort(at[a:e]).astype("<u4").tobytes() for a, e in pairwise(edges)], pa.binary())


def _sample(docs: DataFrame, most: int, total: int, names: np.ndarray, salt: int) -> list[np.ndarray]:
    """The features, as places in names, of the `most` documents whose ids have the smallest hashes: the same documents in the
    same order however they are dealt to tasks."""
    h = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots(names)
        for b in batches:
            for lo, hi, kept in _listed(b.column(3), slot, len(names)):
                yield pa.RecordBatch.from_arrays([*(b.column(k)[lo:hi] for k in range(3)), kept], ["h", "doc_id", "t", "f"])

    def first(share: float) -> list[np.ndarray]:
        rows = docs.where(h <= int(share * (1 << 30))).select(h.alias("h"), F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
        kept = rows.mapInArrow(run, "h long, doc_id string, t long, f binary").orderBy("h", "doc_id", "t").limit(most).select("f").collect()
        return [np.frombuffer(r.f, "<u4") for r in kept]

    share = min(1.0, 1.2 * most / max(total, 1) + 1e-6)
    found = first(share)
    return found if share == 1 or len(found) == most else first(1.0)


def _dealt(docs: DataFrame, names: np.ndarray, parts: int, seed: int) -> DataFrame:
    """(part, f, n): each different list f of features with the number of its documents, shared out evenly among the parts.

    Equal lists are counted before anything is shuffled. A list of fewer documents than parts gives one to each of as many
    parts, beginning at one that its hash says; so a list that many documents have weighs the same in all parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots(names)
        for b in batches:
            for _, _, kept in _listed(b.column(0), slot, len(names)):
                yield pa.RecordBatch.from_arrays([kept], ["f"])

    n, c = F.lit(parts).cast("long"), F.col("c")
    lists = docs.select("text").mapInArrow(run, "f binary").groupBy("f").agg(F.count("*").alias("c"))
    spread = lists.select("f", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.least(c, n) - 1)).alias("k"))
    part = F.pmod(F.pmod(F.xxhash64("f", F.lit(seed)), n) + F.col("k"), n)
    return spread.select(part.alias("part"), "f", (F.floor(c / n) + (F.col("k") < c % n).cast("long")).alias("n"))


def _fitted(dealt: DataFrame, rows_p: list[np.ndarray], n: int, prior: float, models: int, tasks: int) -> list[tuple[np.ndarray, float]]:
    """A classifier for each remainder of the parts' numbers by `models`: the mean of the weights of its parts, each of which
    is fitted in a task that holds that part and the confirmed documents. At most (n + 1) * models rows reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, met = np.zeros((models, n + 1), np.int64), np.zeros(models, np.int64)
        for (part,), rows in by_key(frames, ["part"]):
            w, b = fit_nnpu(rows_p, [np.frombuffer(f, "<u4") for f in rows["f"]], n, prior, rows["n"].to_numpy())
            total[part % models] += np.rint(np.append(w, b) * UNIT).astype(np.int64)
            met[part % models] += 1
        for m in met.nonzero()[0]:
            yield pd.DataFrame({"model": int(m), "at": np.arange(n + 1), "w": total[m], "parts": met[m]})

    sums = dealt.repartition(tasks, "part").sortWithinPartitions("part", "f").mapInPandas(run, "model int, at int, w long, parts long")
    rows = sums.groupBy("model", "at").agg(F.sum("w").alias("w"), F.sum("parts").alias("parts")).toPandas().sort_values(["model", "at"])
    means = [(g["w"] / UNIT / g["parts"]).to_numpy() for _, g in rows.groupby("model")]
    return [(w[:-1], float(w[-1])) for w in means]


def train(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, models: int = MODELS, seed: int = 42
) -> tuple[np.ndarray, list[tuple[np.ndarray, float]]]:
    """(features, classifiers as weights of them and bias). Positives: documents that labels (doc_id, toxic) confirms as toxic
    in any row; all of docs is the unlabelled side. The class prior is the share of toxic among the labelled ones.

    Features, counted over all confirmed and all unlabelled documents, are those that LEAST confirmed documents or more have,
    and that are over RATIO times more frequent there. All unlabelled documents take part in the risk: they are dealt to parts
    of about `unlabelled` documents, `models` parts at least; the steps are taken in each part, beside the same confirmed
    documents, and each classifier is the mean of every so manyth part. Of the confirmed documents the steps read at most
    `positives`, those whose ids have the smallest hashes. Rows with equal ids are told apart by their texts, and weights are
    added up in whole numbers, so the result does not depend on how rows are dealt to tasks. Without a positive there is one
    model, which gives the prior alone.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic, n_known = known.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    prior = min(0.5, max(0.001, n_toxic / max(n_known, 1)))
    nothing = np.zeros(0, np.int64), [(np.zeros(0), float(np.log(prior / (1 - prior))))]
    if not n_toxic:
        return nothing
    confirmed = docs.join(bounded(known.where("toxic = 1").select("doc_id"), HELD_IDS), "doc_id", "left_semi")
    n_p, n_u = confirmed.count(), docs.count()
    if not n_p:
        return nothing
    names, in_p = _frequencies(confirmed, _counted)
    names, in_p = names[in_p >= LEAST], in_p[in_p >= LEAST]
    seen, count = _frequencies(docs, _counted_in(names))
    in_u = np.zeros(len(names), np.int64)
    in_u[np.searchsorted(names, seen)] = count
    names = names[(in_p + 0.1) / (n_p + 1) > RATIO * (in_u + 0.1) / (n_u + 1)]
    rows_p = _sample(confirmed, positives, n_p, names, 3)
    parts = max(models, -(-n_u // unlabelled))
    tasks = min(parts, 8 * docs.sparkSession.sparkContext.defaultParallelism)
    return names, _fitted(_dealt(docs, names, parts, seed), rows_p, len(names), prior, models, tasks)


def score(docs: DataFrame, names: np.ndarray, models: list[tuple[np.ndarray, float]]) -> DataFrame:
    """(doc_id, score): the mean of the models' probabilities for the whole text. A row for each row of docs; an empty or null
    text has no words; null ids stay null; other columns are ignored."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots(names)
        tables = [(np.append(w, 0.0), b) for w, b in models]
        for batch in batches:
            for lo, hi in chunks(batch.column(1).to_pandas()):
                row, feature = features(batch.column(1)[lo:hi].to_pylist())
                s = slot[feature]
                row, s = row[s < len(names)], s[s < len(names)]
                p = [1 / (1 + np.exp(-np.clip(np.bincount(row, weights=t[s], minlength=hi - lo) + b, -40, 40))) for t, b in tables]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.mean(p, axis=0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, learned from rows that aren't held out.

    Null and empty texts get the score of a text without words. A null doc_id counts as not held out. Repeated rows repeat.
    """
    kept = lambda df: df.where(~F.coalesce(held_out(), F.lit(False)))
    bound_batches(spark)
    out = score(docs, *train(kept(docs.select("doc_id", "text")), kept(labels.select("doc_id", "toxic"))))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
