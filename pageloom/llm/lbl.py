"""Language-model scores: a log-bilinear model of word classes, trained by noise-contrastive estimation, times exact word shares."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, remove, table_path
from .words import Words, inside

WORD = inside((0x09, 0x0D), (0x20, 0x20))
#: Text of a block of documents.
BLOCK_BYTES = 4 << 20
#: Words of blocks that meet in a shard, about.
SHARD = 500_000
#: Classes: the end, the most frequent words alone, unseen words, and the other words by their first two bytes (the heaviest
#: beginnings and the rest) and by how often they occur (from so often).
SINGLES, HEADS, BINS = 95, 31, (1, 2, 8, 64)
UNSEEN = SINGLES + 1
CLASSES = UNSEEN + 1 + (HEADS + 1) * len(BINS)
BEFORE = CLASSES  # what stands before a text
#: Words of context, size of vectors, noise samples and tokens of a step, passes over the training texts.
CONTEXT, SIZE, NOISE, STEP, ROUNDS, RATE = 5, 16, 32, 2048, 1, 0.15
#: Models that are averaged at once.
FAN = 64


@dataclass
class Model:
    """Log-bilinear: the score of class c after classes a, b, ... is (near[0] * context[a] + near[1] * context[b] + ...) . target[c] + bias[c]."""

    context: np.ndarray  # (CLASSES + 1, SIZE)
    near: np.ndarray  # (CONTEXT, SIZE), the last class first
    target: np.ndarray  # (CLASSES, SIZE)
    bias: np.ndarray  # (CLASSES,)

    @staticmethod
    def new(share: np.ndarray, seed: int = 42) -> Model:
        """A model that gives each class its share, whatever stands before."""
        r = np.random.default_rng(seed)
        return Model(r.normal(0, 0.1, (CLASSES + 1, SIZE)), np.full((CONTEXT, SIZE), 0.5), r.normal(0, 0.1, (CLASSES, SIZE)), np.log(share))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype("<f8").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Model:
        flat, shapes = np.frombuffer(data, "<f8"), [(CLASSES + 1, SIZE), (CONTEXT, SIZE), (CLASSES, SIZE), (CLASSES,)]
        cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        return Model(*(flat[a:b].reshape(s).copy() for (a, b), s in zip(pairwise(cuts), shapes, strict=True)))

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """Vectors for the classes after each place of a run; before begins CONTEXT classes ahead of the first place."""
        e, n = self.context[before], len(before) - CONTEXT
        return sum(self.near[i] * e[CONTEXT - 1 - i : CONTEXT - 1 - i + n] for i in range(CONTEXT))

    def log_shares(self, stream: np.ndarray, step: int = 1024) -> np.ndarray:
        """Normalised natural log-probabilities of stream[CONTEXT:], by products of whole batches with all classes' vectors."""
        single = Model(*(p.astype("f4") for p in self.parts()))
        out = np.empty(len(stream) - CONTEXT, "f4")
        for a in range(0, len(out), step):
            now = stream[a + CONTEXT : a + CONTEXT + step]
            scores = single.predicted(stream[a : a + CONTEXT + len(now)]) @ single.target.T
            scores += single.bias
            own = scores[np.arange(len(now)), np.minimum(now, CLASSES - 1)]
            top = scores.max(axis=1)
            scores -= top[:, None]
            np.exp(scores, out=scores)
            out[a : a + len(now)] = own - top - np.log(scores.sum(axis=1))
        return out


def contrast(model: Model, stream: np.ndarray, noise: np.ndarray, expected: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(loss, its gradient by part of the model) of telling stream[CONTEXT:] from noise classes, the same for all places.

    expected: log of (noise samples times a class's chance to be one). The loss is the sum over places of
    -log s(own) - sum over noise of log(1 - s(noise)), s the logistic of score minus expected; places before a text don't count.
    """
    now, e = stream[CONTEXT:], model.context[stream]
    n = len(now)
    h = model.predicted(stream)
    live = (now != BEFORE).astype(e.dtype)
    own = np.where(now == BEFORE, 0, now)
    zp = np.einsum("ij,ij->i", h, model.target[own]) + model.bias[own] - expected[own]
    zn = h @ model.target[noise].T + (model.bias - expected)[noise]
    loss = float((np.logaddexp(0, -zp) * live).sum() + (np.logaddexp(0, zn) * live[:, None]).sum())
    gp = -live / (1 + np.exp(np.clip(zp, -40, 40)))
    gn = live[:, None] / (1 + np.exp(-np.clip(zn, -40, 40)))
    dh = gp[:, None] * model.target[own] + gn @ model.target[noise]
    d_target, d_bias = _summed(own, gp[:, None] * h, CLASSES), np.bincount(own, weights=gp, minlength=CLASSES)
    np.add.at(d_target, noise, gn.T @ h)
    np.add.at(d_bias, noise, gn.sum(axis=0))
    de, d_near = np.zeros_like(e), np.empty_like(model.near)
    for i in range(CONTEXT):
        at = slice(CONTEXT - 1 - i, CONTEXT - 1 - i + n)
        de[at] += model.near[i] * dh
        d_near[i] = np.einsum("ij,ij->j", dh, e[at])
    return loss, [_summed(stream, de, CLASSES + 1), d_near, d_target, d_bias]


def _summed(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    at = keys.astype(np.int64)[:, None] * rows.shape[1] + np.arange(rows.shape[1])
    return np.bincount(at.ravel(), weights=rows.ravel(), minlength=n * rows.shape[1]).reshape(n, -1)


def as_stream(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the classes with CONTEXT times BEFORE ahead of each text, where the texts' tokens are in it)."""
    at = np.arange(len(classes)) + CONTEXT * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(classes) + CONTEXT * len(lengths), BEFORE, np.int64)
    out[at] = classes
    return out, at


class Trainer:
    """Adagrad steps over streams of classes, in single precision, from a copy of a model."""

    def __init__(self, model: Model, share: np.ndarray, seed: int) -> None:
        self.model, self.expected = Model(*(p.astype("f4") for p in model.parts())), np.log(NOISE * share).astype("f4")
        self.edges, self.random = np.cumsum(share), np.random.default_rng(seed)
        self.squares = [np.full_like(p, 1e-4) for p in model.parts()]
        self.tokens = 0

    def learn(self, stream: np.ndarray) -> None:
        for a in range(0, len(stream) - CONTEXT, STEP):
            part = stream[a : a + STEP + CONTEXT]
            noise = np.minimum(np.searchsorted(self.edges, self.random.random(NOISE)), CLASSES - 1)
            n = max(1, int((part[CONTEXT:] != BEFORE).sum()))
            for p, g, s in zip(self.model.parts(), contrast(self.model, part, noise, self.expected)[1], self.squares, strict=True):
                g /= n
                s += g * g
                p -= RATE * g / np.sqrt(s)
            self.tokens += n


def _planes(ids: np.ndarray) -> bytes:
    """Numbers below 2^24 as three planes of bytes, which compress well."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(3, -1).T
    return out.view("<u4").ravel()


def _lists(*columns: pa.Array) -> list[pa.Array]:
    """Each column as one row that lists it."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids, lengths in tokens, tokens as numbers of the block's different words (0: the end), these words, and
    how often each is in training documents. Rows: doc_id, held_out, text."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words = Words(rows.column(2), WORD)
        number, first = words.distinct()
        tokens = np.zeros(len(number) + rows.num_rows, np.int64)
        tokens[np.arange(len(number)) + words.rows] = number + 1
        lengths = words.counts + 1
        trained = np.repeat(~rows.column(1).to_numpy(zero_copy_only=False), lengths)
        n = np.bincount(tokens[trained], minlength=len(first) + 1)
        names = pa.concat_arrays([pa.array([""]), words.texts(first)])
        lists = _lists(rows.column(0), rows.column(1), pa.array(lengths.astype(np.int32)), names, pa.array(n))
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), *lists, pa.array([_planes(tokens)])], ["block", "doc_id", "held_out", "lengths", "words", "n", "tokens"])

    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(2).nbytes
        if size >= BLOCK_BYTES:
            yield block()
            held, size, seq = [], 0, seq + 1
    if held:
        yield block()


def _levels(c: np.ndarray) -> np.ndarray:
    """The bin of each count, -1 below the first."""
    return np.searchsorted(BINS, c, side="right") - 1


def _heads(words: Words) -> np.ndarray:
    """The first two bytes of each word as a number (a word of one byte: that byte; the end: 0)."""
    first = words.raw[words.starts].astype(np.int64)
    return np.where(words.lengths > 1, first << 8 | words.raw[words.starts + 1], np.where(words.lengths > 0, first, 0))


@dataclass
class Counts:
    """What all training texts tell: tokens, different words, the words and beginnings with classes of their own, occurrences by
    class, and each class's share as a text that isn't counted meets it."""

    tokens: int
    words: int
    single: list[str]  # the end and the most frequent words
    heads: list[int]
    mass: np.ndarray
    share: np.ndarray

    def classes(self, names: pa.Array, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, unseen_as) of words that occur c times: unseen_as is the class that a word would have if one of its occurrences
        weren't counted, as a text outside the training texts meets it."""
        single = pc.index_in(names, value_set=pa.array(self.single, pa.string())).fill_null(-1).to_numpy()
        place = np.full(1 << 16, len(self.heads))
        place[self.heads] = np.arange(len(self.heads))
        place = place[_heads(Words.of(names))]
        of = lambda c: np.where(single >= 0, single, np.where(c < BINS[0], UNSEEN, UNSEEN + 1 + place * len(BINS) + _levels(c)))
        return of(c), of(c - 1)


def _dealt(shards: int):
    """A block's different words by shard, with their places in the block. Rows: block, words, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                names, n = b.column(1)[k].values, b.column(2)[k].values
                shard = (Words.of(names).hashed() % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                names, n, place, shard = names.take(pa.array(order)), n.take(pa.array(order)), pa.array(order.astype(np.int32)), shard[order]
                edges = np.flatnonzero(np.diff(shard, prepend=-1))
                cuts = pa.array(np.append(edges, len(shard)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, x) for x in (place, names, n)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[edges]), pa.repeat(b.column(0)[k], len(edges)), *lists], ["shard", "block", "place", "words", "n"])

    return run


ANSWERS = "block long, place array<int>, c array<long>, word string, head int, level int, unseen int, n long, words long"
_ANSWERS = pa.schema(
    [("block", pa.int64()), ("place", pa.list_(pa.int32())), ("c", pa.list_(pa.int64())), ("word", pa.string())]
    + [(x, pa.int32()) for x in ("head", "level", "unseen")] + [("n", pa.int64()), ("words", pa.int64())]
)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard by shard, how often each word of a block is in the training texts of all blocks; beside these answers (block, place,
    c) the shard's most frequent words (word, n), and its words and occurrences by beginning and bin. Sorted by shard."""

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in _ANSWERS], schema=_ANSWERS)

    def answers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pa.concat_arrays([h.column(3).flatten() for h in held]).dictionary_encode()
        number, n = code.indices.to_numpy(), np.concatenate([h.column(4).flatten().to_numpy() for h in held])
        c = np.bincount(number, weights=n, minlength=len(code.dictionary)).astype(np.int64)
        at, each = 0, c[number]
        for h in held:
            size = len(h.column(2).flatten())
            edges = h.column(2).offsets.to_numpy()
            lists = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(each[at : at + size]))
            yield rows(block=h.column(1), place=h.column(2), c=lists)
            at += size
        seen = np.flatnonzero(c)
        if not len(seen):
            return
        names, c = code.dictionary.take(pa.array(seen)), c[seen]
        top = pc.select_k_unstable(pa.table({"n": c, "w": names}), SINGLES + 1, [("n", "descending"), ("w", "ascending")])
        yield rows(word=names.take(top), n=pa.array(c[top.to_numpy()]))
        key, counts = np.unique((_heads(Words.of(names)) * 8 + _levels(c)) * 8 + _levels(c - 1) + 1, return_inverse=True)
        n, words = np.bincount(counts, weights=c, minlength=len(key)), np.bincount(counts, minlength=len(key))
        yield rows(head=pa.array(key >> 6), level=pa.array(key >> 3 & 7), unseen=pa.array((key & 7) - 1), n=pa.array(n.astype(np.int64)), words=pa.array(words))

    held: list[pa.RecordBatch] = []
    for b in batches:
        shard = b.column(0).to_numpy()
        for a, z in pairwise([0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]):
            if held and a < z and held[-1].column(0)[0].as_py() != shard[a]:
                yield from answers(held)
                held = []
            if a < z:
                held.append(b.slice(a, z - a))
    if held:
        yield from answers(held)


def totals(answers: DataFrame) -> Counts:
    """What the shards' own totals (see _met) come to; SINGLES words and CLASSES sums reach the driver."""
    heads = answers.where("head is not null").select("head", "level", "unseen", "n", "words")
    tokens, words = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    best = answers.where("word is not null").select("word", "n")
    best = best.where("word = ''").collect() + best.where("word <> ''").orderBy(F.desc("n"), "word").limit(SINGLES).collect()
    single = [r.word for r in best]
    if best:  # these words don't count by beginning
        n = np.array([r.n for r in best])
        away = zip(_heads(Words.of(pa.array(single))).tolist(), _levels(n).tolist(), _levels(n - 1).tolist(), (-n).tolist(), strict=True)
        heads = heads.drop("words").unionByName(answers.sparkSession.createDataFrame(list(away), "head int, level int, unseen int, n long"))
    heads = cut(heads.groupBy("head", "level", "unseen").agg(F.sum("n").alias("n")))
    first = [r.head for r in heads.groupBy("head").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "head").limit(HEADS).collect()]
    place = F.coalesce(F.array_position(F.lit(first).cast("array<int>"), F.col("head")) - 1, F.lit(-1))
    place = F.when(place < 0, len(first)).otherwise(place)
    of = lambda level: F.when(F.col(level) < 0, UNSEEN).otherwise(UNSEEN + 1 + place * len(BINS) + F.col(level))
    mass, share = np.zeros(CLASSES), np.ones(CLASSES)
    for column, out in (("level", mass), ("unseen", share)):
        for r in heads.groupBy(of(column).alias("class")).agg(F.sum("n").alias("n")).collect():
            out[r["class"]] += r.n
        out[: len(best)] += [r.n for r in best]
    return Counts(tokens, words, ["", *single] if "" not in single else single, first, mass, share / share.sum())


def _coded(counts: Counts):
    """Blocks with their tokens' classes (as they are and as unseen), and by document: tokens, known ones, the base score, and
    the log10 share of the words within their classes. Rows: block, place, c, doc_id, held_out, lengths, words, tokens; sorted by
    block, first the row with its tokens, then those with answers."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        row, answers = held[0].slice(0, 1), [held[0].slice(1), *held[1:]]
        names = row.column(6)[0].values
        c = np.zeros(len(names), np.int64)
        for h in answers:
            c[h.column(1).flatten().to_numpy()] = h.column(2).flatten().to_numpy()
        kind, other = counts.classes(names, c)
        tokens, lengths = _from_planes(row.column(7)[0].as_py()), row.column(5)[0].values.to_numpy()
        edges = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x[tokens], edges)
        base = total(np.log10(c + 1)) - lengths * np.log10(counts.tokens + counts.words + 1)
        within = np.where(c > 0, np.log10(np.maximum(c, 1)) - np.log10(np.maximum(counts.mass[kind], 1)), 0.0)
        lists = _lists(row.column(3)[0].values, row.column(4)[0].values, pa.array(lengths), pa.array(total((c > 0).astype(np.int64))), pa.array(base), pa.array(total(within)))
        classes = [pa.array([x.astype(np.uint8)[tokens].tobytes()]) for x in (kind, other)]
        return pa.RecordBatch.from_arrays([row.column(0), *lists, *classes], ["block", "doc_id", "held_out", "lengths", "known", "base", "within", "class", "unseen_as"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(0).to_numpy()
            for a, z in pairwise([0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]):
                if held and a < z and held[-1].column(0)[0].as_py() != keys[a]:
                    yield block(held)
                    held = []
                if a < z:
                    held.append(b.slice(a, z - a))
        if held:
            yield block(held)

    return run


def coded_blocks(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """(blocks, totals) of docs (doc_id, held_out, text); see _coded. The texts are read once: blocks are stored with their tokens
    as numbers, their different words meet those of all blocks in shards of about SHARD words, and the counts come back by block.
    A word is in its shard once for each block that has it."""
    spark = docs.sparkSession
    key, held = docs.schema["doc_id"].dataType.simpleString(), "held_out array<boolean>, lengths array<int>"
    paths = [table_path(spark, f"lm-{x}") for x in ("words", "answers", "classes")]
    schema = f"block long, doc_id array<{key}>, {held}, words array<string>, n array<long>, tokens binary"
    docs.mapInArrow(_blocks, schema).write.parquet(paths[0])
    blocks = spark.read.schema(schema).parquet(paths[0])
    words = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    dealt = blocks.select("block", "words", "n").mapInArrow(_dealt(max(1, -(-words // SHARD))), "shard long, block long, place array<int>, words array<string>, n array<long>")
    dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_met, ANSWERS).write.parquet(paths[1])
    answers = spark.read.schema(ANSWERS).parquet(paths[1])
    counts = totals(answers)
    whole = blocks.select("block", F.lit(0).alias("answer"), "doc_id", "held_out", "lengths", "words", "tokens")
    rows = whole.unionByName(answers.where("block is not null").select("block", F.lit(1).alias("answer"), "place", "c"), allowMissingColumns=True)
    schema = f"block long, doc_id array<{key}>, {held}, known array<long>, base array<double>, within array<double>, class binary, unseen_as binary"
    rows = rows.repartition("block").sortWithinPartitions("block", "answer").select("block", "place", "c", "doc_id", "held_out", "lengths", "words", "tokens")
    rows.mapInArrow(_coded(counts), schema).write.parquet(paths[2])
    for p in paths[:2]:
        remove(spark, p)
    return spark.read.schema(schema).parquet(paths[2]), counts


def _fitted(model: Model, share: np.ndarray):
    """The model after the steps over a task's training documents, with their tokens. Rows: block, held_out, lengths, unseen_as."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for b in batches:
            for k in range(b.num_rows):
                lengths, kept = b.column(2)[k].values.to_numpy(), ~b.column(1)[k].values.to_numpy(zero_copy_only=False)
                classes = np.frombuffer(b.column(3)[k].as_py(), np.uint8)[np.repeat(kept, lengths)]
                t = t or Trainer(model, share, b.column(0)[k].as_py() % 2**32)
                t.learn(as_stream(classes, lengths[kept])[0])
        if t and t.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([float(t.tokens)]), pa.array([t.model.pack()])], ["tokens", "model"])

    return run


def _mean(pairs: Iterable[tuple[float, bytes]]) -> tuple[float, bytes]:
    total, sums = 0.0, 0.0
    for n, data in pairs:
        total, sums = total + n, sums + n * np.frombuffer(data, "<f8")
    return total, (sums / total).tobytes() if total else b""


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, data = _mean((n.as_py(), m.as_py()) for b in batches for n, m in zip(b.column(0), b.column(1), strict=True))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([data])], ["tokens", "model"])


def train(blocks: DataFrame, share: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model after `rounds` passes over all training documents of the blocks. In a pass every task takes noise-contrastive steps
    over its blocks from the same start, and the tasks' models are averaged by their tokens, FAN at a time, until FAN are left."""
    model = Model.new(share)
    for _ in range(rounds):
        rows = cut(blocks.select("block", "held_out", "lengths", "unseen_as").mapInArrow(_fitted(model, share), "tokens double, model binary"))
        while (n := rows.count()) > FAN:
            rows = cut(rows.repartition(-(-n // FAN)).mapInArrow(_averaged, "tokens double, model binary"))
        total, data = _mean((r.tokens, r.model) for r in rows.collect())
        if not total:
            break
        model = Model.unpack(data)
    return model


def scored(blocks: DataFrame, model: Model, key: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of the blocks' documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lengths = b.column(2)[k].values.to_numpy()
                stream, at = as_stream(np.frombuffer(b.column(6)[k].as_py(), np.uint8), lengths)
                each = model.log_shares(stream)[at - CONTEXT].astype("f8")
                score = np.add.reduceat(each, np.cumsum(lengths) - lengths) / np.log(10) + b.column(5)[k].values.to_numpy()
                out = [b.column(0)[k].values, b.column(1)[k].values, pa.array(lengths.astype(np.int64)), b.column(3)[k].values, b.column(4)[k].values, pa.array(score)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = blocks.select("doc_id", "held_out", "lengths", "known", "base", "within", "class")
    return rows.mapInArrow(run, f"doc_id {key}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def language_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Tokens are the words, A-Z lowered, and one end. The model learns from all rows that aren't held out (a null doc_id isn't).
    P(token | text before) is P(class | the CONTEXT classes before), a log-bilinear model's softmax over all classes, times the
    token's share of its class's training tokens. Classes are of bounded number (see the constants); words outside the training
    texts are one symbol, a class of their own, whose chance is learned from each training word's occurrences with one left
    out. base_score is the add-one unigram's. Both are sums of log10 over the tokens.

    Null and empty texts are an end alone; a text is never cut, so a long one is as many steps; repeated rows repeat (and count
    as often in training); an empty table gives an empty one, one without training rows scores with equal chances of classes;
    other columns are ignored. Models of tasks are averaged, so scores (not base_score) depend a little on how rows are dealt.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks, counts = coded_blocks(rows)
    model = train(blocks, counts.share, rounds)
    out = scored(blocks, model, docs.schema["doc_id"].dataType.simpleString())
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
