"""Token ids of whole texts, a byte-aligned file format for them, and packing into power-of-two sequences."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, bounded, release, table_path

#: Word stems whose ids a worker keeps, at most; then it starts anew.
KEPT_STEMS = 1_000_000
#: Stems that go through the library at once.
STEMS = 4096
#: Characters of the texts that are encoded at once. All stems known are hashed anew for each chunk, so writing files, where workers
#: hold little else, takes larger ones.
CHUNK, FILE_CHUNK = 2 << 20, 8 << 20
#: Rows of a table of block or file starts that are broadcast, at most (about 24 bytes each); more are joined by a shuffle.
HELD_STARTS = 1_000_000
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: What Unicode calls white space, for RE2. In a text without two of these together or one at an end, each space and line end
#: stands alone: a space begins a pre-token with what follows, a line end is one.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOGETHER = f"^[{_WHITE}]|[{_WHITE}]$|[{_WHITE}][{_WHITE}]"
#: A run of these after a letter or digit is a pre-token of its own.
TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, other bytes for 256 and on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


class Encoder:
    """encode() of the tokenizers library for many texts, with each distinct word stem encoded once.

    Both kinds of tokenizer split texts before merging, so ids of a text are the ids of its pieces in order. "bytes":
    byte-level BPE, where a lone space between two other characters always begins a new pre-token, and a lone line end is
    one; pieces are cut before such spaces and line ends. "words": lower-casing BPE that drops white space; pieces are what stands between ASCII white space. A piece
    that ends in punctuation after a letter or digit is cut there once more, as both kinds of tokenizer do. What is left are
    stems; a stem of letters is one pre-token, whose ids the library's BPE model gives at once; any other goes through the
    whole tokenizer. Pieces and stems are told apart and looked up in Arrow columns, without an object for each.
    """

    _kept: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool, self.kind = Tokenizer.from_file(path), kind
        self.model, self.line_end = self.tool.model, self.tool.encode("\n", add_special_tokens=False).ids
        self.clear()

    @classmethod
    def of(cls, path: str, kind: str) -> Encoder:
        if (path, kind) not in cls._kept:
            cls._kept[path, kind] = cls(path, kind)
        return cls._kept[path, kind]

    def clear(self) -> None:
        self.names = pa.array([], pa.string())
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(pieces of each text, number of each piece's name, names). A byte-level name that begins with a space is a text's
        first piece, which has no space before it; one that begins with a line end stands for itself; others have a space."""
        if self.kind == "words":
            lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        else:
            odd = pc.match_substring_regex(texts, _TOGETHER)
            lists = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")
            if pc.any(odd).as_py():
                apart = pa.array([_LONE_SPACE.split(t) for t in texts.filter(odd).to_pylist()], lists.type)
                mark = odd.to_numpy(zero_copy_only=False)
                place = np.empty(len(mark), np.int64)
                place[~mark], place[mark] = np.arange((~mark).sum()), (~mark).sum() + np.arange(mark.sum())
                lists = pa.concat_arrays([lists, apart]).take(pa.array(place))
        edges = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        words = lists.flatten()
        coded = words.dictionary_encode()
        slot, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self.kind == "bytes" and len(words):
            first = words.take(pa.array(edges[:-1])).dictionary_encode()
            slot[edges[:-1]] = len(names) + first.indices.to_numpy()
            names = pa.concat_arrays([names, pc.binary_join_element_wise("", first.dictionary, " ")])
        return np.diff(edges), slot, names

    def _new(self, stems: list[str]) -> list[list[int]]:
        """Ids of stems, spelt as _pieces names them."""
        out: list[list[int]] = [[]] * len(stems)
        slow: list[tuple[int, str]] = []
        of_bytes, tokenize = self.kind == "bytes", self.model.tokenize
        leads = {" ": ("", []), "\n": ("", self.line_end)} if of_bytes else {}
        plain: tuple[str, list[int]] = ("Ġ" if of_bytes else "", [])
        for i, s in enumerate(stems):
            (head, before), word = (plain, s) if s[:1] not in leads else (leads[s[0]], s[1:])
            if word.isalpha() and (word.isascii() or max(word) < "\u0250" and (of_bytes or word == word.lower())):
                word = word if of_bytes else word.lower()
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
                out[i] = before + [t.id for t in tokenize(head + spelt)]
            else:
                slow.append((i, (" " if head else "\n" if before else "") + word))
        for (i, _), e in zip(slow, self.tool.encode_batch_fast([s for _, s in slow], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _stem_slots(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slot of each stem, starts, lengths, ids): ids of the stem in slot s are ids[starts[s] : starts[s] + lengths[s]]."""
        at = pc.index_in(stems, value_set=self.names)
        new = stems.filter(pc.is_null(at))
        if len(self.names) >= KEPT_STEMS and 2 * len(new) > len(stems):
            self.clear()  # the texts have changed
            at, new = pa.nulls(len(stems), pa.int32()), stems
        slot = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        starts, lengths, ids = self.starts, self.lengths, self.ids
        if len(new):
            gc.disable()  # many small lists that live for a moment
            numbers, ends = [], []
            for part in range(0, len(new), STEMS):  # what the library returns is many times larger than the ids
                got = self._new(new[part : part + STEMS].to_pylist())
                ends.append(np.fromiter(map(len, got), np.int64, len(got)))
                numbers.append(np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1].sum())))
            gc.enable()
            n = np.concatenate(ends)
            slot[slot < 0] = len(starts) + np.arange(len(new))
            starts = np.concatenate([starts, len(ids) + np.cumsum(n) - n])
            lengths = np.concatenate([lengths, n])
            ids = np.concatenate([ids, *numbers])
            if len(self.names) < KEPT_STEMS:  # else what is new serves these texts only
                self.names = pa.concat_arrays([self.names, new])
                self.starts, self.lengths, self.ids = starts, lengths, ids
        return slot, starts, lengths, ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. No text is null."""
        counts, slot, names = self._pieces(texts)
        if not len(slot):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        stem, tail = _stems(names)
        if self.kind == "bytes":
            tail = pc.binary_join_element_wise("", tail, " ")
        both = pa.concat_arrays([stem, tail]).dictionary_encode()
        at, starts, lengths, ids = self._stem_slots(both.dictionary)
        place = at[both.indices.to_numpy()].reshape(2, -1).T
        n = lengths[place]
        flat, total = _gather(ids, starts[place].ravel(), n.ravel()), n.sum(1)  # of the names
        size = total[slot]
        flat = _gather(flat, (np.cumsum(total) - total)[slot], size)
        before = np.concatenate([[0], np.cumsum(size)])
        return flat, np.diff(before[np.concatenate([[0], np.cumsum(counts)])])


def _gather(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[starts[0] : starts[0] + n[0]], then those of the next start, and so on."""
    ends = np.cumsum(n)
    return values[np.repeat(starts - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _stems(names: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Names without their TAILS, and these; a name whose rest does not end in a letter or digit, and one that may hold a
    special token or İ (in lower case it ends in a mark, not a letter), stays whole."""
    stem = pc.utf8_rtrim(names, characters=TAILS)
    (at, raw), (to, left) = _bytes_of(names), _bytes_of(stem)
    last = np.where(np.diff(to) > 0, left[np.maximum(to[1:] - 1, 0)] if len(left) else 0, 0)
    ends = _ALNUM[last]
    wide = np.nonzero(last >= 128)[0]
    if len(wide):
        ends[wide] = pc.match_substring_regex(stem.take(pa.array(wide)), r"[\pL\pN]$").to_numpy(zero_copy_only=False)
    cut = ends & ~pc.match_substring_regex(names, r"<\||İ").to_numpy(zero_copy_only=False)
    n = np.where(cut, np.diff(at) - np.diff(to), 0)
    tail = _gather(raw, at[1:] - n, n)
    edges = np.concatenate([[0], np.cumsum(n)]).astype("<i4")
    return pc.if_else(pa.array(cut), stem, names), pa.StringArray.from_buffers(len(n), pa.py_buffer(edges), pa.py_buffer(tail))


def encode(texts: pa.Array, path: str, kind: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts (null: empty) with end_id after each, and the lengths with it."""
    flat, n = Encoder.of(path, kind)(pc.fill_null(texts, ""))
    out = np.empty(len(flat) + len(n), np.uint32)
    ends = np.cumsum(n + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = flat, end_id
    return out, n + 1


def _chunks(batch: pa.RecordBatch, path: str, kind: str, end_id: int, chunk: int = CHUNK) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, lengths) of some rows of a batch (doc_id, text) after others; texts of about `chunk` bytes at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    for lo, hi in pairwise(np.unique([0, *np.nonzero(np.diff(size // chunk))[0] + 1, len(size)]).tolist()):
        yield batch.column(0)[lo:hi], *encode(batch.column(1)[lo:hi], path, kind, end_id)
        release()


def _slices(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value for each length: the next so many ids, as little-endian unsigned 32-bit integers."""
    edges = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype("<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


# --- file format: blocks of frequency-ranked ids ------------------------------------------------------------------------

#: Ids in a block, about (a document is never cut).
BLOCK = 1 << 21
BLOCKS = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<int>, names binary, control binary, data binary"
#: For each control byte, the bytes that each of its four values takes.
WIDTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(names, control, data): names holds the ids by falling frequency (ties: smaller id first); the text of ids becomes
    their ranks, of 1 to 4 bytes each; control has two bits for each value, apart from the data."""
    if len(ids) and int(ids.max()) < 1 << 24:  # counts by place, as vocabularies are dense
        counts = np.bincount(ids)
        names = np.nonzero(counts)[0]
        order = names[np.argsort(-counts[names], kind="stable")]
        table = np.empty(len(counts), np.uint32)
        table[order] = np.arange(len(order), dtype=np.uint32)
        value = table[ids]
    else:
        names, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        place = np.argsort(-counts, kind="stable")
        order, table = names[place], np.empty(len(names), np.uint32)
        table[place] = np.arange(len(names), dtype=np.uint32)
        value = table[inverse]
    width = 1 + (value > 0xFF).astype(np.uint8) + (value > 0xFFFF) + (value > 0xFFFFFF)
    code = np.zeros(-(-len(value) // 4) * 4, np.uint8)
    code[: len(value)] = width - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    ends = np.cumsum(width, dtype=np.int64)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        data[(ends - width)[has] + k] = (value[has] >> np.uint32(8 * k)).astype(np.uint8)
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack_ids(n: int, names: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids again: widths by table lookup on the control bytes, values gathered at their offsets."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(width, dtype=np.int64)
    at = ends - width
    raw = np.frombuffer(data, np.uint8)
    value = raw[at].astype(np.uint32)
    for k in range(1, int(width.max(initial=1))):
        has = width > k
        value[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(names, "<u4")[value]


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            docs, lengths = pa.concat_arrays([h[0].cast(pa.int64()) for h in held]), np.concatenate([h[2] for h in held])
            names, control, data = pack_ids(np.concatenate([h[1] for h in held]))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), whole(docs), whole(pa.array(lengths, pa.int32()))]
            return pa.RecordBatch.from_arrays([*row, *(pa.array([x], pa.binary()) for x in (names, control, data))], _BLOCK_NAMES)

        for batch in batches:
            for chunk in _chunks(batch, path, "bytes", end_id, FILE_CHUNK):
                held.append(chunk)
                size += len(chunk[1])
                if size >= BLOCK:
                    yield block()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    return run


_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def write_ids(docs: DataFrame, tokenizer: str, out: str, end_id: int = 0) -> None:
    """Encode whole texts and write blocks of ids in ascending doc_id order (null ids first, equal ids by a hash of the text).

    Documents are dealt by ranges of doc_id and this hash, and sorted, so part files follow each other in order, blocks in a
    file too, and rows that share an id are dealt like any others. Each block is read alone: it has its doc_ids, lengths, and
    its own ids by falling frequency. Null and empty texts give just the end id; rows repeat as in docs; other columns are
    ignored. An empty table gives files without blocks. Only spark.checkpoint.dir or the caller's path is written.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    dealt = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    dealt.mapInArrow(_blocks(tokenizer, end_id), BLOCKS).write.option("compression", "zstd").parquet(out)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) out of the files: ids are little-endian unsigned 32-bit integers. A row for each
    document in them, null ids and repeats included; no blocks give no rows.

    A block's start is the sum of what comes before it, over a table of a row for each block (about 2 million ids). That is
    joined to the blocks: broadcast up to HELD_STARTS rows, else by a shuffle.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))  # a row for each file
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.select("part", "seq", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("in_part"))
    starts = inner.join(before, "part").select("part", "seq", (F.col("at") + F.col("in_part")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (names, control, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("names", "control", "data")), strict=True)):
                n = b.column("lengths")[k].values.to_numpy().astype(np.int64)
                flat = unpack_ids(int(n.sum()), names, control, data)
                at = b.column("start")[k].as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values, pa.array(at), pa.array(n), _slices(flat, n)], ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.drop("n_ids").join(bounded(starts, HELD_STARTS), ["part", "seq"])
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def with_crc(df: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, the unsigned CRC-32 of their bytes."""
    return df.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


# --- packing ------------------------------------------------------------------------------------------------------------

LONGEST = 2048
PIECES = "doc_id long, start long, length int, doc_tokens long, part int, row long, ids binary"


def binary_pieces(n: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of each piece: every number as a sum of powers of two, as many of `longest` as fit, then the bits of
    the rest from the highest on."""
    docs, lengths = [np.repeat(np.arange(len(n)), n // longest)], [np.full(int((n // longest).sum()), longest, np.int64)]
    for k in range(longest.bit_length() - 2, -1, -1):
        has = np.nonzero(n % longest >> k & 1)[0]
        docs.append(has)
        lengths.append(np.full(len(has), 1 << k, np.int64))
    doc, length = np.concatenate(docs), np.concatenate(lengths)
    order = np.argsort(doc, kind="stable")
    return doc[order], length[order]


def _cut(path: str, end_id: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            for docs, flat, n in _chunks(batch, path, "words", end_id):
                doc, length = binary_pieces(n, longest)
                start = np.cumsum(length) - length - (np.cumsum(n) - n)[doc]
                bit = np.log2(length).astype(np.int64)
                row = np.empty(len(doc), np.int64)
                for k in np.unique(bit):
                    mine = bit == k
                    row[mine] = rows[k] + np.arange(mine.sum())
                    rows[k] += mine.sum()
                columns = [docs.cast(pa.int64()).take(pa.array(doc)), start, length.astype("<i4"), n[doc], np.full(len(doc), part, "<i4"), row, _slices(flat, length)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _PIECE_NAMES)

    return run


_PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST, out: str | None = None) -> DataFrame:
    """Sequences of power-of-two lengths, written by length and read back: (doc_id, start, length, ids, doc_tokens,
    sequence_id, offset).

    Each document's ids, with end_id, are cut into pieces of binary lengths; a piece is a sequence of its own, so no sequence
    holds two documents and none has padding. Sequences of equal length lie together (one folder for each length); their
    ids are dense within the table: each piece carries its number among its task's pieces of that length, and what other
    tasks and lengths have comes before it. That is a table of a row for each task and length, joined to the pieces:
    broadcast up to HELD_STARTS rows, else by a shuffle. Null and empty texts are the end id alone, one piece of length 1.
    Repeated rows give sequences of their own; null ids stay null; other columns are ignored; an empty table gives an empty
    one. Documents and pieces aren't shuffled.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = out or table_path(spark, "packed")
    docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id, longest), PIECES).write.partitionBy("length").option("compression", "zstd").parquet(out)
    rows = spark.read.schema(PIECES).parquet(out)
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("all"))
    bases = totals.select("length", F.coalesce(F.sum("all").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each length
    in_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.join(bases, "length").select("length", "part", (F.col("base") + F.coalesce(F.sum("n").over(in_length), F.lit(0))).alias("first"))
    named = rows.join(bounded(firsts, HELD_STARTS), ["length", "part"])
    return named.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (F.col("first") + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
