"""SimHash near-duplicate groups, searched with BK-trees in shards that pigeonhole on two blocks of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded, by_key, components, content_key, cut, fresh, released, stored

BITS, SEED = 64, 42
#: Fingerprints in one tree; a shard with more is cut into parts, and each pair of parts is searched.
TREE = 2048
#: Keys of rows that are broadcast, at most (16 bytes each); more are joined by a shuffle.
HELD_KEYS = 2_000_000


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words make one shingle, no word none."""
    tokens = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    pairs = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")


def vote(hashes: np.ndarray) -> int:
    """64 bits: bit i is set if it is set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    return vote(shingles(text, words))


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self, values: list[int]) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for x in values:
            self.add(x)

    def add(self, x: int) -> None:
        node = 0
        while self.values:
            d = (x ^ self.values[node]).bit_count()
            if d == 0:
                return
            if d not in self.children[node]:
                self.children[node][d] = len(self.values)
                break
            node = self.children[node][d]
        self.values.append(x)
        self.children.append({})

    def near(self, x: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (x ^ self.values[node]).bit_count()
            if d <= radius:
                yield self.values[node]
            stack += [c for k, c in self.children[node].items() if d - radius <= k <= d + radius]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t, words) for t in b.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out)], ["doc_id", "t1", "t2", "fp"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): t1 and t2 name the text (null: empty)."""
    t1, t2 = content_key(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")


def _links(radius: int):
    """Edges that join what the trees link: enough to hold each shard's components together, and no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for (_, i, j), rows in by_key(batches, ["key", "i", "j"]):
            fps, part = rows["fp"].to_numpy().view(np.uint64).tolist(), rows["part"].tolist()
            held = [x for x, p in zip(fps, part, strict=True) if p == i]
            asks = held if i == j else [x for x, p in zip(fps, part, strict=True) if p == j]
            tree, above = BKTree(held), {x: x for x in fps}

            def top(x: int) -> int:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            for x in asks:
                for y in tree.near(x, radius):
                    if (a := top(x)) != (b := top(y)):
                        above[a] = b
                        found.append((x, y))
            if len(found) > 50_000:
                yield _frame(found)
                found = []
        yield _frame(found)

    return run


def _frame(found: list[tuple[int, int]]) -> pd.DataFrame:
    a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})


def _keys(radius: int) -> F.Column:
    """One key for each pair of blocks: with radius + 2 blocks, two fingerprints in the radius agree on two at least."""
    n = radius + 2
    edges = [round(k * BITS / n) for k in range(n + 1)]
    block = [F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    width = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    keys = [
        F.shiftleft(F.shiftleft(F.lit(c).cast("long"), width[p]).bitwiseOR(block[p]), width[q]).bitwiseOR(block[q])
        for c, (p, q) in enumerate(combinations(range(n), 2))
    ]
    return F.explode(F.array(*keys)).alias("key")


def _simhash_rows(docs: DataFrame, radius: int, words: int, tree: int) -> DataFrame:
    """(doc_id, t1, t2, fp, root, component_id) for each row of docs; root names the group."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = cut(_keyed(docs).mapInArrow(released(_fingerprints(words)), f"doc_id {kind}, t1 long, t2 long, fp long"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    keyed = nodes.select("fp", _keys(radius))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree).cast("int")
    spread = (
        keyed.join(sizes, "key")
        .select("key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
        .select("key", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("key", "fp", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    edges = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(released(_links(radius)), "a long, b long")
    roots = components(edges)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(ids, "root"), "fp").select("doc_id", "t1", "t2", "fp", "root", "component_id")


def simhash_groups(docs: DataFrame, radius: int = 4, words: int = 4, tree: int = TREE) -> DataFrame:
    """(doc_id, fp long, component_id): documents whose fingerprints link, directly or over others.

    One row for each row of docs. Null, empty and blank texts have fingerprint 0 and link like any other. Equal
    fingerprints meet once, before the search, so a hot text costs one node; a shard with many fingerprints is cut into
    parts of about `tree` and all pairs of parts are searched, so no link is lost. Trees are built where a shard's rows
    meet, not broadcast, as their size grows with the corpus. component_id is the smallest doc_id in the group (null ids take
    part; it is null if all are). An empty table gives an empty one. Other columns are ignored.
    """
    return _simhash_rows(docs, radius, words, tree).select("doc_id", "fp", "component_id")


def _first_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs, one for each root of rows (doc_id, t1, t2, root): the one with the smallest doc_id (null ids last),
    then the smallest hash of its text. Rows with the same doc_id and text are one.

    What goes is named by hashes of doc_id and text; up to HELD_KEYS of them are broadcast, so that texts aren't shuffled.
    """
    k1, k2 = fresh(docs, "k1", "k2")
    at = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t1", "t2")
    each = rows.groupBy("root", at.alias("at")).agg(F.count("*").alias("n"))
    first = each.groupBy("root").agg(F.min("at").alias("first"))
    a, b = content_key(F.col("at.doc_id"), F.col("at.t1"), F.col("at.t2"))
    marks = cut(each.join(first, "root").select(a.alias(k1), b.alias(k2), (F.col("at") == F.col("first")).alias("stays"), "n").where("NOT stays OR n > 1"))
    gone = bounded(marks.select(k1, k2), HELD_KEYS)
    a, b = content_key("doc_id", *content_key(F.coalesce("text", F.lit(""))))
    named = docs.withColumns({k1: a, k2: b})
    kept = named.join(gone, [k1, k2], "left_anti").select(docs.columns)
    repeated = bounded(marks.where("stays").select(k1, k2), HELD_KEYS)
    if repeated.isEmpty():
        return kept
    once = named.join(repeated, [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return kept.unionByName(once.select(docs.columns))


def drop_near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """One row for each group of simhash_groups, with docs' columns: the one with the smallest doc_id (null ids last). Two
    texts under one doc_id are rows like any other two."""
    return _first_of(docs, _simhash_rows(docs, radius, words, TREE))


# --- groups by the likeness of shingle sets -----------------------------------------------------------------------------

#: Shards are bands of min-hashes: two texts meet in a band if all its rows agree. At a likeness of 0.8 one of 20 bands of
#: 5 rows does so for 99.97 % of pairs; there fingerprints differ in 9.7 bits on average, in over 20 for 0.03 %.
BANDS, ROWS, WIDE = 20, 5, 20
#: Bytes of the sets in one part of a shard that is searched with the whole sets.
PART_BYTES = 32 << 20
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (3, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(distinct: np.ndarray) -> np.ndarray:
    """The smallest value of each of 100 hash functions over distinct shingle hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 1024):
        np.minimum(low, ((distinct[None, i : i + 1024] ^ _MIX[0][:, None]) * _MIX[1][:, None]).min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    mixed = (low * _MIX[2]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX[0][:BANDS]).view(np.int64)


PRINTS = "uid long, set_id string, fp long, low binary, bands array<long>"
_PRINT_NAMES = ["doc_id", "t1", "t2", "text", *(c.split()[0] for c in PRINTS.split(", "))]


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for text in b.column(3).to_pylist():
                distinct = np.unique(shingles(text, words))
                low = sketch(distinct)
                fp = int(np.uint64(vote(distinct)).view(np.int64))
                out.append((uid, xxhash.xxh3_128_hexdigest(distinct.tobytes()), fp, (low >> np.uint64(20)).astype("<u2").tobytes(), band_keys(low)))
                uid += 1
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], _PRINT_NAMES)

    return run


def widest_forest(edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Maximum spanning forest: between two nodes that an edge links, no edge on the forest's path is worse than it."""
    above: dict[int, int] = {}
    out = []

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for edge in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if (a := top(edge[1])) != (b := top(edge[2])):
            above[a] = b
            out.append(edge)
    return out


def _estimates(rows: pd.DataFrame, i: int, j: int, radius: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of part j, the rows of part i that a tree finds in the radius and min-hashes call alike, and how much."""
    uids, part = rows["uid"].to_numpy(), rows["part"].to_numpy()
    fps = rows["fp"].to_numpy().view(np.uint64).tolist()
    low = np.frombuffer(b"".join(rows["low"]), "<u2").reshape(len(rows), -1)
    where: dict[int, list[int]] = {}
    for at in np.flatnonzero(part == i).tolist():
        where.setdefault(fps[at], []).append(at)
    asks: dict[int, list[int]] = {}
    for at in np.flatnonzero(part == j).tolist():
        asks.setdefault(fps[at], []).append(at)
    tree = BKTree(list(where))
    for x, askers in asks.items():
        near = np.array([at for y in tree.near(x, radius) for at in where[y]], np.int64)
        for at in askers:
            other = near[uids[near] < uids[at]] if i == j else near
            likeness = (low[other] == low[at]).mean(1)
            good = likeness >= least
            yield at, other[good], likeness[good]


def _candidates(radius: int, least: float):
    """For each shard, the forest of the best estimated likenesses among the pairs that its trees find in the radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int, int]] = []
        for (key, i, j), rows in by_key(batches, ["key", "i", "j"]):
            uids, edges = rows["uid"].to_numpy(), []
            for at, other, likeness in _estimates(rows, i, j, radius, least):
                for u, v in zip(uids[other].tolist(), likeness.tolist(), strict=True):
                    edges.append((v, min(u, int(uids[at])), max(u, int(uids[at]))))
                if len(edges) > 200_000:
                    edges = widest_forest(edges)
            found += [(int(key), a, b) for _, a, b in widest_forest(edges)]
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["key", "a", "b"], dtype="int64")
                found = []
        yield pd.DataFrame(found, columns=["key", "a", "b"], dtype="int64")

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"uid": b["uid"], "hashes": [np.unique(shingles(t, words)).tobytes() for t in b["text"]]})

    return run


def _exact(radius: int, least: float, similarity: float):
    """Edges (a, b) between roots. In each shard every pair that its trees and estimates find is compared on the whole sets,
    unless its two rows are in one component already, by earlier links or by those of this shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for (_, i, j), rows in by_key(batches, ["key", "i", "j"]):
            root = rows["root"].to_numpy()
            label = np.unique(root, return_inverse=True)[1]
            size = rows["hashes"].str.len().to_numpy() // 8
            kinds, places = np.unique(np.frombuffer(b"".join(rows["hashes"]), "<u8"), return_inverse=True)
            held = np.split(places.astype(np.int32), np.cumsum(size)[:-1])
            mark = np.zeros(len(kinds), bool)
            for at, other, _ in _estimates(rows, i, j, radius, least):
                other = other[label[other] != label[at]]
                if not len(other):
                    continue
                mark[held[at]] = True
                ends = np.cumsum(size[other])
                total = np.append(0, np.cumsum(mark[np.concatenate([held[o] for o in other])], dtype=np.int64))
                mark[held[at]] = False
                both = total[ends] - total[ends - size[other]]
                good = both / np.maximum(1, size[other] + size[at] - both) >= similarity
                for o in other[good]:
                    if label[o] != label[at]:
                        found.append((int(root[at]), int(root[o])))
                        label[label == label[o]] = label[at]
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
                found = []
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _alike(words: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = []
            for left, right in zip(b["text_a"], b["text_b"], strict=True):
                x, y = np.unique(shingles(left, words)), np.unique(shingles(right, words))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both / max(1, len(x) + len(y) - both) >= similarity)
            yield b.loc[kept, ["a", "b"]]

    return run


def _dealt(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of nodes for each pair of parts (key, i, j), which meet in one task; keyed has key, uid and the key's parts."""
    spread = (
        keyed.select("key", "uid", "parts", F.pmod(F.xxhash64("uid"), "parts").cast("int").alias("part"))
        .join(nodes, "uid")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .drop("parts", "other")
    )
    return spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _texts_of(prints: DataFrame, uids: DataFrame, most: int = 2 * HELD_KEYS) -> DataFrame:
    """(uid, text) of the uids (8 bytes each, up to `most` are broadcast): the other texts are read past and not shuffled."""
    return prints.select("uid", "text").join(bounded(uids, most), "uid", "left_semi")


def _similar_rows(docs: DataFrame, words: int, similarity: float, radius: int, tree: int) -> DataFrame:
    """(doc_id, t1, t2, root, component_id) for each row of docs; root names the group."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = stored(_keyed(docs).mapInArrow(released(_prints(words)), f"doc_id {kind}, t1 long, t2 long, text string, {PRINTS}"), "prints")
    classes = cut(prints.groupBy("set_id").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("first_id")))
    nodes = prints.join(classes.select("uid"), "uid", "left_semi")
    keyed = nodes.select("uid", F.explode("bands").alias("key"))
    members = [F.bit_xor(F.xxhash64("uid", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shards = keyed.groupBy("key").agg(F.count("*").alias("n"), *members).where("n > 1").groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    least = similarity - 0.15
    tasks = _dealt(keyed.join(shards.select("key", F.ceil(F.col("n") / tree).cast("int").alias("parts")), "key"), nodes.select("uid", "fp", "low"))
    asked = cut(tasks.mapInPandas(released(_candidates(radius, least)), "key long, a long, b long"))
    pairs = asked.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    texts = _texts_of(prints, ends)
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(released(_alike(words, similarity)), "a long, b long")
    roots = components(links)
    at = lambda c: F.coalesce(f"root_{c}", c)
    apart = asked.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left").where(at("a") != at("b"))
    again = cut(apart.select("key").distinct())
    named = classes.join(roots, classes.uid == roots.node, "left").select("uid", "set_id", "first_id", F.coalesce("root", "uid").alias("root"))
    if not again.isEmpty():
        open_ = cut(keyed.join(again, "key"))
        held = _texts_of(prints, open_.select("uid").distinct()).mapInPandas(released(_sets(words)), "uid long, hashes binary")
        whole = cut(held.join(nodes.select("uid", "fp", "low"), "uid").join(named.select("uid", "root"), "uid"))
        bytes_ = open_.join(whole.select("uid", F.octet_length("hashes").alias("size")), "uid").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        parts = bytes_.select("key", F.greatest(F.ceil(F.col("n") / tree), F.ceil(F.col("size") / PART_BYTES)).cast("int").alias("parts"))
        more = components(_dealt(open_.join(parts, "key"), whole).mapInPandas(released(_exact(radius, least, similarity)), "a long, b long"))
        named = named.join(more.toDF("root", "top"), "root", "left").select("set_id", "first_id", F.coalesce("top", "root").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.select("doc_id", "t1", "t2", "set_id").join(named.join(ids, "root"), "set_id").select("doc_id", "t1", "t2", "root", "component_id")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = WIDE, tree: int = TREE) -> DataFrame:
    """(doc_id, component_id): documents whose sets of shingles have a Jaccard likeness of `similarity` or more, directly or
    over others.

    Texts with equal sets meet once, before the search. Shards are bands of min-hashes; shards with equal members are searched
    once. Each has BK-trees of the sets' fingerprints, followed within the radius. Of what they find, a shard first hands on the
    spanning forest of the best estimated likenesses, so a group of n texts gives n - 1 pairs; they are checked on the whole
    texts. Where a pair of the forest leaves two components apart, pairs outside the forest may be links: such shards are
    searched again, with the whole sets at hand, and every pair found between two components is compared. No pair is a link
    without such a comparison. A large shard is cut into parts and all pairs of parts are searched. Null, empty and blank
    texts have the empty set and form one group. component_id is the smallest doc_id in the group (null if all are null). One
    row for each row of docs; other columns are ignored; an empty table gives an empty one.
    """
    return _similar_rows(docs, words, similarity, radius, tree).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each group of similar_groups, with docs' columns: the one with the smallest doc_id (null ids last). Two
    texts under one doc_id are rows like any other two."""
    return _first_of(docs, _similar_rows(docs, words, similarity, WIDE, TREE))
