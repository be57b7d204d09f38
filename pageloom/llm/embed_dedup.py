"""Embedding near-duplicates: PCA-ordered tiles whose inner products stop as soon as no pair can reach the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_key, components, cut

#: Vectors in one side of a tile, and the leading dimensions after which the bound is looked at.
TILE, STEPS = 4096, (8, 16, 32)
SLACK = 1e-9


def _matrix(vectors: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype("f8")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times a power of two (which rounds nothing) that keeps its squares in range."""
    x = x.astype("f8")
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of the unit vectors' components, by number of dimensions."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for d, rows in b.groupby("dim"):
            x = _units(np.stack(rows["embedding"].to_numpy()))
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        i, j = np.indices(m.shape)
        yield pd.DataFrame({"dim": int(d), "i": i.ravel(), "j": j.ravel(), "s": m.ravel()})


def _rotations(unique: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions, the principal axes in falling order: dim x dim numbers reach the driver."""
    sums = unique.select("dim", "embedding").mapInPandas(_moments, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for d, rows in sums.toPandas().groupby("dim"):
        m = np.zeros((d, d))
        m[rows["i"], rows["j"]] = rows["s"]
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


def _placed(rotations: dict[int, np.ndarray], width: float, kind: str):
    """Each vector with the bin of its first principal coordinate: partners are in the same or the next bin. Components
    travel in the table's own precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, rows in b.groupby("dim"):
                x = np.stack(rows["embedding"].to_numpy())
                first = _units(x) @ rotations[int(d)][:, 0]
                yield pd.DataFrame({"rep": rows["rep"], "n": rows["n"], "label": rows["label"], "dim": rows["dim"], "bin": np.floor(first / width).astype("i4"), "vec": [v.tobytes() for v in x.astype(kind)]})

    return run


def tile_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs (one of a, one of b) whose cosine reaches the threshold."""
    a, b = _scaled(a), _scaled(b)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    u, v = (a / na[:, None]) @ rotation, (b / nb[:, None]) @ rotation
    d = u.shape[1]
    cuts = [0, *[s for s in STEPS if s < d], d]
    rest_u, rest_v = ([np.sqrt(np.maximum(0, (m[:, c:] ** 2).sum(1))) for c in cuts] for m in (u, v))
    least = threshold - SLACK
    got_i, got_j = [], []
    for lo in range(0, len(u), 256):
        rows = slice(lo, min(lo + 256, len(u)))
        dense = u[rows, : cuts[1]] @ v[:, : cuts[1]].T
        i, j = np.nonzero(dense + rest_u[1][rows, None] * rest_v[1] >= least)
        part, i = dense[i, j], i + lo
        for k in range(1, len(cuts) - 1):
            if not len(i):
                break
            span = slice(cuts[k], cuts[k + 1])
            part = part + np.einsum("ij,ij->i", u[i, span], v[j, span])
            keep = part + rest_u[k + 1][i] * rest_v[k + 1][j] >= least
            i, j, part = i[keep], j[keep], part[keep]
        if len(i):
            exact = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j])
            keep = exact >= threshold
            got_i.append(i[keep])
            got_j.append(j[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(got_i), np.concatenate(got_j)) if got_i else (none, none)


def _tiles(rotations: dict[int, np.ndarray], threshold: float, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, dim, *_), rows in by_key(batches, ["label", "dim", "abin", "apart", "bbin", "bpart"]):
            left = rows[rows["side"] == 0]
            alone = bool((rows["abin"].iat[0] == rows["bbin"].iat[0]) and (rows["apart"].iat[0] == rows["bpart"].iat[0]))
            right = left if alone else rows[rows["side"] == 1]
            if not len(left) or not len(right):
                continue
            i, j = tile_pairs(_matrix(left["vec"], kind), _matrix(right["vec"], kind), rotations[int(dim)], threshold)
            if alone:
                i, j = i[i < j], j[i < j]
            else:
                j = j + len(left)
            if not len(i):
                continue
            ids = left["rep"].to_numpy() if alone else np.concatenate([left["rep"], right["rep"]])
            n = left["n"].to_numpy() if alone else np.concatenate([left["n"], right["n"]])
            links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
            root = np.arange(len(ids))
            while True:
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            k = np.nonzero(links)[0]
            yield pd.DataFrame({"a": ids[k], "b": ids[root[k]], "links": links[k].astype("i8")})

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows link when labels and numbers of dimensions are equal and the cosine, in double precision, reaches the threshold.
    A null vec_id, label or vector, a zero vector and one with null or non-finite components link with nothing; such a row
    has n_links 0 and is its own component. Equal vectors meet once, with their number. Unit vectors within the threshold
    differ by at most sqrt(2 - 2 threshold) along any axis, so bins of that width on the first principal axis leave only
    neighbouring bins to compare; a bin with many vectors is cut into parts, and every pair of parts is a tile. So the work of
    a label of n vectors that no bin tells apart grows with the square of n, and each vector goes to n / tile tasks, in the
    table's precision. An empty table gives an empty one; other columns are ignored.
    """
    bound_batches(vectors.sparkSession)
    element, kind = ("float", "<f4") if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else ("double", "<f8")
    rows = vectors.select("vec_id", F.col("label").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd & F.exists("embedding", lambda x: x != 0))
    unique = cut(fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")))
    rotations = _rotations(unique)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    placed = unique.mapInPandas(_placed(rotations, width, kind), f"rep long, n long, label {unique.schema['label'].dataType.simpleString()}, dim int, bin int, vec binary")
    placed = cut(placed)
    parts = placed.groupBy("label", "dim", "bin").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    at = placed.join(parts, ["label", "dim", "bin"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    near = parts.select("label", "dim", (F.col("bin") - 1).alias("bin"), F.col("parts").alias("above"))
    below = parts.select("label", "dim", (F.col("bin") + 1).alias("bin"), F.col("parts").alias("under"))
    body = ["rep", "n", "label", "dim", "vec"]
    side = lambda s, ab, ap, bb, bp: [*body, F.lit(s).alias("side"), ab.alias("abin"), ap.alias("apart"), bb.alias("bbin"), bp.alias("bpart")]
    c, upto = F.col, lambda n: F.sequence(F.lit(0), n - 1)
    own = at.select("*", F.explode(upto(c("parts"))).alias("o"))
    sent = (
        own.select(*side(0, c("bin"), c("part"), c("bin"), c("o"))).where("apart <= bpart")
        .unionByName(own.select(*side(1, c("bin"), c("o"), c("bin"), c("part"))).where("apart < bpart"))
        .unionByName(at.join(near, ["label", "dim", "bin"]).select("*", F.explode(upto(c("above"))).alias("o")).select(*side(0, c("bin"), c("part"), c("bin") + 1, c("o"))))
        .unionByName(at.join(below, ["label", "dim", "bin"]).select("*", F.explode(upto(c("under"))).alias("o")).select(*side(1, c("bin") - 1, c("o"), c("bin"), c("part"))))
    )
    keys = ["label", "dim", "abin", "apart", "bbin", "bpart"]
    found = cut(sent.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_tiles(rotations, threshold, kind), "a long, b long, links long"))
    roots = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    known = (
        unique.join(links, unique.rep == links.a, "left").join(roots, unique.rep == roots.node, "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    tagged = fine.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.coalesce(F.col("vec_id").isNull() | F.col("label").isNull() | F.col("embedding").isNull() | odd | ~F.exists("embedding", lambda x: x != 0), F.lit(True)))
    out = tagged.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
