"""Embedding whitening: principal components of the different vectors, by MLlib's block matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut

#: Numbers in a block of rows (4 MB), blocks that a task multiplies in a scatter, and the share of the trace that counts as nothing.
BLOCK, SPLIT, NOTHING = 1 << 19, 8, 1e-12
#: Partitions whose first row numbers are broadcast, at most.
PARTS = 1_000_000
COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x = floor(256 c) as longs (beyond their range: its ends), for rows whose vector is whole and finite."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & ~odd).select("vec_id", x.alias("x"))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """The rows with idx, dense from 0, and first: whether no row with a smaller idx has the same x. Rows are numbered where
    they lie, once, and stored."""
    at = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    sizes = at.groupBy(part).agg(F.count("*").alias("size"))
    starts = bounded(sizes.select("part", (F.expr("sum(size) OVER (ORDER BY part)") - F.col("size")).alias("start")), PARTS)
    rows = at.withColumn("part", part).join(starts, "part").withColumn("idx", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "start")
    firsts = rows.groupBy("x").agg(F.min("idx").alias("idx")).select("idx", F.lit(True).alias("first"))
    return cut(rows.join(firsts, "idx", "left").na.fill(False, ["first"]))


def block_matrix(rows: DataFrame, size: int, dim: int) -> BlockMatrix:
    """Rows (idx, v array<double>) as blocks; numbers that have no row are rows of zeros."""
    table = MLUtils.convertVectorColumnsFromML(rows.select(F.col("idx").alias("index"), array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(table, size, dim).toBlockMatrix(max(1, BLOCK // dim), dim)


def scatter(x: BlockMatrix) -> np.ndarray:
    """x^T x; the sum over blocks is cut into parts of SPLIT blocks, which meet as dim x dim sums."""
    turned, parts = x.transpose(), max(1, x.numRowBlocks // SPLIT)
    product = turned._java_matrix_wrapper.call("multiply", x._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, turned.rowsPerBlock, x.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, x: BlockMatrix, w: np.ndarray) -> DataFrame:
    """(idx, w array<double>): each row of x times w."""
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(*w.shape, w.ravel(order="F").tolist()))], 1), *w.shape)
    rows = callMLlibFunc("getIndexedRows", x.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("idx"), vector_to_array("vector").alias("w"))


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, by falling eigenvalue; the largest entry of each is positive."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return np.maximum(e, 0), u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1, 1)


def _deviation(n: int, sums: list[int], top: int) -> F.Column:
    """The exact sum over dimensions of (n x - S)^2, null where a long can't hold it."""
    bound = n * top + max(abs(s) for s in sums)
    if len(sums) * bound * bound < 1 << 63:
        at = F.zip_with("x", F.lit(sums).cast("array<long>"), lambda x, s: (x * n - s) * (x * n - s))
        return F.aggregate(at, F.lit(0).cast("long"), lambda a, b: a + b)
    wide = "decimal(38,0)"
    whole = F.array(*(F.lit(str(s)).cast(wide) for s in sums))
    off = F.zip_with("x", whole, lambda x, s: F.try_subtract(F.try_multiply(x.cast(wide), F.lit(str(n)).cast(wide)), s).cast(wide))
    return F.aggregate(off, F.lit("0").cast(wide), lambda a, d: F.try_add(a, F.try_multiply(d, d)).cast(wide)).try_cast("long")


def whitened(vectors: DataFrame, most: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each whole finite vector of (vec_id, embedding)
    and each component up to `most`.

    The fit list holds each different x once (see whole_numbers): n rows with sums S by dimension, both exact. Rows x - S / n
    become a BlockMatrix; its scatter gives the covariance, whose eigenvectors over the roots of their eigenvalues whiten all
    rows by a second product. explained is an eigenvalue over the trace; identity_error the largest entry of the whitened fit
    list's covariance minus the identity, over the components that have any variance (more than 1e-12 of the trace); the others
    have whitened 0. deviation is null where it is too large for a long.

    Vectors of each length are a table of their own (an empty vector has no components), so the lengths are few. Rows with a
    null vector or null or non-finite entries have no result; null and repeated vec_ids stay, repeated rows repeat; an empty
    table gives an empty one; other columns are ignored.

    The driver holds dim x dim numbers and, as Spark's product of block matrices plans there, the place of each block.
    """
    spark = vectors.sparkSession
    out = spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {COLUMNS}")
    rows = numbered_rows(whole_numbers(vectors).withColumn("dim", F.size("x")).where("dim > 0"))
    size = rows.count()
    wide = F.col("x").cast("decimal(38,0)")
    sums = rows.where("first").select("dim", F.posexplode("x").alias("i", "x")).groupBy("dim", "i").agg(F.sum(wide).alias("s"), F.max(F.abs(wide)).alias("top"), F.count("*").alias("n"))
    found: dict[int, list] = {}
    for r in sums.orderBy("dim", "i").collect():  # dim rows for each length of vector
        found.setdefault(r.dim, []).append(r)
    for dim, each in found.items():
        n, whole, top = each[0].n, [int(r.s) for r in each], max(int(r.top) for r in each)
        mean = F.lit([s / n for s in whole]).cast("array<double>")
        own = rows.where(F.col("dim") == dim)
        centred = own.withColumn("v", F.zip_with("x", mean, lambda x, m: x.cast("double") - m))
        covariance = scatter(block_matrix(centred.where("first"), size, dim)) / n
        e, u = components_of(covariance, most)
        trace = float(np.trace(covariance))
        real = e > NOTHING * trace
        scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1)), 0)
        fitted = cut(projected(spark, block_matrix(centred, size, dim), u * scale).join(own.select("idx", "vec_id", "x", "first"), "idx"))
        error = _identity_error(fitted.where("first"), n, np.flatnonzero(real))
        share = F.lit((e / trace if trace > 0 else np.zeros(len(e))).tolist()).cast("array<double>")
        flat = fitted.select("vec_id", _deviation(n, whole, top).alias("deviation"), F.posexplode("w").alias("k", "whitened"))
        out = out.unionByName(flat.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error")))
    return out


def _identity_error(fitted: DataFrame, n: int, real: np.ndarray) -> float:
    """The largest entry of the covariance of w, less the identity, over the given components."""
    at = [F.col("w")[int(k)] for k in real]
    if not at:
        return 0.0
    means = fitted.agg(*(F.avg(a) for a in at)).first()
    off = [a - m for a, m in zip(at, means, strict=True)]
    pairs = [(i, j) for i in range(len(at)) for j in range(i + 1)]
    found = fitted.agg(*(F.sum(off[i] * off[j]) for i, j in pairs)).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(found, pairs, strict=True))
