"""Whitening of embeddings with MLlib's distributed matrices.

Entries become integers floor(scale * c) + shift, so that sums and deviations
are exact.  Centred rows get consecutive indexes and become the blocks of a
BlockMatrix; its transpose times itself is the scatter, whose d x d entries are
the only thing that reaches the driver, where eigh takes it apart; a second
BlockMatrix product projects all rows on the leading components over the roots
of their eigenvalues.  The identity error is measured on the projected rows, by
a third product.

Scale: rows are read once and staged as integers.  Indexes come from counts by
partition (prefix sums over one row for each partition), so no row moves for
them.  A product splits its middle dimension, a few blocks of rows for each
task, and what meets in one task is one d x d sum from each of them.  MLlib
plans a product on the driver with the numbers of all blocks; blocks of
max(1024, n / 100,000) rows keep these to some 100,000.  d x d doubles must fit
on the driver and d rows of a block in a task: d up to some 4,000.

Edge cases: vectors that are null or hold a null or non-finite entry are
dropped; so are those whose length isn't the table's most common one (ties: the
longer), and empty ones.  Null and repeated ids are kept as they are, repeated
rows count each.  Components without variance (fewer different rows than
dimensions) get whitened and explained 0 and take no part in the identity
error.  A deviation beyond 64 bits is null.  An empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Blocks of rows that one task of a product multiplies.
BLOCKS_A_TASK = 8
EMPTY = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What whitens any row: the mean, one column of the matrix for each component, and all eigenvalues, falling."""

    n: int
    sums: list[int]
    mean: np.ndarray
    matrix: np.ndarray
    eigenvalues: np.ndarray


def integer_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x (array of longs) of the usable vectors, staged, with the place of each row in its partition."""
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & finite)
    x = F.transform(v, lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))
    place = F.monotonically_increasing_id()
    return staged(rows.select("vec_id", x.alias("x")).select("*", F.spark_partition_id().alias("part"), place.alias("place")), "whitening-rows")


def indexed(rows: DataFrame) -> DataFrame:
    """Add ``index``: consecutive from 0 over all partitions.  The broadcast side has a row for each partition."""
    counts = rows.groupBy("part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", (before - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(counts), "part").withColumn("index", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def block_matrix(rows: DataFrame, values: Column, n: int, d: int) -> BlockMatrix:
    """The distributed blocks of rows (index, values)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(values).alias("row")), "row")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(max(1024, -(-n // 100_000)), d)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, d x d.

    The Python method doesn't take the number of splits of the middle dimension
    that Spark's own has, and without them all blocks would meet in one task.
    """
    splits = max(1, -(-m.numRowBlocks // BLOCKS_A_TASK))
    left, right = m.transpose()._java_matrix_wrapper._java_model, m._java_matrix_wrapper._java_model
    return BlockMatrix(left.multiply(right, splits), m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def product(m: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """Rows (index, y) of the distributed matrix times a small local one."""
    d, k = matrix.shape
    block = m.blocks.context.parallelize([((0, 0), DenseMatrix(d, k, matrix.ravel(order="F")))], 1)
    rows = m.multiply(BlockMatrix(block, d, k)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("y"))


def centred(x: Column, mean: np.ndarray) -> Column:
    means = F.lit(mean.tolist())
    return F.zip_with(x, means, lambda a, m: a.cast("double") - m)


def fit(rows: DataFrame, n: int, d: int, components: int) -> tuple[Whitening, BlockMatrix]:
    """The whitening of indexed integer rows of d entries, and their centred blocks."""
    sums = rows.select(F.posexplode("x").alias("pos", "e")).groupBy("pos").agg(F.sum("e").alias("s")).collect()  # d rows
    sums = [s for _, s in sorted((r.pos, r.s) for r in sums)]
    mean = np.array([s / n for s in sums])  # the quotient of two integers, rounded once
    m = block_matrix(rows, centred(F.col("x"), mean), n, d)
    values, axes = np.linalg.eigh(scatter(m) / n)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    k = min(components, d)
    some = values[:k] > values[0] * d * np.finfo(float).eps
    roots = np.where(some, np.sqrt(np.where(some, values[:k], 1)), np.inf)
    return Whitening(n, sums, mean, axes[:, :k] / roots, np.where(values > values[0] * d * np.finfo(float).eps, values, 0)), m


def identity_error(projected: DataFrame, n: int, spread: np.ndarray) -> float:
    """Largest entry of the projected rows' covariance minus the identity, over the components that have variance."""
    means = projected.select(F.posexplode("y").alias("pos", "e")).groupBy("pos").agg(F.avg("e").alias("m")).collect()
    mean = np.array([m for _, m in sorted((r.pos, r.m) for r in means)])
    cov = scatter(block_matrix(projected, centred(F.col("y"), mean), n, len(mean))) / n
    return float(np.abs(cov - np.eye(len(mean)))[np.ix_(spread, spread)].max(initial=0.0))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = integer_rows(vectors, key, vector)
    length = F.size("x")
    top = rows.groupBy(length.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        release(rows)
        return vectors.sparkSession.createDataFrame([], EMPTY)
    d, n = top["d"], top["count"]
    kept = staged(indexed(rows.where(length == d).select("vec_id", "x", "part", F.row_number().over(Window.partitionBy("part").orderBy("place")).alias("place"))) if n < rows.count() else indexed(rows), "whitening-indexed")
    release(rows)
    w, blocks = fit(kept, n, d, components)
    projected = staged(product(blocks, w.matrix), "whitened")
    spread = np.flatnonzero(w.eigenvalues[: w.matrix.shape[1]] > 0)
    error = identity_error(projected, n, spread)
    wide = "decimal(38,0)"
    off = F.zip_with("x", F.lit(w.sums), lambda x, s: (x * n - s).cast("decimal(19,0)"))
    deviation = F.aggregate(off, F.lit(0).cast(wide), lambda a, b: (a + (b * b).cast(wide)).cast(wide)).try_cast("long")
    out = kept.select("index", "vec_id", deviation.alias("deviation")).join(projected, "index").select("vec_id", "deviation", F.posexplode("y").alias("pos", "whitened"))
    total = float(w.eigenvalues.sum())
    explained = F.lit([float(e / total) if total else 0.0 for e in w.eigenvalues[: w.matrix.shape[1]]])
    return out.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))
