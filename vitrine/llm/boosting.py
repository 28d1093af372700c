"""Document quality by histogram gradient-boosted trees.

Every text becomes a row of statistics (``document_stats``).  Their values are
cut into at most 64 bins at quantiles; each tree grows level by level to a fixed
depth, choosing each node's split by the gain of its gradient histograms (sums
of gradients and curvatures in each bin), under logistic loss.  A grown model is
four arrays (feature, bin edge, leaf, start), each tree a complete binary tree
in breadth-first order, and a batch of rows goes down all trees at once by
fancy indexing: node = 2 * node + 1 + (value > edge).

Labels may be wrong and lopsided: leaves are damped, and the shrinkage, the
number of trees and the row shares are fixed parameters, not fitted to any
held-out row.  Language, source and id are never statistics.

Scale: the fit takes a bounded, documented sample of labelled rows
(``sample_rows``), chosen by a hash of the id; what reaches the driver is their
statistics, some 40 numbers a row, never their texts.  Scoring is one pass over all
texts without a shuffle, with a model of fixed size.

Edge cases: null and empty texts have the statistics 0 and are scored like any
other row; null labels are not learnt from; without any label every score is
0.5, with one class only it is near that class; repeated rows are scored alike;
very long texts are read whole; an empty table gives an empty result; other
columns of the input, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .document_stats import NAMES, statistics
from .word_arrays import by_bytes

BINS, DEPTH, TREES, RATE, DAMPING, LEAST_CURVATURE = 64, 4, 150, 0.08, 5.0, 3.0


@dataclass
class BoostedTrees:
    """Trees in arrays: [tree, inner node] feature and edge, [tree, leaf] value; start is the log-odds before any tree."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), np.int32))
    edge: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))
    start: float = 0.0

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches; all trees and rows step down one level at a time."""
        out = np.full(len(rows), self.start)
        trees, inner = self.feature.shape
        if not trees or not len(rows):
            return out
        base = (np.arange(trees) * inner)[:, None]
        node = np.zeros((trees, len(rows)), np.int64)
        features, edges, column = self.feature.ravel(), self.edge.ravel(), np.arange(len(rows))
        for _ in range(int(np.log2(inner + 1))):
            at = base + node
            node = 2 * node + 1 + (rows[column, features[at]] > edges[at])
        return out + np.take_along_axis(self.leaf, node - inner, 1).sum(0)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows), -30, 30)))


def bin_edges(rows: np.ndarray) -> list[np.ndarray]:
    """At most BINS - 1 edges for each statistic, at quantiles of its different values."""
    out = []
    for column in rows.T:
        kinds = np.unique(column)
        middles = (kinds[1:] + kinds[:-1]) / 2
        out.append(middles if len(middles) < BINS else np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf")))
    return out


def grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree of full depth: features, edges, leaf values, and each row's leaf.  A node that isn't split sends all rows left."""
    inner, m = 2**DEPTH - 1, binned.shape[1]
    feature, edge, node = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(len(g), np.int64)
    offsets = np.arange(m) * BINS
    valid = np.concatenate([np.arange(BINS) < len(e) for e in edges])
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        flat = ((node - first)[:, None] * (m * BINS) + offsets + binned).ravel()
        hist_g = np.bincount(flat, np.repeat(g, m), width * m * BINS).reshape(width, m, BINS)
        hist_h = np.bincount(flat, np.repeat(h, m), width * m * BINS).reshape(width, m, BINS)
        left_g, left_h = hist_g.cumsum(2), hist_h.cumsum(2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + DAMPING) + right_g**2 / (right_h + DAMPING) - all_g**2 / (all_h + DAMPING)
        gain[(left_h < LEAST_CURVATURE) | (right_h < LEAST_CURVATURE)] = -1
        gain = np.where(valid, gain.reshape(width, -1), -1)
        best = gain.argmax(1)
        split = gain[np.arange(width), best] > 1e-9
        nodes = first + np.arange(width)
        feature[nodes] = np.where(split, best // BINS, 0)
        cut = np.where(split, best % BINS, BINS)
        edge[nodes] = [edges[f][c] if s else np.inf for f, c, s in zip(best // BINS, cut, split, strict=True)]
        mine = node - first
        node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[mine])
    leaf = node - inner
    value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + DAMPING)
    return feature, edge, RATE * value, leaf


def fit_trees(rows: np.ndarray, labels: np.ndarray, trees: int = TREES) -> BoostedTrees:
    """Boost on rows of statistics and labels 0 or 1."""
    if not len(labels):
        return BoostedTrees()
    edges = bin_edges(rows)
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T, strict=True)])  # value > edge: the next bin
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    odds = np.full(len(labels), start := float(np.log(rate / (1 - rate))))
    grown = []
    for _ in range(trees if 0 < labels.sum() < len(labels) else 0):
        p = 1 / (1 + np.exp(-odds))
        feature, edge, leaf, reached = grow(binned, p - labels, p * (1 - p), edges)
        odds += leaf[reached]
        grown.append((feature, edge, leaf))
    if not grown:
        return BoostedTrees(start=start)
    return BoostedTrees(*(np.stack(x) for x in zip(*grown, strict=True)), start)


def with_statistics(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """columns and ``stats``, an array of doubles."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            rows = statistics(batch.column(text))
            stats = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32), rows.ravel())
            yield pa.record_batch([*(batch.column(c) for c in columns), stats], [*columns, "stats"])

    kinds = dict(docs.dtypes)
    given = docs.select(*columns, *([text] if text not in columns else []))
    return given.mapInArrow(compute, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", stats array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; the remainder 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> BoostedTrees:
    """Fit on at most sample_rows labelled documents, in the order of a hash of the id; held-out ids never take part."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("rank", F.xxhash64("doc_id", F.lit("quality")))
        .orderBy("rank", "doc_id").limit(sample_rows)
    )
    # the chosen ids are few by the limit above, whatever the tables' sizes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "rank", "quality")
    got = with_statistics(rows, "text", ["doc_id", "rank", "quality"]).orderBy("rank", "doc_id", "stats").limit(sample_rows).toArrow()
    stats = np.array(got["stats"].combine_chunks().flatten()).reshape(-1, len(NAMES)) if got.num_rows else np.zeros((0, len(NAMES)))
    return fit_trees(stats, np.array(got["quality"].to_pylist(), float).clip(0, 1))


def score_quality(docs: DataFrame, model: BoostedTrees, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add column ``out``, the probability of label 1, to all rows; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)
    columns = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            found = shared.value.probability(statistics(batch.column(text)))
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(found)], [*columns, out])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
