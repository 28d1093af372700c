"""Choosing weights, fusion methods and extra views from judged searches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import plain_unions

from .evaluate import single_truth_metrics, truth_rank
from .search import best_first, fuse_hits

#: The weights tried for extra views, the methods compared, the shares of a tile's views.
AUX_WEIGHTS = (0.70, 0.80, 0.90, 1.0, 1.05, 1.10)
METHODS = ("max", "weighted_max", "average", "weighted_average", "rrf", "softmax")
VIEW_SHARES = (0.50, 0.30, 0.20)


def tune_aux_weight(hits: DataFrame, truth: DataFrame, grid: Sequence[float] = AUX_WEIGHTS) -> DataFrame:
    """Per weight of the grid: place, weight, recall_1 of the best score, and chosen (the first of the best).

    hits: query_id, ord, tile_id, score, aux (whether an extra view gave it); truth: query_id, true_id.
    One pass: every hit carries an array of its scores, no copy of the hits per weight reaches a shuffle unmerged.
    """
    scores = F.array(*[F.when(F.col("aux"), F.col("score") * w).otherwise(F.col("score")) for w in grid])
    tops = [F.max(F.struct(F.element_at("s", i + 1).alias("score"), (-F.col("tile_id")).alias("t"))).alias(f"top{i}") for i in range(len(grid))]
    best = hits.select("query_id", "tile_id", scores.alias("s")).groupBy("query_id").agg(*tops)
    judged = truth.join(best, "query_id", "left")
    right = F.array(*[F.avg(F.coalesce(-F.col(f"top{i}.t") == F.col("true_id"), F.lit(False)).cast("double")) for i in range(len(grid))])
    rows = judged.agg(right.alias("r")).select(F.array_max("r").alias("most"), F.array_position("r", F.array_max("r")).alias("first"), F.posexplode("r").alias("place", "recall_1"))
    return rows.select("place", F.element_at(F.array(*map(F.lit, map(float, grid))), F.col("place") + 1).alias("weight"), "recall_1", (F.col("place") + 1 == F.col("first")).alias("chosen"))


def fusion_bakeoff(hits: DataFrame, truth: DataFrame, methods: Sequence[str] = METHODS, loss: float = 0.01) -> DataFrame:
    """Metrics of each fusion method and the winner: method, n, r1, r5, r10, mrr, ndcg5, admitted, winner.

    A method that loses more than ``loss`` of R@1 against ``max`` isn't
    admitted; the winner has the best R@5, then R@1, then the first name.
    """
    plain_unions(hits.sparkSession)
    parts = []
    for method in methods:
        fused = fuse_hits(hits, method).withColumn("rank", best_first())
        parts.append(single_truth_metrics(truth_rank(fused, truth)).withColumn("method", F.lit(method)))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    base = table.where("method = 'max'").select(F.col("r1").alias("base"))
    table = table.join(F.broadcast(base)).withColumn("admitted", F.col("r1") >= F.col("base") - loss).drop("base")  # one row
    order = Window.orderBy(F.col("admitted").desc(), F.col("r5").desc(), F.col("r1").desc(), "method")  # as many rows as methods
    return table.withColumn("winner", F.row_number().over(order) == 1)


def fuse_views(views: DataFrame, shares: Sequence[float] = VIEW_SHARES) -> DataFrame:
    """A unit vector per tile from its first views: tile_id, i, x.

    Weights are made to sum to 1 over the views present.  views: tile_id, ord (from 0), v.
    """
    weighted = views.where(F.col("ord") < len(shares)).withColumn("w", F.element_at(F.array(*map(F.lit, shares)), F.col("ord") + 1))
    mean = weighted.select("tile_id", "w", F.posexplode("v").alias("i", "x")).groupBy("tile_id", "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("tile_id")))
    return mean.select("tile_id", "i", (F.col("x") / F.greatest(length, F.lit(1e-12))).alias("x"))


def prune_views(views: DataFrame, primary: float = 0.985, other: float = 0.99) -> DataFrame:
    """The views worth keeping: tile_id, ord.  The primary (ord 0) stays.

    Another stays, in the order of ord, if its cosine is below ``primary`` to
    the primary and below ``other`` to each one kept.  views: tile_id, ord, v; a
    tile has a handful of views.
    """

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        m = np.array(group["v"].tolist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for i, k in enumerate(group["ord"]):
            if k == 0 or all(m[i] @ m[j] < (primary if group["ord"].iloc[j] == 0 else other) for j in kept):
                kept.append(i)
        return group.iloc[kept][["tile_id", "ord"]]

    return views.groupBy("tile_id").applyInPandas(keep, "tile_id long, ord int")
