"""From hits of several views to a ranked, filtered result, with what happened to every candidate kept beside it.

Each stage adds its columns to the same rows, and none drops a row before the
end: a search is the explained table with only what is kept, so the two can't
differ.  All windows are by query, over a query's pool.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import families, signals, vectors

from . import search

#: Descriptors that a pair is scored by.
DESCRIPTORS = ("v", "pattern", "edges", "color", "texture", "lab", "family", "sha", "hash", "path", "stem")


def pool(hits: DataFrame, size: int) -> DataFrame:
    """The best view of each tile, and each query's first ``size`` tiles: vector_score, view, pool_rank.  hits: query_id, ord, tile_id, score."""
    best = search.merge_views_max(hits).withColumn("pool_rank", search.best_first())
    return best.where(F.col("pool_rank") <= size).select("query_id", "tile_id", F.col("score").alias("vector_score"), F.col("ord").alias("view"), "pool_rank")


#: Descriptors, by name, from a struct of what a tile keeps of them.
Widen = Callable[[Column], dict[str, Column]]


def pair_components(pairs: DataFrame, tiles: DataFrame, widen: Widen | None = None) -> DataFrame:
    """pairs (query_id, tile_id, …) with both sides' descriptors compared: s_<component>, families, colour penalty, exact, own_file, crop_source.

    tiles: tile_id and DESCRIPTORS; queries are tiles too.  A pair without
    descriptors on either side can't be scored and goes, as where a catalogue
    row has no features.  Bare pairs go to the tiles, then carry these to the
    queries, where they stay to be scored and ranked by query: one shuffle with
    one tile's columns a pair, at any size (no broadcast, and none of the pairs
    is sorted to be joined).  Where ``widen`` makes some descriptors, tiles need
    only hold what these are made of, and pairs carry no more.
    """
    held = [c for c in tiles.columns if c != "tile_id"]
    q, t = (tiles.select(F.col("tile_id").alias(key), F.struct(*held).alias(name)) for key, name in (("query_id", "q"), ("tile_id", "t")))
    both = pairs.join(t.hint("shuffle_hash"), "tile_id").join(q.hint("shuffle_hash"), "query_id")
    made = {f"{side}_{name}": value for side in "qt" if widen for name, value in widen(F.col(side)).items()}
    both = both.withColumns(made) if made else both
    a, b = ({c: F.col(f"{side}_{c}") if f"{side}_{c}" in made else F.col(side)[c] for c in DESCRIPTORS} for side in "qt")
    white = signals.near_white(a["lab"]) & signals.near_white(b["lab"])
    near = vectors.hamming64(a["hash"], b["hash"])
    return both.withColumns(
        {
            "s_embedding": vectors.clamp01(vectors.cosine(a["v"], b["v"])), "s_pattern": vectors.pattern_similarity(a["pattern"], b["pattern"]), "s_color": signals.color_similarity(a["color"], b["color"], 60),
            "s_texture": vectors.texture_similarity(a["texture"], b["texture"]), "s_edge": vectors.edge_similarity(a["edges"], b["edges"]), "query_family": a["family"], "candidate_family": b["family"],
            "color_penalty": vectors.color_penalty(signals.lab_distance(a["lab"], b["lab"]), white), "exact": (a["sha"] == b["sha"]) | near.between(0, 3), "own_file": a["path"] == b["path"], "crop_source": F.coalesce(a["stem"] == b["stem"], F.lit(False)),
        }
    ).drop("q", "t", *made)


def component_score(pairs: DataFrame) -> DataFrame:
    """Add compat and final, the hybrid score."""
    return families.hybrid_score(pairs).withColumn("compat", families.compatibility(F.col("query_family"), F.col("candidate_family")))


def ranked(scored: DataFrame) -> DataFrame:
    """Add score, exact and rerank_rank by the rules on top of the hybrid score."""
    out = search.rerank(scored).withColumn("score", vectors.rounded(F.col("score")))
    return out.withColumn("rank", search.best_first()).withColumn("rerank_rank", F.col("rank"))


def nudged(rows: DataFrame, verify: Column) -> DataFrame:
    """Add nudge, what the verification of near ties added to the score; rank by it."""
    own = rows.withColumns({"before_nudge": F.col("score"), "verify": verify})
    out = search.near_tie_nudge(own, places=6)
    return out.withColumn("nudge", F.col("score") - F.col("before_nudge")).drop("before_nudge")


def explain(hits: DataFrame, tiles: DataFrame, top_k: int, pool_size: int = 50, verify: Column | None = None, widen: Widen | None = None) -> DataFrame:
    """Every candidate of every query with all stages: one row for each tile of the pool.

    pool_rank, vector_score, view; s_<component>, compat, color_penalty, final;
    score, exact, rerank_rank; nudge; floor, kept; rank (null where it isn't
    returned) and lost (where it was lost: weak_filter, top_k, or null).
    """
    scored = component_score(pair_components(pool(hits, pool_size), tiles, widen))
    after = nudged(ranked(scored), F.col("s_edge") if verify is None else verify)
    told = search.weak_verdicts(after, top_k)
    lost = F.when(~F.col("kept"), "weak_filter").when(F.col("out_rank") > top_k, "top_k")
    return told.withColumn("lost", lost).withColumn("rank", F.when(F.col("lost").isNull(), F.col("out_rank"))).drop("out_rank")


def returned(explained: DataFrame) -> DataFrame:
    """The search result: what isn't lost, with the score as it is shown."""
    return explained.where("lost IS NULL").withColumn("display_pct", F.round(vectors.display_percent(F.col("score"), F.col("exact")), 4))


def tile_lookup(explained: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked pair (query_id, tile_id): its ranks in the pool, after rescoring and in the result, and the stage that lost it."""
    own = explained.select("query_id", "tile_id", "pool_rank", "vector_score", "view", "rerank_rank", "score", "floor", "rank", "lost")
    stage = F.when(F.col("pool_rank").isNull(), "not_in_pool").otherwise(F.coalesce("lost", F.lit("returned")))
    return asked.select("query_id", "tile_id").join(own, ["query_id", "tile_id"], "left").withColumn("stage", stage).drop("lost")


def export_selection(result: DataFrame, max_results: int = 12) -> DataFrame:
    """Each query's first results for an export; the number is held between 1 and 100."""
    return result.where(F.col("rank") <= max(1, min(100, max_results)))
