"""Which views of a tile are worth their vectors: ablation, strategies, drift of queries from the views and its causes.

Configurations are sets of views, written as bits; view 0 is the primary.  One
row for each query and tile holds its score in every view, and every
configuration is judged from that, without a search of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import vectors

KS = (1, 5)
#: Points of recall that make a view worth keeping, and the least tiles that must have it (a number and a share).
GAIN, LEAST_TILES, LEAST_SHARE = 1.0, 5, 0.05


def configurations(views: int) -> dict[str, int]:
    """All sets of views with the primary, by name: the bits of the others, in order."""
    return {"primary" + "".join(f"+{v}" for v in range(1, views) if mask >> v & 1): mask for mask in range(1, 1 << views, 2)}


def configuration_ranks(hits: DataFrame, truth: DataFrame, masks: dict[str, int]) -> DataFrame:
    """query_id, config, mask, rank of the true tile (null if it isn't found) for each configuration.

    hits: query_id, ord, tile_id, score, each view's best tiles; truth: query_id,
    true_id.  Ranks up to the length of the views' lists are those of a search
    over the configuration's vectors: a tile before it there is before it in the
    list of its best view.  Ties go to the smaller id.
    """
    views = max(m.bit_length() for m in masks.values())
    by_tile = hits.groupBy("query_id", "tile_id").agg(*[F.max(F.when(F.col("ord") == v, F.col("score"))).alias(f"s{v}") for v in range(views)])
    true = by_tile.join(truth, (by_tile["query_id"] == truth["query_id"]) & (by_tile["tile_id"] == truth["true_id"])).select(truth["query_id"], "true_id", *[F.col(f"s{v}").alias(f"t{v}") for v in range(views)])

    def best(mask: int, side: str) -> Column:
        own = [F.col(f"{side}{v}") for v in range(views) if mask >> v & 1]
        return F.greatest(*own) if len(own) > 1 else own[0]

    both = by_tile.join(true, "query_id")
    ahead = lambda m: (best(m, "s") > best(m, "t")) | (best(m, "s") == best(m, "t")) & (F.col("tile_id") < F.col("true_id"))
    ranks = both.groupBy("query_id").agg(*[F.when(F.max(best(m, "t")).isNotNull(), F.count_if(ahead(m)) + 1).alias(f"r{m}") for m in masks.values()])
    all_ranks = truth.select("query_id").join(ranks, "query_id", "left")
    told = F.array(*[F.struct(F.lit(name).alias("config"), F.lit(m).alias("mask"), F.col(f"r{m}").alias("rank")) for name, m in masks.items()])
    return all_ranks.select("query_id", F.explode(told).alias("x")).select("query_id", "x.*")


def recalls(where: Column | None = None, prefix: str = "") -> list[Column]:
    """Recall columns for an aggregate over configuration_ranks."""
    some = F.lit(True) if where is None else where
    return [F.round(F.avg(F.when(some, F.when(F.col("rank") <= k, 1.0).otherwise(0.0))), 6).alias(f"{prefix}recall_{k}") for k in KS]


def view_ablation(hits: DataFrame, truth: DataFrame, have: DataFrame, views: int) -> DataFrame:
    """config, mask, recall_1, recall_5, gain_1, gain_5 (points over the primary), vectors, verdict.

    have: tile_id, ord.  Configurations: the primary, the primary and one view
    each, all views, and the primary with all views worth keeping.
    """
    masks = configurations(views)
    found = configuration_ranks(hits, truth, masks).groupBy("config", "mask").agg(*recalls())
    counts = have.groupBy("ord").agg(F.countDistinct("tile_id").alias("tiles"))
    tiles = F.max(F.when(F.col("ord") == 0, F.col("tiles"))).over(Window.partitionBy())  # a row for each view
    sizes = counts.withColumn("rare", F.col("tiles") < F.greatest(F.lit(float(LEAST_TILES)), LEAST_SHARE * tiles)).agg(F.map_from_entries(F.collect_list(F.struct("ord", "tiles"))).alias("sizes"), F.collect_list(F.when(F.col("rare"), F.col("ord"))).alias("rare"))
    base = found.where("mask = 1").select(F.col("recall_1").alias("b1"), F.col("recall_5").alias("b5"))
    rows = found.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(sizes))  # one row each
    held = F.filter(F.lit(list(range(views))), lambda v: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), v)), F.lit(2)) == 1)
    single = F.size(held) == 2
    aux = F.element_at(held, -1)
    rows = rows.withColumns({"gain_1": vectors.signed_round((F.col("recall_1") - F.col("b1")) * 100, 2), "gain_5": vectors.signed_round((F.col("recall_5") - F.col("b5")) * 100, 2)})
    rows = rows.withColumn("vectors", F.aggregate(held, F.lit(0).cast("long"), lambda n, v: n + F.coalesce(F.element_at("sizes", v), F.lit(0))))
    verdict = F.when(F.col("mask") == 1, "baseline").when(single & F.array_contains("rare", aux), "rejected_rare_view").when(single & ((F.col("gain_5") >= GAIN) | (F.col("gain_1") >= GAIN)), "keep").when(single, "reject")
    rows = rows.withColumn("verdict", verdict)
    kept = F.coalesce(F.sum(F.when(F.col("verdict") == "keep", F.col("mask") - 1)).over(Window.partitionBy()), F.lit(0)) + 1  # a row for each configuration
    rows = rows.withColumn("kept", kept)
    last = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when((F.col("mask") == F.col("kept")), "candidate").when(F.col("mask") == (1 << views) - 1, "reference_full")
    return rows.withColumn("verdict", last).where("verdict IS NOT NULL").select("config", "mask", "recall_1", "recall_5", "gain_1", "gain_5", "vectors", "verdict")


def recommend_views(ablation: DataFrame, views: int) -> DataFrame:
    """One row: the views to use (all of them where these are better by over half a point, or even and better at the first place), and whether the change pays."""
    full = (1 << views) - 1
    row = lambda when, name: F.max(F.when(when, F.struct("recall_5", "recall_1", "mask", "vectors"))).alias(name)
    kept = F.coalesce(F.sum(F.when(F.col("verdict") == "keep", F.col("mask") - 1)).over(Window.partitionBy()), F.lit(0)) + 1
    rows = ablation.withColumn("kept", kept)
    one = rows.agg(row(F.col("mask") == full, "full"), row(F.col("mask") == F.col("kept"), "greedy"), row(F.col("mask") == 1, "base"))
    f, g = F.col("full"), F.col("greedy")
    better = (f["recall_5"] > g["recall_5"] + 0.005) | ((F.abs(f["recall_5"] - g["recall_5"]) <= 0.005) & (f["recall_1"] > g["recall_1"]))
    chosen = F.when(better, f).otherwise(g)
    commit = chosen["recall_5"] >= F.col("base")["recall_5"] + 0.01
    return one.select(chosen["mask"].alias("mask"), chosen["recall_1"].alias("recall_1"), chosen["recall_5"].alias("recall_5"), chosen["vectors"].alias("vectors"), commit.alias("commit"))


def strategy_bakeoff(ranks: DataFrame, customers: DataFrame, baseline: str) -> DataFrame:
    """config, recalls over all queries and over customers' (query_id), differences from the baseline's, place (1 is the winner).

    The order is by the customers' recall at 5 and 1, then everyone's, then the configuration with fewer views and its name.
    """
    own = customers.select("query_id", F.lit(True).alias("customer")).distinct()
    rows = ranks.join(own, "query_id", "left").groupBy("config", "mask").agg(*recalls(), *recalls(F.col("customer"), "customer_"))
    names = [f"{p}recall_{k}" for p in ("", "customer_") for k in KS]
    base = rows.where(F.col("config") == baseline).select(*[F.col(n).alias(f"b_{n}") for n in names])
    rows = rows.crossJoin(F.broadcast(base))  # one row
    order = [F.desc("customer_recall_5"), F.desc("customer_recall_1"), F.desc("recall_5"), F.desc("recall_1"), F.bit_count("mask"), F.asc("config")]
    return rows.select("config", *names, *[vectors.signed_round(F.col(n) - F.col(f"b_{n}"), 6).alias(f"delta_{n}") for n in names], F.row_number().over(Window.orderBy(*order)).alias("place"))


def embedding_drift(queries: DataFrame, views: DataFrame, classes: DataFrame, most: int = 14) -> DataFrame:
    """tile_id, label, variant, cos_primary, cos_aux (the best of the other views, 0 if there is none), for one tile of each of the first classes.

    queries: tile_id, variant, v; views: tile_id, ord, v; classes: tile_id, label.
    """
    first = classes.where("label IS NOT NULL").groupBy("label").agg(F.min("tile_id").alias("tile_id")).orderBy("label").limit(most)
    chosen = F.broadcast(first)  # at most ``most`` rows
    asked, held = queries.join(chosen, "tile_id"), views.join(F.broadcast(first.select("tile_id")), "tile_id").select("tile_id", "ord", F.col("v").alias("w"))
    pairs = asked.join(held, "tile_id").withColumn("cos", vectors.cosine(F.col("v"), F.col("w")))
    out = pairs.groupBy("tile_id", "label", "variant").agg(F.max(F.when(F.col("ord") == 0, F.col("cos"))).alias("cos_primary"), F.coalesce(F.max(F.when(F.col("ord") > 0, F.col("cos"))), F.lit(0.0)).alias("cos_aux"))
    return out.withColumns({c: vectors.signed_round(F.col(c), 4) for c in ("cos_primary", "cos_aux")})


def root_cause(cos_primary: Column, cos_aux: Column, rank: Column, scene: Column, panel: Column, crop: Column) -> Column:
    """Why a query's tile isn't found: the first label that fits."""
    weak = scene & ~panel & crop.isin("center_fallback", "floor_band")
    return (
        F.when((cos_primary < 0.55) & (cos_aux < 0.55), "embedding_drift_query_far_from_all_views").when(weak, F.concat(F.lit("auto_crop_weak_method="), crop)).when(rank <= 5, "ok_in_top5")
        .when((cos_aux >= 0.75) & F.coalesce(rank > 5, F.lit(True)), "aux_aligned_but_distractors_win").otherwise("mixed_query_preprocess_or_ambiguity")
    )


def drift_causes(rows: DataFrame) -> DataFrame:
    """cause, n over rows of cos_primary, cos_aux, rank, scene, panel, crop."""
    names = ("cos_primary", "cos_aux", "rank", "scene", "panel", "crop")
    return rows.groupBy(root_cause(*map(F.col, names)).alias("cause")).agg(F.count("*").alias("n"))
