"""Surface families: which family a surface is of, compatibility, component weights and the hybrid score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import clamp01, total

FAMILIES = ("plain", "marble", "speckled", "terrazzo", "wood", "geometric", "stone", "mosaic", "textured")
COMPONENTS = ("embedding", "pattern", "color", "texture", "edge")
# Weights of the components, in the order of COMPONENTS, by the query's family.
WEIGHTS = {
    "plain": (0.52, 0.03, 0.32, 0.08, 0.05), "marble": (0.52, 0.06, 0.14, 0.12, 0.16), "speckled": (0.68, 0.18, 0.07, 0.04, 0.03), "terrazzo": (0.55, 0.18, 0.13, 0.09, 0.05), "wood": (0.52, 0.05, 0.13, 0.16, 0.14),
    "geometric": (0.62, 0.10, 0.08, 0.06, 0.14), "stone": (0.52, 0.10, 0.15, 0.16, 0.07), "mosaic": (0.55, 0.18, 0.14, 0.08, 0.05), "textured": (0.53, 0.12, 0.14, 0.14, 0.07),
}
# Pairs of families that are often confused, and pairs that don't go together.
CONFUSED = (("marble", "wood"), ("wood", "stone"), ("speckled", "wood"), ("geometric", "wood"), ("plain", "wood"))
UNLIKE = (("speckled", "plain"), ("speckled", "marble"), ("plain", "terrazzo"), ("wood", "mosaic"))
SAME_BONUS, CONFUSED_MALUS, UNLIKE_MALUS = 0.025, -0.045, -0.035

def weight_table(spark: SparkSession) -> DataFrame:
    """family and one weight column for each component: nine rows."""
    return spark.createDataFrame([(f, *w) for f, w in WEIGHTS.items()], "family string, " + ", ".join(f"w_{c} double" for c in COMPONENTS))


def compatibility(query: Column, candidate: Column) -> Column:
    pair = F.concat_ws("|", F.least(query, candidate), F.greatest(query, candidate))
    of = lambda pairs: pair.isin(*["|".join(sorted(p)) for p in pairs])
    return F.when(query == candidate, SAME_BONUS).when(of(CONFUSED), CONFUSED_MALUS).when(of(UNLIKE), UNLIKE_MALUS).otherwise(0.0)


def hybrid_score(pairs: DataFrame) -> DataFrame:
    """Add final: weighted components, family and colour adjustments, then the cut for weak embeddings.

    pairs: query_family, candidate_family, s_<component> for each component, color_penalty.
    """
    df = pairs.join(F.broadcast(weight_table(pairs.sparkSession)), F.col("query_family") == F.col("family"))  # nine rows
    base = sum((F.col(f"s_{c}") * F.col(f"w_{c}") for c in COMPONENTS), F.lit(0.0))
    score = clamp01(base + compatibility(F.col("query_family"), F.col("candidate_family")) + F.col("color_penalty"))
    emb, family = F.col("s_embedding"), F.col("query_family")
    cut = F.when(family.isin("speckled", "terrazzo") & (emb < 0.42), 0.82).when(family.isin("marble", "wood", "stone") & (emb < 0.40), 0.80).when(emb < 0.36, 0.78).when(emb < 0.42, 0.90).otherwise(1.0)
    return df.withColumn("final", score * cut).drop("family", *[f"w_{c}" for c in COMPONENTS])

# ------------------------------------------------------------- which family

#: Names of a pattern array's elements; the last four, and the three before them, may be missing.
PATTERN = ("density", "mean_size", "size_std", "count", "coverage", "consistency", "uniformity", "small", "elongation", "circularity", "vein", "coherence")
# Points of each family's rules, given where all conditions hold.  Points are a number or
# (slope, field, offset, most): slope * (field - offset), from 0 to most.
_WHOLE = ("structured", ">=", 1.0)
RULES = {
    "speckled": (
        ((("small", ">=", 0.60),), 0.25), ((("count", ">=", 0.12),), (1.0, "count", 0.0, 0.25)), ((("coverage", ">=", 0.006), ("coverage", "<=", 0.22)), 0.15), ((("mean_size", "<=", 0.0012),), 0.10),
        ((("uniformity", ">=", 0.35),), 0.10), ((("directionality", "<", 4.0),), 0.10), ((_WHOLE, ("circularity", ">=", 0.65)), 0.12), ((_WHOLE, ("elongation", "<", 0.20)), 0.10), ((_WHOLE, ("vein", "<", 0.20)), 0.08), ((_WHOLE, ("coherence", "<", 0.30)), 0.05),
    ),
    "terrazzo": (
        ((("coverage", ">=", 0.035),), 0.20), ((("count", ">=", 0.06),), 0.10), ((("mean_size", ">=", 0.0009),), 0.20), ((("mean_size", "<", 0.0009), ("variation", ">=", 2.0)), 0.20), ((("small", "<", 0.70),), 0.10), ((("variation", ">=", 2.5),), 0.10),
    ),
    "marble": (
        ((), (8.0, "activity", 0.0, 0.35)), ((), (0.12, "directionality", 2.0, 0.25)), ((("count", "<", 0.20),), 0.15), ((("coverage", "<", 0.12),), 0.10), ((("entropy", ">", 2.0),), 0.05),
        ((("small", "<", 0.35), ("count", "<", 0.15), ("directionality", ">=", 4.0)), 0.20), ((_WHOLE, ("vein", ">=", 0.25)), (0.5, "vein", 0.0, 0.20)), ((_WHOLE, ("elongation", ">=", 0.20)), (0.4, "elongation", 0.0, 0.15)),
        ((_WHOLE, ("coherence", ">=", 0.35)), (0.5, "coherence", 0.30, 0.10)), ((_WHOLE, ("circularity", "<", 0.55)), 0.08),
    ),
    "wood": (
        ((("directionality", ">=", 4.5),), 0.25), ((("coherence", ">=", 0.40),), 0.20), ((("count", "<", 0.18),), 0.10), ((("coverage", "<", 0.10),), 0.10), ((_WHOLE, ("elongation", ">=", 0.25)), 0.15), ((("small", "<", 0.55),), 0.10),
    ),
    "geometric": (
        ((("activity", ">=", 0.02),), 0.20), ((("uniformity", ">=", 0.55),), 0.20), ((("directionality", ">=", 3.5),), 0.15), ((("entropy", ">=", 1.5), ("entropy", "<=", 3.5)), 0.10), ((("count", "<", 0.25),), 0.10),
    ),
    "stone": (
        ((("variation", ">=", 2.0),), 0.20), ((("mean_size", ">=", 0.0008),), 0.15), ((("coverage", ">=", 0.03), ("coverage", "<=", 0.30)), 0.15), ((("small", "<", 0.75),), 0.10), ((("activity", ">=", 0.015),), 0.10),
    ),
    "mosaic": (
        ((("count", ">=", 0.20),), 0.20), ((("variation", ">=", 2.5),), 0.20), ((("coverage", ">=", 0.05), ("coverage", "<=", 0.35)), 0.15), ((("small", ">=", 0.35), ("small", "<=", 0.80)), 0.10), ((("uniformity", ">=", 0.40),), 0.10),
    ),
}
# Factors on a family's points where all conditions hold, and the levels that plain reaches (the greatest counts).
DAMPING = {"marble": (((("small", ">", 0.45),), 0.60), ((("small", ">=", 0.35), ("small", "<=", 0.55)), 0.55), ((("small", ">=", 0.60),), 0.0)), "wood": (((("small", "<", 0.35), ("count", "<", 0.15)), 0.55),)}
PLAIN = (((("coverage", "<", 0.012), ("count", "<", 0.10)), (0.55, 10.0, 0.012)), ((("density", "<", 0.0010), ("coverage", "<", 0.01)), (0.70, 0.0, 0.0)))
TEXTURED, BOTH_OVER, BOTH_FACTOR, BOTH_SMALL = 0.15, 0.45, 0.55, 0.65
# The least score and lead of a class; within the band of small particles the lead must be larger.
LEAST_SCORE, LEAD, BAND_LEAD, BAND = 0.40, 0.08, 0.15, (0.35, 0.55)


def pattern_values(pattern: Column) -> Column:
    """struct of the named values, ``structured`` (1.0 with all twelve) and ``variation``; null for under five values."""
    n = F.size(pattern)
    least = lambda i: 0 if i < 5 else 8 if i < 8 else 12
    values = [F.when(n >= least(i), F.get(pattern, F.lit(i)).cast("double")).otherwise(0.0).alias(name) for i, name in enumerate(PATTERN)]
    mean, spread = F.get(pattern, F.lit(1)).cast("double"), F.get(pattern, F.lit(2)).cast("double")
    values += [F.when(n >= 12, 1.0).otherwise(0.0).alias("structured"), F.when(mean > 1e-8, spread / mean).otherwise(999.0).alias("variation")]
    return F.when(n >= 5, F.struct(*values))


def edge_metrics(edges: Column) -> Column:
    """struct(activity, directionality, entropy): mean, peak over the mean, entropy in nats; zeros where there are none."""
    e = F.transform(edges, lambda x: x.cast("double"))
    mass = total(e) + 1e-8
    share = F.transform(e, lambda x: x / mass)
    some = F.coalesce(F.size(edges) > 0, F.lit(False))
    found = {"activity": total(e) / F.size(e), "directionality": F.array_max(share) * F.size(e), "entropy": -total(F.transform(share, lambda p: p * F.log(p + 1e-8)))}
    return F.struct(*[F.when(some, c).otherwise(0.0).alias(n) for n, c in found.items()])


def _holds(conditions: tuple, of: Callable[[str], Column]) -> Column:
    tests = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    return reduce(Column.__and__, (tests[op](of(field), F.lit(value)) for field, op, value in conditions), F.lit(True))


def family_scores(values: Column, edges: Column) -> Column:
    """struct of nine scores from 0 to 1 by the rules; values and edges are those of pattern_values and edge_metrics."""
    of = lambda name: (edges if name in ("activity", "directionality", "entropy") else values)[name]

    def worth(points: float | tuple) -> Column:
        if isinstance(points, float):
            return F.lit(points)
        slope, field, offset, most = points
        return F.least(F.lit(most), F.greatest(F.lit(0.0), of(field) - offset) * slope)

    scores = {}
    for family, rules in RULES.items():
        score = sum((F.when(_holds(when, of), worth(points)).otherwise(0.0) for when, points in rules), F.lit(0.0))
        for when, factor in DAMPING.get(family, ()):
            score = score * F.when(_holds(when, of), factor).otherwise(1.0)
        scores[family] = F.least(F.lit(1.0), score)
    levels = [F.when(_holds(when, of), base + (edge - of("coverage")) * slope) for when, (base, slope, edge) in PLAIN]
    scores["plain"] = F.greatest(F.lit(0.0), *levels)
    both, fine = (scores["marble"] > BOTH_OVER) & (scores["speckled"] > BOTH_OVER), of("small") >= BOTH_SMALL
    marble, speckled = scores["marble"], scores["speckled"]
    scores["marble"] = F.when(both & fine, marble * BOTH_FACTOR).otherwise(marble)
    scores["speckled"] = F.when(both & ~fine, speckled * BOTH_FACTOR).otherwise(speckled)
    scores["textured"] = F.lit(TEXTURED)
    return F.when(values.isNotNull(), F.struct(*[scores[f].alias(f) for f in FAMILIES]))


def classify_family(values: Column, scores: Column) -> Column:
    """The family of the best score; textured where it is low, hardly leads, or there are no values."""
    ranked = F.array_sort(F.array(*[F.struct((-scores[f]).alias("s"), F.lit(i).alias("i"), F.lit(f).alias("family")) for i, f in enumerate(FAMILIES)]))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    lead = F.when(values["small"].between(*BAND), BAND_LEAD).otherwise(LEAD)
    sure = (-best["s"] >= LEAST_SCORE) & (second["s"] - best["s"] >= lead)
    return F.when(F.coalesce(sure, F.lit(False)), best["family"]).otherwise("textured")


def with_family(rows: DataFrame, pattern: str = "pattern", edges: str = "edges") -> DataFrame:
    """Add values, edge_values, scores and family, one after the other, so that each is computed once."""
    rows = rows.withColumns({"values": pattern_values(F.col(pattern)), "edge_values": edge_metrics(F.col(edges))})
    return rows.withColumn("scores", family_scores(F.col("values"), F.col("edge_values"))).withColumn("family", classify_family(F.col("values"), F.col("scores")))
