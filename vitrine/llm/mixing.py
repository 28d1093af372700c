"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source, documents are
taken in the order of their keys until the source's budget of words is spent;
a budget above the source's size repeats the source in whole epochs first.

Rows of (source, key, size) are sorted by ranges: Spark deals them out by
sampled ranges of (source, key), and each partition holds one stretch of the
order.  Sums by partition and their prefix sums within each source tell in which
stretch the source's cut falls; running sums over that one stretch tell at which
row; every row then decides for itself by comparing its key with its source's
cut.  Where the ranges fall doesn't change the cut.  The key is a hash of id and
text, so that rows with a null or repeated id have keys of their own; rows equal
in both are numbered and cut one by one, and which of them get the rest makes no
difference to the result.

Scale: rows of (id, source, size, key) are shuffled once and staged; the prefix
sums run over one row for each partition and source, the running sums over one
partition's rows, whatever share a source or a key has.  Texts are never
shuffled.

Edge cases: null texts and texts without a word have size 0 and take 0; a null
source is a source of its own, last in order; a source takes its target to the
word, or to half a document with whole; an empty table gives an empty result;
when nothing has words all targets are 0; ``mixed_documents`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, partitions, release, staged

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, limit: int = 2) -> DataFrame:
    """source, source_size, target: weighted shares of percent of all words, none above limit times its source.

    Sources in the order of their code points (null last) take the weights in
    turn.  A share above its cap stops there and the excess goes to the others
    by weight; ordered by cap per weight, the sources that stop are a prefix,
    so running sums give the common level at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * limit)
    everything = Window.partitionBy()
    s = s.withColumn("want", F.sum("source_size").over(everything) * percent / 100.0).withColumn("all_weight", F.sum("weight").over(everything))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(ahead), F.lit(0))).withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    s = s.withColumn("level", (F.col("want") - F.col("caps_before")) / F.col("weight_left"))
    stops = F.col("level") * F.col("weight") >= F.col("cap")
    # the level that holds for all others is the one of the first source that doesn't stop
    level = F.min(F.when(~stops, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.when(stops, F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def row_hash(seed: int, *more: Column) -> Column:
    """The hash-random key of a row: of its id and text, and of whatever else tells rows apart."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), *more)


def same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a with b's columns for its source; the null source is one like any other."""
    return a.join(b.withColumnRenamed("source", "b_source"), F.col("source").eqNullSafe(F.col("b_source")), how).drop("b_source")


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, limit: int = 2) -> tuple[DataFrame, DataFrame]:
    """The staged rows in their order, and for each source its target, whole epochs, and the cut.

    rows: source, size, mix_key and whatever else.  The order is by (mix_key,
    tie); tie numbers the rows, so that rows with one key are dealt out and cut
    one by one.  cut: the row in which the source's rest ends (mix_key, tie) and
    the words that are left for it (left_words); null where nothing is cut.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last(), "mix_key", "tie")
    rows = staged(dealt.withColumn("stretch", F.spark_partition_id()), "mix-sizes")
    sums = rows.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.select("source", F.col("words").alias("size")), weights, percent, limit)
    budget = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = budget.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    budget = staged(budget, "mix-budget")
    # the stretch in which each source's budget ends, then the row in it
    ends = (F.col("after") > F.col("rest")) & (F.col("after") - F.col("words") <= F.col("rest")) & (F.col("rest") > 0)
    upto = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    reach = same(sums.withColumn("after", F.sum("words").over(upto)), budget.select("source", "rest"))
    cut_in = reach.where(ends).groupBy("source", "rest").agg(F.min("stretch").alias("cut_stretch"), F.min(F.col("after") - F.col("words")).alias("before"))
    inside = same(rows.select("source", "stretch", "mix_key", "tie", F.col("size").alias("words")), cut_in).where(F.col("stretch") == F.col("cut_stretch"))
    upto_row = Window.partitionBy("source").orderBy("mix_key", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("after", F.col("before") + F.sum("words").over(upto_row))
    at = F.struct("mix_key", "tie", (F.col("rest") - F.col("after") + F.col("words")).alias("left_words"))
    cut = inside.where(ends).groupBy("source").agg(F.min(at).alias("cut"))
    plan = staged(same(budget, cut, "left"), "mix-plan")
    release(budget)
    return rows, plan


def words_taken(whole: bool) -> Column:
    """What the mix takes of a row: its epochs, and once more before the cut; at the cut what is left, or with whole all or nothing."""
    at, size = F.col("cut"), F.col("size")
    here, there = F.struct("mix_key", "tie"), F.struct(at["mix_key"].alias("mix_key"), at["tie"].alias("tie"))
    part = F.when(at["left_words"] * 2 >= size, size).otherwise(0) if whole else at["left_words"]
    more = F.when(at.isNull(), 0).when(here < there, size).when(here == there, part).otherwise(0)
    return (F.col("epochs") * size + more).cast("long")


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, limit: int = 2, whole: bool = False) -> DataFrame:
    """Add size, source_size, target and taken to rows of (doc_id, source, text); ``whole`` takes no part of a document.

    taken counts words with repeats.  With whole, the document at the cut is
    taken if at least half of it is within the budget.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(seed).alias("mix_key"))
    rows, plan = plan_mix(rows, weights, percent, limit)
    return same(rows, plan).select("doc_id", "source", "size", "source_size", "target", words_taken(whole).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix as whole documents: each row as often as the mix takes it; a row without a word has nothing to take.

    Texts stay where they are: a row knows by its own key how often it comes.
    Only rows with the key at the cut, which are equal in all columns, are
    brought together, one of them for as many copies as they get in all.
    """
    key = row_hash(seed, F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    given = docs.select(F.struct(*docs.columns).alias("doc"), "source", word_count(F.col("text")).alias("size"), key.alias("mix_key"))
    rows, plan = plan_mix(given.select("source", "size", "mix_key"))
    at = F.col("cut")["mix_key"]
    mine = same(given, plan).where("size > 0")
    copies = F.col("epochs") + F.when(F.col("mix_key") < at, 1).otherwise(0)
    plain = mine.where(F.coalesce(F.col("mix_key") != at, F.lit(True))).select("doc", copies.alias("n"))
    cut = mine.where(F.col("mix_key") == at).groupBy("source", "mix_key").agg(F.first("doc").alias("doc"))
    taken = same(rows, plan).where((F.col("mix_key") == at) & (F.col("size") > 0)).select("source", (words_taken(True) / F.col("size")).cast("long").alias("n"))
    tied = same(cut, taken.groupBy("source").agg(F.sum("n").alias("n"))).select("doc", "n")
    out = plain.unionByName(tied).where("n > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc.*")
