"""Exact and near duplicates of catalogue rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.vectors import hash_bits
from vitrine.session import shared_folder


def exact_groups(rows: DataFrame, key: str = "sha256_hash", item: str = "id") -> DataFrame:
    """Hashes that two or more rows share: hash, n, first_id."""
    return rows.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n"), F.min(item).alias("first_id")).where("n > 1")


def blocks_to_share(n: int, within: int, candidates: int = 64, most_keys: int = 3000) -> int:
    """How many blocks two hashes must share, so that a hash meets some ``candidates`` others by chance among n, or as few as the number of its keys allows."""
    shared = 1
    while shared < 8 and n * comb(within + shared, shared) * 2 ** (-64 * shared / (within + shared)) > candidates and comb(within + shared + 1, shared + 1) <= most_keys:
        shared += 1
    return shared


def keyed_pairs(bits: DataFrame, within: int, shared: int) -> DataFrame:
    """near_pairs of (i, h) by an equi-join: for hashes whose bits are nearly uniform.

    The 64 bits are cut into within + shared blocks; two hashes that close agree
    on at least ``shared`` of them, so an equi-join on every choice of that many
    blocks misses no pair.  A pair comes out at the first choice on which it
    agrees and nowhere else, so nothing has to be made distinct.  Which number of
    blocks keeps chance meetings few: ``blocks_to_share``.
    """
    n = within + shared
    edges = [64 * k // n for k in range(n + 1)]
    parts = [((1 << edges[k + 1]) - (1 << edges[k])) - (1 << 64 if edges[k + 1] == 64 else 0) for k in range(n)]  # each block's bits, as a signed number
    masked = [(sum(1 << k for k in choice), sum(parts[k] for k in choice)) for choice in combinations(range(n), shared)]
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("h").bitwiseAND(F.lit(m)).alias("x")) for c, m in masked]))
    keyed = bits.select("i", "h", keys.alias("k")).select("i", "h", "k.c", "k.x")
    other = keyed.select(F.col("i").alias("i2"), F.col("h").alias("h2"), "c", "x")
    differing = F.col("h").bitwiseXOR(F.col("h2"))
    far = F.bit_count(differing)
    agree = sum((F.when(differing.bitwiseAND(F.lit(p)) == 0, 1 << k).otherwise(0) for k, p in enumerate(parts)), F.lit(0))
    first = F.lit(0)
    for _ in range(shared):  # the lowest blocks that agree, one by one
        rest = agree.bitwiseAND(F.bitwise_not(first))
        first = first.bitwiseOR(rest.bitwiseAND(-rest))
    met = keyed.join(other, ["c", "x"]).where((F.col("i") < F.col("i2")) & (far <= within))
    return met.where(first == F.col("c")).select(F.col("i").alias("a"), F.col("i2").alias("b"), far.alias("distance"))


#: Groups that hashes are dealt into at least, and hashes that a group holds on average at most.
GROUPS, HELD = 16, 1 << 18
#: Pairs that are compared at a time.
AT_A_TIME = 1 << 19


def close_pairs(i: np.ndarray, h: np.ndarray, i2: np.ndarray, h2: np.ndarray, within: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Pairs at most ``within`` bits apart, each once with the smaller id first; with same, both sides are one list."""
    h, h2 = h.view(np.uint64), h2.view(np.uint64)  # bits of a negative number would be counted without its sign
    wide = max(1, min(len(h2), 1 << 13))
    high = max(1, AT_A_TIME // wide)
    found, size = [], 0
    for r in range(0, len(h), high):
        for c in range(0, len(h2), wide):
            if same and c + wide <= r:  # below the diagonal
                continue
            far = np.bitwise_count(h[r : r + high, None] ^ h2[None, c : c + wide])
            x, y = np.divmod(np.flatnonzero(far <= within), far.shape[1])
            far = far[x, y]
            if same:
                above = r + x < c + y
                x, y, far = x[above], y[above], far[above]
            if len(x):
                found.append((i[r + x], i2[c + y], far))
                size += len(x)
            if size > HELD:
                yield pair_batch(found)
                found, size = [], 0
    yield pair_batch(found)


def pair_batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, far = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far.astype(np.int32))], ["a", "b", "distance"])


def near_pairs(rows: DataFrame, within: int = 8, shared: int = 0, item: str = "id", key: str = "perceptual_hash") -> DataFrame:
    """All pairs of different hashes at most ``within`` bits apart: a, b, distance, with the smallest id of each hash.

    Hashes of documents are far from uniform: at this distance keys of some of
    their bits meet many times more pairs than there are, so every pair of
    hashes is compared, in arrays.  Hashes are dealt into groups, and each task
    compares two of them; a hash goes to as many tasks as there are groups, whose
    number is fixed until a group would hold more than HELD.  Equal hashes are one
    row before.  With ``shared``, pairs are found by ``keyed_pairs`` instead.
    """
    bits = rows.select(F.col(item).alias("i"), hash_bits(F.col(key)).alias("h")).where("h is not null").groupBy("h").agg(F.min("i").alias("i"))
    if shared:
        return keyed_pairs(bits, within, shared)
    n = max(GROUPS, -(-rows.count() // HELD))
    own, other = F.col("g"), F.col("o")
    dealt = bits.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.select("i", "h", "g", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"))

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (k.as_py() for k in key)
        i, h, g = (np.concatenate(c) for c in zip(*[[b[c].to_numpy() for c in ("i", "h", "g")] for b in batches], strict=True))
        left, right = g == x, g == y
        yield from close_pairs(i[left], h[left], i[right], h[right], within, x == y)

    return dealt.repartition(n * (n + 1) // 2, "x", "y").groupBy("x", "y").applyInArrow(compare, "a long, b long, distance int")


def hash_members(rows: DataFrame, item: str = "id", key: str = "perceptual_hash") -> DataFrame:
    """One row per row with a hash: id, representative (the smallest id of its hash), distance (0)."""
    own = rows.select(F.col(item).alias("id"), hash_bits(F.col(key)).alias("h")).where("h is not null")
    first = own.groupBy("h").agg(F.min("id").alias("representative"))
    return own.join(first, "h").select("id", "representative", F.lit(0).alias("distance"))


def all_near_pairs(rows: DataFrame, within: int = 8, shared: int = 0, item: str = "id", key: str = "perceptual_hash") -> DataFrame:
    """near_pairs for all ids of both hashes, as (a, b, distance) with a < b; ids of one hash are in hash_members."""
    pairs, members = near_pairs(rows, within, shared, item, key), hash_members(rows, item, key)
    side = lambda s: members.select(F.col("representative").alias(s), F.col("id").alias(f"{s}_id"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "distance")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of (a, b): id, root (the smallest id), by alternating stars with a checkpoint each round."""
    spark = edges.sparkSession
    shared_folder(spark)
    tied = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        both = tied.union(tied.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        up = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = up.groupBy("x").agg(F.min("y").alias("m"))
        down = up.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").union(low.select("x", F.col("m").alias("y")))
        tied = down.distinct().checkpoint()
        now = tied.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == seen:
            return tied.select(F.col("x").alias("id"), F.col("y").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def near_groups(rows: DataFrame, within: int = 8, shared: int = 0, item: str = "id", key: str = "perceptual_hash") -> DataFrame:
    """id, group_id for rows in a near-duplicate group of two or more rows; equal hashes count."""
    root = components(near_pairs(rows, within, shared, item, key))
    own = rows.select(item, hash_bits(F.col(key)).alias("h")).where("h is not null")
    named = own.groupBy("h").agg(F.min(item).alias("id")).join(root, "id", "left").select("h", F.coalesce("root", "id").alias("group_id"))
    all_rows = own.join(named, "h").select(item, "group_id")
    big = all_rows.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    return all_rows.join(big, "group_id").select(item, "group_id")


def keep_first(rows: DataFrame, groups: DataFrame, item: str = "id") -> DataFrame:
    """rows without all but the smallest id of each group.  groups: item, group_id."""
    first = groups.groupBy("group_id").agg(F.min(item).alias("first_id"))
    gone = groups.join(first, "group_id").where(F.col(item) != F.col("first_id")).select(item)
    return rows.join(gone, item, "left_anti")
