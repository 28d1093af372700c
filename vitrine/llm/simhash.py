"""SimHash near-duplicates through distributed vantage-point trees.

``add_fingerprints`` gives every text a 64-bit SimHash of its word shingles.
``link_fingerprints`` finds which fingerprints link at ``radius`` or fewer
differing bits, exactly: a vantage-point tree over the Hamming metric assigns
every distinct fingerprint to shards.  A node with vantage v and threshold m
sends fingerprints with d(v, f) < m left and the others right; by the triangle
bound, only those with m <= d(v, f) < m + radius can have partners on the left,
and so only these go both ways.  Any two linked fingerprints therefore meet in
at least one shard, where a vantage-point tree in memory, pruned by the same
bound, finds the pairs.

Scale: equal fingerprints are one row before anything is compared, so copies
cost nothing; the tree's vantages come from a bounded sample (they only steer
balance, not results); each shard returns a spanning forest of its links (fewer
edges than members), never all pairs; components are found by alternating
large-star and small-star rounds on the edges alone, with checkpoints.

Edge cases: null and empty texts, and texts without a word, have fingerprint
zero and link like any other; fewer words than a shingle: the whole sequence is
the one shingle; rows that repeat are one class; an empty table gives an empty
result; null ids belong to their fingerprint's class, whose id is its smallest
non-null one (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, keep_rows, row_keys, shared_folder, staged

#: Fingerprints that a shard should hold; a tree is as deep as this asks for.
SHARD_ROWS = 8192
#: Sample that the tree's vantages and thresholds are taken from.
SAMPLE = 16_384
MAX_DEPTH = 14
#: Groups of this size or less are compared in full, in memory.
LEAF = 192
BLOCK = 2048

# ------------------------------------------------------------- fingerprints

_BITS = np.arange(64, dtype=np.uint64)


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(words) - shingle + 1)
    # counts of all 64 bits, eight at a time in the bytes of one word: no byte overflows in 255 rows
    ones = np.zeros(64, np.int64)
    low = np.uint64(0x0101010101010101)
    for k in range(8):
        planes = (h >> np.uint64(k)) & low
        for i in range(0, len(planes), 255):
            ones[k::8] += np.array([planes[i : i + 255].sum(dtype=np.uint64)], "<u8").view(np.uint8)
    return int((np.uint64(1) << _BITS[ones * 2 > len(h)]).sum(dtype=np.uint64))


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Add the fingerprint as a signed 64-bit integer with the same bits."""
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text)))


# ------------------------------------------------------- vantage-point trees


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> dict | None:
    """A tree of vantages and thresholds; where the sample is used up or can't be parted, a leaf."""
    if depth == 0 or len(sample) < 2:
        return None
    best = None
    for v in sample[rng.integers(0, len(sample), 6)]:
        d = distance(sample, v)
        m = int(np.median(d))
        m += bool(not (d < m).any())
        left, both = int((d < m).sum()), int(((d >= m) & (d < m + 2)).sum())
        cost = max(left + both, len(sample) - left) + both
        if 0 < left < len(sample) and (best is None or cost < best[0]):
            best = (cost, v, m)
    if best is None or best[0] > 1.9 * len(sample):
        return None
    _, v, m = best
    d = distance(sample, v)
    return {"v": int(v), "m": m, "left": grow_tree(sample[d < m + 2], depth - 1, rng), "right": grow_tree(sample[d >= m], depth - 1, rng)}


def shards_of(tree: dict | None, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for every shard that a fingerprint belongs to."""
    rows, shards = [], []
    stack = [(tree, np.arange(len(fps)), 1)]
    while stack:
        node, own, name = stack.pop()
        if not len(own):
            continue
        if node is None:
            rows.append(own)
            shards.append(np.full(len(own), name, np.int64))
            continue
        d = distance(fps[own], np.uint64(node["v"]))
        stack.append((node["left"], own[d < node["m"] + radius], 2 * name))
        stack.append((node["right"], own[d >= node["m"]], 2 * name + 1))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(shards or [np.zeros(0, np.int64)])


class Forest:
    """Union-find over row numbers; edges holds the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        pair, x, y = (x, y), self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append(pair)


def link_in_memory(fps: np.ndarray, radius: int) -> Forest:
    """Which of the distinct fingerprints of a shard link, by a vantage-point tree down to small leaves."""
    forest, rng = Forest(len(fps)), np.random.default_rng(7)
    stack = [np.arange(len(fps))]
    while stack:
        own = stack.pop()
        if len(own) < 2:
            continue
        part = None
        if len(own) > LEAF:
            for v in fps[own[rng.integers(0, len(own), 3)]]:
                d = distance(fps[own], v)
                m = int(np.median(d))
                m += bool(not (d < m).any())
                left, right = own[d < m + radius], own[d >= m]
                if len(left) + len(right) < 1.6 * len(own) and max(len(left), len(right)) < 0.9 * len(own) and (part is None or len(left) + len(right) < sum(map(len, part))):
                    part = left, right
        if part:
            stack += part
            continue
        # a small or a dense group: compare it in blocks
        for i in range(0, len(own), BLOCK):
            a = own[i : i + BLOCK]
            for j in range(i, len(own), BLOCK):
                b = own[j : j + BLOCK]
                near = distance(fps[a][:, None], fps[b][None, :]) <= radius
                if i == j:
                    near = np.triu(near, 1)
                for x, y in zip(*np.nonzero(near), strict=True):
                    forest.join(int(a[x]), int(b[y]))
    return forest


def link_fingerprints(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect the ids of linked fingerprints, each a link itself.  nodes: fp long (distinct), id long."""
    spark = nodes.sparkSession
    n = nodes.count()
    # in the order of a hash: the same sample each time, whatever the partitions
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / SHARD_ROWS)))))
    tree = spark.sparkContext.broadcast(grow_tree(sample, depth, np.random.default_rng(11)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = batch["fp"].to_numpy(), batch["id"].to_numpy()
            rows, shards = shards_of(tree.value, fps.view(np.uint64), radius)
            yield pa.record_batch([pa.array(shards), pa.array(fps[rows]), pa.array(ids[rows])], ["shard", "fp", "id"])

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        edges = np.array(link_in_memory(rows["fp"].to_numpy().view(np.uint64), radius).edges, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})

    routed = nodes.select("fp", "id").mapInArrow(route, "shard long, fp long, id long")
    return routed.groupBy("shard").applyInArrow(link, "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (id, root) with the smallest id of each as root.

    Alternating large-star and small-star; node degrees only meet aggregates
    and joins that Spark can split, and each round is checkpointed.
    """
    shared_folder(edges.sparkSession)
    stars = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    stars, before = stars.checkpoint(), None
    for _ in range(max_rounds):
        # large star: every neighbour above x is tied to the smallest of x and its neighbours
        both = stars.union(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # small star: every lower neighbour of x, and x, are tied to the smallest of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").union(low.select("x", F.col("m").alias("y")))
        stars = small.distinct().checkpoint()
        now = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return stars.select(F.col("x").alias("id"), F.col("y").alias("root"))
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def fingerprint_classes(docs: DataFrame, radius: int = 2, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: no_id, id, row (see row_keys), ``fp``, ``root`` (the smallest fingerprint of its class) and ``component`` (the smallest key of its class)."""
    rows = docs.select(*row_keys(key, text), F.col(text).alias("text"))
    rows = staged(add_fingerprints(rows, "text", "fp", shingle).drop("text"), "fingerprints")
    # a class goes by its fingerprint: keys may be null or stand in rows of several classes
    nodes = staged(rows.groupBy("fp").agg(F.min(F.when(~F.col("no_id"), F.col("id"))).alias("own")), "classes")
    root = components(link_fingerprints(nodes.select("fp", F.col("fp").alias("id")), radius)).withColumnRenamed("id", "fp")
    rooted = nodes.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "own")
    named = rooted.join(rooted.groupBy("root").agg(F.min("own").alias("component")), "root").select("fp", "root", "component")
    return rows.join(named, "fp").select(*KEYS, "fp", "root", "component")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``fp``, and ``component``, the smallest key of all documents that it links to."""
    found = fingerprint_classes(docs, radius, shingle, key, text)
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "fp", "component")


def keep_one_of_each(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """Drop all but one row of each near-duplicate class: the one with the smallest doc_id (a null only where all are null), then text hash."""
    kept = fingerprint_classes(docs, radius, shingle).groupBy("root").agg(F.min(F.struct(*KEYS)).alias("k")).select("k.*")
    return keep_rows(docs, kept)
