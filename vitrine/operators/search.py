"""Vector search for many queries at once, merging, rescoring and filtering of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.vectors import clamp01, rounded
from vitrine.session import stored

BLOCK = 4096
#: Blocks of more queries than BLOCK at least; vectors that a block sees at a time; pairs whose exact scores are taken at a time.
SPREAD, STEP, CHECKED = 32, 512, 1 << 16
#: Bytes of vectors in a packed row at most, and in what a block goes past in one task.
PACKED, PASSED = 2 << 20, 128 << 20


def best_first(k: int | None = None, *, by: str = "query_id", score: str = "score", item: str = "tile_id"):
    """row_number over a query's hits, best score first, ties by id."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item).asc()))


def dimension(vectors: DataFrame) -> int:
    """The commonest length of the vectors (the larger of equals; 0 where there is none)."""
    n = F.size("v").alias("n")
    first = vectors.where("v is not null").groupBy(n).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return first["n"] if first else 0


def usable(rows: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector v has dim elements, none of them null or NaN."""
    return rows.where(fits(dim))


def unusable(rows: DataFrame, dim: int) -> DataFrame:
    """The rows that a search leaves out: no vector, another length, a null or a NaN in it."""
    return rows.where(~fits(dim))


def fits(dim: int):
    return F.coalesce((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(False))


def matrix(array: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), dim)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


HITS = "query_id long, tile_id long, score double"


def best_hits(own: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, skip_self: bool, threshold: float | None = None) -> pa.Table:
    """The k best (best score, then smallest id) of the vectors v for each of the unit queries q; with a threshold, all at or above it."""
    s = np.round(np.clip(q @ v.T, -1, 1), 6)
    if skip_self:
        s[own[:, None] == ids[None, :]] = -np.inf
    if threshold is None and k < s.shape[1]:
        threshold = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if k else np.inf
    a, b = np.nonzero((s >= (-np.inf if threshold is None else threshold)) & np.isfinite(s))
    if k:  # of those that tie with the last, the smallest ids
        order = np.lexsort((ids[b], -s[a, b], a))
        a, b = a[order], b[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b = a[keep], b[keep]
    return pa.table({"query_id": own[a].astype(np.int64), "tile_id": ids[b].astype(np.int64), "score": s[a, b]})


class Best:
    """A block of unit queries and the k best hits of the vectors that they have seen, in whatever order these come.

    Scores are held to -1 to 1 and rounded, or, if plain, left as they are.
    """

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int, skip_self: bool, threshold: float | None, plain: bool = False):
        self.own, self.q, self.k, self.skip_self, self.threshold, self.plain = own, q, k, skip_self, threshold, plain
        self.single, self.least = q.astype(np.float32), np.full(len(q), -np.inf)  # the k-th best score
        self.last = np.full(len(q), np.iinfo(np.int64).max)  # and its id: of equals the smaller goes first
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query's place, id, score
        self.more, self.size = [], 0

    def see(self, ids: np.ndarray, v: np.ndarray, who: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Vectors for all queries, or for those in the places ``who`` (not with a threshold)."""
        if self.threshold is not None:
            yield from best_hits(self.own, self.q, ids, v, 0, self.skip_self, self.threshold).to_batches()
        elif self.k > 0:
            x, y, s = self.candidates(ids, v, slice(None) if who is None else who)
            if self.skip_self:
                other = self.own[x] != ids[y]
                x, y, s = x[other], y[other], s[other]
            if len(x):
                self.more.append((x, ids[y], s))
                self.size += len(x)
            if self.size > max(1 << 18, len(self.held[0])) or not np.isfinite(self.least).any():
                self.settle()

    def candidates(self, ids: np.ndarray, v: np.ndarray, who: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs that may be among the best, and their exact scores; single precision rules out the rest with its error bound."""
        longest = np.sqrt((v * v).sum(1).max())
        place, least = np.arange(len(self.q))[who], self.least[who]
        if not np.isfinite(least).all() or not longest < 1e18:
            with np.errstate(invalid="ignore"):
                s = self.shown(self.q[who] @ v.T)
            s[np.isnan(s)] = -np.inf
            most = self.k + self.skip_self
            cut = least[:, None] if most >= s.shape[1] else np.maximum(least[:, None], -np.partition(-s, most - 1, axis=1)[:, most - 1 : most])
            x, y = np.nonzero((s >= cut) & np.isfinite(s))
            x, s = place[x], s[x, y]
        else:
            slack = (v.shape[1] + 8) * 2.0**-23 * longest + 1e-6
            x, y = np.divmod(np.flatnonzero(self.single[who] @ v.T.astype(np.float32) > (least - slack).astype(np.float32)[:, None]), len(v))
            x = place[x]
            pieces = [np.einsum("ij,ij->i", self.q[x[a : a + CHECKED]], v[y[a : a + CHECKED]]) for a in range(0, len(x), CHECKED)]
            s = self.shown(np.concatenate(pieces or [np.zeros(0)]))
        better = self.better(x, ids[y], s)
        return x[better], y[better], s[better]

    def shown(self, s: np.ndarray) -> np.ndarray:
        return s if self.plain else np.round(np.clip(s, -1, 1), 6)

    def better(self, x: np.ndarray, ids: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (s > self.least[x]) | (s == self.least[x]) & (ids < self.last[x])

    def settle(self) -> None:
        x, ids, s = (np.concatenate(c) for c in zip(self.held, *self.more))
        order = np.lexsort((ids, -s, x))
        x, ids, s = x[order], ids[order], s[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        keep = place < self.k
        kth = place == self.k - 1
        self.least[x[kth]], self.last[x[kth]] = s[kth], ids[kth]
        self.held, self.more, self.size = (x[keep], ids[keep], s[keep]), [], 0

    def hits(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        x, ids, s = self.held
        yield pa.record_batch([pa.array(self.own[x].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(s)], ["query_id", "tile_id", "score"])


def packed(rows: DataFrame, most: int, kinds: dict[str, str]) -> DataFrame:
    """Up to ``most`` rows in one: n, and for each column that kinds names its numbers one after another, as bytes of that kind (lists and binaries end to end)."""

    def flat(column: pa.Array, kind: str) -> bytes:
        if pa.types.is_binary(column.type):
            return b"".join(column.to_pylist())
        numbers = column.flatten() if pa.types.is_list(column.type) else column
        return numbers.to_numpy(zero_copy_only=False).astype(kind).tobytes()

    def row(held: list, n: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array([n]), *(pa.array([b"".join(c)], pa.binary()) for c in zip(*held))], ["n", *kinds])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - n)
                held.append([flat(part[c], kind) for c, kind in kinds.items()])
                at, n = at + part.num_rows, n + part.num_rows
                if n == most:
                    yield row(held, n)
                    held, n = [], 0
        if held:
            yield row(held, n)

    return rows.select(*kinds).mapInArrow(pack, ", ".join(["n long", *(f"{c} binary" for c in kinds)]))


def element(rows: DataFrame, name: str = "v") -> str:
    return "<f4" if rows.schema[name].dataType.elementType.typeName() == "float" else "<f8"


def numbers(packed: pa.Scalar, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), kind)


def unpacked(ids: pa.Scalar, v: pa.Scalar, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = numbers(ids)
    return ids, numbers(v, kind).astype(np.float64).reshape(len(ids), -1)


def query_blocks(queries: DataFrame, kinds: dict[str, str], n: int, size: int) -> DataFrame:
    """block and the packed columns of about n blocks of queries, dealt out by id; a query has so many bytes."""
    # a hash deals out unevenly: a block may be twice the average before it is cut
    blocks = packed(queries.repartition(n, "query_id"), max(1, 2 * PACKED // size), kinds)
    return blocks.select(F.monotonically_increasing_id().alias("block"), *kinds)


def past_blocks(blocks: DataFrame, there: DataFrame, parts: int) -> DataFrame:
    """Each block with all packed rows that are stored there, in ``parts`` parts: a task has one part's rows, block after block."""
    return blocks.crossJoin(there.coalesce(parts).hint("shuffle_replicate_nl"))


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, *, skip_self: bool = True, threshold: float | None = None) -> DataFrame:
    """The k best vectors by inner product for every query: query_id, tile_id, score, rank.

    queries: query_id, v; vectors: tile_id, v.  Up to BLOCK queries go to where the
    vectors are, which stay in place, and a task keeps its k best per query.  Beyond
    it, vectors are stored once, many to a row, and queries are cut into blocks,
    SPREAD until a block would be over PACKED; a task holds one block and reads up
    to PASSED of the stored vectors past it, so that it sends on only each query's
    k best of these (or, with a threshold, all at or above it).  What is shuffled
    and written are the queries, the vectors and the hits, no copies of vectors.
    Scores are rounded to 6 places, so that ties are broken by id alike everywhere.
    Queries and vectors that are null, of another length than most vectors, or hold
    a null or NaN take no part (see ``unusable``).
    """
    dim = dimension(vectors)
    queries, vectors = usable(queries.select("query_id", "v"), dim), usable(vectors.select("tile_id", "v"), dim)
    most = 0 if threshold is not None else k
    held = queries.limit(BLOCK + 1).toArrow()
    if held.num_rows <= BLOCK:
        own, q = held["query_id"].to_numpy(), unit(matrix(held["v"], dim))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    yield from best_hits(own, q, part["tile_id"].to_numpy(), matrix(part["v"], dim), most, skip_self, threshold).to_batches()

        hits = vectors.mapInArrow(local, HITS)
    else:
        asked_as, kind = element(queries), element(vectors)
        size, asked_size = dim * np.dtype(kind).itemsize, dim * np.dtype(asked_as).itemsize
        there = stored(packed(vectors, max(1, PACKED // size), {"tile_id": "<i8", "v": kind}), "packed-vectors")
        parts = max(1, -(-there.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * size // PASSED))
        n = max(SPREAD, -(-queries.count() * asked_size // PACKED))
        blocks = query_blocks(queries, {"query_id": "<i8", "v": asked_as}, n, asked_size).withColumnRenamed("v", "q")
        pairs = past_blocks(blocks, there.select("tile_id", "v"), parts)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, best = None, None
            for batch in batches:
                for i, block in enumerate(batch["block"].to_pylist()):
                    if block != at:
                        if best:
                            yield from best.hits()
                        own, q = unpacked(batch["query_id"][i], batch["q"][i], asked_as)
                        at, best = block, Best(own, unit(q), most, skip_self, threshold)
                    ids, v = unpacked(batch["tile_id"][i], batch["v"][i], kind)
                    for c in range(0, len(ids), STEP):
                        yield from best.see(ids[c : c + STEP], v[c : c + STEP])
            if best:
                yield from best.hits()

        hits = pairs.mapInArrow(look, HITS)
    ranked = hits.withColumn("rank", best_first())
    return ranked if threshold is not None else ranked.where(F.col("rank") <= k)


def merge_views_max(hits: DataFrame) -> DataFrame:
    """Per query and tile: the best score and the view that gave it (the first of equals).  hits: query_id, ord, tile_id, score."""
    best = F.max(F.struct(F.col("score"), (-F.col("ord")).alias("o")))
    return hits.groupBy("query_id", "tile_id").agg(best.alias("b")).select("query_id", "tile_id", F.col("b.score").alias("score"), (-F.col("b.o")).alias("ord"))


def fuse_hits(hits: DataFrame, method: str, rrf_k: int = 60) -> DataFrame:
    """One score per query and tile from several hits: query_id, tile_id, score.  hits: …, score, view_weight, rank_in_list."""
    w, s = F.greatest(F.col("view_weight"), F.lit(0.05)), F.col("score")
    by = hits.groupBy("query_id", "tile_id")
    if method == "softmax":
        top = by.agg(F.max(s * F.col("view_weight")).alias("m"))
        rest = hits.join(top, ["query_id", "tile_id"]).groupBy("query_id", "tile_id", "m").agg(F.sum(F.exp(s * F.col("view_weight") - F.col("m"))).alias("e"))
        return rest.select("query_id", "tile_id", (F.col("m") + F.log("e")).alias("score"))
    how = {
        "max": F.max(s), "weighted_max": F.max(s * w), "average": F.avg(s), "weighted_average": F.sum(s * w) / F.sum(w),
        "rrf": F.sum(1 / (rrf_k + F.greatest(F.col("rank_in_list"), F.lit(1)))),
    }[method]
    return by.agg(how.alias("score"))


def rerank(hits: DataFrame) -> DataFrame:
    """Rules on top of the hybrid score; the first that fits sets score and exact.

    hits: query_id, tile_id, final, s_embedding, vector_score, exact, own_file, crop_source.
    """
    own, exact, crop = (F.col(c) for c in ("own_file", "exact", "crop_source"))
    vec, emb, final = (F.col(c) for c in ("vector_score", "s_embedding", "final"))
    lead = vec >= emb + 0.12
    rules = [
        (~own & (vec >= 0.88) & lead, F.lit(1.0), F.lit(True)),
        (~exact & (vec >= 0.80) & lead, F.greatest(final, clamp01(0.72 * vec + 0.28 * final)), exact),
        (~exact & crop & (F.greatest(emb, vec) >= 0.78), F.lit(1.0), F.lit(True)),
        (exact & own, F.lit(0.97), F.lit(True)),
        (exact, F.lit(1.0), F.lit(True)),
    ]
    score, is_exact = final, exact
    for when, value, flag in reversed(rules):
        score, is_exact = F.when(when, value).otherwise(score), F.when(when, flag).otherwise(is_exact)
    out = hits.withColumns({"score": score, "exact": is_exact})
    return out.withColumn("rank", best_first())


def near_tie_nudge(hits: DataFrame, verify: DataFrame | None = None, band: float = 0.03, most: int = 5, bonus: float = 0.05, places: int | None = None) -> DataFrame:
    """Raise non-exact hits within a band of the best by their pair's verification; needs at least two of them.  verify: query_id, tile_id, verify; or hits have that column.

    With places, scores are rounded to so many before hits are ranked by them: equals keep their order.
    """
    whole = Window.partitionBy("query_id")
    df = (hits if verify is None else hits.join(verify, ["query_id", "tile_id"], "left")).withColumn("top", F.max("score").over(whole))
    df = df.withColumn("in_band", ~F.col("exact") & (F.col("score") >= F.col("top") - band))
    nth = F.sum(F.col("in_band").cast("int")).over(whole.orderBy("rank"))
    df = df.withColumn("in_band", F.col("in_band") & (nth <= most)).withColumn("tied", F.sum(F.col("in_band").cast("int")).over(whole))
    up = F.col("in_band") & (F.col("tied") >= 2) & (F.coalesce(F.col("verify"), F.lit(0.0)) > 0)
    df = df.withColumn("score", F.when(up, F.least(F.lit(1.0), F.col("score") + bonus * F.col("verify"))).otherwise(F.col("score"))).withColumn("before", F.col("rank"))
    if places is not None:
        df = df.withColumn("score", rounded(F.col("score"), places))
    df = df.withColumn("rank", F.row_number().over(whole.orderBy(F.col("score").desc(), F.col("before"))))
    return df.drop("top", "in_band", "tied", "before", "verify")


def weak_verdicts(hits: DataFrame, top_k: int, share: float = 0.60, least: float = 0.38, fallback: int = 3) -> DataFrame:
    """Add floor, kept and out_rank (the place among the kept).  hits: query_id, tile_id, score, exact, rank.

    Exact hits and those at or above a floor relative to the best are kept; if none is, the first few.
    """
    whole = Window.partitionBy("query_id")
    inexact = F.max(F.when(~F.col("exact"), F.col("score"))).over(whole)
    top = F.max("score").over(whole)
    top_exact = F.max(F.struct(-F.col("rank"), "exact")).over(whole)["exact"]
    df = hits.withColumn("floor", F.greatest(share * F.when(top_exact, F.coalesce(inexact, top)).otherwise(top), F.lit(least)))
    df = df.withColumn("kept", F.col("exact") | (F.col("score") >= F.col("floor"))).withColumn("n_kept", F.sum(F.col("kept").cast("int")).over(whole))
    df = df.withColumn("kept", F.when(F.col("n_kept") == 0, F.col("rank") <= min(fallback, top_k)).otherwise(F.col("kept")))
    place = F.sum(F.col("kept").cast("int")).over(whole.orderBy("rank"))
    return df.withColumn("out_rank", F.when(F.col("kept"), place.cast("int"))).drop("n_kept")


def weak_filter(hits: DataFrame, top_k: int, share: float = 0.60, least: float = 0.38, fallback: int = 3) -> DataFrame:
    """The first top_k of what weak_verdicts keeps, ranked anew."""
    out = weak_verdicts(hits, top_k, share, least, fallback).where(F.col("kept") & (F.col("out_rank") <= top_k))
    return out.withColumn("rank", F.col("out_rank")).drop("kept", "out_rank")


def query_confidence(hits: DataFrame) -> DataFrame:
    """Per query: the best display score below 99.5 and its level.  hits: query_id, display_pct."""
    best = hits.groupBy("query_id").agg(F.max(F.when(F.col("display_pct") < 99.5, F.col("display_pct"))).alias("best"), F.count("*").alias("n"))
    return best.select("query_id", "best", F.when(F.col("n") == 0, "none").when(F.col("best").isNull(), "high").when(F.col("best") < 35, "low").when(F.col("best") < 55, "moderate").otherwise("high").alias("confidence"))
