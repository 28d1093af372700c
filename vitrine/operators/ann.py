"""Approximate search: inverted files, product quantisation and hyperplane hashing.

An index is built once and searched often.  Vectors are dealt out by cell and
stored; blocks of queries go past them, with the cells that each query asks
for, so no vector is copied for a query, no query passes the driver, and a cell
with a third of all vectors is many blocks' work.  A task keeps its best hits
for each query and sends on no more.

What is fitted (cells' centres, sub-vector codes) is fitted on a bounded sample
in the order of a hash of the id, ``SAMPLE`` vectors and ``SAMPLE_FLOATS``
numbers at most; every vector is indexed.  Null, ragged and NaN vectors take no
part, as in the exact search.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.session import shared_folder, stored

from .search import BLOCK, CHECKED, HITS, PACKED, PASSED, SPREAD, STEP, Best, best_first, dimension, element, matrix, numbers, packed, past_blocks, query_blocks, unit, unpacked, usable

SAMPLE, SAMPLE_FLOATS = 65_536, 16 << 20
#: Rows for each part of a hash table's bucket on average.
BUCKET = 64
#: Rows, and queries that ask, of a bucket's part at most on average.
HOT = 1 << 12


def auto_nlist(n: int) -> int:
    """About four times the root of the number of vectors, 1 to 16,384."""
    return max(1, min(16_384, n, round(4 * math.sqrt(n))))


def sample_of(vectors: DataFrame, dim: int) -> np.ndarray:
    most = max(1, min(SAMPLE, SAMPLE_FLOATS // max(1, dim)))
    rows = vectors.orderBy(F.xxhash64("tile_id"), "tile_id").limit(most).select("v").toArrow()
    return matrix(rows["v"], dim)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([(rows[i : i + BLOCK] @ centres.T - half).argmax(1) for i in range(0, len(rows), BLOCK)] or [np.zeros(0, np.int64)])


def k_means(rows: np.ndarray, k: int, rounds: int, spherical: bool = False) -> np.ndarray:
    """Centres of at most k cells (the first rows to begin with); cells that run empty stay where they are."""
    centres = rows[:k].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        full = own[order][at]
        if len(full):
            sums = np.add.reduceat(rows[order], at)
            centres[full] = unit(sums) if spherical else sums / np.diff(np.append(at, len(order)))[:, None]
    return centres


def sub_vectors(dim: int, m: int) -> int:
    """m if it divides the dimension, else the largest of 16, 8, 4, 2 and 1 that does."""
    return m if m > 0 and dim % m == 0 else next(c for c in (16, 8, 4, 2, 1) if dim % c == 0)


@dataclass
class Index:
    """Stored rows by cell (tile_id, cell, and the vector or its code), the cells' centres, and with codes their books: [sub-vector, code, element]."""

    rows: DataFrame
    centres: np.ndarray
    books: np.ndarray | None
    n: int
    dim: int

    @property
    def bytes_a_vector(self) -> int:
        """Of what a search reads for a vector, besides its id and cell."""
        return self.dim * 4 if self.books is None else self.books.shape[0] + 4  # codes, and the norm


def build_index(vectors: DataFrame, nlist: int = 0, m: int = 0, nbits: int = 8, rounds: int = 10) -> Index:
    """Index all usable vectors (tile_id, v) by cell; with m, as m sub-vector codes of nbits in place of the vector.

    The codes are of what is left of the unit vector behind its cell's centre.
    With fewer vectors than codes (2**nbits) the vectors themselves are kept.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors)
    vectors = usable(vectors.select("tile_id", "v"), dim)
    n = vectors.count()
    sample = sample_of(vectors, dim) if n else np.zeros((0, dim))
    norm = unit(sample)
    centres = k_means(norm, nlist or auto_nlist(n), rounds, spherical=True)
    books = None
    if m and n >= 2**nbits:
        m = sub_vectors(dim, m)
        rest = (norm - centres[nearest(norm, centres)]).reshape(len(norm), m, -1)
        books = np.stack([k_means(rest[:, i], 2**nbits, rounds) for i in range(m)])
    shared = spark.sparkContext.broadcast((centres, books))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                raw, held = matrix(part["v"], dim), part["v"]
                rows = unit(raw)
                cell = nearest(rows, centres) if len(centres) else np.zeros(0, np.int64)
                if books is not None:  # the norm stands behind the codes, so that scores are those of the vectors as given
                    rest = (rows - centres[cell]).reshape(len(rows), len(books), -1)
                    codes = np.column_stack([nearest(rest[:, i], books[i]) for i in range(len(books))]).astype(np.uint8)
                    norms = np.linalg.norm(raw, axis=1).astype("<f4").view(np.uint8).reshape(-1, 4)
                    held = pa.array([r.tobytes() for r in np.hstack([codes, norms])], pa.binary())
                yield pa.record_batch([part["tile_id"], pa.array(cell.astype(np.int32)), held], ["tile_id", "cell", "held"])

    kind = vectors.schema["v"].dataType.simpleString() if books is None else "binary"
    placed = vectors.mapInArrow(place, f"tile_id long, cell int, held {kind}")
    order = ["cell", F.xxhash64("tile_id")]
    path = f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return Index(spark.read.schema(placed.schema).parquet(path), centres, books, n, dim)


def compact(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, ties by id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], scores[keep]


def cells_asked(q: np.ndarray, centres: np.ndarray, nprobe: int) -> dict[int, np.ndarray | None]:
    """For each cell the queries that ask for it; None for all."""
    if nprobe >= len(centres):
        return dict.fromkeys(range(len(centres)))
    near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :nprobe]
    cells, own = near.ravel(), np.repeat(np.arange(len(q)), near.shape[1])
    order = np.argsort(cells, kind="stable")
    at = np.flatnonzero(np.diff(cells[order], prepend=-1))
    return {int(cells[order[a]]): own[order[a:b]] for a, b in zip(at, np.append(at[1:], len(order)))}


def decoded(codes: np.ndarray, cell: np.ndarray, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for: the cell's centre and an entry of each sub-vector's book, as long as the vector was."""
    m = len(books)
    norms = codes[:, m:].copy().view("<f4").astype(np.float64)
    return (centres[cell] + np.concatenate([books[i][codes[:, i]] for i in range(m)], axis=1)) * norms


def number_of_blocks(n: int, size: int) -> int:
    """One for up to BLOCK queries, else SPREAD or as many as keep a block at PACKED bytes."""
    return 1 if n <= BLOCK else max(SPREAD, -(-n * size // PACKED))


def stored_parts(there: DataFrame, size: int, blocks: int) -> int:
    """Parts of stored rows that a block goes past, of PASSED bytes; a single block leaves them as they are."""
    if blocks == 1:
        return max(1, there.rdd.getNumPartitions())
    return max(1, -(-there.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * size // PASSED))


def scan(index: Index, queries: DataFrame, n: int, k: int, nprobe: int, skip_self: bool) -> DataFrame:
    """Each query's k best rows of the cells that it asks for, from every part of the index: query_id, tile_id, score.

    queries: usable ones, n blocks of them.  What a block sees of a code is the
    vector that it stands for, so that a product of arrays scores it.
    """
    shared, dim = index.rows.sparkSession.sparkContext.broadcast((index.centres, index.books)), index.dim
    kind, asked_as, size = element(index.rows, "held") if index.books is None else "u1", element(queries), index.bytes_a_vector + 12
    there = stored(packed(index.rows, max(1, PACKED // max(1, dim * 8)), {"tile_id": "<i8", "cell": "<i4", "held": kind}), "packed-cells")
    blocks = query_blocks(queries, {"query_id": "<i8", "v": asked_as}, n, max(1, dim * np.dtype(asked_as).itemsize))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        block, best = None, None
        for batch in batches:
            for i, b in enumerate(batch["block"].to_pylist()):
                if b != block:
                    if best:
                        yield from best.hits()
                    own, q = unpacked(batch["query_id"][i], batch["v"][i], asked_as)
                    q = unit(q)
                    block, best, asked = b, Best(own, q, k, skip_self, None, plain=books is not None), cells_asked(q, centres, nprobe)
                ids, cell = numbers(batch["tile_id"][i]), numbers(batch["cell"][i], "<i4")
                v = numbers(batch["held"][i], kind).reshape(len(ids), -1)
                v = v.astype(np.float64) if books is None else decoded(v, cell, centres, books)
                # cells stand one after another; where every query asks for every cell, their borders don't count
                cuts = np.flatnonzero(np.diff(cell)) + 1 if nprobe < len(centres) else []
                for low, high in zip([0, *cuts], [*cuts, len(ids)]):
                    if int(cell[low]) in asked:
                        for c in range(low, high, STEP):
                            part = slice(c, min(c + STEP, high))
                            yield from best.see(ids[part], v[part], asked[int(cell[low])])
        if best:
            yield from best.hits()

    return past_blocks(blocks, there.drop("n"), stored_parts(there, size, n)).mapInArrow(look, HITS)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", best_first()).where(F.col("rank") <= k)


def exact_scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """query_id, tile_id, score: of each query's pairs (query_id, tile_id; a bounded number) the k best by their exact scores, from every part of the vectors.

    n blocks of queries go past the stored vectors with the ids of their pairs, so no vector is copied for a pair.
    """
    kind, asked_as = element(vectors), element(queries)
    vectors = usable(vectors.select("tile_id", "v"), dim)
    size = max(1, dim * np.dtype(kind).itemsize)
    there = stored(packed(vectors, max(1, PACKED // size), {"tile_id": "<i8", "v": kind}), "packed-vectors")
    # queries that share an id share their pairs
    lists = pairs.groupBy("query_id").agg(F.collect_set("tile_id").alias("asked"))
    asking = queries.join(lists, "query_id").withColumn("count", F.size("asked"))
    blocks = query_blocks(asking, {"query_id": "<i8", "v": asked_as, "count": "<i4", "asked": "<i8"}, n, max(1, dim * np.dtype(asked_as).itemsize))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = None, []

        def hits() -> pa.RecordBatch:
            x, ids, s = compact(*(np.concatenate(c) for c in zip(*found)), k)
            return pa.record_batch([pa.array(own[x].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(s)], ["query_id", "tile_id", "score"])

        for batch in batches:
            for i, b in enumerate(batch["block"].to_pylist()):
                if b != block:
                    if found:
                        yield hits()
                    own, q = unpacked(batch["query_id"][i], batch["q"][i], asked_as)
                    q, wanted = unit(q), numbers(batch["asked"][i])
                    order = np.argsort(wanted, kind="stable")
                    row, wanted = np.repeat(np.arange(len(own)), numbers(batch["count"][i], "<i4"))[order], wanted[order]
                    block, found = b, []
                ids, v = unpacked(batch["tile_id"][i], batch["v"][i], kind)
                low, high = np.searchsorted(wanted, ids), np.searchsorted(wanted, ids, "right")
                times = high - low
                y = np.repeat(np.arange(len(ids)), times)
                x = row[np.arange(len(y)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
                pieces = [np.einsum("ij,ij->i", q[x[a : a + CHECKED]], v[y[a : a + CHECKED]]) for a in range(0, len(x), CHECKED)]
                found.append((x, ids[y], np.round(np.clip(np.concatenate(pieces or [np.zeros(0)]), -1, 1), 6)))
        if found:
            yield hits()

    return past_blocks(blocks.withColumnRenamed("v", "q"), there.drop("n"), stored_parts(there, size, n)).mapInArrow(look, HITS)


def search_index(index: Index, queries: DataFrame, k: int, nprobe: int = 16, *, vectors: DataFrame | None = None, shortlist: int = 0, skip_self: bool = True) -> DataFrame:
    """The k best of the nprobe nearest cells of every query: query_id, tile_id, score, rank.

    An index of codes gives a shortlist for each query (10 k unless told), of
    which ``vectors`` (tile_id, v) gives the exact scores.
    """
    queries = usable(queries.select("query_id", "v"), index.dim)
    n = number_of_blocks(queries.count(), index.dim * np.dtype(element(queries)).itemsize)
    if index.books is None:
        return best_of(scan(index, queries, n, k, nprobe, skip_self), k)
    most = max(k, shortlist or 10 * k)
    pairs = best_of(scan(index, queries, n, most, nprobe, skip_self), most)
    return best_of(exact_scores(pairs, queries, vectors, index.dim, n, k), k)


def knn_ivf(queries: DataFrame, vectors: DataFrame, k: int, nlist: int = 0, nprobe: int = 16, *, skip_self: bool = True) -> DataFrame:
    """The k best vectors in the nprobe nearest cells of every query: query_id, tile_id, score, rank.  nlist 0: ``auto_nlist``."""
    return search_index(build_index(vectors, nlist), queries, k, nprobe, skip_self=skip_self)


def knn_ivf_pq(queries: DataFrame, vectors: DataFrame, k: int, nlist: int = 0, nprobe: int = 16, m: int = 16, nbits: int = 8, shortlist: int = 0, *, skip_self: bool = True) -> DataFrame:
    """As knn_ivf over codes of m bytes a vector (and four for its norm), with exact scores of a shortlist."""
    return search_index(build_index(vectors, nlist, m, nbits), queries, k, nprobe, vectors=vectors, shortlist=shortlist, skip_self=skip_self)


# ------------------------------------------------------------------- hashing


@dataclass
class HashTables:
    """Buckets of every vector (table, bucket, tile_id), stored by table and bucket, and the hyperplanes: [table, bit, element]."""

    rows: DataFrame
    planes: np.ndarray
    dim: int


def auto_bits(n: int) -> int:
    """So many that a bucket has some BUCKET vectors on average, 1 to 60."""
    return max(1, min(60, round(math.log2(max(2, n / BUCKET)))))


def buckets(rows: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, table] bucket numbers and [row, table, bit] distances from the planes."""
    side = np.einsum("re,tbe->rtb", rows, planes)
    return ((side > 0).astype(np.int64) << np.arange(planes.shape[1])).sum(2), side


def build_tables(vectors: DataFrame, tables: int = 8, bits: int = 0, seed: int = 1) -> HashTables:
    """Hash all usable vectors (tile_id, v) by random hyperplanes; what is stored has an id and a number for each table."""
    spark = vectors.sparkSession
    dim = dimension(vectors)
    vectors = usable(vectors.select("tile_id", "v"), dim)
    planes = np.random.default_rng(seed).normal(size=(tables, bits or auto_bits(vectors.count()), dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                number, _ = buckets(matrix(part["v"], dim), planes)
                ids = part["tile_id"].take(pa.array(np.repeat(np.arange(part.num_rows), tables)))
                yield pa.record_batch([pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(number.ravel()), ids], ["table", "bucket", "tile_id"])

    placed = vectors.mapInArrow(place, "table int, bucket long, tile_id long")
    order = ["table", "bucket", F.xxhash64("tile_id")]  # a hot bucket is cut into many partitions
    path = f"{shared_folder(spark)}/hash-tables-{uuid.uuid4().hex}"
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return HashTables(spark.read.schema(placed.schema).parquet(path), planes, dim)


def probes_of(own: np.ndarray, q: np.ndarray, planes: np.ndarray, probes: int) -> pa.Table:
    """query_id, table, bucket: each query's own buckets and those across its nearest planes, in the order of what they cost.

    Costs are the squared distances of the planes that are crossed, one or two of the nearest.
    """
    number, side = buckets(q, planes)
    bits = planes.shape[1]
    near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, : min(bits, probes)]
    cost = np.take_along_axis(side**2, near, 2)
    flips = [(i,) for i in range(near.shape[2])] + [(i, j) for i in range(near.shape[2]) for j in range(i) if i + j < probes]
    if not flips or probes <= 1:
        chosen = number[:, :, None]
    else:
        costs = np.stack([cost[:, :, list(f)].sum(2) for f in flips], 2)
        masks = np.stack([np.bitwise_or.reduce(np.int64(1) << near[:, :, list(f)], axis=2) for f in flips], 2)
        best = np.argsort(costs, axis=2, kind="stable")[:, :, : probes - 1]
        chosen = np.concatenate([number[:, :, None], number[:, :, None] ^ np.take_along_axis(masks, best, 2)], 2)
    n, t, p = chosen.shape
    return pa.table({"query_id": np.repeat(own.astype(np.int64), t * p), "table": np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n), "bucket": chosen.ravel()})


def met_before(mine: np.ndarray, asked: np.ndarray, table: int) -> np.ndarray:
    """[query, row] whether a row stands in a bucket that the query probes in an earlier table.  mine: [row, table]; asked: [query, table, probe]."""
    met = np.zeros((len(asked), len(mine)), bool)
    for t in range(table):
        for p in range(asked.shape[2]):
            met |= asked[:, t, p][:, None] == mine[:, t][None, :]
    return met


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 8, bits: int = 0, probes: int = 4, *, skip_self: bool = True, index: HashTables | None = None) -> DataFrame:
    """The k best of the vectors that share one of a query's probed buckets, by their exact scores: query_id, tile_id, score, rank, candidates (of the query)."""
    index = index or build_tables(vectors, tables, bits)
    planes, dim, part = index.planes, index.dim, HOT
    tables = len(planes)
    sides = {"tile_id": usable(vectors.select("tile_id", "v"), dim), "query_id": usable(queries.select("query_id", "v"), dim)}

    def numbers(name: str) -> DataFrame:
        """A row for each table and bucket that a row stands in or asks for, with the vector and all its bucket numbers."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK // 8):
                    piece = batch.slice(at, BLOCK // 8)
                    v = matrix(piece["v"], dim)
                    if name == "tile_id":
                        chosen = buckets(v, planes)[0][:, :, None]
                    else:
                        chosen = probes_of(np.arange(len(v)), unit(v), planes, probes)["bucket"].to_numpy().reshape(len(v), tables, -1)
                    n, t, p = chosen.shape
                    row = np.repeat(np.arange(n), t * p)
                    every = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (t * p)), pa.array(chosen.ravel()))
                    yield pa.record_batch([pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(chosen.ravel()), *(c.take(pa.array(row)) for c in (piece[name], piece["v"], every))], ["table", "bucket", name, "v", "every"])

        kind = sides[name].schema["v"].dataType.simpleString()
        return sides[name].mapInArrow(place, f"table int, bucket long, {name} long, v {kind}, every array<long>")

    tiles, asking = numbers("tile_id"), numbers("query_id")
    # a bucket of many rows, or that many ask for, is dealt out as a grid; such buckets are few
    hot = lambda df: df.groupBy("table", "bucket").agg(F.ceil(F.count("*") / part).cast("int").alias("n")).where("n > 1")
    grid = hot(index.rows).withColumnRenamed("n", "nt").join(hot(asking).withColumnRenamed("n", "nq"), ["table", "bucket"], "full").select("table", "bucket", F.coalesce("nt", F.lit(1)).alias("nt"), F.coalesce("nq", F.lit(1)).alias("nq"))
    parts_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = lambda c: F.coalesce(c, F.lit(1))
    left = asking.join(F.broadcast(grid), ["table", "bucket"], "left").withColumn("y", F.pmod(F.xxhash64("query_id"), one("nq")).cast("int")).withColumn("x", parts_of(one("nt"))).drop("nt", "nq")
    right = tiles.join(F.broadcast(grid), ["table", "bucket"], "left").withColumn("x", F.pmod(F.xxhash64("tile_id"), one("nt")).cast("int")).withColumn("y", parts_of(one("nq"))).drop("nt", "nq")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        """A bucket's hits: each pair is scored and counted at the first table where it meets, so it comes once."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if a.num_rows and b.num_rows:
            table, own, ids = a["table"][0].as_py(), a["query_id"].to_numpy(), b["tile_id"].to_numpy()
            q, v = unit(matrix(a["v"], dim)), matrix(b["v"], dim)
            mine, wanted = matrix_of(b["every"], tables), matrix_of(a["every"], -1).reshape(len(own), tables, -1)
            for at in range(0, len(own), STEP):
                some = slice(at, at + STEP)
                s = np.round(np.clip(q[some] @ v.T, -1, 1), 6)
                out = met_before(mine, wanted[some], table)
                if skip_self:
                    out |= own[some][:, None] == ids[None, :]
                n = (~out).sum(1)
                s[out | np.isnan(s)] = -np.inf
                cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if k < s.shape[1] else -np.inf
                x, y = np.nonzero((s >= cut) & np.isfinite(s))
                x, i, s = compact(x, ids[y], s[x, y], k)
                found.append((own[some][x], i, s, np.where(np.diff(x, prepend=-1) != 0, n[x], 0)))  # the bucket's candidates are told with a query's best
        own, ids, s, n = (np.concatenate(c) for c in zip(*found))
        return pa.table({"query_id": own.astype(np.int64), "tile_id": ids.astype(np.int64), "score": s, "candidates": n.astype(np.int64)})

    on = ["table", "bucket", "x", "y"]
    every = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(score, f"{HITS}, candidates long")
    whole = F.sum("candidates").over(Window.partitionBy("query_id"))
    ranked = every.withColumn("rank", best_first()).withColumn("candidates", whole)
    return ranked.where(F.col("rank") <= k)


def matrix_of(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length of whole numbers as a matrix."""
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), width)
