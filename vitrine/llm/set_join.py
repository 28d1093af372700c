"""The distributed part of exact set-similarity joins, for sets of lines and of documents.

A class is a set of 64-bit tokens.  Two classes link at a Jaccard similarity of
``percent`` or more.  Three steps find every link:

1. ``meet``: classes that share one of their rarest tokens (prefix filter), and
   pass the length, positional and bitmap filters there, meet.  A token's
   classes come out with the smallest class that hangs together with them under
   this token, their lead: rows by class, never by pair.
2. ``cells``: all classes of a lead stand in its cell.  Two classes that met
   have a lead in common, so they meet again in a cell.
3. ``compare``: every pair of a cell is compared on the whole sets, as arrays.
   A pair with several cells in common counts in the first of them.  What comes
   out is a row by class: its links, whether one leads to an earlier class, and
   the smallest class that it hangs together with in the cell.

Scale: a token or a cell with more than ``PART`` classes (or ``PART_TOKENS``
tokens) is dealt out as a grid: it is cut in parts, and a task holds two parts
at most, so that no group, however hot, meets in one task, and no pair is
written anywhere.  Sets are shuffled for classes with a partner only, once for
each cell (and part of it) that they stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PART = 1024
PART_TOKENS = 1 << 21
#: Buckets of the count sketches, and those summed together.
BUCKETS = 1 << 20
SLICE = 1 << 14
#: Up to so many rows of a token are paired one by one; those of more by products of COLUMNS tokens at once.
FEW, COLUMNS = 16, 2048
#: Pairs handled at once in memory.
PAIRS = 1 << 21
#: Keys that are known to be large are broadcast up to this number, and joined beyond it.
MOST_BROADCAST = 10_000


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its run, end of its run) for each row of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    number = np.cumsum(new)
    return number, np.append(np.flatnonzero(new), len(new))[number] if len(new) else number


def pairs_ahead(stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b) with a < b < stop[a], in order, in chunks."""
    count = stop - np.arange(len(stop)) - 1
    total = np.cumsum(count)
    low = 0
    while low < len(stop):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        own = count[low:high]
        a = np.repeat(np.arange(low, high), own)
        if len(a):
            yield a, np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own) + a + 1
        low = high


def unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make a[i] and b[i] one component for all i; up holds each row's root, before and after."""
    while len(a):
        a, b = up[a], up[b]
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up[:] = up[up]


def smallest(up: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the smallest value in its component."""
    out = np.full(len(up), np.iinfo(np.int64).max)
    np.minimum.at(out, up, value)
    return out[up]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int = 1 << 25, shift: int = 0) -> Iterator[pa.Table]:
    """The rows of a sorted partition in tables that cut no group of equal keys; a table closes at about so many rows or bytes; the last key's lowest bits may not count."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) < rows and sum(b.get_total_buffer_size() for b in held) < size:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            number, _ = runs(*(column(table, k) >> (shift if k == keys[-1] else 0) for k in keys))
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def grid(rows: DataFrame, key: str, large: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """rows, those of a large key (with its number of parts) in every cell of the grid that their part has, and the columns that name a cell."""
    n = 0 if large is None else large.limit(MOST_BROADCAST + 1).count()
    if not n:
        return rows, [key]
    dealt = rows.join(F.broadcast(large) if n <= MOST_BROADCAST else large, key, "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("class_id", F.lit(5)), F.col("parts")), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("int"))))
    return dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other"), [key, "i", "j"]


def crossed(t: pa.Table) -> np.ndarray:
    """For each row its part where its cell holds two, else a number of its own."""
    own = -1 - np.arange(t.num_rows)
    return np.where(column(t, "i") != column(t, "j"), column(t, "part"), own) if "part" in t.column_names else own


def parity(found: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of 128 cells for each set, as two columns of bits: whether a cell has an odd number of the set's tokens."""
    one = np.uint64(1) << (found & np.uint64(63))
    upper = (found & np.uint64(64)) > 0
    return tuple(np.bitwise_xor.reduceat(np.where(upper == side, one, np.uint64(0)), start).view(np.int64) if len(start) else np.zeros(0, np.int64) for side in (False, True))


def token_counts(rows: DataFrame, column_: str, tokens: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """How many tokens fall in each of BUCKETS buckets: a sketch of fixed size, summed by slices, never too low for a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = bucket_totals(bucket(tokens(batch[column_])) for batch in slices(batches))
        parts = total.reshape(-1, SLICE)
        yield pa.record_batch([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, "<i8") for c in table["counts"].to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    # adding in two steps keeps what one task adds small, however many tasks count
    once = rows.select(column_).mapInArrow(count, "slice int, counts binary").withColumn("salt", F.spark_partition_id() % 64)
    half = once.groupBy("slice", "salt").applyInArrow(add, "slice int, counts binary")
    out = np.zeros(BUCKETS, np.int64)
    for r in half.groupBy("slice").applyInArrow(add, "slice int, counts binary").toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
    return out


def bucket_totals(found: Iterator[np.ndarray]) -> np.ndarray:
    """How often each bucket comes; a pass over all buckets is for as many finds, not for a few rows'."""
    total, held, size = np.zeros(BUCKETS, np.int64), [], 0
    for some in found:
        held.append(some)
        size += len(some)
        if size >= BUCKETS:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held, size = [], 0
    return total + np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=BUCKETS)


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


def large_tokens(classes: DataFrame) -> DataFrame | None:
    """token, parts: tokens with over PART classes, counted exactly among those that the sketch doesn't rule out; None if it rules out all."""
    flat = lambda prefixes: prefixes.flatten().to_numpy()
    may = token_counts(classes, "prefix", flat) > PART
    if not may.any():
        return None
    shared_may = classes.sparkSession.sparkContext.broadcast(may)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            tokens = flat(batch["prefix"])
            yield pa.record_batch([pa.array(tokens[shared_may.value[bucket(tokens)]])], ["token"])

    found = classes.select("prefix").mapInArrow(pick, "token long")
    return found.groupBy("token").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1")


def meet(classes: DataFrame, percent: int) -> DataFrame:
    """class_id, lead (distinct).  classes: class_id, size, bits and more_bits (parity), prefix (tokens of 40 bits)."""
    entries = classes.select("class_id", "size", "bits", "more_bits", F.posexplode("prefix").alias("place", "token"))
    entries = entries.withColumn("sizes", F.shiftleft(F.col("size").cast("long"), 32) + F.col("place")).drop("place")  # both in one number
    dealt, order = grid(entries, "token", large_tokens(classes))
    # one number to sort by: the token, then the size
    dealt = dealt.withColumn("by", F.shiftleft("token", 23) + F.least("size", F.lit((1 << 23) - 1)))
    dealt = dealt.repartition(*order).sortWithinPartitions(*order[1:], "by").drop("token", "size")
    order = [*order[1:], "by"]

    def under_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, order, 1 << 17, shift=23):
            own, sizes, bits, more = (column(t, c) for c in ("class_id", "sizes", "bits", "more_bits"))
            bits, more = bits.view(np.uint64), more.view(np.uint64)
            size, place = sizes >> 32, sizes & ((1 << 32) - 1)
            number, end = runs(*(column(t, k) >> (23 if k == "by" else 0) for k in order))
            # sorted by size: those that are not too long for a row follow it
            key = column(t, "by") & ((1 << 23) - 1)
            stop = np.minimum(np.searchsorted((number << 40) | key, (number << 40) | (size * 100 // percent), "right"), end)
            stop[key == (1 << 23) - 1] = end[key == (1 << 23) - 1]
            part = crossed(t)
            up = np.arange(len(own))
            for a, b in pairs_ahead(stop):
                both = size[a] + size[b]
                ok = np.minimum(size[a] - place[a], size[b] - place[b]) * (100 + percent) >= percent * both
                ok &= part[a] != part[b]
                a, b, both = a[ok], b[ok], both[ok]
                odd = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64) + np.bitwise_count(more[a] ^ more[b])
                ok = odd * (100 + percent) <= (100 - percent) * both
                unite(up, a[ok], b[ok])
            lead = smallest(up, own)
            met = np.flatnonzero((np.bincount(up, minlength=len(up)) > 1)[up])
            order_ = np.lexsort((lead[met], own[met]))
            own, lead = own[met][order_], lead[met][order_]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (lead[1:] != lead[:-1])
            yield pa.record_batch([pa.array(own[fresh]), pa.array(lead[fresh])], ["class_id", "lead"])

    return dealt.mapInArrow(under_tokens, "class_id long, lead long").distinct()


def fewer_leads(led: DataFrame) -> DataFrame:
    """led with every lead replaced by the smallest one that any of its classes has, where that makes a cell of PART classes at most.

    Classes with a lead in common still have one: what a lead becomes is the same for all its classes.
    """
    least = led.groupBy("class_id").agg(F.min("lead").alias("least"))
    to = led.join(least, "class_id").groupBy("lead").agg(F.min("least").alias("to"))
    moved = led.join(to, "lead").select("class_id", "lead", "to")
    small = moved.select("class_id", "to").distinct().groupBy("to").agg(F.count("*").alias("n")).where(F.col("n") <= PART)
    return moved.join(small, "to", "left").select("class_id", F.when(F.col("n").isNull(), F.col("lead")).otherwise(F.col("to")).alias("lead")).distinct()


def cells(led: DataFrame) -> tuple[DataFrame, list[str]]:
    """class_id, lead, earlier (its smaller leads) and the place in a grid; the columns that name a cell.  led: class_id, lead, size."""
    leads = led.groupBy("class_id").agg(F.collect_set("lead").alias("leads")).where("size(leads) > 1")
    large = led.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / PART_TOKENS)).alias("parts")).where("parts > 1")
    rows = led.select("class_id", "lead").join(leads, "class_id", "left")
    rows = rows.select("class_id", "lead", F.coalesce(F.filter("leads", lambda x: x < F.col("lead")), F.array().cast("array<long>")).alias("earlier"))
    return grid(rows, "lead", large)


def shared(stop: np.ndarray, base: np.ndarray, owner: np.ndarray, token: np.ndarray) -> np.ndarray:
    """For each pair (x, y) of rows, at base[x] + y - x - 1, how many tokens both have."""
    cell, _ = runs(stop)
    order = np.lexsort((owner, token, cell[owner]))
    owner, token = owner[order], token[order]
    number, end = runs(cell[owner], token)
    out = np.zeros(int((stop - np.arange(len(stop)) - 1).sum()), np.int32)
    times = np.bincount(number)[number] if len(number) else number
    # tokens of few rows: their pairs one by one
    few = np.where(times <= FEW, end, np.arange(len(end)) + 1)
    for p, q in pairs_ahead(few):
        np.add.at(out, base[owner[p]] + owner[q] - owner[p] - 1, np.int32(1))
    # tokens of many: products of the rows of their cell, so many tokens at once
    many = np.flatnonzero(times > FEW)
    for own in np.split(many, np.flatnonzero(np.diff(cell[owner[many]])) + 1) if len(many) else []:
        first = int(np.searchsorted(cell, cell[owner[own[0]]]))
        n = int(stop[first]) - first
        of_token, row = number[own] - number[own[0]], owner[own] - first
        _, of_token = np.unique(of_token, return_inverse=True)
        counts = np.zeros((n, n), np.float32)
        for low in range(0, int(of_token[-1]) + 1, COLUMNS):
            here = slice(*np.searchsorted(of_token, (low, low + COLUMNS)))
            has = np.zeros((n, min(COLUMNS, int(of_token[-1]) + 1 - low)), np.float32)
            has[row[here], of_token[here] - low] = 1
            counts += has @ has.T
        at = int(base[first])
        out[at : at + n * (n - 1) // 2] += counts[np.triu_indices(n, 1)].astype(np.int32)
    return out


def lists(array: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all values of lists of longs."""
    array = array.combine_chunks()
    return np.repeat(np.arange(len(array)), np.diff(array.offsets.to_numpy())), array.flatten().to_numpy()


def tokens_of(array: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of each set, owner, token) of sets kept as little-endian bytes."""
    raw = array.combine_chunks().to_pylist()
    size = np.array([len(x) // 8 for x in raw], np.int64)
    return size, np.repeat(np.arange(len(raw)), size), np.frombuffer(b"".join(raw), "<i8")


def compare(members: DataFrame, keys: list[str], percent: int, order: list[str]) -> DataFrame:
    """class_id, links, late (a link leads to a class that is before it in order), root (see the module), for classes with a link in a cell.

    members: class_id, lead, earlier, the place in a grid (named by keys), tokens, and the columns of order (without nulls).
    """
    dealt = members.repartition(*keys).sortWithinPartitions(*keys)

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 4 * PART):
            _, stop = runs(*(column(table, k) for k in keys))
            total, ends, low, k = np.cumsum(stop - np.arange(len(stop)) - 1), np.unique(stop), 0, 0
            while k < len(ends):  # whole cells, as many as their pairs allow
                k = max(k + 1, int(np.searchsorted(total[ends - 1], (total[low - 1] if low else 0) + 4 * PAIRS, "right")))
                high = int(ends[k - 1])
                yield of_cells(table.slice(low, high - low), stop[low:high] - low)
                low = high

    def of_cells(t: pa.Table, stop: np.ndarray) -> pa.RecordBatch:
        base = np.cumsum(stop - np.arange(len(stop)) - 1) - (stop - np.arange(len(stop)) - 1)
        size, owner, token = tokens_of(t["tokens"])
        both = shared(stop, base, owner, token)
        owner, lead = lists(t["earlier"])
        again = shared(stop, base, owner, lead) if len(owner) else None
        part = crossed(t)
        rank = np.empty(len(stop), np.int64)
        rank[np.lexsort([column(t, c) for c in reversed(order)])] = np.arange(len(stop))
        links, late, up, at = np.zeros(len(stop), np.int64), np.zeros(len(stop), bool), np.arange(len(stop)), 0
        for x, y in pairs_ahead(stop):
            n = both[at : at + len(x)]
            ok = n.astype(np.int64) * (100 + percent) >= percent * (size[x] + size[y])
            ok &= part[x] != part[y]
            if again is not None:
                ok &= again[at : at + len(x)] == 0
            at += len(x)
            x, y = x[ok], y[ok]
            links += np.bincount(x, minlength=len(links)) + np.bincount(y, minlength=len(links))
            late[np.where(rank[x] > rank[y], x, y)] = True
            unite(up, x, y)
        own = column(t, "class_id")
        root, found = smallest(up, own), np.flatnonzero(links)
        return pa.record_batch([pa.array(own[found]), pa.array(links[found]), pa.array(late[found]), pa.array(root[found])], ["class_id", "links", "late", "root"])

    return dealt.mapInArrow(in_cells, "class_id long, links long, late boolean, root long")
