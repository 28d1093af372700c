"""Removal of long repeated strings with an enhanced suffix array.

Every byte is removed that a string of ``length`` bytes covers which also
starts anywhere else, in the same document or another.  Strings are judged on
the input; matches never cross documents.

A suffix array of all positions can't be shuffled at scale, so it is a sparse
one, over positions that the text itself chooses:

1. Anchors.  Each string of ``length`` bytes has one anchor, the position of
   the smallest hash among its ``GRAM``-byte substrings (the leftmost of
   equals).  Equal strings have equal anchors at equal distances.  About one
   position in 85 is an anchor; it stands for the run of string starts that
   chose it, with the bytes those strings cover (its context).
2. Anchors whose hash occurs once have no repeated string.  Anchors whose
   whole context occurs twice (inside copies) are repeated throughout; equal
   contexts are one class from here on.
3. For the other classes of a hash, the contexts are fetched, and per hash the
   suffixes at the anchors are sorted: a suffix array with common-prefix
   lengths.  A scan with a stack walks its tree of common-prefix intervals; a
   second one, in each, over the members' reversed left contexts, finds the
   sets whose left extensions differ beyond a common part.  A set that also
   differs on the right is a maximal repeat with all its occurrences
   (``repeat_groups``); the removal takes its spans from them.
4. A hash with more than ``HOT`` classes (a passage in very many documents)
   would be one large group; there, each string of ``length`` bytes is counted
   by its 64-bit hash instead, an aggregate that no group can skew.  The bytes
   removed are the same either way.

Equality of substrings rests on 64-bit hashes in steps 1, 2 and 4 and on bytes
in step 3.

Scale: the shuffles carry anchors (about 30 bytes for each 85 bytes of text),
contexts of the boundaries of repeats only, and the texts once, to be cut.

Edge cases: null and empty texts have no byte and lose none; a text shorter
than ``length`` loses nothing; repeated rows are copies of each other (both
lose all they share); null ids are ids like any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

GRAM = 32
HOT = 4096
#: Bytes hashed at once.
CHUNK = 1 << 19
_PLACE = 20  # bits of a packed key that hold a place in a chunk
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
ROW = ["doc_id", "thash"]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, 2**64))
        out[filled : 2 * filled] = out[: min(filled, n - filled)] * step
        filled *= 2
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _tables:
        _tables[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return _tables[size]


class Hashes:
    """Hashes of substrings of a byte string: equal substrings have equal hashes, wherever they start."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.upto[1:])

    def between(self, start, stop) -> np.ndarray:
        x = (self.upto[stop] - self.upto[start]) * self.down[start]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def all_of(self, length: int) -> np.ndarray:
        """Of every substring of one length, by its start."""
        n = len(self.upto) - length
        x = (self.upto[length:] - self.upto[:n]) * self.down[:n]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors_of(data: np.ndarray, inside: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last, context) of each anchor; inside says which starts have a whole string in their document."""
    h = Hashes(data)
    grams = h.all_of(GRAM)
    mask = np.uint64((1 << _PLACE) - 1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_min(packed, length - GRAM + 1) & mask).astype(np.int64)
    starts = np.flatnonzero(inside[: len(chosen)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    own = chosen[starts]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    place = own[new]
    # the context's hash also tells its length and where the anchor stands in it
    context = h.between(first, last + length) + (place - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (last - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return grams[place].view(np.int64), place, first, last, context.view(np.int64)


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, inside, row of each piece, start of each piece in data, its offset in the text): texts laid end to end; long ones in overlapping pieces."""
    size, pieces = 0, []

    def laid() -> tuple:
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in pieces])
        starts = ends - [len(p) for _, _, p in pieces]
        inside = np.zeros(len(data), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            inside[a : max(a, b - length + 1)] = True
        return data, inside, np.array([r for r, _, _ in pieces]), starts, np.array([o for _, o, _ in pieces])

    for r, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK - length):
            piece = text[at : at + CHUNK - 1]
            if len(piece) < length:
                continue
            if pieces and size + len(piece) > CHUNK:
                yield laid()
                size, pieces = 0, []
            pieces.append((r, at, piece))
            size += len(piece)
    if pieces:
        yield laid()


def find_anchors(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, thash, anchor, context, first, last, place (in the text's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
            for data, inside, row, starts, offset in chunks(texts, length):
                h, place, first, last, context = anchors_of(data, inside, length)
                if not len(h):
                    continue
                piece = np.searchsorted(starts, first, "right") - 1
                shift = offset[piece] - starts[piece]
                own = pa.array(row[piece])
                yield pa.record_batch(
                    [batch["doc_id"].take(own), batch["thash"].take(own), pa.array(h), pa.array(context), *(pa.array((x + shift).astype(np.int32)) for x in (first, last, place))],
                    ["doc_id", "thash", "anchor", "context", "first", "last", "place"],
                )

    return rows.mapInArrow(run, "doc_id long, thash long, anchor long, context long, first int, last int, place int")


# ----------------------------------------- the sparse suffix array of a group


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """All intervals (first, last, length) of a common-prefix array, by one scan with a stack; lcp[i] is of suffixes i-1 and i."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield first, i - 1, depth
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least length bytes through the anchors of a group: (left reach, right reach, all members).

    lefts: the bytes before each anchor; rights: the bytes from it on.  An
    interval of the common-prefix tree is maximal to the right: its members
    differ, or end, after its prefix.  Among the members, in the order of their
    reversed lefts, a second scan gives the sets that are maximal to the left;
    a set is left-diverse by that, and right-diverse if its members come from
    more than one child of the interval.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    backs = [x[::-1] for x in lefts]
    rank = [0] * len(backs)
    for i, m in enumerate(sorted(range(len(backs)), key=backs.__getitem__)):
        rank[m] = i
    for first, last, reach in prefix_intervals(lcp):
        child = {order[first]: 0}
        for i in range(first + 1, last + 1):
            child[order[i]] = child[order[i - 1]] + (lcp[i] == reach)
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        shared = [0] + [common(backs[a], backs[b]) for a, b in zip(members, members[1:], strict=False)]
        sets = list(prefix_intervals(shared))
        if min(shared[1:]) == 0:
            sets.append((0, len(members) - 1, 0))
        for a, b, left in sets:
            if left + reach >= length and len({child[m] for m in members[a : b + 1]}) > 1:
                yield left, reach, members[a : b + 1]


SPAN = "doc_id long, thash long, start int, stop int"


def repeats_in_group(group: pa.Table, length: int, named: bool) -> pa.Table:
    """The repeats among the classes of one anchor hash: anchor, context, before, after (bytes around the anchor that repeat), repeat.

    named: every maximal repeat with all its members, named by its string's
    hash; else, for each member and right reach, the longest, without a name.
    """
    text, head = group["bytes"].to_pylist(), group["head"].to_pylist()
    lefts, rights = [t[:h] for t, h in zip(text, head, strict=True)], [t[h:] for t, h in zip(text, head, strict=True)]
    longest: dict[tuple[int, int], int] = {}
    rows: list[tuple[int, int, int, int | None]] = []
    for left, reach, members in maximal_repeats(lefts, rights, length):
        if named:
            m = members[0]
            name = int(np.uint64(xxhash.xxh64_intdigest(text[m][head[m] - left : head[m] + reach], seed=42)).astype(np.int64))
            rows.extend((m, left, reach, name) for m in members)
        else:
            for m in members:
                longest[m, reach] = max(left, longest.get((m, reach), 0))
    rows.extend((m, left, reach, None) for (m, reach), left in longest.items())
    own, before, after, name = zip(*rows, strict=True) if rows else ((), (), (), ())
    own = pa.array(own, pa.int64())
    return pa.table({"anchor": group["anchor"].take(own), "context": group["context"].take(own), "before": pa.array(before, pa.int32()), "after": pa.array(after, pa.int32()), "repeat": pa.array(name, pa.int64())})


REPEATS = "anchor long, context long, before int, after int, repeat long"


def prepared(docs: DataFrame, length: int, key: str, text: str, hot: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, anchors, classes, fetched contexts, strings of hot hashes that occur twice)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("thash", F.xxhash64("text"))
    anchors = staged(find_anchors(rows, length), "anchors", compression="zstd")

    # classes of equal contexts, and how many a hash has
    classes = anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "thash", "first", "last", "place")).alias("one"))
    hashes = classes.groupBy("anchor").agg(F.sum("n").alias("members"), F.count("*").alias("kinds"))
    classes = staged(classes.join(hashes.where("members > 1"), "anchor"), "anchor-classes", compression="zstd")
    mixed = classes.where("kinds > 1")

    # the classes that differ from others of their hash: fetch the bytes of one member each, or the hashes of its strings
    asked = mixed.select("anchor", "context", "one.*", (F.col("kinds") > hot).alias("is_hot")).groupBy("doc_id", "thash")
    asked = asked.agg(F.collect_list(F.struct("anchor", "context", "first", "last", "place", "is_hot")).alias("asked")).withColumnsRenamed({"doc_id": "a_id", "thash": "a_hash"})
    near = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("thash") == F.col("a_hash"))).select("text", "asked")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for t, wanted in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["asked"].to_pylist(), strict=True):
                for a in wanted:
                    first, last = a["first"], a["last"]
                    part = t[first : last + length]
                    if a["is_hot"]:
                        strings = Hashes(np.frombuffer(part, np.uint8)).all_of(length).astype("<u8").tobytes()
                        out.append((a["anchor"], a["context"], None, None, strings))
                    else:
                        out.append((a["anchor"], a["context"], a["place"] - first, part, None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["anchor", "context", "head", "bytes", "strings"])

    fetched = near.mapInArrow(contexts, "anchor long, context long, head int, bytes binary, strings binary").dropDuplicates(["anchor", "context"])
    fetched = staged(fetched, "contexts", compression="zstd")

    # hot hashes: count the strings themselves
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [np.frombuffer(s, "<i8") for s in batch["strings"].to_pylist()]
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            nth = np.concatenate([np.arange(len(x)) for x in lists]) if lists else np.zeros(0, np.int64)
            own = pa.array(at)
            yield pa.record_batch([batch["anchor"].take(own), batch["context"].take(own), pa.array(nth.astype(np.int32)), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))], ["anchor", "context", "nth", "string"])

    strings = fetched.where("strings is not null").select("anchor", "context", "strings").mapInArrow(listed, "anchor long, context long, nth int, string long")
    twice = strings.groupBy("anchor", "string").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "string")
    return rows, anchors, classes, fetched, strings.join(twice, ["anchor", "string"])


def repeat_groups(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Every occurrence of each repeated string: repeat (the string's name), doc_id, start, stop (in bytes).

    A repeat is maximal within the context of its anchor, and all its
    occurrences are listed; a repeat longer than a context comes as one group
    for each of its anchors.  For hot hashes the groups are the repeated strings
    of ``length`` bytes and the equal contexts.  Rows equal in id and text stand
    for one; null and short texts have no repeat, an empty table gives none.
    """
    _, anchors, classes, fetched, strings = prepared(docs, length, key, text, hot)
    several = fetched.where("bytes is not null")
    arrays = several.groupBy("anchor").applyInArrow(lambda g: repeats_in_group(g, length, True), REPEATS)
    # copies of a whole context are a repeat too; a class alone in its hash is named by its context
    copies = classes.where("n > 1 and kinds > 1").select("anchor", "context").join(several, ["anchor", "context"])
    copies = copies.select("anchor", "context", F.col("head").alias("before"), (F.length("bytes") - F.col("head")).alias("after"), F.xxhash64("bytes").alias("repeat"))
    alone = classes.where(f"n > 1 and (kinds = 1 or kinds > {hot})")
    alone = alone.select("anchor", "context", (F.col("one.place") - F.col("one.first")).alias("before"), (F.col("one.last") + length - F.col("one.place")).alias("after"), F.col("context").alias("repeat"))
    found = arrays.unionByName(copies).unionByName(alone)
    by_array = anchors.join(found, ["anchor", "context"]).select("repeat", *ROW, (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("stop"))
    by_hash = anchors.join(strings, ["anchor", "context"]).select(F.col("string").alias("repeat"), *ROW, (F.col("first") + F.col("nth")).alias("start"), (F.col("first") + F.col("nth") + length).alias("stop"))
    return by_array.unionByName(by_hash).distinct().drop("thash")


def remove_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, removed (spans in bytes), kept (the remaining bytes)."""
    rows, anchors, classes, fetched, strings = prepared(docs, length, key, text, hot)
    usual = fetched.where("bytes is not null").groupBy("anchor").applyInArrow(lambda g: repeats_in_group(g, length, False), REPEATS)
    runs = strings.groupBy("anchor", "context").agg(F.sort_array(F.collect_list("nth")).alias("nths"))

    # spans in the documents: for whole classes, for usual groups, for hot groups
    members = anchors.select(*ROW, "anchor", "context", "first", "last", "place")
    whole = classes.where("n > 1").select("anchor", "context", F.lit(True).alias("whole"))
    usual = usual.groupBy("anchor", "context").agg(F.collect_set(F.struct("before", "after")).alias("reaches"))
    verdicts = whole.join(usual, ["anchor", "context"], "full").join(runs, ["anchor", "context"], "full")
    spans = members.join(verdicts, ["anchor", "context"]).select(
        *ROW,
        F.when(F.col("whole"), F.array(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("stop")))).otherwise(
            F.concat(
                F.coalesce(F.transform("reaches", lambda r: F.struct((F.col("place") - r["before"]).alias("start"), (F.col("place") + r["after"]).alias("stop"))), F.array().cast("array<struct<start:int,stop:int>>")),
                F.coalesce(F.transform("nths", lambda n: F.struct((F.col("first") + n).alias("start"), (F.col("first") + n + length).alias("stop"))), F.array().cast("array<struct<start:int,stop:int>>")),
            )
        ).alias("spans"),
    )
    spans = spans.groupBy(*ROW).agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnsRenamed({"doc_id": "s_id", "thash": "s_hash"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("thash") == F.col("s_hash")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, kept, n_bytes = [], [], []
            lists = batch["spans"]
            edges = lists.offsets.to_numpy()
            flat = lists.values
            starts, stops = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, t in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                t = t or b""
                own, last = [], 0
                parts = []
                a, b = int(edges[i]), int(edges[i + 1])
                if lists[i].is_valid and b > a:
                    s, e = starts[a:b], stops[a:b]
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    for x, y in zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist(), strict=True):
                        own.append({"start": x, "stop": y})
                        parts.append(t[last:x])
                        last = y
                parts.append(t[last:])
                removed.append(own)
                kept.append(b"".join(parts))
                n_bytes.append(len(t))
            yield pa.record_batch([batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary")


def digest_removals(cut: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Removed spans by a dictionary of all strings, for tests."""
    from collections import Counter

    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans: list[list[int]] = []
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def sha256_of(texts: list[bytes], spans: list[list[tuple[int, int]]]) -> list[str]:
    out = []
    for t, own in zip(texts, spans, strict=True):
        keep = np.ones(len(t), bool)
        for a, b in own:
            keep[a:b] = False
        out.append(hashlib.sha256(np.frombuffer(t, np.uint8)[keep].tobytes()).hexdigest())
    return out
