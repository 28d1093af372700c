"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of all words of the training documents, for
each block of documents: term -> ascending positions over the block, with the
documents laid end to end and one empty place between them.  The index knows
nothing of a benchmark and serves any.  ``search`` answers all test phrases from
these postings alone: in each block every phrase starts from its rarest term
there, and its candidate places are intersected, shifted by the terms' offsets,
with the other terms' lists, the rarest first.

A phrase matches at a place p of a document if for every k its k-th word stands
within ``slop`` places of p + k, in the same document.  With ``slop`` 0 these are
exact phrases, else proximity matches.  Which term is the rarest steers the work
only, so blocks and partitions don't change what matches.  The words that a
match covers are those from p on, as many as the phrase has.

Scale: the index is partitioned by documents; building and searching are two
passes without a shuffle of texts, and a passage that a third of all documents
share costs each block only its own postings.  The phrases are built by Spark,
as arrays of 64-bit word hashes, and go to the blocks in groups of at most
``GROUP_PHRASES`` phrases (a stated query set, in blocks): what the driver holds
and broadcasts is one group.  A larger benchmark takes several passes over the
same index.  Names of items never leave the cluster: they are joined to the
phrases that matched.

Edge cases: null texts have no words and match nothing; an item with fewer
words than a window is one window, an item with none never matches; a null
item id is named by the empty string; repeated document rows each get a row;
items that repeat are found together; very long texts and items are split
nowhere; empty tables give empty results, and with no items every document is
clean; other columns, whatever their names, are kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, staged
from .line_join import LOWER, mixed, utf8, word_hashes
from .word_arrays import by_bytes

#: Documents and bytes of text of a block at most; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
GROUP_PHRASES = 1 << 18
#: Candidate places handled at once.
PLACES = 1 << 20
_CODE = np.arange(256)
_IN_WORD = (_CODE >= 0x80) | np.isin(_CODE, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
#: The share of a byte in a word's hash: ASCII digits and letters (A-Z as a-z) and all bytes above.
SHARE = np.where(_IN_WORD, mixed(LOWER.astype(np.uint64) + np.uint64(1)), 0).astype(np.uint64)
INDEX_SCHEMA = "block long, doc_ids binary, null_ids binary, row_keys binary, doc_starts binary, terms binary, offsets binary, positions binary"
MATCHES = "block long, nth int, doc_id long, row_key long, n_words long, spans array<struct<start:int,stop:int>>, phrases array<long>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits of every word, where each text's words begin and the last one's end)."""
    data, at = utf8(texts)
    starts, hashes = word_hashes(data, at, SHARE)
    return hashes.view(np.int64), np.searchsorted(starts, at)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", row_key: Column | None = None) -> DataFrame:
    """The stored index: one row per block of documents.  block: its name; terms ascending; positions[offsets[k]:offsets[k + 1]] are those of terms[k]."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in by_bytes(slices(batches, BLOCK_ROWS), most=BLOCK_BYTES):
            words, first = terms_of(batch["text"])
            starts = first + np.arange(len(first))
            place = np.arange(len(words)) + np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.argsort(words, kind="stable")
            terms, at = np.unique(words[order], return_index=True)
            given = batch["doc_id"]
            row = [
                given.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), given.is_null().to_numpy(zero_copy_only=False), batch["row_key"].to_numpy(zero_copy_only=False).astype("<i8"),
                starts.astype("<i8"), terms.astype("<i8"), np.append(at, len(words)).astype("<i8"), place[order].astype("<i8" if starts[-1] >> 31 else "<i4"),
            ]
            yield pa.record_batch([pa.array([block]), *(pa.array([x.tobytes()], pa.large_binary()).cast(pa.binary()) for x in row)], ["block", "doc_ids", "null_ids", "row_keys", "doc_starts", "terms", "offsets", "positions"])
            block += 1

    row_key = F.lit(0).cast("long") if row_key is None else row_key
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key.alias("row_key"))
    return staged(rows.mapInArrow(blocks, INDEX_SCHEMA), "postings", compression="zstd")


def phrases_of(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """phrase (64 bits), terms (word hashes as little-endian bytes), name: every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            words, first = terms_of(batch["text"])
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                own = words[a:b].astype("<i8")
                for low in range(0, max(1, len(own) - window + 1) if len(own) else 0, 1 << 16):
                    high = min(low + (1 << 16), max(1, len(own) - window + 1))
                    found = pa.array([own[k : k + window].tobytes() for k in range(low, high)], pa.binary())
                    yield pa.record_batch([batch["name"].take(pa.array(np.full(len(found), i))), found], ["name", "terms"])

    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    return named.mapInArrow(cut, "name string, terms binary").select(F.xxhash64("terms").alias("phrase"), "terms", "name")


def match_block(phrases: np.ndarray, sizes: np.ndarray, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray, starts: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase, document, place) of all matches in a block, in chunks.  phrases: term hashes by row, of which the first sizes[row] count."""
    at = np.searchsorted(terms, phrases)
    at[at == len(terms)] = 0
    inside = np.arange(phrases.shape[1]) < sizes[:, None]
    alive = np.flatnonzero(((terms[at] == phrases) | ~inside).all(axis=1)) if len(terms) else np.zeros(0, np.int64)
    if not len(alive):
        return
    at, inside, size = at[alive], inside[alive], sizes[alive]
    count = np.where(inside, np.diff(offsets)[at], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")  # the rarest first
    # one ascending key for all postings: term, then position
    width = int(starts[-1]) + 2
    key = np.repeat(np.arange(len(terms)), np.diff(offsets)) * width + positions
    row = np.arange(len(alive))
    listed = count[row, order[:, 0]]
    total, low = np.cumsum(listed), 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PLACES // (2 * slop + 1), "right")))
        own = listed[low:high]
        p = np.repeat(np.arange(low, high), own)
        nth = np.arange(len(p)) - np.repeat(np.cumsum(own) - own, own)
        anchor = positions[offsets[at[p, order[p, 0]]] + nth]
        doc = np.searchsorted(starts, anchor, "right") - 1
        place = anchor - order[p, 0]
        if slop:
            shift = np.arange(-slop, slop + 1)
            p, doc, place = (np.repeat(x, len(shift)) for x in (p, doc, place))
            place = place + np.tile(shift, len(place) // len(shift))
        for j in range(phrases.shape[1]):
            k = order[p, j]
            term = at[p, k] * width
            first = np.maximum(place + k - slop, starts[doc])
            last = np.minimum(place + k + slop, starts[doc + 1] - 2)
            found = np.searchsorted(key, term + first)
            found[found == len(key)] = 0
            ok = (first <= last) & (key[found] >= term + first) & (key[found] <= term + last) | (j >= size[p])
            p, doc, place = p[ok], doc[ok], place[ok]
        if slop and len(p):  # several words of one phrase can lead to one place
            p, doc, place = np.unique(np.stack([p, doc, place]), axis=1)
        yield alive[p], doc, place
        low = high


def search(index: DataFrame, phrases: pa.Table, slop: int = 0) -> DataFrame:
    """One row per document: its words, the merged spans of all matches (in words) and the phrases that match.  phrases: phrase, terms."""
    terms = phrases["terms"].to_pylist()
    sizes = np.array([len(t) // 8 for t in terms], np.int64)
    packed = np.zeros((len(terms), int(sizes.max(initial=1))), "<i8")
    packed[np.arange(packed.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(terms), "<i8")
    shared = index.sparkSession.sparkContext.broadcast((packed, sizes, phrases["phrase"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, sizes, names = shared.value
        for batch in slices(batches, 1):
            row = {c: batch[c][0].as_py() for c in batch.schema.names}
            starts, terms, offsets = (np.frombuffer(row[c], "<i8") for c in ("doc_starts", "terms", "offsets"))
            n = len(starts) - 1
            positions = np.frombuffer(row["positions"], "<i8" if starts[-1] >> 31 else "<i4").astype(np.int64)
            found = [(np.zeros(0, np.int64),) * 3, *match_block(packed, sizes, terms, offsets, positions, starts, slop)]
            p, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((place, doc))
            p, doc, place = p[order], doc[order], place[order]
            start = np.maximum(place, starts[doc]) - starts[doc]
            stop = np.minimum(place + sizes[p], starts[doc + 1] - 1) - starts[doc]
            spans, own = merged(doc, start, stop, n), np.unique(np.stack([doc, names[p]]), axis=1)
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[0], np.arange(n + 1)).astype(np.int32)), pa.array(own[1]))
            ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], bool))
            yield pa.record_batch(
                [pa.array(np.full(n, row["block"])), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(np.frombuffer(row["row_keys"], "<i8")), pa.array(np.diff(starts) - 1), spans, listed],
                ["block", "nth", "doc_id", "row_key", "n_words", "spans", "phrases"],
            )

    return index.mapInArrow(run, MATCHES)


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> pa.ListArray:
    """For each of n documents its spans, overlapping and touching ones made one; given in the order of (doc, start)."""
    far = doc * (int(stop.max(initial=0)) + 2)  # apart from one document to the next
    reach = np.maximum.accumulate(far + stop) if len(doc) else stop
    new = np.ones(len(doc), bool)
    new[1:] = far[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    whole = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array((reach[last] - far[last]).astype(np.int32) if len(first) else first.astype(np.int32))], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)), whole)


def merge_spans(spans: Column) -> Column:
    """An array of spans with overlapping and touching ones made one."""

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(F.get(out, F.size(out) - 1)["stop"] >= s["start"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,stop:int>>"), add)


def row_key(doc_key: str = "doc_id") -> Column:
    return F.xxhash64(F.col(doc_key).isNull(), F.col(doc_key), F.col("text"))


def search_items(index: DataFrame, items: DataFrame, window: int = 13, slop: int = 0, item_key: str = "item_id", group_phrases: int = GROUP_PHRASES) -> DataFrame:
    """Per indexed document row: doc_id, row_key, n_words, spans and items of all matches of the items' windows."""
    phrases = staged(phrases_of(items, window, item_key), "phrases", compression="zstd")
    distinct = staged(phrases.groupBy("phrase").agg(F.min("terms").alias("terms")), "distinct-phrases", compression="zstd")
    groups = max(1, -(-distinct.count() // group_phrases))
    parts = []
    for g in range(groups):
        own = distinct.where(F.pmod("phrase", F.lit(groups)) == g).toArrow()  # a group, bounded by group_phrases
        parts.append(staged(search(index, own, slop), "matches", compression="zstd"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    named = found.where("size(phrases) > 0").select("block", "nth", F.explode("phrases").alias("phrase")).join(phrases.select("phrase", "name"), "phrase")
    named = named.groupBy("block", "nth").agg(F.array_sort(F.collect_set("name")).alias("items"))
    if groups > 1:  # each row has one part per group
        found = found.groupBy("block", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"), merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = found.select("block", "nth", "doc_id", "row_key", "n_words", "spans").join(named, ["block", "nth"], "left")
    out = staged(out.select("doc_id", "row_key", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "found-items", compression="zstd")
    release(phrases, distinct, *parts)
    return out


def find_items(docs: DataFrame, items: DataFrame, window: int = 13, slop: int = 0, doc_key: str = "doc_id", item_key: str = "item_id", group_phrases: int = GROUP_PHRASES) -> DataFrame:
    """The same for a table of documents, by an index of its own; row_key is a hash of id and text."""
    index = build_index(docs, doc_key, row_key=row_key(doc_key))
    found = search_items(index, items, window, slop, item_key, group_phrases)
    release(index)
    return found


def judge_contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """Digest columns: n_hit, n_items, items_sha256, contaminated (hits make up at least one share-th of the words)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    own = [c for c in ("doc_id", "row_key") if c in found.columns]
    out = found.select(*own, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Rows that aren't contaminated; rows are told apart by id and text, so that a null or repeated id takes no other row along."""
    bad = judge_contamination(find_items(docs, items, window)).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_row")).distinct()
    given = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("own_id"), row_key().alias("own_row"))
    return given.join(bad, (F.col("own_row") == F.col("bad_row")) & F.col("own_id").eqNullSafe(F.col("bad_id")), "left_anti").select("doc.*")
