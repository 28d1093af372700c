"""Near copies of whole documents: Jaccard similarity of word shingles, exactly.

A document is the set of its shingles of ``shingle`` words (words as in the
SimHash: runs without ASCII white space, A-Z lower-cased).  Two documents link
at a Jaccard similarity of ``threshold`` or more; documents that hang together
by links are one class, and one row of each class stays.

Candidates come from two ways.  SimHashes of the shingles are linked through
vantage-point trees (``simhash``) at ``radius`` differing bits: what two copies
with small changes have in common.  But no radius gives the rule above: at a
similarity of 0.8 two 64-bit SimHashes differ in about 10 bits, give or take 3,
and single pairs in more, where the trees' bounds prune nothing.  All pairs that
the radius misses come from the prefix-filter join of ``set_join``, which loses
none: shingles are ordered by rarity, and two sets that are similar enough share
one among the first few of both.  Every candidate, of either way, is compared in
full: it links by its Jaccard similarity alone.

Scale: equal sets are one class before anything is joined; links are needed for
components only, so what leaves a task is one row by class, never a pair; whole
sets are read again from the texts, for classes with a partner only.

Edge cases: texts without a word are one class; fewer words than a shingle: the
whole sequence is the one shingle; rows are told apart by id and text, so that
null and repeated ids are rows like any other; of rows equal in both one stays;
the row that stays has the smallest id of its class, a null only where all are
null; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, keep_rows, release, row_keys, slices, staged
from .line_join import FACTORS, mixed, rarity_levels, utf8, word_hashes
from .set_join import BUCKETS, cells, compare, fewer_leads, meet, parity
from .simhash import components, link_fingerprints, simhash


def shingles_of(texts: pa.Array, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles, repeated ones included, text by text."""
    data, at = utf8(texts)
    starts, hashes = word_hashes(data, at)
    text = np.searchsorted(at, starts, "right") - 1
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    place, stop = np.arange(len(text)), first[text + 1]
    total = np.zeros(len(text), np.uint64)
    padded = np.concatenate([hashes, np.zeros(shingle, np.uint64)])
    for k in range(shingle):
        total += np.where(place + k < stop, padded[k : k + len(text)] * FACTORS[k], np.uint64(0))
    whole = (place + shingle <= stop) | (place == first[text])
    return text[whole], mixed(total[whole])


def shingle_sets(texts: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    text, found = shingles_of(texts, shingle)
    return [np.unique(x) for x in np.split(found, np.searchsorted(text, np.arange(1, len(texts))))] if len(texts) else []


def least_shared(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def prefixes(rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Per row: its keys, fp (SimHash), class_id, size (of the set), bits (parity bitmap) and prefix (its rarest shingles, as level and 32 bits of the hash)."""
    levels = rows.sparkSession.sparkContext.broadcast(rarity_levels(rows, lambda texts: shingles_of(texts, shingle)[1]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, sizes, bits, firsts = [], [], [], []
            for found in shingle_sets(batch["text"], shingle):
                names.append(int((mixed(found).sum(dtype=np.uint64) ^ np.uint64(len(found) << 40)).view(np.int64)))
                sizes.append(len(found))
                bits.append([int(x[0]) for x in parity(found, np.zeros(1, np.int64))] if len(found) else [0, 0])
                order = (levels.value[(found % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (found >> np.uint64(32))
                firsts.append(np.sort(order)[: len(found) - least_shared(len(found), percent) + 1].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            fps = np.array([simhash(t, shingle) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([*[batch[k] for k in KEYS], pa.array(fps), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array([b[k] for b in bits], pa.int64()) for k in (0, 1)), listed], [*KEYS, "fp", "class_id", "size", "bits", "more_bits", "prefix"])

    return rows.mapInArrow(cut, "no_id boolean, id long, row long, fp long, class_id long, size int, bits long, more_bits long, prefix array<long>")


def whole_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """class_id, KEYS, tokens (binary) of the wanted classes (class_id and the keys of a row), read again from the texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([s.astype("<u8").tobytes() for s in shingle_sets(batch["text"], shingle)], pa.binary())
            yield pa.record_batch([batch["class_id"], *(batch[k] for k in KEYS), sets], ["class_id", *KEYS, "tokens"])

    sets = rows.join(wanted, KEYS).select("class_id", *KEYS, "text").mapInArrow(read, "class_id long, no_id boolean, id long, row long, tokens binary")
    return sets.dropDuplicates(["class_id"])  # rows equal in id and text give one


def near_fingerprints(classes: DataFrame, radius: int) -> DataFrame:
    """class_id, lead: classes whose SimHashes link, each under the other's name; of classes with one SimHash all stand under the smallest."""
    nodes = classes.groupBy("fp").agg(F.min("class_id").alias("first_id"))
    same = classes.select("fp", "class_id").join(nodes, "fp").where("class_id <> first_id").select(F.col("class_id").alias("a"), F.col("first_id").alias("b"))
    pairs = staged(link_fingerprints(staged(nodes.withColumnRenamed("first_id", "id"), "shingle-fingerprints"), radius).union(same), "shingle-simhash", compression="zstd")
    lead = F.least("a", "b").alias("lead")
    return pairs.select(F.col("a").alias("class_id"), lead).union(pairs.select("b", lead)).distinct()


def near_copy_classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: no_id, id, row (see row_keys) and root, which is the same for all rows of a class."""
    percent = round(threshold * 100)
    rows = docs.select(*row_keys(key, text), F.col(text).alias("text"))
    own = staged(prefixes(rows, percent, shingle), "shingle-prefixes", compression="zstd")
    first = own.groupBy("class_id").agg(F.min(F.struct(*KEYS, "fp", "size", "bits", "more_bits", "prefix")).alias("f"))
    classes = staged(first.select("class_id", "f.*"), "shingle-classes", compression="zstd")
    met = meet(classes, percent)
    met = staged(met.union(near_fingerprints(classes, radius)).distinct(), "shingle-met", compression="zstd")
    led = staged(fewer_leads(met), "shingle-leads", compression="zstd")
    release(met)
    wanted = classes.select("class_id", *KEYS, "size").join(led.select("class_id").distinct(), "class_id")
    sets = staged(whole_sets(rows, wanted.drop("size"), shingle), "shingle-sets", compression="zstd")
    members, keys = cells(led.join(wanted.select("class_id", "size"), "class_id"))
    found = compare(members.join(sets, "class_id"), keys, percent, KEYS)
    links = staged(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")), "near-links", compression="zstd")
    release(led, sets, classes)
    root = components(links).withColumnRenamed("id", "class_id")
    return own.select(*KEYS, "class_id").join(root, "class_id", "left").select(*KEYS, F.coalesce("root", "class_id").alias("root"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one row of each class of near copies: the one with the smallest id, then text hash."""
    kept = near_copy_classes(docs, threshold, shingle).groupBy("root").agg(F.min(F.struct(*KEYS)).alias("k")).select("k.*")
    return keep_rows(docs, kept)
