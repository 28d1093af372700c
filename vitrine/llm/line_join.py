"""Line dedup by an exact set-similarity join.

A line is the set of its words (runs without ASCII white space, A-Z
lower-cased).  A line goes if an earlier one (in the order of doc_id, then line)
has a Jaccard similarity of ``threshold`` or more.  Equal sets are one class,
named by 64 bits.  Between classes the join is the prefix-filter one of
``set_join``: tokens are ordered by rarity, two sets that are similar enough
share a token among the first few of both, and only sets that meet there and
pass the length, positional and bitmap filters are compared in full.  None of
the filters can lose a pair: the bitmap holds the parity of the tokens in 128
cells, so that two bitmaps differ in no more bits than two sets do in tokens.
A word is known by 64 bits, computed for all words of a block of bytes at once.

Rarity comes from a count sketch of fixed size: each task counts tokens in
``BUCKETS`` hash buckets, the counts add up in any order.  Any common order
keeps the join exact; a collision only makes a token look less rare.

Scale: no table holds the words of all lines.  Lines and classes carry their
first tokens only, and whole sets are read again from the texts for those
classes that still have a partner.  Classes are pre-aggregated before they are
joined, so a line in a third of all documents is one row.  Pairs are never
written: a class comes out with the number of its links.  The sketch is the
only thing broadcast, of fixed size.

Edge cases: lines without a word are kept and never match; null and empty texts
have no line to lose; repeated rows are copies (the first row's lines stay, and
rows that are equal in id and text are one in the order, so that of their equal
lines one class is the first, and each has the same lines and links); null ids
come first; empty tables give empty results; other columns, whatever their
names, are kept by ``drop_lines``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, staged
from .set_join import BUCKETS, cells, compare, fewer_leads, meet, parity, token_counts

#: Bytes of text hashed together.  A longer word is hashed whole.
BLOCK = 1 << 22
#: Lines sorted together; their number takes the upper 23 bits of a sort key.
LINES_AT_ONCE = 1 << 20
LEVEL_STEPS = 8
NEWLINE = 10
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number; different numbers stay different."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: The share of a byte in a word's hash, before its place is counted in; white space has none.
BYTE_SHARE = np.where(IS_SPACE, 0, mixed(LOWER.astype(np.uint64) + np.uint64(1))).astype(np.uint64)


def place_factors(n: int) -> np.ndarray:
    return mixed(np.arange(1 << 20, (1 << 20) + n, dtype=np.uint64)) | np.uint64(1)


FACTORS = place_factors(1 << 12)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends); a null is empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, cuts: np.ndarray, share: np.ndarray = BYTE_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its 64 bits.  No word reaches over one of the cuts (ascending); bytes without a share part words."""
    starts, hashes, low, outside = [], [], 0, share == 0
    while low < len(data):
        high = low + BLOCK
        while high < len(data):  # a block ends after a byte outside words
            if len(spaces := np.flatnonzero(outside[data[high : high + BLOCK]])):
                high += int(spaces[0]) + 1
                break
            high += BLOCK
        part = data[low:high]
        inside = ~outside[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        inner = cuts[np.searchsorted(cuts, low) : np.searchsorted(cuts, low + len(part))] - low
        first[inner] = inside[inner]
        begin = np.flatnonzero(first)
        if len(begin):
            length = np.diff(np.append(begin, len(part)))
            factors = FACTORS if length.max() <= len(FACTORS) else place_factors(int(length.max()))
            place = np.arange(begin[0], len(part)) - np.repeat(begin, length)
            starts.append(begin + low)
            hashes.append(mixed(np.add.reduceat(share[part[begin[0] :]] * factors[place], begin - begin[0])))
        low += len(part)
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.uint64), *hashes])


def line_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, line number, size, distinct tokens of all lines one after the other) for all lines with a word, in blocks."""
    data, at = utf8(texts)
    starts, hashes = word_hashes(data, at)
    ends = np.flatnonzero(data == NEWLINE)
    text = np.searchsorted(at, starts, "right") - 1
    before = np.searchsorted(ends, starts)  # newlines before a word, those of earlier texts included
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (before[1:] != before[:-1])
    begin = np.flatnonzero(fresh)
    number = (before - np.searchsorted(ends, at[text]))[begin].astype(np.int32)
    for k in range(0, len(begin), LINES_AT_ONCE):
        lines = begin[k : k + LINES_AT_ONCE]
        stop = begin[k + LINES_AT_ONCE] if k + LINES_AT_ONCE < len(begin) else len(starts)
        found = hashes[lines[0] : stop]
        line = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.append(lines, stop)))
        order = np.argsort((line << np.uint64(41)) | (found >> np.uint64(23)), kind="stable")
        found, line = found[order], line[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (line[1:] != line[:-1])
        yield text[lines], number[k : k + LINES_AT_ONCE], np.bincount(line[new].astype(np.int64), minlength=len(lines)), found[new]


def rarity_levels(rows: DataFrame, tokens: Callable[[pa.Array], np.ndarray] = lambda texts: word_hashes(*utf8(texts))[1]) -> np.ndarray:
    """Per bucket of tokens, the logarithm of how often one occurs."""
    return np.minimum(LEVEL_STEPS * np.log2(np.maximum(token_counts(rows, "text", tokens), 1)), 255).astype(np.uint8)


#: The columns that order lines.
ORDER = ["has_id", "id", "row", "line"]


def doc_keys(key: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns without nulls that tell documents apart by id and text, in the order of documents: null ids come first."""
    given = F.col(key).cast("long")
    return [given.isNotNull().alias("has_id"), F.coalesce(given, F.lit(0)).alias("id"), F.xxhash64(text).alias("row")]


def first_tokens(rows: DataFrame, percent: int) -> DataFrame:
    """Every line with a word: has_id, id, row, line, class_id, size, bits and more_bits (parity bitmap), prefix (its first tokens by rarity)."""
    levels = rows.sparkSession.sparkContext.broadcast(rarity_levels(rows))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = levels.value
        for batch in slices(batches):
            for at, line, size, found in line_sets(batch["text"]):
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                name = np.add.reduceat(found, start) ^ (size.astype(np.uint64) << np.uint64(48))
                # a token as it stands in prefixes: its rarity level, then 32 bits of its hash
                order = (level_of[(found % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (found >> np.uint64(32))
                order = np.sort((np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(40)) | order) & np.uint64((1 << 40) - 1)
                taken = size - (-(-size * percent // 100)) + 1  # of so many first tokens, similar sets share one
                ends = np.cumsum(taken)
                prefix = order[np.repeat(start - (ends - taken), taken) + np.arange(ends[-1])]
                own = pa.array(at)
                columns = [*(batch[c].take(own) for c in ORDER[:3]), pa.array(line), pa.array(name.view(np.int64)), pa.array(size.astype(np.int32)), *map(pa.array, parity(found, start))]
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(prefix.view(np.int64))))
                yield pa.record_batch(columns, [*ORDER, "class_id", "size", "bits", "more_bits", "prefix"])

    return rows.mapInArrow(split, "has_id boolean, id long, row long, line int, class_id long, size int, bits long, more_bits long, prefix array<long>")


def whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """class_id, the columns of ORDER, tokens and size (their number) of the wanted classes (class_id, first), read again from the texts that hold their first lines."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, line, name, lines = [], [], [], []
            for i, (t, picked) in enumerate(zip(batch["text"].to_pylist(), batch["picked"].to_pylist(), strict=True)):
                own = t.split("\n")
                for p in picked:
                    text.append(i)
                    line.append(p["line"])
                    name.append(p["class_id"])
                    lines.append(own[p["line"]])
            sets = [np.zeros(0, np.uint64)]
            for _, _, size, found in line_sets(pa.array(["\n".join(lines)], pa.large_string())):
                sets += np.split(found, np.cumsum(size)[:-1])
            at = pa.array(text, pa.int64())
            yield pa.record_batch([pa.array(name, pa.int64()), *(batch[c].take(at) for c in ORDER[:3]), pa.array(line, pa.int32()), pa.array([x.astype("<u8").tobytes() for x in sets[1:]], pa.binary()), pa.array([len(x) for x in sets[1:]], pa.int32())], ["class_id", *ORDER, "tokens", "size"])

    of_text = [F.col(f"first.{c}").alias(c) for c in ORDER[:3]]
    by_text = wanted.groupBy(*of_text).agg(F.collect_list(F.struct("class_id", F.col("first.line").alias("line"))).alias("picked"))
    # texts are not sorted to be joined
    sets = rows.join(by_text.hint("shuffle_hash"), ORDER[:3]).mapInArrow(pick, "class_id long, has_id boolean, id long, row long, line int, tokens binary, size int")
    return sets.dropDuplicates(["class_id"])  # rows that are equal in id and text give their sets once


def similar_lines(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line with a word: has_id, id, row, line, class_id, links (of its class to other classes), removed."""
    percent = round(threshold * 100)
    rows = docs.select(*doc_keys(key, text), F.col(text).alias("text"))
    split = staged(first_tokens(rows, percent), "line-tokens", compression="zstd")
    best = split.groupBy("class_id").agg(F.min(F.struct(*ORDER, "size", "bits", "more_bits", "prefix")).alias("best"))
    classes = staged(best.select("class_id", F.struct(*(f"best.{c}" for c in ORDER)).alias("first"), "best.size", "best.bits", "best.more_bits", "best.prefix"), "line-prefixes", compression="zstd")
    lines = staged(split.select(*ORDER, "class_id"), "lines", compression="zstd")
    release(split)

    led = staged(meet(classes, percent), "line-met", compression="zstd")
    firsts = staged(classes.select("class_id", "first"), "line-classes", compression="zstd")
    release(classes)
    led, met = staged(fewer_leads(led), "line-leads", compression="zstd"), led
    release(met)
    wanted = firsts.join(led.select("class_id").distinct(), "class_id")
    sets = staged(whole_sets(rows, wanted), "line-sets", compression="zstd")
    members, keys = cells(led.join(sets.select("class_id", "size"), "class_id"))
    found = compare(members.join(sets.drop("size"), "class_id"), keys, percent, ORDER).groupBy("class_id").agg(F.sum("links").alias("links"), F.max("late").alias("late"))
    found = staged(found, "line-links", compression="zstd")
    release(led, sets)
    known = staged(firsts.select("class_id", "first").join(found, "class_id", "left"), "line-verdicts", compression="zstd")
    release(firsts, found)
    removed = ~F.struct(*ORDER).eqNullSafe(F.col("first")) | F.coalesce("late", F.lit(False))
    return lines.select(*ORDER, "class_id").join(known, "class_id").select(*ORDER, "class_id", F.coalesce("links", F.lit(0)).alias("links"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: has_id, id, row (see doc_keys) and lines, those with a word: array of (line, class_id, links, removed), ascending."""
    lines = similar_lines(docs, threshold, key, text)
    by = lines.groupBy(*ORDER[:3]).agg(F.array_sort(F.collect_set(F.struct("line", "class_id", "links", "removed"))).alias("lines"))
    joined = docs.select(*doc_keys(key, text)).join(by, ORDER[:3], "left")
    return joined.withColumn("lines", F.coalesce("lines", F.array().cast(by.schema["lines"].dataType)))


def drop_lines(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed lines cut from text; null texts stay null."""
    found = dedup_lines(docs, threshold, key, text).dropDuplicates(ORDER[:3])
    cut = F.transform(F.filter("lines", lambda x: x["removed"]), lambda x: x["line"])
    joined = docs.select(F.struct(*docs.columns).alias("doc"), *doc_keys(key, text)).join(found.select(*ORDER[:3], cut.alias("cut")), ORDER[:3])
    kept = F.array_join(F.filter(F.split(f"doc.{text}", "\n", -1), lambda x, i: ~F.array_contains(F.col("cut"), i)), "\n")
    return joined.select(*[(kept if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
