"""Token ids in binary shards with a minimal perfect hash index.

``encode_texts`` turns texts into ids with a public tokenizer; ``write_store``
writes them in ascending key order; ``read_store`` and ``lookup`` read them.

File format.  A store is a folder of Spark-written Parquet files without
compression, so that it lives on any file system Spark can write to, is
committed atomically and survives lost tasks.  Each row is one shard:

* ``part``, ``seq``: the shard's place; shards in this order hold ascending keys;
* ``part_base``: ids before it in its part; ``first_key``, ``last_key``;
* ``keys``: the rows' keys, int64 little-endian; ``null_keys`` rows at the front have a null key;
* ``payload``: raw ids, little-endian, two bytes each if the vocabulary fits, else four (``width``);
* ``offsets``: uint32, row r has ids offsets[r] to offsets[r+1];
* ``seeds``, ``slots``, ``prints``: a minimal perfect hash (hash and displace) of
  the shard's keys: a key's bucket gives a seed, the seed gives its slot, the
  slot holds the key's first row and a 16-bit fingerprint.

The folder ``_index`` in the store is the store-wide index: keys are dealt by a
hash to parts of about ``INDEX_KEYS`` keys, each a minimal perfect hash of its
keys, whose slots hold a 32-bit fingerprint and the key's places (part, seq, first
row, rows) in the shards.  A foreign key is told by its fingerprint before any
shard is read, up to one in four billion, which the shard's own keys tell.
``lookup`` takes a table of keys through the index to the shards in two joins;
access to a key takes constant time.

Scale: one range shuffle of the texts, after which every task encodes and
writes its own key range; shards close at ``SHARD_IDS`` ids.  Global offsets
need one row per task on the driver.  The shards' hashes are built with them; the
store-wide index takes one shuffle of (key, place) rows, one for each key of a
shard.

Edge cases: a null text is encoded as empty (only the end id); null keys come
first and are found by a null key; rows that share a key stay neighbours, and a
lookup returns all of them; an empty table gives an empty store; texts that the
word memory can't take, and all texts of other tokenizers, go through the library
whole.  Special
strings of the tokenizer inside a text are encoded as the library does.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_folder, slices, staged

SHARD_IDS = 1_000_000
SHARD_SCHEMA = (
    "part int, seq int, part_base long, first_key long, last_key long, n_docs int, n_ids long, null_keys int, width int, "
    "keys binary, offsets binary, seeds binary, slots binary, prints binary, payload binary"
)
#: Words remembered by an encoder before it forgets all.
WORD_CACHE = 700_000
#: Keys in a part of the store-wide index, about.
INDEX_KEYS = 200_000
INDEX_SCHEMA = "part_of_index int, seeds binary, prints binary, ends binary, places binary"
#: A list of asked keys is broadcast up to so many shards, and joined beyond it.
MOST_BROADCAST = 10_000


# ---------------------------------------------------------------- encoding


class Encoder:
    """The tokenizers library behind a memory of words.

    With a tokenizer file that normalises and splits as ``APART`` says, in texts
    below U+0250 without special strings, normalisation is lower-casing and no
    piece spans white space, so a word's ids don't depend on its neighbours: each
    distinct word is encoded once by the library's model.  All other texts, and
    all texts of other tokenizers, go through the library whole.
    """

    #: What a tokenizer file must say for words to be encoded apart.
    APART = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    )

    #: Pieces as the tokenizer's own pre-tokenizer splits them, for characters below U+0250.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+")
    ODD = re.compile(r"[İɐ-\U0010ffff]")
    SEPARATORS = "\x1c\x1d\x1e\x1f\x85"  # white space to Python alone, or to the tokenizer alone

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        said = json.loads(self.whole.to_str())
        special = [t["content"] for t in said["added_tokens"]]
        self.apart = (said["normalizer"], said["pre_tokenizer"]) == self.APART and said["truncation"] is None and all("oftext|>" in t for t in special)
        self.wide = self.whole.get_vocab_size() > 65_536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= WORD_CACHE:
                self.pieces.clear()
            mapped = piece if piece.isascii() and piece.isalnum() else "".join(map(self.byte_chars.__getitem__, piece.encode()))
            got = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()
        return got

    def word(self, word: str) -> bytes:
        if len(self.words) >= WORD_CACHE:
            self.words.clear()
        got = self.words[word] = b"".join(map(self.piece, self.PIECES.findall(word)))
        return got

    def __call__(self, text: str | None) -> bytes:
        """The text's ids as little-endian integers of the store's width."""
        if not text:
            return b""
        if not self.apart or "oftext|>" in text or any(map(text.__contains__, self.SEPARATORS)) or not text.isascii() and self.ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        words = text.lower().split()
        got = list(map(self.words.get, words))
        if None in got:
            got = [self.word(w) if g is None else g for w, g in zip(words, got, strict=True)]
        return b"".join(got)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker; its memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ------------------------------------------------- minimal perfect hashing

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit hash of int64 keys under a seed (or seeds)."""
    x = keys.astype(np.int64).view(np.uint64) + (np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1)) * _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds per bucket and each key's slot, for distinct keys: n keys take exactly the slots 0..n-1."""
    n = len(keys)
    buckets = max(1, (n + 3) // 4)
    own = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    seeds, slot, taken = np.zeros(buckets, "<u4"), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(buckets + 1))
    size = np.diff(edges)
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        rows = order[edges[b] : edges[b + 1]]
        seed = 1
        while True:
            trial = np.arange(seed, seed + 32, dtype=np.uint64)[:, None]
            places = (mix(keys[rows][None, :], trial) % np.uint64(n)).astype(np.int64)
            fits = ~taken[places].any(axis=1)
            if len(rows) > 1:
                ordered = np.sort(places, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                k = int(fits.argmax())
                seeds[b], slot[rows] = seed + k, places[k]
                taken[places[k]] = True
                break
            seed += 32
    return seeds, slot


class Shard:
    """One shard, read."""

    def __init__(self, row: dict):
        self.null_keys = row["null_keys"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.offsets = np.frombuffer(row["offsets"], "<u4")
        self.ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
        self.seeds, self.slots, self.prints = (np.frombuffer(row[c], d) for c, d in (("seeds", "<u4"), ("slots", "<u4"), ("prints", "<u2")))

    def rows_of_all(self) -> np.ndarray:
        """For each row with a key, in order, the first row that the index gives for its key: all at once."""
        keys = self.keys[self.null_keys :]
        if not len(keys):
            return np.zeros(0, np.int64)
        seed = self.seeds[(mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = (mix(keys, seed) % np.uint64(len(self.slots))).astype(np.int64)
        if (self.prints[slot] != (mix(keys, 7) >> np.uint64(48)).astype(np.uint16)).any():
            raise ValueError("a stored fingerprint doesn't fit its key")
        return self.slots[slot].astype(np.int64)

    def row(self, r: int) -> np.ndarray:
        return self.ids[self.offsets[r] : self.offsets[r + 1]]


def pack(part: int, seq: int, part_base: int, keys: list, parts: list[bytes], dtype: np.dtype) -> dict:
    """A shard's row from its documents' keys (nulls first, ascending) and ids."""
    nulls = sum(k is None for k in keys)
    given = np.array([0 if k is None else k for k in keys], "<i8")
    sizes = np.array([len(p) // dtype.itemsize for p in parts], np.int64)
    distinct, first = np.unique(given[nulls:], return_index=True)
    seeds, slot = build_mph(distinct) if len(distinct) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
    slots, prints = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u2")
    slots[slot] = first + nulls
    prints[slot] = (mix(distinct, 7) >> np.uint64(48)).astype(np.uint16)
    real = [k for k in keys if k is not None]
    return {
        "part": part, "seq": seq, "part_base": part_base, "first_key": real[0] if real else None, "last_key": real[-1] if real else None,
        "n_docs": len(keys), "n_ids": int(sizes.sum()), "null_keys": nulls, "width": dtype.itemsize, "keys": given.tobytes(),
        "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype("<u4").tobytes(), "seeds": seeds.tobytes(), "slots": slots.tobytes(),
        "prints": prints.tobytes(), "payload": b"".join(parts),
    }


# ------------------------------------------------------------ write and read


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", tasks: int | None = None) -> None:
    """Encode all texts, append end_id to each, and write shards in ascending key order to path."""
    spark = docs.sparkSession
    spark_schema = spark.createDataFrame([], SHARD_SCHEMA).schema

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        keys, parts, size, base = [], [], 0, 0
        names = spark_schema.names

        def closed() -> pa.RecordBatch:
            row = pack(part, seq, base, keys, parts, enc.dtype)
            types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
            return pa.record_batch([pa.array([row[f.name]], types[f.dataType.simpleString()]) for f in spark_schema], names)

        for batch in slices(batches):
            for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = enc(t) + end
                keys.append(k)
                parts.append(ids)
                size += len(ids) // enc.dtype.itemsize
                if size >= SHARD_IDS:
                    yield closed()
                    keys, parts, size, seq, base = [], [], 0, seq + 1, base + size
        if keys:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # rows that share a key (all null ones, say) are many tasks' work: the text's hash and a number of the row part them
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tasks or partitions(spark), *order).sortWithinPartitions(*order).select("key", "text")
    written = ordered.mapInArrow(shards, SHARD_SCHEMA)
    written.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    write_index(spark, path)


def store_shards(spark: SparkSession, path: str) -> DataFrame:
    """The store's shards with their base, the number of ids in all shards before."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row for each writing task
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    bases = F.broadcast(spark.createDataFrame(rows, "of_part int, ahead long"))
    return shards.join(bases, F.col("part") == F.col("of_part")).withColumn("base", F.col("part_base") + F.col("ahead")).drop("of_part", "ahead")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the store, through its index: key, start, n_tokens, ids_crc32 (of the ids as uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for row in batch.to_pylist():
                shard = Shard(row)
                first = np.concatenate([np.zeros(shard.null_keys, np.int64), shard.rows_of_all()])
                # rows that share a key follow the one that the index gives
                at = np.arange(len(shard.keys))
                run = np.concatenate([np.arange(shard.null_keys), at[shard.null_keys :] - first[shard.null_keys :]]) if len(at) else at
                place = first + run
                offsets, ids = shard.offsets.astype(np.int64), shard.ids.astype("<u4")
                start, stop = offsets[place], offsets[place + 1]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                keys = pa.array(shard.keys, mask=np.arange(len(shard.keys)) < shard.null_keys)
                yield pa.record_batch([keys, pa.array(start + row["base"]), pa.array(stop - start), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return store_shards(spark, path).mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def index_part(parts: int) -> Column:
    """The part of the index that a key belongs to; null keys have one of their own."""
    return F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(parts))).cast("int")


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 13) >> np.uint64(32)).astype("<u4")


def write_index(spark: SparkSession, path: str) -> None:
    """Write the store-wide index of a written store."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    n = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                keys, nulls = np.frombuffer(row["keys"], "<i8"), row["null_keys"]
                own, first, times = np.unique(keys[nulls:], return_index=True, return_counts=True)
                key = pa.concat_arrays([pa.nulls(min(nulls, 1), pa.int64()), pa.array(own)])
                first, times = (np.concatenate([x[: min(nulls, 1)], y]).astype(np.int32) for x, y in ((np.array([0]), first + nulls), (np.array([nulls]), times)))
                at = [pa.array(np.full(len(first), row[c], np.int32)) for c in ("part", "seq")]
                yield pa.record_batch([key, *at, pa.array(first), pa.array(times)], ["key", "part", "seq", "row", "n_rows"])

    def hashed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("part", "ascending"), ("seq", "ascending")])
        keys = rows["key"].fill_null(0).to_numpy()
        own, first = np.unique(keys, return_index=True)
        seeds, slot = build_mph(own)
        by_slot = np.argsort(slot)
        count = np.diff(np.append(first, len(keys)))[by_slot]
        order = np.repeat(first[by_slot], count) + np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
        listed = np.stack([rows[c].to_numpy() for c in ("part", "seq", "row", "n_rows")], axis=1)[order]
        row = [seeds, prints_of(own[by_slot]), np.cumsum(count).astype("<u4"), listed.astype("<i4")]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], ["part_of_index", "seeds", "prints", "ends", "places"])

    rows = shards.select("part", "seq", "keys", "null_keys").mapInArrow(places, "key long, part int, seq int, row int, n_rows int")
    rows = rows.withColumn("part_of_index", index_part(max(1, -(-n // INDEX_KEYS))))
    built = rows.groupBy("part_of_index").applyInArrow(hashed, INDEX_SCHEMA)
    built.withColumn("parts", F.lit(max(1, -(-n // INDEX_KEYS)))).write.option("compression", "none").parquet(f"{path}/_index")


def find_places(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """key, part, seq, row, n_rows: where the keys (column key, each taken once) stand, by the store-wide index alone."""
    index = spark.read.schema(f"{INDEX_SCHEMA}, parts int").parquet(f"{path}/_index")
    parts = index.agg(F.max("parts")).first()[0] or 1

    def probe(key: tuple, asked: pa.Table, index: pa.Table) -> pa.Table:
        given, names = asked["key"].combine_chunks(), ["key", "part", "seq", "row", "n_rows"]
        if not index.num_rows or not len(given):
            return pa.table([pa.nulls(0, pa.int64()), *[pa.nulls(0, pa.int32())] * 4], names)
        row = index.to_pylist()[0]
        seeds, prints, ends = (np.frombuffer(row[c], "<u4") for c in ("seeds", "prints", "ends"))
        keys = given.fill_null(0).to_numpy()
        seed = seeds[(mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)]
        slot = (mix(keys, seed) % np.uint64(len(ends))).astype(np.int64)
        known = np.flatnonzero(prints[slot] == prints_of(keys))
        first = np.concatenate([[0], ends]).astype(np.int64)
        count = (first[slot + 1] - first[slot])[known]
        at = np.repeat(first[slot[known]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found = np.frombuffer(row["places"], "<i4").reshape(-1, 4)[at]
        return pa.table([given.take(pa.array(np.repeat(known, count))), *(pa.array(found[:, c]) for c in range(4))], names)

    asked = keys.select(F.col("key").cast("long").alias("key")).distinct().withColumn("part_of_index", index_part(parts))
    return asked.groupBy("part_of_index").cogroup(index.groupBy("part_of_index")).applyInArrow(probe, "key long, part int, seq int, row int, n_rows int")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """key, nth (of the rows that share it), ids: the documents of the asked keys (column key), read from the raw payloads."""
    places = find_places(spark, path, keys).groupBy("part", "seq").agg(F.collect_list(F.struct("key", "row", "n_rows")).alias("asked"))
    places = staged(places, "asked-places")
    few = places.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).join(F.broadcast(places) if few else places, ["part", "seq"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for row in batch.to_pylist():
                shard = Shard(row)
                asked = [(p["key"], r) for p in row["asked"] for r in range(p["row"], p["row"] + p["n_rows"])]
                asked = [(k, r) for k, r in asked if (r < shard.null_keys if k is None else shard.keys[r] == k)]  # a foreign key may share a fingerprint
                ids = pa.array([shard.row(r).astype(np.int64) for _, r in asked], pa.list_(pa.int64()))
                at = [pa.array([row[c]] * len(asked), pa.int32()) for c in ("part", "seq")]
                yield pa.record_batch([pa.array([k for k, _ in asked], pa.int64()), *at, pa.array([r for _, r in asked], pa.int32()), ids], ["key", "part", "seq", "row", "ids"])

    found = shards.mapInArrow(read, "key long, part int, seq int, row int, ids array<long>")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("part", "seq", "row"))
    return found.select("key", nth.alias("nth"), "ids")


def new_store_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
