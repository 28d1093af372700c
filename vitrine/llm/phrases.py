"""Phrase collocation mining by Rabin-Karp fingerprints.

A phrase of up to four words is counted by its fingerprint: numpy prefix
polynomials over a batch's bytes give every word's, prefix polynomials over
these every n-gram's (``word_arrays``).  One level follows another.  Words are
counted first, then pairs of frequent words, then triples and quadruples whose
pairs are all frequent, since no part of a frequent phrase is rarer than the
phrase; of the words only those of frequent pairs are wanted from then on.  What is frequent is known to the tasks by a bit array of fixed size; a
bit that is set by chance only lets something pass that a later count drops.

Fingerprints can't tell for sure that two phrases are equal.  So the last pass
reads the text at every occurrence of a frequent fingerprint: words get exact
numbers (equal fingerprints, then equal bytes, else numbers by text), n-grams
are grouped by their words' numbers, and only these phrases become text, each
with its count and a pointer to an occurrence (document and byte).  The
final counts are by text.

Scale: each pass reads the texts where they are.  What is shuffled is (language
and phrase in one fingerprint, count), first summed in the map tasks; a
language or phrase with a third of all rows is one row for each task.  The bit
array (2**27 bits, 16 MB) and the slices of text are of fixed size, whatever the
input: fuller bits let more n-grams through to the shuffle, never a
different result.  Scores and drops join rows of frequent phrases only.  The
first rows of each language are cut in salted parts before they meet.

Edge cases: null texts are empty; a null language is ``und``; texts and words
of any length are read whole; repeated rows count each; null and repeated ids
only matter for the pointer; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged
from .word_arrays import by_bytes, byte_hashes, mixed, runs, sequence_hashes, text_bytes

LONGEST, LEAST, KEEP, COVER = 4, 30, 2000, 80
BITS = 27
#: Phrases that become text at once.
PHRASES_AT_ONCE = 200_000
SALTS = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 within a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Words:
    """The words of a batch: bytes, spans, fingerprints, languages, and how many words of the piece follow each."""

    def __init__(self, batch: pa.RecordBatch):
        raw, offsets = text_bytes(batch.column("text"))
        self.raw, kind = LOWER[raw], KIND[raw]
        self.starts, self.stops = runs(kind == 0, offsets)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.offsets = offsets
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = codes[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        self.hashes = byte_hashes(self.raw, self.starts, self.stops)
        # a piece ends at a document's end and where a byte of kind 2 stands between two words
        ends = np.concatenate(([0], np.cumsum(kind == 2, dtype=np.int64)))
        piece = ends[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        last = np.ones(len(self.starts), bool)
        last[:-1] = (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(last)
        self.left = at[np.searchsorted(at, np.arange(len(last)))] - np.arange(len(last)) if len(at) else np.zeros(0, np.int64)
        self.salt = np.array([lang_salt(x) for x in self.langs] or [0], np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which n words of one piece stand, and fingerprints of (language, n, words)."""
        at = np.flatnonzero(self.left >= n - 1)
        found = (sequence_hashes(self.hashes, n) if n > 1 else self.hashes)[at]
        return at, mixed(mixed(found + np.uint64(n)) ^ self.salt[self.lang[at]])


def lang_salt(lang: str) -> int:
    data = np.frombuffer(lang.encode("utf-8", "replace"), np.uint8)
    return int(mixed(byte_hashes(data, np.array([0]), np.array([len(data)])))[0]) if len(data) else 0


class Frequent:
    """The bit array: whether a fingerprint may be among the frequent ones."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(1 << BITS - 6, np.uint64)
        self.words[slots] = bits

    def __call__(self, fingerprints: np.ndarray) -> np.ndarray:
        place = fingerprints & np.uint64((1 << BITS) - 1)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def may_be_frequent(words: Words, n: int, known: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints of n-grams all of whose parts of the level below (words for pairs, else pairs) pass."""
    at, found = words.grams(n)
    part = min(2, n - 1)
    places, below = words.grams(part)
    ok = np.zeros(len(words.starts) + 1, bool)
    ok[places] = known(below)
    keep = np.ones(len(at), bool)
    for k in range(n - part + 1):
        keep &= ok[at + k]
    return at[keep], found[keep]


def words_of_pairs(words: Words, known: Frequent) -> np.ndarray:
    """Fingerprints of the words that stand in pairs that pass."""
    at, pairs = words.grams(2)
    at = at[known(pairs)]
    return np.unique(words.grams(1)[1][np.union1d(at, at + 1)])


def read(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text"))


def count_fingerprints(docs: DataFrame, sizes: tuple[int, ...], least: int, known: Broadcast | None) -> DataFrame:
    """fp, count of the n-grams of these sizes that occur at least so often; with the longest, also the words of frequent pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = Words(batch)
            for n in sizes:
                found = words.grams(n)[1] if known is None else may_be_frequent(words, n, known.value)[1]
                fps, counts = np.unique(found, return_counts=True)
                yield pa.record_batch({"fp": fps.view(np.int64), "count": counts.astype(np.int64)})
            if max(sizes) == LONGEST:  # words of frequent pairs are wanted, whatever their number
                fps = words_of_pairs(words, known.value)
                yield pa.record_batch({"fp": fps.view(np.int64), "count": np.full(len(fps), least, np.int64)})

    found = read(docs).mapInArrow(count, "fp long, count long")
    return found.groupBy("fp").agg(F.sum("count").alias("count")).where(F.col("count") >= least)


def bit_array(frequent: DataFrame) -> Frequent:
    """The bit array of the fingerprints; its 64-bit words, 2**21 at most, are put together in the tasks."""
    place = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1))
    slots = frequent.select((F.shiftright(place, 6)).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("bit"))
    got = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    return Frequent(got["slot"].to_numpy(), got["bits"].to_numpy().view(np.uint64))


def exact_words(words: Words) -> np.ndarray:
    """A number for each word, equal exactly where the bytes are."""
    _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    number = number.astype(np.int64)
    like = first[number]
    size = words.stops - words.starts
    odd = size != size[like]
    check = np.flatnonzero(~odd & (like != np.arange(len(like))))
    for at in range(0, len(check), 1 << 18):
        some = check[at : at + (1 << 18)]
        n = size[some]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = words.raw[np.repeat(words.starts[some], n) + inner] != words.raw[np.repeat(words.starts[like[some]], n) + inner]
        odd[some] = np.add.reduceat(differs, np.cumsum(n) - n) > 0
    texts: dict[bytes, int] = {}
    for w in np.flatnonzero(odd):  # equal fingerprints of different words
        text = words.raw[words.starts[w] : words.stops[w]].tobytes()
        number[w] = texts.setdefault(text, len(first) + len(texts))
    return number


def first_and_count(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index and size of each group, and each entry's first."""
    _, first, own, counts = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    return first, counts, first[own]


def phrases_of(words: Words, known: Frequent) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: first places of the phrases that pass in this batch, and their counts; told apart by their words."""
    number = exact_words(words)
    for n in range(1, LONGEST + 1):
        at, found = words.grams(n)
        pass_ = known(found)
        at, found = at[pass_], found[pass_]
        first, counts, like = first_and_count(found)
        differs = words.lang[at] != words.lang[at[like]]
        for k in range(n):
            differs |= number[at + k] != number[at[like] + k]
        if differs.any():  # equal fingerprints of different phrases: group by the words' numbers, pair by pair
            group = words.lang[at]
            for k in range(n):
                group = np.unique(group * (number.max() + 1) + number[at + k], return_inverse=True)[1].astype(np.int64)
            first, counts, _ = first_and_count(group)
        yield n, at[first], counts


def phrase_texts(words: Words, places: np.ndarray, n: int) -> pa.Array:
    """The n words from each place on, joined by spaces, put together from the bytes at once."""
    word = (places[:, None] + np.arange(n)).ravel()
    size = words.stops[word] - words.starts[word] + 1  # with a space behind
    ends = np.cumsum(size)
    source = np.repeat(words.starts[word] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    data = words.raw[np.minimum(source, len(words.raw) - 1)]
    data[ends - 1] = 32
    keep = np.ones(len(data), bool)
    keep[ends[n - 1 :: n] - 1] = False
    offsets = np.concatenate(([0], ends[n - 1 :: n] - np.arange(1, len(places) + 1)))
    return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])).cast(pa.string())


def slice_table(batch: pa.RecordBatch, known: Frequent) -> pa.Table:
    """lang, k, phrase, f, doc_id, byte of a batch's phrases; k 0: all words of the language."""
    words, names = Words(batch), ["lang", "k", "phrase", "f", "doc_id", "byte"]
    langs = pa.array(words.langs, pa.string())
    nulls = pa.nulls(len(langs), pa.int64())
    totals = np.bincount(words.lang, minlength=len(langs)).astype(np.int64)
    parts = [pa.table([langs, pa.array(np.zeros(len(langs), np.int32)), pa.nulls(len(langs), pa.string()), pa.array(totals), nulls, nulls], names)]
    ids = batch.column("doc_id").cast(pa.int64())
    for n, places, counts in phrases_of(words, known):
        for low in range(0, len(places), PHRASES_AT_ONCE):
            at = places[low : low + PHRASES_AT_ONCE]
            doc = words.doc[at]
            byte = pa.array(words.starts[at] - words.offsets[doc])
            parts.append(pa.table([langs.take(pa.array(words.lang[at])), pa.array(np.full(len(at), n, np.int32)), phrase_texts(words, at, n), pa.array(counts[low : low + PHRASES_AT_ONCE].astype(np.int64)), ids.take(pa.array(doc)), byte], names))
    return pa.concat_tables(parts)


def count_phrases(docs: DataFrame, known: Broadcast, least: int) -> DataFrame:
    """lang, k, phrase, f, doc_id, byte of the frequent phrases; k 0, phrase null: all words of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield from slice_table(batch, known.value).to_batches()

    found = read(docs).mapInArrow(count, "lang string, k int, phrase string, f long, doc_id long, byte long")
    found = found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"), F.first("doc_id").alias("doc_id"), F.first("byte").alias("byte"))  # both of one row
    return found.where((F.col("f") >= least) | (F.col("k") == 0))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, k, phrase, f, doc_id, byte of all phrases of two to four words with f >= least, of their words, and the languages' totals (k 0); staged."""
    spark = docs.sparkSession
    words = staged(count_fingerprints(docs, (1,), least, None), "frequent-words")
    known = spark.sparkContext.broadcast(bit_array(words))
    pairs = staged(count_fingerprints(docs, (2,), least, known), "frequent-pairs")
    known.unpersist()
    known = spark.sparkContext.broadcast(bit_array(pairs))
    longer = staged(count_fingerprints(docs, tuple(range(3, LONGEST + 1)), least, known), "frequent-longer")
    known.unpersist()
    known = spark.sparkContext.broadcast(bit_array(pairs.unionByName(longer)))
    out = staged(count_phrases(docs, known, least), "frequent-phrases")
    known.unpersist()
    release(words, pairs, longer)
    return out


def words_of(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (two words or more) with a, l, r and score of their lowest-scoring cut."""
    parts = phrases.where("k > 0").select(F.col("lang").alias("p_lang"), F.col("phrase").alias("part"), F.col("f").alias("p_f"))
    cuts = phrases.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), "doc_id", "byte", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    w = words_of()
    cuts = cuts.withColumn("head", F.array_join(F.slice(w, F.lit(1), F.col("cut")), " ")).withColumn("rest", F.array_join(F.slice(w, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
    for column, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(parts.withColumnRenamed("p_f", name), (F.col("lang") == F.col("p_lang")) & (F.col(column) == F.col("part"))).drop("p_lang", "part", column)
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(2000000 as {wide}) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")
    return cuts.groupBy("lang", "k", "phrase", "a", "doc_id", "byte").agg(lowest).select("lang", "k", "phrase", "a", "doc_id", "byte", "low.l", "low.r", "low.score")


def covered(phrases: DataFrame, percent: int = COVER) -> DataFrame:
    """lang, phrase of candidates that stand inside a longer candidate with at least that part of their count."""
    longer = phrases.where("k > 2").select("lang", "k", F.col("f").alias("longer"), words_of().alias("w"))
    size = F.explode(F.sequence(F.lit(2), F.col("k") - 1))
    inner = longer.select("*", size.alias("size")).select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", "longer", F.array_join(F.expr("slice(w, at, size)"), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = "decimal(38,0)"
    enough = F.col("longer").cast(wide) * 100 >= F.col("f").cast(wide) * percent
    return inner.join(phrases.where("k > 1").select("lang", "phrase", "f"), ["lang", "phrase"]).where(enough).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, keep: int = KEEP, percent: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, doc_id, byte: each language's best phrases of two to four words."""
    phrases = frequent_phrases(docs, least)
    found = scored(phrases).join(covered(phrases, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    found = found.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= keep)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    totals = phrases.where("k = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    found = found.join(totals, F.col("lang") == F.col("n_lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "byte")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
seqs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM seqs, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
freq AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM freq WHERE k > 1)),
scores AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
           FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.head JOIN freq y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM lowest s JOIN
           (SELECT lang, f, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
            FROM (SELECT *, unnest(range(2, k)) AS size FROM freq WHERE k > 2)) b ON b.lang = s.lang AND b.phrase = s.phrase WHERE 100 * b.f >= 80 * s.a),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM lowest s ANTI JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
