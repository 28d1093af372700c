"""Statistics of whole texts as one numpy row each, computed for a batch at a time from its bytes.

Nothing but the text enters.  Lengths are in bytes of UTF-8; shares are of the
count they are named after, and 0 where that count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .word_arrays import byte_hashes, runs, sequence_hashes, text_bytes

#: Classes of bytes whose shares of the text are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?", "inner": b",;:", "bang": b"!", "mark": b"#*$%&|<>@^~_=+\\/", "quote": b"\"'`()[]{}", "dash": b"-",
    "space": b" \t", "line": b"\n\r\x0b\x0c", "high": bytes(range(0xC0, 0x100)), "control": bytes([*range(9), *range(14, 32), 127]),
}
NAMES = [
    "log_bytes", "log_words", "log_lines", *(f"share_{c}" for c in CLASSES), "word_mean", "word_sd", "long_words", "short_words", "capital_words", "upper_words", "marked_words", "distinct_words", "top_word",
    "line_mean", "line_sd", "short_lines", "repeated_lines", "stopped_lines", "bar_lines", "repeated_pairs", "repeated_fives", "words_a_stop", "class_entropy", "pair_entropy",
]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)  # the last number: letters and all else
for _i, _members in enumerate(CLASSES.values()):
    CLASS_OF[np.frombuffer(_members, np.uint8)] = _i
IS = {c: np.isin(np.arange(256), np.frombuffer(m, np.uint8)) for c, m in CLASSES.items()}
SPACE, STOP = IS["space"] | IS["line"], IS["stop"] | IS["bang"]


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def mean_sd(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and standard deviation of values by document."""
    n = np.bincount(doc, minlength=n_docs).astype(float)
    mean = ratio(np.bincount(doc, values, n_docs), n)
    return n, mean, np.sqrt(np.maximum(ratio(np.bincount(doc, values.astype(float) ** 2, n_docs), n) - mean**2, 0))


def distinct(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each document has, and how often its commonest one stands."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(d)))
    top = np.zeros(n_docs)
    np.maximum.at(top, d[at], lengths)
    return np.bincount(d[at], minlength=n_docs).astype(float), top


def repeated(doc: np.ndarray, words: np.ndarray, n: int, n_docs: int) -> np.ndarray:
    """Share of a document's n-grams that occur earlier in it."""
    grams = sequence_hashes(words, n)
    at = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    d = doc[at]
    kinds, _ = distinct(d, grams[at], n_docs)
    total = np.bincount(d, minlength=n_docs).astype(float)
    return ratio(total - kinds, total)


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of each row's distribution."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; null and empty texts have zeros."""
    raw, offsets = text_bytes(texts)
    n_docs = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    doc_of = np.repeat(np.arange(n_docs), np.diff(offsets))
    classes = len(CLASSES) + 1
    kind = CLASS_OF[raw]
    counts = np.bincount(doc_of * classes + kind, minlength=n_docs * classes).reshape(n_docs, classes).astype(float)
    shares = {c: counts[:, i] for i, c in enumerate(CLASSES)}
    inner = doc_of[1:] == doc_of[:-1]
    pairs = np.bincount((doc_of[1:] * classes * classes + kind[:-1].astype(np.int64) * classes + kind[1:])[inner], minlength=n_docs * classes * classes).reshape(n_docs, classes * classes).astype(float)
    starts, stops = runs(~SPACE[raw], offsets)
    word_doc, length = doc_of[starts], stops - starts
    n, mean, sd = mean_sd(word_doc, length, n_docs)
    hashes = byte_hashes(raw, starts, stops)
    kinds, top = distinct(word_doc, hashes, n_docs)
    share = lambda told: ratio(np.bincount(word_doc[told], minlength=n_docs).astype(float), n)
    upto = lambda c: np.concatenate(([0], np.cumsum(IS[c][raw], dtype=np.int64)))
    upper, marks = upto("upper"), upto("mark")
    capital = IS["upper"][raw[starts]]
    line_starts, line_stops = runs(~IS["line"][raw], offsets)
    line_doc, line_length = doc_of[line_starts], line_stops - line_starts
    lines, line_mean, line_sd = mean_sd(line_doc, line_length, n_docs)
    line_kinds, _ = distinct(line_doc, byte_hashes(raw, line_starts, line_stops), n_docs)
    of_lines = lambda told: ratio(np.bincount(line_doc[told], minlength=n_docs).astype(float), lines)
    columns = [np.log1p(size), np.log1p(n), np.log1p(lines), *(ratio(shares[c], size) for c in CLASSES), mean, sd, share(length > 15), share(length < 3), share(capital)]
    columns += [share(upper[stops] - upper[starts] == length), share(marks[stops] > marks[starts]), ratio(kinds, n), ratio(top, n), line_mean, line_sd, of_lines(line_length < 20), ratio(lines - line_kinds, lines)]
    columns += [of_lines(STOP[raw[line_stops - 1]]), of_lines(np.isin(raw[line_starts], np.frombuffer(b"|*-<#", np.uint8))), repeated(word_doc, hashes, 2, n_docs), repeated(word_doc, hashes, 5, n_docs)]
    columns += [ratio(n, shares["stop"] + shares["bang"]), entropy(counts), entropy(pairs)]
    return np.column_stack(columns) if n_docs else np.zeros((0, len(NAMES)))
