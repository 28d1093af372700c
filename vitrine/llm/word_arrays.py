"""Words and polynomial fingerprints of whole batches of texts, as numpy arrays over the UTF-8 bytes.

A fingerprint of the byte span [s, e) is sum(code[b_i] * BASE**(i - s)) modulo
2**64: prefix sums of code[b_i] * BASE**i give it for every span with one
difference and one product with an inverse power (BASE is odd, so it has an
inverse).  Fingerprints of word sequences are the same sum over the words'
fingerprints.  Equal spans always agree; different ones may, so whoever needs
certainty compares the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are hashed at a time, and bytes of text that are worked on together; a longer text stands alone.
WINDOW, SLICE_BYTES = 1 << 18, 1 << 20
CODES = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept = np.cumprod(up), np.cumprod(down)
        if size > WINDOW:
            return kept
        _powers[size] = kept
    return _powers[size]


def span_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans [start, stop) of codes (uint64), all within one window."""
    up, down = powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=prefix[1:])
    return (prefix[stops] - prefix[starts]) * down[starts]


def byte_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Fingerprints of ascending byte spans, window by window."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(stops, starts[at] + WINDOW, "right")))
        low, high = int(starts[at]), int(stops[upto - 1])
        out[at:upto] = span_hashes(CODES[raw[low:high]], starts[at:upto] - low, stops[at:upto] - low)
        at = upto
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial sums, whose low bits are weak."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all n consecutive entries of words; the last n-1 places have none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    for at in range(0, count, WINDOW):
        upto = min(count, at + WINDOW)
        starts = np.arange(upto - at)
        out[at:upto] = span_hashes(words[at : upto + n - 1], starts, starts + n)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, one after the other, and the n+1 offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of True that don't cross an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]]
    return cuts[:-1][keep], cuts[1:][keep]
