"""Arrays of numbers and 64-bit hashes: Column -> Column, for rows that are already paired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pattern similarity.
PATTERN_WEIGHTS = {12: (0.04, 0.04, 0.04, 0.10, 0.10, 0.12, 0.12, 0.10, 0.12, 0.10, 0.12, 0.10), 8: (0.05, 0.05, 0.05, 0.15, 0.15, 0.20, 0.20, 0.15)}


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rounded(x: Column, places: int = 6) -> Column:
    """x to so many places; a billionth more keeps exact halves from falling either way.  A zero keeps its sign, as in SQL: F.round drops it."""
    unit = 10.0**places
    return F.rint((x + 1e-9) * unit) / unit


def signed_round(x: Column, places: int) -> Column:
    """F.round, without a billionth more, where a zero keeps the sign of x."""
    near = F.round(x, places)
    return F.when(near == 0, x * 0.0).otherwise(near)


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(1e-12)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty or unlike arrays, and where the norms' product is below 1e-8."""
    scale = norm(a) * norm(b)
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale >= 1e-8)
    return F.when(fine, dot(a, b) / scale).otherwise(0.0)


def texture_similarity(a: Column, b: Column) -> Column:
    """1 minus the Bhattacharyya distance of two histograms."""
    mass = F.sqrt(total(F.transform(a, lambda x: x.cast("double"))) * total(F.transform(b, lambda x: x.cast("double"))))
    shared = total(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))))
    value = clamp01(1.0 - F.sqrt(F.greatest(F.lit(0.0), 1.0 - shared / mass)))
    return F.when((F.size(a) == F.size(b)) & (mass > 0), value).otherwise(0.0)


def edge_similarity(a: Column, b: Column) -> Column:
    """Cosine; two empty histograms are alike, one empty one is not."""
    none_a, none_b = norm(a) < 1e-8, norm(b) < 1e-8
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(clamp01(cosine(a, b)))


def pattern_similarity(a: Column, b: Column) -> Column:
    """By size: 12 and 8 elements are weighted differences, 5 a distance, others 0."""
    gap = lambda n: total(F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.array(*map(F.lit, PATTERN_WEIGHTS[n])), lambda d, w: d * w))
    far = F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))
    same = F.size(a) == F.size(b)
    return F.when(same & (F.size(a) == 12), 1 / (1 + 5 * gap(12))).when(same & (F.size(a) == 8), 1 / (1 + 5 * gap(8))).when(same & (F.size(a) == 5), 1 / (1 + 10 * far)).otherwise(0.0)


def pearson(a: Column, b: Column) -> Column:
    """Correlation; 1 where either side is constant."""
    n = F.size(a).cast("double")
    ma, mb = total(F.transform(a, lambda x: x.cast("double"))) / n, total(F.transform(b, lambda x: x.cast("double"))) / n
    return F.when((dot(a, a) / n - ma * ma < 1e-18) | (dot(b, b) / n - mb * mb < 1e-18), 1.0).otherwise((dot(a, b) / n - ma * mb) / F.sqrt((dot(a, a) / n - ma * ma) * (dot(b, b) / n - mb * mb)))


def color_penalty(distance: Column, both_near_white: Column) -> Column:
    """0 up to a distance of 28, -0.08 from 72 on, linear between; none between two near-white colours."""
    return F.when(both_near_white | (distance <= 28), 0.0).when(distance >= 72, -0.08).otherwise(-0.08 * (distance - 28) / 44)


def sign_hash(v: Column, bits: int = 64) -> Column:
    """64 signs of a vector as 16 hex digits, the first element in the lowest bit."""
    value = F.lit(0).cast("long")
    for i in range(bits):
        value = value.bitwiseOR(F.when(F.get(v, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def dhash64(gray: Column) -> Column:
    """The difference hash of 8 rows of 9 grey values as 16 hex digits: a bit for each value below its right neighbour, the first in the highest bit; null for another size."""
    value = F.lit(0).cast("long")
    for r in range(8):
        for c in range(8):
            up = F.get(gray, F.lit(9 * r + c)) < F.get(gray, F.lit(9 * r + c + 1))
            value = value.bitwiseOR(F.when(up, F.shiftleft(F.lit(1).cast("long"), 63 - 8 * r - c)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(gray) == 72, F.lower(F.lpad(F.hex(value), 16, "0")))


def hash_bits(h: Column) -> Column:
    """16 hex digits as the signed integer of the same bits; null if it isn't hex."""
    return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("long"))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; -1 if either isn't one."""
    return F.coalesce(F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b))), F.lit(-1))


def duplicate_percent(distance: Column) -> Column:
    return F.when(distance < 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - distance / 64 * 100))


def display_percent(score: Column, exact: Column) -> Column:
    return F.when(exact, 100.0).otherwise(F.least(F.lit(99.5), 100 * F.pow(clamp01(score), F.lit(1.35))))
