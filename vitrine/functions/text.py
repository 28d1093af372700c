"""Names, paths, ids, hashes, dates: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, part of the file-name grammar.
COLORS = ("white", "black", "grey", "gray", "cream", "beige", "brown", "blue", "green", "red", "ivory", "bone", "taupe", "sand", "charcoal", "anthracite", "gold", "silver", "bronze", "copper", "walnut", "oak", "teak", "ebony", "onyx")
CATEGORIES = ("floor", "wall", "tile", "tiles", "decor", "decorative", "ceramic", "porcelain", "marble", "granite", "wood", "stone", "terrazzo", "mosaic", "slate", "travertine", "cement", "concrete", "vinyl")
SIZE = r"(\d{2,4})\s*[xX×]\s*(\d{2,4})"
# Days a registry key of each type lasts; a lifetime key has a far date.
DURATIONS = {"15-Day Trial": 15, "1-Month Trial": 30, "2-Month Trial": 60, "3-Month Trial": 90, "6-Month Trial": 180, "1-Year": 365, "3-Year": 1095, "30-Day": 30, "90-Day": 90}
LIFETIME_UNTIL = "9999-12-31"


def filename_metadata(stem: Column) -> Column:
    """struct(brand, category, color, size, product_code) of a file name without its extension."""
    unknown = F.lit("Unknown")
    found = F.when(F.regexp_extract(stem, SIZE, 1) != "", F.concat(F.regexp_extract(stem, SIZE, 1), F.lit("x"), F.regexp_extract(stem, SIZE, 2))).otherwise(unknown)
    parts = F.filter(F.transform(F.split(stem, "_"), F.trim), lambda p: p != "")
    tokens = F.filter(F.split(F.lower(stem), r"[-\s]+"), lambda t: t != "")
    part = lambda n: F.coalesce(F.get(parts, F.lit(n)), unknown)
    first = lambda found: F.coalesce(F.initcap(F.get(found, F.lit(0))), unknown)
    by_place = F.struct(
        part(0).alias("brand"), part(1).alias("category"), part(2).alias("color"),
        F.when(F.lower(F.coalesce(F.get(parts, F.lit(3)), F.lit("unknown"))) != "unknown", F.get(parts, F.lit(3))).otherwise(found).alias("size"), part(4).alias("product_code"),
    )
    by_word = F.struct(
        unknown.alias("brand"), first(F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.array_contains(tokens, c))).alias("category"),
        first(F.filter(tokens, lambda t: t.isin(*COLORS))).alias("color"), found.alias("size"), F.when(F.size(tokens) > 0, F.substring(stem, 1, 80)).otherwise(unknown).alias("product_code"),
    )
    return F.when(F.size(parts) >= 2, by_place).otherwise(by_word)


def tile_id(raw: Column) -> Column:
    """A number, or the digits that a label ends with; null if there are none."""
    return F.coalesce(raw.try_cast("bigint"), F.regexp_extract(raw, r"(\d+)$", 1).try_cast("bigint"))


def dimensions(text: Column) -> Column:
    """struct(width, height) of "WxH"; 0, 0 if it isn't that."""
    w, h = (F.split(text, "x")[k].try_cast("int") for k in (0, 1))
    fine = w.isNotNull() & h.isNotNull()
    return F.struct(F.when(fine, w).otherwise(0).alias("width"), F.when(fine, h).otherwise(0).alias("height"))


def crop_source_stem(path: Column, folder: str = "crops") -> Column:
    """The stem of the tile that a crop was taken from, lower-cased; null for other paths."""
    stem = F.lower(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1))
    bare = F.regexp_replace(F.regexp_replace(stem, "^(crop|autocrop|precise)_", ""), r"_\d+$", "")
    return F.when(F.contains(path, F.lit(f"/{folder}/")) & (bare != ""), bare)


def key_fingerprint(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def normalized_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def expiry_date(kind: Column, start: Column) -> Column:
    """The day a key of a kind ends; an unknown kind is an error."""
    days = F.create_map(*[F.lit(x) for pair in DURATIONS.items() for x in pair])
    return F.when(kind == "Lifetime", F.to_date(F.lit(LIFETIME_UNTIL))).when(kind.isin(*DURATIONS), F.date_add(start, days[kind])).otherwise(F.raise_error(F.concat(F.lit("unknown key type: "), kind)).cast("date"))


def expiry_status(until: Column, today: Column, within: int = 30) -> Column:
    day = F.to_date(until)
    return F.when(day < today, "expired").when(day <= F.date_add(today, within), "expiring").otherwise("valid")


def parse_timestamp(text: Column) -> Column:
    """ISO text (a Z and up to nine digits of seconds' fractions allowed), else null."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1"), "Z$", "").try_cast("timestamp")


def profile_errors(name: Column, email: Column, phone: Column, website: Column) -> Column:
    """What is wrong with a profile, as an array of messages."""
    given = lambda c: F.coalesce(F.trim(c), F.lit(""))
    site = F.regexp_replace(F.regexp_replace(F.lower(given(website)), "^https?://", ""), "/.*$", "")
    digits = F.regexp_replace(given(phone), r"\D", "")
    checks = [
        F.when(given(name) == "", "name"), F.when((given(email) != "") & ~given(email).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email"),
        F.when((given(phone) != "") & (F.length(digits) != 10), "phone"), F.when((given(website) != "") & ~site.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$"), "website"),
    ]
    return F.array_compact(F.array(*checks))
