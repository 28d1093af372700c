"""Rules over measured signals of images and stored features, and colours: Column -> Column.

A null signal fails the rules that read it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clamp01, pearson

# The current versions and sizes of stored features.
CURRENT = {"feature_version": 17, "pattern_feature_version": 3, "embedding_model": "facebook/dinov2-large", "embedding_dimension": 1024}
SIZES = {"pattern_feature_size": 12, "color_histogram_size": 2884}
# Fixed values of the query plan: most views, strip, isolate, panel, keep the aspect, by kind.
PLANS = {
    "clean_tile": (1, False, False, False, True), "catalog_sheet": (2, False, False, True, True), "phone_screenshot": (2, True, True, False, True),
    "room_scene": (3, False, True, False, False), "partial_crop": (2, False, False, False, True),
}
# Confidence of each kind of query.
CONFIDENCE = {"catalog_sheet": 0.88, "phone_screenshot": 0.85, "room_scene": 0.85, "clean_tile": 0.80, "partial_crop": 0.65, "unknown": 0.40}
# Linear RGB to XYZ over the D65 white.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def query_origin(path: Column, hint: Column, folder: str = "crops") -> Column:
    """crop_tool or auto: by the hint, else by a crop folder or the name of a crop."""
    told = F.lower(F.trim(hint))
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    crop = F.contains(F.lower(path), F.lit(folder)) | name.rlike(r"^(autocrop_|precise_)") | name.rlike(r"^crop_[^.]*_\d+(\.[^.]*)?$")
    return F.when(told.isin("crop_tool", "crop"), "crop_tool").when(told.isin("auto", "drop"), "auto").when(crop, "crop_tool").otherwise("auto")


def features_compatible(row: dict[str, Column], current: dict | None = None, sizes: dict | None = None) -> Column:
    """Versions, model and dimension equal to the current ones; sizes equal where they are known."""
    fine = F.lit(True)
    for name, value in (current or CURRENT).items():
        fine = fine & row[name].eqNullSafe(F.lit(value))
    for name, value in (sizes or SIZES).items():
        fine = fine & F.coalesce(row[name] == value, F.lit(True))
    return fine


def feature_ready(*features: Column) -> Column:
    """All of a row's features are there."""
    fine = F.lit(True)
    for f in features:
        fine = fine & f.isNotNull()
    return fine


def image_kind(width: Column, height: Column, border: Column, texture: Column, text: Column, grid: Column) -> Column:
    """struct(left_panel, center_crop, kind, quality)."""
    aspect = width / F.greatest(height, F.lit(1))
    wide = aspect >= F.when(grid | (text >= 0.12), 1.03).otherwise(1.12)
    panel = wide & (width >= 480) & (height >= 320) & ((text >= 0.12) | grid | (border >= 0.25))
    center = (F.least(width, height) >= 400) & (texture >= 0.15) & ~panel & ~(grid & (aspect >= 1.03)) & (border < 0.55)
    kind = F.when(panel, "catalog_sheet").when(border >= 0.35, "bordered_tile").when((texture >= 0.12) & aspect.between(0.75, 1.35), "clean_tile").otherwise("unknown")
    quality = clamp01(0.35 * texture + 0.25 * (1 - F.least(border, F.lit(1.0))) + 0.2 + F.when(kind != "unknown", 0.2).otherwise(0.0))
    return F.struct(panel.alias("left_panel"), center.alias("center_crop"), kind.alias("kind"), quality.alias("quality"))


def query_kind(width: Column, height: Column, border: Column, texture: Column, text: Column, grid: Column, band: Column, chrome: Column, scene: Column) -> Column:
    """The first kind that fits: sheet, phone, room, clean, partial."""
    aspect = width / F.greatest(height, F.lit(1))
    margins = ((text >= 0.10) & (border >= 0.08)) | (grid & (border >= 0.20)) | ((border >= 0.30) & (text >= 0.08))
    sheet = (width >= 480) & (height >= 320) & (aspect >= 1.12) & (band < 40) & margins
    return (
        F.when(sheet, "catalog_sheet").when(chrome & ((aspect < 0.85) | (height >= 1000)), "phone_screenshot").when(scene & (band >= 35), "room_scene")
        .when(aspect.between(0.85, 1.18) & (texture >= 0.12) & (band < 25), "clean_tile").when(texture >= 0.12, "partial_crop").otherwise("unknown")
    )


def _table(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def kind_confidence(kind: Column) -> Column:
    return _table(CONFIDENCE, kind)


def query_view_plan(kind: Column, background: Column, cap: int = 3) -> Column:
    """struct(max_views, strip_ui, isolate_scene, prefer_panel, preserve_aspect); unknown kinds isolate where half is background."""
    heavy = F.coalesce(background >= 0.5, F.lit(False))
    unknown = (F.when(heavy, 2).otherwise(1), F.lit(False), heavy, F.lit(False), F.lit(True))
    out = []
    for i, name in enumerate(("max_views", "strip_ui", "isolate_scene", "prefer_panel", "preserve_aspect")):
        value = F.coalesce(_table({k: p[i] for k, p in PLANS.items()}, kind), unknown[i])
        out.append((F.least(value, F.lit(max(1, cap))) if i == 0 else value).alias(name))
    return F.struct(*out)


def center_box(width: Column, height: Column, ratio: float) -> Column:
    """struct(left, top, right, bottom) of the middle part of an image, in whole pixels and one at least."""
    w, h = (F.greatest(F.lit(1), F.floor(side * ratio)).cast("int") for side in (width, height))
    left, top = (F.floor((side - part) / 2).cast("int") for side, part in ((width, w), (height, h)))
    return F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))


def index_view_boxes(width: Column, height: Column, ratios: tuple[float, ...] = (0.50, 0.40)) -> Column:
    """array of struct(view, left, top, right, bottom): the whole image, and its middle at each ratio; empty where a side isn't above 0."""
    whole = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), width.cast("int").alias("right"), height.cast("int").alias("bottom"))
    named = {"full": whole, **{f"center_{round(100 * r)}": center_box(width, height, r) for r in ratios}}
    boxes = F.array(*[F.struct(F.lit(n).alias("view"), *[b[c].alias(c) for c in ("left", "top", "right", "bottom")]) for n, b in named.items()])
    return F.when((width > 0) & (height > 0), boxes).otherwise(F.filter(boxes, lambda b: F.lit(False)))


def confidence_level(best: Column) -> Column:
    """Of the best display score that isn't exact: none, low, moderate or high."""
    return F.when(best.isNull(), "none").when(best < 35, "low").when(best < 55, "moderate").otherwise("high")


def lab8(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b): 8-bit CIE Lab, lightness over 255, the others about 128; may differ by one from other libraries."""
    linear = [F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    x, y, z = (sum((m * c for m, c in zip(row[1:], linear[1:], strict=True)), row[0] * linear[0]) / w for row, w in zip(XYZ, WHITE, strict=True))
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return F.struct(F.round(light * 255 / 100).alias("l"), F.round(500 * (f(x) - f(y)) + 128).alias("a"), F.round(200 * (f(y) - f(z)) + 128).alias("b"))


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(sum((F.pow(p[k] - q[k], F.lit(2.0)) for k in ("a", "b")), F.pow(p["l"] - q["l"], F.lit(2.0))))


def near_white(lab: Column) -> Column:
    return (lab["l"] >= 175) & (F.hypot(lab["a"] - 128, lab["b"] - 128) <= 28)


def color_similarity(a: Column, b: Column, bins: int = 2880) -> Column:
    """Of colour vectors: histogram bins, then lightness, its deviation, saturation and value.

    Correlation of the bins and distance of the four statistics; two near-white
    colours are at least as alike as their lightness, value and saturation say.
    Vectors of another size are correlated whole; unlike sizes give 0.
    """
    stat = lambda v, i: F.get(v, F.lit(bins + i)).cast("double")
    far = F.sqrt(sum((F.pow(stat(a, i) - stat(b, i), F.lit(2.0)) for i in range(1, 4)), F.pow(stat(a, 0) - stat(b, 0), F.lit(2.0))))
    base = clamp01(0.8 * pearson(F.slice(a, 1, bins), F.slice(b, 1, bins)) + 0.2 * F.greatest(F.lit(0.0), 1 - far))
    close = lambda i, over: F.greatest(F.lit(0.0), 1 - F.abs(stat(a, i) - stat(b, i)) / over)
    white = (stat(a, 0) >= 0.7) & (stat(b, 0) >= 0.7) & (stat(a, 2) <= 0.14) & (stat(b, 2) <= 0.14)
    value = F.when(white, F.greatest(base, 0.55 * close(0, 0.28) + 0.25 * close(3, 0.28) + 0.20 * close(2, 0.20))).otherwise(base)
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == bins + 4, value).otherwise(clamp01(pearson(a, b)))
