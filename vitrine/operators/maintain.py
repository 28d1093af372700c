"""Incremental maintenance of a catalogue: snapshot diff, upserts, deletions, schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import plain_unions

#: Rules by which two recorded times count as equal, in seconds.
SAME_TIME = 1e-6


def unchanged(force: bool = False) -> Column:
    """Of a row of both snapshots: indexed, of equal size, and of equal time (or, without a recorded time, of equal content)."""
    same = F.when(F.col("old_mtime").isNotNull(), F.abs(F.col("old_mtime") - F.col("mtime")) <= SAME_TIME).otherwise(F.col("old_sha") == F.col("sha"))
    return F.lit(not force) & F.coalesce(F.col("old_indexed") & (F.col("old_size") == F.col("size")) & same, F.lit(False))


def diff_scan(disk: DataFrame, catalog: DataFrame, force: bool = False, complete: bool = True) -> DataFrame:
    """path, action: skipped, modified, new, or (only if the scan is complete) deleted.  Both: path, size, mtime, sha; catalog also indexed."""
    old = catalog.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha").alias("old_sha"), F.col("indexed").alias("old_indexed"), F.lit(True).alias("known"))
    both = disk.withColumn("seen", F.lit(True)).join(old, "path", "full")
    action = F.when(F.col("seen").isNull(), "deleted" if complete else "unseen").when(unchanged(force), "skipped").when(F.col("known") & F.col("old_indexed"), "modified").otherwise("new")
    return both.select("path", action.alias("action"))


def scan_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("new", "modified", "deleted", "skipped")])


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """A new snapshot: rows of changes replace rows of current with the same key.

    Of several rows with one key the greatest in ``order`` wins (nulls lose), then the greatest as JSON text.
    """
    plain_unions(current.sparkSession)
    rows = current.withColumn("is_new", F.lit(0)).unionByName(changes.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col("is_new").desc(), *([F.col(order).desc_nulls_last()] if order else []), F.to_json(F.struct(*[c for c in rows.columns if c != "is_new"])).desc()))).where("nth = 1").drop("nth", "is_new")


def replace_vectors(vectors: DataFrame, new: DataFrame, key: str = "tile_id") -> DataFrame:
    """All vectors of the new ones' ids go, then the new ones are added."""
    return vectors.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def evolve_schema(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add missing columns with their defaults and fill nulls of present ones."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d) for c, d in defaults.items()})


def metadata_filter(rows: DataFrame, wanted: dict[str, str], allowed: tuple[str, ...] = ("brand", "category", "color", "size")) -> DataFrame:
    """Indexed rows that match all wanted values without regard to case and outer blanks; unknown fields and values don't filter."""
    keep = F.col("is_indexed")
    for field, value in wanted.items():
        if field in allowed and value and value.strip().lower() != "unknown":
            keep = keep & (F.lower(F.trim(F.col(field))) == value.strip().lower())
    return rows.where(keep)


def filter_options(rows: DataFrame, fields: tuple[str, ...] = ("brand", "category", "color", "size")) -> DataFrame:
    """field, value: the distinct known values, one spelling for each."""
    long = rows.where("is_indexed").select(*fields).unpivot([], list(fields), "field", "value").where(F.trim("value") != "").where(F.lower(F.trim("value")) != "unknown")
    return long.groupBy("field", F.lower(F.trim("value")).alias("folded")).agg(F.min(F.trim("value")).alias("value")).select("field", "value")
