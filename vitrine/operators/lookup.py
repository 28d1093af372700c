"""References to tiles (ids, paths, names) resolved for whole tables of references at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import crop_source_stem
from vitrine.functions.vectors import hamming64
from vitrine.session import plain_unions

EXTENSIONS = ("jpg", "jpeg", "jfif", "png", "webp", "heic", "heif")


def exact_match(sha_a: Column, sha_b: Column, hash_a: Column, hash_b: Column, within: int = 3) -> Column:
    """Equal non-empty digests, or perceptual hashes at most ``within`` bits apart; never null."""
    near = hamming64(hash_a, hash_b).between(0, within)
    return F.coalesce((sha_a == sha_b) & (sha_a != ""), F.lit(False)) | F.coalesce(near, F.lit(False))


def file_stem(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1))


def by_stem(refs: DataFrame, tiles: DataFrame) -> DataFrame:
    """refs (ref) with the tile whose file has that stem in any case: ref, id.

    A name with a known extension goes before others, then the smallest id;
    references without a tile are left out.  tiles: id, path, is_indexed.
    """
    known = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*EXTENSIONS)
    named = tiles.where("is_indexed").groupBy(file_stem(F.col("path")).alias("stem")).agg(F.min(F.struct((~known).alias("other"), F.col("id"))).alias("best"))
    wanted = refs.select("ref").distinct().withColumn("stem", F.lower(F.trim("ref"))).where("stem <> ''")
    return wanted.join(named, "stem").select("ref", F.col("best.id").alias("id"))


def resolve_refs(refs: DataFrame, tiles: DataFrame) -> DataFrame:
    """refs (ref) as ids, paths or names, in that order: ref, id, how."""
    plain_unions(refs.sparkSession)
    wanted = refs.select(F.trim("ref").alias("ref")).distinct()
    number = wanted.where(F.col("ref").rlike("^[0-9]+$")).withColumn("id", F.col("ref").try_cast("long"))
    found = number.join(tiles.select("id"), "id", "left_semi").select("ref", "id", F.lit(0).alias("place"))
    found = found.union(wanted.join(tiles.groupBy("path").agg(F.min("id").alias("id")), F.col("ref") == F.col("path")).select("ref", "id", F.lit(1)))
    found = found.union(by_stem(wanted, tiles).select("ref", "id", F.lit(2)))
    best = found.groupBy("ref").agg(F.min(F.struct("place", "id")).alias("best"))
    return best.select("ref", "best.id", F.element_at(F.array(*map(F.lit, ("id", "path", "stem"))), F.col("best.place") + 1).alias("how"))


def link_crops(queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """queries (query_id, path) whose crop was taken from an indexed tile: query_id, id."""
    stems = queries.select("query_id", crop_source_stem(F.col("path")).alias("ref")).where("ref is not null")
    return stems.join(by_stem(stems, tiles), "ref").select("query_id", "id")


def manifest_catalog(lines: DataFrame) -> DataFrame:
    """The first path given for every true id: true_id, path, complete (whether every id has one).

    lines: line_no, true_id, path (null or blank where a line names none).
    """
    given = F.trim("path") != ""
    first = lines.groupBy("true_id").agg(F.min(F.when(given, F.struct("line_no", "path"))).alias("first"))
    whole = first.agg(F.coalesce(F.bool_and(F.col("first").isNotNull()), F.lit(True)).alias("complete"))  # one row
    return first.select("true_id", F.col("first.path").alias("path")).join(F.broadcast(whole))
