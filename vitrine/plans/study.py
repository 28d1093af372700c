"""Queries of studies and checks: approximate indexes, view ablation, drift, quality reports, profiles, monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import signals
from vitrine.operators import ann, checks, evaluate, maintain, search, views
from vitrine.operators.checks import Constraint
from vitrine.session import shared_folder
from vitrine.sources import catalog as sources
from vitrine.streaming import files, monitor

from . import tables as T
from .hybrid import view_hits, view_hits_sql, view_vectors, _VIEW_VECTORS
from .queries import query, r6, true_tiles

# ------------------------------------------------------ approximate indexes


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = T.vectors(spark, sf).select("tile_id", "v")
    return v.select(F.col("tile_id").alias("query_id"), "v"), v


@query("d15_knn_ivf_pq")
def d15(spark, sf):
    """Codes of 16 bytes a vector and four for its norm, all of 32 cells' codes, exact scores of 100 for each query."""
    queries, vectors = _sides(spark, sf)
    return ann.knn_ivf_pq(queries, vectors, 10, nlist=32, nprobe=32, m=16, shortlist=100)


@query("d16_knn_lsh")
def d16(spark, sf):
    queries, vectors = _sides(spark, sf)
    return ann.knn_lsh(queries, vectors, 10, tables=8, probes=6)


@query("e23_ann_recall")
def e23(spark, sf):
    """Each query's recall with each index, and with three numbers of probes."""
    _, vectors = _sides(spark, sf)
    queries = vectors.where("tile_id % 100 = 0").select(F.col("tile_id").alias("query_id"), "v")  # the query set of searches
    exact = search.knn_exact(queries, vectors, 10)
    nlist = ann.auto_nlist(vectors.count())
    found = {
        "ivf": ann.knn_ivf(queries, vectors, 10, nlist, -(-nlist // 2)), "ivf_pq": ann.knn_ivf_pq(queries, vectors, 10, nlist=32, nprobe=32, m=16, shortlist=100),
        **{f"lsh_{p}": ann.knn_lsh(queries, vectors, 10, tables=8, probes=p) for p in (1, 3, 6)},
    }
    parts = [evaluate.ann_recall(exact, hits, 10).select(F.lit(name).alias("method"), "query_id", r6("recall").alias("recall")) for name, hits in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ ablation

VIEWS, DEPTH = 4, 10


def _ranks_by_config(spark: SparkSession, sf: str) -> DataFrame:
    return views.configuration_ranks(view_hits(spark, sf, DEPTH, VIEWS - 1), true_tiles(spark, sf), views.configurations(VIEWS))


_TRUTH = "SELECT vec_id AS query_id, coalesce(lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id), min(vec_id) OVER (PARTITION BY label)) AS true_id, label FROM embeddings"
_CONFIGS = "(VALUES " + ", ".join(f"('{n}', {m})" for n, m in views.configurations(VIEWS).items()) + ") AS c(config, mask)"
_CONFIG_RANKS = f"""SELECT t.query_id, c.config, c.mask, r.rank FROM ({_TRUTH}) t CROSS JOIN {_CONFIGS} LEFT JOIN (
  SELECT query_id, mask, tile_id, row_number() OVER (PARTITION BY query_id, mask ORDER BY max(score) DESC, tile_id) AS rank FROM ({view_hits_sql(DEPTH, VIEWS - 1)}) h JOIN {_CONFIGS} ON c.mask >> h.ord & 1 = 1 GROUP BY query_id, mask, tile_id
) r ON r.query_id = t.query_id AND r.mask = c.mask AND r.tile_id = t.true_id"""
_HIT = "avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)"
_ABLATION = f"""WITH m AS (SELECT config, mask, round({_HIT.format(k=1)}, 6) AS recall_1, round({_HIT.format(k=5)}, 6) AS recall_5 FROM ({_CONFIG_RANKS}) GROUP BY 1, 2),
n AS (SELECT ord, count(*) AS tiles FROM ({_VIEW_VECTORS}) GROUP BY 1),
g AS (SELECT m.*, round((recall_1 - (SELECT recall_1 FROM m WHERE mask = 1)) * 100, 2) AS gain_1, round((recall_5 - (SELECT recall_5 FROM m WHERE mask = 1)) * 100, 2) AS gain_5, (SELECT sum(tiles) FROM n WHERE m.mask >> n.ord & 1 = 1)::BIGINT AS vectors FROM m),
v AS (SELECT *, CASE WHEN mask = 1 THEN 'baseline' WHEN bit_count(mask) = 2 THEN CASE WHEN (SELECT max(tiles) FROM n WHERE ord > 0 AND g.mask >> n.ord & 1 = 1) < greatest({views.LEAST_TILES}, {views.LEAST_SHARE} * (SELECT tiles FROM n WHERE ord = 0)) THEN 'rejected_rare_view'
  WHEN gain_5 >= {views.GAIN} OR gain_1 >= {views.GAIN} THEN 'keep' ELSE 'reject' END END AS single FROM g),
k AS (SELECT 1 + coalesce(sum(mask - 1) FILTER (single = 'keep'), 0) AS kept FROM v)
SELECT config, mask, recall_1, recall_5, gain_1, gain_5, vectors, coalesce(single, CASE WHEN mask = (SELECT kept FROM k) THEN 'candidate' WHEN mask = {(1 << VIEWS) - 1} THEN 'reference_full' END) AS verdict FROM v WHERE verdict IS NOT NULL"""


def _ablation(spark: SparkSession, sf: str) -> DataFrame:
    hits, have = view_hits(spark, sf, DEPTH, VIEWS - 1), view_vectors(spark, sf).select("tile_id", "ord")
    return views.view_ablation(hits, true_tiles(spark, sf), have, VIEWS)


@query("e14_view_ablation", _ABLATION)
def e14(spark, sf):
    return _ablation(spark, sf)


@query(
    "e17_recommend_views",
    f"""WITH a AS ({_ABLATION}), kept AS (SELECT 1 + coalesce(sum(mask - 1) FILTER (verdict = 'keep'), 0) AS mask FROM a), f AS (SELECT * FROM a WHERE mask = {(1 << VIEWS) - 1}), p AS (SELECT * FROM a WHERE mask = (SELECT mask FROM kept)),
x AS (SELECT CASE WHEN f.recall_5 > p.recall_5 + 0.005 OR abs(f.recall_5 - p.recall_5) <= 0.005 AND f.recall_1 > p.recall_1 THEN f.mask ELSE p.mask END AS mask FROM f, p)
SELECT a.mask, a.recall_1, a.recall_5, a.vectors, a.recall_5 >= b.recall_5 + 0.01 AS commit FROM a JOIN x USING (mask), (SELECT recall_5 FROM a WHERE mask = 1) b""",
)
def e17(spark, sf):
    return views.recommend_views(_ablation(spark, sf), VIEWS)


_DELTAS = ", ".join(f"round(m.{p}recall_{k} - b.{p}recall_{k}, 6) AS delta_{p}recall_{k}" for p in ("", "customer_") for k in (1, 5))


@query(
    "e15_strategy_bakeoff",
    f"""WITH m AS (SELECT config, mask, {', '.join(f"round({_HIT.format(k=k)}, 6) AS recall_{k}, round({_HIT.format(k=k)} FILTER (label IN (1, 2, 3)), 6) AS customer_recall_{k}" for k in (1, 5))} FROM (SELECT r.*, e.label FROM ({_CONFIG_RANKS}) r JOIN embeddings e ON e.vec_id = r.query_id) GROUP BY 1, 2)
SELECT m.config, m.recall_1, m.recall_5, m.customer_recall_1, m.customer_recall_5, {_DELTAS}, row_number() OVER (ORDER BY m.customer_recall_5 DESC, m.customer_recall_1 DESC, m.recall_5 DESC, m.recall_1 DESC, bit_count(m.mask), m.config) AS place FROM m, (SELECT * FROM m WHERE mask = 1) b""",
)
def e15(spark, sf):
    customers = T.vectors(spark, sf).where("label IN (1, 2, 3)").select(F.col("tile_id").alias("query_id"))
    return views.strategy_bakeoff(_ranks_by_config(spark, sf), customers, "primary")


# --------------------------------------------------------------------- drift


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """Queries made of a tile's vector: itself, its first three quarters, its size only, coarse steps."""
    v = T.vectors(spark, sf).select("tile_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    made = {"original": F.col("v"), "crop_75": F.transform("v", lambda x, i: F.when(i < 48, x).otherwise(0.0)), "phone": F.transform("v", lambda x: F.abs(x)), "whatsapp": F.transform("v", lambda x: F.floor(x * 8) / 8)}
    return v.select("tile_id", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("w")) for n, c in made.items()])).alias("q")).select("tile_id", "q.variant", F.col("q.w").alias("v"))


_VARIANTS = """SELECT vec_id AS tile_id, label, unnest([{'variant': 'original', 'q': embedding::DOUBLE[]}, {'variant': 'crop_75', 'q': list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= 48 THEN x ELSE 0 END)},
 {'variant': 'phone', 'q': list_transform(embedding::DOUBLE[], lambda x: abs(x))}, {'variant': 'whatsapp', 'q': list_transform(embedding::DOUBLE[], lambda x: floor(x * 8) / 8)}], recursive := true) FROM embeddings"""
_DRIFT = f"""SELECT tile_id, label, variant, round(max(cos) FILTER (ord = 0), 4) AS cos_primary, round(coalesce(max(cos) FILTER (ord > 0), 0), 4) AS cos_aux FROM (
  SELECT x.tile_id, x.label, x.variant, w.ord, list_cosine_similarity(x.q, w.v) AS cos FROM ({_VARIANTS}) x JOIN ({_VIEW_VECTORS}) w ON w.tile_id = x.tile_id
  WHERE x.tile_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label ORDER BY label LIMIT 14)) GROUP BY 1, 2, 3"""


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    return views.embedding_drift(_variants(spark, sf), view_vectors(spark, sf), T.vectors(spark, sf).select("tile_id", "label"))


@query("e18_embedding_drift", _DRIFT)
def e18(spark, sf):
    return _drift(spark, sf)


_CROP = "CASE WHEN chrome THEN 'center_fallback' WHEN grid THEN 'floor_band' ELSE 'none' END"


@query(
    "e19_drift_root_cause",
    f"""SELECT CASE WHEN cos_primary < 0.55 AND cos_aux < 0.55 THEN 'embedding_drift_query_far_from_all_views' WHEN scene AND NOT panel AND crop <> 'none' THEN 'auto_crop_weak_method=' || crop WHEN rank <= 5 THEN 'ok_in_top5'
  WHEN cos_aux >= 0.75 AND coalesce(rank > 5, true) THEN 'aux_aligned_but_distractors_win' ELSE 'mixed_query_preprocess_or_ambiguity' END AS cause, count(*) AS n
FROM (SELECT d.cos_primary, d.cos_aux, r.rank, s.scene, s.border >= 0.25 AS panel, {_CROP} AS crop FROM ({_DRIFT}) d JOIN ({T.SIGNALS_SQL}) s USING (tile_id) LEFT JOIN (SELECT * FROM ({_CONFIG_RANKS}) WHERE mask = 1) r ON r.query_id = d.tile_id) GROUP BY 1""",
)
def e19(spark, sf):
    s = T.signals(spark, sf).select("tile_id", "scene", (F.col("border") >= 0.25).alias("panel"), F.when(F.col("chrome"), "center_fallback").when(F.col("grid"), "floor_band").otherwise("none").alias("crop"))
    ranks = _ranks_by_config(spark, sf).where("mask = 1").select(F.col("query_id").alias("tile_id"), "rank")
    return views.drift_causes(_drift(spark, sf).join(s, "tile_id").join(ranks, "tile_id", "left"))


def _stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features as they were stored: some not at all, some of earlier content, a class's with another tile's colours."""
    v = T.vectors(spark, sf).select("tile_id", "label", F.transform("v", lambda x: x.cast("double")).alias("v"))
    other = v.select((F.col("tile_id") - 1).alias("tile_id"), F.col("v").alias("w"))
    colour = F.when(F.col("label") == 0, F.coalesce(F.col("w"), F.col("v"))).otherwise(F.col("v"))
    rows = v.join(other, "tile_id", "left").where("v[2] <= 0.3")
    sha = F.when(F.col("v")[3] > 0.3, "old").otherwise(F.col("label").cast("string"))
    texture = F.when(F.col("v")[4] > 0.35, F.slice("v", 13, 10)).otherwise(F.transform(F.slice("v", 13, 12), lambda x: checks.half(x)))
    return rows.select(F.col("tile_id").cast("string").alias("path"), sha.alias("sha"), F.slice(colour, 1, 12).alias("color"), texture.alias("texture"))


_HALF = "CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} / pow(2, greatest(floor(log2(abs({x}))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs({x}))), -14) - 10) END"
_GAP = "list_max(list_transform(range(1, 13), lambda i: abs(" + _HALF.format(x="s.{f}[i]") + " - (" + _HALF.format(x="f.{f}[i]") + "))))"


@query(
    "d17_feature_drift",
    f"""WITH f AS (SELECT vec_id::VARCHAR AS path, label::VARCHAR AS sha, embedding[1:12]::DOUBLE[] AS color, embedding[13:24]::DOUBLE[] AS texture FROM embeddings),
s AS (SELECT a.vec_id::VARCHAR AS path, CASE WHEN a.embedding[4]::DOUBLE > 0.3::DOUBLE THEN 'old' ELSE a.label::VARCHAR END AS sha, (CASE WHEN a.label = 0 THEN coalesce(b.embedding, a.embedding) ELSE a.embedding END)[1:12]::DOUBLE[] AS color,
  CASE WHEN a.embedding[5]::DOUBLE > 0.35::DOUBLE THEN a.embedding[13:22]::DOUBLE[] ELSE list_transform(a.embedding[13:24]::DOUBLE[], lambda x: {_HALF.format(x='x')}) END AS texture FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.embedding[3]::DOUBLE <= 0.3::DOUBLE),
g AS (SELECT f.path, s.sha AS s_sha, f.sha AS f_sha, len(s.texture) = 12 AS whole, {_GAP.format(f='color')} AS color_gap, list_cosine_similarity(s.color, f.color) AS color_cosine, CASE WHEN len(s.texture) = 12 THEN {_GAP.format(f='texture')} END AS texture_gap, CASE WHEN len(s.texture) = 12 THEN list_cosine_similarity(s.texture, f.texture) END AS texture_cosine FROM f LEFT JOIN s USING (path))
SELECT path, CASE WHEN s_sha IS NULL THEN 'not_stored' WHEN s_sha <> f_sha THEN 'content_changed' WHEN NOT whole THEN 'size_changed' WHEN color_gap > 0.001 OR texture_gap > 0.001 THEN 'drifted' ELSE 'same' END AS cause,
  {', '.join(f'round(CASE WHEN s_sha IS NOT NULL THEN {c} END + 1e-9, 6) AS {c}' for c in ('color_gap', 'color_cosine', 'texture_gap', 'texture_cosine'))} FROM g""",
)
def d17(spark, sf):
    plain = F.transform("v", lambda x: x.cast("double"))
    fresh = T.vectors(spark, sf).select(F.col("tile_id").cast("string").alias("path"), F.col("label").cast("string").alias("sha"), F.slice(plain, 1, 12).alias("color"), F.slice(plain, 13, 12).alias("texture"))
    out = checks.feature_drift(_stored_features(spark, sf), fresh, ("color", "texture"))
    return out.select("path", "cause", *[r6(c).alias(c) for c in out.columns[2:]])


# -------------------------------------------------------- report and profiles

_FAULTY = f"SELECT id, CASE WHEN price < 910 THEN NULL ELSE path END AS path, brand, color, size::INT AS width, price, is_indexed, CASE WHEN price > 1000 THEN price END AS features FROM ({T.TILES_SQL})"


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tiles(spark, sf)
    return t.select("id", F.when(F.col("price") >= 910, F.col("path")).alias("path"), "brand", "color", F.col("size").cast("int").alias("width"), "price", "is_indexed", F.when(F.col("price") > 1000, F.col("price")).alias("features"))


_BROKEN = {
    "path_missing": ("error", "path IS NOT NULL", True), "width_small": ("warning", "width >= 3", False), "brand_unlike": ("warning", "brand <> 'Brand#11'", False),
    "indexed_without_features": ("error", "NOT (is_indexed AND features IS NULL)", True), "price_high": ("info", "price < 100000", False),
}
_REPORT = " UNION ALL ".join(
    f"SELECT '{n}' AS issue, '{s}' AS severity, count(*) AS n, array_to_string(list_sort(list(id))[1:5], ',') AS sample, {str(b).lower()} AS rebuild FROM ({_FAULTY}) WHERE NOT coalesce({c}, false) HAVING count(*) > 0" for n, (s, c, b) in _BROKEN.items()
) + f" UNION ALL SELECT 'repeated:color', 'error', count(*), array_to_string(list_sort(list(id))[1:5], ','), false FROM (SELECT id, min(id) OVER (PARTITION BY color) AS first FROM ({_FAULTY})) WHERE id <> first HAVING count(*) > 0"


@query("e27_catalog_quality_report", _REPORT)
def e27(spark, sf):
    rules = [Constraint(n, s, F.expr(c), b) for n, (s, c, b) in _BROKEN.items()]
    rows = _faulty(spark, sf)
    return checks.quality_report(rows, "id", rules, ("color",)).unionByName(checks.missing_columns(rows, {"id": "bigint", "path": "string", "width": "int"}))


@query("e27_needs_rebuild", f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, bool_or(rebuild) AS rebuild FROM ({_REPORT})")
def e27_rebuild(spark, sf):
    return checks.needs_rebuild(e27(spark, sf))


_LOG = """SELECT user_id AS owner, event_id AS "at", CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'select' END AS action,
 floor(value)::BIGINT % 5 AS profile_id, CASE WHEN floor(value * 10)::BIGINT % 2 = 0 THEN ' p' ELSE 'P' END || (floor(value * 100)::BIGINT % 7)::VARCHAR AS name FROM events"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e, cut = T.table(spark, sf, "events"), lambda m: F.floor(F.col("value") * m).cast("long")
    action = F.when(F.col("event_type").isin("signup", "click"), "add").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "delete").otherwise("select")
    name = F.concat(F.when(cut(10) % 2 == 0, " p").otherwise("P"), (cut(100) % 7).cast("string"))
    return e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("at"), action.alias("action"), (cut(1) % 5).alias("profile_id"), name.alias("name"))


_ADDED = "list_append(list_filter(live, lambda e: e.id <> profile_id), {'id': profile_id, 'f': f})"
_PROFILES = f"""WITH RECURSIVE ops AS (SELECT *, lower(trim(name)) AS f, row_number() OVER (PARTITION BY owner ORDER BY "at") AS n FROM ({_LOG})),
r(owner, n, live, selected, "at", action, profile_id, name, outcome) AS (
  SELECT DISTINCT owner, 0::BIGINT, []::STRUCT(id BIGINT, f VARCHAR)[], NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM ops
  UNION ALL SELECT owner, n, CASE WHEN outcome IN ('added', 'updated') THEN {_ADDED} WHEN outcome = 'deleted' THEN list_filter(live, lambda e: e.id <> profile_id) ELSE live END,
   CASE WHEN outcome = 'selected' THEN profile_id WHEN outcome = 'deleted' AND selected = profile_id THEN NULL ELSE selected END, "at", action, profile_id, name, outcome FROM (
   SELECT o.*, r.live, r.selected, CASE WHEN o.action = 'add' AND len(list_filter(r.live, lambda e: e.id = o.profile_id)) > 0 THEN 'refused_exists' WHEN o.action <> 'add' AND len(list_filter(r.live, lambda e: e.id = o.profile_id)) = 0 THEN 'refused_missing'
    WHEN o.action IN ('add', 'update') AND len(list_filter(r.live, lambda e: e.f = o.f AND e.id <> o.profile_id)) > 0 THEN 'refused_name' ELSE CASE o.action WHEN 'add' THEN 'added' WHEN 'update' THEN 'updated' WHEN 'delete' THEN 'deleted' ELSE 'selected' END END AS outcome
   FROM r JOIN ops o ON o.owner = r.owner AND o.n = r.n + 1))
SELECT owner, "at", action, profile_id, name, outcome, selected FROM r WHERE n > 0"""


@query("h8_profile_upsert", _PROFILES)
def h8(spark, sf):
    return checks.apply_profiles(_log(spark, sf))


@query("h8_profiles_after", f"""SELECT owner, profile_id, trim(name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY owner, profile_id ORDER BY "at" DESC) AS back FROM ({_PROFILES}) WHERE outcome IN ('added', 'updated', 'deleted')) WHERE back = 1 AND outcome <> 'deleted'""")
def h8_after(spark, sf):
    return checks.profiles_after(checks.apply_profiles(_log(spark, sf)))


# ---------------------------------------------------------------- monitoring

_SEEN = "SELECT '/tiles/' || user_id AS path, floor(value / 40)::BIGINT AS size, ts AS \"at\" FROM events"
WAIT = 6 * 3600.0


@query(
    "i3_stability_check",
    f"""WITH o AS (SELECT *, CASE WHEN epoch("at") - lag(epoch("at")) OVER w <= {WAIT} THEN 0 ELSE 1 END AS starts FROM ({_SEEN}) WINDOW w AS (PARTITION BY path ORDER BY "at", size)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY "at", size ROWS UNBOUNDED PRECEDING) AS run FROM o),
p AS (SELECT *, row_number() OVER w AS nth, lag(size) OVER w AS before FROM b WINDOW w AS (PARTITION BY path, run ORDER BY "at", size)),
f AS (SELECT path, run, min(nth) FILTER (size = before AND size > 0) AS fine, max(nth) AS last FROM p WHERE nth <= {monitor.PROBES} GROUP BY 1, 2)
SELECT f.path, CASE WHEN fine IS NULL THEN 'failed' ELSE 'stable' END AS outcome, p.nth::INTEGER AS probes, p.size, p."at" FROM f JOIN p ON p.path = f.path AND p.run = f.run AND p.nth = coalesce(fine, last)""",
)
def i3(spark, sf):
    e = T.table(spark, sf, "events")
    seen = e.select(F.concat(F.lit("/tiles/"), F.col("user_id").cast("string")).alias("path"), F.floor(F.col("value") / 40).cast("long").alias("size"), F.col("ts").cast("timestamp").alias("at"))
    return monitor.stable_files(seen, WAIT).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "i4_incremental_apply",
    f"""SELECT path, size, "at", event_id FROM (SELECT path, event_id, "at", floor(size * 100)::BIGINT AS size, step, row_number() OVER (PARTITION BY path ORDER BY "at" DESC, event_id DESC, step = 'process' DESC) AS back
  FROM (SELECT *, unnest(CASE action WHEN 'moved' THEN ['remove', 'process'] WHEN 'deleted' THEN ['remove'] ELSE ['process'] END) AS step FROM ({T.EVENTS_SQL}) WHERE path LIKE '%.jpg')) WHERE back = 1 AND step = 'process'""",
)
def i4(spark, sf):
    """The file events applied in four batches, the third of them twice."""
    e = T.file_events(spark, sf)
    changes = files.file_actions(e).select("path", "step", F.floor(F.col("size") * 100).cast("long").alias("size"), "at", "event_id")
    bounds = e.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    part = F.floor((F.col("at").cast("double") - F.col("low").cast("double")) / (F.col("high").cast("double") - F.col("low").cast("double") + 1) * 4)
    changes = changes.crossJoin(F.broadcast(bounds)).withColumn("part", part).drop("low", "high")  # one row
    store = monitor.BucketStore(spark, f"{shared_folder(spark)}/watched-{uuid.uuid4().hex}")
    for batch_id in (0, 1, 2, 2, 3):
        store.apply(changes.where(F.col("part") == batch_id).drop("part"), batch_id)
    return store.snapshot().select("path", "size", F.col("at").cast("timestamp_ntz").alias("at"), "event_id")


# ------------------------------------------------------- manifests, history


@query("a6_write_manifest", "SELECT '/q/' || min(vec_id) || '.jpg' AS query_path, list_sort(list(vec_id)) AS relevant_ids, 'class-' || label AS category, min(vec_id) AS query_id FROM embeddings GROUP BY label")
def a6(spark, sf):
    """A manifest with a query for each class, written and read back."""
    v = T.vectors(spark, sf).groupBy("label").agg(F.min("tile_id").alias("query_id"), F.collect_list("tile_id").alias("relevant_ids"))
    queries = v.select(F.concat(F.lit("/q/"), F.col("query_id").cast("string"), F.lit(".jpg")).alias("query_path"), "relevant_ids", F.concat(F.lit("class-"), F.col("label").cast("string")).alias("category"), "query_id")
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    sources.write_manifest(queries, path)
    return sources.parse_manifest(spark.read.text(path))


@query(
    "a11_append_history",
    """SELECT event_id AS query_id, '/q/' || user_id AS query_path, floor(value)::INTEGER AS result_count, value / 10 AS elapsed_seconds, ts AS "at" FROM events WHERE event_type IN ('view', 'click')""",
)
def a11(spark, sf):
    """Searches appended to the history in three batches, the second of them twice; each search is told twice."""
    e = T.table(spark, sf, "events").where("event_type IN ('view', 'click')")
    told = e.select(F.col("event_id").alias("query_id"), F.concat(F.lit(" /q/"), F.col("user_id").cast("string")).alias("query_path"), F.floor("value").alias("result_count"), (F.col("value") / 10).alias("elapsed_seconds"), F.col("ts").alias("at"))
    root = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    for batch_id in (0, 1, 1, 2):
        part = told.where(F.pmod("query_id", F.lit(3)) == batch_id)
        sources.append_batch(files.search_history(part.unionByName(part)), root, batch_id)
    return sources.read_batches(spark, root).drop("batch")


_BOX = "SELECT tile_id, 'center_{p}' AS view, (width - w) // 2 AS \"left\", (height - h) // 2 AS top, (width - w) // 2 + w AS \"right\", (height - h) // 2 + h AS bottom FROM (SELECT tile_id, width, height, greatest(1, floor(width * {r}))::INTEGER AS w, greatest(1, floor(height * {r}))::INTEGER AS h FROM s)"
_BOXES = f"""WITH s AS (SELECT tile_id, width::INTEGER AS width, height::INTEGER AS height FROM ({T.SIGNALS_SQL}))
SELECT tile_id, 'full' AS view, 0 AS "left", 0 AS top, width AS "right", height AS bottom FROM s UNION ALL {_BOX.format(p=50, r='0.5::DOUBLE')} UNION ALL {_BOX.format(p=40, r='0.4::DOUBLE')}"""


@query("b39_index_view_boxes", _BOXES)
def b39(spark, sf):
    s = T.signals(spark, sf)
    return s.select("tile_id", F.inline(signals.index_view_boxes(F.col("width"), F.col("height"))))


_FOLDERS = "SELECT '/tiles/' || (user_id % 20) AS path, ts AS last_indexed_at, event_id FROM events"


@query("a12_upsert_folders", f"""SELECT path, max(last_indexed_at) AS last_indexed_at FROM ({_FOLDERS}) GROUP BY 1""")
def a12(spark, sf):
    """Each folder's last indexing, from earlier rows and a batch of changes with several rows a folder."""
    e = T.table(spark, sf, "events").select(F.concat(F.lit("/tiles/"), (F.col("user_id") % 20).cast("string")).alias("path"), F.col("ts").alias("last_indexed_at"))
    middle = e.agg(F.percentile(F.col("last_indexed_at").cast("timestamp").cast("double"), 0.5).alias("middle"))
    e = e.crossJoin(F.broadcast(middle)).withColumn("late", F.col("last_indexed_at").cast("timestamp").cast("double") > F.col("middle")).drop("middle")  # one row
    earlier = maintain.upsert(e.where("false").drop("late"), e.where("NOT late").drop("late"), "path", "last_indexed_at")
    return maintain.upsert(earlier, e.where("late").drop("late"), "path", "last_indexed_at")


@query("a7_write_report", "SELECT label::BIGINT AS label, count(*)::BIGINT AS n, 'class, \"' || label || '\"' AS note FROM embeddings GROUP BY 1, 3")
def a7(spark, sf):
    """A report written as CSV and JSON, read back from the JSON."""
    rows = T.vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n")).withColumn("note", F.concat(F.lit('class, "'), F.col("label").cast("string"), F.lit('"')))
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    sources.write_report(rows, path)
    return spark.read.schema("label long, n long, note string").json(f"{path}/json")
