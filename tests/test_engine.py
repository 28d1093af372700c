"""Queries against DuckDB, and the operators' unit cases."""

import numpy as np
import pytest
from oracle import compare, views
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.functions import signals, text, vectors
from vitrine.operators import ann, duplicates, evaluate, lookup, maintain, registry, search, tuning
from vitrine.plans import ORACLES, QUERIES
from vitrine.sources import catalog
from vitrine.streaming import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) == ""


def test_queries_without_sql_run(spark):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, SF).count() > 0


def test_exact_and_approximate_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v[7] = v[8] = v[9]  # ties go by id
    odd = [(400, None), (401, [1.0] * 3), (402, [float("nan")] * 16), (403, [None] * 16)]
    rows = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), *odd], "tile_id long, v array<double>")
    queries = rows.withColumnRenamed("tile_id", "query_id")
    s = np.round(np.clip(v / np.linalg.norm(v, axis=1, keepdims=True) @ v.T, -1, 1), 6)
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j), n + 1) for i in range(400) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:5])}
    for block in (4096, 64):
        monkeypatch.setattr(search, "BLOCK", block)
        assert {(r.query_id, r.tile_id, r["rank"]) for r in search.knn_exact(queries, rows, 5).collect()} == want
    assert {r.tile_id for r in search.unusable(rows, search.dimension(rows)).collect()} == {400, 401, 402, 403}
    assert search.knn_exact(queries.limit(0), rows, 5).count() == 0
    found = {(r.query_id, r.tile_id, r["rank"]) for r in ann.knn_ivf(queries, rows, 5, 10, 10).collect()}
    assert found == want  # all cells are searched
    exact, few = search.knn_exact(queries, rows, 5), ann.knn_ivf(queries, rows, 5, 20, 2)
    assert 0.1 < np.mean([r.recall for r in evaluate.ann_recall(exact, few, 5).collect()]) < 1


def test_approximate_search_reaches_its_recall(spark):
    recall = {}
    for r in QUERIES["e23_ann_recall"](spark, "/root/testdata/sf0.1").collect():
        recall.setdefault(r.method, []).append(r.recall)
    assert all(len(r) == 20 for r in recall.values())
    mean = {m: np.mean(r) for m, r in recall.items()}
    assert min(mean["ivf"], mean["ivf_pq"], mean["lsh_6"]) >= 0.9 and mean["lsh_1"] < mean["lsh_3"] < mean["lsh_6"]


def test_upsert_takes_the_last_of_several(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size int, t int")
    new = spark.createDataFrame([("a", 2, 5), ("a", 3, 9), ("a", 4, None)], "path string, size int, t int")
    assert sorted(map(tuple, maintain.upsert(old, new, "path", "t").collect())) == [("a", 3, 9), ("b", 1, 1)]


def test_filename_metadata(spark):
    cases = {
        "Kajaria_Floor_Grey_60x60_ABC123": ("Kajaria", "Floor", "Grey", "60x60", "ABC123"),
        "5mm-white-dotted-ceramic-floor-tile-500x500": ("Unknown", "Floor", "White", "500x500", "5mm-white-dotted-ceramic-floor-tile-500x500"),
        "cream-color-floor-tiles": ("Unknown", "Floor", "Cream", "Unknown", "cream-color-floor-tiles"),
        "A_B": ("A", "B", "Unknown", "Unknown", "Unknown"),
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", text.filename_metadata(F.col("s")).alias("m"))
    assert {r.s: tuple(r.m) for r in df.collect()} == cases


def test_small_functions(spark):
    row = spark.range(1).select(
        text.tile_id(F.lit("tile-42")).alias("a"), text.tile_id(F.lit("none")).alias("b"), text.dimensions(F.lit("12x")).alias("c"), text.crop_source_stem(F.lit("/x/crops/crop_Foo_3.jpg")).alias("d"), text.crop_source_stem(F.lit("/x/Foo.jpg")).alias("e"),
        text.parse_timestamp(F.lit("2024-01-02T03:04:05.123456789Z")).cast("string").alias("f"), text.parse_timestamp(F.lit("soon")).alias("g"), text.profile_errors(F.lit(" "), F.lit("a@b"), F.lit("12"), F.lit("http://x.co/y")).alias("h"),
        vectors.hamming64(F.lit("ff"), F.lit("0f")).alias("i"), vectors.hamming64(F.lit("zz"), F.lit("00")).alias("j"), vectors.display_percent(F.lit(0.9), F.lit(True)).alias("k"), vectors.pearson(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(3.0))).alias("l"),
    ).first()
    assert tuple(row) == (42, None, (0, 0), "foo", None, "2024-01-02 03:04:05.123456", None, ["name", "email", "phone"], 4, -1, 100.0, 1.0)


def hits(spark, scores, exact=()):
    return spark.createDataFrame([(1, i, s, i in exact, i + 1) for i, s in enumerate(scores)], "query_id long, tile_id long, score double, exact boolean, rank int")


def test_weak_filter_cases(spark):
    keep = lambda df, k=10: [r.score for r in search.weak_filter(df, k).orderBy("rank").collect()]
    assert keep(hits(spark, [0.75, 0.55, 0.40, 0.25, 0.20])) == [0.75, 0.55]
    assert keep(hits(spark, [0.97, 0.55, 0.436, 0.40], exact={0})) == [0.97, 0.55, 0.436, 0.40]
    assert keep(hits(spark, [0.30, 0.22, 0.10])) == [0.30, 0.22, 0.10] and keep(hits(spark, [0.30, 0.22]), 1) == [0.30]


def test_fusion_orders(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1.0, 5), (1, 2, 0.92, 1.0, 1), (1, 2, 0.5, 1.0, 2), (1, 1, 0.95, 1.0, 9)], "query_id long, tile_id long, score double, view_weight double, rank_in_list int")
    first = lambda m: search.fuse_hits(df, m).orderBy(F.desc("score"), "tile_id").first()
    assert tuple(first("max"))[1:] == (1, 0.95) and first("rrf").tile_id == 2


def test_near_pairs_and_groups_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 10), replace=False)) for _ in range(60)], np.uint64)
    h = np.concatenate([base, base ^ flips, base[:5]])
    rows = spark.createDataFrame([(i, f"{int(x):016x}") for i, x in enumerate(h)], "id long, perceptual_hash string")
    for shared in (1, 2):
        got = {(r.a, r.b) for r in duplicates.near_pairs(rows, 8, shared).collect()}
        first = {int(x): i for i, x in reversed(list(enumerate(h)))}
        want = {tuple(sorted((i, j))) for x, i in first.items() for y, j in first.items() if i < j and 0 < (x ^ y).bit_count() <= 8}
        assert got == want
    groups = {r.id: r.group_id for r in duplicates.near_groups(rows).collect()}
    assert all(groups[i + 120] == groups[i] for i in range(5)) and all(groups[groups[i]] == groups[i] for i in groups)
    assert duplicates.keep_first(rows, duplicates.near_groups(rows)).count() == len(h) - len(groups) + len(set(groups.values()))


def test_diff_counts_partition_the_paths(spark):
    disk = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 2, 1.0, "y"), ("c", 3, 1.0, "z")], "path string, size long, mtime double, sha string")
    cat = spark.createDataFrame([("a", 1, 1.0, "x", True), ("b", 9, 1.0, "y", True), ("d", 1, None, "q", True)], "path string, size long, mtime double, sha string, indexed boolean")
    got = dict(tuple(r) for r in maintain.diff_scan(disk, cat).collect())
    assert got == {"a": "skipped", "b": "modified", "c": "new", "d": "deleted"}
    assert dict(tuple(r) for r in maintain.diff_scan(disk, cat, force=True, complete=False).collect()) == {"a": "modified", "b": "modified", "c": "new", "d": "unseen"}


def test_metrics_grow_with_k(spark):
    rows = QUERIES["e6_ranking_metrics"](spark, SF).collect()
    assert all(0 <= r.recall_1 <= r.recall_5 <= r.recall_10 <= 1 and 0 <= r.ndcg_5 <= 1 for r in rows)


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, [0.5])], "id long, v array<float>")
    back = catalog.decode_vectors(df.withColumn("v", catalog.encode_vectors(F.col("v"))), "v")
    assert {r.id: list(r.v) for r in back.collect()} == {1: [1.0, -2.5], 2: [0.5]}
    catalog.write_snapshot(df, str(tmp_path / "s"), 1, "id")
    catalog.write_snapshot(df.where("id = 2"), str(tmp_path / "s"), 2, "id")
    assert catalog.read_snapshot(spark, str(tmp_path / "s")).count() == 1
    (tmp_path / "img/sub").mkdir(parents=True)
    for n in ("a.jpg", "b.PNG", "sub/c.webp", "readme.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert catalog.scan_files(spark, str(tmp_path / "img")).count() == 3
    lines = spark.createDataFrame([("# note",), ("",), ('{"query_image":"q.jpg","true_tile_id":"tile 7","category":" Crop "}',), ('{"query_path":"r.jpg","relevant_ids":[3,4]}',)], "value string")
    assert {tuple(r)[:3] for r in catalog.parse_customer_manifest(lines).collect()} == {("q.jpg", 7, "crop"), ("r.jpg", 3, "unknown")}


def test_stream_equals_its_table_twin(spark, tmp_path):
    events = spark.createDataFrame([(i, f"/t/{i % 3}.jpg", ["created", "moved", "deleted"][i % 3], f"2024-01-01 00:00:{i:02d}", 1.0) for i in range(30)], "event_id long, path string, action string, at string, size double").withColumn("at", F.col("at").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    files.file_actions(stream).writeStream.foreachBatch(files.apply_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    want = {tuple(r) for r in files.file_actions(events).groupBy("path").agg(F.max_by("step", "at"), F.max("at")).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()} == want
    assert evaluate.latest(events, ["path"], [F.desc("at")]).count() == 3


def test_references(spark):
    tiles = spark.createDataFrame([(1, "/a/One.JPG", True), (2, "/a/one.txt", True), (3, "/b/two.png", False), (12, "/b/12.png", True)], "id long, path string, is_indexed boolean")
    refs = spark.createDataFrame([("ONE",), ("two",), (None,), ("",), ("12",), ("99",), ("/b/two.png",), ("ONE",)], "ref string")
    assert sorted(map(tuple, lookup.by_stem(refs, tiles).collect())) == [("12", 12), ("ONE", 1)]
    assert sorted(map(tuple, lookup.resolve_refs(refs, tiles).collect())) == [("/b/two.png", 3, "path"), ("12", 12, "id"), ("ONE", 1, "stem")]
    crops = spark.createDataFrame([(1, "/x/crops/crop_one_3.jpg"), (2, "/x/one_3.jpg"), (3, None)], "query_id long, path string")
    assert [tuple(r) for r in lookup.link_crops(crops, tiles).collect()] == [(1, 1)]
    lines = spark.createDataFrame([(2, 7, "b"), (1, 7, " "), (3, 7, "a"), (4, 8, None)], "line_no long, true_id long, path string")
    assert sorted(map(tuple, lookup.manifest_catalog(lines).collect())) == [(7, "b", False), (8, None, False)]


def test_tuning_and_views(spark):
    hits = spark.createDataFrame([(q, o, t, 0.1 * ((q * 7 + t * 3 + o) % 9), 1.0 - 0.2 * o, t + 1, o == 1) for q in range(40) for o in (0, 1) for t in range(6)], "query_id long, ord int, tile_id long, score double, view_weight double, rank_in_list long, aux boolean")
    truth = spark.createDataFrame([(q, q % 6) for q in range(40)], "query_id long, true_id long")
    # parts of a union that adaptive execution merges in different ways must not split a group
    both = hits.repartition(16, "query_id").withColumn("rank_in_list", F.row_number().over(Window.partitionBy("query_id", "ord").orderBy("tile_id")))
    table = tuning.fusion_bakeoff(both, truth).collect()
    assert [r.n for r in table] == [40] * 6 and sum(r.winner for r in table) == 1 and all(r.r1 <= r.r5 for r in table)
    tuned = tuning.tune_aux_weight(hits, truth).orderBy("place").collect()
    assert [r.weight for r in tuned] == list(tuning.AUX_WEIGHTS) and [r.chosen for r in tuned].index(True) == max(range(6), key=lambda i: (tuned[i].recall_1, -i))
    views = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.01]), (1, 2, [0.0, 1.0]), (1, 3, [0.0, 0.99]), (2, 0, [0.0, 2.0])], "tile_id long, ord int, v array<double>")
    assert sorted(map(tuple, tuning.prune_views(views).collect())) == [(1, 0), (1, 2), (2, 0)]
    fused = {(r.tile_id, r.i): r.x for r in tuning.fuse_views(views).collect()}
    assert fused[2, 1] == pytest.approx(1) and fused[1, 0] == pytest.approx(0.8 / (0.8**2 + 0.203**2) ** 0.5)


def test_near_pairs_of_equal_hashes_equal_their_sql(spark, tmp_path):
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(60)
    copies = few.unionByName(few.limit(9).withColumn("doc_id", F.col("doc_id") + 10_000))
    close = few.limit(12).crossJoin(spark.createDataFrame([(20_000, "extra"), (30_000, "more words here")], "n long, w string"))
    close = close.withColumns({"doc_id": F.col("doc_id") + F.col("n"), "text": F.concat_ws(" ", "text", "w")}).drop("n", "w")
    copies.unionByName(close).write.parquet(f"{tmp_path}/documents.parquet")
    con = views(str(tmp_path))
    for name in ("d5_near_duplicate_pairs", "d5_near_duplicate_members", "b10_duplicate_percent"):
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], str(tmp_path)) == ""
    assert QUERIES["d5_near_duplicate_pairs"](spark, str(tmp_path)).where("a >= 10000 or b >= 10000").count() > 20


def test_color_similarity_cases(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(60).tolist(), rng.random(60).tolist()
    white, pale, dark = [0.9, 0.1, 0.05, 0.9], [0.8, 0.1, 0.1, 0.8], [0.2, 0.1, 0.5, 0.3]
    rows = [(0, a + white, b + pale), (1, a + white, a + white), (2, a + dark, b + dark), (3, a + white, a), (4, a, b), (5, [0.0] * 60 + dark, a + dark)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", signals.color_similarity(F.col("a"), F.col("b"), 60).alias("s")).collect()}
    corr = np.corrcoef(a, b)[0, 1]
    near = 0.55 * (1 - 0.1 / 0.28) + 0.25 * (1 - 0.1 / 0.28) + 0.2 * (1 - 0.05 / 0.2)
    far = float(np.linalg.norm(np.subtract(white, pale)))
    want = {0: max(near, min(1, max(0, 0.8 * corr + 0.2 * (1 - far)))), 1: 1.0, 2: min(1, max(0, 0.8 * corr + 0.2)), 3: 0.0, 4: max(0, corr), 5: 1.0}
    assert got == pytest.approx(want)
    lab = spark.range(1).select(signals.lab8(*map(F.lit, (255.0, 255.0, 255.0))).alias("w"), signals.lab8(*map(F.lit, (255.0, 0.0, 0.0))).alias("r")).first()
    assert tuple(lab.w) == (255, 128, 128) and tuple(lab.r) == (136, 208, 195)


def test_registry_lifecycle_cases(spark):
    events = [
        (1, "issue", "k1", " m1 ", None, None), (2, "delete", "k1", None, None, None), (3, "cancel", "k1", None, None, "late"), (4, "issue", "k2", "m1", None, None),
        (5, "unblock", None, "m1", None, None), (6, "issue", "k3", "m3", None, None), (7, "issue", "k4", "m3", "k3", None), (8, "issue", "k5", "*", None, None), (9, "cancel", "k5", None, None, ""),
        (10, "issue", "k6", "m6", None, None), (11, "cancel", "k6", None, None, None), (12, "delete", "k6", None, None, None), (13, "cancel", "k6", None, None, None), (14, "cancel", "none", None, None, None),
        (15, "issue", "k7", "m7", None, None), (16, "cancel", "k7", None, None, None), (17, None, "k7", None, None, None),
    ]
    got = {r.license_id: tuple(r)[1:] for r in registry.registry_lifecycle(spark.createDataFrame(events, "at int, action string, license_id string, machine_id string, supersedes string, reason string")).collect()}
    assert got == {
        "k1": ("m1", "cancelled", " Cancelled: late", False), "k2": ("m1", "active", "", False), "k3": ("m3", "superseded", " Replaced by newer key.", False),
        "k4": ("m3", "active", "", False), "k5": ("*", "cancelled", " Cancelled.", False), "k7": ("m7", "cancelled", " Cancelled.", True),
    }


def test_document_hashes_row_by_row(spark, tmp_path):
    """Null texts and ids, a text of 49 words, two rows of one id: each document is its own row and nothing is shuffled."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(words[::-1] * 2)), (None, "\u00e9x1" + " ".join(words)), (2, " ".join(words[:49])), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, views(str(tmp_path)), "b8", QUERIES["b8_dhash64"], ORACLES["b8_dhash64"], str(tmp_path)) == ""
    assert QUERIES["b8_dhash64"](spark, str(tmp_path)).count() == 3
    assert "Exchange" not in QUERIES["b8_dhash64"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_rounding_to_zero_keeps_the_sign(spark, tmp_path):
    """Elements that round to zero come out of a query as out of its SQL, bit for bit: F.round gives 0.0 where SQL gives -0.0."""
    tiny = [0.6, 0.8, -3e-7, 3e-7, -1e-10, -0.0, 0.0, -5.1e-7]
    spark.createDataFrame([(1, tiny, 0), (2, [0.0] * 8, 0), (3, [-x for x in tiny], 0), (4, None, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = lambda rows: {i: v and np.array(v).tobytes() for i, v in rows}
    want = bits(views(str(tmp_path)).execute(ORACLES["b18_l2_normalize"]).fetchall())
    assert bits(map(tuple, QUERIES["b18_l2_normalize"](spark, str(tmp_path)).collect())) == want and np.signbit(np.frombuffer(want[1])[2])
    given = [-0.004, 0.004, -0.005, 0.005, -0.0, 0.0, -1.234, 2.5, None, float("nan"), float("-inf")]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").select("i", vectors.signed_round(F.col("x"), 2), vectors.rounded(F.col("x"), 2)).orderBy("i").collect()
    sql = views(str(tmp_path)).execute("SELECT round(x, 2), round(x + 1e-9, 2) FROM (SELECT unnest(range(len(?::DOUBLE[]))) AS i, unnest(?::DOUBLE[]) AS x) ORDER BY i", [given, given]).fetchall()
    assert [tuple(map(repr, r[1:])) for r in got] == [tuple(map(repr, r)) for r in sql]
