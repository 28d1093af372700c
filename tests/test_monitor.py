"""Stability of watched files and the bucketed catalogue, on streams with restarts and as tables."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from vitrine.sources import catalog
from vitrine.streaming import files, monitor

T0 = dt.datetime(2024, 1, 1)
SEEN = "path string, size long, at timestamp"
CHANGES = "path string, step string, size long, at timestamp, event_id long"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def plain_outcomes(rows, wait, probes):
    """The rule in plain Python, one path at a time."""
    out = []
    for path in sorted({r[0] for r in rows}):
        runs, last = [], None
        for _, size, t in sorted((r for r in rows if r[0] == path), key=lambda r: (r[2], r[1])):
            if last is None or (t - last).total_seconds() > wait:
                runs.append([])
            runs[-1].append((size, t))
            last = t
        for run in runs:
            fine = [i for i in range(1, min(len(run), probes)) if run[i][0] == run[i - 1][0] > 0]
            i = fine[0] if fine else min(len(run), probes) - 1
            out.append((path, "stable" if fine else "failed", i + 1, run[i][0], run[i][1]))
    return sorted(out)


ROWS = [
    ("a", 5, at(0)), ("a", 9, at(1)), ("a", 9, at(2)), ("a", 9, at(3)), ("b", 0, at(0)), ("b", 0, at(1)), ("b", 7, at(2)), ("b", 7, at(3)), ("c", 1, at(0)), ("c", 2, at(1)), ("c", 3, at(2)), ("c", 4, at(3)), ("c", 5, at(4)), ("c", 5, at(5)),
    ("d", 3, at(0)), ("d", 3, at(100)), ("d", 3, at(101)), ("e", 4, at(2)), ("f", 6, at(0)), ("f", 6, at(0)),
]


def test_stability_of_tables(spark):
    got = sorted(tuple(r) for r in monitor.stable_files(spark.createDataFrame(ROWS, SEEN), 60).collect())
    assert got == plain_outcomes(ROWS, 60, 5)
    assert {r[1] for r in got} == {"stable", "failed"}
    assert monitor.stable_files(spark.createDataFrame([], SEEN)).count() == 0


def test_stability_of_a_stream_over_restarts(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    end = [("z", 1, at(1000)), ("z", 1, at(1001))]  # moves the watermark, so that the waits end
    try:
        ordered = sorted(ROWS, key=lambda r: r[2])
        for part in (ordered[:9], ordered[9:], end, [("z", 2, at(3000))], [("z", 2, at(5000))]):
            spark.createDataFrame(part, SEEN).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SEEN).parquet(source)
            q = monitor.stable_stream(stream, 60).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
        got = sorted(tuple(r) for r in spark.read.parquet(sink).where("path <> 'z'").collect())
    finally:
        spark.conf.unset(provider)
    assert got == plain_outcomes(ROWS, 60, 5)


@pytest.fixture
def store(spark, tmp_path):
    return monitor.BucketStore(spark, str(tmp_path / uuid.uuid4().hex), 8)


def told(store, batch_id):
    return {r.path: r.outcome for r in store.outcomes(batch_id).collect()}


def test_batches_touch_their_buckets_only_and_replays_nothing(spark, store):
    first = [(f"/{i}.jpg", "process", i, at(i), i) for i in range(40)]
    store.apply(spark.createDataFrame(first, CHANGES), 0)
    assert store.snapshot().count() == 40 and set(told(store, 0).values()) == {"indexed"}
    _, before = store.pointer()
    second = [("/1.jpg", "process", 99, at(100), 100), ("/2.jpg", "remove", None, at(100), 101), ("/nothing.jpg", "remove", None, at(100), 102), ("/3.jpg", "process", 3, at(3), 3), ("/4.jpg", "failed", 0, at(100), 103), ("/5.jpg", "process", 7, at(1), 1)]
    store.apply(spark.createDataFrame(second, CHANGES), 1)
    assert told(store, 1) == {"/1.jpg": "indexed", "/2.jpg": "removed", "/nothing.jpg": "skipped", "/3.jpg": "skipped", "/4.jpg": "failed", "/5.jpg": "skipped"}
    rows = {r.path: r["size"] for r in store.snapshot().collect()}
    assert rows["/1.jpg"] == 99 and "/2.jpg" not in rows and rows["/4.jpg"] == 4 and rows["/5.jpg"] == 5 and len(rows) == 39
    _, after = store.pointer()
    touched = {r[0] for r in spark.createDataFrame(second, CHANGES).select(F.pmod(F.xxhash64("path"), F.lit(8))).collect()}
    assert {b for b in after if after[b] != before.get(b)} <= touched and len(touched) < 8
    store.apply(spark.createDataFrame([("/1.jpg", "remove", None, at(500), 500)], CHANGES), 1)  # the number was committed
    assert {r.path: r["size"] for r in store.snapshot().collect()} == rows
    store.drop_unused()
    assert {r.path: r["size"] for r in store.snapshot().collect()} == rows


def test_late_changes_and_ties(spark, store):
    store.apply(spark.createDataFrame([("/a", "process", 1, at(10), 1), ("/a", "remove", None, at(10), 2), ("/b", "remove", None, at(10), 3), ("/b", "process", 4, at(10), 3)], CHANGES), 5)
    assert {r.path: r["size"] for r in store.snapshot().collect()} == {"/b": 4}
    store.apply(spark.createDataFrame([("/a", "process", 8, at(9), 9), ("/b", "process", 5, at(9), 9)], CHANGES), 6)
    assert {r.path: r["size"] for r in store.snapshot().collect()} == {"/b": 4} and set(told(store, 6).values()) == {"skipped"}
    store.apply(spark.createDataFrame([], CHANGES), 7)
    assert store.pointer()[0] == 7 and store.snapshot().count() == 1


def test_a_stream_of_batches_equals_one_batch(spark, store, tmp_path):
    rows = [(f"/{i % 17}", "remove" if i % 5 == 0 else "process", None if i % 5 == 0 else i % 3, at(i % 29), i) for i in range(120)]
    whole = monitor.BucketStore(spark, str(tmp_path / "whole"), 8)
    whole.apply(spark.createDataFrame(rows, CHANGES), 0)
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for part in (rows[:50], rows[50:60], rows[60:]):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(source)
        q = spark.readStream.schema(CHANGES).parquet(source).writeStream.foreachBatch(store.apply).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(map(str, store.snapshot().drop("event_id").collect())) == sorted(map(str, whole.snapshot().drop("event_id").collect()))


def test_history_of_a_stream_is_appended_once(spark, tmp_path):
    kind = "query_id long, query_path string, result_count int, elapsed_seconds double, at timestamp"
    rows = [(i, f" /q/{i}.jpg ", i - 1, 0.5 * i, at(i)) for i in range(6)] + [(9, " ", 1, 1.0, at(2)), (10, None, 1, 1.0, at(2))]
    source, root, check = (str(tmp_path / n) for n in ("in", "history", "check"))
    for part in (rows[:3], rows[1:]):  # two searches are told again
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = files.search_history(spark.readStream.schema(kind).parquet(source))
        q = stream.writeStream.foreachBatch(lambda batch, n: catalog.append_batch(batch, root, n)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    want = sorted((i, f"/q/{i}.jpg", max(0, i - 1), 0.5 * i, at(i)) for i in range(6))
    assert sorted(tuple(r)[:5] for r in catalog.read_batches(spark, root).drop("batch").collect()) == want
    assert sorted(tuple(r) for r in files.search_history(spark.createDataFrame(rows + rows, kind)).collect()) == want
    before = catalog.read_batches(spark, root).count()
    catalog.append_batch(spark.read.parquet(f"{root}/batch=0").limit(0).unionByName(spark.createDataFrame([(0, "/q/0.jpg", 0, 0.0, at(0))], kind)), root, 77)
    assert catalog.read_batches(spark, root).count() == before + 1


def test_manifest_round_trip(spark, tmp_path):
    rows = [("/a b.jpg", [3, 1], "x", 7), ("/n.jpg", [2], None, None), (None, [1], "x", 1), ("/none.jpg", [], "x", 2), ('/"q".jpg', [5], "y", 3)]
    path = str(tmp_path / "manifest")
    catalog.write_manifest(spark.createDataFrame(rows, "query_path string, relevant_ids array<long>, category string, query_id long"), path)
    got = sorted((r.query_path, r.relevant_ids, r.category, r.query_id) for r in catalog.parse_manifest(spark.read.text(path)).collect())
    assert got == sorted([("/a b.jpg", [1, 3], "x", 7), ("/n.jpg", [2], "Unknown", None), ('/"q".jpg', [5], "y", 3)], key=lambda r: r[0])
