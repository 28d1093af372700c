"""Watching files: when one has stopped growing, and a catalogue that follows the changes batch by batch.

``stable_files`` is the table form, ``stable_stream`` the stateful one; on the
same observations they give the same outcomes.  ``BucketStore`` is what a stream
applies its changes to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Probes after which a file that never kept its size fails.
PROBES = 5
OUTCOME = "path string, outcome string, probes int, size long, at timestamp"


def stable_files(seen: DataFrame, wait_seconds: float = 60.0, probes: int = PROBES) -> DataFrame:
    """path, outcome, probes, size, at for each run of observations (path, size, at) of a file.

    A run ends where the next observation comes more than ``wait_seconds`` later.
    stable: at the first of its first ``probes`` observations that has the size
    of the one before, above 0; failed: none has, told at the last of them.
    Observations of one path at one time count in the order of their sizes.
    """
    by = Window.partitionBy("path").orderBy("at", "size")
    gap = F.col("at").cast("double") - F.lag(F.col("at").cast("double")).over(by)
    rows = seen.select("path", F.col("size").cast("long").alias("size"), "at").withColumn("run", F.sum(F.when(gap <= wait_seconds, 0).otherwise(1)).over(by))
    within = Window.partitionBy("path", "run").orderBy("at", "size")
    rows = rows.withColumn("nth", F.row_number().over(within)).withColumn("before", F.lag("size").over(within)).where(F.col("nth") <= probes)
    here = F.struct(F.col("nth").alias("probes"), "size", "at")
    same = (F.col("size") == F.col("before")) & (F.col("size") > 0)
    told = rows.groupBy("path", "run").agg(F.min(F.when(same, here)).alias("fine"), F.max(here).alias("last"))
    at = F.coalesce("fine", "last")
    return told.select("path", F.when(F.col("fine").isNotNull(), "stable").otherwise("failed").alias("outcome"), at["probes"].alias("probes"), at["size"].alias("size"), at["at"].alias("at"))


class StabilityProbe(StatefulProcessor):
    """State of a path: when it was last seen, its size then, observations of the run, and whether the run is decided.

    A timer at the end of the wait closes a run that no later observation closes.
    """

    def __init__(self, wait_seconds: float, probes: int):
        self.wait, self.probes = int(wait_seconds * 1000), probes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "at long, size long, n int, decided boolean")

    def close_run(self, path: str, at: int, size: int, n: int, decided: bool) -> list[tuple]:
        return [] if decided else [(path, "failed", n, size, pd.Timestamp(at, unit="ms"))]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (path,), out = key, []
        state = self.run.get() if self.run.exists() else None
        frame = pd.concat(list(rows)).sort_values(["at", "size"])
        for at, size in zip(frame["at"], frame["size"].astype("int64")):
            at = int(at.value // 1_000_000)
            if state is not None and at - state[0] > self.wait:
                out += self.close_run(path, *state)
                state = None
            n, before = (state[2] + 1, state[1]) if state is not None else (1, None)
            decided = state is not None and state[3]
            if not decided and size == before and size > 0:
                out.append((path, "stable", n, size, pd.Timestamp(at, unit="ms")))
                decided = True
            elif not decided and n >= self.probes:
                out.append((path, "failed", n, size, pd.Timestamp(at, unit="ms")))
                decided = True
            state = (at, int(size), n, decided)
        self.run.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[0] + self.wait + 1)
        yield pd.DataFrame(out, columns=["path", "outcome", "probes", "size", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.run.exists():
            state = self.run.get()
            if expiredTimerInfo.getExpiryTimeInMs() > state[0] + self.wait:
                out = self.close_run(key[0], *state)
                self.run.clear()
        yield pd.DataFrame(out, columns=["path", "outcome", "probes", "size", "at"])

    def close(self) -> None:
        pass


def stable_stream(seen: DataFrame, wait_seconds: float = 60.0, probes: int = PROBES, late: str = "10 seconds") -> DataFrame:
    """stable_files of a stream, with the state of each path; times to the millisecond.

    Observations later than ``late`` are dropped.  State needs a store that keeps
    it on disk: spark.sql.streaming.stateStore.providerClass set to the RocksDB one.
    """
    rows = seen.select("path", F.col("size").cast("long").alias("size"), "at").withWatermark("at", late)
    return rows.groupBy("path").transformWithStateInPandas(StabilityProbe(wait_seconds, probes), OUTCOME, outputMode="Append", timeMode="EventTime")


# ------------------------------------------------------------- the catalogue


class BucketStore:
    """A table of the latest state of each path, in buckets by a hash of the path, that follows batches of changes.

    A batch reads and rewrites only the buckets that it touches, under a folder
    of its own; a pointer file then names for every bucket the batch that wrote it
    last, and is put in place by a rename, the commit.  A batch whose number is
    not above the last commit changes nothing, so a replay is harmless, and what a
    batch wrote before it failed is written over.  Removed paths stay as marks,
    so that a late change can't bring one back.  One writer at a time.

    A changed file is told by (at, event_id); the later wins, and of a removal
    and a processing in one event the processing.
    """

    COLUMNS = "path string, size long, at timestamp, event_id long, removed boolean"
    TOLD = "path string, outcome string, at timestamp"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def pointer(self) -> tuple[int, dict[int, int]]:
        """The last committed batch (-1 for none) and each bucket's batch."""
        log = self.hadoop(f"{self.root}/log")
        done = sorted(int(f.getPath().getName()) for f in self.fs.listStatus(log) if f.getPath().getName().isdigit()) if self.fs.exists(log) else []
        if not done:
            return -1, {}
        text = self.spark.read.text(f"{self.root}/log/{done[-1]}", wholetext=True).first()[0]  # a line for each bucket at most
        return done[-1], {int(b): v for b, v in json.loads(text).items()}

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Committed rows, removed ones too, of all or some buckets."""
        _, at = self.pointer()
        paths = [f"{self.root}/data/{v}/bucket={b}" for b, v in at.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], self.COLUMNS)

    def snapshot(self) -> DataFrame:
        return self.rows().where("NOT removed").drop("removed")

    def outcomes(self, batch_id: int) -> DataFrame:
        """What became of each path of a committed batch: indexed, skipped, removed or failed."""
        return self.spark.read.schema(self.TOLD).parquet(f"{self.root}/outcomes/{batch_id}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Bring in a batch (path, step, size, at, event_id); step is process, remove or failed.  Fit for foreachBatch."""
        last, at = self.pointer()
        if batch_id <= last:
            return
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        order = F.struct("at", "event_id", (F.col("step") == "process").alias("p"), "step", "size")
        latest = batch.groupBy("path").agg(F.max(order).alias("x")).select("path", "x.step", "x.size", "x.at", "x.event_id").withColumn("bucket", bucket)
        latest = latest.persist()
        try:
            touched = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # at most one row for each bucket
            old = self.rows(touched).select("path", F.struct("size", "at", "event_id", "removed").alias("old"))
            both = latest.join(old, "path", "full").withColumn("bucket", bucket)
            was, new = F.col("old"), F.struct(F.col("size").cast("long").alias("size"), "at", "event_id", (F.col("step") == "remove").alias("removed"))
            later = was.isNull() | (F.struct("at", "event_id") > F.struct(was["at"].alias("at"), was["event_id"].alias("event_id")))
            there = F.coalesce(~was["removed"], F.lit(False))
            same = there & was["size"].eqNullSafe(F.col("size")) & (was["at"] == F.col("at"))
            outcome = F.when(~later | (F.col("step") == "process") & same, "skipped").when(F.col("step") == "failed", "failed").when(F.col("step") == "process", "indexed").when(there, "removed").otherwise("skipped")
            told = both.withColumn("outcome", F.when(F.col("step").isNotNull(), outcome))
            takes = (F.col("outcome").isin("indexed", "removed") | (F.col("step") == "remove") & later) & F.col("step").isNotNull()
            state = told.withColumn("row", F.when(F.coalesce(takes, F.lit(False)), new).otherwise(was))
            state.where("row IS NOT NULL").select("path", "row.*", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{batch_id}")
            told.where("outcome IS NOT NULL").select("path", "outcome", "at").write.mode("overwrite").parquet(f"{self.root}/outcomes/{batch_id}")
        finally:
            latest.unpersist()
        written = {int(f.getPath().getName().split("=")[1]) for f in self.fs.listStatus(self.hadoop(f"{self.root}/data/{batch_id}")) if "=" in f.getPath().getName()}
        self.commit(batch_id, at | {b: batch_id for b in touched if b in written})

    def commit(self, batch_id: int, at: dict[int, int]) -> None:
        draft = self.hadoop(f"{self.root}/log/.{batch_id}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(at), "utf-8"))
        out.close()
        if not self.fs.rename(draft, self.hadoop(f"{self.root}/log/{batch_id}")):
            raise RuntimeError(f"batch {batch_id} could not be committed")

    def drop_unused(self) -> None:
        """Delete the folders of batches that no bucket reads any more, and pointers but the last."""
        last, at = self.pointer()
        for name, keep in (("data", set(at.values())), ("log", {last})):
            folder = self.hadoop(f"{self.root}/{name}")
            for f in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
                own = f.getPath().getName()
                if own.isdigit() and int(own) not in keep and int(own) <= last:
                    self.fs.delete(f.getPath(), True)
