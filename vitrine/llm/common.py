"""Shared helpers: staged tables, batch sizes, word classes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import plain_unions

#: ASCII white space, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
#: Rows that are worked on together.
BATCH_ROWS = 256
#: Names of the columns that row_keys gives.
KEYS = ["no_id", "id", "row"]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a local one if Spark runs on one machine, else an error."""
    plain_unions(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage the way a table does: a lost executor loses nothing, and
    whatever reads the result several times computes it once.  The shuffle files
    of the write go with its end, so a chain of steps needs the disk of one.
    ``release`` deletes the table once later steps are written themselves.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows: texts differ in length by orders of magnitude, and a batch may hold 10,000 of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 5; the remainder 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def row_keys(key: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns without nulls that tell rows apart by id and text, in the order in which rows are kept."""
    given = F.col(key).cast("long")
    return [given.isNull().alias("no_id"), F.coalesce(given, F.lit(0)).alias("id"), F.xxhash64(text).alias("row")]


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """docs with the rows that kept names by their keys; of rows equal in id and text, one."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), *row_keys())
    return keyed.join(kept, KEYS, "left_semi").dropDuplicates(KEYS).select("doc.*")
