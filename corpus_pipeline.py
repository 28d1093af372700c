"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

Stages, in order: toxicity (rejected documents go), near-dedup (one document
of each class stays; classes hang together by links of a Jaccard similarity of
0.8 or more on 5-word shingles), benchmark decontamination (contaminated
documents go), mixing sources to target weights (documents repeat or go),
token-ID output (the digest of the files read back).

Edge cases, for all stages: null ids are ids like any other, and rows are told
apart by id and text, so that a null or repeated id takes no other row along;
null and empty texts aren't toxic, are near copies of each other, aren't
contaminated and have nothing to take in the mix, so the mix drops them; very
long texts are read whole; of rows equal in id and text the near-dedup keeps one;
ties go by the smaller id, then the text's hash; an empty table gives an empty
result; other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import decontam, mixing, near_copies, token_store, toxicity
from vitrine.llm.common import release, staged, table
from vitrine.llm.queries import END_ID, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5, by a model fitted on the labelled rows among them."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    given = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return toxicity.score_toxicity(given, model).where(F.col("toxicity.score") < 0.5).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: candidates by SimHash trees and the prefix-filter join, of which the join alone is exact; see near_copies."""
    return near_copies.drop_near_copies(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages don't make up a twentieth of the words."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of all documents, as digests read back from its files."""
    path = token_store.new_store_path(spark)
    token_store.write_store(docs, path, tokenizer_path(), END_ID)
    return token_store.read_store(spark, path).withColumnRenamed("key", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("mix_sources", mix_to_weights),
    ("token_ids", write_token_ids),
]

#: The toxicity model, the SimHash and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what a stage returns is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
