"""Thin queries that bind the operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, chat, decontam, line_join, mixing, phrases, quality, simhash, suffix_dedup, token_store, toxicity, urls, whitening
from .common import fold, staged, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit_toxicity(docs, labels))
    score = F.col("toxicity.score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxicity.offending").alias("n_offending"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_store_path(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_store.read_store(spark, path).withColumnRenamed("key", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_join.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    links = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["links"])
    removed = F.transform(F.filter("lines", lambda x: x["removed"]), lambda x: x["line"])
    doc_id = F.when(F.col("has_id"), F.col("id")).alias("doc_id")
    return found.select(doc_id, F.size("lines").cast("long").alias("n_lines"), links.alias("n_links"), F.size(removed).alias("n_removed"), F.sha2(F.array_join(removed, ","), 256).alias("removed_sha256"), "lines")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = rows.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")))
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns = chat.canonical_turns(records).select("conv_id", "turn", F.inline("turns"))
    return chat.digest_chats(staged(chat.format_chats(turns), "chats"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_removals(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judge_contamination(decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op11_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = boosting.score_quality(docs, boosting.fit_quality(docs, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return scored.select("doc_id", (boosting.fold(F.col("doc_id")) == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Escaping adds a character per backslash and per control string, the template 24 per turn.
OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(x) + (length(x) - length(replace(x, '\', ''))) + len(regexp_extract_all(x, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS n
      FROM (SELECT *, role || chr(0) || text AS x FROM t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n - 1 + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_token_store": op2_token_store,
        "op3_line_dedup": op3_line_dedup,
        "op4_simhash": op4_simhash,
        "op5_chat_format": op5_chat_format,
        "op6_url_filter": op6_url_filter,
        "op7_decontaminate": op7_decontaminate,
        "op8_mix_sources": op8_mix_sources,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality": op10_quality,
        "op11_quality_trees": op11_quality_trees,
        "op12_whitening": op12_whitening,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": OP5_SQL, "op6_url_filter": urls.oracle(), "op13_phrases": phrases.SQL}
