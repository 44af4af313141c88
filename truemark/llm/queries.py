"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truemark.llm import chat, language, line_dedup, media, mixing, near_dedup, packing, quality, quality_rules, token_files, toxicity, vector_codes, whitening
from truemark.llm.common import id_bucket, table, written
from truemark.llm.oracles import ORACLES


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.by_position(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_bucket(F.col("doc_id"), 4) == 2)
    field = toxicity.learn(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, field).select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode_media(media.encode_media(table(spark, sf_dir, "documents")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_bucket(F.col("doc_id"), 5) == 0)
    known = language.learn_dictionaries(docs.where("not held_out"))
    return language.identify(docs.drop("lang"), known).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_bucket(F.col("doc_id"), 5) == 0)
    model = quality.learn(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    summed = vector_codes.label_errors(written(coded, "vector-codes"))
    return summed.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebook_digest(books)).alias("codebooks_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_tokens(table(spark, sf_dir, "documents"), byte_tokenizer())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mix_sources, op2_near_dedup, op3_toxicity, op4_media, op5_language, op6_line_dedup, op7_chat, op8_packing, op9_quality, op10_quality_rules, op11_vector_codes, op12_token_files, op13_whitening)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
