"""One query per operator, with production parameters, over its whole table; ORACLE has the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, conversations, decontaminate, langid, lines, minhash, packing, secrets, sql, tokenfiles, toxicity, urls, warc, whiten


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lines.digest(docs, lines.removed_lines(docs))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).drop("file")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(spark, _table(spark, sf_dir, "documents"), _tokenizer())


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversations.digest(turns, conversations.repair(conversations.damage(turns)))


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_warc, op4_secrets, op5_decontamination, op6_near_duplicates, op7_neighbours, op8_language, op9_toxicity, op10_token_files, op11_url_filter, op12_whitening, op13_conversation_repair)}
#: The other operators have no form in SQL: tokenizers, trained models, spans by automata, approximate search.
ORACLE: dict[str, str] = {"op2_line_dedup": sql.LINES, "op3_warc": sql.WARC, "op5_decontamination": sql.DECONTAMINATION, "op6_near_duplicates": sql.NEAR, "op11_url_filter": sql.URLS, "op13_conversation_repair": sql.REPAIR}
