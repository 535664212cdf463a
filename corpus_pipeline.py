"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet to the
shared folder and reads it back as the next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import decontaminate, langid, lines, minhash, packing, work

#: Below this share of known n-grams a text is in none of the learned languages.
LEAST_SHARE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those in no language that the labelled documents teach.

    Null, empty and letterless texts go, repeated rows all stay or all go, a null doc_id is as any other. Where no row
    has a language to learn from, texts with a letter stay.
    """
    filters = langid.fit(docs)
    whole = docs.select("doc_id", F.struct(*docs.columns).alias("_row"))
    found = langid.predict(whole, filters, ("_row",), "_row").filter(F.col("_row.text").rlike(r"\p{L}"))
    if filters.languages:
        found = found.filter(F.col("score") >= LEAST_SHARE)
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that an earlier line resembles; a document that this leaves blank goes.

    Documents that lose no line stay as they are, null and empty texts, too; rows that share a doc_id lose the lines at
    the same places.
    """
    return lines.without_lines(docs, lines.removed_lines(docs), keep_blank=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the smallest doc_id.

    Null, empty and blank texts have no copies and stay, as does a null doc_id. Of rows with one doc_id, one of each
    text stays, if any of them does.
    """
    kept = minhash.near_duplicates(docs).filter("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(*docs.columns).alias("_row"))
    left = own.join(kept.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")))
    alone = (F.col("_n") == 1) | F.col("_doc").isNull() | F.col("_row.text").isNull()
    again = left.filter(~alone).withColumn("_text", F.sha2("_row.text", 256)).dropDuplicates(["_doc", "_text"])
    return left.filter(alone).select("_row.*").union(again.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; documents that are mostly such passages go.

    Null texts and those without a hit stay as they are, repeated rows are treated each; without a benchmark item all stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2,048 ids: a row for each piece of a document; null texts are one end mark, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), lean=True)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
#: Language ID and tokenizing have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        start = work.tables()
        done = work.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        own = set(done.inputFiles())
        work.release(spark, [p for p in work.tables() if p not in start and not any(p in f for f in own)])
        docs = done
    return docs
