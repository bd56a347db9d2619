"""The corpus pipeline: five of the training-data operators, each over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, linededup, packing, registry, simhash
from tessera.llm.common import SPACE, free_name, shared_folder

#: SQL can express neither the language models nor the verified shingle sets nor the packing; tests hold each stage and the whole against brute force.
ORACLE_SQL = None
#: A language is told if it has so much of the probability, code lengths taken per 64 bytes.
LEAST_SCORE = 0.75
#: Near-duplicates: words of a shingle, the Jaccard similarity from which on documents are linked, and the bits in which near fingerprints may differ.
SHINGLE, LEAST_SIMILARITY, BITS_APART = 5, 0.8, 4
#: Words whose ids a worker remembers: fewer than when packing is all that it does, as it keeps them through the other stages too.
REMEMBERED_WORDS = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null texts, those without letters, and those whose best language has less than LEAST_SCORE of the probability
    (texts of a word or two). Columns of docs, whatever their names. Equal rows stay or go together; an empty table stays empty."""
    told = free_name(docs, "_lang")
    out = langid.identify_languages(docs, langid.train(docs.select("doc_id", "text", "lang")), told)
    return out.filter((F.col(f"{told}.pred") != langid.UNDETERMINED) & (F.col(f"{told}.score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop shared lines; documents of which nothing but white space is left go. Columns of docs, whatever their names, with text and n_chars (if there) made anew
    where lines went. A null text stays; equal rows stay or go together; an empty table stays empty."""
    lines = free_name(docs, "_lines")
    out = linededup.drop_shared_lines(docs, into=lines)
    kept, some = F.col(f"{lines}.kept"), F.col(f"{lines}.dropped").isNotNull()
    new = {"text": F.when(some, kept).otherwise(F.col("text")), "n_chars": F.when(some, F.char_length(kept).cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else None)}
    return out.filter(~some | (F.btrim(kept, F.lit(SPACE)) != "")).select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked by 5-word shingles with a Jaccard similarity of 0.8 or more, the document with the smallest doc_id stays: SimHash
    fingerprints and their blocks give the near pairs, an exact check follows, and a prefix filter finds the links that fingerprints can't. Rows of equal doc_id stay or
    go together, and so do those without one. Columns of docs, whatever their names; an empty table stays empty."""
    groups = simhash.similar_documents(docs.select("doc_id", "text"), SHINGLE, LEAST_SIMILARITY, BITS_APART)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stays"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage. Columns of docs, whatever their names. Null and empty texts stay; equal rows stay or go together; an empty table
    stays empty."""
    hits = free_name(docs, "_hits")
    out = decontamination.decontaminate(docs, registry.table(spark, sf_dir, "benchmark"), registry.WINDOW, into=hits)
    return out.filter(F.col(f"{hits}.n_hit") == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequences; nulls, repeats and empty tables as in best_fit_packing()."""
    return packing.best_fit_packing(docs.select("doc_id", "text"), registry.vocabulary(), registry.CAPACITY, registry.END_ID, REMEMBERED_WORDS)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again. An empty table gives no rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
