"""A corpus pipeline of five stages: language ID, line dedup, near duplicates, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``; rows they keep carry the stage's decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.llm import jaccard, langid, mixing, packing, windows
from paralex.llm.common import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text less like every learned language than this is in none of them: texts of known languages score 0.35 or more,
#: other scripts, random letters and encoded data less than 0.2.
LEAST_SCORE = 0.2
TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: a predicted one, with LEAST_SCORE or more.

    A null or empty text, and one without letters, goes.  A null lang becomes the predicted one.  Where no language can
    be learned nothing is rejected.  Repeated rows are judged alike.
    """
    docs = docs.select(COLUMNS)
    profiles = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if not profiles:
        return docs
    out = langid.predict(docs, profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; n_chars is that of the text left.

    A document of which no more than white space is left, after a removal, goes; a null text stays null.
    """
    out = windows.line_dedup(docs.select(COLUMNS))
    left = F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where((F.col("n_removed") == 0) | left)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    changed = F.col("n_removed") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) one document stays: the least doc_id,
    nulls last; of rows that share it, the one whose text has the least hash.

    Rows are told apart by doc_id and text, so a null doc_id, or one that several texts have, is judged like any other.
    Documents without words link with nothing and stay.  Repeated rows become one.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    docs = docs.select(COLUMNS)
    groups = jaccard.jaccard_groups(docs.select(row.alias("doc_id"), "text"), shingle=5, percent=80)
    members = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")
    heads = stash(docs.select("doc_id", row).join(members, "row").groupBy("component").agg(first).select("row"), "heads")
    kept = docs.withColumn("row", row).join(heads, "row", "left_semi")
    return kept.dropDuplicates(["row", "doc_id", "text"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0, 1 or 2 times, so that sources near their target weights."""
    out = mixing.mix_sources(docs.select(COLUMNS), weights=(3, 1, 2), share=1.5, most=2.0)
    return out.where("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).select(COLUMNS)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.best_fit_pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), capacity=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("best_fit_pack", best_fit_pack),
]

#: SQL can't express a trained classifier, nor tokenization: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
