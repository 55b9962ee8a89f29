"""The corpus pipeline: stages of the training-data operators, each over all
that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, doc_bucket, table
from tallyspark.llm.decontaminate import find_contamination
from tallyspark.llm.language import identify, train
from tallyspark.llm.line_dedup import dedup_lines
from tallyspark.llm.packing import pack
from tallyspark.llm.queries import tokenizer_path
from tallyspark.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the trees tell; those without a letter, or
    torn between languages, go."""
    held = F.coalesce(doc_bucket("doc_id", 3) == 1, F.lit(False))
    model = train(docs.filter(~held), "text", "lang", "doc_id")
    return (identify(docs, model, COLUMNS).filter("lang_pred != 'und' AND score >= 0.5").select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents keep."""
    out = dedup_lines(docs, carry=["doc_id", "lang", "source"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.length("kept_text").cast("long").alias("n_chars"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    found = near_duplicates(docs)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stay")), "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows cover less than a twentieth."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.filter("NOT (n_hit > 0 AND 20 * n_hit >= n_words)").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places."""
    return pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

#: fitted trees, XXH64 fingerprints and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; each result is written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
