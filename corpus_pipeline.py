"""A corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import decontam, langid, line_dedup, ngram_join, packing
from calibra.llm.runtime import cut, semi, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a language predicted less surely than this go.
LEAST_SCORE = 0.5


def identified(docs: DataFrame) -> DataFrame:
    """docs with d and key, which tell rows apart: the id, LAST if null, and the text's hash."""
    return docs.withColumn("d", F.coalesce("doc_id", F.lit(line_dedup.LAST))).withColumn("key", F.xxhash64("text"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined surely enough, each with the predicted one as lang.

    Rows are judged one by one: repeated rows and null ids like others, ties go to the first language
    by name; null, empty and letterless texts go.
    """
    found = langid.identify(docs, carry=("text", "source", "n_chars"))
    return found.where(f"lang_pred <> '{langid.UNDETERMINED}' and score >= {LEAST_SCORE}").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines or of passages of one or two lines; documents left
    without a word go, as do null and empty texts.

    Earlier is by (doc_id, place), a null doc_id last; rows of one doc_id and text are one document,
    so repeated rows lose the same lines.
    """
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "doc_id", "text")
    found = line_dedup.remove_repeated_lines(keyed, carry=("row",), words=line_dedup.PASSAGE_WORDS)
    kept = found.where(F.col("kept_text").rlike(line_dedup.WORD))
    return kept.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.length("kept_text").cast("long").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id, a null one last, then of least
    text hash; of repeated rows one. Rows of one doc_id and different texts are different documents;
    null and empty texts are in no group and stay.
    """
    found = ngram_join.near_duplicates(docs).where("component is not null").withColumn("d", F.coalesce("doc_id", F.lit(line_dedup.LAST)))
    rows = cut(found.groupBy("component", "d", "key").agg(F.count("*").alias("m")))
    first = cut(rows.groupBy("component").agg(F.min(F.struct("d", "key", "m")).alias("f"), F.count("*").alias("of")))
    gone = rows.join(first.where("of > 1"), "component").where("d <> f.d or key <> f.key").select("d", "key")
    again = cut(first.where("f.m > 1").select("f.d", "f.key"))
    kept = semi(identified(docs), cut(gone), ["d", "key"], "left_anti")
    # Only repeated rows meet; texts of other documents stay where they are.
    once = semi(kept, again, ["d", "key"], "left_anti")
    return once.unionByName(semi(kept, again, ["d", "key"]).dropDuplicates(["d", "key"])).select(*COLUMNS)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item; repeated rows and null ids are judged like
    others, null and empty texts stay."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = found.select(F.coalesce("doc_id", F.lit(line_dedup.LAST)).alias("d"), "key").distinct()
    return semi(identified(docs), cut(found), ["d", "key"], "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; rows are packed as often as given, null
    and empty texts as their end alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", keep_language), ("line_dedup", remove_lines), ("near_duplicates", one_of_each), ("decontamination", clean_of_benchmarks), ("packing", packed)]

#: Packing and language identification can't be stated in SQL; tests/llm holds each stage against a
#: plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
