"""Columns that bear the names of inner ones change no operator's and no stage's rows."""

from __future__ import annotations

import pytest
from helpers import documents
from pyspark.sql import functions as F

import corpus_pipeline
from calibra.llm import decontam, embedding, hmm_lm, interaction, langid, license_scan, line_dedup, ngram_join, packing, pii, quality, resampling, substring

SF = "/root/testdata/sf0.001"
NAMES = "d m n at item item_id size word words w g gram cls root component part held_out score predicted n_words n_features weight rank symbols rare count directory row s x b _1 clean_text kept_text simhash start quality toxic"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and ran away from the dog.", "clash"), (None, None, "clash")], "item_id long, text string, key string")


def path(docs):
    return docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


OPERATORS = {
    "ngram_join": lambda s, d: ngram_join.near_duplicates(d).select("doc_id", "n_shingles", "component_id"),
    "packing": lambda s, d: packing.pack(d, "/opt/tokenizers/byte_bpe_50k.json").select("doc_id", "piece", "start", "length", "ids_crc32"),
    "langid": lambda s, d: langid.identify(d),
    "hmm_lm": lambda s, d: hmm_lm.score(d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 3)),
    "license_scan": lambda s, d: license_scan.scan(path(d)),
    "line_dedup": lambda s, d: line_dedup.remove_repeated_lines(d).select("doc_id", "n_lines", "n_removed", "kept_text"),
    "decontam": lambda s, d: decontam.contaminated(d, benchmark(s)),
    "pii": lambda s, d: pii.find(d),
    "substring": lambda s, d: substring.remove_repeats(d),
    "quality": lambda s, d: quality.clean(d, with_text=True),
    "embedding": lambda s, d: embedding.classify(d, labels(s)),
    "interaction": lambda s, d: interaction.audit(d, labels(s)),
    "resampling": lambda s, d: resampling.resample(d, benchmark(s)),
}


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def clashing(docs):
    return docs.select("*", *[F.lit("clash").alias(c) for c in NAMES.split()])


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    docs, run = documents(spark), OPERATORS[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = rows(run(spark, clashing(docs)))
    assert got and got == rows(run(spark, plain))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, name):
    docs, stage = documents(spark), dict(corpus_pipeline.STAGES)[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = stage(spark, clashing(docs), SF)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    assert rows(got) == rows(stage(spark, plain, SF))
