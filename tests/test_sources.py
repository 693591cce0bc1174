from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from calibra.operators import answers
from calibra.sources import tables
from calibra.streaming.answers import last_wins, windowed_accounting


def test_cards(spark, tmp_path):
    (tmp_path / "a__b.yaml").write_text("name: 'B'\nsize: 3\nempty:\nsize_src:\n  quote: x\n")
    got = {(r["card"], r["field"]): r["value"] for r in tables.read_cards(spark, str(tmp_path)).collect()}
    assert got == {("a__b", "name"): "B", ("a__b", "size"): "3", ("a__b", "empty"): None, ("a__b", "size_src"): None}


def test_csv_parts_with_mark_and_different_columns(spark, tmp_path):
    (tmp_path / "p1.csv").write_text("﻿a,b\n1,\"x\ny\"\n", encoding="utf-8")
    (tmp_path / "p2.csv").write_text("a,c\n2,\"say \"\"hi\"\"\"\n")
    got = tables.read_csv(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "p2.csv")]).orderBy("a").collect()
    assert [r["a"] for r in got] == ["1", "2"] and got[0]["b"] == "x\ny" and got[1]["c"] == 'say "hi"' and got[1]["part"] == "p2.csv"


def test_schema_of_a_markdown_table():
    assert tables.schema_of_table("| column | what |\n|---|---|\n| `row_id` | id |\n| a / b | two |\n") == ["row_id", "a", "b"]


def test_grid_source(spark, tmp_path):
    path = tmp_path / "book.json"
    path.write_text(json.dumps({"s": [["a", "b"], [1, None]], "t": [["c"]]}))
    spark.dataSource.register(tables.GridSource)
    got = spark.read.format("grid").option("path", str(path)).load().collect()
    assert sorted((r["sheet"], r["row"], r["column"], r["value"]) for r in got) == [("s", 0, "a", "1"), ("s", 0, "b", None)]


def test_flattened_and_nan():
    assert tables.flattened('{"b": [1, {"c": 2.5}], "_x": 3, "a": true}') == [("b.0", 1.0), ("b.1.c", 2.5)]


def test_nan_is_written_as_null(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "x double, k int")
    assert tables.without_nan(df).first()["x"] is None


def test_resumable_asks_only_what_is_missing(spark, tmp_path):
    requests = spark.range(6).select(F.col("id").alias("key"))
    path = str(tmp_path / "log")
    schema = "key long, value double, error string"

    def fails_on_odd(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"], "value": 1.0, "error": [None if k % 2 == 0 else "odd" for k in batch["key"]]})

    assert answers.resumable(spark, requests, path, fails_on_odd, schema, ["key"]) == 6
    assert answers.resumable(spark, requests, path, fails_on_odd, schema, ["key"]) == 3
    assert answers.answered(spark.read.parquet(path), ["key"], "value").count() == 3


def test_streams(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00", None, 1.0), (1, "2026-01-01 00:00:01", None, 1.0), (2, "2026-01-01 02:00:00", "x", 3.0)]
    spark.createDataFrame(rows, "key int, t string, error string, latency_s double").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    schema = "key int, t timestamp, error string, latency_s double"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    windowed_accounting(stream, "t", "key").writeStream.format("memory").queryName("w1").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r["lines"] for r in spark.table("w1").orderBy("start").collect()] == [1, 1]
    last_wins(stream, "key", "t").writeStream.format("memory").queryName("w2").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w2").count() == 2
