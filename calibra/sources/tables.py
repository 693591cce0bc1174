"""Readers and writers: JSON lines, CSV, cards, documents' schemas, and a source for small workbooks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ANSWER_SCHEMA = "key string, condition string, rep int, model string, error string, latency_s double, usage_in bigint, answers map<string,struct<probs:map<string,double>,raw:string>>, _corrupt_record string"


def read_answers(spark: SparkSession, path: str, schema: str = ANSWER_SCHEMA) -> DataFrame:
    """Answer lines of any depth of folders; unparseable lines are dropped, the file is kept as `file`.

    Within a file lines keep their order by _metadata.file_block_start only where files are whole;
    write a line number to order lines of one key (last line wins).
    """
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file")).where("_corrupt_record is null and key is not null").drop("_corrupt_record")


def write_answers(df: DataFrame, path: str) -> None:
    """Appends lines, by model, condition and repetition, so later scans prune."""
    df.write.mode("append").partitionBy("model", "condition", "rep").json(path)


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV with a header, quoted newlines and doubled quotes; a byte-order mark is dropped; parts of
    different columns are united by name; the file's name is kept as `part`."""
    paths = [paths] if isinstance(paths, str) else sorted(paths)
    frames = [spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(p).select("*", F.col("_metadata.file_name").alias("part")) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.toDF(*[c.lstrip("﻿") for c in out.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every float column, as JSON has none."""
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_json(df: DataFrame, path: str) -> None:
    """One result set, replaced as a whole when the job commits."""
    without_nan(df).write.mode("overwrite").json(path)


def schema_of_table(markdown: str) -> list[str]:
    """Column names from the first column of a Markdown table; `a / b` names two."""
    names = []
    for line in markdown.splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if line.strip().startswith("|") and cells and re.fullmatch(r"`?[a-z0-9_]+`?( / `?[a-z0-9_]+`?)*", cells[0]):
            names += [n.strip().strip("`") for n in cells[0].split("/")]
    return names[1:] if names[:1] == ["column"] else names


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards as rows (card, field, value): top-level `field: value` lines of YAML-like files."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("card"), "value")
    lines = files.select("card", F.explode(F.split("value", "\n")).alias("line"))
    pattern = r"^([A-Za-z_][A-Za-z0-9_]*):\s*(.*?)\s*$"
    found = lines.select("card", F.regexp_extract("line", pattern, 1).alias("field"), F.regexp_extract("line", pattern, 2).alias("value")).where("field <> ''")
    return found.withColumn("value", F.when(F.col("value") == "", None).otherwise(F.regexp_replace("value", "^[\"']|[\"']$", "")))


def entries(xml):
    """(id, title, published) of each entry of an Atom feed."""
    one = lambda tag, s: F.trim(F.regexp_extract(s, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return F.transform(F.filter(F.split(xml, "<entry>"), lambda x, i: i > 0), lambda s: F.struct(one("id", s).alias("id"), one("title", s).alias("title"), one("published", s).alias("published")))


def flattened(json_text: str) -> list[tuple[str, float]]:
    """Numeric leaves of a JSON document by dotted label; keys that begin with _ are left out."""
    out: list[tuple[str, float]] = []

    def walk(node, path: tuple[str, ...]) -> None:
        if isinstance(node, dict):
            for k in sorted(node):
                if not k.startswith("_"):
                    walk(node[k], (*path, k))
        elif isinstance(node, list):
            for i, x in enumerate(node):
                walk(x, (*path, str(i)))
        elif isinstance(node, (int, float)) and not isinstance(node, bool):
            out.append((".".join(path), float(node)))

    walk(json.loads(json_text), ())
    return out


class GridSource(DataSource):
    """`spark.read.format("grid")`: sheets of a workbook saved as JSON {sheet: [[cells]]}, the first row
    of a sheet being its header; rows (sheet, row, column, value)."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "sheet string, row int, column string, value string"

    def reader(self, schema) -> DataSourceReader:
        return GridReader(self.options["path"])


class GridReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with open(self.path, encoding="utf-8") as file:
            return [InputPartition(name) for name in json.load(file)]

    def read(self, partition: InputPartition):
        with open(self.path, encoding="utf-8") as file:
            header, *rows = json.load(file)[partition.value]
        for i, row in enumerate(rows):
            for name, cell in zip(header, row, strict=False):
                yield partition.value, i, str(name), None if cell is None else str(cell)
