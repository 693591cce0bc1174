"""The answer store: lines by model, condition and repetition; what it holds without reading it; appends
that a replay doesn't repeat; and one JSON document replaced as a whole."""

from __future__ import annotations

import json
import math
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ANSWER_SCHEMA, without_nan

PARTS = ("model", "condition", "rep")
#: Fixed value: how often a replacement is tried, a second apart.
TRIES = 30


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or where that is unset and all
    runs on this machine, under a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix=f"{name}-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def append_batch(lines: DataFrame, batch: int, path: str) -> None:
    """Writes a batch's lines under its number. A batch that is written again, as after a lost driver,
    takes its own place, so the store holds it once."""
    without_nan(lines).write.mode("overwrite").partitionBy(*PARTS).json(f"{path}/batch={batch}")


def append_stream(lines: DataFrame, path: str, checkpoint: str):
    """Appends a stream of lines (with columns of PARTS), each micro-batch once, until what is there has
    been read."""
    writer = lines.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """Rows (model, condition, rep, files, bytes) from the names of files alone; no line is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return files.groupBy(*[F.col(c).cast("string" if c != "rep" else "int").alias(c) for c in PARTS]).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def present(listing: DataFrame, models: DataFrame) -> DataFrame:
    """The models asked for (column model) that have a folder."""
    return models.join(listing.select("model").distinct(), "model", "left_semi")


def available(listing: DataFrame) -> DataFrame:
    """The repetitions that each model and condition has, in order."""
    return listing.groupBy("model", "condition").agg(F.array_sort(F.collect_set("rep")).alias("reps"))


def answers_of(spark: SparkSession, path: str, models: Iterable[str], conditions: Iterable[str] | None = None) -> DataFrame:
    """Lines of some models and conditions; folders of others are not listed among the files read."""
    named = {f.split()[0] for f in ANSWER_SCHEMA.split(", ")}
    kept = ", ".join([*(f for f in ANSWER_SCHEMA.split(", ") if f.split()[0] not in PARTS), "batch int, model string, condition string, rep int"])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where(F.col("model").isin(*models))
    rows = rows if conditions is None else rows.where(F.col("condition").isin(*conditions))
    return rows.where("key is not null").select(*[c for c in rows.columns if c in named and c != "_corrupt_record"], "batch")


def plain_json(value):
    """A value as JSON has it: numbers that are none as null, other number types as Python's."""
    if isinstance(value, dict):
        return {str(k): plain_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain_json(v) for v in value]
    value = value.item() if hasattr(value, "item") else value
    return None if isinstance(value, float) and not math.isfinite(value) else value


def replace_json(spark: SparkSession, document, path: str, tries: int = TRIES, wait: float = 1.0) -> None:
    """Puts one JSON document, keys sorted, in a file's place at once: it is written beside it and renamed
    over it through the file system of the path, again if that is refused for a while. Readers see the old
    document or the new one. For result sets that fit the driver."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    system, context = target.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    system.mkdirs(target.getParent())
    out = system.create(beside, True)
    try:
        out.write(bytearray(json.dumps(plain_json(document), indent=2, sort_keys=True, allow_nan=False).encode()))
    finally:
        out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    for turn in range(tries):
        try:
            context.rename(beside, target, rename)
            return
        except Exception:
            if turn == tries - 1:
                system.delete(beside, False)
                raise
            time.sleep(wait)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document written by replace_json, as one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def freeze_inputs(spark: SparkSession, requests: DataFrame, path: str) -> None:
    """Requests as JSON lines by condition, and a manifest of them: a row count for each condition; names that
    begin with an underscore tell about the manifest itself."""
    without_nan(requests).write.mode("overwrite").partitionBy("condition").json(f"{path}/requests")
    counts = {r["condition"]: r["n"] for r in requests.groupBy("condition").agg(F.count("*").alias("n")).collect()}
    replace_json(spark, {**counts, "_conditions": len(counts)}, f"{path}/manifest.json")


def conditions_of(spark: SparkSession, path: str) -> list[str]:
    """The conditions that a manifest names, in order."""
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()["value"]
    return sorted(c for c in json.loads(text) if not c.startswith("_"))


def load_inputs(spark: SparkSession, path: str, conditions: Iterable[str], schema: str) -> DataFrame:
    """Frozen requests of some conditions; files of others aren't read."""
    return spark.read.schema(f"{schema}, condition string").json(f"{path}/requests").where(F.col("condition").isin(*conditions))
