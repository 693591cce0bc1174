"""Keys dealt to as many tasks as the rows need, where a fixed number of partitions would let each task grow;
and relations that several jobs read, made once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Rows that a task gets, about.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in tasks of TASK_ROWS rows on average, if it has about `rows` rows; a few rows stay as they
    are. Groupings and joins by these keys need no further shuffle."""
    return df.repartition(-(-rows // TASK_ROWS), *keys) if rows > TASK_ROWS else df


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written under spark.checkpoint.dir, from which each job reads the columns that it
    needs. Where the setting is absent and all runs on this machine, a temporary folder serves."""
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) if folder.isEmpty() else folder.get()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    path = f"{folder or tempfile.mkdtemp(prefix='kept-')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
