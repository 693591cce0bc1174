"""Relations derived from the supplied tables: decisions, an answer log, ratings, an option design.

Probabilities are quotients of whole-number weights, so any engine gets the same doubles. Each
relation has its DuckDB form beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import draw, draw_sql

#: Synthetic models and the weight each gives the right option.
MODELS = {"alpha": 850, "beta": 550, "gamma": 250}
OPTIONS = ("F", "O", "P")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, ord, item, grp, type, y, p, in_scope, rep, latency_s, usage_in: one row for each order and model."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    models = spark.createDataFrame(list(MODELS.items()), "model string, signal int")
    rows = orders.crossJoin(F.broadcast(models))  # three models, fixed
    y = F.array_position(F.array(*map(F.lit, OPTIONS)), F.col("o_orderstatus")).cast("int") - 1
    rows = rows.withColumn("y", y)
    weights = F.array(*[draw("p", F.col("model"), F.col("o_orderkey"), k) % 1000 + 1 + F.when(F.col("y") == k, F.col("signal")).otherwise(0) for k in range(3)])
    return rows.withColumn("w", weights).select(
        "model",
        F.col("o_orderkey").alias("ord"),
        F.col("o_orderkey").alias("item"),
        F.col("o_custkey").alias("grp"),
        F.substring("o_orderpriority", 1, 1).alias("type"),
        "y",
        F.transform("w", lambda x: x.cast("double") / F.aggregate("w", F.lit(0).cast("long"), lambda a, z: a + z).cast("double")).alias("p"),
        (F.col("o_custkey") % 10 != 0).alias("in_scope"),
        ((draw("lat", F.col("model"), F.col("o_orderkey")) % 900 + 100) / 1000.0).alias("latency_s"),
        (draw("use", F.col("o_orderkey")) % 400 + 50).alias("usage_in"),
    )


def judged(dec: DataFrame) -> DataFrame:
    """Decisions with pred, conf and correct (0 or 1)."""
    return dec.withColumn("pred", V.argmax(F.col("p"))).withColumn("conf", F.array_max("p")).withColumn("correct", (F.col("pred") == F.col("y")).cast("int"))


_W = ", ".join(f"{draw_sql(repr('p'), 'm.model', 'o_orderkey', str(k))} % 1000 + 1 + case when y = {k} then m.signal else 0 end as w{k}" for k in range(3))
_M = ", ".join(f"('{m}', {s})" for m, s in MODELS.items())
#: DuckDB: dec(model, ord, item, grp, type, y, p0, p1, p2, pred, conf, correct, in_scope, latency_s, usage_in).
DEC_SQL = f"""
o as (select *, case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 end as y from orders),
w as (select o.*, m.model, {_W} from o, (values {_M}) m(model, signal)),
q as (select *, w0::double / (w0 + w1 + w2)::double as p0, w1::double / (w0 + w1 + w2)::double as p1, w2::double / (w0 + w1 + w2)::double as p2 from w),
dec as (select model, o_orderkey as ord, o_orderkey as item, o_custkey as grp, substr(o_orderpriority, 1, 1) as type, y, p0, p1, p2, greatest(p0, p1, p2) as conf,
  case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as pred,
  (case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end = y)::int as correct, o_custkey % 10 <> 0 as in_scope,
  ({draw_sql(repr('lat'), 'model', 'o_orderkey')} % 900 + 100) / 1000.0::double as latency_s, {draw_sql(repr('use'), 'o_orderkey')} % 400 + 50 as usage_in from q)
"""
