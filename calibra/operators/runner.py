"""Answer services by name, runs of them in chunks under a limit of spending, and answer files of baselines.

A service is an object with answer(record) -> {"model_returned", "usage_in", "answers": {question:
{option: probability}}}. It may have prefetch(records), called with a whole batch before its records are
asked one by one. Factories, not services, are registered, and each task makes its own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ranking import running
from . import answers

_FACTORIES: dict[str, Callable[[], object]] = {}

#: Distinct pairs up to which their scores are broadcast; beyond, the join is shuffled.
FEW = 1_000_000


def register(name: str, factory: Callable[[], object]) -> None:
    _FACTORIES[name] = factory


def registered() -> list[str]:
    return sorted(_FACTORIES)


def scorer(name: str, key: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of batches that asks the named service: rows of key, model_returned, usage_in, answers
    (JSON) and error. The factory is looked up here, so executors need no registry."""
    if name not in _FACTORIES:
        raise KeyError(f"no service named {name!r}; there are {registered()}")
    factory, made = _FACTORIES[name], []

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(factory())
        service, records = made[0], batch.to_dict("records")
        if hasattr(service, "prefetch"):
            service.prefetch(records)
        lines = []
        for r in records:
            found = service.answer(r)
            lines.append([*[r[k] for k in key], found.get("model_returned"), found.get("usage_in"), json.dumps(found["answers"], sort_keys=True), None])
        return pd.DataFrame(lines, columns=[*key, "model_returned", "usage_in", "answers", "error"])

    return score


def line_schema(requests: DataFrame, key: list[str]) -> str:
    kinds = dict(requests.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in key) + ", model_returned string, usage_in long, answers string, error string"


def asked(requests: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Lines of all requests, unwritten; a failing service fails the task, which is tried again."""
    score = scorer(name, key)
    return requests.mapInPandas(lambda batches: (score(b) for b in batches), line_schema(requests, key))


def run_within(spark: SparkSession, requests: DataFrame, path: str, name: str, key: list[str], limit: float, chunk: int = 500, price: float = answers.PRICE) -> tuple[int, float]:
    """Asks the service for what `path` has no good line for, about `chunk` requests at a time, and stops
    after the chunk that brought what was spent (all lines of `path`) over `limit` dollars.

    Returns the chunks run and the dollars spent. A stopped or lost run goes on where it was: each chunk
    is an append, and answered keys are not asked again.
    """
    chunks = max(1, -(-requests.count() // chunk))
    dealt = requests.withColumn("_chunk", F.pmod(F.xxhash64(*key), F.lit(chunks)))
    score, schema, spent, done = scorer(name, key), line_schema(requests, key), 0.0, 0
    for i in range(chunks):
        if answers.resumable(spark, dealt.where(F.col("_chunk") == i).drop("_chunk"), path, score, schema, key):
            done += 1
            spent = (spark.read.parquet(path).agg(F.sum("usage_in")).first()[0] or 0) * price / 1e6
            if spent > limit:
                break
    return done, spent


def chunks_within(rows: DataFrame, chunk: str, tokens: str, chunks: int, limit: float, price: float = answers.PRICE) -> DataFrame:
    """Chunks 0 to chunks - 1 of a planned run with their tokens, what is spent after each, and whether it is
    run: the first to pass `limit` dollars is the last."""
    at = running(rows.select((F.col(chunk) / F.lit(chunks)).alias("_c"), F.col(tokens).alias("tokens")), [], "_c", ["tokens"], descending=False)
    spent = F.col("c_tokens") * F.lit(price) / 1e6
    return at.select(F.round(F.col("_c") * chunks).cast("long").alias(chunk), "tokens", spent.alias("spent"), ((F.col("c_tokens") - F.col("tokens")) * F.lit(price) / 1e6 <= limit).alias("run"))


def baseline_lines(dec: DataFrame, request: str, question: str, options: Column, temperature: Column | None = None, model: str = "baseline") -> DataFrame:
    """(request, line): one JSON answer line for each request, its questions' distributions as served, and
    with a fitted temperature beside it and what that makes of them, where there is one (a temperature of 1
    leaves them as they are). A request is one line of the format, so its questions meet in one row."""
    as_map = lambda p: F.map_from_arrays(options, p)
    raw = [F.lit(1.0).alias("served_temperature"), as_map(F.col("p")).alias("probs_t1")]
    if temperature is not None:
        raw += [temperature.alias("fitted_temperature"), F.when(temperature == 1, as_map(F.col("p"))).when(temperature.isNotNull(), as_map(V.tempered(F.col("p"), temperature))).alias("probs_scaled")]
    body = F.struct(as_map(F.col("p")).alias("probs"), F.struct(*raw).alias("raw"))
    rows = dec.select(F.col(request).alias("_r"), F.col(question).cast("string").alias("_q"), body.alias("_b"))
    found = rows.groupBy("_r").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_q", "_b")), lambda a, b: F.when(a["_q"] < b["_q"], -1).when(a["_q"] > b["_q"], 1).otherwise(0))).alias("answers"))
    line = F.to_json(F.struct(F.col("_r").cast("string").alias("key"), F.lit(1).alias("rep"), F.lit(model).alias("model"), F.lit(1.0).alias("served_temperature"), "answers"))
    return found.select(F.col("_r").alias(request), line.alias("line"))


_LINE = "key string, model string, answers map<string, struct<probs: map<string, double>, raw: struct<served_temperature: double, fitted_temperature: double, probs_t1: map<string, double>, probs_scaled: map<string, double>>>>"


def read_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(key, model, question, probs, fitted_temperature, probs_scaled) of answer lines; a line that is no
    JSON gives no row."""
    found = lines.select(F.from_json(line, _LINE).alias("x")).select("x.key", "x.model", F.explode("x.answers").alias("question", "a"))
    return found.select("key", "model", "question", "a.probs", "a.raw.fitted_temperature", "a.raw.probs_scaled")


def fitted_temperatures(read: DataFrame, gold: DataFrame, question: str = "question", kind: str = "type") -> DataFrame:
    """(type, temperature) that the lines carry: of each type the first by key and question."""
    rows = read.where("fitted_temperature is not null").join(gold.select(F.col(question).cast("string").alias("question"), F.col(kind).alias(kind)), "question")
    return rows.groupBy(kind).agg(F.min_by("fitted_temperature", F.struct("key", "question")).alias("temperature"))


def entailed(pairs: DataFrame, key: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, p): softmax of the entailment of each option's hypothesis. pairs: key, option (its place),
    premise, hypothesis. score adds a column logit to distinct pairs, each of which it sees once however
    many decisions ask it; it runs once. A pair with a null text or logit leaves its decision out."""
    texts = ["premise", "hypothesis"]
    rows = pairs.withColumn("_k", F.sha2(F.to_json(F.struct(*texts)), 256))
    distinct = rows.dropna(subset=texts).groupBy("_k").agg(*[F.first(t).alias(t) for t in texts])
    known = score(distinct).select("_k", "logit").persist(StorageLevel.MEMORY_AND_DISK)
    side = F.broadcast(known) if known.count() <= FEW else known
    met = rows.join(side, "_k", "left")
    found = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("option", "logit"))).alias("x"), F.count_if(F.col("logit").isNull()).alias("_gone")).where("_gone = 0")
    top = F.array_max("x.logit")
    return found.select(*key, V.rescaled(F.transform("x.logit", lambda v: F.exp(v - top))).alias("p"))


def iso_day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def utc_stamp(moment: Column) -> Column:
    """ISO 8601 with a Z; timestamps without a zone are taken as UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Tries of a request, the longest wait between two in seconds, and what names a failure that
#: may pass.
ATTEMPTS, LONGEST_WAIT = 7, 30.0
PASSING = ("429", "529", "502", "503", "Timeout", "Connect", "RemoteProtocol")


def patient(answer: Callable[[dict], dict], concurrency: int = 1, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A scorer of a batch from a service that answers one request: `concurrency` requests at a time in a
    task; a failure that may pass is tried again after 1, 2, 4, ... seconds, any other is not. A request
    that fails for good is an error line of its own; the others of its batch keep their answers."""

    def one(request: dict) -> dict:
        for turn in range(attempts):
            began = time.perf_counter()
            try:
                return {**request, **answer(request), "latency_s": round(time.perf_counter() - began, 4), "error": None}
            except Exception as e:  # noqa: BLE001  any failure of a service is a line in the log
                said = repr(e)
                if not any(mark in said for mark in PASSING):
                    break
                if turn < attempts - 1:
                    wait(min(2.0**turn, LONGEST_WAIT))
        return {**request, "latency_s": None, "error": said[:500]}

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        with ThreadPoolExecutor(concurrency) as pool:
            return pd.DataFrame(list(pool.map(one, rows.to_dict("records"))))

    return batch


def run_requests(requests: DataFrame, answer: Callable[[dict], dict], schema: str, concurrency: int = 1, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answer lines of requests, in columns of schema (the request's, the answer's, latency_s, error);
    as many tasks as partitions ask at once, each `concurrency` requests."""
    score, names = patient(answer, concurrency, attempts, wait), [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield score(rows).reindex(columns=names)

    return requests.mapInPandas(run, schema)
