"""Append-only answer logs: last line wins, resumption, alignment with gold labels, accounting, cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.quantiles import quantiles, same

#: Fixed value: dollars for a million input tokens of the hosted service.
PRICE = 0.042


def last_lines(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest line of each key: a grouped maximum, so lines of one key never need one sorted task."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*key, "x.*")


def answered(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest line without an error of each key."""
    return last_lines(log.where("error is null"), key, order)


def to_do(requests: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Requests without a good line: what a resumed run still has to ask."""
    return requests.join(log.where("error is null").select(*key).distinct(), key, "left_anti")


def failed_only(log: DataFrame, key: list[str]) -> DataFrame:
    """Keys all of whose lines are errors."""
    return log.groupBy(*key).agg(F.count("*").alias("lines"), F.max(F.col("error").isNull()).alias("ok")).where("not ok").select(*key, "lines")


def accounting(log: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Lines, keys, answered keys, error lines, superseded good lines, and keys that never succeeded."""
    keys = log.groupBy(*by, *key).agg(F.count("*").alias("lines"), F.count_if(F.col("error").isNull()).alias("good"))
    return keys.groupBy(*by).agg(
        F.sum("lines").alias("lines"), F.count("*").alias("keys"), F.count_if(F.col("good") > 0).alias("answered"), F.sum(F.col("lines") - F.col("good")).alias("errors"),
        F.sum(F.greatest(F.col("good") - 1, F.lit(0))).alias("superseded"), F.count_if(F.col("good") == 0).alias("never"))


def aligned(requests: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their probabilities in option order.

    requests: key, options array<string>, label. answers: key, probs map<string,double>. An option
    without a probability has 0, a vector without mass becomes uniform, an unanswered request has a
    null p; y is null where the label is no option.
    """
    rows = requests.join(answers.select(key, "probs"), key, "left")
    p = F.transform("options", lambda o: F.coalesce(F.try_element_at(F.col("probs"), o), F.lit(0.0)))
    y = F.array_position("options", F.col("label")).cast("int") - 1
    return rows.withColumn("p", F.when(F.col("probs").isNotNull(), V.rescaled(p))).withColumn("y", F.when(y >= 0, y)).drop("probs")


def binary_probs(value: Column, probs: Column) -> Column:
    """A yes/no answer as a map: a scalar, else the map's true or yes."""
    yes = F.coalesce(value, F.try_element_at(probs, F.lit("true")), F.try_element_at(probs, F.lit("yes")))
    return F.when(yes.isNotNull(), F.create_map(F.lit("false"), 1 - yes, F.lit("true"), yes))


def strict_reply(text: Column, options: Column) -> Column:
    """Probabilities in option order from a JSON reply; null if it is none, negatives count as 0, no
    mass as uniform."""
    found = F.from_json(text, "map<string,double>", {"mode": "PERMISSIVE"})
    p = F.transform(options, lambda o: F.greatest(F.coalesce(F.try_element_at(found, o), F.lit(0.0)), F.lit(0.0)))
    return F.when(found.isNotNull(), V.rescaled(p))


def lenient_body(text: Column) -> Column:
    """From the first { to the last } of what follows a closing think mark."""
    return F.regexp_extract(F.substring_index(text, "</think>", -1), r"(?s)\{.*\}", 0)


def latency(log: DataFrame, by: list[str], value: str = "latency_s") -> DataFrame:
    """Count, median, 95th percentile and mean."""
    sums = log.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    at = quantiles(log, by, value, {"p50": 0.5, "p95": 0.95})
    return sums.join(at, same(sums, at, by), "left").select(*[sums[c] for c in by], "n", "p50", "p95", "mean")


def cost(log: DataFrame, by: list[str], tokens: str = "usage_in", price: float = PRICE) -> DataFrame:
    """Tokens, dollars, and dollars for a thousand decisions."""
    out = log.groupBy(*by).agg(F.count("*").alias("decisions"), F.sum(tokens).alias("tokens"))
    spent = F.col("tokens") * F.lit(price) / 1e6
    return out.withColumn("usd", spent).withColumn("usd_per_1000", spent / F.col("decisions") * 1000)


def repeats(runs: DataFrame, key: list[str], rep: str = "rep") -> DataFrame:
    """Every two repetitions of the same decisions: share of changed predictions, mean change of the
    top probability, share identical."""
    a, b = runs.alias("a"), runs.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    pairs = a.join(b, [*same, F.col(f"a.{rep}") < F.col(f"b.{rep}")])
    return pairs.groupBy(F.col(f"a.{rep}").alias("rep_a"), F.col(f"b.{rep}").alias("rep_b")).agg(
        F.count("*").alias("n"), F.avg((F.col("a.pred") != F.col("b.pred")).cast("int")).alias("flip_rate"), F.avg(F.abs(F.col("a.conf") - F.col("b.conf"))).alias("mean_change"), F.avg((F.col("a.conf") == F.col("b.conf")).cast("int")).alias("identical"))


def all_present(df: DataFrame, key: list[str], variant: str, variants: int) -> DataFrame:
    """Keys with every variant, and whether all agree on pred."""
    return df.groupBy(*key).agg(F.count_distinct(variant).alias("v"), F.count_distinct("pred").alias("kinds")).where(F.col("v") == variants).select(*key, (F.col("kinds") == 1).alias("agree"))


def value_counts(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """How often each field has each value, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(*by, pairs.alias("x")).groupBy(*by, F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def request_hash(body: Column) -> Column:
    return F.substring(F.sha2(body, 256), 1, 16)


def frozen(df: DataFrame, by: list[str], body: str, order: str) -> DataFrame:
    """A manifest: rows, and the SHA-256 of the ordered digests of their bodies."""
    digests = df.groupBy(*by).agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(body, 256).alias("d")))).alias("x"))
    return digests.select(*by, "rows", F.sha2(F.array_join(F.col("x.d"), "\n"), 256).alias("sha256"))


#: Rows, or digests, under one digest of the next level; and the levels below the root.
FAN, TREE_LEVELS = 1000, 2


def frozen_tree(df: DataFrame, by: list[str], body: str, order: str, fan: int = FAN, levels: int = TREE_LEVELS) -> DataFrame:
    """A manifest (by, rows, sha256) whose digests merge: of `fan` order numbers the ordered digests of
    their bodies make one, of `fan` of these the next, and so on for `levels`; the root is of what is left.
    So no array holds a condition's rows. order: whole numbers; equal ones go by their digests. A null
    body is empty."""

    def merged(level: DataFrame) -> DataFrame:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_d"))), lambda x: x["_d"])
        return level.groupBy(*by, "_c").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("_d"), F.sum("_n").alias("_n"))

    level = df.select(*by, F.col(order).cast("long").alias("_o"), F.sha2(F.coalesce(F.col(body).cast("string"), F.lit("")), 256).alias("_d"), F.lit(1).cast("long").alias("_n"))
    for _ in range(levels):
        level = merged(level.withColumn("_c", F.floor(F.col("_o") / fan))).withColumnRenamed("_c", "_o")
    return merged(level.withColumn("_c", F.lit(0))).select(*by, F.col("_n").alias("rows"), F.col("_d").alias("sha256"))


def replayed(manifest: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, status) of a manifest beside one of what was made again: same, changed, missing, new."""
    a, b = manifest.select(*by, F.struct("rows", "sha256").alias("_a")), again.select(*by, F.struct("rows", "sha256").alias("_b"))
    both = a.join(b, by, "full_outer")
    return both.select(*by, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(F.col("_a") == F.col("_b"), "same").otherwise("changed").alias("status"))


def extended(manifest: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """The manifest with new conditions; entries that are there stay, and one that would change is fatal."""
    at = again.join(replayed(manifest, again, by).where("status <> 'missing'"), by)
    fatal = F.raise_error(F.concat(F.lit("a frozen condition changed: "), F.concat_ws(" ", *[F.col(c).cast("string") for c in by]))).cast("string")
    status = F.when(F.col("status") == "changed", fatal).otherwise(F.col("status"))
    new = at.withColumn("status", status).where("status = 'new'").select(*by, "rows", "sha256")
    return manifest.select(*by, "rows", "sha256").unionByName(new)


def resumable(spark, requests: DataFrame, path: str, scorer, schema: str, key: list[str], retries: int = 7) -> int:
    """Scores what `path` has no good line for and appends the lines; returns how many were to do.

    scorer(batch: pandas frame) -> pandas frame of `schema`, with an error column. A failing batch is
    tried again; after `retries` its keys are written as error lines, which the next run asks again.
    """
    import pandas as pd

    try:
        log = spark.read.parquet(path)
        rest = to_do(requests, log, key)
    except Exception as e:  # the first run: nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rest = requests

    def run(batches):
        for batch in batches:
            for turn in range(retries):
                try:
                    yield scorer(batch)
                    break
                except Exception as e:  # noqa: BLE001  any failure of a scorer is a line in the log
                    if turn == retries - 1:
                        out = pd.DataFrame({k: batch[k] for k in key})
                        out["error"] = pd.Series([str(e)[:200]] * len(out), dtype=object, index=out.index)
                        for c in (c.split()[0] for c in schema.split(", ")):
                            if c not in out:
                                out[c] = pd.Series([None] * len(out), dtype=object, index=out.index)
                        yield out[[c.split()[0] for c in schema.split(", ")]]

    n = rest.count()
    if n:
        rest.mapInPandas(run, schema).write.mode("append").parquet(path)
    return n


#: Texts of an error message that make it a refusal, and tokens from which a reply was cut off.
BUDGET_MESSAGES, CUT_OFF = ("head_max_len", "budget"), 768
#: Fixed value: how far a reply's stated probabilities may sum from one.
SUM_WITHIN = 0.01
_ANSWER_LINE = "key string, error string, answers map<string, struct<probs: map<string, double>, raw: struct<usage_out: double, raw_text: string>>>, _corrupt string"
#: What JSON text of an error field counts as no error.
NO_ERROR = ("", "null", "false", "0", "0.0", "{}", "[]")


def failures(lines: DataFrame, by: list[str], line: str, stated: Column | None = None) -> DataFrame:
    """What became of raw answer lines, by file: lines, answered, answered_keys, errors, refusals,
    unparseable, both (keys with an error and an answer), questions, empty (questions without
    probabilities), and of the models that state probabilities in a reply (`stated`; else null):
    truncated, not_summing, percent_scale.

    A line with an error is not answered; a refusal is an error that names a budget. Blank lines don't
    count; a line that is no JSON object counts as unparseable alone. Truncated replies have used CUT_OFF
    tokens; a reply on a percent scale has a probability over 1. Replies that can't be read count in
    neither of the last two.
    """
    own = F.lit(False) if stated is None else stated
    rows = lines.where(F.trim(F.coalesce(F.col(line), F.lit(""))) != "").select(*by, own.alias("_own"), F.from_json(line, _ANSWER_LINE, {"columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    bad = F.col("x").isNull() | F.col("x._corrupt").isNotNull()
    error = F.when(~F.coalesce(F.trim("x.error"), F.lit("")).isin(*NO_ERROR), F.col("x.error"))
    rows = rows.select(*by, "_own", bad.alias("_bad"), F.when(~bad, F.col("x.key")).alias("_key"), F.when(~bad, error).alias("_error"), F.when(~bad & error.isNull(), F.coalesce(F.map_values("x.answers"), F.array().cast("array<struct<probs:map<string,double>,raw:struct<usage_out:double,raw_text:string>>>"))).alias("_a"))
    stated_p = lambda q: F.transform(F.from_json(q["raw"]["raw_text"], "probabilities array<struct<p: double>>")["probabilities"], lambda x: x["p"])
    whole = lambda p: p.isNotNull() & ~F.exists(p, lambda x: x.isNull())
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    n_of = lambda test: F.coalesce(F.size(F.filter("_a", test)), F.lit(0))
    replies = F.transform("_a", stated_p)
    in_reply = lambda test: F.size(F.filter(replies, lambda p: whole(p) & test(p)))
    measured = rows.select(
        *by, "_own", "_bad", "_key", "_error", F.coalesce(F.size("_a"), F.lit(-1)).alias("_q"),
        n_of(lambda q: q["probs"].isNull() | (F.size(q["probs"]) == 0)).alias("_empty"), n_of(lambda q: F.coalesce(q["raw"]["usage_out"], F.lit(0.0)) >= CUT_OFF).alias("_cut"),
        F.when(F.col("_own") & F.col("_a").isNotNull(), in_reply(lambda p: F.abs(total(p) - 1) > SUM_WITHIN)).otherwise(0).alias("_off"), F.when(F.col("_own") & F.col("_a").isNotNull(), in_reply(lambda p: F.exists(p, lambda x: x > 1))).otherwise(0).alias("_percent"))
    refused = reduce(Column.__or__, [F.contains(F.col("_error"), F.lit(m)) for m in BUDGET_MESSAGES])
    sums = lambda c: F.sum(c).cast("long")
    # Sums by key first, so that keys with both are counted in the same pass over the lines.
    keyed = measured.groupBy(*by, "_own", "_key").agg(
        F.count("*").alias("lines"), F.count_if(F.col("_q") >= 0).alias("answered"), F.count_if(F.col("_error").isNotNull()).alias("errors"), F.count_if(refused).alias("refusals"), F.count_if("_bad").alias("unparseable"),
        F.sum(F.greatest("_q", F.lit(0))).alias("questions"), *[F.sum(c).alias(c) for c in ("_empty", "_cut", "_off", "_percent")])
    only = lambda c: F.when(F.col("_own"), F.col(c))
    found = keyed.groupBy(*by, "_own").agg(
        *[sums(c).alias(c) for c in ("lines", "answered", "errors", "refusals", "unparseable", "questions")], F.count_if((F.col("answered") > 0) & F.col("_key").isNotNull()).alias("answered_keys"),
        F.count_if((F.col("answered") > 0) & (F.col("errors") > 0)).alias("both"), sums("_empty").alias("empty"), *[sums(c).alias(c) for c in ("_cut", "_off", "_percent")])
    return found.select(*by, "lines", "answered", "answered_keys", "errors", "refusals", "unparseable", "both", "questions", "empty", only("_cut").alias("truncated"), only("_off").alias("not_summing"), only("_percent").alias("percent_scale"))


def micro_batches(rows: DataFrame, by: list[str], length: str, tie: str, budget: int) -> DataFrame:
    """Rows with a batch number in their group: by length, cut where the greatest length times the number
    of rows would pass the budget. Each step depends on the last, so a group is folded as one array of
    its lengths; groups are what one worker would batch, not whole tables."""
    kind = "struct<out:array<struct<n:long,t:long,batch:int>>,batch:int,rows:long>"
    start = F.struct(F.array().cast("array<struct<n:long,t:long,batch:int>>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("rows")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        # Lengths ascend, so the row at hand is the longest.
        fresh = (acc["rows"] > 0) & (x["n"] * (acc["rows"] + 1) > budget)
        batch = (acc["batch"] + F.when(fresh, 1).otherwise(0)).cast("int")
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["n"].alias("n"), x["t"].alias("t"), batch.alias("batch")))).alias("out"), batch.alias("batch"), F.when(fresh, 1).otherwise(acc["rows"] + 1).cast("long").alias("rows")).cast(kind)

    listed = F.array_sort(F.collect_list(F.struct(F.col(length).cast("long").alias("n"), F.col(tie).cast("long").alias("t"))))
    folded = rows.groupBy(*by).agg(F.aggregate(listed, start, step)["out"].alias("x"))
    return folded.select(*by, F.explode("x").alias("x")).select(*by, F.col("x.t").alias(tie), F.col("x.n").alias(length), F.col("x.batch").alias("batch"))


def at_utilization(log: DataFrame, by: list[str], seconds: str, price: float, used: float) -> DataFrame:
    """Machine hours, their cost at full use, and at a share of use."""
    hours = F.sum(seconds) / 3600.0
    return log.groupBy(*by).agg(hours.alias("hours"), (price * hours).alias("usd_full"), (price * hours / used).alias("usd_used"))
