"""Registered queries: the answer store, replaced documents, documents and prompts in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.documents import flattened, parsed_prompt
from ..operators import answers, design
from ..sources import store
from .derived import table
from .evaluation import _r
from .records import _log, answer_log


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as answer lines; a line's batch is its number by two."""
    log = answer_log(spark, sf_dir)
    key, model = F.col("line_no").cast("string"), F.concat(F.lit("m"), F.col("model").cast("string"))
    return log.select(key.alias("key"), model.alias("model"), F.col("kind").alias("condition"), (F.col("key") % 2 + 1).cast("int").alias("rep"), "error", "latency_s", "usage_in", (F.col("line_no") % 2).alias("of"))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The store after both batches, the first of which was written twice."""
    path, lines = store.scratch(spark, "store"), _lines(spark, sf_dir)
    for batch in (0, 1, 0):
        store.append_batch(lines.where(F.col("of") == batch).drop("of"), batch, path)
    return path


@query(_log("select 'm' || model as model, kind as condition, array_to_string(list_sort(list(distinct key % 2 + 1)), ' ') as reps from log where model <> 1 group by all"))
def s05_s06_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions that the store has of the models asked for, one of which it doesn't hold."""
    listing = store.discovered(spark, _stored(spark, sf_dir))
    asked = store.present(listing, spark.createDataFrame([("m0",), ("m2",), ("m7",)], "model string"))
    found = store.available(listing.join(F.broadcast(asked), "model", "left_semi"))
    return found.select("model", "condition", F.array_join(F.transform("reps", lambda x: x.cast("string")), " ").alias("reps"))


@query(_log("select 'm' || model as model, kind as condition, (line_no % 2)::int as batch, count(*) as lines, count(error) as errors, sum(usage_in)::bigint as tokens from log where model in (0, 2) and kind <> 'signup' group by all"))
def k03_appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two batches, read again from the folders of two models; a repeated batch adds nothing."""
    conditions = [r["kind"] for r in answer_log(spark, sf_dir).select("kind").distinct().where("kind <> 'signup'").collect()]
    rows = store.answers_of(spark, _stored(spark, sf_dir), ["m0", "m2"], conditions)
    return rows.groupBy("model", "condition", "batch").agg(F.count("*").alias("lines"), F.count("error").alias("errors"), F.sum("usage_in").alias("tokens"))


@query(_log("select kind, count(*) as n, case when kind <> 'error' then round(avg(latency_s), 6) end as mean from log group by kind"))
def k01_k02_replaced_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result set by kind, put in the place of an older one; a mean that is no number becomes null."""
    path = f"{store.scratch(spark, 'document')}/result.json"
    mean = F.when(F.col("kind") == "error", F.lit(float("nan"))).otherwise(F.avg("latency_s"))
    result = {r["kind"]: {"n": r["n"], "mean": r["mean"]} for r in answer_log(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), mean.alias("mean")).collect()}
    for document in ({"old": {"n": 0, "mean": 0.0}}, result):
        store.replace_json(spark, {"by_kind": document}, path)
    read = store.read_json(spark, path, "by_kind map<string, struct<n: long, mean: double>>")
    return _r(read.select(F.explode("by_kind").alias("kind", "x")).select("kind", "x.n", "x.mean"))


@query("""with o as (select o_orderkey as k, o_totalprice as p from orders)
select k, label, round(value, 6) as value from (select k, 'paired.acc' as label, p as value from o union all select k, 'paired.ci.0', p - 1 from o union all select k, 'paired.ci.1', p + 1 from o union all select k, 'n', (k % 7)::double from o) where k % 11 <> 0""")
def p30_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a document for each order; every eleventh is cut off."""
    p = F.col("o_totalprice")
    paired = F.struct(p.alias("acc"), F.array(p - 1, p + 1).alias("ci"), F.lit(1).alias("_note"), F.lit("x").alias("name"))
    text = F.to_json(F.struct(paired.alias("paired"), (F.col("o_orderkey") % 7).alias("n"), F.lit(True).alias("ok")))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 11 == 0, F.lit('{"paired": ')).otherwise(text).alias("text"))
    return _r(flattened(docs, "text"))


@query("""select c_custkey as id, case when c_custkey % 3 = 0 then 'Judge customer ' || c_name || '. Answer:' else 'Judge customer ' || c_name || '.' end as instruction,
 case when c_custkey % 3 = 2 then 'again' else 'lives in nation ' || c_nationkey end as a, 'buys ' || lower(c_mktsegment) as b, case when c_custkey % 3 = 1 then 3 else 2 end as sections from customer""")
def p23_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with sections that go on over lines, a constraint, a section more, and one opened twice."""
    name, n = F.col("c_name"), F.col("c_custkey") % 3
    head = F.concat(F.lit("\n Judge customer\n"), name, F.lit(".\nA: lives in\n   nation "), F.col("c_nationkey").cast("string"), F.lit("\nB: buys "), F.lower("c_mktsegment"))
    prompt = F.concat(head, F.when(n == 0, "\nConstraint: one letter\nAnswer:  ").when(n == 1, "\nOTHER: neither\n").otherwise("\nA: again"))
    found = table(spark, sf_dir, "customer").select("c_custkey", parsed_prompt(prompt).alias("x"))
    at = F.col("x.sections")
    return found.select(F.col("c_custkey").alias("id"), F.col("x.instruction").alias("instruction"), at["A"].alias("a"), at["B"].alias("b"), F.size(at).alias("sections"))


def _tree(name: str, rows: str, last: str) -> str:
    """A manifest's digests in DuckDB: rows (cond, k, body) by thousands, thousands of these, and the root."""
    up = "sha256(string_agg(d, chr(10) order by {o}, d))"
    return f"""{name}0 as (select cond, k // 1000 as c, {up.format(o='k')} as d, count(*) as n from (select cond, k, sha256(body) as d from {rows}) group by all),
{name}1 as (select cond, c // 1000 as c, {up.format(o='z')} as d, sum(n) as n from (select cond, c as z, c, d, n from {name}0) group by cond, c // 1000),
{name} as (select cond, {up.format(o='c')} as sha256, sum(n)::bigint as rows from {name}1 group by cond){last}"""


@query(f"""with a as (select o_orderstatus as cond, o_orderkey as k, o_orderstatus || o_custkey as body from orders where o_orderstatus <> 'P'),
b as (select o_orderstatus as cond, o_orderkey as k, case when o_orderstatus = 'O' and o_orderkey % 1000 = 7 then 'x' else o_orderstatus || o_custkey end as body from orders),
{_tree('ma', 'a', ',')} {_tree('mb', 'b', '')}
select cond as condition, coalesce(ma.rows, mb.rows) as rows, coalesce(ma.sha256, mb.sha256) as sha256, case when ma.rows is null then 'new' when ma.sha256 = mb.sha256 then 'same' else 'changed' end as status from ma full join mb using (cond)""")
def n18_replayed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen manifest beside a replay in which one condition is the same, one has other rows, one is new."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    body = F.concat(status, F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(status.alias("condition"), key.alias("k"), body.alias("body"))
    manifest = answers.frozen_tree(rows.where("condition <> 'P'"), ["condition"], "body", "k")
    changed = (F.col("condition") == "O") & (F.col("k") % 1000 == 7)
    again = answers.frozen_tree(rows.withColumn("body", F.when(changed, "x").otherwise(F.col("body"))), ["condition"], "body", "k")
    told = answers.replayed(manifest, again, ["condition"])
    entries = manifest.unionByName(again.join(told.where("status = 'new'").select("condition"), "condition", "left_semi"))
    return entries.join(told, "condition").select("condition", "rows", "sha256", "status")


@query("select o_orderpriority as condition, count(*) as n, sum(o_custkey)::bigint as keys from orders where o_orderpriority not like '5%' group by all")
def s03_manifest_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen requests of the conditions that the manifest names, but one, read again by their folders."""
    path = store.scratch(spark, "inputs")
    orders = table(spark, sf_dir, "orders")
    store.freeze_inputs(spark, orders.select(F.col("o_orderpriority").alias("condition"), "o_orderkey", "o_custkey"), path)
    named = [c for c in store.conditions_of(spark, path) if not c.startswith("5")]
    rows = store.load_inputs(spark, path, named, "o_orderkey long, o_custkey long")
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("""with r as (select s_suppkey, (row_number() over (order by s_suppkey) - 1) % 3 + 1 as part from supplier)
select part::int as part, count(*) as n, count(*) filter (where s_suppkey % 4 = 0) as high, count(*) filter (where s_suppkey % 4 = 1) as low, count(*) filter (where s_suppkey % 4 > 1) as blank from r group by part""")
def k07_task_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task tables for three raters as CSV, read again, filled by a rule and checked against the legal values."""
    legal = {"grade": ("low", "high"), "relation": ("same", "other")}
    tasks = design.rating_tasks(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 3, legal)
    path = store.scratch(spark, "tasks")
    tasks.write.partitionBy("part").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    read = spark.read.option("header", True).csv(path).withColumn("id", F.col("s_suppkey").cast("long"))
    filled = read.withColumn("grade", F.when(F.col("id") % 4 == 0, " High").when(F.col("id") % 4 == 1, "low"))
    found = filled.select("id", "part").join(design.read_ratings(filled, "id", legal), "id")
    return found.groupBy(F.col("part").cast("int").alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("grade") == "high").alias("high"), F.count_if(F.col("grade") == "low").alias("low"), F.count_if(F.col("grade").isNull()).alias("blank"))
