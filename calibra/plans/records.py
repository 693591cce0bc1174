"""Registered queries: answer logs, cost, joins, ledgers, agreement, design, text overlap, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import vectors as V
from ..functions.dealing import dealt, kept
from ..functions.documents import inverted
from ..functions.hashing import draw, draw_sql
from ..functions.quantiles import quantiles
from ..operators import answers, design, evidence, ledger, overlap
from ..sources import store, tables
from .derived import table
from .evaluation import _r

# An answer log from events: the user is the key, the time the order of lines, errors are error lines.


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("line_no"), (F.col("user_id") % 3).alias("model"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), (F.col("event_id") % 4).cast("string"))).alias("error"),
        F.col("value").alias("latency_s"), F.get_json_object("props", "$.k").cast("long").alias("usage_in"), F.col("event_type").alias("kind"), "ts")


LOG_SQL = "log as (select user_id as key, event_id as line_no, user_id % 3 as model, case when event_type = 'error' then 'error ' || (event_id % 4)::varchar end as error, value as latency_s, (props->>'$.k')::bigint as usage_in, event_type as kind, ts from events)"


def _log(body: str, ctes: str = "") -> str:
    return f"with {LOG_SQL}{', ' + ctes if ctes else ''} {body}"


@query(_log("select key, line_no, model, round(latency_s, 6) as latency_s, usage_in from (select *, row_number() over (partition by key order by line_no desc) as r from log where error is null) where r = 1"))
def s02_w07_last_line_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(answers.answered(answer_log(spark, sf_dir), ["key"], "line_no").select("key", "line_no", "model", "latency_s", "usage_in"))


@query(_log("select distinct key from log where error is null"))
def s04_completed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_log(spark, sf_dir).where("error is null").select("key").distinct()


@query(_log("select c_custkey as key from customer where c_custkey not in (select key from log where error is null)"))
def j06_q01_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.to_do(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), answer_log(spark, sf_dir), ["key"])


@query(_log("select key, count(*) as lines from log group by key having count(*) filter (where error is null) = 0"))
def j07_only_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.failed_only(answer_log(spark, sf_dir), ["key"])


@query(_log("select l.* exclude (ts, latency_s, error) from log l where key in (select c_custkey from customer where c_mktsegment = 'BUILDING')"))
def j08_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return answer_log(spark, sf_dir).join(some, "key", "left_semi").drop("ts", "latency_s", "error")


@query(_log("select model, sum(lines)::bigint as lines, count(*) as keys, count(*) filter (where good > 0) as answered, sum(lines - good)::bigint as errors, sum(greatest(good - 1, 0))::bigint as superseded, count(*) filter (where good = 0) as never from (select model, key, count(*) as lines, count(*) filter (where error is null) as good from log group by all) group by model"))
def a25_failure_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.accounting(answer_log(spark, sf_dir), ["model"], ["key"])


@query(_log("select error, model, count(*) as n from log where error is not null group by all"))
def a26_error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_log(spark, sf_dir).where("error is not null").groupBy("error", "model").agg(F.count("*").alias("n"))


@query(_log("select model, count(latency_s) as n, round(quantile_cont(latency_s, 0.5), 6) as p50, round(quantile_cont(latency_s, 0.95), 6) as p95, round(avg(latency_s), 6) as mean from log group by model"))
def a17_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(answers.latency(answer_log(spark, sf_dir), ["model"]))


@query(_log("select model, count(*) as decisions, sum(usage_in)::bigint as tokens, round(sum(usage_in) * 0.042::double / 1e6, 9) as usd, round(sum(usage_in) * 0.042::double / 1e6 / count(*) * 1000, 9) as usd_per_1000 from log group by model"))
def a18_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(answers.cost(answer_log(spark, sf_dir), ["model"]), 9)


@query(_log("select key, round(sum(latency_s / n), 6) as amortized from (select *, count(*) over (partition by key, kind) as n from log) group by key"))
def a19_amortized_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = answer_log(spark, sf_dir)
    sizes = log.groupBy("key", "kind").agg(F.count("*").alias("n"))
    return _r(log.join(sizes, ["key", "kind"]).groupBy("key").agg(F.sum(F.col("latency_s") / F.col("n")).alias("amortized")))


@query(_log("select model, round(sum(latency_s) * p.usd / 3600, 9) as usd, round(0.042::double * sum(usage_in) / 1e6 / (sum(latency_s) / 3600), 9) as break_even from log join (values (0, 0.8::double), (1, 1.2::double), (2, 2.5::double)) p(model, usd) using (model) group by model, p.usd"))
def a20_a24_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend at a model's hourly price, and the hourly price at which the hosted service costs as much."""
    prices = spark.createDataFrame([(0, 0.8), (1, 1.2), (2, 2.5)], "model long, price double")
    out = answer_log(spark, sf_dir).join(F.broadcast(prices), "model").groupBy("model", "price").agg(F.sum("latency_s").alias("s"), F.sum("usage_in").alias("t"))
    return _r(out.select("model", (F.col("s") * F.col("price") / 3600).alias("usd"), (answers.PRICE * F.col("t") / 1e6 / (F.col("s") / 3600)).alias("break_even")), 9)


@query(_log("select round(sum(usage_in) * 0.042::double / 1e6, 9) as spent, round(sum(length(props)) / 3.5::double * 0.042 / 1e6, 9) as estimate from (select usage_in from log) l full join (select props from events) e on false"))
def a21_a22_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend so far, and an estimate at 3.5 characters a token."""
    e = table(spark, sf_dir, "events")
    return _r(e.agg((F.sum(F.get_json_object("props", "$.k").cast("long")) * answers.PRICE / 1e6).alias("spent"), (F.sum(F.length("props")) / 3.5 * answers.PRICE / 1e6).alias("estimate")), 9)


@query("select l_orderkey as key, l_linenumber as qid, round(o_totalprice / n, 6) as share from lineitem join (select l_orderkey, count(*) as n from lineitem group by 1) using (l_orderkey) join orders on o_orderkey = l_orderkey")
def a23_itemwise_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    sizes = line.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return _r(line.join(sizes, "l_orderkey").join(orders, "l_orderkey").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("qid"), (F.col("o_totalprice") / F.col("n")).alias("share")))


@query(_log("select model, count(*) as n, round(avg((latency_s = round(latency_s, 2))::int), 6) as on_grid, round(max(abs(latency_s - round(latency_s, 2))), 6) as farthest from log group by model"))
def a27_grid_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, g = F.col("latency_s"), F.round("latency_s", 2)
    return _r(answer_log(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.avg((v == g).cast("int")).alias("on_grid"), F.max(F.abs(v - g)).alias("farthest")))


@query(_log("select model, field, value, count(*) as n from (select model, 'kind' as field, kind as value from log union all select model, 'error', error from log) group by all"))
def a28_run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.value_counts(answer_log(spark, sf_dir), ["kind", "error"], ["model"])


@query(_log("select usage_in, n from (select usage_in, count(*) as n from log group by 1) order by n desc, usage_in limit 5"))
def o02_o05_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_log(spark, sf_dir).groupBy("usage_in").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "usage_in").limit(5)


# Alignment of answers with options


@query("""with a as (select p_partkey as key, p_size as u, p_partkey % 5 = 0 as missing, p_partkey % 7 = 0 as empty from part),
w as (select *, case when empty then 0 else u end as wa, case when empty then 0 else (u * 7) % 13 end as wb from a)
select key, case when not missing then round(case when wa + wb > 0 then wa::double / (wa + wb) else 1 / 3.0::double end, 6) end as pa, case when not missing then round(case when wa + wb > 0 then wb::double / (wa + wb) else 1 / 3.0::double end, 6) end as pb,
 (case when key % 11 = 0 then null else key % 3 end)::int as y from w""")
def p01_j01_p03_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options a, b, c; answers give weights to a and b; every fifth request is unanswered, every
    seventh has no mass, every eleventh's label is no option."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("u"))
    names = F.array(*map(F.lit, "abc"))
    requests = parts.select("key", names.alias("options"), F.when(F.col("key") % 11 == 0, "none").otherwise(F.element_at(names, (F.col("key") % 3 + 1).cast("int"))).alias("label"))
    empty = F.col("key") % 7 == 0
    replies = parts.where("key % 5 <> 0").select("key", F.create_map(F.lit("a"), F.when(empty, 0.0).otherwise(F.col("u")), F.lit("b"), F.when(empty, 0.0).otherwise((F.col("u") * 7) % 13), F.lit("z"), F.lit(9.0)).alias("probs"))
    out = answers.aligned(requests, replies)
    return _r(out.select("key", F.col("p")[0].alias("pa"), F.col("p")[1].alias("pb"), "y"))


@query("select p_partkey as key, round(case when p_partkey % 4 = 0 then null else p_size / 100.0::double end, 6) as yes from part")
def p02_binary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar, a map with true, a map with yes, or nothing."""
    v, k = F.col("p_size") / 100.0, F.col("p_partkey") % 4
    scalar = F.when(k == 1, v)
    probs = F.when(k == 2, F.create_map(F.lit("true"), v)).when(k == 3, F.create_map(F.lit("yes"), v)).otherwise(F.create_map(F.lit("x"), v))
    return _r(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), answers.binary_probs(scalar, probs)["true"].alias("yes")))


@query("select p_partkey as key, round(case when p_partkey % 3 = 0 then null when p_size > 25 then 0.75 else 0.5 end::double, 6) as pa, p_partkey % 3 <> 0 as parsed from part")
def p15_p16_p17_reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON after a closing think mark; some replies are no JSON, negatives count as 0."""
    small = F.when(F.col("p_size") > 25, F.lit('{"a": 3, "b": 1, "c": -2}')).otherwise(F.lit('{"a": 2, "b": 2}'))
    reply = F.concat(F.lit("<think>{no}</think> so: "), F.when(F.col("p_partkey") % 3 == 0, F.lit("{broken")).otherwise(small), F.lit(" done"))
    p = answers.strict_reply(answers.lenient_body(reply), F.array(*map(F.lit, "abc")))
    return _r(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), p[0].alias("pa"), p.isNotNull().alias("parsed")))


@query("select o_orderkey as key, substr(sha256('{\"id\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}'), 1, 16) as request_hash from orders")
def n19_t15_t16_request_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), answers.request_hash(body).alias("request_hash"))


@query("select n_regionkey as condition, count(*) as rows, sha256(string_agg(sha256(n_name), chr(10) order by n_nationkey)) as sha256 from nation group by 1")
def k04_n18_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.frozen(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", "n_nationkey").withColumnRenamed("n_regionkey", "condition")


@query("select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as last_user, (sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))::bigint as offset_before from conversations")
def w09_w10_p23_running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_user"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)).cast("long").alias("offset_before"))


@query("select p_brand, count(*) as n, round(avg(length(p_type)), 6) as mean_chars, round(median(length(p_type)), 6) as median_chars, min(length(p_type)) as least, max(length(p_type)) as greatest from part group by 1")
def a31_option_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.length("p_type").cast("long").alias("_c"))
    sums = rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("_c").alias("mean_chars"), F.min("_c").alias("least"), F.max("_c").alias("greatest"))
    return _r(sums.join(quantiles(rows, ["p_brand"], "_c", {"median_chars": 0.5}), "p_brand"))


@query("select p_partkey, p_brand || ': ' || p_type as rendered, 'o' || (p_size % 3 + 1)::varchar as neutral from part")
def p12_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = design.neutral(F.array(*map(F.lit, "abc")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(": "), "p_type").alias("rendered"), F.element_at(three, (F.col("p_size") % 3 + 1).cast("int")).alias("neutral"))


@query("select p_partkey, case when p_size > 40 then 'o4' else 'o' || (p_size % 3 + 1)::varchar end as label, 4 as options from part")
def p21_none_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = design.neutral(F.array(*map(F.lit, "abc")))
    label = F.when(F.col("p_size") <= 40, F.element_at(options, (F.col("p_size") % 3 + 1).cast("int")))
    grown, named = design.with_none_option(options, label, "o4")
    return table(spark, sf_dir, "part").select("p_partkey", named.alias("label"), F.size(grown).alias("options"))


@query("select p_partkey, case when p_size % 3 = 2 then null when p_size % 2 = 0 then 'up' else 'down' end as grp from part")
def p22_label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"e0": "up", "e1": "down", "f0": "up", "f1": "down"}
    even = (F.col("p_size") % 2).cast("string")
    labels = F.when(F.col("p_size") % 3 == 2, F.array(F.lit("e0"), F.lit("f1"))).otherwise(F.array(F.concat(F.lit("e"), even), F.concat(F.lit("f"), even), F.lit("other")))
    return table(spark, sf_dir, "part").select("p_partkey", design.single_group(labels, groups).alias("grp"))


# Design


@query(f"select o_custkey % 5 as s, o_orderkey as id from orders qualify row_number() over (partition by o_custkey % 5 order by {draw_sql(repr('x1'), 'o_orderkey')}, o_orderkey) <= 20")
def x01_x05_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("s"), F.col("o_orderkey").alias("id"))
    return design.stratified(rows, ["s"], "id", 20, "x1")


@query(f"select o_orderpriority as panel, o_orderkey as id from (select *, row_number() over (partition by o_orderpriority order by {draw_sql(repr('x6'), 'o_orderkey')}, o_orderkey) as r, greatest(1, round_even(count(*) over (partition by o_orderpriority) * 0.01::double, 0)) as take from orders) where r <= take")
def x06_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("panel"), F.col("o_orderkey").alias("id"))
    return design.proportional(rows, ["panel"], "id", 0.01, "x6")


@query("select n_regionkey, n_nationkey, ((row_number() over (partition by n_regionkey order by n_nationkey) - 1) % 3)::int as part from nation")
def x07_w11_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.round_robin(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], "n_nationkey", 3)


_OPT = [f"t{i}" for i in range(12)]
_PERM = f"pm as (select p_partkey as item, o as option, o = 't' || (p_size % 12) as gold, row_number() over (partition by p_partkey order by {draw_sql(repr('x2'), 'p_partkey', 'o')}, o) - 1 as perm_rank from part, (values {', '.join(f'({o!r})' for o in _OPT)}) v(o))"


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_size")
    return design.permuted(items, "item", _OPT, F.concat(F.lit("t"), (F.col("p_size") % 12).cast("string")), "x2")


@query(f"with {_PERM} select item, option, gold, perm_rank::int as perm_rank from pm")
def x02_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _design(spark, sf_dir)


@query(f"with {_PERM} select k, item, option, gold from (select *, case when gold then 0 else row_number() over (partition by item, gold order by perm_rank) end as r from pm), (values (3), (6), (12)) s(k) where r <= k - 1")
def x03_nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.nested_subsets(_design(spark, sf_dir), "item", [3, 6, 12]).select("k", "item", "option", "gold")


_WORD = "translate(substr(md5('kr|' || {0} || '|' || o_orderkey), 1, 5), '0123456789abcdef', 'abcdefghijklmnop')"


@query(f"""select o_orderkey as item, naming, case when o_orderstatus = 'F' then coalesce(pos, {_WORD.format("'pos'")}) else coalesce(neg, {_WORD.format("'neg'")}) end as label from orders, (values ('k01', '0', '1'), ('kny', 'no', 'yes'), ('kswap', 'yes', 'no'), ('krand', null, null)) n(naming, neg, pos)""")
def p20_namings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") == "F").alias("positive"))
    return design.renamed(items, "item", "positive", "kr").select("item", "naming", "label")


# Evidence


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters of documents' labels: the second agrees unless a draw says otherwise."""
    level = lambda d: F.element_at(F.array(*map(F.lit, evidence.LEVELS)), (d % 3 + 1).cast("int"))
    first = level(draw("first", F.col("doc_id")))
    second = F.when(draw("same", F.col("doc_id")) % 4 != 0, first).otherwise(level(draw("second", F.col("doc_id"))))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("item"), F.concat(F.lit("domain"), (F.col("doc_id") % 5 + 1).cast("string")).alias("domain"), first.alias("first"), second.alias("second"))


_LEVEL = "['low', 'unclear', 'high'][{0} % 3 + 1]"
RAT_SQL = f"""rat as (select doc_id::varchar as item, 'domain' || (doc_id % 5 + 1) as domain, {_LEVEL.format(draw_sql("'first'", 'doc_id'))} as first,
 case when {draw_sql("'same'", 'doc_id')} % 4 <> 0 then {_LEVEL.format(draw_sql("'first'", 'doc_id'))} else {_LEVEL.format(draw_sql("'second'", 'doc_id'))} end as second from labels)"""


@query(f"""with {RAT_SQL}, co as (select domain, list_position(['low', 'unclear', 'high'], first) - 1 as a, list_position(['low', 'unclear', 'high'], second) - 1 as b from rat),
po as (select domain, count(*) as n, avg((a = b)::int) as po, avg(abs(a - b) / 2.0::double) as d from co group by domain),
ma as (select domain, a, count(*) as m from co group by all), mb as (select domain, b, count(*) as m from co group by all),
pe as (select domain, sum(case when a = b then ma.m * mb.m else 0 end)::double / any_value(n * n) as pe, sum(ma.m * mb.m * abs(a - b) / 2.0::double) / any_value(n * n) as de from ma join mb using (domain) join po using (domain) group by domain)
select domain, n, round(po, 6) as agreement, round(case when pe < 1 then (po - pe) / (1 - pe) end, 6) as kappa, round(case when de > 0 then 1 - d / de end, 6) as weighted_kappa from po join pe using (domain)""")
def a32_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(evidence.kappa(ratings(spark, sf_dir), ["domain"]))


@query(f"with {RAT_SQL} select item, domain, first, second from rat where first <> second")
def j17_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where("first <> second").select("item", "domain", "first", "second")


@query(f"with {RAT_SQL} select item, case when first <> second and item::int % 2 = 0 then second else first end as first, case when first <> second and item::int % 2 = 0 then 'r [adj]' else 'r' end as reason from rat")
def n09_n10_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied twice, to the same effect as once."""
    rows = ratings(spark, sf_dir)
    final = rows.where("first <> second and cast(item as int) % 2 = 0").select("item", F.col("second").alias("final"))
    once = evidence.adjudicated(rows.select("item", "first", F.lit("r").alias("reason")), final, ["item"], "[adj]")
    return evidence.adjudicated(once, final, ["item"], "[adj]")


_GRADES = f"""gr as (select l_orderkey as study, max(case when l_linenumber = 1 then g end) as d1, max(case when l_linenumber = 2 then g end) as d2, max(case when l_linenumber = 3 then g end) as d3, max(case when l_linenumber = 4 then g end) as d4, max(case when l_linenumber = 5 then g end) as d5 from
 (select l_orderkey, l_linenumber, {_LEVEL.format(draw_sql("'rob'", 'l_orderkey', 'l_linenumber'))} as g from lineitem where l_linenumber <= 5) group by 1),
gx as (select study, d1, d5, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'high')) as h, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'unclear')) as u, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'low')) as l from gr),
go as (select study, case when d1 = 'high' or d5 = 'high' or h >= 2 then 'high' when l = 5 or (u = 1 and h = 0) then 'low' else 'some_concerns' end as overall from gx)"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").select("l_orderkey", "l_linenumber")
    # Levels are grouped as numbers, since greatest texts are found by sorting; equal lines have equal levels.
    level = (draw("rob", F.col("l_orderkey"), F.col("l_linenumber")) % 3).cast("int")
    coded = dealt(lines.select(F.col("l_orderkey").alias("study"), "l_linenumber", level.alias("level")), lines.count(), "study")
    codes = coded.groupBy("study").agg(*[F.max(F.when(F.col("l_linenumber") == k, F.col("level"))).alias(f"d{k}") for k in range(1, 6)])
    wide = codes.select("study", *[F.get(F.array(*map(F.lit, evidence.LEVELS)), F.col(f"d{k}")).alias(f"d{k}") for k in range(1, 6)])
    return wide.withColumn("overall", evidence.overall_grade([F.col(f"d{k}") for k in range(1, 6)]))


@query(f"with {_GRADES} select study, overall from go")
def n03_overall_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades(spark, sf_dir).select("study", "overall")


@query(f"with {_GRADES} select coalesce(overall, '') as overall, count(*) as estimates from lineitem left join go on study = l_orderkey group by 1")
def j13_n02_graded_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grades(spark, sf_dir).select(F.col("study").alias("l_orderkey"), "overall")
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(g, "l_orderkey", "left").groupBy(F.coalesce("overall", F.lit("")).alias("overall")).agg(F.count("*").alias("estimates"))


_EST = "est as (select l_returnflag as analysis, s_nationkey as cluster, l_suppkey as study, round(l_extendedprice / l_quantity - 1500, 2) as v from lineitem join supplier on s_suppkey = l_suppkey)"


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cluster"))
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", F.round(F.col("l_extendedprice") / F.col("l_quantity") - 1500, 2).alias("v"))
    return line.join(s, "l_suppkey").select(F.col("l_returnflag").alias("analysis"), "cluster", F.col("l_suppkey").alias("study"), "v")


@query(f"with {_EST}, m as (select analysis, cluster, median(v) as m from est group by all) select analysis, count(*) as clusters, round(min(m), 6) as least, arg_min(cluster, (m, cluster)) as least_cluster, round(max(m), 6) as greatest, round(median(m), 6) as median, count(*) filter (where m > 0) as ahead, count(*) filter (where m < 0) as behind from m group by analysis")
def a33_a34_n14_cluster_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(evidence.pooled(estimates(spark, sf_dir), ["analysis"], "cluster", "v"))


@query(f"with {_EST}, m as (select analysis, cluster, median(v) as m from est where study % 5 <> 0 group by all) select analysis, count(*) as clusters, round(median(m), 6) as median from m group by analysis")
def n15_leave_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(evidence.pooled(estimates(spark, sf_dir).where("study % 5 <> 0"), ["analysis"], "cluster", "v").select("analysis", "clusters", "median"))


_RB = f"""with {_EST}, m as (select analysis, cluster, median(v) as m, row_number() over (partition by analysis order by cluster) - 1 as k, count(*) over (partition by analysis) as n from est group by analysis, cluster),
d as (select distinct analysis, n, b, j, {draw_sql("'med'", 'b', 'j')} % n as k from m, range(100) x(b), range(25) y(j) where j < n),
st as (select d.analysis, b, median(m) as s from d join m using (analysis, k) group by all) select analysis, round(quantile_cont(s, 0.025), 6) as low, round(quantile_cont(s, 0.975), 6) as high from st where analysis in (select analysis from m where n >= 3) group by analysis"""


@query(_RB)
def r11_median_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the median over clusters, only where there are three or more."""
    m = evidence.cluster_medians(estimates(spark, sf_dir), ["analysis"], "cluster", "v")
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("analysis").orderBy("cluster")) - 1)
    sizes = m.groupBy("analysis").agg(F.count("*").alias("n")).where("n >= 3")
    draws = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("analysis", "b", (draw("med", F.col("b"), F.col("j")) % F.col("n")).alias("k"))
    stats = quantiles(draws.join(m, ["analysis", "k"]), ["analysis", "b"], "m", {"s": 0.5})
    return _r(quantiles(stats, ["analysis"], "s", {"low": 0.025, "high": 0.975}))


@query(f"with {_EST} select analysis, round((max(m) - min(m)) / max(span), 6) as ratio from (select analysis, study, median(v) as m, max(v) - min(v) as span from est group by all) group by analysis")
def a35_span_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(evidence.span_ratio(estimates(spark, sf_dir), ["analysis"], "study", "v"))


@query("""with ledger as (select o_orderkey as k, case when o_orderkey % 97 = 0 then 'K ' || o_orderkey else 'k-' || (o_orderkey % 350) end as value_key from orders)
 select 'repeated value_key' as rule, min(k)::varchar as row_id from ledger group by value_key having count(*) > 1
 union all select 'malformed value_key', k::varchar from ledger where k % 97 = 0 union all select 'blank excerpt', k::varchar from ledger where k % 101 = 0""")
def n01_n17_ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger_violations(table(spark, sf_dir, "orders"))


def _ledger_violations(rows: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    ledger = rows.select(
        F.lpad(k.cast("string"), 19, "0").alias("row_id"), F.when(k % 97 == 0, F.concat(F.lit("K "), k.cast("string"))).otherwise(F.concat(F.lit("k-"), (k % 350).cast("string"))).alias("value_key"), F.when(k % 101 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("excerpt"))
    return evidence.violations(ledger).withColumn("row_id", F.regexp_replace("row_id", "^0+(?=.)", ""))


@query("""select p_partkey, round(case p_partkey % 4 when 0 then p_size when 1 then 100.0::double * p_size / 50 else null end, 6) as number from part""")
def n06_number_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain number, a fraction, two matches, none."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("acc "), s)).when(k == 1, F.concat(F.lit("acc "), s, F.lit("/50"))).when(k == 2, F.concat(F.lit("acc "), s, F.lit(" acc 7"))).otherwise(F.lit("none"))
    return _r(table(spark, sf_dir, "part").select("p_partkey", evidence.single_number(text, r"acc ([0-9./]+)").alias("number")))


@query("""select a.p_partkey, round(case a.p_partkey % 3 when 0 then a.p_size - b.p_size when 1 then a.p_size::double / b.p_size else 100.0::double * (b.p_size - a.p_size) end, 6) as v from part a join part b on b.p_partkey = a.p_partkey + 1""")
def p28_j12_n12_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection lines that read two ledger rows and combine them by a closed expression."""
    ledger = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("value"))
    lines = ledger.select(F.col("id").alias("a_row"), (F.col("id") + 1).alias("b_row"), F.element_at(F.array(*map(F.lit, ["a-b", "a/b", "100*(b-a)"])), (F.col("id") % 3 + 1).cast("int")).alias("expr"))
    a, b = ledger.select(F.col("id").alias("a_row"), F.col("value").alias("a")), ledger.select(F.col("id").alias("b_row"), F.col("value").alias("b"))
    out = lines.join(a, "a_row").join(b, "b_row")
    return _r(out.select(F.col("a_row").alias("p_partkey"), evidence.evaluated(F.col("expr"), F.col("a"), F.col("b")).alias("v")))


@query("select c_mktsegment as claim, c_nationkey as cluster, c_custkey as id, place from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as place from (select * from customer qualify row_number() over (partition by c_mktsegment, c_nationkey order by c_acctbal desc, c_custkey) = 1)) where place <= 3")
def w08_o06_top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("claim"), F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"), "c_acctbal")
    return evidence.top_evidence(rows, "claim", "cluster", [F.desc("c_acctbal"), F.asc("id")]).select("claim", "cluster", "id", F.col("place").cast("long"))


@query("select c_mktsegment as claim, case when bool_and(c_acctbal > -900) then 'supported' when bool_and(c_acctbal <= -900) then 'contradicted' else 'mixed' end as status, count(*) filter (where c_acctbal > 0) as ahead from customer group by 1")
def a37_claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("c_acctbal") > -900
    status = F.when(F.bool_and(ok), "supported").when(F.bool_and(~ok), "contradicted").otherwise("mixed")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("claim")).agg(status.alias("status"), F.count_if(F.col("c_acctbal") > 0).alias("ahead"))


@query("select coalesce(r_name, 'none') as tier, count(*) as n, count(distinct lower(substr(n_name, 1, 3))) as families from nation left join region on r_regionkey = n_regionkey and r_regionkey <> 2 group by 1")
def a38_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(checks, "n_regionkey", "left").groupBy(F.coalesce("r_name", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.substring("n_name", 1, 3))).alias("families"))


@query("select count(*) filter (where o_orderkey is not null) as with_rows, count(*) filter (where o_orderkey is null) as no_rows from (select c_custkey, min(o_orderkey) as o_orderkey from customer left join orders on o_custkey = c_custkey group by 1)")
def a40_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(with_rows, "c_custkey", "left").agg(F.count_if(F.col("hit").isNotNull()).alias("with_rows"), F.count_if(F.col("hit").isNull()).alias("no_rows"))


@query("select c_nationkey as record, round(avg(c_acctbal) filter (where c_mktsegment = 'BUILDING'), 6) as building, round(avg(c_acctbal) filter (where c_mktsegment = 'MACHINERY'), 6) as machinery from customer group by 1")
def j18_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("record")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).avg("c_acctbal")
    return _r(wide.select("record", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery")))


@query("select c_custkey, o_orderkey as first_order from customer join (select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1) on o_custkey = c_custkey")
def u05_o03_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey")


@query("(select o_custkey as k from orders intersect select c_custkey from customer where c_nationkey < 10) union all (select c_custkey as k from customer where c_nationkey >= 24 except select o_custkey from orders)")
def u02_u03_u04_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer")
    some = o.intersect(c.where("c_nationkey < 10").select(F.col("c_custkey").alias("k")))
    return some.union(c.where("c_nationkey >= 24").select(F.col("c_custkey").alias("k")).exceptAll(o.distinct()))


@query("select n_name as name, n_regionkey as k from nation union all select r_name, null from region")
def u01_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k")).unionByName(r.select(F.col("r_name").alias("name")), allowMissingColumns=True)


# Text


_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"with t as (select doc_id, text, {_NORM} as n from documents) select doc_id, (count(*) over (partition by text) - 1) as exact, (count(*) over (partition by n) - 1) as normalized from t")
def t01_t07_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


_GRAMS = """bq as (select item_id, {gram} as g from benchmark), dq as (select conv_id * 1000 + turn as pid, {gram} as g from conversations),
bx as (select item_id, len(g) as n, unnest(g) as x from bq), dx as (select pid, len(g) as n, unnest(g) as x from dq),
pr as (select item_id, pid, any_value(bx.n) as a, any_value(dx.n) as b, count(*) as shared from bx join dx using (x) group by item_id, pid)
select item_id, pid, round(j, 6) as jaccard from (select *, row_number() over (partition by item_id order by j desc, pid) as r from (select *, shared::double / (a + b - shared) as j from pr)) where r = 1"""


@query("with " + _GRAMS.format(gram=f"list_distinct(list_transform(range(1, length({_NORM}) - 3), lambda i: substr({_NORM}, i, 5)))"))
def t04_t06_j10_o04_char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pid"), overlap.norm(F.col("text")).alias("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", overlap.norm(F.col("text")).alias("text"))
    return _r(overlap.best_match(items, pool, "item_id", "pid", overlap.char_grams))


@query("with " + _GRAMS.format(gram=f"list_distinct(list_filter(string_split({_NORM}, ' '), lambda x: x <> ''))"))
def t05_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pid"), overlap.norm(F.col("text")).alias("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", overlap.norm(F.col("text")).alias("text"))
    return _r(overlap.best_match(items, pool, "item_id", "pid", overlap.token_set))


@query(f"with b as (select item_id, substr({_NORM}, 1, 120) as h from benchmark), d as (select doc_id, {_NORM} as t from documents) select item_id, doc_id from b join d on contains(t, h)")
def j11_substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query("select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) as text_md5 from pages")
def t08_s11_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(overlap.plain_text(F.col("html"))).alias("text_md5"))


@query("select p_partkey, p_size % 2 = 0 as found from part")
def n05_t11_t12_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's numbers, looked for in an excerpt that has them as words, with separators or a bare point."""
    size, large = F.col("p_size"), F.col("p_partkey") * 1000 + 7
    words = F.create_map(*[F.lit(x) for word, digits in overlap.NUMBERS.items() for x in (digits, word)])
    excerpt = F.concat(F.coalesce(F.try_element_at(words, size.cast("string")), size.cast("string")), F.lit(" of "), F.format_number(large, 0), F.lit(" items, ."), (size + size % 2).cast("string"))
    value = F.concat(size.cast("string"), F.lit(" of "), large.cast("string"), F.lit(" at 0."), size.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", overlap.numbers_contained(value, excerpt).alias("found"))


@query("select p_partkey, regexp_replace('2401.' || p_partkey || 'v' || p_size, 'v[0-9]+$', '') as base, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def t13_t14_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("2401."), F.col("p_partkey").cast("string"), F.lit("v"), F.col("p_size").cast("string"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(v, r"v\d+$", "").alias("base"), slug.alias("slug"))


@query("select vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings")
def t21_t18_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return _r(table(spark, sf_dir, "embeddings").select("vec_id", "label", n.alias("norm")), 5)


@query("""with e as (select vec_id, label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings), c as (select label, i, avg(x) as m from e group by all)
select vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) as cosine, round(max(x) filter (where i = 1) / sqrt(sum(x * x)), 5) as first from e join c using (label, i) group by vec_id""")
def t21_cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cosine with the mean of its label's, and its first entry at length one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroid = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))
    return _r(e.join(centroid, "label").select("vec_id", V.cosine(F.col("v"), F.col("c")).alias("cosine"), V.unit(F.col("v"))[0].alias("first")), 5)


@query("""with f as (select o_orderpriority as k, o_custkey % 5 as fold, o_orderstatus as y, count(*) as n from orders group by all), t as (select k, y, sum(n) as n from f group by all), g as (select k, fold, sum(n) as n from f group by all)
select k, fold, y, round((coalesce(t.n, 0) - coalesce(f.n, 0) + 1)::double / ((select sum(n) from t t2 where t2.k = t.k) - g.n + 3), 6) as p from t join g using (k) left join f using (k, fold, y)""")
def m05_frequency_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold label frequencies, smoothed by one: totals less each fold."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 5).alias("fold"), F.col("o_orderstatus").alias("y"))
    f = rows.groupBy("k", "fold", "y").agg(F.count("*").alias("n"))
    t, g, whole = f.groupBy("k", "y").agg(F.sum("n").alias("tn")), f.groupBy("k", "fold").agg(F.sum("n").alias("gn")), f.groupBy("k").agg(F.sum("n").alias("kn"))
    out = t.join(g, "k").join(whole, "k").join(f, ["k", "fold", "y"], "left")
    return _r(out.select("k", "fold", "y", ((F.col("tn") - F.coalesce("n", F.lit(0)) + 1) / (F.col("kn") - F.col("gn") + 3)).alias("p")))


@query()
def m01_m02_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-label regression: a row for each option, weighted by its probability. The fit reads its rows several
    times, so draws are made and written once."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .derived import decisions

    dec = kept(decisions(spark, sf_dir).where("model = 'alpha'").select("item", "p", (F.col("usage_in") / 450.0).alias("u")))
    rows = dec.select("item", array_to_vector(F.array("u", F.col("p")[0])).alias("features"), F.posexplode("p").alias("label", "w"))
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=20, regParam=1e-3).fit(rows.select("features", F.col("label").cast("double"), "w"))
    scored = model.transform(dec.select("item", array_to_vector(F.array("u", F.col("p")[0])).alias("features")))
    return scored.select("item", F.transform(vector_to_array("probability"), lambda x: F.round(x, 4)).alias("p"))


@query()
def m03_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of words and word pairs, terms in two texts or more."""
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer

    items = table(spark, sf_dir, "benchmark")
    words = NGram(n=2, inputCol="w", outputCol="pairs").transform(RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+").transform(items))
    both = words.select("item_id", F.concat("w", "pairs").alias("terms"))
    counts = CountVectorizer(inputCol="terms", outputCol="tf", minDF=2, vocabSize=20000).fit(both).transform(both)
    from pyspark.ml.functions import vector_to_array

    found = IDF(inputCol="tf", outputCol="x").fit(counts).transform(counts)
    return found.select("item_id", F.round(F.aggregate(vector_to_array("x"), F.lit(0.0), lambda a, v: a + v), 4).alias("mass"))


# Sources and sinks: written and read again


@query("select n_nationkey as key, 'm' || n_regionkey as model, n_name as condition from nation where n_nationkey % 2 = 0")
def s01_s03_k01_k03_answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer lines by model, condition and repetition; unparseable ones are dropped."""
    path = store.scratch(spark, "answers")
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model"), F.col("n_name").alias("condition"))
    text = lines.select(F.when(F.col("key").cast("int") % 2 == 0, F.to_json(F.struct("*"))).otherwise(F.lit("{broken")).alias("value"))
    text.write.text(path)
    return tables.read_answers(spark, path).select(F.col("key").cast("int").alias("key"), "model", "condition")


@query("select r_name as name, r_regionkey::varchar as k from region")
def s07_s08_k05_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("k")), path)
    return tables.read_csv(spark, path).select("name", "k")


@query("select n_nationkey as id, n_name as title from nation")
def s12_atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    entry = F.concat(F.lit("<feed><entry><id> "), F.col("n_nationkey").cast("string"), F.lit("</id><title>"), F.col("n_name"), F.lit("</title></entry></feed>"))
    return n.select(F.explode(tables.entries(entry)).alias("e")).select(F.col("e.id").cast("int").alias("id"), "e.title")


@query("select event_type as kind, count(*) as lines from events group by 1")
def e01_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the events read as a stream until they are used up, counted by type."""
    name = f"counts_{spark.range(1).select(F.replace(F.uuid(), F.lit('-'))).first()[0]}"
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    counts = rows.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("lines"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("select p_partkey, round_even(printf('%.2f', p_retailprice / 7)::double * 10, 0) = floor(p_retailprice / 7 * 10) as equal_at_coarser from part")
def n07_coarser_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of a price cut off after one decimal equals one with two decimals if that rounds to it."""
    v = F.col("p_retailprice") / 7
    printed = lambda c, d: F.format_string(f"%.{d}f", c)
    return table(spark, sf_dir, "part").select("p_partkey", ledger.same_value(printed(F.floor(v * 10) / 10, 1), printed(v, 2)).alias("equal_at_coarser"))


@query("select o_orderkey as id, array_to_string(list_sort([o_orderstatus || '=' || case when o_orderstatus = o_orderpriority[1] then 'b' else 'a' end] || case when o_orderstatus <> o_orderpriority[1] then [o_orderpriority[1] || '=b'] else [] end), ' ') as inverted from orders")
def t19_inverted_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps turned round: of two keys with one value the last stands."""
    m = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.substring("o_orderpriority", 1, 1), F.lit("c"), F.lit(None).cast("string"))
    pairs = F.transform(F.map_entries(inverted(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(pairs), " ").alias("inverted"))
