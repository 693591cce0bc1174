"""Registered queries: services and runs, baselines' files, chosen regressions, held-out risk, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.hashing import draw, draw_sql
from ..operators import answers, decide, design, regression, runner, significance
from .derived import OPTIONS, decisions, table
from .evaluation import _FOLD, _TAIL, _judged, _r, _sql


class Sizes:
    """A service that reads a batch's answers ahead; p of "yes" is the record's size over 50."""

    def __init__(self) -> None:
        self.known: dict[int, float] = {}

    def prefetch(self, records: list[dict]) -> None:
        self.known = {r["key"]: r["size"] / 50.0 for r in records}

    def answer(self, record: dict) -> dict:
        p = self.known[record["key"]]
        return {"model_returned": "sizes-1", "usage_in": record["size"] + 10, "answers": {"fits": {"yes": p, "no": 1.0 - p}}}


runner.register("sizes", Sizes)


@query("select p_partkey as key, 'sizes-1' as model_returned, (p_size + 10)::bigint as usage_in, round(p_size / 50.0::double, 6) as yes from part")
def q03_q04_q05_registered_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = runner.asked(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")), "sizes", ["key"])
    yes = F.get_json_object("answers", "$.fits.yes").cast("double")
    return _r(asked.where("error is null").select("key", "model_returned", "usage_in", yes.alias("yes")))


@query(f"""with c as (select o_custkey // 500 as chunk, sum(o_orderkey % 400 + 50)::bigint as tokens from orders group by 1), w as (select *, sum(tokens) over (order by chunk) as upto, sum(tokens) over () as whole from c)
select chunk, tokens, round(upto * {answers.PRICE}::double / 1e6, 6) as spent, (upto - tokens) * {answers.PRICE}::double / 1e6 <= 0.05::double as run from w""")
def q02_chunks_within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 500 customers; the run ends with the chunk that passes five cents."""
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 500).alias("chunk"), (F.col("o_orderkey") % 400 + 50).alias("tokens"))
    chunks = rows.agg(F.max("chunk")).first()[0] + 1
    return _r(runner.chunks_within(rows, "chunk", "tokens", chunks, 0.05))


_FITTED = "0.5 + type::int / 2.0::double"


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dec = decisions(spark, sf_dir)
    by_type = 0.5 + F.col("type").cast("int") / 2.0
    # One file of each model; a request is a customer, its questions are orders.
    keyed = dec.withColumn("request", F.concat_ws("|", "model", F.col("grp").cast("string")))
    return runner.baseline_lines(keyed, "request", "item", F.array(*map(F.lit, OPTIONS)), by_type), dec


@query(_sql(f"""select model || '|' || grp as key, item, round(p0, 6) as p, round(tt, 6) as fitted, round(case when tt = 1 then p0 else exp(ln(greatest(p0, 1e-6)) / tt) / (exp(ln(greatest(p0, 1e-6)) / tt) + exp(ln(greatest(p1, 1e-6)) / tt) + exp(ln(greatest(p2, 1e-6)) / tt)) end, 6) as scaled
 from (select *, {_FITTED} as tt from dec)"""))
def k06_baseline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer lines as they are written, read again."""
    read = runner.read_lines(_lines(spark, sf_dir)[0])
    return _r(read.select("key", F.col("question").cast("long").alias("item"), F.col("probs")[OPTIONS[0]].alias("p"), F.col("fitted_temperature").alias("fitted"), F.col("probs_scaled")[OPTIONS[0]].alias("scaled")))


@query(_sql(f"select type, round(any_value({_FITTED}), 6) as temperature from dec group by type"))
def c07_read_back_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, dec = _lines(spark, sf_dir)
    gold = dec.select(F.col("item").alias("question"), "type").distinct()
    return _r(runner.fitted_temperatures(runner.read_lines(lines), gold))


_SIDES = ("small", "medium", "large")
_PAIRS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(_SIDES))


@query(f"""with l as (select p_partkey as key, option, exp({draw_sql("'nli'", "p_brand || ' ' || p_size", "'The part is ' || side || '.'")} % 2001 / 250.0::double - 4) as e from part, (values {_PAIRS}) s(option, side))
select key, round(max(e) filter (where option = 0) / sum(e), 6) as p0, round(max(e) filter (where option = 1) / sum(e), 6) as p1 from l group by key""")
def m06_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of premise and hypothesis are scored once; the score is drawn from the texts."""
    options = F.posexplode(F.array(*map(F.lit, _SIDES))).alias("option", "side")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("premise"), options)
    pairs = rows.select("key", "option", "premise", F.concat(F.lit("The part is "), "side", F.lit(".")).alias("hypothesis"))
    found = runner.entailed(pairs, ["key"], lambda d: d.withColumn("logit", draw("nli", F.col("premise"), F.col("hypothesis")) % 2001 / 250.0 - 4))
    return _r(found.select("key", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from events")
def t20_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", runner.iso_day(F.col("ts")).alias("day"), runner.utc_stamp(F.col("ts")).alias("stamp"))


@query("""select o_orderkey as item, naming, neg || '/' || pos as options, case when o_orderstatus = 'F' then pos else neg end as label, round((o_orderkey % 100) / 100.0::double, 6) as soft_positive
 from orders, (values ('k01', '0', '1'), ('kny', 'no', 'yes'), ('kswap', 'yes', 'no')) n(naming, neg, pos) where o_orderstatus <> 'P'""")
def q07_row_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule skips a status; drawn names have a query of their own."""

    def rule(rows: DataFrame):
        return F.when(rows["o_orderstatus"] != "P", F.struct((rows["o_orderstatus"] == "F").alias("positive"), (rows["o_orderkey"] % 100 / 100.0).alias("soft")))

    out = design.recast(table(spark, sf_dir, "orders"), "o_orderkey", rule, "q07").where("naming <> 'krand'")
    return _r(out.select(F.col("o_orderkey").alias("item"), "naming", F.array_join("options", "/").alias("options"), "label", F.col("soft")[1].alias("soft_positive")))


_HELD = f"""{_FOLD}, fd as (select dec.*, fold from dec join gf using (grp)), ks as (select k from range(5) r(k)),
bl as (select model, k, conf, count(*) as m, sum(1 - correct) as e from fd, ks where fold <> k group by all),
cu as (select model, k, conf, sum(m) over w as accepted, sum(e) over w as errors from bl window w as (partition by model, k order by conf desc)),
th as (select model, k as fold, arg_max(conf, accepted) filter (where errors::double / accepted <= 0.1) as t from cu group by model, k),
cell as (select model, count(*) as n, count(*) filter (where conf >= t) as accepted, count(*) filter (where conf >= t and correct = 0) as errors from fd join th using (model, fold) group by model),
bis as (select model, errors as k, accepted as n, 0.0::double as lo, 1.0::double as hi, 0 as i from cell where errors < accepted union all select model, k, n, case when above then (lo + hi) / 2 else lo end, case when above then hi else (lo + hi) / 2 end, i + 1 from (select *, {_TAIL} > 0.05::double as above from bis where i < 60))"""


@query(_sql("""select model, n, accepted, errors, round(accepted / n::double, 6) as coverage, round(errors::double / nullif(accepted, 0), 6) as risk, round(case when accepted = 0 then null when errors = accepted then 1.0::double else (select (lo + hi) / 2 from bis where i = 60 and bis.model = cell.model) end, 6) as risk_upper from cell""", _HELD).replace("with ", "with recursive ", 1))
def g08_held_out_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = significance.folds(_judged(spark, sf_dir), "grp", "fold")
    return _r(decide.cross_fitted(dec, ["model"], "fold", significance.FOLDS, 0.1))


@query("""with recursive z as (select c_nationkey as g, count(*) as n, row_number() over (order by count(*) desc, c_nationkey) as i from customer group by 1),
d as (select 0::bigint as i, null::int as g, 0 as fold, [0, 0, 0, 0, 0]::bigint[] as load union all
 select z.i, z.g, list_position(load, list_min(load))::int - 1, list_transform(range(1, 6), lambda j: load[j] + case when j = list_position(load, list_min(load)) then n else 0 end)::bigint[] from d join z on z.i = d.i + 1)
select d.fold, count(*) as customers, count(distinct g) as groups from d join customer on c_nationkey = g where d.i > 0 group by 1""")
def r17_balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = significance.with_balanced_folds(table(spark, sf_dir, "customer").select("c_nationkey"), "c_nationkey")
    return out.groupBy("fold").agg(F.count("*").alias("customers"), F.count_distinct("c_nationkey").alias("groups"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = decisions(spark, sf_dir)
    x = F.array(F.col("usage_in") / 450.0, F.col("latency_s"), F.col("in_scope").cast("double"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i == F.col("y")).cast("double"))
    return dec.select("model", "item", x.alias("x"), "p", hot.alias("hot"), (draw("cv", F.col("item")) % 5).cast("int").alias("fold"))


@query()
def m04_strength_by_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge strengths of soft-label regressions by five folds; tests hold fits against their optimum's conditions."""
    found = regression.select_strength(_examples(spark, sf_dir), "model", "fold", "x", "p", [0.01, 1.0, 100.0])
    return _r(found.select("model", "strength", "cv_loss", "n"))


@query()
def m01_strength_by_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths by accuracy, then likelihood, on a fifth of the items."""
    rows = _examples(spark, sf_dir).withColumn("valid", (F.col("fold") == 0).cast("int"))
    return _r(regression.validated_strength(rows, "model", "valid", "p", "hot", [1.0, 10.0, 100.0, 1000.0, 10000.0]))


@query()
def m05_out_of_fold_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _examples(spark, sf_dir).withColumn("id", F.concat_ws("|", "model", F.col("item").cast("string")))
    found = regression.out_of_fold(rows, "model", "fold", "x", "hot", "id")
    return _r(found.select("id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), F.col("p")[2].alias("p2")), 4)


_N, _HEAD_MOST, _MOST, _CAP = "(o_custkey % 12 + 2)", 96, 80, 20
_TOKENS = f"""rq as (select o_orderkey as item, substr(o_orderpriority, 1, 1) as type, list_transform(range(0, {_N}), lambda i: (o_orderkey * 7 + i * 13) % 31 + 1) as opts, list_transform(range(0, {_N}), lambda i: i % 3 + 1) as keys, o_orderkey % 40 + 5 as head, o_orderkey % 90 as state, o_orderkey % {_N} as gold from orders),
mk as (select *, list_transform(opts, lambda n: least(n, {_CAP}) + 1) as m from rq), ex as (select *, list_sum(m) > {_HEAD_MOST} - 16 as exceeds, greatest(4, ({_HEAD_MOST} - 16) // len(m)) as per from mk),
kp as (select *, case when exceeds then list_transform(m, lambda n: least(n, per)) else m end as kept from ex), hd as (select *, least(head, greatest(8, {_HEAD_MOST} - list_sum(kept))) as hk from kp),
st as (select *, 3 + hk + list_sum(kept) as pre, list_transform(range(1, len(kept) + 1), lambda i: 2 + hk + coalesce(list_sum(kept[1:i - 1]), 0)) as mark from hd),
rp as (select *, least(state, greatest(0, {_MOST} - pre - 1)) as sk, len(list_filter(mark, lambda x: x >= {_MOST})) as gone, len(list_filter(range(1, len(kept) + 1), lambda i: kept[i] - 1 <= keys[i])) as bare from st),
bd as (select *, least({_MOST}, pre + sk + 1) as seq_len from rp)"""


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import rendering

    key, n = F.col("o_orderkey"), (F.col("o_custkey") % 12 + 2).cast("int")
    places = F.sequence(F.lit(0), n - 1)
    count = lambda c: c.cast("int")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("item"), F.substring("o_orderpriority", 1, 1).alias("type"), F.transform(places, lambda i: count((key * 7 + i * 13) % 31 + 1)).alias("options"), F.transform(places, lambda i: i % 3 + 1).alias("keys"),
        count(key % 40 + 5).alias("head"), count(key % 90).alias("state"), count(key % n).alias("gold"))
    return rendering.option_budget(rows, _HEAD_MOST, _MOST, _CAP)


@query(f"with {_TOKENS} select item, exceeds, hk as head_kept, sk as state_kept, seq_len, bare as lost, gone as dropped, gone > 0 as refused, kept[gold + 1] - 1 >= opts[gold + 1] as gold_whole from bd")
def g22_budget_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir).select("item", "exceeds", "head_kept", "state_kept", "seq_len", "lost", "dropped", "refused", "gold_whole")


@query(f"""with {_TOKENS} select type, count(*) filter (where item % 11 <> 0) as compared, count(*) filter (where item % 11 <> 0 and item % 5 <> 0) as equal, count(*) filter (where item % 11 = 0) as refused_seen, count(*) filter (where gone > 0) as refused_foretold, count(*) filter (where gone > 0 and item % 11 = 0) as "both" from bd group by type""")
def g22_budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth request reports another usage, every eleventh was refused."""
    from ..operators import rendering

    seen = _budget(spark, sf_dir).withColumn("used", F.col("seq_len") + (F.col("item") % 5 == 0).cast("int")).withColumn("was_refused", F.col("item") % 11 == 0)
    return rendering.budget_check(seen, ["type"], "used", "was_refused")


_KEPT = "list_transform(kept, lambda n: n - 1)"
_MORE = f"""su as (select *, list_sum(m) as ot, greatest(0, list_sum(m) - ({_HEAD_MOST} - 16)) as excess, mark[gold + 1] as gm, {_KEPT} as kt,
 len(list_distinct(list_transform(range(1, len(kept) - gone + 1), lambda i: ((i - 1) % 3 + 1)::varchar || ':' || least(kept[i] - 1, opts[i])::varchar))) as seen from bd)"""


@query(f"""with {_TOKENS}, {_MORE} select type, count(*) as requests, max(ot)::int as options_max, round(avg(exceeds::int), 6) as share_exceeding, max(excess)::int as excess_max,
 coalesce(array_to_string(list_sort(list(distinct per) filter (where exceeds)), ' '), '') as fair_shares, round(avg(bare), 6) as lost_mean, round(sum(bare)::double / sum(len(opts)), 6) as share_lost, round(avg(gone), 6) as dropped_mean, round(avg((gone > 0)::int), 6) as share_refused,
 round(avg(seen), 6) as distinct_mean, round(sum(sk)::double / sum(state), 6) as state_kept_share, max(seq_len)::int as length_max, round(avg((seq_len >= {_MOST})::int), 6) as share_at_most, round(avg(gold + 1), 6) as gold_place_mean,
 round(avg((kt[gold + 1] >= opts[gold + 1])::int), 6) as share_gold_whole, round(avg((kt[gold + 1] <= keys[gold + 1])::int), 6) as share_gold_lost, round(avg((gm >= {_MOST})::int), 6) as share_gold_dropped,
 round(median(ot), 6) as options_median, round(median(excess), 6) as excess_median, round(median(hk), 6) as head_kept_median, round(median(seq_len), 6) as length_median, round(median(gm), 6) as gold_mark_median, round(median(ot) / {_HEAD_MOST}, 6) as options_over_head_median from su group by type""")
def a43_budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay's measures by type; an option's tokens are its place by three, then 2, 3, ..."""
    from ..operators import rendering

    ids = F.transform("options", lambda n, i: F.slice(F.concat(F.array(i % 3 + 1), F.sequence(F.lit(2), n + 1)), F.lit(1), n))
    seen = _budget(spark, sf_dir).withColumn("distinct", rendering.distinct_seen(ids, F.col("kept"), F.col("dropped")))
    return _r(rendering.budget_summary(seen, ["type"], _HEAD_MOST, _MOST))
