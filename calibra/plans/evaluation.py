"""Registered queries: scores, calibration, curves, tests, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import vectors as V
from ..functions.hashing import draw, draw_sql
from ..functions.quantiles import quantiles
from ..operators import calibration, curves, decide, metrics, resampling, significance
from .derived import DEC_SQL, decisions, judged

B = 60


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(decisions(spark, sf_dir))


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql(body: str, ctes: str = "") -> str:
    return f"with {DEC_SQL}{', ' + ctes if ctes else ''} {body}"


_BINS = """ranked as (select *, row_number() over (partition by model order by conf, ord) - 1 as r, count(*) over (partition by model) as n from dec),
binned as (select *, (select count(*) from range(1, 11) e(b) where round_even(b * n / 10.0::double, 0)::bigint <= r) as bin from ranked)"""
_CELLS = _BINS + ", cells as (select model, bin, count(*) as n, avg(conf) as c, avg(correct) as a, sum(correct) as s, sum((conf - correct) * (conf - correct)) as brier from binned group by all)"
_CURVE = """blocks as (select model, conf, count(*) as m, sum(1 - correct) as e from dec group by all),
curve as (select model, conf as threshold, m, sum(m) over w as accepted, sum(e) over w as errors, sum(m) over (partition by model) as n from blocks window w as (partition by model order by conf desc)),
rc as (select model, threshold, m::bigint as m, accepted::bigint as accepted, errors::bigint as errors, accepted::double / n::double as coverage, errors::double / accepted::double as risk, n::bigint as n from curve)"""


@query(_sql("""select model, count(*) as n, round(avg(correct), 6) as accuracy, round(avg(-ln(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-6))), 6) as nll,
 round(avg(pow(p0 - (y = 0)::int, 2) + pow(p1 - (y = 1)::int, 2) + pow(p2 - (y = 2)::int, 2)), 6) as brier,
 any_value(e) as ece from dec join ece using (model) group by model""",
 _CELLS + ", ece as (select model, round(sum(n * abs(c - a)) / sum(n), 6) as e from cells group by model)"))
def flagship_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir)
    return _r(metrics.point_scores(dec, ["model"]).select("model", "n", "accuracy", "nll", "brier").join(metrics.ece(dec, ["model"]), "model"))


@query(_sql("""select model, type, count(*) as n, round(avg(correct), 6) as accuracy, round(avg(conf), 6) as mean_conf, round(avg((conf >= 0.9)::int), 6) as share_high,
 round(avg(correct) filter (where conf >= 0.9), 6) as acc_high, count(distinct round(conf, 6)) as distinct_conf,
 round(avg(-ln(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-6))), 6) as nll,
 round(avg(-ln(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-6) / (greatest(p0, 1e-6) + greatest(p1, 1e-6) + greatest(p2, 1e-6)))), 6) as nll_norm,
 round(avg(pow(p0 - (y = 0)::int, 2) + pow(p1 - (y = 1)::int, 2) + pow(p2 - (y = 2)::int, 2)), 6) as brier from dec group by all"""))
def a01_a14_point_scores_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.point_scores(_judged(spark, sf_dir), ["model", "type"]))


_F1 = "cls as (select model, y as c, correct, 1 as g from dec union all select model, pred, correct, 0 from dec), f as (select model, c, 2.0::double * sum(correct) filter (where g = 1) / count(*) as f1 from cls group by all)"


@query(_sql("select model, round(sum(coalesce(f1, 0)) / count(*), 6) as macro_f1 from f group by model", _F1))
def a04_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.macro_f1(_judged(spark, sf_dir), ["model"]))


@query(_sql("select model, round(sum(coalesce(f1, 0)) / 4.0::double, 6) as macro_f1 from f group by model", _F1))
def a04b_macro_f1_all_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.macro_f1(_judged(spark, sf_dir), ["model"], classes=4))


@query(_sql("select model, round(sum(n * abs(c - a)) / sum(n), 6) as ece from cells group by model", _CELLS))
def a05_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.ece(_judged(spark, sf_dir), ["model"]))


@query(_sql("select model, bin::int as bin, n, round(c, 6) as conf, round(a, 6) as acc from cells", _CELLS))
def a06_w02_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.reliability(_judged(spark, sf_dir), ["model"]))


@query(_sql("""select model, n::bigint as n, round(rel, 6) + 0.0 as reliability, round(sq - base * base, 6) + 0.0 as resolution, round(base * (1 - base), 6) + 0.0 as uncertainty,
 round(top - rel + (sq - base * base) - base * (1 - base), 6) + 0.0 as residual, round(top, 6) + 0.0 as brier_top from whole""",
 _CELLS + ", whole as (select model, sum(n) as n, sum(s)::double / sum(n) as base, sum(brier) / sum(n) as top, sum(n * (c - a) * (c - a)) / sum(n) as rel, sum(n * a * a) / sum(n) as sq from cells group by model)"))
def a07_murphy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.murphy(_judged(spark, sf_dir), ["model"]))


@query(_sql("select model, round(sum(m::double / n::double * risk), 6) as aurc from rc group by model", _CURVE))
def a08_aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(curves.aurc(curves.risk_coverage(_judged(spark, sf_dir), ["model"]), ["model"]))


@query(_sql("""select model, round(coalesce(max(coverage) filter (where risk <= 0.05), 0), 6) as coverage, round(min(threshold) filter (where risk <= 0.05), 6) as threshold,
 coalesce(max(accepted) filter (where risk <= 0.05), 0) as accepted, coalesce(arg_max(errors, coverage) filter (where risk <= 0.05), 0) as errors from
 (select *, coverage = max(coverage) filter (where risk <= 0.05) over (partition by model) as best from rc) where true group by model""".replace("round(min(threshold) filter (where risk <= 0.05), 6)", "round(arg_max(threshold, coverage) filter (where risk <= 0.05), 6)"), _CURVE))
def a09_coverage_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(curves.coverage_at_risk(curves.risk_coverage(_judged(spark, sf_dir), ["model"]), ["model"], 0.05))


_AUC = """ar as (select model, {pos} as pos, rank() over (partition by model order by conf) + (count(*) over (partition by model, conf) - 1) / 2.0::double as rk from dec),
auc as (select model, (sum(rk) filter (where pos) - count(*) filter (where pos) * (count(*) filter (where pos) + 1) / 2.0::double) / (count(*) filter (where pos) * count(*) filter (where not pos))::double as auroc from ar group by model)"""


@query(_sql("select model, round(auroc, 6) as auroc from auc", _AUC.format(pos="correct = 1")))
def a10_w03_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.auroc(_judged(spark, sf_dir).withColumn("pos", F.col("correct") == 1), ["model"], "conf", "pos"))


@query(_sql("select model, round(avg(case pred when 0 then s0 when 1 then s1 else s2 end), 6) as soft_accuracy, round(avg(pow(p0 - s0, 2) + pow(p1 - s1, 2) + pow(p2 - s2, 2)), 6) as soft_brier from (select *, (1 + (y = 0)::int) / 4.0::double as s0, (1 + (y = 1)::int) / 4.0::double as s1, (1 + (y = 2)::int) / 4.0::double as s2 from dec) group by model"))
def a12_soft_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = F.array(*[(1 + (F.col("y") == k).cast("int")) / 4.0 for k in range(3)])
    return _r(metrics.soft_scores(_judged(spark, sf_dir).withColumn("soft", soft), ["model"]))


@query(_sql("""select model, round(avg(conf) filter (where in_scope), 6) as mean_conf_in, round(avg(conf) filter (where not in_scope), 6) as mean_conf_out,
 round(avg((conf >= 0.9)::int) filter (where not in_scope), 6) as share_out_high, round(any_value(auroc), 6) as auroc from dec join auc using (model) group by model""", _AUC.format(pos="in_scope")))
def a15_scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.scope_summary(_judged(spark, sf_dir), ["model"]))


@query(_sql("""select model, 'pooled' as task, count(*) as n, round(avg(correct), 6) as accuracy, count(distinct cluster) as clusters from
 (select *, type || '/' || grp as cluster from dec where type in ('1', '2') union all select *, type || '/' || grp from dec where type = '3') group by model"""))
def a16_u06_pooled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "type", "grp"))
    both = dec.where("type in ('1', '2')").unionByName(dec.where("type = '3'"))
    pooled = both.groupBy("model").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.count_distinct("cluster").alias("clusters"))
    return _r(pooled.select("model", F.lit("pooled").alias("task"), "n", "accuracy", "clusters"))


@query(_sql("select model, floor(5 * y / 3)::int as gold_fifth, count(*) as n, round(avg(correct), 6) as accuracy, round(avg((pred = 0)::int), 6) as first_share, round(avg((pred = 2)::int), 6) as last_share from dec group by all"))
def a29_a30_position_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.position_shares(_judged(spark, sf_dir), ["model"], 3))


@query(_sql("select model, fifth::int as fifth, count(*) as n, round(avg((floor(5 * pred / 3) = fifth)::int), 6) as predicted_share, round(avg((floor(5 * y / 3) = fifth)::int), 6) as gold_share from dec, range(5) f(fifth) where y is not null group by all"))
def a30_predicted_fifths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.position_fifths(_judged(spark, sf_dir), ["model"], F.lit(3)))


_ROUNDED = _CURVE.replace("blocks as (select model, conf, count(*) as m, sum(1 - correct) as e from dec group by all)", """hu as (select *, round_even(p0 * 100, 0) / 100 as a, round_even(p1 * 100, 0) / 100 as b, round_even(p2 * 100, 0) / 100 as c from dec),
rd as (select model, y, a / (a + b + c) as a, b / (a + b + c) as b, c / (a + b + c) as c from hu),
blocks as (select model, greatest(a, b, c) as conf, count(*) as m, sum((case when a >= b and a >= c then 0 when b >= c then 1 else 2 end <> y)::int) as e from rd group by all)""")


@query(_sql("""select model, any_value(n) as n, round(coalesce(max(coverage) filter (where kind = 0 and risk <= 0.3::double), 0), 6) as coverage, round(coalesce(max(coverage) filter (where kind = 1 and risk <= 0.3::double), 0), 6) as coverage_rounded
 from (select model, n, coverage, risk, 0 as kind from rc union all select model, n, coverage, risk, 1 from rc2) group by model""",
 _CURVE + ", " + _ROUNDED.replace("blocks", "blocks2").replace("curve as", "curve2 as").replace("from curve)", "from curve2)").replace("rc as", "rc2 as")))
def g20_rounding_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage at a risk of 0.3 with probabilities as answered, and rounded to hundredths."""
    dec = _judged(spark, sf_dir)
    both = [judged(dec.withColumn("p", p)) for p in (F.col("p"), V.rounded(F.col("p"), 2))]
    found = [curves.coverage_at_risk(curves.risk_coverage(d, ["model"]), ["model"], 0.3) for d in both]
    n = dec.groupBy("model").agg(F.count("*").alias("n"))
    return _r(n.join(found[0].select("model", "coverage"), "model").join(found[1].select("model", F.col("coverage").alias("coverage_rounded")), "model"))


@query(_sql("select model, count(*) as n, round(avg((conf >= 0.999)::int), 6) as saturated from dec group by model"))
def a44_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_judged(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("conf") >= 0.999).cast("int")).alias("saturated")))


@query(_sql("select model, round(threshold, 6) as threshold, m, accepted, errors, round(coverage, 6) as coverage, round(risk, 6) as risk, n from rc", _CURVE))
def w01_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(curves.risk_coverage(_judged(spark, sf_dir), ["model"]))


# Vectors

_V = "select model, item, {0} from dec where model = 'beta'"


@query(_sql("select model, item, round(pow(p0, 2) / s, 6) as a, round(pow(p1, 2) / s, 6) as b, round(pow(p2, 2) / s, 6) as c from (select *, pow(p0, 2) + pow(p1, 2) + pow(p2, 2) as s from dec)"))
def p05_c01_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temperature of 1/2 and the undoing of a served temperature of 2 are the same power."""
    q = V.tempered(F.col("p"), 0.5)
    return _r(decisions(spark, sf_dir).withColumn("q", q).select("model", "item", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"), F.col("q")[2].alias("c")))


@query(_sql("select model, item, round(case when s > 0 then a / s else 1 / 3.0::double end, 6) as a, round(case when s > 0 then b / s else 1 / 3.0::double end, 6) as b from (select *, a + b + c as s from (select model, item, round_even(p0, 2) as a, round_even(p1, 2) as b, round_even(p2, 2) as c from dec))"))
def p18_rounded_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = decisions(spark, sf_dir).withColumn("q", V.rounded(F.col("p")))
    return _r(dec.select("model", "item", F.col("q")[0].alias("a"), F.col("q")[1].alias("b")))


@query(_sql("select model, count(*) filter (where in_scope) as n, round(avg(correct) filter (where in_scope), 6) as accuracy from dec group by model"))
def p08_p10_scored_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = metrics.scored(_judged(spark, sf_dir)).where("in_scope")
    return _r(dec.groupBy("model").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy")))


@query(_sql("select model, (count(*) filter (where item % 7 <> 0)) as answered, count(*) as total from dec group by model"))
def p09_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage(decisions(spark, sf_dir).withColumn("p", F.when(F.col("item") % 7 != 0, F.col("p"))), ["model"])


# Calibration

_GRID = "grid as (select i as gi, exp(ln({low}) + i * ((ln({high}) - ln({low})) / ({n} - 1))) as t from range({n}) g(i))"
_TNLL = "-ln(greatest(pow(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-6), 1 / t) / (pow(greatest(p0, 1e-6), 1 / t) + pow(greatest(p1, 1e-6), 1 / t) + pow(greatest(p2, 1e-6), 1 / t)), 1e-6))"
_WIDE = _GRID.format(low="0.2::double", high="20.0::double", n=120)
_NARROW = _GRID.format(low="0.25::double", high="8.0::double", n=60)
_FITTED = "sums as (select {by}, gi, t, sum(" + _TNLL + ") as v, count(*) as n from dec{src}, grid group by all), best as (select *, row_number() over (partition by {by} order by round(v, 6), gi) as r from sums)"


@query(_sql("select model, round(t, 6) as temperature, gi::int as gi, n, gi = 0 as at_low, gi = 119 as at_high from best where r = 1", _WIDE + ", " + _FITTED.format(by="model", src=" where model <> '' and true".replace(" where model <> '' and true", ""))))
def c02_c06_temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(calibration.fit(_judged(spark, sf_dir), ["model"]))


@query(_sql("select model, round(t, 6) as temperature, gi::int as gi, n, gi = 0 as at_low, gi = 59 as at_high from best where r = 1", _NARROW + ", " + _FITTED.format(by="model", src="")))
def c02b_narrow_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(calibration.fit(_judged(spark, sf_dir), ["model"], calibration.NARROW))


@query(_sql("select model, type, round(case when n >= 30 then t else 1.0 end, 6) as temperature, n from best where r = 1", _WIDE + ", " + _FITTED.format(by="model, type", src="")))
def c04_c07_fit_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(calibration.fit_by_slice(_judged(spark, sf_dir), ["model", "type"]).select("model", "type", "temperature", "n"))


_FOLD = "gf as (select grp, (row_number() over (order by " + draw_sql("'fold'", "grp") + ", grp) - 1) % 5 as fold from (select distinct grp from dec))"
_CROSS = f"""{_WIDE}, {_FOLD}, part as (select model, fold, gi, t, sum({_TNLL}) as v, count(*) as n from dec join gf using (grp), grid group by all),
rest as (select model, fold, gi, t, sum(v) over (partition by model, gi) - v as v, sum(n) over (partition by model, gi) - n as n from part),
best as (select *, row_number() over (partition by model, fold order by round(v, 6), gi) as r from rest)"""


@query(_sql("select model, fold::int as fold, round(t, 6) as temperature, gi::int as gi, n::bigint as n from best where r = 1", _CROSS))
def c03_cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = significance.folds(_judged(spark, sf_dir), "grp", "fold")
    return _r(calibration.cross_fit(dec, ["model"]).select("model", "fold", "temperature", "gi", "n"))


@query(_sql("""select model, count(*) as n, round(avg(-ln(greatest(pow(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-6), 1 / temp) / (pow(greatest(p0, 1e-6), 1 / temp) + pow(greatest(p1, 1e-6), 1 / temp) + pow(greatest(p2, 1e-6), 1 / temp)), 1e-6))), 6) as nll
 from dec join gf using (grp) join (select model, fold, t as temp from best where r = 1) using (model, fold) group by model""", _CROSS))
def c03_c05_cross_fitted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = significance.folds(_judged(spark, sf_dir), "grp", "fold")
    out = calibration.scaled(dec, calibration.cross_fit(dec, ["model"]), ["model", "fold"])
    return _r(out.groupBy("model").agg(F.count("*").alias("n"), F.avg(metrics.nll(F.col("p"), F.col("y"))).alias("nll")))


# Tests and resampling

@query(_sql("select fold::int as fold, count(*) as groups from gf group by fold", _FOLD))
def r16_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = decisions(spark, sf_dir).select("grp").distinct()
    return significance.folds(groups, "grp", "fold").groupBy("fold").agg(F.count("*").alias("groups"))


_BOOT = f"""cl as (select model, grp, sum(correct) as s, count(*) as m, row_number() over (partition by model order by {draw_sql("'order'", 'grp')}, grp) - 1 as k from dec group by model, grp),
sz as (select model, count(*) as n from cl group by model),
dr as (select model, b, {draw_sql("'boot'", "b", "j")} % n as k from sz, range({B}) x(b), range((select max(n) from sz)) y(j) where j < n),
st as (select dr.model, b, sum(s)::double / sum(m)::double as stat from dr join cl using (model, k) group by dr.model, b)"""


@query(_sql("select model, round(quantile_cont(stat, 0.025), 6) as low, round(quantile_cont(stat, 0.975), 6) as high, count(*) as replicates from st group by model", _BOOT))
def r03_r08_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(significance.interval(significance.bootstrap_ratio(_judged(spark, sf_dir), ["model"], "grp", "correct", B, "boot"), ["model"]))


@query(_sql(f"""select model, round(least(1.0, 2.0 * (1 + least(lo, hi)) / ({B} + 1)), 6) as p, round((1 + lo) / ({B} + 1.0), 6) as p_one_sided, round(greatest(2.0 * least(lo, hi) / {B}, 1.0 / {B}), 6) as p_older
 from (select model, count(*) filter (where stat - 0.6 <= 0) as lo, count(*) filter (where stat - 0.6 >= 0) as hi from st group by model)""".replace("0.6", "0.6::double"), _BOOT))
def r09_r10_bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = significance.bootstrap_ratio(_judged(spark, sf_dir), ["model"], "grp", "correct", B, "boot").withColumn("stat", F.col("stat") - F.lit(0.6))
    return _r(significance.p_two_sided(stats, ["model"]))


@query()
def r01_r04_q06_weighted_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error of resampled clusters: bins are formed anew in each replicate, by weights."""
    dec = _judged(spark, sf_dir).select("model", "grp", "item", "conf", "correct")
    rows = dec.join(resampling.drawn(dec, ["model"], "grp", 20, "r01"), ["model", "grp"])
    return significance.interval(resampling.weighted_ece(rows, ["model"], "conf", "correct", ["item"], 20), ["model"])


_PAIR = "pr as (select a.type, a.item, a.correct as ca, b.correct as cb from dec a join dec b using (item) where a.model = 'alpha' and b.model = 'beta'), pc as (select type, count(*) as n, avg(ca) as acc_a, avg(cb) as acc_b, avg(ca - cb) as diff, count(*) filter (where ca = 1 and cb = 0) as n01, count(*) filter (where ca = 0 and cb = 1) as n10 from pr group by type)"
_MC = "case when n01 + n10 = 0 then 1.0 else least(1.0::double, 2 * (select sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2.0::double))) from range(least(n01, n10) + 1) r(i))) end"


@query(_sql(f"select type, n, round(acc_a, 6) as acc_a, round(acc_b, 6) as acc_b, round(diff, 6) as diff, n01, n10, round(case when n >= 30 then {_MC} end, 6) as mcnemar_p from pc", _PAIR))
def r12_g16_j02_paired_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir)
    return _r(significance.paired(dec.where("model = 'alpha'"), dec.where("model = 'beta'"), ["item"], ["type"]))


@query(_sql(f"""select type, round(p, 6) as mcnemar_p, round(max(least(1.0::double, (m - rn + 1) * p)) over (order by p, type rows between unbounded preceding and current row), 6) as holm
 from (select *, row_number() over (order by p, type) as rn, count(*) over () as m from (select type, {_MC} as p from pc))""", _PAIR))
def w04_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holm(_judged(spark, sf_dir))


def _holm(dec: DataFrame) -> DataFrame:
    dec = dec.withColumn("family", F.lit("types"))
    found = significance.paired(dec.where("model = 'alpha'"), dec.where("model = 'beta'"), ["item"], ["family", "type"], least=0)
    return _r(significance.holm(found, ["family"], "mcnemar_p", "type").select("type", "mcnemar_p", "holm"))


#: Limits by 60 bisections: the p at which the tail of k errors in n falls to a.
_TAIL = "list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))))"
_LIMITS = f"""cell as (select model, type, sum(1 - correct)::bigint as errors, count(*)::bigint as n from dec group by all),
ask as (select model, type, n, what, case what when 'low' then n - errors else errors end as k, case what when 'upper' then 0.05::double else 0.025::double end as a from cell, (values ('low'), ('high'), ('upper')) w(what)),
bis as (select *, 0.0::double as lo, 1.0::double as hi, 0 as i from ask where k < n union all select model, type, n, what, k, a, case when above then (lo + hi) / 2 else lo end, case when above then hi else (lo + hi) / 2 end, i + 1 from (select *, {_TAIL} > a as above from bis where i < 60)),
lim as (select model, type, what, (lo + hi) / 2 as v from bis where i = 60 union all select model, type, what, 1.0::double from ask where k >= n)"""


@query(_sql("select model, type, errors as k, n, round(1 - max(v) filter (where what = 'low'), 6) + 0.0 as low, round(max(v) filter (where what = 'high'), 6) as high, round(max(v) filter (where what = 'upper'), 6) as upper from cell join lim using (model, type) group by all", _LIMITS).replace("with ", "with recursive ", 1))
def r13_r14_clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _judged(spark, sf_dir).groupBy("model", "type").agg(F.sum(1 - F.col("correct")).alias("k"), F.count("*").alias("n"))
    return _r(cells.withColumn("x", significance.clopper_pearson()(F.col("k"), F.col("n"))).select("model", "type", "k", "n", "x.*"))


@query(_sql("""select model, type, k::bigint as k, n, round((select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3::double) + (n - i) * ln(0.7::double))) from range(k::bigint + 1) r(i)), 6) as cdf
 from (select model, type, sum(1 - correct) as k, count(*) as n from dec group by all)"""))
def r15_binomial_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binomial_cdf(_judged(spark, sf_dir))


def _binomial_cdf(dec: DataFrame) -> DataFrame:
    cells = dec.groupBy("model", "type").agg(F.sum(1 - F.col("correct")).alias("k"), F.count("*").alias("n"))
    return _r(cells.withColumn("cdf", significance.binomial_cdf(F.col("k"), F.col("n"), F.lit(0.3))))


# Decisions and cascades

_CASC = """cp as (select a.type, a.item, a.grp, a.conf, a.correct as c1, b.correct as c2, a.latency_s as l1, b.latency_s as l2 from dec a join dec b using (item) where a.model = 'gamma' and b.model = 'alpha'),
taus as (select distinct type, conf as tau from cp union select distinct type, 0.0::double from cp union select distinct type, 1 + 1e-9::double from cp),
cv as (select taus.type, tau, count(*) filter (where conf < tau) as escalated, sum(case when conf < tau then c2 else c1 end) as rt, count(*) as n from taus join cp using (type) group by taus.type, tau)"""


def _cascade(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    dec = _judged(spark, sf_dir).where(where)
    a = dec.where("model = 'gamma'").select("type", "item", "grp", "conf", F.col("correct").alias("c1"), F.col("latency_s").alias("l1"))
    b = dec.where("model = 'alpha'").select("item", F.col("correct").alias("c2"), F.col("latency_s").alias("l2"))
    return a.join(b, "item")


@query(_sql("select type, round(tau, 9) as tau, rt::bigint as 'right', escalated, n from (select *, row_number() over (partition by type order by rt desc, tau) as r from cv) where r = 1", _CASC))
def g02_w05_w06_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(curves.best_threshold(curves.cascade_curve(_cascade(spark, sf_dir), ["type"]), ["type"]), 9)


@query(_sql("""select type, round(max(rt)::double / max(n), 6) as best_accuracy, round(min(escalated::double / n) filter (where rt >= k2), 6) as match, round(min(escalated::double / n) filter (where rt >= 0.95::double * k2), 6) as retain95,
 round(min(escalated::double / n) filter (where rt >= 0.99::double * k2), 6) as retain99 from cv join (select type, sum(c2) as k2 from cp group by type) using (type) group by type""", _CASC))
def g03_cascade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade_summary(_cascade(spark, sf_dir))


def _cascade_summary(pairs: DataFrame) -> DataFrame:
    return _r(curves.cascade_summary(curves.cascade_curve(pairs, ["type"]), ["type"], pairs.groupBy("type").agg(F.sum("c2").alias("k2"))))


@query(_sql("select type, count(*) as n, round(avg(case when conf < 0.6 then c2 else c1 end), 6) as accuracy, round(avg((conf < 0.6)::int), 6) as escalated, round(quantile_cont(l1 + case when conf < 0.6 then l2 else 0 end, 0.5), 6) as p50 from cp group by type", _CASC))
def g01_g07_cascade_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.merged(_cascade(spark, sf_dir), 0.6)
    sums = out.groupBy("type").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("escalated").alias("escalated"))
    return _r(sums.join(quantiles(out, ["type"], "latency", {"p50": 0.5}), "type"))


@query(_sql("""select type, count(*) as n, round(avg(case when gate < 0.45 then c2 else c1 end), 6) as all_accuracy, round(avg(case when gate < 0.45 and conf < 0.45 then c2 else c1 end), 6) as low_accuracy, round(avg((gate < 0.45)::int), 6) as sent
 from (select *, min(conf) over (partition by grp) as gate from cp) group by type""", _CASC))
def g06_request_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.request_gate(_cascade(spark, sf_dir), "grp", 0.45)
    return _r(out.groupBy("type").agg(F.count("*").alias("n"), F.avg("replace_all").alias("all_accuracy"), F.avg("replace_low").alias("low_accuracy"), F.avg("sent").alias("sent")))


_HELD = """thr as (select model, arg_max(threshold, coverage) filter (where risk <= 0.1) as threshold from (select model, threshold, accepted::double / n as coverage, errors::double / accepted as risk from
 (select model, conf as threshold, sum(count(*)) over w as accepted, sum(sum(1 - correct)) over w as errors, sum(count(*)) over (partition by model) as n from dec where item % 2 = 0 group by model, conf window w as (partition by model order by conf desc))) group by model)"""


@query(_sql("""select model, count(*) as n, round(any_value(threshold), 6) as threshold, count(*) filter (where conf >= threshold) as accepted, count(*) filter (where conf >= threshold and correct = 0) as errors,
 round(count(*) filter (where conf >= threshold) / count(*)::double, 6) as coverage, round(case when count(*) filter (where conf >= threshold) > 0 then count(*) filter (where conf >= threshold and correct = 0)::double / count(*) filter (where conf >= threshold) end, 6) as risk
 from dec join thr using (model) where item % 2 = 1 group by model""", _HELD))
def g04_g08_held_out_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir)
    found = curves.coverage_at_risk(curves.risk_coverage(dec.where("item % 2 = 0"), ["model"]), ["model"], 0.1).select("model", "threshold")
    out = decide.realized(dec.where("item % 2 = 1"), ["model"], found).join(found, "model")
    return _r(out.select("model", "n", "threshold", "accepted", "errors", "coverage", "risk"))


@query(_sql("""select model, count(*) filter (where conf >= threshold) as accepted, count(*) filter (where conf >= threshold and (not in_scope or correct = 0)) as errors,
 round(avg((conf >= threshold)::int) filter (where in_scope), 6) as coverage_in, round(avg((conf >= threshold)::int) filter (where not in_scope), 6) as false_acceptance from dec join thr using (model) group by model""", _HELD))
def g09_intent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir)
    found = curves.coverage_at_risk(curves.risk_coverage(dec.where("item % 2 = 0"), ["model"]), ["model"], 0.1).select("model", "threshold")
    return _r(decide.intent_gate(dec, ["model"], found))


@query(_sql("select model, count(*) filter (where conf >= 0.5 and pred <> 2) as routed, count(*) filter (where conf >= 0.5 and pred <> 2 and correct = 0) as errors from dec group by model"))
def g10_option_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.option_gate(_judged(spark, sf_dir), 2)
    go = F.col("conf_route") >= 0.5
    return out.groupBy("model").agg(F.count_if(go).alias("routed"), F.count_if(go & (F.col("correct") == 0)).alias("errors"))


_LTT = """pts as (select round(0.5 + 0.02 * i, 4)::double as t from range(25) r(i) union all select 1.0::double - pow(10.0::double, -(2.0 + 0.25 * i)) from range(25) r(i)),
lt as (select model, t, count(*) as accepted, sum(1 - correct)::bigint as errors from dec, pts where conf >= t group by model, t),
ok as (select *, row_number() over (partition by model order by t) as r from lt where (select sum(exp(lgamma(accepted + 1) - lgamma(k + 1) - lgamma(accepted - k + 1) + k * ln(0.2::double) + (accepted - k) * ln(0.8::double))) from range(errors + 1) x(k)) <= 0.1::double / 50)"""


@query(_sql("""select model, n, round(t, 8) as threshold, coalesce(accepted, 0)::bigint as accepted, coalesce(errors, 0)::bigint as errors, round(coalesce(accepted, 0)::double / n, 8) as coverage, round(errors::double / accepted, 8) as risk
 from (select model, count(*) as n from dec group by model) left join (select * from ok where r = 1) using (model)""", _LTT))
def g11_learn_then_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(decide.learn_then_test(_judged(spark, sf_dir), ["model"], 0.2, 0.1), 8)


@query(_sql("select type as k, count(*) as n, round(avg(correct), 6) as accuracy, round(max(avg(correct)) over () - avg(correct), 6) + 0.0 as drop_from_best from dec where model = 'beta' group by type"))
def g14_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score by condition and its drop from the best; conditions are few, so their window is one partition."""
    from pyspark.sql import Window

    out = _judged(spark, sf_dir).where("model = 'beta'").groupBy(F.col("type").alias("k")).agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))
    return _r(out.withColumn("drop_from_best", F.max("accuracy").over(Window.partitionBy(F.lit(1))) - F.col("accuracy")))


@query(_sql("select count(*) as n, round(avg(a.correct * b.correct), 6) as composed, round(avg(c.correct), 6) as flat from dec a join dec b using (item) join dec c using (item) where a.model = 'alpha' and b.model = 'beta' and c.model = 'gamma'"))
def g15_j04_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir)
    a, b, c = (dec.where(F.col("model") == m).select("item", F.col("correct").alias(m)) for m in ("alpha", "beta", "gamma"))
    return _r(a.join(b, "item").join(c, "item").agg(F.count("*").alias("n"), F.avg(F.col("alpha") * F.col("beta")).alias("composed"), F.avg("gamma").alias("flat")))


@query(_sql("select model, round(avg(correct) filter (where not seen), 6) as unseen_accuracy, round(avg(correct), 6) as accuracy from (select dec.*, e.grp is not null as seen from dec left join (select distinct c_custkey as grp from customer where c_mktsegment = 'BUILDING') e using (grp)) group by model"))
def g19_j09_exposure_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("grp")).distinct().withColumn("seen", F.lit(True))
    dec = _judged(spark, sf_dir).join(seen, "grp", "left")
    return _r(dec.groupBy("model").agg(F.avg(F.when(F.col("seen").isNull(), F.col("correct"))).alias("unseen_accuracy"), F.avg("correct").alias("accuracy")))


_PTS = "pt as (select model, type, round(avg(correct), 6) as quality, round(avg(usage_in), 6) as cost, round(avg(latency_s), 6) as latency from dec group by all), pk as (select model || type as k, quality, cost, latency from pt)"


@query(_sql("select a.k, a.quality, a.cost, a.latency, exists (select 1 from pk b where b.k <> a.k and b.quality >= a.quality and b.cost <= a.cost and b.latency <= a.latency and (b.quality > a.quality or b.cost < a.cost or b.latency < a.latency)) as dominated from pk a", _PTS))
def g25_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _r(_judged(spark, sf_dir).groupBy("model", "type").agg(F.avg("correct").alias("quality"), F.avg("usage_in").alias("cost"), F.avg("latency_s").alias("latency")))
    return decide.dominated(points.select(F.concat("model", "type").alias("k"), "quality", "cost", "latency"), "k", ["quality"], ["cost", "latency"])


@query(_sql("select rep_a::int as rep_a, rep_b::int as rep_b, count(*) as n, round(avg((pa <> pb)::int), 6) as flip_rate, round(avg(abs(ca - cb)), 6) as mean_change, round(avg((ca = cb)::int), 6) as identical from (select x.rep as rep_a, y.rep as rep_b, x.pred as pa, y.pred as pb, x.conf as ca, y.conf as cb from rp x join rp y on x.item = y.item and x.rep < y.rep) group by all",
 "rp as (select case model when 'alpha' then 1 when 'beta' then 2 else 3 end as rep, item, pred, conf from dec)"))
def r18_j05_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.answers import repeats

    rep = F.when(F.col("model") == "alpha", 1).when(F.col("model") == "beta", 2).otherwise(3)
    return _r(repeats(_judged(spark, sf_dir).select(rep.alias("rep"), "item", "pred", "conf"), ["item"]))


@query(_sql("select count(*) as n, round(avg((k = 1)::int), 6) as agreement from (select item, count(distinct pred) as k from dec group by item having count(distinct model) = 3)"))
def r19_j03_permutation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.answers import all_present

    return _r(all_present(_judged(spark, sf_dir), ["item"], "model", 3).agg(F.count("*").alias("n"), F.avg(F.col("agree").cast("int")).alias("agreement")))


@query(_sql("select type, round(max(a) - min(a), 6) as accuracy_range from (select model, type, avg(correct) as a from dec group by all) group by type"))
def r20_service_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _judged(spark, sf_dir).groupBy("model", "type").agg(F.avg("correct").alias("a"))
    return _r(out.groupBy("type").agg((F.max("a") - F.min("a")).alias("accuracy_range")))


@query(_sql(f"select item % 10 as grp10, count(*) as n, round(100.0 * avg(((conf >= 0.5) <> (other >= 0.5))::int), 6) as flips_per_100 from (select *, lead(conf) over (partition by item order by model) as other from dec where model in ('alpha', 'beta')) where other is not null group by all"))
def g12_g21_name_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir)
    a, b = dec.where("model = 'alpha'").select("item", "conf"), dec.where("model = 'beta'").select("item", F.col("conf").alias("other"))
    return _r(a.join(b, "item").groupBy((F.col("item") % 10).alias("grp10")).agg(F.count("*").alias("n"), (100.0 * F.avg(((F.col("conf") >= 0.5) != (F.col("other") >= 0.5)).cast("int"))).alias("flips_per_100")))


@query(_sql(f"select model, round(sum(case when u % 3 = 0 then 1 else 0 end)::double / count(*), 6) as share, count(*) as n from (select *, {draw_sql(repr('one'), 'item')} as u from dec) group by model"))
def x00_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(decisions(spark, sf_dir).withColumn("u", draw("one", F.col("item"))).groupBy("model").agg((F.sum(F.when(F.col("u") % 3 == 0, 1).otherwise(0)) / F.count("*")).alias("share"), F.count("*").alias("n")))
