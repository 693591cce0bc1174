"""Registered queries: families of comparisons, backbone controls, held-out cascades, refits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.hashing import draw_sql
from ..operators import calibration, comparison, curves, metrics, resampling, significance
from .evaluation import _AUC, _CASC, _CELLS, _CURVE, _FOLD, _TNLL, _WIDE, _cascade, _judged, _r, _sql

B = 20
#: Fixed values of the paired comparisons: replicates of means, whose least p is 0.0002 (B could give none
#: below 0.095), and of what sorts its rows.
PAIRED, SORTED = 10_000, 1_000

_FAM = """fm as (select {fam} as family, {mem} as member, {cl} as cl, {val} as v from {src}),
fc as (select family, member, cl, sum(v) as s, count(*) as m, row_number() over (partition by family, member order by {order}, cl) - 1 as k from fm group by family, member, cl),
fz as (select family, member, count(*) as of from fc group by all),
fd as (select family, member, b, {draw} % of as k from fz, range({b}) x(b), range((select max(of) from fz)) y(j) where j < of),
fs as (select fd.family, fd.member, b, sum(s)::double / sum(m)::double as stat from fd join fc using (family, member, k) group by fd.family, fd.member, b),
fp as (select family, member, least(1.0, 2.0 * (1 + least(count(*) filter (where stat <= 0), count(*) filter (where stat >= 0))) / ({b} + 1)) as p from fs group by family, member),
fr as (select f.family, f.member, f.n, f.points, fp.p, row_number() over (partition by f.family order by p, f.member) as rn, count(*) over (partition by f.family) as mm
  from (select family, member, count(*) as n, 100 * avg(v) as points from fm group by all having count(*) >= {least}) f join fp using (family, member))"""
_HOLM = "max(least(1.0::double, (mm - rn + 1) * p)) over (partition by family order by p, member rows between unbounded preceding and current row)"


def _fam(fam: str, mem: str, cl: str, val: str, src: str, seed: str, replicates: int, least: int = 50) -> str:
    return _FAM.format(fam=fam, mem=mem, cl=cl, val=val, src=src, draw=draw_sql(repr(seed), "b", "j"), order=draw_sql("'order'", "cl"), b=replicates, least=least)


@query(_sql(f"select family as type, member as model, n, round(points, 6) as points, round(p, 6) as p, round({_HOLM}, 6) as holm from fr", _fam("a.type", "a.model", "a.grp", "a.correct - b.correct", "dec a join dec b using (item) where b.model = 'gamma' and a.model <> 'gamma'", "g17", PAIRED)))
def g17_baseline_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model against one baseline, by type: a family for each type."""
    dec = _judged(spark, sf_dir)
    base = dec.where("model = 'gamma'").select("item", F.col("correct").alias("cb"))
    pairs = dec.where("model <> 'gamma'").join(base, "item").select("type", "model", "grp", (F.col("correct") - F.col("cb")).alias("v"))
    return _r(comparison.family(pairs, ["type"], "model", "grp", "v", PAIRED, "g17").select("type", "model", "n", "points", "p", "holm"))


_BACK = {"alpha": "gamma", "beta": "gamma"}
_SQ = "pow(p0 - (y = 0)::int, 2) + pow(p1 - (y = 1)::int, 2) + pow(p2 - (y = 2)::int, 2)"


@query(_sql(f"select split_part(family, '|', 1) as type, split_part(family, '|', 2) as metric, member as model, n, round(points, 6) as points, round(p, 6) as p, round({_HOLM}, 6) as holm from fr",
 f"sc as (select *, {_SQ} as brier from dec), " + _fam("a.type || '|' || m.metric", "a.model", "a.grp", "case m.metric when 'accuracy' then a.correct - b.correct else a.brier - b.brier end", "sc a join sc b using (item), (values ('accuracy'), ('brier')) m(metric) where a.model in ('alpha', 'beta') and b.model = 'gamma'", "g18", B)))
def g18_j19_backbone_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models against their backbones: a family for each type and metric."""
    dec = _judged(spark, sf_dir).withColumn("brier", _square(F.col("p"), F.col("y"))).select("model", "item", "type", "grp", "correct", "brier")
    both = comparison.backbone_pairs(dec, _BACK, ["item"])
    metric = F.explode(F.array(F.struct(F.lit("accuracy").alias("metric"), (F.col("correct") - F.col("correct_b")).cast("double").alias("v")), F.struct(F.lit("brier").alias("metric"), (F.col("brier") - F.col("brier_b")).alias("v"))))
    pairs = both.select("type", "model", "grp", metric.alias("x")).select("type", "x.metric", "model", "grp", "x.v")
    return _r(comparison.family(pairs, ["type", "metric"], "model", "grp", "v", B, "g18").select("type", "metric", "model", "n", "points", "p", "holm"))


def _square(p, y):
    from ..functions import vectors as V

    return V.squared_error(p, y)


@query()
def r07_auc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-scope areas of two models over the same draws, which SQL can't repeat; a test holds the statistic
    against a plain version."""
    dec = _judged(spark, sf_dir)
    a = dec.where("model = 'alpha'").select("item", "grp", F.col("in_scope").alias("positive"), F.col("conf").alias("score_a"))
    b = dec.where("model = 'beta'").select("item", F.col("conf").alias("score_b"))
    stats = comparison.auc_difference(a.join(b, "item"), "grp", B, "r07")
    return _r(significance.interval(stats.withColumn("what", F.lit("beta - alpha")), ["what"]))


@query()
def r05_refit_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of temperatures that are refitted in every replicate; a test holds them against a plain version."""
    found = resampling.refit_temperatures(_judged(spark, sf_dir), ["model"], "grp", B, "r05")
    return _r(significance.interval(found, ["model"], "temperature"))


@query()
def r05_refit_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error as answered and after scaling, the temperatures refitted by folds of each
    replicate's drawn clusters; a test holds it against a plain version."""
    stats = resampling.refit_ece(_judged(spark, sf_dir), ["model"], "grp", ["item"], B, "r05")
    return _r(significance.interval(stats, ["model", "what"]))


@query()
def r05_refit_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade's accuracy, gain, escalated share and cost, its thresholds refitted by folds of each
    replicate's drawn clusters; a test holds it against a plain version."""
    stats = resampling.refit_cascade(_cascade(spark, sf_dir), ["type"], "grp", B, "r05", "l1", "l2")
    long = stats.select("type", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("stat")) for c in ("accuracy", "gain", "escalated", "cost_fraction")])).alias("x")).select("type", "x.*")
    p = stats.groupBy("type").agg(((1 + F.count_if(F.col("gain") <= 0)) / (F.count("*") + 1)).alias("p_gain_le_0"))
    return _r(significance.interval(long, ["type", "what"]).join(p, "type"))


@query()
def g18_backbone_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, calibration error, out-of-scope area and flips of models less their backbones', by type:
    difference, interval, p and Holm's p within each type and metric. A test holds it against plain numpy."""
    dec = _judged(spark, sf_dir)
    other = dec.where("model = 'beta'").select("item", F.col("p")[0].alias("_q"))
    dec = dec.join(other, "item").select("model", "item", "type", "grp", "conf", "correct", "in_scope", ((F.col("p")[0] >= 0.5) != (F.col("_q") >= 0.5)).cast("int").alias("flip"))
    return _r(comparison.paired_metrics(comparison.backbone_pairs(dec, _BACK, ["item"]).drop("type_b", "grp_b", "in_scope_b"), ["type"], "model", "grp", "item", B, "g18"))


@query(_sql(f"""select model, round(quantile_cont(stat, 0.025), 6) as low, round(quantile_cont(stat, 0.975), 6) as high, count(*) as replicates from st group by model""", f"""cl as (select model, type, item, correct as s, row_number() over (partition by model, type order by {draw_sql("'order'", 'item')}, item) - 1 as k from dec),
sz as (select model, type, count(*) as n from cl group by all), dr as (select model, type, b, {draw_sql("'r06'", 'b', 'j')} % n as k from sz, range({B}) x(b), range((select max(n) from sz)) y(j) where j < n),
by_type as (select dr.model, dr.type, b, avg(s) as stat from dr join cl using (model, type, k) group by all), st as (select model || '/' || type as model, b, stat from by_type)"""))
def r06_item_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision a cluster of its own, by type."""
    dec = _judged(spark, sf_dir).select(F.concat_ws("/", "model", "type").alias("model"), "item", "correct")
    return _r(significance.interval(significance.bootstrap_ratio(dec, ["model"], "item", "correct", B, "r06"), ["model"]))


@query(_sql("""select type, count(*) as n, round(avg(case when conf < tau then c2 else c1 end), 6) as accuracy, round(avg((conf < tau)::int), 6) as escalated, round(avg(case when conf < tau then c2 else c1 end) - greatest(avg(c1), avg(c2)), 6) + 0.0 as gain from pf join hb using (type, fold) group by type""",
 _CASC.split(",\ntaus")[0] + ", " + _FOLD + """, pf as (select cp.*, fold from cp join gf using (grp)), ks as (select k from range(5) r(k)),
tf as (select type, k, conf as tau from pf, ks where fold <> k group by all union select distinct type, k, 0.0::double from pf, ks union select distinct type, k, 1 + 1e-9::double from pf, ks),
cf as (select tf.type, k, tau, sum(case when conf < tau then c2 else c1 end) as rt from tf join pf on pf.type = tf.type and pf.fold <> k group by tf.type, k, tau),
hb as (select type, k as fold, tau from (select *, row_number() over (partition by type, k order by rt desc, tau) as r from cf) where r = 1)"""))
def g04_held_out_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of four folds applied to the fifth; folds keep a request's decisions together."""
    pairs = significance.folds(_cascade(spark, sf_dir), "grp", "fold")
    out = comparison.held_out_cascade(pairs, ["type"], "fold", significance.FOLDS)
    gain = F.avg("correct") - F.greatest(F.avg("c1"), F.avg("c2"))
    return _r(out.groupBy("type").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("escalated").alias("escalated"), gain.alias("gain")))


@query(_sql("""select type, count(*) as n, round(avg(r), 6) as accuracy, round(avg(c1), 6) as acc_first, round(avg(c2), 6) as acc_second, round((sum(r) - greatest(sum(c1), sum(c2)))::double / count(*), 6) + 0.0 as gain,
 (sum(r) - greatest(sum(c1), sum(c2)))::bigint as gain_decisions, round(avg((conf < 0.6)::int), 6) as escalated, round((sum(l1) + sum(case when conf < 0.6 then l2 else 0 end)) / sum(l2), 6) as cost_fraction from (select *, case when conf < 0.6 then c2 else c1 end as r from cp) group by type""", _CASC.split(",\ntaus")[0]))
def g05_cascade_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import decide

    return _r(comparison.cascade_statistics(decide.merged(_cascade(spark, sf_dir), 0.6), ["type"], "l1", "l2"))


@query(_sql("""select a.model, round(avg(a.p0), 6) as mean_p, round(avg(a.p0 - r.p0), 6) + 0.0 as name_effect, round(any_value(x.auroc - y.auroc), 6) + 0.0 as delta_auc from dec a join dec r using (item) join auc x on x.model = a.model join auc y on y.model = r.model where r.model = 'beta' group by a.model""",
 _AUC.replace("order by conf)", "order by p0)").replace("partition by model, conf)", "partition by model, p0)").format(pos="y = 0")))
def g13_name_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namings (here models) against a reference: mean shift of the positive option, and of the area."""
    dec = _judged(spark, sf_dir).withColumn("p0", F.col("p")[0]).withColumn("pos", F.col("y") == 0)
    area = metrics.auroc(dec, ["model"], "p0", "pos")
    base = area.where("model = 'beta'").select(F.col("auroc").alias("base"))
    shift = dec.join(dec.where("model = 'beta'").select("item", F.col("p0").alias("r0")), "item").groupBy("model").agg(F.avg("p0").alias("mean_p"), F.avg(F.col("p0") - F.col("r0")).alias("name_effect"))
    return _r(shift.join(area, "model").crossJoin(F.broadcast(base)).select("model", "mean_p", "name_effect", (F.col("auroc") - F.col("base")).alias("delta_auc")))


def _by_type(sql: str) -> str:
    return sql.replace("model", "type")


@query(_sql("""select k, n, round(accuracy, 6) as accuracy, round(ece, 6) as ece, round(aurc, 6) as aurc, round(max(accuracy) over () - accuracy, 6) + 0.0 as drop_from_best from (select type as k, count(*) as n, avg(correct) as accuracy, any_value(e) as ece, any_value(u) as aurc from dec
 join (select type, sum(n * abs(c - a)) / sum(n) as e from cells group by type) using (type) join (select type, sum(m::double / n::double * risk) as u from rc group by type) using (type) where model = 'beta' group by type)""",
 _by_type(_CELLS).replace("from dec)", "from dec where model = 'beta')", 1) + ", " + _by_type(_CURVE).replace("from dec group by all)", "from dec where model = 'beta' group by all)", 1)))
def g14_cardinality_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, calibration error and area under risk by condition, and the drop from the best."""
    from pyspark.sql import Window

    dec = _judged(spark, sf_dir).where("model = 'beta'")
    out = dec.groupBy("type").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy")).join(metrics.ece(dec, ["type"]), "type").join(curves.aurc(curves.risk_coverage(dec, ["type"]), ["type"]), "type")
    return _r(out.withColumn("drop_from_best", F.max("accuracy").over(Window.partitionBy(F.lit(1))) - F.col("accuracy")).withColumnRenamed("type", "k"))  # a row for each condition


@query(_sql("""select n, round(composed, 6) as composed, round(flat, 6) as flat, n01, n10, round(case when n01 + n10 = 0 then 1.0 else least(1.0::double, 2 * (select sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2.0::double))) from range(least(n01, n10) + 1) r(i))) end, 6) as mcnemar_p
 from (select count(*) as n, avg(h) as composed, avg(f) as flat, count(*) filter (where h = 1 and f = 0) as n01, count(*) filter (where h = 0 and f = 1) as n10 from (select a.correct * b.correct as h, c.correct as f from dec a join dec b using (item) join dec c using (item) where a.model = 'alpha' and b.model = 'beta' and c.model = 'gamma'))"""))
def g15_hierarchical_against_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = _judged(spark, sf_dir)
    a, b, c = (dec.where(F.col("model") == m).select("item", F.col("correct").alias(m)) for m in ("alpha", "beta", "gamma"))
    both = a.join(b, "item").select("item", F.lit(1).alias("one"), (F.col("alpha") * F.col("beta")).alias("correct"))
    found = significance.paired(both, c.select("item", F.col("gamma").alias("correct")), ["item"], ["one"], least=0)
    return _r(found.select("n", F.col("acc_a").alias("composed"), F.col("acc_b").alias("flat"), "n01", "n10", "mcnemar_p"))


@query(_sql(f"select model, gi::int as gi, round(t, 6) as t, round(sum({_TNLL}), 4) as nll, count(*) as n from dec, grid group by model, gi, t", _WIDE))
def c05_grid_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of all temperatures, kept for refits."""
    return _r(calibration.grid_nll(_judged(spark, sf_dir), ["model"]).withColumn("nll", F.round("nll", 4)))



_SWEPT = """k as (select *, type::int as size from dec), an as (select model || '|' || size as model, ord, conf, correct from k where not (model = 'gamma' and size = 5 or ord % 7 = 0)),
al as (select model, size, count(*) filter (where not (model = 'gamma' and size = 5 or ord % 7 = 0)) as n, count(*) filter (where model = 'gamma' and size = 5 or ord % 7 = 0) as refused from k group by all),
"""


@query(_sql("""select model, size, n, refused, round(accuracy, 6) as accuracy, round(ece, 6) as ece, round(mean_conf, 6) as mean_conf, round(1.0::double / size, 6) as chance, round(aurc, 6) as aurc,
 round(max(accuracy) filter (where size = 1) over (partition by model) - max(accuracy) filter (where size = 5) over (partition by model), 6) + 0.0 as loss
 from (select al.*, s.accuracy, s.mean_conf, e.ece, u.aurc from al left join (select model as mk, avg(correct) as accuracy, avg(conf) as mean_conf from an group by all) s on mk = al.model || '|' || size
 left join (select model as mk, sum(n * abs(c - a)) / sum(n) as ece from cells group by all) e using (mk) left join (select model as mk, sum(m::double / n::double * risk) as aurc from rc group by all) u using (mk))""",
 _SWEPT + _CELLS.replace("from dec)", "from an)", 1) + ", " + _CURVE.replace("from dec group by all)", "from an group by all)", 1)))
def g14_refused_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models over the numbers of options; one refuses all requests at five, and all refuse a seventh."""
    size = F.col("type").cast("int")
    gone = ((F.col("model") == "gamma") & (size == 5)) | (F.col("ord") % 7 == 0)
    asked = _judged(spark, sf_dir).withColumn("size", size).withColumn("p", F.when(~gone, F.col("p")))
    return _r(comparison.cardinality_sweep(asked, ["model"], "size", 1, 5))
