"""Registered queries: ledger checks, excerpts, selection lines, censuses, designs, small batches."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.hashing import draw, draw_sql
from ..functions.ranking import numbered
from ..operators import answers, design, evidence, ledger, overlap
from .derived import table
from .evaluation import _r
from .records import _EST, _GRADES, _NORM, LOG_SQL, RAT_SQL, answer_log, estimates, grades, ratings


@query("select p_partkey as id, case when p_partkey % 2 = 0 and p_size % 3 < 2 then 'not_reported' when p_size % 3 = 0 then ' ' when p_size % 3 = 1 then 'Unclear' else 'human' end as label from part")
def p26_label_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(F.lit(" "), F.lit("Unclear"), F.lit("human")), (F.col("p_size") % 3 + 1).cast("int"))
    version = F.when(F.col("p_partkey") % 2 == 0, "1.2").otherwise("1.0")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ledger.fixed_label(label, version).alias("label"))


@query("select p_partkey as id, case when p_partkey % 2 = 0 and p_size % 2 = 0 then '15 bins, scheme not stated' when p_size % 2 = 0 then '15 bins, spacing not stated' else 'own scheme' end as name from part")
def p27_binning_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = F.when(F.col("p_partkey") % 2 == 0, "r2Jev").otherwise("r1Acc")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ledger.group_name(analysis, F.when(F.col("p_size") % 2 == 0, "15 bins, spacing not stated").otherwise("own scheme")).alias("name"))


@query(f"with {_GRADES}, c as (select g.*, o.overall, list_count(list_filter([d2, d3, d4], lambda x: x = 'high')) as ch, list_count(list_filter([d2, d3, d4], lambda x: x = 'unclear')) as cu from gr g join go o using (study)) select study, case when d2 is null and d3 is null and d4 is null then '' when ch >= 2 then 'high' when ch = 0 and cu <= 1 then 'low' else 'some_concerns' end as grade from c")
def n04_cost_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades(spark, sf_dir).select("study", ledger.cost_grade([F.col(f"d{i}") for i in range(1, 6)]).alias("grade"))


@query(f"""with {_GRADES}, r as (select gr.*, case when study % 11 = 0 then 'low' else overall end as given, overall from gr join go using (study))
select study, problem from (select study, 'rating' as problem from r where d1 is null or d2 is null or d3 is null or d4 is null or d5 is null union all select study, 'rule' from r where given <> overall union all select study, 'orphan' from r where study not in (select o_orderkey from orders where o_orderstatus <> 'P'))""")
def n02_grade_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rob = grades(spark, sf_dir).withColumn("overall", F.when(F.col("study") % 11 == 0, "low").otherwise(F.col("overall")))
    return ledger.grade_problems(rob, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("study")))


@query("""select p_partkey as id, case p_partkey % 6 when 0 then 'ok' when 1 then 'value_not_in_excerpt' when 2 then 'derived' when 3 then 'table_ok' when 4 then 'not_found' else 'no_fulltext' end as status from part""")
def n05_t03_t09_t10_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each part, and an excerpt for each verdict; ligatures, dashes and quotes are typographic in one of the two."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    study = F.concat(F.lit("2609."), F.col("p_partkey").cast("string"))
    body = F.concat(F.lit("The ﬁrst model — “"), "p_type", F.lit("” — reached "), size, F.lit(" points. Table 3: accuracy of the models on all tasks, "), size, F.lit(" and 7.5 there."))
    texts = p.where("p_partkey % 6 <> 5").select(study.alias("study"), body.alias("text"))
    excerpt = (
        F.when(n == 0, F.concat(F.lit('The first model - "'), "p_type", F.lit('" - ... reached '), size, F.lit(" points")))
        .when(n.isin(1, 2, 5), F.concat(F.lit("“"), "p_type", F.lit("”; reached")))
        .when(n == 3, F.lit("Table 3: accuracy of the models on all tasks // row none, col x"))
        .otherwise(F.lit("Table 9: nothing of this kind stands in any text | x")))
    rows = p.select(F.col("p_partkey").alias("id"), F.concat(study, F.lit("v2")).alias("study"), excerpt.alias("excerpt"), F.when(n == 1, "9999").when(n == 2, "8888").otherwise(size).alias("value"), F.when(n == 2, " Derived from Table 3").alias("location"))
    return ledger.verified_excerpts(rows, texts).select("id", "status")


@query("select p_partkey as id, case p_partkey % 6 when 0 then true when 1 then p_size % 10 < 5 or (p_size % 10 = 5 and (p_size // 10) % 2 = 0) when 2 then true when 3 then false when 4 then true else false end as same from part where p_size > 0")
def n07_value_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal text, a coarser precision (half to even), a fraction's percentage, other numbers, equal fractions, words."""
    n, s = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    tenth = F.concat((F.col("p_size") / 10).cast("int").cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    whole = (F.col("p_size") / 10).cast("int").cast("string")
    a = F.when(n == 0, F.concat(F.lit(" A"), s)).when(n == 1, whole).when(n == 2, F.concat((F.col("p_size") * 2).cast("string"), F.lit(".0"))).when(n == 3, s).when(n == 4, F.concat(s, F.lit("/9 and 1/2"))).otherwise(F.lit("high"))
    b = F.when(n == 0, F.concat(F.lit("a"), s, F.lit(" "))).when(n == 1, tenth).when(n == 2, F.concat(s, F.lit(" / 50"))).when(n == 3, (F.col("p_size") + 1).cast("string")).when(n == 4, F.concat(F.lit("1/2, "), s, F.lit("/9"))).otherwise(F.lit("low"))
    return table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), ledger.same_value(a, b).alias("same"))


@query("""select c_custkey as id, cell, was, now from (select c_custkey, 'c_nationkey' as cell, c_nationkey::varchar as was, '99' as now from customer where c_custkey % 13 = 0 and c_custkey % 17 <> 0
 union all select c_custkey, 'row', 'present', null from customer where c_custkey % 17 = 0)""")
def n08_changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled cell may change; a fixed one may not, nor may a row go."""
    before = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_mktsegment").alias("rating"))
    after = before.where("id % 17 <> 0").select("id", F.when(F.col("id") % 13 == 0, 99).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.lit("filled").alias("rating"))
    return ledger.changed_cells(before, after, "id", ["rating"])


@query(f"with {RAT_SQL} select item, case when first <> second then 'adjudicated' else first end as class from rat")
def n10_class_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir)
    return ledger.overridden(rows.select("item", "first", "second"), rows.where("first <> second").select("item", F.lit("adjudicated").alias("final")), ["item"])


_LINES = "sl as (select p_partkey as line, case when p_partkey % 2 = 0 then 'r2OpenEce' else 'r2JevEce' end as analysis, 'rec' || p_partkey as record, 'L' || p_partkey as row_id, case when p_partkey % 5 = 0 then 'no' else 'yes' end as include from part)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("line"), F.when(k % 2 == 0, "r2OpenEce").otherwise("r2JevEce").alias("analysis"), F.concat(F.lit("rec"), k.cast("string")).alias("record"), F.concat(F.lit("L"), k.cast("string")).alias("row_id"), F.when(k % 5 == 0, "no").otherwise("yes").alias("include"), F.lit(None).cast("string").alias("b_row"))


@query(f"""with {_LINES}, pr as (select a.analysis, a.record as raw, b.record as recal, b.row_id as b from sl a join sl b on b.line = a.line + 4 and b.analysis = a.analysis where a.line % 8 = 1 and b.include = 'yes')
select s.analysis, s.record, s.row_id, case when r.recal is not null then 'no' else s.include end as include, p.b as b_row from sl s left join pr p on p.raw = s.record left join pr r on r.recal = s.record""")
def n11_paired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    k = F.col("line")
    pairs = own.where("line % 8 = 1").select(F.col("record").alias("raw"), F.concat(F.lit("rec"), (k + 4).cast("string")).alias("recal"))
    return ledger.paired_lines(own.drop("line"), pairs)


@query("""with p as (select p_partkey as k, p_partkey % 5 as m, p_size::double as s, lag(p_size) over (order by p_partkey) as prev, (p_partkey % 90 + 10)::double as n from part)
select k as line, case when m = 1 then 'r2Jev' else 'r1Acc' end as analysis, case when m = 1 then '10 bins, scheme not stated' else '10 bins, spacing not stated' end as group_name,
 round(case m when 0 then s when 1 then s + 0.5 when 2 then n when 3 then 100 * s / (s + 7) else s + 3 end, 6) as a, round(case m when 1 then (s + 3) / 100 when 3 then prev + 0.25 when 4 then s end, 6) as b,
 round(case m when 0 then s when 1 then (s + 0.5) / 100 when 2 then n when 3 then 100 * s / (s + 7) - (prev + 0.25) else (s + 3) / s end, 6) as val from p where k % 7 <> 0 and k > 5""")
def n12_selection_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name a field, a pattern, another row or none of these; whole numbers, decimals, fractions,
    and numbers inside texts."""
    k, m, size = F.col("p_partkey"), F.col("p_partkey") % 5, F.col("p_size").cast("string")
    n, row = (k % 90 + 10).cast("string"), lambda i: F.concat(F.lit("L"), i.cast("string"))
    value = F.when(m == 0, size).when(m == 1, F.concat(F.lit("  "), size, F.lit(".5 "))).when(m == 2, F.concat(size, F.lit(".25 (n="), n, F.lit(")"))).when(m == 3, F.concat(size, F.lit(" / "), (F.col("p_size") + 7).cast("string"))).otherwise(F.concat(size, F.lit(" of 80")))
    p = table(spark, sf_dir, "part")
    book = p.select(row(k).alias("row_id"), value.alias("value"), F.concat(F.lit("about "), (F.col("p_size") + 3).cast("string"), F.lit(" points")).alias("comparator_value"))
    pick = lambda **at: reduce(lambda c, x: c.when(m == int(x[0][1:]), x[1]), at.items(), F.when(F.lit(False), ""))
    rows = p.where(k > 5).select(
        k.alias("line"), F.when(m == 1, "r2Jev").otherwise("r1Acc").alias("analysis"), F.lit("10 bins, spacing not stated").alias("group"), F.when(k % 7 == 0, "no").otherwise(" Yes").alias("include"), row(k).alias("row_id"),
        pick(_4="comparator_value", _0="").alias("a_field"), pick(_2=r"n=(\d+)", _4=r"\d+(?= points)").alias("a_pattern"), F.when(m == 3, row(k - 1)).alias("b_row"),
        pick(_1="comparator_value", _3="value", _4="value").alias("b_field"), pick(_1=r"about (\d+)", _3=r"^([\d.]+)", _4=r"(\d+) of").alias("b_pattern"), pick(_1="a/100", _3="a-b", _4="a/b").alias("expr"))
    return _r(ledger.read_selection(rows, book).withColumnRenamed("group", "group_name"))


@query(f"with {_LINES} select line, record from sl where include = 'yes' and analysis = 'r2JevEce' and line % 3 = 0")
def n13_selection_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis, one role; each record once, or it is fatal."""
    own = lines(spark, sf_dir).withColumn("role", F.when(F.col("line") % 3 == 0, "estimate").otherwise("comparator"))
    return ledger.one_record(ledger.selected(own, "r2JevEce", ["estimate"]), ["analysis", "record"]).select("line", "record")


@query("select p_brand as class, count(*) as n, round(avg(p_size), 6) as mean from part group by 1")
def j14_n14_class_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates by the class of their record; every one must have one."""
    p = table(spark, sf_dir, "part")
    classes = p.select(F.col("p_partkey").alias("record"), F.col("p_brand").alias("class"))
    return _r(ledger.classed(p.select(F.col("p_partkey").alias("record"), "p_size"), classes, ["record"]).groupBy("class").agg(F.count("*").alias("n"), F.avg("p_size").alias("mean")))


@query("select '2609.' || lpad(c_custkey::varchar, 9, '0') as id, c_custkey % 3 = 0 as in_ledger from customer where c_custkey <> 7")
def n16_corpus_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers listed in texts, twice each, and those the ledger holds under some version."""
    c = table(spark, sf_dir, "customer")
    ident = F.concat(F.lit("2609."), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    texts = c.select(F.concat(F.lit("see "), ident, F.lit(" and "), ident, F.lit("v1.")).alias("text"))
    book = c.where("c_custkey % 3 = 0").select(F.concat(ident, F.lit("v"), (F.col("c_custkey") % 4 + 1).cast("string")).alias("id"))
    return ledger.listed_ids(texts, "text", r"26(?:09|10)\.\d{9}", book, ["2609.000000007"])


@query(r"""select doc_id, len(x) as lines, md5(array_to_string(list_transform(x, lambda l: trim(regexp_replace(l, '[ \t\n\f\r]+', ' ', 'g'))), chr(10))) as lines_md5
 from (select doc_id, regexp_extract_all(coalesce(text, ''), '([^\n\r]{0,120}(?:[lL][iI][cC][eE][nN][sScC][eE])[^\n\r]{0,240})', 1) as x from documents)""")
def n21_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around a licence word on its line, in any case."""
    found = ledger.lines_with(F.coalesce("text", F.lit("")), "(?i:licen[sc]e)")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", F.size("x").alias("lines"), F.md5(F.array_join("x", "\n")).alias("lines_md5"))


@query(f"""with {_GRADES}, ch as (select gr.study, case when study % 4 = 0 then 'low' else d1 end as d1, d2, d3, d4, case when study % 6 = 0 then 'high' else d5 end as d5, coalesce(study % 4 = 0 and d1 is distinct from 'low', false) as m1, coalesce(study % 6 = 0 and d5 is distinct from 'high', false) as m5 from gr),
cx as (select *, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'high')) as h, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'unclear')) as u, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'low')) as l from ch)
select study, d1, d5, case when not (m1 or m5) then go.overall when d1 = 'high' or d5 = 'high' or h >= 2 then 'high' when l = 5 or (u = 1 and h = 0) then 'low' else 'some_concerns' end as overall,
 case when m1 or m5 then 'r; [adj]' || case when m1 then ' d1' else '' end || case when m5 then ' d5' else '' end else 'r' end as reason from cx join go using (study)""")
def n09_regraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicated first and fifth domains with the overall grade by its rule; applied twice, to the same
    effect as once."""
    g = grades(spark, sf_dir).withColumn("reason", F.lit("r"))
    final = g.where("study % 4 = 0").select("study", F.lit(1).alias("domain"), F.lit("low").alias("final")).unionByName(g.where("study % 6 = 0").select("study", F.lit(5).alias("domain"), F.lit("high").alias("final")))
    once = evidence.regraded(g, final, "[adj]")
    return evidence.regraded(once, final, "[adj]").select("study", "d1", "d5", "overall", "reason")


_STRATA = {"class": "cluster % 4", "grade": "case study % 3 when 0 then 'low' when 1 then 'high' end", "reference": "case study % 2 when 0 then 'human' else 'model' end"}


@query(f"with {_EST}, x as (" + " union all ".join(f"select analysis, '{name}' as stratum, ({level})::varchar as level, cluster, v from est" for name, level in _STRATA.items()) + """),
m as (select analysis, stratum, level, cluster, median(v) as m from x where level is not null group by all)
select analysis, stratum, level, count(*) as clusters, round(min(m), 6) as least, round(max(m), 6) as greatest, round(median(m), 6) as median, count(*) filter (where m > 0) as ahead, count(*) filter (where m < 0) as behind from m group by all""")
def n14_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled within comparator classes, grades and reference kinds; some estimates have no grade."""
    rows = estimates(spark, sf_dir).withColumns({name: F.expr(level).cast("string") for name, level in _STRATA.items()})
    return _r(evidence.stratified(rows, ["analysis"], list(_STRATA), "cluster", "v").drop("least_cluster"))


@query("select p_partkey as id, case p_partkey % 3 when 0 then 'mit-' || p_size when 1 then '- a' || p_size || chr(10) || '- b' end as license from part")
def s11_card_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.concat(F.lit("---\nname: x\n"), F.when(n == 0, F.concat(F.lit("license: mit-"), s, F.lit(" \n"))).when(n == 1, F.concat(F.lit("license:\n- a"), s, F.lit("\n- b\n"))).otherwise(F.lit("")), F.lit("---\nbody"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ledger.card_license(text).alias("license"))


_CEN = """cen as (select c_custkey as id, case when c_custkey % 4 = 0 then case when c_custkey % 8 = 0 then 'T1' else 'X' end else case c_custkey % 3 when 0 then 'T1' when 1 then 'T2' else 'D' end end as tier,
 case when c_custkey % 4 = 0 then 'hand' else c_mktsegment end as relation, case when c_custkey % 4 = 0 then 'F' || (c_custkey % 5) when c_custkey % 3 = 0 then c_nationkey::varchar else '' end as family, c_custkey % 4 = 0 as checked from customer)"""


def _census(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(k.alias("id"), F.element_at(F.array(F.lit("T1"), F.lit("T2"), F.lit("D")), (k % 3 + 1).cast("int")).alias("tier"), F.col("c_mktsegment").alias("relation"), F.col("c_nationkey").cast("string").alias("family"))
    checks = c.where("c_custkey % 4 = 0").select(k.alias("id"), F.when(k % 8 == 0, " T1").otherwise("X").alias("verdict"), F.lit("hand").alias("relation"), F.concat(F.lit("F"), (k % 5).cast("string"), F.lit(" ")).alias("family"))
    return ledger.census(rows, checks)


@query(f"with {_CEN} select id, tier, relation, family, checked from cen")
def j15_census_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census(spark, sf_dir)


@query(f"with {_CEN} select tier, relation, count(*) as n, count(distinct lower(family)) as families, count(*) filter (where checked) as checked from cen group by 1, 2")
def a38_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census(spark, sf_dir).groupBy("tier", "relation").agg(F.count("*").alias("n"), F.count_distinct(F.lower("family")).alias("families"), F.count_if("checked").alias("checked"))


@query(f"with {_CEN} select case when id % 6 = 0 then 'missing' when id % 2 = 0 then 'pointer' else 'softmax' end as panel, count(*) as originals, count(distinct lower(family)) as families from cen where tier = 'T1' group by 1")
def j16_a39_head_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals by decision head; those without a code are listed as missing."""
    own = _census(spark, sf_dir).where("tier = 'T1'").select("id", "family")
    codes = own.where("id % 6 <> 0").select("id", F.when(F.col("id") % 2 == 0, " Pointer").otherwise("softmax").alias("panel"))
    return ledger.head_counts(own, codes, ["pointer", "softmax"])


@query("""with r as (select p_partkey as record, p_size + 1.0 as val, (p_partkey * 7) % 31 + 1.0 as b, case p_partkey % 3 when 0 then 'in-domain' when 1 then 'transferred' else 'other' end as fit from part where p_partkey % 5 <> 0 and p_partkey % 4 <> 0)
select fit, count(*) as records, round(min(b / val), 6) as least, arg_min(record, (b / val, record)) as least_record, round(max(b / val), 6) as greatest, arg_max(record, (b / val, record)) as greatest_record from r group by fit""")
def a36_recalibration_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("record"), F.when(k % 5 != 0, "raw").otherwise("served").alias("a_stage"), F.lit("estimate").alias("role"), F.element_at(F.array(F.lit("in-domain set"), F.lit("transferred set"), F.lit("none")), (k % 3 + 1).cast("int")).alias("fit"), (F.col("p_size") + 1.0).alias("val"), F.when(k % 4 != 0, (k * 7) % 31 + 1.0).alias("b"))
    return _r(ledger.recal_ratios(rows))


@query("select p_partkey as id, case when p_size < 10 then 'supported' when p_size >= 30 then 'contradicted' else 'mixed' end as direction from part where p_partkey % 9 <> 0 union all select p_partkey, null from part where p_partkey % 9 = 0")
def g26_claim_by_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = F.when(F.col("p_partkey") % 9 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(10), F.lit(20), F.lit(30)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ledger.claim_direction(F.col("p_size"), others).alias("direction"))


@query("""with p as (select p_partkey as id, p_retailprice / (40.0::double * p_size) as ratio, p_size % 5 as wrong, p_size % 4 as lower, p_size % 7 as q, p_retailprice as c, p_partkey % 5 as l from part where p_size > 0),
r as (select *, (3 >= q and 1200 <= c and 2 <= l and (3 > q or 1200 < c or 2 < l)) or (5 >= q and 1500 <= c and 1 <= l and (5 > q or 1500 < c or 1 < l)) as beaten from p)
select id, case when ratio >= 2 then 'supported' when ratio > 1 then 'mixed' else 'contradicted' end as speed, case when wrong = 0 then 'supported' else 'contradicted' end as types,
 case lower when 0 then 'supported' when 3 then 'contradicted' else 'mixed' end as calibration, case when beaten then 'contradicted' when q < 5 then 'mixed' else 'supported' end as frontier from r""")
def g26_claim_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of claims: speed against the least ratio claimed, type errors, calibration among three
    comparators, the frontier beside two."""
    p, of = table(spark, sf_dir, "part").where("p_size > 0"), lambda q, c, l: F.struct(F.lit(q).cast("long").alias("quality"), F.lit(c).cast("double").alias("cost"), F.lit(l).cast("long").alias("latency"))  # noqa: E731, E741
    own = F.struct((F.col("p_size") % 7).alias("quality"), F.col("p_retailprice").alias("cost"), (F.col("p_partkey") % 5).alias("latency"))
    return p.select(
        F.col("p_partkey").alias("id"), ledger.ratio_direction(F.col("p_retailprice") / (40.0 * F.col("p_size")), F.lit(2.0)).alias("speed"), ledger.absence_direction(F.col("p_size") % 5).alias("types"),
        ledger.rank_direction(F.col("p_size") % 4, F.lit(3)).alias("calibration"), ledger.frontier_direction(own, F.array(of(3, 1200, 2), of(5, 1500, 1))).alias("frontier"))


@query("""with l as (select l_orderkey, count(*) as n, sum(l_quantity) as q, min(l_discount) as least, max(l_discount) as most from lineitem group by 1), j as (select * from orders left join l on l_orderkey = o_orderkey),
c as (select o_orderkey, [n is not null, coalesce(n between 1 and 7, false), coalesce(q <= 50 * n, false), coalesce(least >= 0 and most <= 0.05, false), o_totalprice > 0] as ok from j)
select w.what, count(*) as n, count(*) filter (where not ok[w.i]) as failures, count(*) filter (where not ok[w.i]) = 0 as ok from c, (values (1, 'an order has lines'), (2, 'seven lines at most'), (3, 'quantities up to fifty'), (4, 'discounts up to a twentieth'), (5, 'a positive total')) w(i, what) group by w.i, w.what""")
def n20_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold between orders and their lines, each with its failures; some do fail."""
    lines_ = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"))
    rows = table(spark, sf_dir, "orders").join(lines_, "o_orderkey", "left")
    return ledger.consistency(rows, {
        "an order has lines": F.col("n").isNotNull(), "seven lines at most": F.col("n").between(1, 7), "quantities up to fifty": F.col("q") <= 50 * F.col("n"),
        "discounts up to a twentieth": (F.col("least") >= 0) & (F.col("most") <= 0.05), "a positive total": F.col("o_totalprice") > 0})


@query("""select count(*) filter (where decision = 'include' and has) as included, count(*) filter (where decision = 'exclude') as excluded, count(*) filter (where decision = 'include' and not has) as no_rows, count(*) filter (where decision = 'grey') as grey
 from (select case c_custkey % 3 when 0 then 'include' when 1 then 'exclude' else 'grey' end as decision, c_custkey in (select o_custkey from orders) as has from customer)""")
def a40_sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    n, has = F.col("c_custkey") % 3, F.col("has").isNotNull()
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(have, "c_custkey", "left")
    return rows.agg(F.count_if((n == 0) & has).alias("included"), F.count_if(n == 1).alias("excluded"), F.count_if((n == 0) & ~has).alias("no_rows"), F.count_if(n == 2).alias("grey"))


@query(f"""with {_GRADES}, ch as (select study, case when study % 3 = 0 then 'high' else d1 end as d1, d2, d3, d4, d5 from gr),
cx as (select study, d1, d5, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'high')) as h, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'unclear')) as u, list_count(list_filter([d1, d2, d3, d4, d5], lambda x: x = 'low')) as l from ch),
ca as (select study, case when d1 = 'high' or d5 = 'high' or h >= 2 then 'high' when l = 5 or (u = 1 and h = 0) then 'low' else 'some_concerns' end as before from cx)
select overall as after, before, count(*) as n, count(*) filter (where overall <> before) as moved from go join ca using (study) group by all""")
def a41_grades_before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades as they are, and with the first rating of a domain restored."""
    g = grades(spark, sf_dir)
    first = F.when(F.col("study") % 3 == 0, "high").otherwise(F.col("d1"))
    before = evidence.overall_grade([first, *[F.col(f"d{i}") for i in range(2, 6)]])
    rows = g.select(F.col("overall").alias("after"), before.alias("before"))
    return rows.groupBy("after", "before").agg(F.count("*").alias("n"), F.count_if(F.col("after") != F.col("before")).alias("moved"))


@query(f"""with t as (select doc_id, lang, text, {_NORM} as n from documents), c as (select lang, count(*) over (partition by text) - 1 as e, count(*) over (partition by n) - 1 as m from t)
select lang, count(*) as n, count(*) filter (where e > 0) as exact, count(*) filter (where m > 0) as normalized, count(*) filter (where m > 0 and e = 0) as normalized_only from c group by lang""")
def a42_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = overlap.duplicates(docs, "text", "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("exact") > 0).alias("exact"), F.count_if(F.col("normalized") > 0).alias("normalized"), F.count_if((F.col("normalized") > 0) & (F.col("exact") == 0)).alias("normalized_only"))


@query("""with o as (select o_orderkey, sum(len(string_split(l_returnflag || ' ' || l_linestatus || ' x', ' '))) as t, count(*) as k from lineitem join orders on o_orderkey = l_orderkey group by 1)
select count(*) as requests, round(quantile_cont(t, 0.5), 6) as median_tokens, max(t)::bigint as max_tokens, round(avg((t > 12)::int), 6) as share_over, round(quantile_cont(greatest(t - 12, 0), 0.5), 6) as median_excess, max(greatest(t - 12, 0))::bigint as max_excess, round(sum(least(t, 12))::double / sum(t), 6) as kept_share from o""")
def a43_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a request's options against a budget of 12. Totals are few whole numbers, so their
    medians come from counts, not from a sort."""
    n = F.size(F.split(F.concat_ws(" ", "l_returnflag", "l_linestatus", F.lit("x")), " "))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(n).alias("t")).groupBy("t").agg(F.count("*").alias("w"))
    over = F.greatest(F.col("t") - 12, F.lit(0))
    return _r(per.agg(
        F.sum("w").alias("requests"), F.expr("percentile(t, 0.5, w)").alias("median_tokens"), F.max("t").alias("max_tokens"), (F.sum(F.when(F.col("t") > 12, F.col("w")).otherwise(0)) / F.sum("w")).alias("share_over"),
        F.expr("percentile(greatest(t - 12, 0), 0.5, w)").alias("median_excess"), F.max(over).alias("max_excess"), (F.sum(F.least(F.col("t"), F.lit(12)) * F.col("w")) / F.sum(F.col("t") * F.col("w"))).alias("kept_share")))


@query(f"""with pm as (select p_partkey as item, d, row_number() over (partition by p_partkey order by {draw_sql(repr('x4'), 'p_partkey', 'd')}, d) - 1 as place, p_size % 3 as gold from part, (values (0), (1), (2)) v(d)),
st as (select item, 'domain' as stage, 'd' || d as option, d = gold as gold, place from pm),
op as (select p_partkey as item, 't' || o as option, o % 3 as d, o = p_size % 12 as gold, p_size % 12 % 3 as gd, row_number() over (partition by p_partkey order by {draw_sql(repr('x4t'), 'p_partkey', "'t' || o")}, 't' || o) as pl from part, range(12) r(o))
select item, stage, option, gold, place::int as place from st union all select item, 'option', option, gold, (row_number() over (partition by item order by pl) - 1)::int from op where d = gd""".replace("p_size % 3 as gold", "p_size % 12 % 3 as gold"))
def x04_hierarchical_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains first, then the options of the right option's domain, in drawn orders."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.concat(F.lit("t"), (F.col("p_size") % 12).cast("string")).alias("gold"))
    return design.hierarchical(items, "item", "gold", {f"t{i}": f"d{i % 3}" for i in range(12)}, "x4", "x4t")


@query(f"""with a as (select o_orderpriority as label, o_orderkey as id, {draw_sql(repr('x8'), 'o_orderkey')} as h from orders), w as (select label, id, h, row_number() over (partition by label order by h, id) as r from a)
select label, id, (row_number() over (order by h, id) - 1)::int as place from w where r <= 500 order by h, id limit 500""")
def x08_shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write order drawn over all labels; a sampling operator: its cap of 500 is its purpose."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("id"))
    return design.shuffled(rows, ["label"], "id", "x8", 500)


@query(f"select o_orderkey as id from orders order by {draw_sql(repr('x9'), 'o_orderkey')}, o_orderkey limit 1500")
def x09_seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,500 of a drawn order (a sampling operator)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).orderBy(draw("x9", F.col("id")), "id").limit(1500)


@query(f"""with {LOG_SQL}, t as (select model, key, usage_in % 8 as m from log where usage_in % 8 <> 7), k as (select model, key, bool_or(m in (3, 4, 5, 6)) as good, bool_or(m in (0, 2)) as bad from t where m <> 1 group by all)
select model, count(*) as lines, count(*) filter (where m in (3, 4, 5, 6)) as answered, any_value(gk) as answered_keys, count(*) filter (where m in (0, 2)) as errors, count(*) filter (where m = 0) as refusals, count(*) filter (where m = 1) as unparseable, any_value(bk) as 'both',
 sum(case when m in (3, 4, 5) then 1 when m = 6 then 2 else 0 end)::bigint as questions, count(*) filter (where m = 5) as empty, case when model = 2 then count(*) filter (where m = 3) end as truncated, case when model = 2 then count(*) filter (where m in (4, 6)) end as not_summing, case when model = 2 then count(*) filter (where m = 4) end as percent_scale
 from t join (select model, count(*) filter (where good) as gk, count(*) filter (where good and bad) as bk from k group by model) using (model) group by model""")
def a25_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of three files: refusals, other errors, lines cut off, long replies, percentages, empty and
    unsummed distributions, blank lines. Model 2 states its probabilities in the reply."""
    log, m = answer_log(spark, sf_dir), F.col("usage_in") % 8
    question = lambda probs, said, used=10: {"probs": probs, "raw": {"usage_out": used, "raw_text": said}}
    said = lambda *p: json.dumps({"probabilities": [{"p": x} for x in p]})
    half = {"a": 0.5, "b": 0.5}
    kinds = [
        {"error": "prompt exceeds its budget of 512"}, None, {"error": "HTTP 500"}, {"answers": {"q": question(half, said(0.5, 0.5), 768)}}, {"answers": {"q": question(half, said(70, 30))}},
        {"error": "", "answers": {"q": question({}, "none")}}, {"error": None, "answers": {"q": question(half, said(0.5, 0.4)), "r": question(half, said(0.25, 0.75))}}]
    line = F.lit("  ")
    for i, x in enumerate(kinds):
        body = '"answers": {' if x is None else json.dumps(x)[1:]
        line = F.when(m == i, F.concat(F.lit('{"key": "'), F.col("key").cast("string"), F.lit('", '), F.lit(body))).otherwise(line)
    return answers.failures(log.select("model", line.alias("line")), ["model"], "line", F.col("model") == 2)


@query()
def w12_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns by length, cut where the padded size would pass 400 characters; a test
    holds them against a plain version."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return answers.micro_batches(rows, ["conv_id"], "n", "turn", 400)


@query("select l_returnflag as kind, round(sum(l_quantity) / 3600.0::double, 6) as hours, round(0.8::double * sum(l_quantity) / 3600.0, 6) as usd_full, round(0.8::double * sum(l_quantity) / 3600.0 / 0.25, 6) as usd_quarter from lineitem group by 1")
def a24_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine's cost, and what it is at a quarter's use."""
    return _r(answers.at_utilization(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 0.8, 0.25).withColumnRenamed("l_returnflag", "kind").withColumnRenamed("usd_used", "usd_quarter"))


@query(f"with {LOG_SQL}, g as (select model, usage_in, count(*) as n from log group by all) select model, usage_in, n, place from (select *, row_number() over (partition by model order by n desc, usage_in) as place from g) where place <= 5")
def a27_most_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five values a model served most (a top list)."""
    counts = answer_log(spark, sf_dir).groupBy("model", "usage_in").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "usage_in"))
    return counts.withColumn("place", place.cast("long")).where("place <= 5")


@query("select k from (select o_custkey as k from orders union select c_custkey from customer)")
def u04_union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return o.union(c).distinct()


@query("select 'syn.at' || upper(s[1]) || s[2:] || c_custkey as label, c_nationkey as value from (select *, regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') as s from customer)")
def n17_t14_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of letters and digits for each customer, from a slug with its first letter upper case; each stands once."""
    c = table(spark, sf_dir, "customer")
    label = F.concat(F.lit("at"), ledger.camel(ledger.slug(F.col("c_mktsegment"))), F.col("c_custkey").cast("string"))
    return ledger.published(c.select(label.alias("label"), F.col("c_nationkey").alias("value")), "label", "syn.")


@query("select printf('L%03d', row_number() over (order by o_orderkey)) as row_id, o_orderkey from orders")
def w11_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged rows numbered in order, without one sorted partition."""
    found = numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "r")
    return found.select(F.format_string("L%03d", "r").alias("row_id"), "o_orderkey")


@query("""with n as (select lang, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t, doc_id from documents where text is not null), f as (select t, min(doc_id) as first from n group by t)
select lang, count(*) as n, count(*) filter (where doc_id <> first) as exposed from n join f using (t) group by lang""")
def t02_exposed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text, white space and case aside, an earlier one has too."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("lang", "doc_id", F.xxhash64(overlap.norm_spaces(F.col("text"))).alias("t"))
    first = rows.groupBy("t").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "t").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") != F.col("first")).alias("exposed"))
