"""Registered queries: rendering of questions, parsing of replies, likelihoods of options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.quantiles import quantiles
from ..operators import answers, rendering
from .derived import table
from .evaluation import _r

KIND = "case p_partkey % 3 when 0 then 'choice' when 1 then 'noul' else 'score' end"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, kind, names, descriptions, ins: a question of each kind from parts."""
    kind = F.element_at(F.array(*map(F.lit, ("choice", "noul", "score"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), kind.alias("kind"), F.array("p_brand", F.lit("other")).alias("names"), F.array("p_type", F.lit("None of these.")).alias("descriptions"), F.col("p_name").alias("ins"), "p_size")


@query(f"select p_partkey as key, array_to_string(case {KIND} when 'choice' then [p_brand, 'other'] when 'noul' then ['false', 'true'] else ['0', '1'] end, '|') as keys from part")
def p11_option_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("key", F.array_join(rendering.option_keys(F.col("kind"), F.col("names")), "|").alias("keys"))


_TEXTS = "array_to_string(case {k} when 'noul' then ['no', 'yes'] else [{a}, {b}] end, '|')"
_K0, _K1 = f"case {KIND} when 'choice' then p_brand else '0' end", f"case {KIND} when 'choice' then 'other' else '1' end"


@query("select p_partkey as key, " + ", ".join(f"{_TEXTS.format(k=KIND, a=a, b=b)} as {n}" for n, a, b in (("keydesc", f"({_K0}) || ': ' || p_type", f"({_K1}) || ': None of these.'"), ("description", "p_type", "'None of these.'"), ("only_key", _K0, _K1))) + " from part")
def p12_option_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("keys", rendering.option_keys(F.col("kind"), F.col("names")))
    text = lambda how: F.array_join(rendering.option_texts(F.col("kind"), F.col("keys"), F.col("descriptions"), how), "|")
    return q.select("key", text("keydesc").alias("keydesc"), text("desc").alias("description"), text("key").alias("only_key"))


@query("""select p_partkey as key, md5('State:' || chr(10) || p_brand || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(range(p_size), lambda i: '- o' || i), chr(10)) || chr(10) || chr(10)
 || 'Reply as JSON with probabilities of ' || case when p_size <= 20 then 'all options' else 'the 5 likeliest options' end || '.') as prompt_md5, case when p_size <= 20 then p_size else 5 end::int as reported from part""")
def p13_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    rows = table(spark, sf_dir, "part").withColumn("options", options)
    return rows.select(F.col("p_partkey").alias("key"), F.md5(rendering.prompt(F.col("p_brand"), F.col("p_name"), F.col("options"))).alias("prompt_md5"), rendering.reported(F.col("options")).cast("int").alias("reported"))


_SCORED = "'State:' || chr(10) || p_brand || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || chr(10) || 'Options:' || chr(10) || '- o1: ' || p_type || chr(10) || '- o2: size ' || p_size || chr(10) || chr(10) || 'Reply with the {} of the single best option, exactly as written above.' || chr(10) || 'Answer:'"


@query(f"select p_partkey as key, md5({_SCORED.format('key')}) as by_key, md5({_SCORED.format('description')}) as by_description, ' o1| o2' as keys, ' ' || p_type || '| size ' || p_size as descriptions from part")
def p13_scoring_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for scoring options by key and by description, with their continuations."""
    keys, descriptions = F.array(F.lit("o1"), F.lit("o2")), F.array(F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string")))
    both = [rendering.scoring_prompt(F.col("p_brand"), F.col("p_name"), keys, descriptions, by_key) for by_key in (True, False)]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), both[0].alias("k"), both[1].alias("d"))
    return rows.select("key", F.md5("k.text").alias("by_key"), F.md5("d.text").alias("by_description"), F.array_join("k.continuations", "|").alias("keys"), F.array_join("d.continuations", "|").alias("descriptions"))


@query(f"""select p_partkey as key, case {KIND} when 'noul' then '{{"type":"boolean","description":"' || p_name || '"}}' else '{{"type":"enum","choices":["' || ({_K0}) || '","' || ({_K1}) || '"],"description":"' || p_name || '","choice_descriptions":{{"' || ({_K0}) || '":"' || p_type || '","' || ({_K1}) || '":"None of these."}}}}' end as field from part""")
def p14_schema_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("keys", rendering.option_keys(F.col("kind"), F.col("names")))
    return q.select("key", rendering.schema_field(F.col("kind"), F.col("ins"), F.col("keys"), F.col("descriptions")).alias("field"))


@query("""select p_partkey as key, case p_partkey % 4 when 0 then case when p_size % 2 = 0 then upper(p_type[1]) || p_type[2:] || '.' else 'It is not the case that ' || lower(p_name[1]) || p_name[2:] end
 when 1 then case when p_size % 2 = 0 then p_name else 'This text is about ' || lower(p_type) || '.' end when 2 then 'This text is about no key.' else 'A long enough rubric of ' || p_type end as said from part""".replace("when 0 then case when p_size % 2 = 0 then upper(p_type[1]) || p_type[2:] || '.'", "when 0 then case when p_size % 2 = 0 then upper(p_type[1]) || p_type[2:] || ' stop.'"))
def p24_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics with a full stop, short ones, long ones, none; yes/no questions without a rubric."""
    case, even = F.col("p_partkey") % 4, F.col("p_size") % 2 == 0
    rubric = F.when((case == 0) & even, F.concat(F.lit("True: "), "p_type", F.lit(" stop."))).when((case == 1) & ~even, F.concat(F.lit("False: "), F.lower("p_type"))).when(case == 3, F.concat(F.lit("a long enough rubric of "), "p_type"))
    kind = F.when(((case == 0) & ~even) | ((case == 1) & even), "noul").otherwise("choice")
    key = F.when(case == 1, "true").when(case == 0, "false").otherwise("no_key")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), rendering.hypothesis(kind, F.col("p_name"), rubric, key).alias("said"))


@query("select p_partkey as key, 'o1|o2' as neutral, case when p_size % 3 = 0 then 'o1' when p_size % 3 = 1 then 'o2' end as label, round(case when p_size % 2 = 0 then 0.25 else 0.75 end, 2)::double as first from part")
def p19_neutral_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir)
    label = F.when(F.col("p_size") % 3 == 0, F.col("names")[0]).when(F.col("p_size") % 3 == 1, "other").otherwise("elsewhere")
    soft = F.create_map(F.col("names")[0], F.when(F.col("p_size") % 2 == 0, 0.25).otherwise(0.75), F.lit("other"), F.when(F.col("p_size") % 2 == 0, 0.75).otherwise(0.25))
    names, renamed, probs = rendering.neutral_recode(F.col("names"), label, soft)
    return rows.select("key", F.array_join(names, "|").alias("neutral"), renamed.alias("label"), F.try_element_at(probs, F.lit("o1")).alias("first"))


@query("""select p_partkey as key, round(case p_partkey % 5 when 0 then (p_size + 1.0::double) / (p_size + 2) when 1 then 2.0::double / 3 when 2 then 1.0 when 3 then 0.5 else 0.5 end, 6) as a from part""")
def p16_lenient_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys twice, keys with a description, negatives, no JSON, other keys only."""
    one = lambda k, p, name="p": F.concat(F.lit('{"key":"' + k + '","' + name + '":'), p.cast("string"), F.lit("}"))
    whole = lambda *xs: F.concat(F.lit('<think>{"probabilities":[]}</think> so {"probabilities":['), F.concat_ws(",", *xs), F.lit("]} done"))
    n, size = F.col("p_partkey") % 5, F.col("p_size")
    text = F.when(n == 0, whole(one("a", size), one(" a ", F.lit(1)), one("b", F.lit(1)))).when(n == 1, whole(one("a: first", F.lit(2), "probability"), one("b", F.lit(1)))).when(n == 2, whole(one("a", F.lit(3)), one("b", F.lit(-4)))).when(n == 3, F.lit("{broken")).otherwise(whole(one("z", F.lit(1))))
    return _r(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), rendering.lenient_reply(text, F.array(F.lit("a"), F.lit("b")))[0].alias("a")))


@query("""select p_brand as brand, count(*) as n, count(*) filter (where p_partkey % 3 <> 0) as strict_parsed, round(avg((p_partkey % 3 <> 0 and p_size > 25)::int), 6) as strict_accuracy, round(avg((p_partkey % 3 = 0 or p_size > 25)::int), 6) as lenient_accuracy from part group by 1""")
def g20_parse_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in a list form or a map form, the right option being a: a strict reading takes only the
    map; a lenient one only the list, and is uniform, which counts as the first option, where it finds none."""
    options = F.array(F.lit("a"), F.lit("b"))
    big, listed = F.col("p_size") > 25, F.col("p_partkey") % 3 == 0
    right = F.when(big, '{"a": 3, "b": 1}').otherwise('{"a": 1, "b": 3}')
    text = F.when(listed, F.lit('{"probabilities":[{"key":"a","p":0.9},{"key":"b","p":0.1}]}')).otherwise(right)
    strict = F.when(~listed, answers.strict_reply(text, options))
    loose = F.when(listed, rendering.lenient_reply(text, options)).otherwise(strict)
    first = lambda p: F.coalesce(p[0] > p[1], F.lit(False)).cast("int")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), strict.alias("s"), loose.alias("l"))
    return _r(rows.groupBy("brand").agg(F.count("*").alias("n"), F.count("s").alias("strict_parsed"), F.avg(first(F.col("s"))).alias("strict_accuracy"), F.avg(first(F.col("l"))).alias("lenient_accuracy")))


@query("select p_partkey as key, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) as p from (select p_partkey, ln(p_size / 60.0::double) as a, ln((p_partkey % 7 + 1) / 60.0::double) as b from part)")
def p25_restricted_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes known, two offered."""
    logs = F.create_map(F.lit("x"), F.ln(F.col("p_size") / 60.0), F.lit("out"), F.lit(-0.1), F.lit("y"), F.ln((F.col("p_partkey") % 7 + 1) / 60.0))
    return _r(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), rendering.restricted(logs, F.array(F.lit("x"), F.lit("y")))[0].alias("p")))


@query("select p_partkey as key, round(pow(f, 2) / (pow(f, 2) + pow(1 - f, 2)), 6) as fit from (select p_partkey, p_size / 51.0::double as f from part)")
def p07_isolated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level's fit, served at a temperature of 2, as it would be at 1."""
    from ..functions import vectors as V

    f = F.col("p_size") / 51.0
    return _r(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), V.power_or_uniform(F.array(1 - f, f), 2.0)[1].alias("fit")))


@query("select p_partkey as key, round(case when a + b > 0 then a / (a + b) else 0.5 end, 6) as a from (select p_partkey, case when p_partkey % 7 = 0 then 0 else pow(p_size / 100.0::double, 3) end as a, case when p_partkey % 7 < 2 then 0 else pow(0.5::double, 3) end as b from part)")
def p06_power_or_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros stay zero; a vector without mass becomes uniform."""
    from ..functions import vectors as V

    n = F.col("p_partkey") % 7
    p = F.array(F.when(n == 0, 0.0).otherwise(F.col("p_size") / 100.0), F.when(n < 2, 0.0).otherwise(0.5))
    return _r(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), V.power_or_uniform(p, 3.0)[0].alias("a")))


_KEYS = [*(f"o{i}" for i in range(1, 13))]


@query("""with it as (select p_partkey as item, p_size as s from part), k as (select 'o' || i as opt, i from range(1, 13) r(i)),
d as (select item, i, ln((1 + (item + i) % 5) / 60.0::double) as lp1, case when i = 1 then ln(0.2::double + s / 100.0::double) else ln((1 + (s + i) % 7) / 100.0::double) end as lpd from it, range(1, 10) r(i)),
e as (select item, i, ln((1 + (item + i) % 4) / 20.0::double) as lp from it, range(0, 3) r(i)),
s as (select item, opt, k.i, ln(0.9::double) + case when k.i < 10 then (select lpd from d where d.item = it.item and d.i = k.i) else (select lpd from d where d.item = it.item and d.i = 1) + (select lp from e where e.item = it.item and e.i = k.i - 10) end as logp from it, k),
b as (select s.*, case when i = 1 then ln(1 - (select sum(exp(lp)) from e where e.item = s.item)) else 0 end as boundary from s)
select item, opt, round(logp, 9) as logp, round(boundary, 9) as boundary, 0::bigint as missing, round(exp(logp + boundary) / sum(exp(logp + boundary)) over (partition by item), 9) as p from b""")
def g23_key_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys o1 to o12 by their characters: o1 begins three others."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_size")
    keys = items.select("item", F.explode(F.array(*map(F.lit, _KEYS))).alias("opt")).withColumn("tokens", F.filter(F.split("opt", ""), lambda x: x != ""))
    path = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    root = items.select("item", path().alias("path"), F.lit("o").alias("token"), F.lit(0.9).alias("w"))
    digit = items.select("item", path("o").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("i"), "p_size")
    digit = digit.select("item", "path", F.col("i").cast("string").alias("token"), F.when(F.col("i") == 1, 0.2 + F.col("p_size") / 100.0).otherwise((1 + (F.col("p_size") + F.col("i")) % 7) / 100.0).alias("w"))
    after = items.select("item", path("o", "1").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    after = after.select("item", "path", F.col("i").cast("string").alias("token"), ((1 + (F.col("item") + F.col("i")) % 4) / 20.0).alias("w"))
    nodes = root.union(digit).union(after).select("item", "path", "token", F.ln("w").alias("lp"))
    return _r(rendering.key_likelihood(keys, nodes).select("item", "opt", "logp", "boundary", "missing", "p"), 9)


_KL = "tk as (select l_orderkey as item, l_linenumber as opt, unnest([ln((1 + l_quantity) / 60.0::double), ln((1 + l_discount * 10) / 12.0::double)]) as lp from lineitem), m as (select item, opt, avg(lp) as mean from tk group by all)"


@query(f"with {_KL} select item, opt, round(mean, 6) as mean, round(exp(mean) / sum(exp(mean)) over (partition by item), 6) as p from m")
def g24_description_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    lps = F.array(F.ln((1 + F.col("l_quantity")) / 60.0), F.ln((1 + F.col("l_discount") * 10) / 12.0))
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("opt"), F.explode(lps).alias("lp"))
    return _r(rendering.description_likelihood(tokens))


@query("""select p_partkey as key, printf('%.2f', p_size / 1000.0::double + 0.1001) as small, case when p_size < 10 then printf('%.1f', p_size::double) else p_size::varchar end as large, case when p_size % 10 = 0 then (p_size // 10) || '.0' else (p_size // 10) || '.' || (p_size % 10) end as tidied from part where p_size < 100""")
def p29_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two significant digits below and above one; decimals without needless zeros."""
    size = F.col("p_size")
    text = F.concat((size / 10).cast("int").cast("string"), F.lit("."), (size % 10).cast("string"), F.lit("0"))
    return table(spark, sf_dir, "part").where("p_size < 100").select(F.col("p_partkey").alias("key"), rendering.two_digits(size / 1000.0 + 0.1001).alias("small"), rendering.two_digits(size.cast("double")).alias("large"), rendering.tidy(text).alias("tidied"))


@query("""with l as (select l_orderkey, l_linenumber::varchar as k, l_returnflag || ' ' || l_partkey as t from lineitem), o as (select l_orderkey, count(*) as size, sum(length(k) + 2 + length(t)) + count(*) - 1 as rendered, sum(length(t)) as texts from l group by all)
select size, count(*) as n, round(avg(rendered), 6) as rendered_mean, round(median(rendered), 6) as rendered_median, min(rendered)::int as rendered_least, max(rendered)::int as rendered_greatest, round(avg(texts), 6) as texts_mean from o group by size""")
def a31_option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the option lists of requests, by the number of options: an order's lines are its options."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat_ws(" ", "l_returnflag", F.col("l_partkey").cast("string")).alias("t")))).alias("x"))
    chars = rendering.list_chars(F.transform("x", lambda x: x["l_linenumber"].cast("string")), F.transform("x", lambda x: x["t"]))
    rows = lines.select(F.size("x").cast("long").alias("size"), chars.alias("c")).select("size", "c.*")
    sums = rows.groupBy("size").agg(F.count("*").alias("n"), F.avg("rendered").alias("rendered_mean"), F.min("rendered").alias("rendered_least"), F.max("rendered").alias("rendered_greatest"), F.avg("texts").alias("texts_mean"))
    return _r(sums.join(quantiles(rows, ["size"], "rendered", {"rendered_median": 0.5}), "size"))


@query(f"""select p_partkey // 3 as request, count(*) as fields, coalesce(array_to_string(list_sort(list(p_partkey::varchar) filter (where {KIND} = 'score')), ' '), '') as score_fields, count(*) filter (where {KIND} = 'noul') as yes_no from part group by 1""")
def p14_request_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions a request: its fields, those that are scores, and how many are yes or no."""
    q = questions(spark, sf_dir).withColumn("request", F.floor(F.col("key") / 3))
    field = rendering.schema_field(F.col("kind"), F.col("ins"), rendering.option_keys(F.col("kind"), F.col("names")), F.col("descriptions"))
    found = rendering.request_schema(q, ["request"], "key", "kind", field)
    yes_no = F.size(F.filter(F.map_values("fields"), lambda x: F.get_json_object(x, "$.type") == "boolean"))
    return found.select("request", F.size("fields").cast("long").alias("fields"), F.array_join("score_fields", " ").alias("score_fields"), yes_no.cast("long").alias("yes_no"))
