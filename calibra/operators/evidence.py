"""Agreement of raters, pooling of study estimates by cluster, grade rules and ledger checks."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dealing import kept
from ..functions.quantiles import quantiles, same

#: The ratings, in their order.
LEVELS = ("low", "unclear", "high")


def kappa(ratings: DataFrame, by: list[str], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Agreement, Cohen's kappa and linearly weighted kappa; null where chance agreement is certain."""
    code = lambda c: F.array_position(F.array(*map(F.lit, levels)), F.col(c)) - 1
    cells = ratings.select(*by, code("first").alias("a"), code("second").alias("b")).groupBy(*by, "a", "b").agg(F.count("*").alias("m"))
    k = len(levels)
    weight = F.abs(F.col("a") - F.col("b")) / float(k - 1)
    seen = cells.groupBy(*by).agg(F.sum("m").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0)) / F.sum("m")).alias("po"), (F.sum(F.col("m") * weight) / F.sum("m")).alias("do"))
    rows, cols = cells.groupBy(*by, "a").agg(F.sum("m").alias("ra")), cells.groupBy(*by, "b").agg(F.sum("m").alias("cb"))
    chance = rows.join(cols, by).join(seen.select(*by, "n"), by).groupBy(*by).agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("ra") * F.col("cb") / (F.col("n") * F.col("n"))).otherwise(0.0)).alias("pe"), F.sum(F.col("ra") * F.col("cb") / (F.col("n") * F.col("n")) * weight).alias("de"))
    out = seen.join(chance, by)
    return out.select(*by, "n", F.col("po").alias("agreement"), F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"), F.when(F.col("de") > 0, 1 - F.col("do") / F.col("de")).alias("weighted_kappa"))


def cluster_medians(estimates: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    return quantiles(estimates, [*by, cluster], value, {"m": 0.5})


def pooled(estimates: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """A median for each cluster, then their count, extremes with their clusters, median and signs."""
    # A row for each cluster, which the count, the search for large groups and the median read again.
    m = kept(cluster_medians(estimates, by, cluster, value))
    low, high = F.min(F.struct("m", cluster)), F.max(F.struct(F.col("m"), F.lit(0).alias("z")))
    told = m.groupBy(*by).agg(
        F.count("*").alias("clusters"), low["m"].alias("least"), low[cluster].alias("least_cluster"), high["m"].alias("greatest"), F.count_if(F.col("m") > 0).alias("ahead"), F.count_if(F.col("m") < 0).alias("behind"))
    at = quantiles(m, by, "m", {"median": 0.5})
    return told.join(at, same(told, at, by)).select(*[told[c] for c in by], "clusters", "least", "least_cluster", "greatest", "median", "ahead", "behind")


def span_ratio(estimates: DataFrame, by: list[str], study: str, value: str) -> DataFrame:
    """The range of the studies' medians over the widest study's range."""
    m, own = cluster_medians(estimates, by, study, value), estimates.groupBy(*by, study).agg((F.max(value) - F.min(value)).alias("span"))
    both = m.join(own, same(m, own, [*by, study])).select(*[m[c] for c in by], "m", "span")
    return both.groupBy(*by).agg(((F.max("m") - F.min("m")) / F.max("span")).alias("ratio"))


def overall_grade(ratings: list[Column]) -> Column:
    """From five domains: high if the first or the fifth is high or two are; low if all are low, or one
    is unclear and none high; else some_concerns."""
    count = lambda level: sum((F.when(r == level, 1).otherwise(0) for r in ratings), F.lit(0))
    high, unclear, low = count("high"), count("unclear"), count("low")
    return F.when((ratings[0] == "high") | (ratings[4] == "high") | (high >= 2), "high").when((low == 5) | ((unclear == 1) & (high == 0)), "low").otherwise("some_concerns")


def violations(ledger: DataFrame) -> DataFrame:
    """Rows (rule, row_id) for repeated ids, repeated or malformed keys, and blank excerpts."""
    again = lambda c: ledger.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")).where("n > 1").select(F.lit(f"repeated {c}").alias("rule"), "row_id")
    shape = ledger.where(~F.col("value_key").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")).select(F.lit("malformed value_key").alias("rule"), "row_id")
    blank = ledger.where(F.coalesce(F.trim("excerpt"), F.lit("")) == "").select(F.lit("blank excerpt").alias("rule"), "row_id")
    return again("row_id").union(again("value_key")).union(shape).union(blank)


def single_number(text: Column, pattern: str) -> Column:
    """The number that the pattern's first group finds, if it matches exactly once; a / b as percent."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 1)
    token = F.when(F.size(hits) == 1, F.element_at(hits, 1))
    parts = F.split(token, "/")
    return F.when(F.size(parts) == 2, 100.0 * F.try_to_number(parts[0], F.lit("999999999")) / F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999"))).otherwise(token.try_cast("double")).cast("double")


#: A text that is a number, and one that is a fraction.
NUMBER = r"^\s*([+-]?\d*\.?\d+)\s*$"
FRACTION = r"^\s*(\d+)\s*/\s*(\d+)\s*$"
#: An opening bracket that begins a group of its own.
GROUP = r"(?<!\\)(\\\\)*\((?!\?)"


def read_number(text: Column, pattern: Column, where: Column) -> Column:
    """The number in a text by the row's own pattern: its first group, or all of its match if it has none.
    It must match exactly once. Without a pattern (null or empty) the text must be a number, or a fraction,
    which is read as percent. Anything else is fatal and told with `where`."""
    text, given = F.coalesce(text, F.lit("")), F.coalesce(pattern, F.lit("")) != ""
    hits = F.regexp_extract_all(text, F.when(given, pattern).otherwise(F.lit("$")), F.when(given & pattern.rlike(GROUP), 1).otherwise(0))
    found = F.when(F.size(hits) == 1, F.get(hits, F.lit(0)).try_cast("double"))
    part = lambda i: F.regexp_extract(text, FRACTION, i).try_cast("double")
    plain = F.coalesce(F.regexp_extract(text, NUMBER, 1).try_cast("double"), F.try_divide(100.0 * part(1), part(2)))
    told = F.concat(where, F.when(given, F.concat(F.lit(": pattern "), pattern, F.lit(" finds no one number in "))).otherwise(F.lit(": no number without a pattern in ")), text)
    value = F.when(given, found).otherwise(plain)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(told).cast("double"))


#: The closed expressions of a selection line over the values a and b. The twelve forms
#: that selection lines may name.
EXPRESSIONS = ("a", "-a", "a-b", "b-a", "a/b", "b/a", "a/100", "1-a/100", "-100*a", "100*(a-b)", "100*(b-a)", "1/(1-a/100)")


def arithmetic(text: str, values: dict[str, Column]) -> Column:
    """A column from the text of an expression over named columns; a division by zero is null."""
    by = {ast.Sub: Column.__sub__, ast.Mult: Column.__mul__, ast.Div: F.try_divide}

    def of(node: ast.expr) -> Column:
        match node:
            case ast.Name():
                return values[node.id]
            case ast.Constant():
                return F.lit(float(node.value))
            case ast.UnaryOp(op=ast.USub()):
                return -of(node.operand)
            case ast.BinOp():
                return by[type(node.op)](of(node.left), of(node.right))
        raise ValueError(text)

    return of(ast.parse(text, mode="eval").body)


def evaluated(expr: Column, a: Column, b: Column) -> Column:
    """One of the closed expressions; null for any other."""
    out = None
    for text in EXPRESSIONS:
        form = arithmetic(text, {"a": a, "b": b})
        out = F.when(expr == text, form) if out is None else out.when(expr == text, form)
    return out


def adjudicated(first: DataFrame, decisions: DataFrame, on: list[str], tag: str) -> DataFrame:
    """Ratings with the adjudicated one where it differs, and the reason extended by a tag; a row that
    carries the tag is left alone, so applying twice changes nothing."""
    out = first.join(decisions, on, "left")
    change = F.col("final").isNotNull() & (F.col("final") != F.col("first")) & ~F.coalesce(F.col("reason"), F.lit("")).contains(tag)
    return out.select(*on, F.when(change, F.col("final")).otherwise(F.col("first")).alias("first"), F.when(change, F.concat_ws(" ", "reason", F.lit(tag))).otherwise(F.col("reason")).alias("reason"))


def regraded(grades: DataFrame, decisions: DataFrame, tag: str, domains: int = 5) -> DataFrame:
    """Grades (study, d1 ..., overall, reason) with adjudicated ratings, and the overall grade by its rule
    where one changed. decisions: study, domain (a number), final; of several for one domain the greatest
    stands. The reason is extended by the tag and the domains that changed; a row that carries the tag is
    left alone, so applying twice changes nothing."""
    told = decisions.groupBy("study", "domain").agg(F.max("final").alias("f")).groupBy("study").agg(F.map_from_entries(F.collect_list(F.struct(F.col("domain").cast("int"), "f"))).alias("_f"))
    at = grades.join(told, "study", "left")
    free = ~F.contains(F.coalesce("reason", F.lit("")), F.lit(tag))
    final = {i: F.col("_f")[F.lit(i)] for i in range(1, domains + 1)}
    moved = {i: F.coalesce(free & final[i].isNotNull() & ~final[i].eqNullSafe(F.col(f"d{i}")), F.lit(False)) for i in final}
    rated = [F.when(moved[i], final[i]).otherwise(F.col(f"d{i}")).alias(f"d{i}") for i in final]
    some = reduce(Column.__or__, moved.values())
    names = F.concat_ws(" ", F.lit(tag), *[F.when(moved[i], F.lit(f"d{i}")) for i in final])
    out = at.select("study", *rated, "overall", "reason", some.alias("_m"), names.alias("_n"))
    overall = F.when(F.col("_m"), overall_grade([F.col(f"d{i}") for i in final])).otherwise(F.col("overall"))
    return out.select("study", *[f"d{i}" for i in final], overall.alias("overall"), F.when(F.col("_m"), F.concat_ws("; ", "reason", "_n")).otherwise(F.col("reason")).alias("reason"))


def stratified(estimates: DataFrame, by: list[str], strata: list[str], cluster: str, value: str) -> DataFrame:
    """What `pooled` gives within each level of each stratum (a column of estimates); estimates without a
    level are in none of that stratum."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("stratum"), F.col(c).cast("string").alias("level")) for c in strata]))
    rows = estimates.select(*by, cluster, value, each.alias("_x")).select(*by, "_x.stratum", "_x.level", cluster, value).where("level is not null")
    return pooled(rows, [*by, "stratum", "level"], cluster, value)


def top_evidence(rows: DataFrame, claim: str, cluster: str, order: list, keep: int = 3) -> DataFrame:
    """Of each claim the best row of each cluster, then the first `keep`."""
    one = Window.partitionBy(claim, cluster).orderBy(*order)
    best = rows.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(claim).orderBy(*order))).where(F.col("place") <= keep).drop("_r")
