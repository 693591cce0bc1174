"""The ledger's checks and readings: labels, grades, excerpts against full texts, value equality,
selection lines, overlap of corpora, licence lines, censuses."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dealing import dealt
from .evidence import LEVELS, evaluated, overall_grade, read_number
from .overlap import numbers_contained

#: Group names of recalibration analyses that mean the same, with the name that stands for them.
BINNING = {
    "10 bins (width not stated)": "10 bins, scheme not stated",
    "10 bins, spacing not stated": "10 bins, scheme not stated",
    "15 bins (scheme not stated)": "15 bins, scheme not stated",
    "15 bins (width not stated)": "15 bins, scheme not stated",
    "15 bins, spacing not stated": "15 bins, scheme not stated",
    "equal-width (bins not stated)": "equal-width, bin count not stated",
}


#: Marks between the pieces of an excerpt, marks of what an excerpt leaves out, and marks that
#: end the caption of a table's cell.
PIECE_MARKS = (";", "|", "//", "[", "]")
LEFT_OUT = ("...", "…")
CAPTION_ENDS = ("//", "[", "|", ";", ", row ")


def any_of(marks: tuple[str, ...]) -> str:
    """A pattern for any of some marks."""
    return "(?:" + "|".join(map(re.escape, marks)) + ")"


def fixed_label(label: Column, version: Column) -> Column:
    """Blank and unclear labels of version 1.2 are not_reported."""
    poor = F.lower(F.trim(F.coalesce(label, F.lit("")))).isin("", "unclear")
    return F.when((version == "1.2") & poor, "not_reported").otherwise(label)


def group_name(analysis: Column, group: Column) -> Column:
    """The one name of a binning scheme, for analyses whose name begins with r2."""
    table = F.create_map(*[F.lit(x) for pair in BINNING.items() for x in pair])
    return F.when(F.startswith(analysis, F.lit("r2")), F.coalesce(F.try_element_at(table, group), group)).otherwise(group)


def cost_grade(ratings: list[Column]) -> Column:
    """From domains two to four: high if two are high; low if none is high and at most one unclear; else
    some_concerns. Blank without ratings."""
    count = lambda level: sum((F.when(r == level, 1).otherwise(0) for r in ratings[1:4]), F.lit(0))
    grade = F.when(count("high") >= 2, "high").when((count("high") == 0) & (count("unclear") <= 1), "low").otherwise("some_concerns")
    return F.when(ratings[1].isNull() & ratings[2].isNull() & ratings[3].isNull(), "").otherwise(grade)


def grade_problems(rob: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows (study, problem): repeated studies, ratings that are none, grades the rule doesn't give, and
    graded studies without ledger rows. rob: study, d1 to d5, overall.

    Problems are counted by study, so rob is read once; what it is dealt by study stays so.
    """
    ratings = [F.col(f"d{i}") for i in range(1, 6)]
    legal = F.lit(True)
    for r in ratings:
        legal &= F.coalesce(r.isin(*LEVELS), F.lit(False))
    wrong = F.coalesce("overall", F.lit("")) != overall_grade(ratings)
    own = rob.groupBy("study").agg(F.count_if(~legal).cast("int").alias("_a"), F.count_if(wrong).cast("int").alias("_b"), F.count("*").alias("_n"))
    named = ledger.select("study")
    known = dealt(named, named.count(), "study").distinct().withColumn("_k", F.lit(True))
    some = lambda name, when: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.array_repeat(F.lit("rating"), F.col("_a")), F.array_repeat(F.lit("rule"), F.col("_b")), some("repeated", F.col("_n") > 1), some("orphan", F.col("_k").isNull()))
    return own.join(known, "study", "left").select("study", F.explode(found).alias("problem"))


def compatible(text: Column) -> Column:
    """Compatibility forms (NFKC): ligatures, wide digits and the like as plain characters."""

    @F.pandas_udf("string")
    def forms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return forms(text)


def excerpt_text(text: Column) -> Column:
    """Compatibility forms, typographic quotes and dashes as plain ones, all but [0-9A-Za-z.%+-=<>] as
    one space, lower case. Texts without a character beyond ASCII never leave the JVM."""
    plain = F.when(F.length(text) == F.octet_length(text), text).otherwise(compatible(text))
    return F.lower(F.trim(F.regexp_replace(F.translate(plain, "‘’“”–—−", "''\"\"---"), r"[^0-9A-Za-z.%+\-=<>]+", " ")))


def excerpt_pieces(excerpt: Column) -> Column:
    """What stands between separators and ellipses, normalized, if it has three characters or more."""
    parts = F.split(excerpt, rf"\s*{any_of(PIECE_MARKS)}\s*|{any_of(LEFT_OUT)}")
    plain = F.transform(parts, lambda p: F.lower(F.trim(F.regexp_replace(F.translate(p, "‘’“”–—−", "''\"\"---"), r"[^0-9A-Za-z.%+\-=<>]+", " "))))
    return F.filter(plain, lambda p: F.length(p) >= 3)


def verified_excerpts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (row_id, study, excerpt, value, location) with a status from the study's full text.

    ok: all pieces stand in it and the value's numbers in the excerpt; derived: they don't, but the
    location says so; value_not_in_excerpt: they don't; table_ok: not all pieces, but the caption (25
    characters or more) and each number of the value; not_found; no_fulltext. Version marks at the end
    of a study's name don't count.
    """
    # Of a study several texts are joined; each study's rows then meet one text.
    body = texts.groupBy("study").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("_t")).select("study", F.concat(F.lit(" "), excerpt_text(F.col("_t")), F.lit(" ")).alias("_body"))
    known = rows.withColumn("study", F.regexp_replace(F.trim("study"), r"v\d+$", "")).withColumn("_x", F.when(F.length("excerpt") == F.octet_length("excerpt"), F.col("excerpt")).otherwise(compatible(F.col("excerpt"))))
    at = known.join(body, "study", "left")
    pieces = excerpt_pieces(F.col("_x"))
    here = (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(F.col("_body"), p))
    stripped = F.regexp_replace("_x", r"\\[A-Za-z]+", " ")
    caption = F.lower(F.trim(F.regexp_replace(F.get(F.split(stripped, rf"\s*{any_of(CAPTION_ENDS)}\s*"), F.lit(0)), r"[^0-9A-Za-z.%+\-=<>]+", " ")))
    numbers = F.regexp_extract_all(F.coalesce("value", F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    cells = (F.size(numbers) > 0) & F.forall(numbers, lambda v: F.regexp_count(F.col("_body"), F.concat(F.lit(r"(?<![\d.])\Q"), v, F.lit(r"\E(?![\d])"))) > 0)
    table = (F.length(caption) >= 25) & F.contains(F.col("_body"), caption) & cells
    printed = numbers_contained(F.coalesce("value", F.lit("")), F.col("_x"))
    derived = F.startswith(F.lower(F.trim(F.coalesce("location", F.lit("")))), F.lit("derived from"))
    status = F.when(F.coalesce(F.trim("_body"), F.lit("")) == "", "no_fulltext").when(here & printed, "ok").when(here & derived, "derived").when(here, "value_not_in_excerpt").when(table, "table_ok").otherwise("not_found")
    return at.select(*rows.columns, status.alias("status"))


def decimals(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\.(\d+)", 1))


def same_value(first: Column, second: Column) -> Column:
    """Equal as printed: the same text; the same number at the coarser of two precisions; a fraction that
    is the first one's percentage; or the same fractions."""
    a, b = F.lower(F.trim(first)), F.lower(F.trim(second))
    x, y = a.try_cast("double"), b.try_cast("double")
    parts = F.regexp_extract_all(b, F.lit(r"^(\d+)\s*/\s*\d+$"), 1), F.regexp_extract_all(b, F.lit(r"^\d+\s*/\s*(\d+)$"), 1)
    percent = F.try_divide(100 * F.get(parts[0], F.lit(0)).try_cast("double"), F.get(parts[1], F.lit(0)).try_cast("double"))
    at = lambda v, d: F.bround(v * F.pow(F.lit(10.0), d), 0)
    least = F.least(decimals(a), decimals(b))
    sets = [F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\d+/\d+)"), 1))) for t in (a, b)]
    return F.when(a == b, True).when(percent.isNotNull() & x.isNotNull(), at(percent, decimals(a)) == F.round(x * F.pow(F.lit(10.0), decimals(a)), 0)).when(x.isNull() | y.isNull(), (F.size(sets[0]) > 0) & (sets[0] == sets[1])).otherwise(at(x, least) == at(y, least))


def changed_cells(before: DataFrame, after: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Rows (key, cell, was, now) of cells outside `fill` that differ, blank and null being alike; a row on
    one side only counts as the cell `row`."""
    cells = [c for c in before.columns if c != key and c not in fill]
    text = lambda df: df.select(key, F.map_from_arrays(F.array(*map(F.lit, cells)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])).alias("m"))
    both = text(before).withColumnRenamed("m", "a").join(text(after).withColumnRenamed("m", "b"), key, "full_outer")
    whole = both.where("a is null or b is null").select(key, F.lit("row").alias("cell"), F.when(F.col("a").isNotNull(), "present").alias("was"), F.when(F.col("b").isNotNull(), "present").alias("now"))
    pairs = both.where("a is not null and b is not null").select(key, F.explode("a").alias("cell", "was"), "b").select(key, "cell", "was", F.element_at("b", F.col("cell")).alias("now"))
    return pairs.where("was <> now").union(whole)


def overridden(rows: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """rows (on, first, second) with the class that stands: the decision, else the one both gave. A
    disagreement that no decision settles is fatal."""
    out = rows.join(decisions.select(*on, "final"), on, "left")
    agreed = F.when(F.col("first").eqNullSafe(F.col("second")), F.col("first"))
    settled = F.col("final").isNotNull() | F.col("first").eqNullSafe(F.col("second"))
    return out.select(*on, F.when(settled, F.coalesce("final", agreed)).otherwise(F.raise_error(F.lit("a disagreement is not settled"))).alias("class"))


def paired_lines(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Selection lines in which a raw record takes its recalibrated one's row as second value, and the
    latter is no longer included. lines: analysis, record, row_id, include, b_row; pairs: raw, recal."""
    recal = lines.where("include = 'yes'").select("analysis", F.col("record").alias("recal"), F.col("row_id").alias("_row"))
    joined = pairs.join(recal, "recal").join(lines.select("analysis", F.col("record").alias("raw")), ["analysis", "raw"])
    out = lines.join(joined.select("analysis", F.col("raw").alias("record"), "_row"), ["analysis", "record"], "left").join(joined.select("analysis", F.col("recal").alias("record"), F.lit(True).alias("_gone")), ["analysis", "record"], "left")
    return out.select("analysis", "record", "row_id", F.when(F.col("_gone"), "no").otherwise(F.col("include")).alias("include"), F.coalesce("_row", "b_row").alias("b_row"))


def read_selection(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Included selection lines with a, b and val.

    lines: line, analysis, group, include, row_id, a_field, a_pattern, b_row, b_field, b_pattern, expr.
    ledger: row_id and the fields that lines name. a is the number in its row's a_field (`value` if it
    names none); b, where a line has a b_field, that of b_row, or of the same row. A pattern must find
    exactly one number. What can't be read is fatal: a missing row, an unknown field or expression, a text
    without its one number, an expression without the value it needs or dividing by zero. A percent pair
    of an r2 analysis has both values divided by 100.
    """
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    fields = [c for c in ledger.columns if c != "row_id"]
    book = ledger.select("row_id", F.create_map(*[x for c in fields for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]).alias("_f"))
    named = lines.where(F.lower(F.trim("include")) == "yes").withColumn("_other", F.coalesce(blank("b_row"), "row_id"))
    # Both sides are dealt by their number of rows and merged: a book is small on disk, not as a table of maps.
    n = max(named.count(), book.count())
    at = dealt(named, n, "row_id").join(dealt(book, n, "row_id").hint("merge"), "row_id", "left")
    other = book.select(F.col("row_id").alias("_other"), F.col("_f").alias("_g"))
    at = dealt(at, n, "_other").join(dealt(other, n, "_other").hint("merge"), "_other", "left")
    where = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("analysis"), F.lit(", row "), F.coalesce("row_id", F.lit("")))

    def number(held: Column, field: Column, pattern: Column) -> Column:
        text = held[field]
        fatal = F.raise_error(F.concat(where, F.lit(": not in the ledger"))).cast("double")
        return F.when(text.isNull(), fatal).otherwise(read_number(text, pattern, where))

    a = number(F.col("_f"), F.coalesce(blank("a_field"), F.lit("value")), F.col("a_pattern"))
    b = F.when(blank("b_field").isNotNull(), number(F.col("_g"), F.col("b_field"), F.col("b_pattern")))
    rows = at.select("line", "analysis", group_name(F.col("analysis"), F.col("group")).alias("group"), where.alias("_w"), a.alias("a"), b.alias("b"), F.coalesce(blank("expr"), F.lit("a")).alias("expr"))
    halves = (F.col("expr") == "a/100") & F.col("b").isNotNull() & F.startswith(F.col("analysis"), F.lit("r2"))
    rows = rows.withColumn("b", F.when(halves, F.col("b") / 100).otherwise(F.col("b")))
    val = evaluated(F.col("expr"), F.col("a"), F.col("b"))
    return rows.select("line", "analysis", "group", "a", "b", F.when(val.isNotNull(), val).otherwise(F.raise_error(F.concat("_w", F.lit(": no value of "), "expr")).cast("double")).alias("val"))


def selected(lines: DataFrame, analysis: str, roles: list[str] | None = None, subsets: list[str] | None = None) -> DataFrame:
    """Included lines of one analysis, of some roles and subsets."""
    out = lines.where((F.col("include") == "yes") & (F.col("analysis") == analysis))
    out = out if roles is None else out.where(F.col("role").isin(*roles))
    return out if subsets is None else out.where(F.col("subset").isin(*subsets))


def one_record(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines, of which each key must name exactly one; another number is fatal."""
    n = lines.groupBy(*keys).agg(F.count("*").alias("_n"))
    return lines.join(n, keys).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("a record is not unique")))).drop("_n")


def classed(estimates: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    """Estimates with their comparator class; one without is fatal."""
    return estimates.join(classes.select(*on, "class"), on, "left").withColumn("class", F.when(F.col("class").isNotNull(), F.col("class")).otherwise(F.raise_error(F.lit("an estimate has no comparator class"))))


def listed_ids(texts: DataFrame, text: str, pattern: str, ledger: DataFrame, own: list[str]) -> DataFrame:
    """Rows (id, in_ledger): distinct ids that texts list, but their own, and whether the ledger has them."""
    ids = texts.select(F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)).alias("id")).distinct().where(~F.col("id").isin(*own))
    known = ledger.select(F.regexp_replace(F.trim("id"), r"v\d+$", "").alias("id")).distinct().withColumn("_k", F.lit(True))
    return ids.join(known, "id", "left").select("id", F.col("_k").isNotNull().alias("in_ledger"))


def lines_with(text: Column, pattern: str, width: int = 240) -> Column:
    """What stands around each match of a pattern on its line, at most width / 2 before and width after.

    The characters before are tried again at every place, so only lines with a match are read that way.
    """
    around = F.lit(f"(.{{0,{width // 2}}}(?:{pattern}).{{0,{width}}})")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern))
    found = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, around, 1)))
    hits = F.when(~text.rlike(pattern), F.array().cast("array<string>")).otherwise(found)
    return F.transform(hits, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def card_license(text: Column) -> Column:
    """The license of a card's front matter: a value, or a list of `- ` lines as they stand; null without one."""
    value = F.regexp_extract(text, r"(?m)^license:[ \t]*(\S.*)$", 1)
    items = F.regexp_extract(text, r"(?m)^license:[ \t]*\n((?:- .*\n)+)", 1)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(value != "", strip(value)).when(items != "", strip(items))


def census(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Census rows (id, tier, relation, family) with what a hand check says: its verdict as tier, its
    relation and family; unchecked originals are families of their own."""
    c = checks.select("id", F.col("verdict").alias("_v"), F.col("relation").alias("_r"), F.col("family").alias("_f"))
    at = rows.join(c, "id", "left")
    checked = F.col("_v").isNotNull()
    tier = F.when(checked, F.trim("_v")).otherwise(F.col("tier"))
    return at.select("id", tier.alias("tier"), F.when(checked, F.coalesce("_r", F.lit(""))).otherwise(F.col("relation")).alias("relation"), F.when(checked, F.trim("_f")).when(F.col("tier") == "T1", F.coalesce("family", F.col("id").cast("string"))).otherwise(F.lit("")).alias("family"), checked.alias("checked"))


def head_counts(families: DataFrame, codes: DataFrame, panels: list[str]) -> DataFrame:
    """Originals and distinct families for each decision head; a head that is none is fatal, originals
    without a code count under `missing`. families: id, family (later sources override earlier ones
    before this); codes: id, panel."""
    panel = F.lower(F.trim("panel"))
    legal = F.when(panel.isin(*panels) | F.col("panel").isNull(), F.coalesce(panel, F.lit("missing"))).otherwise(F.raise_error(F.lit("unknown panel")))
    return families.join(codes, "id", "left").groupBy(legal.alias("panel")).agg(F.count("*").alias("originals"), F.count_distinct(F.lower("family")).alias("families"))


def recal_ratios(lines: DataFrame) -> DataFrame:
    """Recalibrated over raw value of raw estimates with both, by the kind of fit: extremes and records.
    lines: record, a_stage, role, fit, val, b."""
    rows = lines.where("b is not null and a_stage = 'raw' and role = 'estimate'").withColumn("ratio", F.try_divide("b", "val"))
    kind = F.when(F.startswith("fit", F.lit("in-domain")), "in-domain").when(F.startswith("fit", F.lit("transferred")), "transferred").otherwise("other")
    low, high = F.min(F.struct("ratio", "record")), F.max(F.struct("ratio", "record"))
    return rows.groupBy(kind.alias("fit")).agg(F.count("*").alias("records"), low["ratio"].alias("least"), low["record"].alias("least_record"), high["ratio"].alias("greatest"), high["record"].alias("greatest_record"))


def claim_direction(own: Column, others: Column) -> Column:
    """An error beside those of comparators: supported if below all, contradicted if below none, else mixed;
    null without comparators."""
    below = F.size(F.filter(others, lambda x: own < x))
    return F.when(F.size(others) > 0, F.when(below == F.size(others), "supported").when(below == 0, "contradicted").otherwise("mixed"))


def ratio_direction(ratio: Column, least: Column) -> Column:
    """A speed or cost claim: supported at or over the least ratio claimed, mixed between 1 and it, else
    contradicted; null without a ratio."""
    return F.when(ratio.isNotNull(), F.when(ratio >= least, "supported").when(ratio > 1, "mixed").otherwise("contradicted"))


def absence_direction(found: Column) -> Column:
    """A claim that something never happens (type errors, wrong answers at high confidence)."""
    return F.when(found.isNotNull(), F.when(found == 0, "supported").otherwise("contradicted"))


def rank_direction(lower: Column, total: Column) -> Column:
    """A calibration claim from counts: how many of all comparators have a lower error."""
    return F.when((lower > 0) & (lower < total), "mixed").when(lower == 0, "supported").when(lower.isNotNull(), "contradicted")


def frontier_direction(own: Column, others: Column) -> Column:
    """A claim to be on the frontier of (quality, cost, latency). own: a struct of these; others: an array
    of them. Contradicted if another is at least as good in all and better in one; else mixed if one has
    more quality, else supported; null without others."""
    alike = lambda x: (x["quality"] >= own["quality"]) & (x["cost"] <= own["cost"]) & (x["latency"] <= own["latency"])
    better = lambda x: (x["quality"] > own["quality"]) | (x["cost"] < own["cost"]) | (x["latency"] < own["latency"])
    return F.when(F.size(others) > 0, F.when(F.exists(others, lambda x: alike(x) & better(x)), "contradicted").when(F.exists(others, lambda x: x["quality"] > own["quality"]), "mixed").otherwise("supported"))


def consistency(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows (what, n, failures, ok): each check over all rows in one pass; a null check fails."""
    names = list(checks)
    found = rows.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(checks.values())])
    each = F.explode(F.array(*[F.struct(F.lit(what).alias("what"), F.col(f"_{i}").alias("failures")) for i, what in enumerate(names)]))
    return found.select("n", each.alias("x")).select("x.what", "n", "x.failures", (F.col("x.failures") == 0).alias("ok"))


def slug(text: Column) -> Column:
    """A path's segment: lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def camel(text: Column) -> Column:
    """The first letter upper case, the rest as it is."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def published(values: DataFrame, label: str, prefix: str) -> DataFrame:
    """values under their full labels. A label that isn't letters and digits, or that stands twice, is fatal."""
    wrong = F.raise_error(F.concat(F.lit("bad label "), F.coalesce(F.col(label), F.lit("")))).cast("string")
    named = values.withColumn(label, F.when(F.col(label).rlike("^[A-Za-z0-9]+$"), F.concat(F.lit(prefix), F.col(label))).otherwise(wrong))
    again = named.groupBy(label).agg(F.count("*").alias("_n"))
    checked = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated label "), F.col(label))))
    return named.join(again, label).where(checked).drop("_n")
