"""What filters remove alone, together and in every order, from one cube over their failure flags.

Rows are first counted by part and flags, so the cube expands one row for each combination that occurs,
not each document. Of the cube's grouping sets the rows whose selected flags are all false count the
survivors of that subset of filters. A step of an order is then a join of two subsets' survivors: those
before it and those after it.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, plain

FILTERS = "ABCDE"
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = r"[#$%&*|]"
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D: too few words, too few distinct ones, many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [F.size(words) < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words), 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts (part, A to E, n, good, toxic) of documents by part and the filters that they fail.

    E, the copy of a smaller doc_id's text, needs no row to meet another: rows are counted by text,
    labels and part with their least id, and of a text's groups those with the least id of all hold the
    rows that pass.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    judged = documents.select(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), "doc_id", F.sha2(text.cast("binary"), 256).alias("same"), *[c.alias(f) for c, f in zip(text_flags(text), FILTERS, strict=False)])
    # Rows without an id have no label; they are dealt by their text, as there may be many.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(0)
    joined = judged.withColumn("s", spread).join(marks.withColumn("s", F.lit(0).cast("long")), ["doc_id", "s"], "left").drop("s").withColumns({m: F.coalesce(m, F.lit(0)) for m in MEASURES[1:]})
    by = ["same", "part", *FILTERS[:4], *MEASURES[1:]]
    once = joined.groupBy("doc_id", *by).agg(F.count("*").alias("n"))
    # A null id counts as greater than all others.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = cut(once.groupBy(*by).agg(F.sum("n").alias("n"), F.min(F.struct(order.alias("id"), "n")).alias("least")))
    first = groups.groupBy("same").agg(F.min("least.id").alias("first"))
    passing = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    told = groups.join(first, "same").withColumn("x", F.explode(F.array(F.struct(F.lit(False).alias("E"), passing.alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - passing).alias("m")))))
    told = told.where("x.m > 0").select("part", *FILTERS[:4], "x.E", F.col("x.m").alias("n"), *[(F.col("x.m") * F.col(m)).alias(m) for m in MEASURES[1:]])
    return told.groupBy("part", *FILTERS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def survivors(counts: DataFrame) -> DataFrame:
    """Rows (part, subset, n, good, toxic) for each part and subset of filters, a bit for each: what
    passes all of the subset, zeros included."""
    cube = counts.cube("part", *FILTERS).agg(F.grouping_id().alias("g"), *[F.sum(m).alias(m) for m in MEASURES])
    # grouping_id has a bit for each column that is rolled up, part's first and E's last.
    chosen = F.lit((1 << len(FILTERS)) - 1).bitwiseXOR(F.col("g").cast("int"))
    clean = reduce(Column.__and__, [F.coalesce(~F.col(f), F.lit(True)) for f in FILTERS])
    found = cube.where(F.col("g") < 1 << len(FILTERS)).where(clean).select("part", chosen.alias("subset"), *MEASURES)
    every = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, list(MEASURES))


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int, int]]:
    """(order, step, the filter's bit, subset before, subset after) of all orders; the first filter has
    the highest bit."""
    bit = {f: 1 << (len(filters) - 1 - i) for i, f in enumerate(filters)}
    out = []
    for order in map("".join, permutations(filters)):
        before = 0
        for i, f in enumerate(order):
            out.append((order, i + 1, bit[f], before, before | bit[f]))
            before |= bit[f]
    return out


def audit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for each part, order of the five filters and step.

    Null texts are empty, and empty texts are copies of each other. A null part is the empty string, as
    is an empty one. A null doc_id counts as the greatest; rows of one doc_id are no copies of each
    other, each is counted. Of several labels of one doc_id any marks it; null labels and rows without
    one mark nothing. Empty documents give no rows. Other columns are ignored.
    """
    docs = documents.select(plain(doc_id).alias("doc_id"), plain(text).alias("text"), plain(part).alias("part"))
    marks = labels.select(plain(doc_id).alias("doc_id"), plain(quality).alias("quality"), plain(toxic).alias("toxic"))
    left = cut(survivors(cut(flagged(docs, marks))))
    spark, every = documents.sparkSession, (1 << len(FILTERS)) - 1
    pairs = sorted({s[2:] for s in steps()})
    # A pair of subsets stands at one step of so many orders.
    orders = {p: math.factorial(p[1].bit_count()) * math.factorial(len(FILTERS) - 1 - p[1].bit_count()) for p in pairs}
    table = F.broadcast(spark.createDataFrame([(*p, orders[p]) for p in pairs], "filter int, before int, after int, orders long"))
    said = lambda of, name: left.select("part", F.col("subset").alias(of), *[F.col(m).alias(f"{name}_{m}") for m in MEASURES])
    gone = table.join(said("before", "b"), "before").join(said("after", "a"), ["part", "after"])
    gone = gone.select("part", "filter", "before", "after", "orders", F.col("a_n").alias("kept"), *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"gone_{m}") for m in MEASURES])
    of_filter = gone.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("gone_n"))).alias("fails"),
        F.max(F.when(F.col("after") == every, F.col("gone_n"))).alias("unique_fails"),
        F.sum(F.col("gone_n") * F.col("orders")).alias("shapley"),
    )
    placed = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, filter int, before int, after int"))
    found = gone.join(of_filter, ["part", "filter"]).join(placed, ["filter", "before", "after"])
    return found.select("part", "filter_order", "step", "kept", F.col("gone_n").alias("removed"), (F.col("fails") - F.col("gone_n")).alias("redundant"), "unique_fails", F.col("gone_good").alias("good_lost"), F.col("gone_toxic").alias("toxic_lost"), "shapley")


#: Applies every order to every document, one filter after another.
ORACLE_SQL = r"""
with marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
least as (select coalesce(text, '') as text, min(doc_id) as m from documents group by all),
w as (select coalesce(d.source, '') as part, d.doc_id, coalesce(d.text, '') as text, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') as w, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
      case when l.m is null then false when d.doc_id is null then true else l.m < d.doc_id end as e
      from documents d left join marks using (doc_id) join least l on l.text = coalesce(d.text, '')),
f as (select part, good, toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), e] as fails from w),
x as (select unnest(range(1, 6)) as i),
orders as (select a.i as a, b.i as b, c.i as c, d.i as d, e.i as e, [a.i, b.i, c.i, d.i, e.i] as seq from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
o as (select seq, array_to_string(list_transform(seq, lambda i: substr('ABCDE', i, 1)), '') as filter_order from orders),
told as (select part, good, toxic, fails, o.filter_order, o.seq, coalesce(list_position(list_transform(o.seq, lambda i: fails[i]), true), 6) as hit, len(list_filter(fails, lambda b: b)) as n_fails from f, o),
s as (select part, filter_order, step, seq[step] as i,
      count(*) filter (hit > step) as kept, count(*) filter (hit = step) as removed,
      count(*) filter (fails[seq[step]] and hit < step) as redundant, count(*) filter (fails[seq[step]] and n_fails = 1) as unique_fails,
      count(*) filter (hit = step and good = 1) as good_lost, count(*) filter (hit = step and toxic = 1) as toxic_lost
      from told, (select unnest(range(1, 6)) as step) group by part, filter_order, step, seq[step])
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, i)::bigint as shapley from s
"""
