"""Sampling and experimental design with reproducible draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.ranking import numbered


def stratified(df: DataFrame, stratum: list[str], ident: str, n: int | Column, seed: str) -> DataFrame:
    """n of each stratum by drawn order (a sampling operator: the limit is its purpose)."""
    order = Window.partitionBy(*stratum).orderBy(draw(seed, F.col(ident)), ident)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def proportional(df: DataFrame, panel: list[str], ident: str, share: float, seed: str) -> DataFrame:
    """max(1, round(n share)) of each panel, rounded half to even."""
    sizes = df.groupBy(*panel).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(share)).cast("int")).alias("_take"))
    return stratified(df.join(F.broadcast(sizes), panel), panel, ident, F.col("_take"), seed).drop("_take")


def round_robin(df: DataFrame, by: list[str], ident: str, parts: int) -> DataFrame:
    return df.withColumn("part", ((F.row_number().over(Window.partitionBy(*by).orderBy(ident)) - 1) % parts).cast("int"))


def permuted(items: DataFrame, item: str, options: list[str], gold: Column, seed: str) -> DataFrame:
    """Rows (item, option, gold, perm_rank): the options in an order drawn for each item."""
    rows = items.select(item, gold.alias("_gold"), F.explode(F.array(*map(F.lit, options))).alias("option"))
    order = Window.partitionBy(item).orderBy(draw(seed, F.col(item), F.col("option")), "option")
    return rows.select(item, "option", (F.col("option") == F.col("_gold")).alias("gold"), (F.row_number().over(order) - 1).alias("perm_rank"))


def nested_subsets(design: DataFrame, item: str, sizes: list[int]) -> DataFrame:
    """For each size k the gold option and the first k - 1 others; smaller subsets lie in larger ones."""
    order = Window.partitionBy(item, "gold").orderBy("perm_rank")
    rank = F.when(F.col("gold"), 0).otherwise(F.row_number().over(order))
    return design.withColumn("_r", rank).withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("_r") <= F.col("k") - 1).drop("_r")


def neutral(options: Column) -> Column:
    """o1, o2, ... in place of option names."""
    return F.transform(options, lambda o, i: F.concat(F.lit("o"), (i + 1).cast("string")))


#: Names of the negative and the positive option; krand draws five letters for each.
NAMINGS = {"k01": ("0", "1"), "kny": ("no", "yes"), "kswap": ("yes", "no")}


def renamed(items: DataFrame, item: str, positive: str, seed: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each binary item under every naming: rows (item, naming, negative_name, positive_name, label, *carry)."""
    spark = items.sparkSession
    names = spark.createDataFrame([(k, *v) for k, v in NAMINGS.items()] + [("krand", None, None)], "naming string, neg string, pos string")
    rows = items.crossJoin(F.broadcast(names))  # four namings, fixed
    word = lambda side: F.translate(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(side), F.col(item).cast("string"))), 1, 5), "0123456789abcdef", "abcdefghijklmnop")
    neg, pos = F.coalesce("neg", word("neg")), F.coalesce("pos", word("pos"))
    return rows.select(item, "naming", neg.alias("negative_name"), pos.alias("positive_name"), F.when(F.col(positive), pos).otherwise(neg).alias("label"), *carry)


def recast(rows: DataFrame, item: str, rule: Callable[[DataFrame], Column], seed: str) -> DataFrame:
    """Binary questions that a rule finds in rows, under every naming. rule(rows) is a column of struct<positive:
    boolean, soft: double> (soft: the positive option's probability, or null), or null to skip a row. Rows
    (item, naming, options, label, positive_name, soft); soft is in the order of options."""
    said = rows.select(item, rule(rows).alias("_b")).where("_b is not null").select(item, "_b.positive", "_b.soft")
    out = renamed(said, item, "positive", seed, ("soft",))
    return out.select(item, "naming", F.array("negative_name", "positive_name").alias("options"), "label", "positive_name", F.when(F.col("soft").isNotNull(), F.array(1 - F.col("soft"), F.col("soft"))).alias("soft"))


def with_none_option(options: Column, label: Column, name: str) -> tuple[Column, Column]:
    """An out-of-scope option at the end; it is the label where there was none."""
    return F.concat(options, F.array(F.lit(name))), F.coalesce(label, F.lit(name))


def single_group(labels: Column, groups: dict[str, str]) -> Column:
    """The one group that all labels map to; null if there are several or none."""
    table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    found = F.array_distinct(F.filter(F.transform(labels, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()))
    return F.when(F.size(found) == 1, found[0])


def hierarchical(items: DataFrame, item: str, gold: str, domains: dict[str, str], seed: str, option_seed: str) -> DataFrame:
    """Rows (item, stage, option, gold, place): the domains in a drawn order, then the options of the gold
    option's domain. domains: option -> domain."""
    names = sorted(set(domains.values()))
    table = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair])
    home = F.element_at(table, F.col(gold))
    place = lambda drawn: (F.row_number().over(Window.partitionBy(item).orderBy(drawn, "option")) - 1).cast("int")
    # Domains are drawn by their numbers.
    first = items.select(item, home.alias("_home"), F.posexplode(F.array(*map(F.lit, names))).alias("_i", "option"))
    first = first.select(item, F.lit("domain").alias("stage"), "option", (F.col("option") == F.col("_home")).alias("gold"), place(draw(seed, F.col(item), F.col("_i"))).alias("place"))
    second = items.select(item, F.col(gold).alias("_gold"), home.alias("_home"), F.explode(table).alias("option", "_domain")).where("_domain = _home")
    second = second.select(item, F.lit("option").alias("stage"), "option", (F.col("option") == F.col("_gold")).alias("gold"), place(draw(option_seed, F.col(item), F.col("option"))).alias("place"))
    return first.union(second)


def shuffled(df: DataFrame, label: list[str], ident: str, seed: str, cap: int) -> DataFrame:
    """A drawn write order: each label's first `cap`, then the first `cap` of all, with their places (a
    sampling operator: the cap is its purpose)."""
    own = stratified(df, label, ident, cap, seed)
    few = own.withColumn("_h", draw(seed, F.col(ident))).orderBy("_h", ident).limit(cap)
    return few.withColumn("place", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_h", ident)) - 1).cast("int")).drop("_h")  # at most `cap` rows


def rating_tasks(items: DataFrame, ident: str, parts: int, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """items dealt in turn to `parts` task tables (column part), with a blank column to fill for each name in
    `legal` and beside it what may stand there; a note is free."""
    turn = numbered(items, ident, "_r")
    blanks = [c for name, values in legal.items() for c in (F.lit("").alias(name), F.lit(" | ".join(values)).alias(f"{name}_may_be"))]
    return turn.select(((F.col("_r") - 1) % parts + 1).cast("int").alias("part"), *items.columns, *blanks, F.lit("").alias("note"))


def read_ratings(filled: DataFrame, ident: str, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (ident, names of legal) of filled task tables; what isn't one of the legal values is fatal, blanks
    are null."""
    def value(name: str) -> Column:
        given = F.lower(F.trim(F.col(name)))
        wrong = F.raise_error(F.concat(F.lit(f"{name} may not be "), given)).cast("string")
        return F.when(F.coalesce(given, F.lit("")) == "", F.lit(None).cast("string")).when(given.isin(*legal[name]), given).otherwise(wrong).alias(name)

    return filled.select(ident, *[value(name) for name in legal])
