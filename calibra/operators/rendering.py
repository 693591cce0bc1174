"""How questions become text and replies become probabilities: keys, options, schemas, parsing,
likelihoods of option keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Beyond so many options only the most likely REPORTED are asked for.
ALL_OPTIONS, REPORTED = 20, 5
#: Descriptions of a yes/no question that has none.
DEFAULTS = {"false": "No.", "true": "Yes."}


def option_keys(kind: Column, names: Column) -> Column:
    """Keys in option order: the names of a choice, false and true of a yes/no question, the numbers of
    a score's levels; null for any other kind."""
    levels = F.transform(names, lambda x, i: i.cast("string"))
    return F.when(kind == "choice", names).when(kind == "noul", F.array(*map(F.lit, DEFAULTS))).when(kind == "score", levels)


def option_texts(kind: Column, keys: Column, descriptions: Column, how: str = "keydesc") -> Column:
    """Options as text: key and description, the description or the key alone; yes/no is always no, yes."""
    form = {"keydesc": lambda k, d: F.concat(k, F.lit(": "), d), "desc": lambda k, d: d, "key": lambda k, d: k}[how]
    return F.when(kind == "noul", F.array(F.lit("no"), F.lit("yes"))).otherwise(F.zip_with(keys, descriptions, form))


def reported(options: Column) -> Column:
    """How many options a reply must give a probability."""
    return F.when(F.size(options) <= ALL_OPTIONS, F.size(options)).otherwise(REPORTED)


def prompt(state: Column, instructions: Column, options: Column) -> Column:
    """State, question, a line for each option, and what the reply must cover."""
    cover = F.when(F.size(options) <= ALL_OPTIONS, F.lit("all options")).otherwise(F.lit(f"the {REPORTED} likeliest options"))
    lines = F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("State:\n"), state), F.concat(F.lit("Question: "), instructions), F.concat(F.lit("Options:\n"), lines), F.concat(F.lit("Reply as JSON with probabilities of "), cover, F.lit(".")))


#: What a prompt for scoring keys or descriptions asks for, and the cue it ends with.
ASK_KEY = "Reply with the key of the single best option, exactly as written above."
ASK_DESCRIPTION = "Reply with the description of the single best option, exactly as written above."
CUE = "Answer:"


def scoring_prompt(state: Column, instructions: Column, keys: Column, descriptions: Column, by_key: bool = True) -> Column:
    """A prompt after which options are scored by likelihood, with its continuations: by key, or by
    description. A struct of text and continuations; the cue has no space after it, each continuation one
    before it."""
    lines = F.array_join(F.zip_with(keys, descriptions, lambda k, d: F.concat(F.lit("- "), k, F.lit(": "), d)), "\n")
    ask = F.lit(f"{ASK_KEY if by_key else ASK_DESCRIPTION}\n{CUE}")
    text = F.concat_ws("\n\n", F.concat(F.lit("State:\n"), state), F.concat(F.lit("Question: "), instructions), F.concat(F.lit("Options:\n"), lines), ask)
    return F.struct(text.alias("text"), F.transform(keys if by_key else descriptions, lambda x: F.concat(F.lit(" "), x)).alias("continuations"))


def schema_field(kind: Column, instructions: Column, keys: Column, descriptions: Column) -> Column:
    """A question as a JSON field: boolean, or an enum of its keys with their descriptions."""
    yes_no = F.to_json(F.struct(F.lit("boolean").alias("type"), instructions.alias("description")))
    enum = F.to_json(F.struct(F.lit("enum").alias("type"), keys.alias("choices"), instructions.alias("description"), F.map_from_arrays(keys, descriptions).alias("choice_descriptions")))
    return F.when(kind == "noul", yes_no).otherwise(enum)


def request_schema(questions: DataFrame, by: list[str], name: str, kind: str, field: Column) -> DataFrame:
    """Rows (by, fields, score_fields): a request's schema, its fields by name, and the names of those that are
    scores. A question of another kind than choice, noul or score is fatal."""
    legal = F.when(F.col(kind).isin("choice", "noul", "score"), field).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(F.col(kind), F.lit("")))).cast("string"))
    each = questions.select(*by, F.struct(F.col(name).cast("string").alias("k"), legal.alias("v"), (F.col(kind) == "score").alias("s")).alias("x"))
    told = each.groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("x"))
    names = F.transform(F.filter("x", lambda x: x["s"]), lambda x: x["k"])
    return told.select(*by, F.map_from_entries(F.transform("x", lambda x: F.struct(x["k"], x["v"]))).alias("fields"), names.alias("score_fields"))


def list_chars(keys: Column, texts: Column) -> Column:
    """Characters of an option list as it is rendered, a line `key: text` for each, and of its texts alone."""
    lines = F.array_join(F.zip_with(keys, texts, lambda k, t: F.concat(k, F.lit(": "), t)), "\n")
    return F.struct(F.length(lines).alias("rendered"), F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t)).alias("texts"))


def hypothesis(kind: Column, instructions: Column, rubric: Column, key: Column) -> Column:
    """An option as a sentence: a yes/no question without rubrics by its instructions or their denial; a
    rubric of five words or with a full stop as it is; else as what the text is about."""
    ins = F.trim(instructions)
    asked = F.when(key == "true", ins).otherwise(F.concat(F.lit("It is not the case that "), F.lower(F.left(ins, F.lit(1))), F.substring(ins, F.lit(2), F.length(ins))))
    text = F.regexp_replace(F.trim(F.coalesce(rubric, F.replace(key, F.lit("_"), F.lit(" ")))), r"^(True|False):\s*", "")
    whole = (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= 5) | F.endswith(text, F.lit("."))
    said = F.when(whole, F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))).otherwise(F.concat(F.lit("This text is about "), text, F.lit(".")))
    return F.when((kind == "noul") & rubric.isNull(), asked).otherwise(said)


def neutral_recode(options: Column, label: Column, soft: Column) -> tuple[Column, Column, Column]:
    """Options as o1, o2, ..., with the label and the keys of the soft distribution renamed alike."""
    names = F.transform(options, lambda o, i: F.concat(F.lit("o"), (i + 1).cast("string")))
    table = F.map_from_arrays(options, names)
    return names, F.try_element_at(table, label), F.transform_keys(soft, lambda k, v: F.coalesce(F.try_element_at(table, k), k))


def lenient_reply(text: Column, options: Column) -> Column:
    """Probabilities from a list of {key, p or probability} in the last JSON object after the thinking:
    a key counts by its name, or by what stands before its colon; negatives count as 0, repeated keys
    are summed, no mass or no JSON is uniform."""
    tail = F.substring_index(F.coalesce(text, F.lit("")), "</think>", -1)
    body = F.regexp_extract(tail, r"(?s)\{.*\}", 0)
    items = F.from_json(F.when(body != "", body).otherwise(tail), "struct<probabilities:array<struct<key:string,p:double,probability:double>>>")["probabilities"]
    given = F.filter(F.coalesce(items, F.array().cast("array<struct<key:string,p:double,probability:double>>")), lambda x: x.isNotNull() & F.coalesce(x["p"], x["probability"]).isNotNull())
    named = F.transform(given, lambda x: F.struct(F.trim(F.coalesce(x["key"], F.lit(""))).alias("k"), F.greatest(F.coalesce(x["p"], x["probability"]), F.lit(0.0)).alias("v")))
    known = F.transform(named, lambda x: F.struct(F.when(F.array_contains(options, x["k"]), x["k"]).otherwise(F.trim(F.substring_index(x["k"], ":", 1))).alias("k"), x["v"].alias("v")))
    return V.rescaled(F.transform(options, lambda o: F.aggregate(F.filter(known, lambda x: x["k"] == o), F.lit(0.0), lambda a, x: a + x["v"])))


def restricted(logs: Column, offered: Column) -> Column:
    """Softmax of log-probabilities (a map) over the offered classes only."""
    own = F.transform(offered, lambda o: F.element_at(logs, o))
    return V.rescaled(F.transform(own, lambda x: F.exp(x - F.array_max(own))))


def softmax(rows: DataFrame, item: str, score: str, name: str = "p") -> DataFrame:
    """rows with exp(score) over the sum of its item's."""
    top = rows.withColumn("_e", F.exp(F.col(score) - F.max(score).over(Window.partitionBy(item))))
    return top.withColumn(name, F.col("_e") / F.sum("_e").over(Window.partitionBy(item))).drop("_e")


def key_likelihood(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (item, opt, logp, boundary, missing, p) of keys (item, opt, tokens) and next-token
    log-probabilities (item, path array, token, lp).

    logp: the sum over a key's tokens. boundary: the logarithm of what is left after the tokens that go
    on to a longer declared key. A token that a path doesn't list counts as the path's least
    log-probability and as missing. A key without tokens, or two of the same, is fatal. p: softmax of both over an item's keys.
    All joins are merges: of exploded rows Spark knows the size before, and would broadcast them by it.
    """
    alike = keys.groupBy("item", "tokens").agg(F.count("*").alias("_n"))
    fatal = lambda why: F.raise_error(F.concat(F.lit(why), F.col("item").cast("string")))
    sound = F.when(F.size("tokens") < 1, fatal("a key without tokens in item ")).when(F.col("_n") > 1, fatal("two keys of the same tokens in item ")).otherwise(F.lit(True))
    keys = keys.join(alike.hint("merge"), ["item", "tokens"]).where(sound).drop("_n")
    steps = keys.select("item", "opt", "tokens", F.posexplode("tokens").alias("j", "token"))
    steps = steps.select("item", "opt", F.expr("slice(tokens, 1, j)").alias("path"), "token", F.lit(False).alias("beyond"))
    longer = steps.select("item", "path", "token").distinct()
    beyond = keys.select("item", "opt", F.col("tokens").alias("path")).join(longer.hint("merge"), ["item", "path"]).select("item", "opt", "path", "token", F.lit(True).alias("beyond"))
    floors = nodes.groupBy("item", "path").agg(F.min("lp").alias("floor"))
    found = steps.union(beyond).join(nodes.hint("merge"), ["item", "path", "token"], "left").join(floors.hint("merge"), ["item", "path"], "left").withColumn("at", F.coalesce("lp", "floor"))
    mass = F.sum(F.when(F.col("beyond"), F.exp("at")))
    sums = found.groupBy("item", "opt").agg(F.sum(F.when(~F.col("beyond"), F.col("at"))).alias("logp"), F.log1p(-F.least(F.coalesce(mass, F.lit(0.0)), F.lit(1 - 1e-15))).alias("boundary"), F.count_if(F.col("lp").isNull()).alias("missing"))
    return softmax(sums.withColumn("_s", F.col("logp") + F.col("boundary")), "item", "_s").drop("_s")


def description_likelihood(tokens: DataFrame) -> DataFrame:
    """Rows (item, opt, mean, p) of rows (item, opt, lp), one for each token: softmax of mean log-probabilities."""
    means = tokens.groupBy("item", "opt").agg((F.sum("lp") / F.greatest(F.count("lp"), F.lit(1))).alias("mean"))
    return softmax(means, "item", "mean")


def two_digits(x: Column) -> Column:
    """A number with two significant digits; from 10 on whole, with separators of thousands."""
    places = 1 - F.floor(F.log10(F.abs(x))).cast("int")
    form = lambda d: F.format_number(F.round(x, d), max(d, 0))
    out = F.when(x == 0, F.lit("0"))
    for d in range(-12, 13):
        out = out.when(places == d, F.replace(form(d), F.lit(","), F.lit("")) if d > 0 else form(d))
    return out


def tidy(value: Column) -> Column:
    """A printed decimal with three places at most and no zeros at its end but one after the point."""
    plain = F.when(F.length(F.substring_index(value, ".", -1)) > 3, F.replace(F.format_number(value.try_cast("double"), 3), F.lit(","), F.lit(""))).otherwise(value)
    cut = F.regexp_replace(plain, r"(?<=\.\d{1,9}?)0+$", "")
    cut = F.when(F.endswith(cut, F.lit(".")), F.concat(cut, F.lit("0"))).otherwise(cut)
    return F.when(value.rlike(r"^-?\d+\.\d+$"), cut).otherwise(value)


#: Room kept for the question, least tokens of an option and of the question once options are cut.
ROOM, LEAST_OPTION, LEAST_HEAD = 16, 4, 8


def option_budget(requests: DataFrame, head_most: int, most: int, cap: int) -> DataFrame:
    """What a service of bounded input makes of each request, from token counts alone.

    requests: options and keys (arrays of counts: an option's text, its key alone), head, state, gold (place).
    Adds exceeds (options leave the question too little room, so all are cut alike), head_kept, state_kept,
    seq_len, lost (options cut down to their key), dropped (options whose mark lies beyond the end), refused
    (some are dropped) and gold_whole; further options_total (with marks, after the cap), excess (over the room
    for options), fair (an option's share where all are cut), gold_mark (its place), gold_lost, gold_dropped,
    and kept (tokens that each option keeps). An option takes a mark besides its tokens; so do start, end and
    question.
    """
    marked = requests.withColumn("_m", F.transform("options", lambda n: F.least(n, F.lit(cap)) + 1))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: (a + x).cast("int"))
    fair = F.greatest(F.lit(LEAST_OPTION), F.floor(F.lit(head_most - ROOM) / F.greatest(F.size("options"), F.lit(1))).cast("int"))
    cut = marked.withColumn("exceeds", total(F.col("_m")) > head_most - ROOM).withColumn("_k", F.when(F.col("exceeds"), F.transform("_m", lambda n: F.least(n, fair))).otherwise(F.col("_m")))
    laid = cut.withColumn("head_kept", F.least(F.col("head"), F.greatest(F.lit(LEAST_HEAD), head_most - total(F.col("_k")))))
    at = F.transform("_k", lambda n, i: 2 + F.col("head_kept") + total(F.slice("_k", F.lit(1), i)))
    laid = laid.withColumn("_at", at).withColumn("_state", 3 + F.col("head_kept") + total(F.col("_k")))
    laid = laid.withColumn("state_kept", F.least(F.col("state"), F.greatest(F.lit(0), most - F.col("_state") - 1)))
    lost = F.size(F.filter(F.zip_with("_k", "keys", lambda n, k: n - 1 <= k), lambda x: x))
    dropped = F.size(F.filter("_at", lambda m: m >= most))
    whole = F.get("_k", F.col("gold")) - 1 >= F.get("options", F.col("gold"))
    out = laid.select("*", F.least(F.lit(most), F.col("_state") + F.col("state_kept") + 1).alias("seq_len"), lost.alias("lost"), dropped.alias("dropped"), (dropped > 0).alias("refused"), whole.alias("gold_whole"),
        total(F.col("_m")).alias("options_total"), F.greatest(F.lit(0), total(F.col("_m")) - (head_most - ROOM)).alias("excess"), F.when(F.col("exceeds"), fair).alias("fair"), F.get("_at", F.col("gold")).alias("gold_mark"),
        (F.get("_k", F.col("gold")) - 1 <= F.get("keys", F.col("gold"))).alias("gold_lost"), (F.get("_at", F.col("gold")) >= most).alias("gold_dropped"), F.transform("_k", lambda n: n - 1).alias("kept"))
    return out.drop("_m", "_k", "_at", "_state")


def distinct_seen(ids: Column, kept: Column, dropped: Column) -> Column:
    """How many different option texts are seen after every cut. ids: each option's tokens; options that are
    dropped stand last."""
    seen = F.zip_with(ids, kept, lambda x, n: F.slice(x, F.lit(1), n))
    return F.size(F.array_distinct(F.slice(seen, F.lit(1), F.size(kept) - dropped)))


def budget_summary(replayed: DataFrame, by: list[str], head_most: int, most: int) -> DataFrame:
    """What the replay of `option_budget`, with a column distinct, comes to in each group: medians, greatest
    values, means and shares, one row for each group. Token counts are whole numbers up to the service's
    bounds, so a median's state is a count for each of them."""
    share = lambda c: F.avg(c.cast("int"))
    sums = replayed.groupBy(*by).agg(
        F.count("*").alias("requests"), F.max("options_total").alias("options_max"), share(F.col("exceeds")).alias("share_exceeding"), F.max("excess").alias("excess_max"),
        F.array_join(F.array_sort(F.collect_set("fair")), " ").alias("fair_shares"), F.avg("lost").alias("lost_mean"), (F.sum("lost") / F.sum(F.size("options"))).alias("share_lost"),
        F.avg("dropped").alias("dropped_mean"), share(F.col("refused")).alias("share_refused"), F.avg("distinct").alias("distinct_mean"), (F.sum("state_kept") / F.sum("state")).alias("state_kept_share"),
        F.max("seq_len").alias("length_max"), share(F.col("seq_len") >= most).alias("share_at_most"), F.avg(F.col("gold") + 1).alias("gold_place_mean"),
        share(F.col("gold_whole")).alias("share_gold_whole"), share(F.col("gold_lost")).alias("share_gold_lost"), share(F.col("gold_dropped")).alias("share_gold_dropped"),
        *[F.percentile(c, F.lit(0.5)).alias(f"{name}_median") for c, name in (("options_total", "options"), ("excess", "excess"), ("head_kept", "head_kept"), ("seq_len", "length"), ("gold_mark", "gold_mark"))])
    return sums.withColumn("options_over_head_median", F.col("options_median") / head_most)


def budget_check(replayed: DataFrame, by: list[str], used: str, refused: str) -> DataFrame:
    """The replay against what was observed: answered requests with a usage, how many used just seq_len tokens,
    refusals seen, foretold, and both."""
    asked = ~F.col(refused) & F.col(used).isNotNull()
    return replayed.groupBy(*by).agg(
        F.count_if(asked).alias("compared"), F.count_if(asked & (F.col(used) == F.col("seq_len"))).alias("equal"), F.count_if(F.col(refused)).alias("refused_seen"),
        F.count_if(F.col("refused")).alias("refused_foretold"), F.count_if(F.col("refused") & F.col(refused)).alias("both"))
