"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

A window is as many consecutive words of a document as an item has. Each gets a 64-bit SimHash of its
shingles, weighted by their counts. Fingerprints are cut into RADIUS + 1 blocks; two that differ in at
most RADIUS bits agree in a block, so a join of windows and items of one size on their blocks finds
every item within the radius. Candidates are verified by exact weighted Jaccard.

A window that is similar enough shares a word shingle with an item of its size, so windows without one
get no fingerprint: fingerprints of all windows of all sizes would be as many rows as words, for each
size. Which item it was plays no part in the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, plain, semi, small

WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 fingerprints differ in about 10 bits of 64, with a deviation of 3.
RADIUS = 23
#: Bits of a counter; several stand in one long. Wider ones serve where an item has more shingles.
LANE_BITS = 12


def word_list(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")


def shingle_list(words: Column, k: int) -> Column:
    """Hashes of the k words from each place on; none if there are fewer."""

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, many).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), of)[0]


def lanes(h: Column, bits: int) -> list[Column]:
    """The 64 bits of h, as many in each long as there is room for, each in a lane of its own."""
    out, count = [], 63 // bits
    for at in range(0, 64, count):
        own = [F.shiftleft(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("long"), bits * (b - at)) for b in range(at, min(64, at + count))]
        out.append(reduce(lambda x, y: x.bitwiseOR(y), own))
    return out


def simhash(shingles: Column, width: int = LANE_BITS) -> Column:
    """Of an array of shingles' lanes (structs l0, l1, ...) the bits set in over half of them."""
    count = 63 // width
    names = [f"l{i}" for i in range(-(-64 // count))]
    kind = "struct<" + ",".join(f"{n}:bigint" for n in [*names, "n"]) + ">"
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in [*names, "n"]]).cast(kind)
    mask = (1 << width) - 1

    def bits(sums: Column) -> Column:
        on = [F.when(2 * F.shiftright(sums[names[b // count]], width * (b % count)).bitwiseAND(F.lit(mask)) > sums["n"], F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for b in range(64)]
        return reduce(lambda x, y: x.bitwiseOR(y), on)

    return F.aggregate(shingles, start, lambda acc, x: F.struct(*[(acc[n] + x[n]).alias(n) for n in names], (acc["n"] + 1).alias("n")), bits)


def laned(shingles: Column, width: int = LANE_BITS) -> Column:
    return F.transform(shingles, lambda g: F.struct(*[x.alias(f"l{i}") for i, x in enumerate(lanes(g, width))]))


def blocks(simhash: Column) -> Column:
    """(number, value) of each of RADIUS + 1 blocks."""
    out, at = [], 0
    for i in range(RADIUS + 1):
        size = (64 * (i + 1)) // (RADIUS + 1) - at
        out.append(F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << size) - 1)).alias("v")))
        at += size
    return F.array(*out)


def contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, key, item_id, start, length, similarity): for each document and item the window
    of greatest weighted Jaccard similarity, the first if tied, if it is SIMILARITY or more.

    Words are lower-cased; shingles have WORDS words, or all of a shorter item's, and weigh as often
    as they occur. A document shorter than an item is one window. key is the hash of the document's
    text: rows with equal doc_id and text count once. Null and empty texts match nothing; rows with a
    null doc_id or item_id are judged like others. Texts of any length are read whole. Other columns
    are ignored.
    """
    docs = documents.select(plain(doc_id).alias("doc_id"), plain(text).alias("text")).where("text is not null").withColumn("key", F.xxhash64("text"))
    items = benchmark.select(plain(item_id).alias("item_id"), word_list(plain_name(item_text)).alias("w")).where("size(w) > 0")
    items = cut(items.withColumn("size", F.size("w")).withColumn("k", F.least("size", F.lit(WORDS))).withColumn("item", F.xxhash64("item_id", "w")).dropDuplicates(["item"]))
    return_parts = [matches(docs, items.where(F.col("k") == k), k) for k in sorted(r["k"] for r in items.select("k").distinct().collect())]
    if not return_parts:
        kinds = {f.name: f.dataType for f in [*docs.schema, *items.schema]}
        return docs.where("false").select("doc_id", "key", F.lit(None).cast(kinds["item_id"]).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0.0).alias("similarity"))
    return reduce(DataFrame.union, return_parts)


def plain_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def matches(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The matches of items whose shingles have k words."""
    greatest = items.agg(F.max("size")).first()[0]
    width = LANE_BITS if greatest < 1 << LANE_BITS else greatest.bit_length()
    shingled = items.select("item", "item_id", "size", shingle_list(F.col("w"), k).alias("g"))
    prints = cut(shingled.select("item", "size", F.array_distinct("g").alias("own"), simhash(laned(F.col("g"), width), width).alias("item_simhash")))
    item_counts = cut(shingled.select("item", "size", F.explode("g").alias("g")).groupBy("item", "size", "g").agg(F.count("*").alias("n")))

    # Shingles shared with an item of a size, by document; and all the windows of that size around them.
    places = docs.select("doc_id", "key", F.posexplode(shingle_list(word_list("text"), k)).alias("at", "g"))
    hits = places.join(small(item_counts.select("g", "size").distinct()), "g").groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "size")).alias("hits"))
    hits = cut(hits.withColumn("d", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))))
    texts = semi(docs, hits.select("key").distinct(), "key").withColumn("d", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)))
    worded = texts.join(hits, ["doc_id", "d", "key"]).withColumn("w", word_list("text")).select("doc_id", "d", "key", "hits", F.size("w").alias("m"), shingle_list(F.col("w"), k).alias("s"))
    # Few bytes, but many windows to come: a fixed number of tasks, which isn't cut down by their size.
    worded = cut(worded.dropDuplicates(["doc_id", "d", "key"]).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def around(h: Column) -> Column:
        last = F.greatest(F.col("m") - h["size"], F.lit(0))
        low, high = F.least(F.greatest(h["at"] - h["size"] + k, F.lit(0)), last), F.least(h["at"], last)
        return F.transform(F.sequence(low, high), lambda at: F.struct(at.alias("start"), h["size"].alias("size")))

    def printed(lane: Column) -> Column:
        own = lambda x: simhash(F.slice(lane, x["start"] + 1, x["size"] - k + 1), width)
        return F.transform(F.array_distinct(F.flatten(F.transform("hits", around))), lambda x: F.struct(x["start"], x["size"], own(x).alias("simhash")))

    # Fingerprints are made beside the document's shingles, so that its windows' rows don't copy these.
    prints_of = F.transform(F.array(laned(F.col("s"), width)), printed)[0]
    windows = worded.select("doc_id", "d", "key", F.explode(prints_of).alias("x")).select("doc_id", "d", "key", "x.size", "x.start", "x.simhash")

    # Candidates: windows and items of one size that agree in a block, each at the first block they
    # agree in; of these the ones within the radius, and then those whose unshared shingles allow it.
    dealt = windows.withColumn("x", F.explode(blocks(F.col("simhash"))))
    index = prints.select("item", "size", "item_simhash", F.explode(blocks(F.col("item_simhash"))).alias("x"))
    agree = F.zip_with(blocks(F.col("simhash")), blocks(F.col("item_simhash")), lambda x, y: x == y)
    near = dealt.join(small(index), ["size", "x"]).where(F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_simhash"))) <= RADIUS).where(F.array_position(agree, True) - 1 == F.col("x.b"))
    near = near.select("doc_id", "d", "key", "item", "size", "start").join(small(prints.select("item", "own")), "item")
    near = near.join(worded.select("doc_id", "d", "key", "m", "s"), ["doc_id", "d", "key"]).withColumn("s", F.slice("s", F.col("start") + 1, F.col("size") - k + 1))
    unshared = F.size(F.array_except("s", "own"))
    near = near.where(F.size("s") - unshared >= SIMILARITY * (F.col("size") - k + 1 + unshared))
    near = cut(near.select(F.when(~F.col("d"), F.col("doc_id")).alias("doc_id"), "key", "item", "size", "start", "m", "s"))

    # Exact weighted Jaccard: shared weight over the rest.
    by = ["doc_id", "key", "item", "size", "start", "m"]
    counts = near.select(*by, F.explode("s").alias("g")).groupBy(*by, "g").agg(F.count("*").alias("c"))
    joined = counts.join(small(item_counts.select("item", "g", "n")), ["item", "g"], "left")
    sums = joined.groupBy(*by).agg(F.sum("c").alias("here"), F.sum(F.least("c", F.coalesce("n", F.lit(0)))).alias("both"))
    sums = sums.withColumn("similarity", F.col("both") / (F.col("here") + F.col("size") - k + 1 - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    best = sums.groupBy("doc_id", "key", "item").agg(F.min(F.struct(-F.col("similarity"), "start", F.least("size", F.col("m") - F.col("start")).alias("length"))).alias("b"))
    return best.join(items.select("item", "item_id"), "item").select("doc_id", "key", "item_id", F.col("b.start").alias("start"), F.col("b.length").alias("length"), (-F.col("b.col1")).alias("similarity"))


ORACLE_SQL = r"""
with d as (select distinct doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where text is not null),
i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark where text is not null),
it as (select item_id, w, len(w) as n, least(len(w), 5) as k from i where len(w) > 0),
ig as (select item_id, n, k, array_to_string(w[j:j + k - 1], ' ') as g from (select *, unnest(range(1, n - k + 2)) as j from it)),
ic as (select item_id, n, k, g, count(*) as c from ig group by all),
ks as (select distinct k from it),
dg as (select doc_id, text, k, len(w) as m, j, array_to_string(w[j:j + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as j from d, ks)),
hit as (select distinct doc_id, text, m, item_id, n, ic.k, j - 1 as pos from dg join ic on dg.g = ic.g and dg.k = ic.k),
win as (select distinct doc_id, text, m, item_id, n, k, unnest(range(least(greatest(pos - n + k, 0), greatest(m - n, 0)), least(pos, greatest(m - n, 0)) + 1)) as s from hit),
wg as (select win.doc_id, win.text, win.m, win.item_id, win.n, win.k, win.s, dg.g, count(*) as c from win join dg on dg.doc_id is not distinct from win.doc_id and dg.text = win.text and dg.k = win.k and dg.j - 1 between win.s and win.s + win.n - win.k group by all),
sim as (select wg.doc_id, wg.text, wg.m, wg.item_id, wg.n, wg.s, sum(least(wg.c, coalesce(ic.c, 0)))::double / (sum(wg.c) + any_value(wg.n - wg.k + 1) - sum(least(wg.c, coalesce(ic.c, 0)))) as similarity
        from wg left join ic on ic.item_id = wg.item_id and ic.g = wg.g group by wg.doc_id, wg.text, wg.m, wg.item_id, wg.n, wg.s),
best as (select *, row_number() over (partition by doc_id, text, item_id order by similarity desc, s) as r from sim where similarity >= 0.8)
select doc_id, item_id, s::int as start, least(n, m - s)::int as length, round(similarity, 6) as similarity from best where r = 1
"""
