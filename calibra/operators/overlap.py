"""Text normalization and overlap between a query set and a pool."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number words and their digits.
NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "twenty-one": "21",
}


def norm(text: Column) -> Column:
    """Lower case, ASCII punctuation as spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " "), r"\s+", " "))


def norm_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def char_grams(text: Column, n: int = 5) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda x: x != ""))


def plain_text(html: Column) -> Column:
    """Tags dropped, common entities replaced."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, mark in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}.items():
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: A number as it is printed: a numeral, whose digits commas and long minus signs may part, or a number word,
#: each with decimals or not; or decimals alone.
_SKIP = "[,−]{0,9}"
_WORD = rf"(?<!\w{_SKIP})(?:{'|'.join(reversed(NUMBERS))})(?!{_SKIP}\w)"
_DIGITS = rf"\d(?:{_SKIP}\d)*"
PRINTED = rf"(?i)((?:{_DIGITS}|{_WORD})(?:{_SKIP}\.{_SKIP}{_DIGITS})?|(?<!\d{_SKIP})\.{_SKIP}{_DIGITS})"


def numbers_of(text: Column) -> Column:
    """The numbers of a text in order, as plain numerals: number words are looked up, nothing before a point is 0."""
    table = F.create_map(*[F.lit(x) for pair in {**NUMBERS, "": "0"}.items() for x in pair])

    def plain(token: Column) -> Column:
        bare = F.translate(F.lower(token), ",−", "")
        whole, rest = F.substring_index(bare, ".", 1), F.regexp_extract(bare, r"\..*", 0)
        return F.concat(F.coalesce(F.try_element_at(table, whole), whole), rest)

    return F.transform(F.regexp_extract_all(text, F.lit(PRINTED), 1), plain)


def numbers_contained(value: Column, excerpt: Column) -> Column:
    """Whether every number of value is among those of excerpt."""
    return F.size(F.array_except(numbers_of(value), numbers_of(excerpt))) == 0


def duplicates(df: DataFrame, text: str, ident: str) -> DataFrame:
    """For each row, how many others have its text, exactly and normalized. Counted by group and
    joined, so no window holds a group."""
    rows = df.select(ident, F.col(text).alias("_t"), norm(F.col(text)).alias("_n"))
    exact, alike = rows.groupBy("_t").agg((F.count("*") - 1).alias("exact")), rows.groupBy("_n").agg((F.count("*") - 1).alias("normalized"))
    return rows.join(exact, "_t").join(alike, "_n").select(ident, "exact", "normalized")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as run at once, if it is read in fewer: for small files and long work a row."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.select(F.spark_partition_id()).distinct().count() < tasks else df


#: Distinct grams of all queries that are broadcast, at most, or in a block of queries; pool texts in a block, about.
QUERY_GRAMS, POOL_ROWS = 2_000_000, 20_000
#: Shared grams of texts and queries that a task counts at a time, about, and cells of its counts.
HITS, CELLS = 1_000_000, 1_000_000


def best_match(queries: DataFrame, pool: DataFrame, query_id: str, pool_id: str, grams) -> DataFrame:
    """For each query the pool text of greatest Jaccard similarity of gram sets, least id if tied.

    The queries' grams go to each task as an inverted index; a pool text then counts what it shares with
    every query in one pass, and only each task's best leaves it. Queries with more than QUERY_GRAMS grams
    are not broadcast, but meet the pool in blocks of both. Every pair that shares a gram is counted, never
    made a row; of equal pool texts the least id is read.
    """
    hashed = lambda df, ident: df.select(F.col(ident).cast("long").alias("_id"), F.transform(grams(F.col("text")), lambda x: F.xxhash64(x)).alias("_g"))
    q = hashed(queries, query_id).where(F.size("_g") > 0)
    once = hashed(spread(pool.groupBy("text").agg(F.min(pool_id).alias(pool_id))), pool_id)
    kinds, blocks = "q long, p long, j double", -(-(q.agg(F.sum(F.size("_g"))).first()[0] or 0) // QUERY_GRAMS)
    if blocks <= 1:
        shared = pool.sparkSession.sparkContext.broadcast(_index(q.toArrow()))
        found = once.mapInArrow(lambda batches: _counted(shared.value, batches), kinds)
    else:
        parts = -(-once.count() // POOL_ROWS)
        near = lambda df, own, of, other, n: df.withColumn(own, F.pmod(F.xxhash64("_id"), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))))
        left, right = near(q, "_qb", blocks, "_pb", parts), near(once, "_pb", max(parts, 1), "_qb", blocks)
        both = left.groupBy("_qb", "_pb").cogroup(right.groupBy("_qb", "_pb"))
        found = both.applyInArrow(lambda a, b: pa.Table.from_batches(_counted(_index(a), b.select(["_id", "_g"]).to_batches(max_chunksize=10_000))), kinds)
    least = found.groupBy("q").agg(F.max(F.struct("j", (-F.col("p")).alias("k"))).alias("b"))
    return least.select(F.col("q").alias(query_id), (-F.col("b.k")).alias(pool_id), F.col("b.j").alias("jaccard"))


def _index(queries: pa.Table) -> tuple[np.ndarray, ...]:
    """Of rows (_id, _g): ids, how many grams each has, the distinct grams, and whose each gram is."""
    ids, sizes = np.asarray(queries["_id"]), np.asarray(pc.list_value_length(queries["_g"])).astype(np.int64)
    gram = np.asarray(pc.list_flatten(queries["_g"]))
    order = np.argsort(gram, kind="stable")
    known, first = np.unique(gram[order], return_index=True)
    return ids, sizes, known, np.append(first, len(gram)), np.repeat(np.arange(len(ids)), sizes)[order]


def _counted(index: tuple[np.ndarray, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's best of pool texts (_id, _g)."""
    ids, sizes, known, first, owner = index
    best, whose = np.zeros(len(ids)), np.full(len(ids), np.iinfo(np.int64).max)
    rows = max(1, CELLS // max(1, len(ids)))
    for batch in batches if len(known) else ():
        n = np.asarray(batch.column("_g").value_lengths().fill_null(0)).astype(np.int64)
        flat, text, names = np.asarray(batch.column("_g").flatten()), np.repeat(np.arange(batch.num_rows), n), np.asarray(batch.column("_id"))
        place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[place] == flat
        place, text = place[hit], text[hit]
        count = first[place + 1] - first[place]
        # Hits up to each text; a step ends before its hits or cells are too many, but has one text at least.
        hits = np.concatenate([[0], np.cumsum(np.bincount(text, count, batch.num_rows).astype(np.int64))])
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(hits, hits[at] + HITS, "right")) - 1))
            lo, hi, total = ends[at], ends[to], int(hits[to] - hits[at])
            c = count[lo:hi]
            where = np.arange(total) + np.repeat(first[place[lo:hi]] - (np.cumsum(c) - c), c)
            cell = np.repeat((text[lo:hi] - at) * len(ids), c) + owner[where]
            both = np.bincount(cell, minlength=(to - at) * len(ids)).reshape(to - at, -1)
            similarity = both / np.maximum(n[at:to, None] + sizes - both, 1)
            top = similarity.max(0)
            least = np.where((similarity == top) & (both > 0), names[at:to, None], np.iinfo(np.int64).max).min(0)
            better = (top > best) | ((top == best) & (top > 0) & (least < whose))
            best, whose = np.where(better, top, best), np.where(better, least, whose)
            at = to
    some = best > 0
    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, whose, best)], ["q", "p", "j"])


def joined_match(queries: DataFrame, pool: DataFrame, query_id: str, pool_id: str, grams) -> DataFrame:
    """best_match by a join on grams, whatever the number of queries."""
    q = queries.select(query_id, grams(F.col("text")).alias("_g")).withColumn("_qn", F.size("_g"))
    p = pool.select(pool_id, grams(F.col("text")).alias("_g")).withColumn("_pn", F.size("_g"))
    qg, pg = q.select(query_id, "_qn", F.explode("_g").alias("_x")), p.select(pool_id, "_pn", F.explode("_g").alias("_x"))
    pairs = qg.join(pg, "_x").groupBy(query_id, pool_id, "_qn", "_pn").agg(F.count("*").alias("both"))
    sim = F.col("both") / (F.col("_qn") + F.col("_pn") - F.col("both"))
    best = pairs.withColumn("jaccard", sim).groupBy(query_id).agg(F.max(F.struct("jaccard", (-F.col(pool_id)).alias("k"))).alias("b"))
    return best.select(query_id, (-F.col("b.k")).alias(pool_id), F.col("b.jaccard").alias("jaccard"))


#: Windows of these lengths are hashed besides the heads' full length; a shorter head is looked for by as
#: much of its start as the longest of them covers.
WINDOWS = (1, 2, 4, 8, 16, 32, 64)
#: Bits of the filter for a head, and its most bits; marks that each hash sets. Characters hashed at once.
FILTER_BITS, MOST_BITS, MARKS, CHUNK = 16, 1 << 27, 4, 1 << 20
#: Heads that are broadcast, at most; more are joined by a shuffle.
SMALL_POOL = 100_000
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(texts: list[str], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the hashes of all windows of so many characters that lie within a text: (size, text,
    place in the text, hash). Rolling: all sizes are differences of one running sum."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(length) - length
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * _powers(_BASE, len(code) + 1)[:-1], out=sums[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), len(code) + 1)
    for size in sizes:
        count = np.maximum(length - size + 1, 0)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = place + np.repeat(first, count)
        yield size, np.repeat(np.arange(len(texts)), count), place, _mixed((sums[at + size] - sums[at]) * back[at] + np.uint64(size))


def _marks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(mark, hash): the bits that each hash sets in a filter of so many (a power of two)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(MARKS)])


def contained(pool: DataFrame, corpus: DataFrame, pool_id: str, corpus_id: str, length: int = 120) -> DataFrame:
    """Pairs (pool_id, corpus_id) where the first `length` normalized characters of a pool text (its head)
    lie in a corpus text, at word edges or not. Heads without a character match nothing.

    The corpus is read once: rolling hashes of its windows of the heads' length, and of shorter heads'
    starts, pass a Bloom filter of the heads' hashes; what passes is joined with the heads on the hash and
    checked on the characters. Of the pool only the filter, of a bounded size, reaches the driver.
    """
    spark, sizes = pool.sparkSession, [*(w for w in WINDOWS if w < length), length]
    heads = pool.select(F.col(pool_id).cast("long").alias("_p"), F.substring(norm(F.col("text")), 1, length).alias("_h")).where("_h <> ''")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_h").to_pylist()
            reach = np.array([max(s for s in sizes if s <= len(t)) for t in texts])
            key = np.zeros(len(texts), np.uint64)
            for size, text, place, hashes in window_hashes(texts, sizes):
                own = (place == 0) & (reach[text] == size)
                key[text[own]] = hashes[own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], ["_p", "_h", "_k"])

    heads = heads.mapInArrow(keyed, "_p long, _h string, _k long")
    n = heads.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(6, (FILTER_BITS * max(n, 1) - 1).bit_length()))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_marks(np.asarray(batch.column("_k")).view(np.uint64), bits))
            word, first = np.unique(bit >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(bit) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["w", "m"])

    words = np.zeros(bits // 64, np.uint64)
    told = heads.select("_k").mapInArrow(set_bits, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    words[told["w"].to_numpy(np.int64)] = told["m"].to_numpy(np.int64).view(np.uint64)
    used = [r["_s"] for r in heads.select(F.length("_h").alias("_l")).distinct().select(F.greatest(*[F.when(F.col("_l") >= s, s).otherwise(0) for s in sizes]).alias("_s")).distinct().collect()]
    shared = spark.sparkContext.broadcast((words, sorted(used)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, used = shared.value
        for batch in batches:
            ids, texts = batch.column("_c").to_pylist(), batch.column("_t").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size, to = size + len(texts[to]), to + 1
                found = set()
                for _, text, place, hashes in window_hashes(texts[at:to], used):
                    passed = np.ones(len(hashes), bool)
                    for bit in _marks(hashes, len(words) * 64):
                        passed &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    keys = hashes.view(np.int64)[passed].tolist()
                    found.update((ids[at + i], k, texts[at + i][j : j + length]) for i, j, k in zip(text[passed].tolist(), place[passed].tolist(), keys, strict=True))
                c, k, w = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(k, pa.int64()), pa.array(w, pa.string())], ["_c", "_k", "_w"])
                at = to

    texts = spread(corpus.select(corpus_id, "text")).select(F.col(corpus_id).cast("long").alias("_c"), norm(F.col("text")).alias("_t")).where("_t is not null")
    passed = texts.mapInArrow(windows, "_c long, _k long, _w string") if n else texts.select("_c", F.lit(0).cast("long").alias("_k"), F.lit("").alias("_w")).where("false")
    hits = passed.join(F.broadcast(heads) if n <= SMALL_POOL else heads, "_k").where(F.startswith(F.col("_w"), F.col("_h")))
    return hits.select(F.col("_p").alias(pool_id), F.col("_c").alias(corpus_id)).distinct()
