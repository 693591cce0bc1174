"""Removal of repeated runs of lines by winnowing, with DataFrame functions only.

A passage is `run` consecutive lines, or one or two lines that hold `words` words. Of each passage that
holds no smaller one the line of least hash, the rightmost if tied, is selected as a fingerprint: any two
equal passages are guaranteed to share one. Fingerprints that occur at one place only are dropped. The
positions of the others are joined by what surrounds them, and each match is extended to both sides as
far as the lines around it also stand earlier: of equal passages around a fingerprint all but the first,
by (doc_id, place), are later repeats, and the fingerprint's run goes from the leftmost line to the
rightmost one of them. No pairs of places are formed; of longer matches each part has fingerprints of
its own. Within one document a line goes at each place but its first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, plain, semi, small

RUN = 3
#: So many words in one line or two make a passage of its own.
PASSAGE_WORDS = 10
LAST = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]"


def lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def worded(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, key, text) the lines that have a word: h, their hashes, i, their places in the
    text, n, their numbers of words. Texts are split once."""
    n_words = lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    numbered = F.transform(lines("text"), lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(WORD), F.xxhash64(x)).alias("h"), n_words(x).alias("n")))
    found = docs.withColumn("lines", F.filter(numbered, lambda x: x["h"].isNotNull())).where(F.size("lines") > 0)
    return cut(found.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "key", F.col("lines.h").alias("h"), F.col("lines.i").alias("i"), F.col("lines.n").alias("n")))


def fingerprints(run: int, words: int) -> Column:
    """Of arrays h, i and n, for each fingerprint its place among the lines (at) and what surrounds it:
    run - 1 lines on both sides and itself, null beyond the ends (h, i, n)."""
    h, n = F.col("h"), F.col("n")

    def least(places: list[Column]) -> Column:
        low = F.least(*[F.get(h, p) for p in places])
        return F.coalesce(*[F.when(F.get(h, p) == low, p) for p in reversed(places)])

    def chosen(j: Column) -> Column:
        here, both = F.get(n, j), F.get(n, j) + F.get(n, j + 1)
        window = [j + t for t in range(run)]
        calm = j + run <= F.size(h)
        for p in window[:-1]:
            calm &= F.get(n, p) + F.get(n, p + 1) < words
        if run == 1:
            return j
        two = F.when((here < words) & (F.get(n, j + 1) < words) & (both >= words), least([j, j + 1]))
        return F.coalesce(F.when(here >= words, j), two, F.when(calm, least(window)))

    def around(at: Column) -> Column:
        return F.struct(at.alias("at"), *[F.array(*[F.get(F.col(c), at + t) for t in range(1 - run, run)]).alias(c) for c in "hin"])

    places = F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - 1), chosen), lambda x: x.isNotNull())
    return F.transform(F.array_distinct(places), around)


def passages(run: int, words: int) -> Column:
    """Of a fingerprint's surroundings h and n the passages that hold it: from, to (beside it), whole."""
    out = []
    for size in sorted({1, 2, run}):
        for first in range(1 - size, 1):
            each = [F.get("h", F.lit(run - 1 + first + t)) for t in range(size)]
            n = sum((F.get("n", F.lit(run - 1 + first + t)) for t in range(size)), F.lit(0))
            full = each[0].isNotNull() & each[-1].isNotNull() & (F.lit(size == run) | (n >= words))
            out.append(F.when(full, F.struct(F.lit(first).alias("from"), F.lit(first + size - 1).alias("to"), F.xxhash64(*each).alias("whole"))))
    return F.array_compact(F.array(*out))


def later_runs(found: DataFrame, run: int, words: int) -> DataFrame:
    """Rows (d, key, lines): the later repeats around each fingerprint, extended to both sides."""
    marks = found.select("d", "key", F.explode(fingerprints(run, words)).alias("f")).select("d", "key", "f.*").withColumn("mark", F.get("h", F.lit(run - 1)))
    often = cut(marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    spread = cut(semi(marks, often, "mark").select("d", "key", "at", "i", F.explode(passages(run, words)).alias("w")).select("d", "key", "at", "i", "w.*"))
    place = F.struct("d", "key", (F.col("at") + F.col("from")).alias("at"))
    # Rows of one document count once: a passage at one place only doesn't repeat.
    first = spread.groupBy("whole").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("whole", "first")
    later = spread.join(small(cut(first)), "whole").where(place != F.col("first"))
    runs = later.groupBy("d", "key", "at").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.first("i").alias("i"))
    return runs.select("d", "key", F.slice("i", F.col("from") + run, F.col("to") - F.col("from") + 1).alias("lines"))


def own_repeats(found: DataFrame) -> DataFrame:
    """Rows (d, key, lines): lines that stand earlier in their own document."""
    own = found.where(F.size(F.array_distinct("h")) < F.size("h")).select("d", "key", F.explode(F.arrays_zip("h", "i")).alias("x"))
    places = own.groupBy("d", "key", "x.h").agg(F.array_sort(F.collect_set("x.i")).alias("i")).where(F.size("i") > 1)
    return places.select("d", "key", F.slice("i", 2, F.size("i")))


def remove_repeated_lines(documents: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), words: int | None = PASSAGE_WORDS) -> DataFrame:
    """Rows (doc_id, text, n_lines, n_removed, kept_text, and the columns to carry), one for each row of documents.

    Lines are separated by newlines; those without a word are never removed and don't interrupt a
    run. A line goes if it lies in `run` consecutive lines, or in one or two lines that hold `words`
    words, that also begin earlier, by (doc_id, place) with a null doc_id last; and if it stands
    earlier in its own document. With words=None only `run` lines count. Rows with equal doc_id and
    text are one document, so neither loses its lines to the other; rows with equal doc_id and
    different texts are ordered by the texts' hash. Null and empty texts have no lines and stay as
    they are. Texts of any length are read whole. Columns not named are ignored.
    """
    docs = documents.select(plain(doc_id).alias("doc_id"), plain(text).alias("text"), F.struct(F.lit(0), *map(plain, carry)).alias("carried")).withColumn("key", F.xxhash64("text"))
    found = worded(docs)
    later = later_runs(found, run, LAST >> 32 if words is None else words)
    if words is not None:
        later = later.union(own_repeats(found))
    gone = cut(later.groupBy("d", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone")))

    all_lines = docs.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("key", F.coalesce("key", F.lit(0)))
    keys = gone.select("key").distinct()
    hit = semi(all_lines, keys, "key").join(gone, ["d", "key"], "left")
    rest = semi(all_lines, keys, "key", "left_anti").withColumn("gone", F.lit(None).cast("array<int>"))
    n_lines = F.size(F.filter(lines("text"), lambda x: x.rlike(WORD)))
    whole = hit.select("doc_id", "text", "carried", "gone").union(rest.select("doc_id", "text", "carried", "gone"))
    split = F.transform(F.array(lines("text")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))[0]
    return whole.select("doc_id", "text", n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(split).alias("kept_text"), *[F.col("carried")[c].alias(c) for c in carry])


ORACLE_SQL = f"""
with split as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (select distinct doc_id, text, unnest(lines) as line, unnest(range(len(lines))) as i from split),
worded as (select *, row_number() over (partition by doc_id, text order by i) as r, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as n from numbered where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
runs as (select doc_id, text, r, line as a, lead(line, 1) over w as b, lead(line, 2) over w as c, i as i1, lead(i, 1) over w as i2, lead(i, 2) over w as i3, n as n1, lead(n, 1) over w as n2 from worded window w as (partition by doc_id, text order by r)),
passages as (select doc_id, text, r, a, null as b, null as c, [i1] as places from runs where n1 >= {PASSAGE_WORDS}
  union all select doc_id, text, r, a, b, null, [i1, i2] from runs where n1 + n2 >= {PASSAGE_WORDS} union all select doc_id, text, r, a, b, c, [i1, i2, i3] from runs where c is not null),
placed as (select *, first_value(doc_id) over f as d0, first_value(r) over f as r0 from passages window f as (partition by a, b, c order by doc_id, r)),
own as (select doc_id, text, i, row_number() over (partition by doc_id, text, line order by i) as k from worded),
gone as (select distinct doc_id, text, unnest(places) as i from placed where doc_id <> d0 or r <> r0 union select doc_id, text, i from own where k > 1),
kept as (select doc_id, text, count(*) filter (where gone) as n_removed, string_agg(line, chr(10) order by i) filter (where not gone) as kept_text
         from (select n.*, g.i is not null as gone from numbered n left join gone g using (doc_id, text, i)) group by doc_id, text)
select s.doc_id, (select count(*) from (select unnest(s.lines) as l) where regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as n_lines,
       k.n_removed, md5(coalesce(k.kept_text, '')) as kept_md5
from split s join kept k on k.doc_id = s.doc_id and k.text = s.text
"""
