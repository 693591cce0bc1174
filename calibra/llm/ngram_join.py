"""N-gram Jaccard join by rare-first prefix filtering.

Documents with equal shingle sets form one class, so copies never meet each other. Shingles are
ordered rare first (by a sketch of their counts over all documents, then by hash); two sets of
similarity t or more share a shingle among the first n - ceil(t n) + 1 of each. Documents are joined
on those prefix shingles, filtered by length, position and suffix, and each pair is verified once on
the exact sets.

A prefix shingle of many classes doesn't emit its pairs: all its classes are compared with one of
them, its pivot, the class that has the least before the shingle, which is the one its near copies
differ least from. The verified links are joined to components; for ROUNDS rounds each shingle that
still holds several components takes another pivot; last, classes that are still in different
components meet, in blocks, if length and position allow. A pair within a component can't change any
component, so components are those of all links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import components, cut, plain, semi, small, small_batches
from .words import chunks, mix, shingles, words

#: Buckets of the sketch of shingle counts: one byte each when broadcast, whatever the input.
SKETCH_BITS = 24
SKETCH_PARTS = 256
#: Buckets that a task counts before it hands its counts on.
COUNTED = 1 << 19
#: Text that a task works on at once.
TEXT_BYTES = 1 << 18
ROUNDS = 1
#: Classes of one shingle that meet in one block, about.
BLOCK = 4000
BITMAP_LONGS = 8
#: Similarity NUM / DEN.
NUM, DEN = 4, 5
WORDS = 5


def class_hashes(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of 64 bits for each set, from its elements and their number."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value), out=sums[1:])
    n = np.diff(first).astype(np.uint64)
    return mix(sums[first[1:]] - sums[first[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bitmaps(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """BITMAP_LONGS x 64 bits for each set: the parity of its elements by hash."""
    out = []
    for k in range(BITMAP_LONGS):
        own = (value >> np.uint64(6)) % np.uint64(BITMAP_LONGS) == np.uint64(k)
        bits = np.append(np.bitwise_xor.accumulate(np.where(own, np.uint64(1) << (value & np.uint64(63)), np.uint64(0))), np.uint64(0))
        at = lambda i: np.where(i > 0, bits[i - 1], np.uint64(0))  # noqa: E731, B023
        out.append((at(first[1:]) ^ at(first[:-1])).view(np.int64))
    return out


SIGS = [f"s{k}" for k in range(BITMAP_LONGS)]
FIRST_SCHEMA = "doc_id long, key long, n long, cls long, " + ", ".join(f"{s} long" for s in SIGS) + ", part int, counts binary"
FIRST_NAMES = ["doc_id", "key", "n", "cls", *SIGS, "part", "counts"]


def packed_counts(at: np.ndarray, n: np.ndarray) -> bytes:
    """Counts of a sketch part's buckets that are not 0; at: the buckets within the part."""
    return zlib.compress(n.astype("<u4").tobytes() + at.astype("<u2").tobytes(), 1)


def sketch_rows(bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (part, counts) of distinct buckets, ascending, and their counts."""
    width = (1 << SKETCH_BITS) // SKETCH_PARTS
    bounds = np.searchsorted(bucket, np.arange(SKETCH_PARTS + 1) * width).tolist()
    parts = [packed_counts(bucket[a:b] % width, n[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    none = pa.nulls(SKETCH_PARTS, pa.int64())
    return pa.RecordBatch.from_arrays([none] * (4 + BITMAP_LONGS) + [pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(parts, pa.binary())], FIRST_NAMES)


def sizes_and_sketch(k: int):
    """Rows (doc_id, key, n, cls, s0, ...) for documents, and between them and at the end of a partition the
    counts of its shingles by bucket, as rows (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, n, held, waiting = np.zeros(0, np.uint32), np.zeros(0, np.uint32), [], 0

        def add() -> None:
            nonlocal bucket, n, held, waiting
            new, of = np.unique(np.concatenate([bucket, *held]), return_counts=True)
            of = of.astype(np.uint32)
            of[np.searchsorted(new, bucket)] += n - np.uint32(1)
            bucket, n, held, waiting = new, of, [], 0

        for batch in batches:
            for c in chunks(batch, size=TEXT_BYTES):
                value, first = shingles(words(c.column("text"), lower=True), k)
                held.append((value >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                waiting += len(value)
                part, counts = pa.nulls(c.num_rows, pa.int32()), pa.nulls(c.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("key"), pa.array(np.diff(first), pa.int64()), pa.array(class_hashes(value, first)), *map(pa.array, bitmaps(value, first)), part, counts], FIRST_NAMES)
                if waiting >= COUNTED // 4:
                    add()
                if len(bucket) >= COUNTED:
                    yield sketch_rows(bucket, n)
                    bucket, n = bucket[:0], n[:0]
        add()
        if len(bucket):
            yield sketch_rows(bucket, n)

    return run


def summed(rows: pa.Table) -> np.ndarray:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint32)
    for x in rows.column("counts"):
        both = zlib.decompress(x.as_py())
        of = len(both) // 6
        total[np.frombuffer(both, "<u2", of, 4 * of)] += np.frombuffer(both, "<u4", of)
    return total


def add_counts(rows: pa.Table) -> pa.Table:
    total = summed(rows)
    at = np.flatnonzero(total)
    return pa.table({"part": rows.column("part")[:1], "counts": pa.array([packed_counts(at, total[at])], pa.binary())})


def levels(rows: pa.Table) -> pa.Table:
    level = np.minimum(255, 4 * np.log2(summed(rows) + 1.0)).astype(np.uint8)
    return pa.table({"part": rows.column("part")[:1], "counts": pa.array([level.tobytes()], pa.binary())})


def rarity(parts: DataFrame) -> np.ndarray:
    """For each bucket of the sketch, 4 log2(count + 1): the only thing that reaches the driver, of
    fixed size. Partitions' counts are added in groups before they meet, as many as each holds."""
    salts = max(8, math.isqrt(parts.where("part = 0").count()))
    some = parts.withColumn("salt", F.spark_partition_id() % salts).groupBy("part", "salt").applyInArrow(add_counts, "part int, counts binary")
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for r in some.groupBy("part").applyInArrow(levels, "part int, counts binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return out.ravel()


def prefix_rows(k: int, rare):
    """Rows (gram, cls, place): each class's prefix shingles, once in a partition. place: the set's
    size and the shingle's position, of 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = rare.value, set()
        for batch in batches:
            for c in chunks(batch, size=TEXT_BYTES):
                value, first = shingles(words(c.column("text"), lower=True), k)
                cls = class_hashes(value, first)
                n = np.diff(first)
                key = (level[value >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56)) | (value >> np.uint64(8))
                take = n - (NUM * n + DEN - 1) // DEN + 1
                grams, rows = [], []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b > a and (x := int(cls[i])) not in seen:
                        seen.add(x)
                        own = key[a:b]
                        own.sort()
                        grams.append(own[: take[i]])
                        rows.append(i)
                if rows:
                    i = np.array(rows)
                    each = np.repeat(np.arange(len(i)), take[i])
                    pos = np.arange(len(each)) - np.repeat(np.cumsum(take[i]) - take[i], take[i])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(grams).view(np.int64), cls[i][each], (n[i][each] << 32) | pos)], ["gram", "cls", "place"])

    return run


def set_rows(k: int):
    """Rows (cls, elements): the exact shingle set of each document, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, size=TEXT_BYTES):
                value, first = shingles(words(c.column("text"), lower=True), k)
                sets = [value[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(class_hashes(value, first)), pa.array(sets, pa.binary())], ["cls", "elements"])

    return run


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, elements_a, elements_b), the pairs (a, b) whose exact similarity suffices."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("elements_a"), batch.column("elements_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: The least number of shingles that sets of sizes x.n and y.n must share.
NEED = f"(({NUM} * (x.n + y.n) + {NUM + DEN - 1}) div {NUM + DEN})"
#: Filters of prefix rows x and y that lose no link.
LENGTH = f"{DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n)"
POSITION = f"least(x.n - x.pos, y.n - y.pos) >= {NEED}"
#: The bitmaps differ in no more places than the sets have unshared shingles.
SUFFIX = " + ".join(f"bit_count(x.{s} ^ y.{s})" for s in SIGS) + f" <= x.n + y.n - 2 * {NEED}"


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id, key, component), one for each row of documents.

    Two documents link when the Jaccard similarity of their sets of k-word shingles is at least
    NUM / DEN; component_id is the least doc_id reachable by links, class_id the least doc_id with
    the same set. key is the text's hash; component, one number for each component, tells components
    apart where ids are null or repeated (null for empty sets). A text of 1 to k - 1 words is one
    shingle; null, empty and all-space texts have an empty set, link with nothing and are their own
    component. A null doc_id takes part, but names a component only if nothing else can. Repeated
    rows are returned as often as given. Texts of any length are read whole. Other columns are
    ignored.
    """
    with small_batches(documents.sparkSession):
        return _near_duplicates(documents, doc_id, text, k)


def _near_duplicates(documents: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """near_duplicates; all that needs Python is computed and cut before it returns."""
    spark = documents.sparkSession
    docs = documents.select(plain(doc_id).cast("long").alias("doc_id"), plain(text).alias("text")).withColumn("key", F.xxhash64("text"))
    first = cut(docs.mapInArrow(sizes_and_sketch(k), FIRST_SCHEMA))
    rare = spark.sparkContext.broadcast(rarity(first.where("part is not null").select("part", "counts")))
    sizes = first.where("part is null").select("doc_id", "key", "n", "cls", *SIGS)
    # Of equal sets the text of least hash stands for all where sets are compared.
    classes = sizes.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min("key").alias("key"), F.min("n").alias("n"), *[F.min(s).alias(s) for s in SIGS])

    # Shingles of one class go.
    grams = docs.mapInArrow(prefix_rows(k, rare), "gram long, cls long, place long")
    shared = grams.groupBy("gram").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("gram")
    members = grams.join(shared, "gram").groupBy("gram", "cls").agg(F.min("place").alias("place"))
    members = cut(members.select("gram", "cls", F.expr("shiftright(place, 32)").alias("n"), F.expr("place & 4294967295").alias("pos")))
    central = F.min(F.struct(F.col("pos") / F.col("n"), "n", "cls", "pos"))
    labels, links, tried = None, None, None
    for turn in range(ROUNDS + 2):
        if turn == 0:
            pivots = members.groupBy("gram").agg(central.alias("p")).select("gram", "p.cls", "p.n", "p.pos", F.lit(None).cast("long").alias("root"))
            rest = members.withColumn("root", F.lit(None).cast("long"))
        else:
            # A shingle's pivot has met all its other classes, so it leaves; most shingles have no two components left.
            met = pivots.select("gram", "cls")
            named = members.join(met, ["gram", "cls"], "left_anti").join(small(labels.withColumnRenamed("node", "cls")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
            split = named.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("of"), central.alias("p"), F.min_by("root", F.struct(F.col("pos") / F.col("n"), "n", "cls", "pos")).alias("root"))
            split = split.where("r0 <> r1").select("gram", "of", "p.cls", "p.n", "p.pos", "root")
            named = cut(named.join(split.select("gram", "of"), "gram"))
            if named.isEmpty():
                break
            members, pivots, rest = named.select("gram", "cls", "n", "pos"), split, named
        apart = F.col("x.cls") != F.col("y.cls")
        if turn:
            apart &= F.col("x.root") != F.col("y.root")
        on = F.col("x.gram") == F.col("y.gram")
        if turn > ROUNDS:
            # All that are left meet once, a block of a shingle's classes with each other block.
            blocks = F.ceil(F.col("of") / BLOCK)
            x = rest.withColumn("block", F.pmod("cls", blocks))
            y = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            on, apart = on & (F.col("x.block") == F.col("y.block")), apart & (F.col("x.cls") < F.col("y.cls"))
        else:
            x, y = pivots, rest
        pairs = x.alias("x").join(y.alias("y"), on & apart & F.expr(LENGTH) & F.expr(POSITION))
        pairs = pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        pairs = cut(suffix_filtered(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), classes))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        found = cut(verify(docs, pairs, k))
        if links is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)

    info = classes.select("cls", "least_id").join(small(labels.withColumnRenamed("node", "cls")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = info.groupBy("root").agg(F.min("least_id").alias("component_id"))
    info = info.join(least, "root").select("cls", "least_id", "component_id", F.col("root").alias("component"))
    known = sizes.where("n > 0").join(info, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("least_id").alias("class_id"), "key", "component")
    return known.union(sizes.where("n = 0").select("doc_id", "n", "doc_id", "doc_id", "key", F.lit(None).cast("long")))


def suffix_filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow them, with the texts that stand for them (key_a, key_b)."""
    x, y = (classes.select(F.col("cls").alias(c), F.col("key").alias(f"key_{c}"), F.struct("n", *SIGS).alias(v)) for c, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(SUFFIX).select("a", "b", "key_a", "key_b")


def verify(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The linked ones of pairs (a, b) of classes, by the exact sets of one text of each class."""
    wanted = cut(pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct())
    texts = semi(docs.select("key", "text"), wanted, "key")
    sets = texts.mapInArrow(set_rows(k), "cls long, elements binary").dropDuplicates(["cls"])
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("elements_b")), "b").join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("elements_a")), "a")
    return both.select("a", "b", "elements_a", "elements_b").mapInArrow(verified, "a long, b long")
