"""Importance resampling of documents towards a target distribution of hashed n-grams.

The documents' counts of feature buckets are one sparse matrix, a row for each document and a column
for each bucket. It is written once to the shared folder as blocks in compressed-sparse-row form. Its
column sums are the corpus' distribution; the target's come from a matrix of its own. The product of
the matrix with the buckets' gains is the documents' weights, and Gumbel noise drawn from a hash of the
id makes the highest scores a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, plain, shared_folder
from .words import chunks, lower_ascii, utf8

BUCKETS = 10_000
#: Features are runs of 1 to GRAMS words.
GRAMS = 3
SEED = 42
#: Documents of fewer words are not drawn; of the others DRAWN in a hundred are.
LEAST_WORDS, DRAWN = 20, 5
#: Words of up to so many bytes are hashed together, longer ones one by one.
SHORT = 64
#: Text of a block of the matrix, and bytes of a group of blocks in its files.
BLOCK_BYTES, GROUP_BYTES = 1 << 18, 1 << 22
#: Scores are counted in so many intervals, to sort only those that may be drawn.
INTERVALS = 1 << 14


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """step: byte -> its CRC-32 remainder; shift: (n, k, byte) -> byte k of a CRC moved on by n zero
    bytes, for n of up to SHORT + 1."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    shift = np.zeros((SHORT + 2, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHORT + 2):
        shift[n] = step[shift[n - 1] & np.uint32(255)] ^ (shift[n - 1] >> np.uint32(8))
    return step, shift


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words of lower-cased texts, and each text's range of words. A word is a run of
    digits, a to z and characters beyond ASCII."""
    kind = np.zeros(256, bool)
    kind[48:58] = kind[97:123] = kind[128:] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each length of 1 to GRAMS words, the words from which a run of it lies within a text, and the
    CRC-32 of each run's words, joined by one space."""
    step, shift = crc_tables()
    length = end - start
    order = np.argsort(length, kind="stable")
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    spaced = np.full(len(start), step[(0xFFFFFFFF ^ 32) & 255] ^ np.uint32(0xFFFFFFFF >> 8), np.uint32)
    ranked = length[order]
    for j in range(min(SHORT, int(ranked[-1]) if len(ranked) else 0)):
        of = order[np.searchsorted(ranked, j, "right") :]
        byte = data[start[of] + j]
        for s in (state, spaced):
            s[of] = step[(s[of] ^ byte) & np.uint32(255)] ^ (s[of] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    spaced ^= np.uint32(0xFFFFFFFF)
    long = np.flatnonzero(length > SHORT)
    for i in long.tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]])
    out = [(np.arange(len(start)), state)]
    lengths = np.diff(first)
    for n in range(2, GRAMS + 1):
        count = np.maximum(lengths - n + 1, 0)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
        before, last = out[-1], at + n - 1
        value = before[1][np.searchsorted(before[0], at)]
        moved = np.minimum(length[last], SHORT) + 1
        joined = spaced[last]
        for k in range(4):
            joined = joined ^ shift[moved, k, (value >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(length[last] > SHORT).tolist():
            w = last[i]
            joined[i] = zlib.crc32(data[start[w] : end[w]], zlib.crc32(b" ", int(value[i])))
        out.append((at, joined))
    return out


def block(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' rows of the matrix: n_words, n_features, and indptr, indices (ascending within a
    row) and counts."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    start, end, first = word_ranges(data, offsets)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    runs = crcs(data, start, end, first)
    cell = np.concatenate([doc[at] * BUCKETS + value % np.uint32(BUCKETS) for at, value in runs])
    cell.sort()
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    cells, counts = cell[new], np.diff(np.append(new, len(cell)))
    indptr = np.searchsorted(cells, np.arange(n + 1) * BUCKETS)
    n_words = np.diff(first)
    return n_words, sum(np.maximum(n_words - k, 0) for k in range(GRAMS)), indptr, cells % BUCKETS, counts


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of about BLOCK_BYTES of text: the block's ids, and its matrix, whose arrays
    are little-endian numbers of 4, 2 and as many bytes as the largest count needs (1 or 4)."""
    for batch in batches:
        for c in chunks(batch, size=BLOCK_BYTES):
            n_words, n_features, indptr, indices, counts = block(c.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array([0, c.num_rows], pa.int32()), x) for x in (c.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()))]
            wide = "<u4" if len(counts) and counts.max() > 255 else "<u1"
            numbers = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((indptr, "<u4"), (indices, "<u2"), (counts, wide))]
            yield pa.RecordBatch.from_arrays([*lists, *numbers], ["doc_id", "n_words", "n_features", "indptr", "indices", "counts"])


def matrix(texts: DataFrame) -> DataFrame:
    """The matrix of rows (doc_id, text), written to the shared folder and read from there."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    path = f"{shared_folder(texts.sparkSession)}/matrix-{uuid.uuid4().hex}"
    found = texts.select("doc_id", "text").mapInArrow(blocks, f"doc_id array<{kind}>, n_words array<long>, n_features array<long>, indptr binary, indices binary, counts binary")
    # Few blocks in a row group, as a reader holds one group's at a time.
    found.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).option("parquet.block.size.row.check.min", 8).parquet(path)
    return texts.sparkSession.read.schema(found.schema).parquet(path)


def cells(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's indices and counts."""
    indices, counts = (b.column(c)[i].as_buffer() for c in ("indices", "counts"))
    return np.frombuffer(indices, "<u2"), np.frombuffer(counts, "<u4" if counts.size > indices.size // 2 else "<u1")


def column_sums(m: DataFrame) -> np.ndarray:
    """How often each bucket occurs: each task adds its blocks up, the tasks' sums are grouped, and one
    row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                total += np.bincount(*cells(b, i), BUCKETS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    out = [0] * BUCKETS
    for r in m.select("indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return np.array(out, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, in thousandths: the logarithm of its smoothed target share over its source share."""
    all_source, all_target = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = ((t + 1.0) * all_source / ((s + 1.0) * all_target) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(m: DataFrame, gain: np.ndarray) -> DataFrame:
    """The product of the matrix with the gains: a row (doc_id, n_words, n_features, weight) for each document."""
    kind = m.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                indices, counts = cells(b, i)
                sums = np.concatenate([[0], np.cumsum(gain[indices] * counts)])
                weight = np.diff(sums[np.frombuffer(b.column("indptr")[i].as_buffer(), "<u4")])
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i].values, b.column("n_words")[i].values, b.column("n_features")[i].values, pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return m.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, share: int = DRAWN) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) with rank: 1, 2, ... by descending score,
    then by doc_id, a null one last, of the `share` in a hundred of documents of LEAST_WORDS words or
    more; null for all others.

    Counts of scores in intervals tell which interval holds the last one drawn; only documents from
    there on are sorted, dealt by ranges of (score, doc_id), and numbered by place and the counts of the
    ranges before. Rows that agree in all this are numbered in any order.
    """
    fit = F.col("n_words") >= LEAST_WORDS
    n, low, high = scored.where(fit).agg(F.count("*"), F.min("score"), F.max("score")).first()
    k = n * share // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    width = (high - low) // INTERVALS + 1
    interval = F.floor((F.col("score") - low) / width)
    counts = sorted(scored.where(fit).groupBy(interval.alias("i")).count().collect(), reverse=True)
    upper, least = 0, low
    for i, c in counts:
        upper += c
        if upper >= k:
            least = low + i * width
            break
    near = fit & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    placed = cut(scored.where(near).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    before, total = [], 0
    for part, c in sorted(placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        before.append((part, total))
        total += c
    offsets = F.broadcast(scored.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", F.shiftright("at", 33)).join(offsets, "part").withColumn("rank", F.when(rank <= k, rank))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, share: int = DRAWN, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank), one for each row of documents.

    Words are lower-cased (A to Z only); features are runs of 1 to GRAMS words of whole texts, counted in
    BUCKETS buckets. Null, empty and wordless texts have no features and a weight of 0. Texts of fewer
    than LEAST_WORDS words are never drawn. Rows of equal score rank by doc_id, a null one last; a null
    id draws its noise as the text '' would. Repeated rows are scored and ranked one by one. An empty
    target weighs by rarity in the corpus; empty documents give no rows. Other columns are ignored.
    """
    m = matrix(documents.select(plain(doc_id).alias("doc_id"), plain(text).alias("text")))
    goal = matrix(target.select(F.lit(0).alias("doc_id"), plain(target_text).alias("text")))
    found = weights(m, gains(column_sums(m), column_sums(goal)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return drawn(cut(found.withColumn("score", F.col("weight") + noise)), share)
