"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts of up to ORDER bytes with escape probabilities (method C,
with exclusion) is learned from a bounded sample of labelled texts and frozen. Every context's full
distribution is laid out in one table, so the exact code length of a text in each language is a sum
of table entries, one for each byte. The language of the shortest code is predicted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import plain
from .words import chunks, utf8

ORDER = 3
#: Labelled texts learned from, at most, for each language.
SAMPLE = 1000
#: A context of the greatest order gets a node if it occurs so often in the sample.
LEAST = 4
#: The code lengths of so many bytes, at most, enter the score.
SCORED_BYTES = 32
UNDETERMINED = "und"


@dataclass
class Model:
    """langs; symbol: byte -> symbol (0: before a text's start, last: bytes never seen); node: three
    symbols -> row of the deepest context known; bits: (row, symbol, language) -> code length."""

    langs: list[str]
    symbol: np.ndarray
    node: np.ndarray
    bits: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the ORDER before it and itself, as 256 where they lie before the text's start."""
    wide = data.astype(np.int32)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    before = [np.where(at >= k, np.concatenate([np.full(k, 256, np.int32), wide[:-k]])[: len(wide)], 256) for k in range(ORDER, 0, -1)]
    return (*before, wide)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n): counts of bytes in context, by language, of one partition."""
    for batch in batches:
        for c in chunks(batch):
            langs = np.array(c.column("lang").to_pylist(), object)
            for lang in np.unique(langs):
                data, offsets = utf8(c.column("text").filter(pa.array(langs == lang)))
                a, b, x, y = (g.astype(np.int64) for g in grams(data, offsets))
                code, n = np.unique(((a * 257 + b) * 257 + x) * 257 + y, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "gram", "n"])


def blend(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """PPM-C with exclusion: seen symbols share total / (total + distinct); the escape share goes to
    the unseen ones in proportion to the shorter context's probabilities."""
    counts = counts.astype(np.float64)
    seen = counts > 0
    total, distinct = counts.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    rest = np.where(seen, 0, lower)
    mass = rest.sum(-1, keepdims=True)
    escape = np.where(mass > 0, distinct, 0)
    return np.where(total > 0, counts / np.maximum(total + escape, 1) + np.where(total > 0, escape / np.maximum(total + escape, 1), 1) * rest / np.where(mass > 0, mass, 1), lower)


def compile_model(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Lays the trees out. lang: index of each row's language."""
    parts = [gram // 257**3, gram // 257**2 % 257, gram // 257 % 257, gram % 257]
    known = np.unique(np.concatenate(parts))
    known = known[known < 256]
    size = len(known) + 2
    symbol = np.full(257, size - 1)
    symbol[known], symbol[256] = np.arange(1, len(known) + 1), 0
    a, b, c, y = (symbol[p] for p in parts)
    unseen = max(1, 256 - len(known))

    top, rank = np.unique((a * size + b) * size + c, return_inverse=True)
    heavy = np.bincount(rank, n, len(top)) >= LEAST
    top = top[heavy]
    seen2 = np.unique(b * size + c)
    rows = 1 + size + len(seen2) + len(top)
    bits = np.zeros((rows, size, len(langs)), np.float32)
    for k in range(len(langs)):
        own = lang == k
        ak, bk, ck, yk, nk = a[own], b[own], c[own], y[own], n[own]
        ground = np.full(size, 1 / 256.0)
        ground[0], ground[-1] = 0, unseen / 256.0
        p0 = blend(np.bincount(yk, nk, size), ground / ground.sum())
        c1 = np.bincount(ck * size + yk, nk, size * size).reshape(size, size)
        p1 = blend(c1, np.broadcast_to(p0, c1.shape))
        at2 = np.searchsorted(seen2, bk * size + ck)
        c2 = np.bincount(at2 * size + yk, nk, len(seen2) * size).reshape(-1, size)
        p2 = blend(c2, p1[seen2 % size])
        ctx = (ak * size + bk) * size + ck
        at3 = np.minimum(np.searchsorted(top, ctx), max(0, len(top) - 1))
        hit = top[at3] == ctx if len(top) else np.zeros(len(ctx), bool)
        c3 = np.bincount(at3[hit] * size + yk[hit], nk[hit], len(top) * size).reshape(-1, size)
        p3 = blend(c3, p2[np.searchsorted(seen2, top % (size * size))])
        p = np.concatenate([p0[None], p1, p2, p3])
        p[:, -1] /= unseen
        bits[:, :, k] = -np.log2(np.maximum(p, 1e-12))
    node = np.zeros((size, size, size), np.int32)
    node[:] = 1 + np.arange(size)
    node[:, seen2 // size, seen2 % size] = 1 + size + np.arange(len(seen2))
    node.reshape(-1)[top] = 1 + size + len(seen2) + np.arange(len(top))
    return Model(langs, symbol.astype(np.uint8), node, bits)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of rows (doc_id, text, lang): for each language the `sample` texts of least hash of
    doc_id, whole. What reaches the driver is bounded by the sample, not by the table."""
    rows = labelled.where("text is not null and lang is not null").withColumn("h", F.xxhash64("doc_id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("of"))
    near = rows.join(F.broadcast(sizes), "lang").where("h / 18446744073709551616D + 0.5D <= (1.2D * {0} + 100D) / of".format(sample))
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= sample)
    found = chosen.select("text", "lang").mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    index = found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    return compile_model(langs, index, found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language; 0 for empty texts."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        a, b, c, y = (model.symbol[g] for g in grams(data, offsets))
        size = len(model.node)
        row = model.node.reshape(-1)[(a.astype(np.int32) * size + b) * size + c]
        cost = model.bits.reshape(-1, len(model.langs))[row.astype(np.int64) * size + y]
        out[full] = np.add.reduceat(cost, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


def predict(shared):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**shared.value)
        ascii_letter = np.zeros(256, np.int64)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = 1
        names = np.array([*model.langs, UNDETERMINED], object)
        for column in columns:
            found, scores = [], []
            for c in chunks(pa.RecordBatch.from_arrays([column], ["text"]), size=1 << 17):
                data, offsets = utf8(c.column("text"))
                bits = code_lengths(model, data, offsets)
                sums = np.concatenate([[0], np.cumsum(ascii_letter[data])])
                letters = sums[offsets[1:]] > sums[offsets[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                    letters[i] = any(map(str.isalpha, c.column("text")[int(i)].as_py()))
                n = np.maximum(np.diff(offsets), 1)[:, None]
                nats = -(bits - bits.min(1, keepdims=True)) / n * np.minimum(n, SCORED_BYTES) * np.log(2)
                share = np.exp(nats) / np.exp(nats).sum(1, keepdims=True)
                found.append(np.where(letters, bits.argmin(1), len(model.langs)))
                scores.append(np.where(letters, share.max(1), 0.0))
            best, score = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((found, np.int64), (scores, float)))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id", remainder: int = 0):
    """Whether crc32 of the id as text leaves this remainder by 5; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(plain(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == remainder


def in_fold(doc_id: int | None, remainder: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == remainder


def identify(documents: DataFrame, model: Model | None = None, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, and the columns to carry), one for each row of documents.

    Learned from rows that are not held out and have a text and a language, `sample` of each
    language at most; lang and doc_id are no inputs of a prediction. Null, empty and letterless
    texts are `und` with score 0. score: the posterior of the language with equal priors, from the
    mean code length carried over min(bytes, SCORED_BYTES) bytes. Without any labelled row all are
    `und`.
    """
    spark = documents.sparkSession
    docs = documents.select(plain(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), plain(text).alias("text"), plain(lang).alias("lang"), F.struct(F.lit(0).alias("_"), *[plain(c).alias(c) for c in carry]).alias("carried"))
    kept = [F.col("carried").getField(c).alias(c) for c in carry]
    model = model or learn(docs.where("not held_out"), sample)
    if not model.langs:
        return docs.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), *kept)
    shared = spark.sparkContext.broadcast(vars(model))
    # Only the text goes to Python, and what is found comes back; a filter on it must not be a second run.
    judge = F.arrow_udf(predict(shared), "struct<lang_pred string, score double>").asNondeterministic()
    found = docs.select("doc_id", "held_out", "carried", judge("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", *kept)
