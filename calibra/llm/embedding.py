"""A quality classifier of learned subword vectors.

A text's features are its words and their runs of 3 to 5 characters, the word's ends included, hashed
into BUCKETS. A word that repeats the one before it has a feature in common with all such words, and one
more marks the text's end. The mean of the features' vectors goes through a
softmax over the labels. Vectors and output weights are learned together by stochastic gradient descent
in numpy, from a bounded sample of labelled texts.

As mean and output are linear, a learned feature's vector enters a score only through its products with
the output weights, so scoring reads these (two numbers a bucket) and not the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import held_out
from .runtime import plain
from .words import GRAM_BASE, chunks, mix, utf8

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: Vectors' length, rounds over the sample, and the rate of learning, which falls to 0 in a line.
DIMENSION, ROUNDS, RATE = 8, 12, 2.0
#: Labelled texts learned from, at most, of each label.
SAMPLE = 2000
#: Of a score, from which the prediction is 1.
THRESHOLD = 0.3
#: Bytes of text that are read at once, and characters whose features are.
FEATURE_BYTES, PIECE = 1 << 18, 1 << 18
#: Stand before and after each word; no text has them, as they are no characters.
OPEN, CLOSE = 0x110000, 0x110001


@dataclass
class Model:
    """vectors: (bucket, dimension); output: (dimension, label), bias: (label)."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """The products of the vectors with the output weights, and the bias."""
        return self.vectors @ self.output, self.bias


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, and each text's range of them."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    sums = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return code, sums[offsets]


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of all features of all texts with the text of each, in pieces of whole words and
    about PIECE characters. Every text has one feature at least."""
    code, offsets = characters(*utf8(column))
    inside = (code != 32) & ((code < 9) | (code > 13))
    edge = np.zeros(len(code) + 1, bool)
    edge[offsets] = True
    wide = np.concatenate([[False], inside, [False]])
    start = np.flatnonzero(inside & (~wide[:-2] | edge[:-1]))
    end = np.flatnonzero(inside & (~wide[2:] | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    yield np.full(len(offsets) - 1, bucket_of(np.array([1], np.uint64))[0]), np.arange(len(offsets) - 1)
    sums = np.cumsum(end - start + 2)
    at, last = 0, (np.uint64(0), -1)
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PIECE, "right")))
        found, docs, own = word_features(code, start[at:to], end[at:to], doc[at:to])
        before, same = np.append(last[0], own[:-1]), np.append(last[1], doc[at : to - 1])
        again = doc[at:to][(own == before) & (doc[at:to] == same)]
        yield bucket_of(np.concatenate([*found, own, np.full(len(again), 2, np.uint64)])), np.concatenate([*docs, doc[at:to], again])
        at, last = to, (own[-1], doc[to - 1])


def bucket_of(value: np.ndarray) -> np.ndarray:
    return (mix(value) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(code: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the words' character runs with the text of each, by size; and of the words."""
    length = end - start + 2
    first = np.cumsum(length) - length
    total = int(length.sum())
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(total) - first[word]
    left = length[word] - place
    # Words one after another, each between its marks.
    body = (place > 0) & (left > 1)
    chars = np.where(place == 0, np.uint64(OPEN), np.uint64(CLOSE))
    chars[body] = code[(start[word] + place - 1)[body]]
    found, docs, value = [], [], chars
    for size in range(2, max(SIZES) + 1):
        value = value[:-1] * np.uint64(GRAM_BASE) + chars[size - 1 :]
        if size in SIZES:
            at = np.flatnonzero(left[: len(value)] >= size)
            found.append(value[at] + np.uint64(size))
            docs.append(doc[word[at]])
    return found, docs, np.add.reduceat((chars + np.uint64(1)) * (mix(place.astype(np.uint64)) | np.uint64(1)), first)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, quality, buckets, share) for each text: its distinct buckets, and each one's share of
    the text's features."""
    for batch in batches:
        for c in chunks(batch, size=FEATURE_BYTES):
            pieces = [np.unique(doc * BUCKETS + bucket, return_counts=True) for bucket, doc in features(c.column("text"))]
            cell, of = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
            n = np.bincount(of, np.concatenate([p[1] for p in pieces]))
            doc = cell // BUCKETS
            share = n / np.bincount(doc, n, c.num_rows)[doc]
            bounds = pa.array(np.searchsorted(cell, np.arange(c.num_rows + 1) * BUCKETS).astype(np.int32))
            buckets = pa.ListArray.from_arrays(bounds, pa.array((cell % BUCKETS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([c.column("key"), c.column("quality"), buckets, pa.ListArray.from_arrays(bounds, pa.array(share.astype(np.float32)))], ["key", "quality", "buckets", "share"])


def chosen(documents: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts (key, quality, text), for each label the `sample` ids of least hash of the id,
    and how many ids have each label.

    Only ids are compared until the sample is known; an id of several rows gives its least text, and of
    several labels the greatest.
    """
    ids = documents.where("not held_out and doc_id is not null").select("doc_id").distinct()
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    told = known.join(ids, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    sizes = {r["quality"]: r["n"] for r in told.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("quality") == q, F.lit(min(1.0, (1.2 * sample + 100) / n))) for q, n in sizes.items()], F.lit(1.0))
    near = told.where(F.col("h") / F.lit(2.0**64) + 0.5 <= share)
    picked = near.withColumn("r", F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))).where(F.col("r") <= sample)
    texts = documents.where("not held_out").join(F.broadcast(picked.select("doc_id", "quality", "h")), "doc_id")
    return texts.groupBy(F.col("h").alias("key"), "doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), sizes


def train(buckets: list[np.ndarray], share: list[np.ndarray], quality: np.ndarray, weight: np.ndarray, seed: int = 1) -> Model:
    """Stochastic gradient descent on the weighted cross-entropy, one text at a time in an order drawn
    anew each round."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    output, bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
    steps, done = ROUNDS * len(buckets), 0
    for _ in range(ROUNDS):
        for i in rng.permutation(len(buckets)):
            rate, done = RATE * weight[i] * (1 - done / steps), done + 1
            rows, x = buckets[i], share[i]
            mean = x @ vectors[rows]
            error = softmax(mean @ output + bias)
            error[quality[i]] -= 1
            back = output @ error
            output -= (rate * 0.1) * np.outer(mean, error)
            bias -= (rate * 0.01) * error
            # The mean's own gradient is x * back; steps of the share's root reach rare features too.
            vectors[rows] -= rate * np.sqrt(x)[:, None] * back
    return Model(vectors, output, bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of documents (doc_id, held_out, text) and labels (doc_id, quality). What reaches the
    driver is bounded by the sample: of each text its buckets, of which there are BUCKETS at most. A
    label of which the sample holds a part only weighs as its ids do among all labelled ones."""
    texts, sizes = chosen(documents, labels, sample)
    rows = texts.select("key", "quality", "text").mapInArrow(feature_rows, "key long, quality int, buckets array<int>, share array<float>").toArrow()
    rows = rows.sort_by([("key", "ascending"), ("quality", "ascending")])
    quality = rows.column("quality").to_numpy()
    lists = [rows.column(k).combine_chunks() if len(rows) else [] for k in ("buckets", "share")]
    held = [[x[i].values.to_numpy() for i in range(len(rows))] for x in lists]
    have = np.bincount(quality, minlength=2) if len(rows) else np.zeros(2)
    weight = np.array([sizes.get(q, 0) / max(have[q], 1) for q in (0, 1)])[quality] if len(rows) else np.zeros(0)
    return train(*held, quality, weight / weight.mean() if len(rows) else weight)


def score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            for c in chunks(batch, size=FEATURE_BYTES):
                n, sums = np.zeros((c.num_rows, 1)), np.zeros((c.num_rows, 2))
                for bucket, doc in features(c.column("text")):
                    n[:, 0] += np.bincount(doc, minlength=c.num_rows)
                    for k in range(2):
                        sums[:, k] += np.bincount(doc, table[bucket, k], c.num_rows)
                p = softmax(sums / n + bias)[:, 1]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(documents: DataFrame, labels: DataFrame, model: Model | None = None, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of documents; score: the probability
    of label 1.

    Learned from labelled rows that are not held out, `sample` of each label at most; labels and doc_id
    are no inputs of a score. Null texts are empty; an empty text has the feature of its end alone.
    Texts of any length are read whole, repeated rows one by one. Rows with a null id are scored, not
    learned from; labels other than 0 and 1 are ignored. Without labels all scores are 0.5. Other
    columns are ignored.
    """
    docs = documents.select(plain(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), plain(text).alias("text"))
    model = model or learn(docs, labels.select(plain(doc_id).alias("doc_id"), plain(quality).alias("quality")), sample)
    shared = documents.sparkSession.sparkContext.broadcast(model.read())
    return docs.mapInArrow(score_rows(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
