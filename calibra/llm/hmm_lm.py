"""A hidden Markov language model over words.

All training words are counted. The TOP most frequent are symbols of their own; every other word is
emitted as the class of its spelling (last byte, length, script), then as itself within the class by
its count. Latent states are trained by Baum-Welch: each round's expected counts are summed within a
partition, then across partitions. The rounds start from a chain over spelling classes alone, fitted
to how often each class follows each other in all training texts, a table of fixed size. A text's likelihood is the exact scaled forward recursion over its
symbols times its rare words' shares of their classes, which come by a join on the word's hash: the
vocabulary is never broadcast, only the TOP words and class totals, of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .runtime import cut, plain, small
from .words import Words, chunks, words

TOP = 1 << 16
CLASSES = 1024
STATES = 8
ROUNDS = 3
#: Rounds over the table of class pairs that start the training.
START_ROUNDS = 30
#: Words of a training sequence. Longer texts are trained on in segments, each read with CONTEXT words
#: on both sides, so that only a text's first word counts as a start and every transition counts once.
SEGMENT, CONTEXT = 256, 16
#: Copies of one text beyond which its sums are broadcast, not shuffled to.
CROWD = 1000
#: Words scored side by side.
TOKENS = 1 << 19
#: Weight of the unigram distribution in a state's emissions.
PRIOR = 20.0
PARTS = 64
PAIR = 2048
END = np.uint64(1)  # the end token's hash; words' hashes are 2 or more
SEED = 11


@dataclass
class Model:
    """vocabulary: ascending hashes of TOP words; symbol: their numbers; share: log10 of a rare word's
    denominator by class; start, move, emit: the chain (emit by symbol and state)."""

    vocabulary: np.ndarray
    log_top: np.ndarray
    base_denominator: float
    train_tokens: int
    class_log: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def spelled(column) -> tuple[Words, np.ndarray, np.ndarray]:
    """Lower-cased words of texts, their hashes, and their classes."""
    w = words(column, lower=True)
    h = np.maximum(w.hashes(), np.uint64(2))
    last = w.data[w.end - 1].astype(np.int64)
    wide = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data > 127, out=wide[1:])
    return w, h, last + 256 * (w.end - w.start > 6) + 512 * (wide[w.end] > wide[w.start])


def with_ends(w: Words, value: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """value of each word, and `end` after each text's; bounds of texts in it."""
    bounds = w.first + np.arange(len(w.first))
    out = np.full(len(value) + len(w.first) - 1, end, value.dtype)
    out[np.arange(len(value)) + w.doc] = value
    return out, bounds


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, word, class, n): counts of words with their classes, and, with pair set, of class
    pairs (word: PAIR times the class before, plus the class; CLASSES is the end, CLASSES + 1 the start)."""
    for batch in batches:
        for c in chunks(batch, size=2 << 20):
            w, h, kind = spelled(c.column("text"))
            value, at, n = np.unique(h, return_index=True, return_counts=True)
            row, bounds = with_ends(w, kind, CLASSES)
            before = np.append(CLASSES + 1, row[:-1])
            before[bounds[:-1]] = CLASSES + 1
            pair, m = np.unique(before * PAIR + row, return_counts=True)
            word = np.concatenate([value.view(np.int64), END.view(np.int64)[None], pair])
            kinds = np.concatenate([kind[at], [0], np.zeros(len(pair), np.int64)]).astype(np.int32)
            is_pair = np.arange(len(word)) > len(value)
            yield pa.RecordBatch.from_arrays([pa.array(is_pair), pa.array(word), pa.array(kinds), pa.array(np.concatenate([n, [c.num_rows], m]).astype(np.int64))], ["pair", "word", "class", "n"])


def look_up(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's place in the ascending table, and whether it is there."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def symbols(vocabulary: np.ndarray, column) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray]:
    """Symbols of each text's words and end, texts' bounds, the words, their hashes, which are rare."""
    w, h, kind = spelled(column)
    at, known = look_up(vocabulary, h)
    symbol = np.where(known, at, len(vocabulary) + 1 + kind).astype(np.int32)
    all_symbols, bounds = with_ends(w, symbol, len(vocabulary))
    return all_symbols, bounds, w, h, ~known


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, sequence: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence: the scaled forward recursion, all sequences side by side,
    longest first, so that those still running are a prefix."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, size = bounds[:-1][order], lengths[order]
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    total = np.zeros(len(size))
    state = np.empty((len(size), len(start)))
    for t, n in enumerate(running.tolist()):
        now = (np.broadcast_to(start, (n, len(start))) if t == 0 else state[:n] @ move) * emit[sequence[begin[:n] + t]]
        scale = now.sum(1)
        state[:n] = now / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.zeros(len(size))
    out[order] = total
    return out


def segments(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: where its reading begins and for how many symbols, its own part in that (from,
    to), and whether it begins a text; longest first."""
    lengths = np.diff(bounds)
    count = np.maximum(1, -(-lengths // SEGMENT))
    text = np.repeat(np.arange(len(lengths)), count)
    own = bounds[:-1][text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    begin, stop = np.maximum(own - CONTEXT, bounds[:-1][text]), np.minimum(own + SEGMENT, bounds[1:][text])
    size = np.minimum(stop + CONTEXT, bounds[1:][text]) - begin
    order = np.argsort(-size, kind="stable")
    return tuple(x[order] for x in (begin, size, own - begin, stop - begin, begin == bounds[:-1][text]))


def expect(start, move, emit, sequence: np.ndarray, bounds: np.ndarray):
    """Expected counts of starts, moves and emissions over segments of the sequences."""
    begin, size, low, high, first = segments(bounds)
    states = len(start)
    still = np.linalg.matrix_power(move, 64)[0]
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    ahead, scales = [], []
    for t, n in enumerate(running.tolist()):
        now = (np.where(first[:, None], start, still) if t == 0 else ahead[-1][:n] @ move) * emit[sequence[begin[:n] + t]]
        scales.append(now.sum(1))
        ahead.append(now / scales[-1][:, None])
    moves, gamma = np.zeros((states, states)), np.zeros((len(sequence), states), np.float32)
    back = np.ones((len(size), states))
    for t in range(len(ahead) - 1, -1, -1):
        n = len(ahead[t])
        own = (low[:n] <= t) & (t < high[:n])
        post = ahead[t] * back[:n]
        gamma[begin[:n][own] + t] = (post / post.sum(1, keepdims=True))[own]
        if t:
            incoming = emit[sequence[begin[:n] + t]] * back[:n] / scales[t][:, None]
            moves += (ahead[t - 1][:n].T @ (incoming * own[:, None])) * move
            back[:n] = incoming @ move.T
    emitted = np.stack([np.bincount(sequence, gamma[:, s], len(emit)) for s in range(states)], 1)
    return gamma[bounds[:-1]].sum(0, dtype=np.float64), moves, emitted


def settle(counts, unigram: np.ndarray):
    """Probabilities of expected counts, smoothed; emissions towards the unigram distribution."""
    starts, moves, emitted = counts
    start = (starts + 1) / (starts + 1).sum()
    move = (moves + 0.5) / (moves + 0.5).sum(1, keepdims=True)
    emit = (emitted + PRIOR * unigram[:, None]) / (emitted.sum(0) + PRIOR)
    return start, move, emit


def pack_counts(counts) -> list[bytes]:
    return [np.asarray(p, "<f4").tobytes() for p in np.array_split(np.concatenate([np.ravel(x) for x in counts]), PARTS)]


def add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<f8") for x in rows.column("sums"))
    return pa.table({"part": rows.column("part")[:1], "sums": pa.array([np.asarray(total, "<f8").tobytes()], pa.binary())})


def widen(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<f4").astype("<f8") for x in rows.column("sums"))
    return pa.table({"part": rows.column("part")[:1], "sums": pa.array([np.asarray(total, "<f8").tobytes()], pa.binary())})


def coded(vocabulary):
    """Rows (doc_id, key, held_out, symbols, rare): each text's symbols, 32 bits each, and its rare words
    with their numbers, so that texts are taken apart once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                sequence, bounds, w, h, rare = symbols(vocabulary.value, c.column("text"))
                h, doc = h[rare], w.doc[rare]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(h))).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(tf)], ["word", "tf"])
                at = np.searchsorted(doc[new], np.arange(c.num_rows + 1)).astype(np.int32)
                data = pa.py_buffer(sequence.astype("<i4").tobytes())
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), c.num_rows, [None, pa.py_buffer((4 * bounds).astype("<i8").tobytes()), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.column(k) for k in ("doc_id", "key", "held_out")), own, pa.ListArray.from_arrays(pa.array(at), each)], ["doc_id", "key", "held_out", "symbols", "rare"])

    return run


def sequences(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about `size` bytes of symbols, with those and their texts' bounds."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("symbols"))).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            part = batch.slice(at, to - at)
            sequence = np.frombuffer(b"".join(x.as_buffer() for x in part.column("symbols")), "<i4")
            yield part, sequence, np.concatenate([[0], (ends[at:to] - before) // 4])
            at = to


def expectations(shared):
    """Rows (part, sums): a partition's expected counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, sequence, bounds in sequences(batches):
            found = expect(*shared.value, sequence, bounds)
            total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(pack_counts(total), pa.binary())], ["part", "sums"])

    return run


def class_chain(pairs: np.ndarray, rounds: int = START_ROUNDS):
    """Start, moves and emissions (by class, the end last) of a chain fitted to counts of class pairs
    (from, to; the start is the last from): Baum-Welch over pairs."""
    rng = np.random.default_rng(SEED)
    n, first = pairs[:-1].astype(np.float64), pairs[-1]
    total = n.sum(0) + n.sum(1) + first + 0.1
    emit = total[:, None] * rng.gamma(1.0, 1.0, (len(total), STATES))
    emit /= emit.sum(0)
    weight, move = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    for _ in range(rounds):
        left = emit * weight
        ratio = n / np.maximum(left @ move @ emit.T, 1e-300)
        moves = move * (left.T @ ratio @ emit)
        emitted = left * (ratio @ emit @ move.T) + emit * (ratio.T @ left @ move)
        weight = (moves.sum(1) + 0.5) / (moves.sum(1) + 0.5).sum()
        move = (moves + 0.5) / (moves + 0.5).sum(1, keepdims=True)
        emit = emitted + 0.1 * (total / total.sum())[:, None]
        emit /= emit.sum(0)
    post = emit * weight
    starts = (post / post.sum(1, keepdims=True) * first[:, None]).sum(0) + 1
    return starts / starts.sum(), move, emit


def train(texts: DataFrame, kinds: np.ndarray, unigram: np.ndarray, pairs: np.ndarray, rounds: int):
    """Baum-Welch over all coded texts, started from class pairs of all. Only sums of fixed size reach the
    driver. kinds: the class of each symbol."""
    spark = texts.sparkSession
    size = len(unigram)
    start, move, by_class = class_chain(pairs)
    emit = by_class[kinds] * (unigram / np.bincount(kinds, unigram, len(by_class))[kinds])[:, None]
    chain = (start, move, emit / emit.sum(0))
    salts = max(8, math.isqrt(texts.select(F.spark_partition_id()).distinct().count())) if rounds else 8
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)
        sums = texts.mapInArrow(expectations(shared), "part int, sums binary").withColumn("salt", F.spark_partition_id() % salts)
        sums = sums.groupBy("part", "salt").applyInArrow(widen, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()
        if not sums:
            break
        flat = np.concatenate([np.frombuffer(bytes(r["sums"]), "<f8") for r in sorted(sums, key=lambda r: r["part"])])
        cuts = np.split(flat, [STATES, STATES + STATES * STATES])
        chain = settle((cuts[0], cuts[1].reshape(STATES, STATES), cuts[2].reshape(size, STATES)), unigram)
        shared.unpersist()
    return chain


def score_rows(shared):
    """Rows (doc_id, key, held_out, n_tokens, n_rare, top_known, top_base, chain), without rare words' own part.

    Symbols are read in small chunks and gathered to TOKENS before the recursion runs, as
    it takes as many steps as the longest text has words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        top = len(m.vocabulary)
        end_known = m.log_top[top] > np.log10(0.5)

        def scored(held: list) -> pa.RecordBatch:
            sequence = np.concatenate([h[0] for h in held])
            n = np.concatenate([h[1] for h in held])
            bounds = np.concatenate([[0], np.cumsum(n)])
            cost = np.where(sequence <= top, m.log_top[np.minimum(sequence, top)], 0.0)
            share = np.where(sequence > top, m.class_log[np.maximum(sequence - top - 1, 0)], 0.0)
            columns = {
                "n_tokens": n,
                "n_rare": np.add.reduceat((sequence > top).astype(np.int64), bounds[:-1]),
                "top_known": np.add.reduceat((sequence < top) + (sequence == top) * end_known, bounds[:-1]).astype(np.int64),
                "top_base": np.add.reduceat(cost, bounds[:-1]) - n * m.base_denominator,
                "chain": forward(m.start, m.move, m.emit, sequence, bounds) - np.add.reduceat(share, bounds[:-1]),
            }
            ids = pa.Table.from_batches([h[2] for h in held]).combine_chunks()
            return pa.RecordBatch.from_arrays([*(ids.column(k).combine_chunks() for k in ("doc_id", "key", "held_out")), *map(pa.array, columns.values())], ["doc_id", "key", "held_out", *columns])

        held, size = [], 0
        for part, sequence, bounds in sequences(batches):
            held.append((sequence, np.diff(bounds), part.select(["doc_id", "key", "held_out"])))
            size += len(sequence)
            if size >= TOKENS:
                yield scored(held)
                held, size = [], 0
        if held:
            yield scored(held)

    return run


def score(documents: DataFrame, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row.

    Learned from rows that are not held out. Null and empty texts have one token, their end. A word
    never seen in training has count 0, as in the base. Repeated rows are scored alike, and each
    counts in training. With nothing to learn from, all words are alike unseen. Texts of any length are
    scored whole; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(plain(doc_id).alias("doc_id"), held_out(doc_id, 1).alias("held_out"), F.coalesce(plain(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    training = docs.where("not held_out").select("text")
    counts = cut(training.mapInArrow(word_counts, "pair boolean, word long, class int, n long").groupBy("pair", "word").agg(F.min("class").alias("class"), F.sum("n").alias("n")))
    pairs = np.zeros((CLASSES + 2, CLASSES + 1))
    told = counts.where("pair").select("word", "n").toPandas()  # of fixed size
    pairs[told["word"] // PAIR, told["word"] % PAIR] = told["n"]
    counts = counts.where("not pair").drop("pair")

    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"] or 0, size["v"]
    top = counts.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(TOP).toPandas()
    ends = counts.where(F.col("word") == int(END)).first()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    vocabulary = top["word"].to_numpy(np.int64).view(np.uint64)[order]
    n_top = top["n"].to_numpy(np.int64)[order]
    kinds = np.concatenate([top["class"].to_numpy(np.int64)[order], [CLASSES], np.arange(CLASSES)])
    edge = spark.createDataFrame(top[["word"]].astype("int64"), "word long")
    rare = counts.where(F.col("word") != int(END)).join(F.broadcast(edge), "word", "left_anti")
    classes = {r["class"]: (r["n"], r["v"]) for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    class_n = np.array([classes.get(k, (0, 0))[0] for k in range(CLASSES)], np.float64)
    class_v = np.array([classes.get(k, (0, 0))[1] for k in range(CLASSES)], np.float64)

    n_end = ends["n"] if ends else 0
    unigram = np.concatenate([n_top, [n_end], class_n]) + 0.5
    unigram /= unigram.sum()
    kind = docs.schema["doc_id"].dataType.simpleString()
    known_words = spark.sparkContext.broadcast(vocabulary)
    texts = cut(docs.mapInArrow(coded(known_words), f"doc_id {kind}, key long, held_out boolean, symbols binary, rare array<struct<word:bigint,tf:int>>"))
    start, move, emit = train(texts.where("not held_out").select("symbols"), kinds, unigram, pairs, rounds if total else 0)
    model = Model(vocabulary, np.log10(np.append(n_top, n_end) + 0.5), float(np.log10(total + 0.5 * (distinct + 1))), int(total), np.log10(class_n + 0.5 * (class_v + 1)), start, move, emit)
    shared = spark.sparkContext.broadcast(vars(model))

    scored = texts.select("doc_id", "key", "held_out", "symbols").mapInArrow(score_rows(shared), f"doc_id {kind}, key long, held_out boolean, n_tokens long, n_rare long, top_known long, top_base double, chain double")
    # A text that occurs m times sends its words m times: its sums are divided by m.
    found = texts.select("key", F.explode("rare").alias("x")).select("key", "x.word", "x.tf").join(rare.select("word", "n"), "word", "left")
    sums = found.groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    copies = texts.groupBy("key").agg(F.count("*").alias("m"))
    sums = cut(copies.join(sums, "key").select("key", "m", (F.col("rare_log") / F.col("m")).alias("rare_log"), F.expr("rare_known div m").alias("rare_known")))
    # Texts of many copies take their sums from a broadcast; they, and texts without rare words, are dealt
    # anywhere in the join of the others.
    crowd = sums.where(F.col("m") > CROWD).select("key", F.col("rare_log").alias("crowd_log"), F.col("rare_known").alias("crowd_known"))
    rest = sums.where(F.col("m") <= CROWD).select(F.col("key").alias("at"), "rare_log", "rare_known")
    out = scored.join(small(crowd), "key", "left")
    out = out.withColumn("at", F.when((F.col("n_rare") > 0) & F.col("crowd_log").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id", "key"))).join(rest, "at", "left")
    log, known = F.coalesce("crowd_log", "rare_log", F.lit(0.0)), F.coalesce("crowd_known", "rare_known", F.lit(0))
    # A text dealt anywhere may meet another's sums by chance, so only rare words count.
    log, known = F.when(F.col("n_rare") > 0, log).otherwise(0.0), F.when(F.col("n_rare") > 0, known).otherwise(0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("top_known") + known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("top_base") + log).alias("base_score"), (F.col("chain") + log).alias("score"))
