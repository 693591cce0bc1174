"""Best-fit-decreasing packing of token sequences into fixed-length training sequences.

Lengths are whole numbers of at most the capacity, so the state of best-fit decreasing is a count of
open bins for each remaining capacity, whatever the number of documents. The plan is made on the
driver from the histogram of lengths (at most `capacity` rows): a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and a run of equal lengths that meets a
run of equal bins is placed in one step, with the result of placing one at a time. Executors then
give each piece its rank among those of its length and read its place off the plan.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, plain
from .words import chunks, process_store

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that one task ranks, about.
RANKED = 20_000


class Open:
    """A segment tree over remaining capacities: which have an open bin."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        if count > 0 and room > 0:
            self.groups[room].append((first, count))
            self._set(room, True)

    def take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].pop()
        if not self.groups[room]:
            self._set(room, False)
        return group

    def _set(self, room: int, value: bool) -> None:
        i = room + self.leaves
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least `need` that has an open bin."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, from_rank, to_rank, first_bin, per_bin, offset), and the number of bins.

    Piece number i of a length, from_rank <= i < to_rank, goes to bin first_bin + (i - from_rank)
    // per_bin, at offset + (i - from_rank) % per_bin * length.
    """
    bins, runs, bin_count = Open(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                fresh = -(-left // (capacity // length))
                bins.add(capacity, bin_count, fresh)
                bin_count += fresh
                room = capacity
            first, count = bins.take(room)
            per_bin = room // length
            full = min(count, left // per_bin)
            if full:
                runs.append((length, rank, rank + full * per_bin, first, per_bin, capacity - room))
                rank, left = rank + full * per_bin, left - full * per_bin
                bins.add(room - per_bin * length, first, full)
            if full < count and 0 < left:
                runs.append((length, rank, rank + left, first + full, left, capacity - room))
                bins.add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            bins.add(room, first + full, count - full)
    return runs, bin_count


def encoder(path: str):
    """The tokenizer of a file; special tokens' strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    kept = process_store().setdefault("tokenizers", {})
    if path not in kept:
        kept[path] = Tokenizer.from_file(path)
        kept[path].encode_special_tokens = True
    return kept[path]


def byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """The same vocabulary as merge ranks, several times as fast; None if the file's
    ids don't follow its merges, or its pattern is another one."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    vocab, merges, stand_in = model["model"]["vocab"], model["model"]["merges"], byte_of()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    ids = [vocab.get("".join(p)) for p in pairs]
    if None in ids or ids != sorted(ids) or model.get("normalizer") or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": model["pre_tokenizer"].get("trim_offsets"), "use_regex": True}:
        return None
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(stand_in[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of so much white space are left to the file's own tokenizer; the pattern's look-ahead takes a
#: stack as deep as the run.
LONG_SPACE = 10_000
WIDE_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)
#: The split of byte-level vocabularies: contractions, words, numbers, other marks, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers: by the file's merges as ranks where it
    is that kind of vocabulary, which gives the same ids sooner, else by the file's own tokenizer."""
    kept = process_store().setdefault("ranked", {})
    if path not in kept:
        kept[path] = ranked(path)
    fast = kept[path]
    if fast and not any(len(t) >= LONG_SPACE and WIDE_SPACE.search(t) for t in texts):
        return [array("I", fast.encode_ordinary(t)).tobytes() for t in texts]
    return [np.array(e.ids, "<u4").tobytes() for e in encoder(path).encode_batch(texts, add_special_tokens=False)]


def piece_rows(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for c in chunks(batch):
                rows = []
                for doc_id, ids in zip(c.column("doc_id").to_pylist(), encode_texts([t or "" for t in c.column("text").to_pylist()], path), strict=True):
                    ids += end
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = (n - 1) % capacity + 1 if start == 0 else capacity
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, piece, start, length, zlib.crc32(own), own if with_ids else None))
                        start, piece = start + length, piece + 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[2:5]), pa.array(columns[5], pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    with_ids its ids as binary (little-endian, unsigned, 32 bits each).

    A document is its text's ids and end_id; null or empty text is end_id alone. Documents of more
    than `capacity` ids are cut, the first piece taking what is over; others stay whole. Sequences
    are filled without gaps from 0. Texts of any length, and runs of one character of any length, are
    encoded whole. Repeated rows are packed as often as given; an empty table gives
    no rows. tokenizer: path of a byte-level BPE file, readable by every executor.
    """
    spark = documents.sparkSession
    docs = documents.select(plain(doc_id).cast("long").alias("doc_id"), plain(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = cut(docs.mapInArrow(piece_rows(tokenizer, capacity, end_id, with_ids), schema))
    if not with_ids:
        pieces = pieces.drop("ids")

    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    places = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "length long, from_rank long, to_rank long, first_bin long, per_bin long, base long")

    parts = max(1, sum(histogram.values()) // RANKED)
    # pieces are written, so their numbers are the same whenever they are read; equal rows are dealt apart.
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("piece", F.monotonically_increasing_id()), F.lit(parts)))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(counts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(places), "length").where("rank >= from_rank and rank < to_rank")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    at = F.col("rank") - F.col("from_rank")
    return placed.select(*keep, (F.col("first_bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"), (F.col("base") + at % F.col("per_bin") * F.col("length")).cast("long").alias("offset"), *(["ids"] if with_ids else []))
