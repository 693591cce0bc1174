"""Removal of long passages that occur elsewhere, by suffix automata of reference shards.

A window is `length` consecutive words of a document. The least hash among the short grams of a
window is its anchor: equal windows have equal anchors, and neighbouring windows mostly share one.
Runs of windows with one anchor are cut out as snippets; anchors that occur once are dropped.
Snippets are dealt to shards by anchor, with equal ones merged into one and a count. Each shard
builds suffix automata over its snippets' words; each snippet is then streamed through the automaton
for its matching statistics, and a window is repeated if the state of its `length` words occurs
twice or more. The verdicts go back to the documents by joins, where maximal spans are removed.

The reference is the corpus itself, so its automata have no proven size bound and are not broadcast:
each meets just the snippets that can match it. An automaton holds CROWD bytes of distinct snippets
at most; an anchor with more is dealt again by the least of longer grams, at last by whole windows,
so no task holds an unbounded group. Words are compared as text, not by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, plain, semi
from .words import chunks, gram_hashes, grams_within, range_hashes, sliding_min, words

LENGTH = 35
#: Words of the grams whose least is a window's anchor: first, and where an anchor has a crowd of
#: different snippets; at last the windows themselves.
GRAMS = (8, 22, None)
#: Bytes of distinct snippets in one automaton, at most: about 100 MB of a task's memory.
CROWD = 1 << 20
#: Bytes of distinct snippets in a shard, about.
SHARD = 1 << 19
#: Windows of one snippet, at most; longer runs are cut, each window being in one part.
RUN = 1 << 20


def runs(column, length: int, gram: int):
    """The runs of windows of each text: words, anchor hash, text, first word and number of windows."""
    w = words(column)
    at = grams_within(w.first, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return w, none, none, none, none
    least = sliding_min(gram_hashes(w.hashes(), gram), length - gram + 1)[at]
    doc = w.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    if len(count) and count.max() > RUN:
        begin = np.concatenate([np.arange(b, b + n, RUN) for b, n in zip(begin.tolist(), count.tolist(), strict=True)])
        count = np.diff(np.append(begin, len(at)))
    return w, least[begin].view(np.int64), doc[begin], at[begin], count


def anchor_counts(length: int):
    """Rows (anchor, n): how many places are some window's anchor, by their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, size=2 << 20):
                w = words(c.column("text"))
                at, span = grams_within(w.first, length), length - GRAMS[0] + 1
                if not len(at):
                    continue
                gram = gram_hashes(w.hashes(), GRAMS[0])
                # A place is an anchor if its gram is the least of some window around it.
                greatest = np.zeros(len(gram) + span - 1, np.uint64)
                greatest[at + span - 1] = sliding_min(gram, span)[at]
                value, n = np.unique(gram[~sliding_min(~greatest, span) == gram], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def run_rows(length: int):
    """Rows (anchor, key, key2, begin, windows): the runs of each text, begin counted from its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                w, anchor, doc, begin, count = runs(c.column("text"), length, GRAMS[0])
                keys = [np.asarray(c.column(k))[doc] if len(doc) else np.zeros(0, np.int64) for k in ("key", "key2")]
                place = ((begin - w.first[doc]) << 24) | count
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, *keys, place)], ["anchor", "key", "key2", "place"])

    return run


def snippet_rows(length: int):
    """Of rows (key, key2, copies, text, hits), rows (anchor, snippet, copies, key, key2, begin, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                w = words(c.column("text"))
                hits = c.column("hits")
                doc = np.repeat(np.arange(c.num_rows), np.asarray(hits.value_lengths().fill_null(0)))
                flat = hits.flatten()
                anchor, place = np.asarray(flat.field("anchor")), np.asarray(flat.field("place"))
                begin, count = (place >> 24) + w.first[doc], place & ((1 << 24) - 1)
                start, end = w.start[begin], w.end[begin + count + length - 2]
                body = [w.data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                # Equal word sequences are one snippet however they are spaced.
                body = [b" ".join(b.split()) for b in body]
                sizes = np.array([len(b) for b in body])
                joined = np.frombuffer(b"".join(body), np.uint8)
                stop = np.cumsum(sizes)
                snippet = range_hashes(joined, stop - sizes, stop).view(np.int64)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(snippet), *(c.column(k).take(take) for k in ("copies", "key", "key2")), pa.array(place >> 24), pa.array(body, pa.binary())], ["anchor", "snippet", "copies", "key", "key2", "begin", "body"])

    return run


class Automaton:
    """A suffix automaton of several word sequences, with the number of places each state ends at."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[bytes], copies: int) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)
            self.count[last] += copies

    def _state(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def close(self) -> None:
        """Adds each state's places to those of its shorter suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, sequence: list[bytes], length: int) -> list[bool]:
        """For each window of the sequence, whether it ends at two places or more."""
        state, matched, out = 0, 0, []
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if i >= length - 1:
                at = state
                while matched >= length and self.length[self.link[at]] >= length:
                    at = self.link[at]
                out.append(matched >= length and self.count[at] >= 2)
        return out


def judge(length: int):
    """Of one shard's rows (anchor, snippet, copies, body), rows (anchor, snippet, marks): a byte for
    each window, 1 if it is repeated. Snippets none of whose windows are repeated are left out."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("anchor")
        anchors = np.asarray(shard.column("anchor"))
        bounds = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])).tolist() + [len(anchors)]
        copies, bodies = shard.column("copies").to_pylist(), shard.column("body")
        keep, marks = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            sequences = [bodies[i].as_py().split(b" ") for i in range(a, b)]
            reference = Automaton()
            for i, words_ in zip(range(a, b), sequences, strict=True):
                reference.add(words_, copies[i])
            reference.close()
            for i, words_ in zip(range(a, b), sequences, strict=True):
                found = reference.repeated(words_, length)
                if any(found):
                    keep.append(i)
                    marks.append(bytes(found))
        picked = shard.select(["anchor", "snippet"]).take(pa.array(keep, pa.int64()))
        return picked.append_column("marks", pa.array(marks, pa.binary()))

    return run


def part_rows(length: int, gram: int):
    """Of rows (anchor, snippet, copies, body), rows (anchor, snippet, copies, at, key, part, twice,
    body): the runs of windows of each snippet by longer grams. twice: the run may repeat itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.set_column(batch.schema.get_field_index("body"), "text", batch.column("body").cast(pa.string()))):
                w, key, doc, begin, count = runs(c.column("text"), length, gram)
                if not len(key):
                    continue
                stop = w.end[begin + count + length - 2]
                part = range_hashes(w.data, w.start[begin], stop).view(np.int64)
                body = [w.data[a:b].tobytes() for a, b in zip(w.start[begin].tolist(), stop.tolist(), strict=True)]
                grams = gram_hashes(w.hashes(), gram).view(np.int64)
                twice = [int((grams[b : b + n + length - gram] == k).sum()) > 1 for b, n, k in zip(begin.tolist(), count.tolist(), key, strict=True)]
                own = [c.column(k).take(pa.array(doc)) for k in ("anchor", "snippet", "copies")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(begin - w.first[doc]), pa.array(key), pa.array(part), pa.array(twice), pa.array(body, pa.binary())], ["anchor", "snippet", "copies", "at", "key", "part", "twice", "body"])

    return run


def sizes_of(merged: DataFrame) -> DataFrame:
    return merged.groupBy("anchor").agg(F.sum(F.length("body")).alias("size"), F.sum("copies").alias("places"))


def marks_of(merged: DataFrame, length: int, level: int = 0) -> DataFrame:
    """Rows (anchor, snippet, at, marks) of merged snippets (anchor, snippet, copies, body)."""
    last = level == len(GRAMS) - 1
    sizes = sizes_of(merged)
    shards = 1 + (sizes.agg(F.sum("size")).first()[0] or 0) // SHARD
    big = None if last else cut(sizes.where(F.col("size") > CROWD).select("anchor"))
    last = last or big.isEmpty()
    calm = merged if last else semi(merged, big, "anchor", "left_anti")
    dealt = calm.select("anchor", "snippet", "copies", "body").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(judge(length), "anchor long, snippet long, marks binary").select("anchor", "snippet", F.lit(0).cast("long").alias("at"), "marks")
    if last:
        return found
    crowd = semi(merged, big, "anchor").select("anchor", "snippet", "copies", "body")
    schema = "anchor long, snippet long, copies long, at long, key long, part long, twice boolean, body binary"
    parts = cut(crowd.mapInArrow(part_rows(length, GRAMS[level + 1] or length), schema))
    equal = parts.groupBy(F.col("key").alias("anchor"), F.col("part").alias("snippet")).agg(F.sum("copies").alias("copies"), F.first("body").alias("body"), F.max("twice").alias("twice"))
    often = equal.join(sizes_of(equal), "anchor").where("places > 1 or twice").select("anchor", "snippet", "copies", "body")
    below = marks_of(cut(often), length, level + 1)
    places = parts.select("anchor", "snippet", F.col("at").alias("begin"), "key", "part").join(below.select(F.col("anchor").alias("key"), F.col("snippet").alias("part"), "at", "marks"), ["key", "part"])
    return found.union(places.select("anchor", "snippet", F.col("begin") + F.col("at"), "marks"))


def strip(length: int, with_text: bool):
    """Of rows (doc columns, text, marks), the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, n_removed, digests, kept_texts = [], [], [], [], []
            for doc_id, text, marks in zip(batch.column("doc_id"), batch.column("text"), batch.column("marks").to_pylist(), strict=True):
                parts = (text.as_py() or "").encode().split()
                n, removed = len(parts), np.zeros(len(parts) + 1, np.int64)
                for m in marks or ():
                    at = m["begin"] + np.flatnonzero(np.frombuffer(m["marks"], np.uint8))
                    np.add.at(removed, at, 1)
                    np.add.at(removed, at + length, -1)
                gone = np.cumsum(removed)[:n] > 0
                total = int(gone.sum())
                kept = b" ".join(parts if not total else [p for p, g in zip(parts, gone.tolist(), strict=True) if not g])
                ids.append(doc_id)
                n_words.append(n)
                n_removed.append(total)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            columns = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                columns["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of documents: doc_id, n_words, n_removed, kept_sha256, and with with_text
    the kept words joined by one space (kept_text).

    Each word in a window of `length` words whose sequence also starts anywhere else, in the same or
    another row, is removed; windows are judged on the input. Null and empty texts, and texts of
    fewer words, lose nothing; repeated rows count as occurrences of each other. Texts of any length
    are read whole; other columns are ignored.
    """
    docs = documents.select(plain(doc_id).alias("doc_id"), plain(text).alias("text"))
    keyed = docs.withColumn("key", F.xxhash64("text")).withColumn("key2", F.xxhash64(F.lit(1), "text"))
    again = keyed.where("text is not null").groupBy("key", "key2").agg(F.count("*").alias("copies"))

    often = docs.select("text").mapInArrow(anchor_counts(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    placed = keyed.select("key", "key2", "text").mapInArrow(run_rows(length), "anchor long, key long, key2 long, place long")
    hits = cut(placed.join(often, "anchor").distinct().groupBy("key", "key2").agg(F.collect_list(F.struct("anchor", "place")).alias("hits")))
    with_hits = semi(keyed, hits.select("key").distinct(), "key").select("key", "key2", "text").dropDuplicates(["key", "key2"])
    bodies = with_hits.join(hits, ["key", "key2"]).join(again, ["key", "key2"]).select("key", "key2", "copies", "text", "hits")
    schema = "anchor long, snippet long, copies long, key long, key2 long, begin long, body binary"
    snippets = cut(bodies.mapInArrow(snippet_rows(length), schema))

    # Equal snippets are merged; only then are anchors dealt to shards.
    merged = snippets.groupBy("anchor", "snippet").agg(F.sum("copies").alias("copies"), F.first("body").alias("body"))
    marks = marks_of(cut(merged), length)

    placed = snippets.select("anchor", "snippet", "key", "key2", "begin").join(marks, ["anchor", "snippet"])
    verdicts = placed.groupBy("key", "key2").agg(F.collect_list(F.struct((F.col("begin") + F.col("at")).alias("begin"), "marks")).alias("marks"))
    verdicts = cut(verdicts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    few = semi(keyed, verdicts.select("key").distinct(), "key").join(verdicts, ["key", "key2"], "left")
    none = F.lit(None).cast("array<struct<begin:bigint,marks:binary>>").alias("marks")
    rest = semi(keyed, verdicts.select("key").distinct(), "key", "left_anti").select("*", none)
    whole = few.select("doc_id", "text", "marks").union(rest.select("doc_id", "text", "marks"))
    return whole.mapInArrow(strip(length, with_text), schema)
