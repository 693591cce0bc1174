"""Line-first quality rules.

Every line with a word is judged by itself: by punctuation (it must end a sentence), as navigation
(a row of separators) and as boilerplate (symbol noise, stock phrases, a repeat of an earlier line).
Failing lines are removed; a document that loses too large a share of its words so is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import plain
from .words import chunks, gram_hashes, grams_within, mix, range_hashes, words

#: A line ends a sentence if its last word does, quotes and brackets included. A line that doesn't
#: passes for prose cut short if one word in SENTENCE_WORDS ends a sentence.
SENTENCE_WORDS = 40
TERMINAL = ".!?:;\"')]"
TERMINAL_WIDE = ("…", "”", "»", "“", "。", "！", "？")
SEPARATORS = "|>/"
SYMBOLS = "#*$%&|<>"
PHRASES = ("javascript", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "lorem ipsum", "click here", "sign up for")
#: Of a line: separator words per hundred words, and symbols per hundred words, beyond which it fails.
MAX_SEPARATORS, MAX_SYMBOLS = 20, 50
#: Of a document: words in failing lines per hundred words, beyond which it is rejected.
MAX_LOSS = 50
MIN_WORDS, MAX_REPEATED = 50, 50


def flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


def counts_between(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[end] - sums[start]


def repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether its (doc, key) occurs twice or more, and whether it did before."""
    order = np.argsort(mix(key + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), kind="stable")
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    often, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:]] = same
    often[order[1:]] = same
    often[order[:-1]] |= same
    return often, before


def judge_lines(w, line_start, line_end, line_doc, first_word, n_words, again) -> np.ndarray:
    """Whether each line with a word fails a rule; lines without words pass."""
    data = w.data
    bad = np.zeros(len(line_start), bool)
    has = np.flatnonzero(n_words)
    last = w.end - 1
    ends = flags(TERMINAL)[data[last]]
    for mark in TERMINAL_WIDE:
        code = mark.encode()
        hit = last >= len(code) - 1
        for j, byte in enumerate(reversed(code)):
            hit &= data[np.maximum(last - j, 0)] == byte
        ends |= hit
    sentences = counts_between(ends, first_word, first_word + n_words)[has]
    single = (w.end - w.start == 1) & flags(SEPARATORS)[data[w.start]]
    separators = counts_between(single, first_word, first_word + n_words)[has]
    symbols = counts_between(flags(SYMBOLS)[data], line_start, line_end)[has]
    n = n_words[has]
    bad[has] = (~ends[(first_word + n_words - 1)[has]] & (SENTENCE_WORDS * sentences < n)) | (100 * separators > MAX_SEPARATORS * n) | (100 * symbols > MAX_SYMBOLS * n) | again[has]
    lowered = data.tobytes().lower()
    for phrase in map(str.encode, PHRASES):
        at = lowered.find(phrase)
        while at >= 0:
            line = int(np.searchsorted(line_start, at, "right")) - 1
            bad[line] |= at + len(phrase) <= line_end[line] and n_words[line] > 0
            at = lowered.find(phrase, at + 1)
    return bad


def measure(c: pa.RecordBatch, with_text: bool) -> dict[str, pa.Array]:
    w = words(c.column("text"))
    data, offsets, doc = w.data, w.offsets, w.doc
    n_words = np.diff(w.first)
    lead = (data & 0xC0) != 0x80
    word_chars = counts_between(lead, w.start, w.end)

    # Lines: every text has one more than newlines; an empty text has one empty line.
    breaks = np.flatnonzero(data == 10)
    line_start, line_end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    per_doc = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    line_doc = np.repeat(np.arange(len(per_doc)), per_doc)
    first_word = np.searchsorted(w.start, line_start)
    line_words = np.searchsorted(w.start, line_end) - first_word
    again = np.zeros(len(line_start), bool)
    has = np.flatnonzero(line_words)
    again[has] = repeated(range_hashes(data, line_start[has], line_end[has]), line_doc[has])[1]

    at = grams_within(w.first, 3)
    covered = np.zeros(len(doc) + 1, bool)
    if len(at):
        hit = at[repeated(gram_hashes(w.hashes(), 3)[at], doc[at])[0]]
        for j in range(3):
            covered[hit + j] = True
    repeat_words = counts_between(covered, w.first[:-1], w.first[1:])

    bad = judge_lines(w, line_start, line_end, line_doc, first_word, line_words, again)
    lost = np.bincount(line_doc, line_words * bad, len(per_doc)).astype(np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEATED * n_words)
    out = {
        "n_words": n_words,
        "word_chars": np.add.reduceat(np.append(word_chars, 0), np.minimum(w.first[:-1], len(word_chars))) * (n_words > 0),
        "n_symbols": counts_between(flags(SYMBOLS)[data], offsets[:-1], offsets[1:]),
        "n_dup_lines": np.bincount(line_doc, again, len(per_doc)).astype(np.int64),
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~failed & (100 * lost <= MAX_LOSS * n_words),
        "n_lost_words": lost,
    }
    if with_text:
        first_line = np.cumsum(per_doc) - per_doc
        raw = data.tobytes()
        out["clean_text"] = ["\n".join(raw[line_start[j] : line_end[j]].decode() for j in range(f, f + n) if not bad[j]) for f, n in zip(first_line.tolist(), per_doc.tolist(), strict=True)]
    return {k: pa.array(v) for k, v in out.items()}


def clean(documents: DataFrame, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lost_words, and with with_text the text without its failing
    lines (clean_text).

    Null and empty texts have no words, fail the base and have an empty clean_text. Repeated rows are
    judged one by one; other columns are ignored.
    """
    docs = documents.select(plain(doc_id).alias("doc_id"), plain(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                found = measure(c, with_text)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), *found.values()], ["doc_id", *found])

    counted = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {counted}" + ", clean_text string" * with_text)
