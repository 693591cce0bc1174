"""Licences of texts: sparse TF-IDF cosine to templates, then inheritance from directories.

Lines that hold a licence word, with what stands between near ones, form blocks; each block is
compared with every template. Document frequencies of all words of blocks are counted over all texts. A path without a licence of its own takes that of the nearest directory above it that has
a licence file, by equi-joins on directory names; directories, not files, are joined to their
ancestors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, plain, semi, small
from .words import chunks, range_hashes, utf8, words

#: Short notices and characteristic passages of well-known licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: A line is read if it holds one of these.
MARKS = ("licens", "licenc", "copyright", "permission", "redistribut", "public domain", "free software", "warrant")
#: Lines between two such lines that still belong to one block.
GAP = 3
THRESHOLD = 0.6
#: A text is a licence file of its directory if its name says so or so many words in a hundred are in blocks that match a template.
FILE_SHARE = 50
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense|notice)([.\-_].*)?$"


def terms_table() -> np.ndarray:
    """ASCII letters lower-cased, digits and other bytes kept, other ASCII as spaces."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        ch = chr(b)
        table[b] = ord(ch.lower()) if ch.isalnum() else (10 if ch == "\n" else 32)
    return table


def term_hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = utf8(pa.array(texts, pa.string()))
    plain_text = terms_table()[data]
    column = pa.array([plain_text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    w = words(column)
    h = w.hashes()
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def vocabulary() -> np.ndarray:
    return np.unique(np.concatenate(term_hashes([t for v in TEMPLATES.values() for t in v])))


#: Distinct terms that a task counts before it hands them on.
HELD_TERMS = 1 << 20


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, n): in how many of the texts read a term occurs; a term may come several times."""
    table, held, total = terms_table(), [], 0

    def out() -> pa.RecordBatch:
        h = np.concatenate([x for x, _ in held])
        term, at = np.unique(h, return_inverse=True)
        n = np.bincount(at, np.concatenate([x for _, x in held]), len(term)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["h", "n"])

    for batch in batches:
        for c in chunks(batch):
            data, offsets = utf8(c.column("text"))
            data = table[data]
            inside = (data != 32) & (data != 10)
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            start = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[: len(inside)] | edge[:-1]))
            end = np.flatnonzero(inside & (np.append(~inside[1:], True)[: len(inside)] | edge[1:])) + 1
            h = range_hashes(data, start, end)
            doc = np.searchsorted(offsets, start, "right") - 1
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            term, n = np.unique(h[new], return_counts=True)
            held.append((term, n))
            total += len(term)
            if total > HELD_TERMS:
                yield out()
                held, total = [], 0
    if held:
        yield out()


def blocks(text: str) -> list[str]:
    """Runs of lines with a licence mark, and what stands between near ones."""
    lowered = text.lower()
    if not any(m in lowered for m in MARKS):
        return []
    lines = text.split("\n")
    marked = [i for i, line in enumerate(lines) if any(m in line.lower() for m in MARKS)]
    out, begin, last = [], None, None
    for i in [*marked, None]:
        if begin is not None and (i is None or i - last > GAP):
            out.append("\n".join(lines[begin : last + 1]))
            begin = None
        if i is not None:
            begin, last = (i if begin is None else begin), i
    return out


#: Window starts that are looked at together.
STRIDE = 4096


def window_cosines(v: np.ndarray, h: np.ndarray, idf: np.ndarray, width: int, pairs: tuple) -> np.ndarray:
    """The cosines (starts x templates) of all windows of `width` terms; v: terms x templates. Products
    are sums over terms; squared norms as well, but for terms that occur several times, whose pairs
    count twice."""

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return total[width:] - total[:-width]

    left, right, value = pairs
    fits = right - left < width
    extra = np.zeros(len(h) + 1)
    # A pair lies in the windows that start at right - width + 1 up to left.
    np.add.at(extra, np.maximum(right[fits] - width + 1, 0), value[fits])
    np.add.at(extra, left[fits] + 1, -value[fits])
    square = sums(idf * idf) + 2 * np.cumsum(extra)[: len(h) - width + 1]
    return sums(v) / np.sqrt(square)[:, None]


def term_pairs(h: np.ndarray, idf: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of equal terms less than `within` apart, and their products."""
    found = [np.flatnonzero(h[d:] == h[:-d]) for d in range(1, min(within, len(h)))]
    left = np.concatenate([np.zeros(0, np.int64), *found])
    right = np.concatenate([np.zeros(0, np.int64), *[x + d for d, x in enumerate(found, 1)]])
    return left, right, idf[left] ** 2


def marked_terms(block: str) -> np.ndarray:
    """Which terms of a block a licence mark begins in."""
    plain_text = terms_table()[np.frombuffer(block.encode("utf-8", "replace"), np.uint8)].tobytes()
    begins = np.array([m.start() for m in re.finditer(rb"[^ \t-\r]+", plain_text)], np.int64)
    at = [m.start() for mark in MARKS for m in re.finditer(mark.encode(), plain_text)]
    out = np.zeros(len(begins), bool)
    if at:
        out[np.searchsorted(begins, at, "right") - 1] = True
    return out


def judge(block: str, known: np.ndarray, vectors: np.ndarray, widths: np.ndarray, idf_of) -> tuple[int | None, float, int]:
    """The template nearest to any part of a block, its cosine, and how many terms belong to a licence
    if any part reaches THRESHOLD. Parts are the block, its sentences and lines, and windows as wide
    as each template around its licence marks, so that prose around a notice doesn't hide it. In a
    block with a licence all terms count, but of a line with prose around a notice the notice only."""
    lines = block.split("\n")
    by_line = term_hashes(lines)
    h = np.concatenate(by_line)
    if not len(h):
        return None, 0.0, 0
    idf = idf_of(h)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    of_known = np.where(known[at] == h, idf, 0.0)
    best, score = None, 0.0

    def part(a: int, b: int) -> bool:
        nonlocal best, score
        if a == b:
            return False
        _, place = np.unique(h[a:b], return_inverse=True)
        cosine = vectors @ np.bincount(at[a:b], of_known[a:b], len(known)) / np.linalg.norm(np.bincount(place, idf[a:b]))
        k = int(cosine.argmax())
        if cosine[k] >= THRESHOLD and cosine[k] > score:
            best, score = k, float(cosine[k])
        return bool(cosine[k] >= THRESHOLD)

    whole = part(0, len(h))
    notice = np.zeros(len(h), bool)
    line_ends = np.cumsum([len(x) for x in by_line])
    full = []
    for line, end, terms in zip(lines, line_ends, by_line, strict=True):
        first = end - len(terms)
        full.append(part(first, end))
        if ". " in line:
            for terms in term_hashes(line.split(". ")):
                if part(first, first + len(terms)):
                    notice[first : first + len(terms)] = True
                first += len(terms)
    near = marked_terms(block)
    widest = int(widths.max())
    for s in range(0, len(h), STRIDE):
        to = min(len(h), s + STRIDE + widest - 1)
        if not near[s:to].any():
            continue
        pairs = term_pairs(h[s:to], idf[s:to], widest)
        v = vectors[:, at[s:to]].T * of_known[s:to, None]
        marks = np.append(0, np.cumsum(near[s:to]))
        for width in np.unique(widths[widths < min(len(h), to - s + 1)]).tolist():
            wide = np.flatnonzero(widths == width)
            holds = np.flatnonzero(marks[width:] > marks[:-width])
            cosine = window_cosines(v[:, wide], h[s:to], idf[s:to], width, pairs)[holds]
            if not len(holds):
                continue
            i, k = np.unravel_index(cosine.argmax(), cosine.shape)
            if cosine[i, k] >= THRESHOLD and cosine[i, k] > score + 1e-9:
                best, score = int(wide[k]), float(min(1.0, cosine[i, k]))
            for i in holds[(cosine >= THRESHOLD).any(axis=1)]:
                notice[s + i : s + i + width] = True
    if best is None:
        return None, 0.0, 0
    if whole:
        return best, score, len(h)
    counts = 0
    for end, terms, all_of_it in zip(line_ends, by_line, full, strict=True):
        held = int(notice[end - len(terms) : end].sum())
        counts += held if held and not all_of_it else len(terms)
    return best, score, counts


def licence_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, path, n_words, blocks, terms): of each text its blocks and their distinct terms."""
    for batch in batches:
        n_words, found, terms = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            parts = blocks(text)
            n_words.append(len(text.split()) if parts else 0)
            found.append(parts)
            terms.append(np.unique(np.concatenate(term_hashes(parts))).view(np.int64) if parts else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.int64()))], ["doc_id", "path", "n_words", "blocks", "terms"])


def own_licenses(known: np.ndarray, df: np.ndarray, n: int):
    """Judges blocks by the document frequencies of their terms (weights: h and n of each)."""

    def weigh(count: np.ndarray) -> np.ndarray:
        return 1 + np.log((1 + n) / (1 + count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, v in TEMPLATES.items() for _ in v]
        templates = term_hashes([t for v in TEMPLATES.values() for t in v])
        vectors = np.array([np.bincount(np.searchsorted(known, h), minlength=len(known)) * weigh(df) for h in templates])
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        widths = np.array([len(h) for h in templates])
        for batch in batches:
            found = []
            for n_words, parts, weights in zip(batch.column("n_words").to_pylist(), batch.column("blocks").to_pylist(), batch.column("weights"), strict=True):
                h, count = (x.to_numpy(zero_copy_only=False) for x in weights.values.flatten())
                order = np.argsort(h.view(np.uint64))
                h, weight = h.view(np.uint64)[order], weigh(count[order])
                best, score, covered = None, 0.0, 0
                for block in parts:
                    k, cosine, terms = judge(block, known, vectors, widths, lambda x, h=h, weight=weight: weight[np.searchsorted(h, x)])
                    covered += terms
                    if k is not None and cosine > score:
                        best, score = names[k], cosine
                found.append((best, round(score, 6), 100 * covered >= FILE_SHARE * max(1, n_words)))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["doc_id", "path", "own", "score", "mostly"])

    return run


def ancestors(directory: Column) -> Column:
    """(name, depth) of a directory and all above it; the root is ''."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("name"), i.alias("depth")))


def scan(files: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """Rows (doc_id, path, own, score, license, inherited_from), one for each row of files.

    own: the template nearest to any licence block of the whole text, if its cosine is THRESHOLD or
    more; score: that cosine. license: own, else that of the nearest directory at or above the
    path's with a licence file; among several files of a directory the best score counts, then the
    first name. inherited_from: that directory ('' the root), null for own and missing licences.
    Null and empty texts have no licence of their own; a null path inherits nothing; repeated rows
    are judged alike. Other columns are ignored.
    """
    docs = files.select(plain(doc_id).alias("doc_id"), plain(path).cast("string").alias("path"), plain(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.mapInArrow(licence_blocks, f"doc_id {kind}, path string, n_words long, blocks array<string>, terms array<long>")
    read = cut(read.withColumn("row", F.monotonically_increasing_id()))
    n = read.count()
    known = vocabulary()
    templates = docs.sparkSession.createDataFrame([(int(x),) for x in known.view(np.int64)], "h long")
    asked = cut(read.select(F.explode("terms").alias("h")).union(templates).distinct())
    counts = docs.select("text").mapInArrow(document_counts, "h long, n long")
    seen = cut(semi(counts, asked, "h").groupBy("h").agg(F.sum("n").alias("n")))
    of = {r["h"]: r["n"] for r in seen.join(F.broadcast(templates), "h", "left_semi").collect()}
    df = np.array([of.get(int(x), 0) for x in known.view(np.int64)])

    # Words of blocks meet their frequencies; texts stay where they are.
    weights = read.select("row", F.explode("terms").alias("h")).join(small(seen), "h").groupBy("row").agg(F.collect_list(F.struct("h", "n")).alias("weights"))
    judged = read.where(F.size("blocks") > 0).join(weights, "row").select("doc_id", "path", "n_words", "blocks", "weights")
    # Blocks are small but slow to judge: so many tasks, whatever their bytes.
    judged = judged.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    judged = judged.mapInArrow(own_licenses(known, df, n), f"doc_id {kind}, path string, own string, score double, mostly boolean")
    none = read.where(F.size("blocks") == 0).select("doc_id", "path", F.lit(None).cast("string").alias("own"), F.lit(0.0).alias("score"), F.lit(False).alias("mostly"))
    found = cut(judged.union(none))
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    found = found.withColumn("directory", F.array_join(F.filter(F.split(directory, "/"), lambda x: x != ""), "/"))
    name = F.element_at(F.split("path", "/"), -1)
    file_rows = found.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("mostly") | name.rlike(FILE_NAME)))
    given = file_rows.groupBy(F.col("directory").alias("name")).agg(F.min(F.struct(-F.col("score"), "path", "own"))["own"].alias("given"))
    above = found.where("path is not null").select("directory").distinct().withColumn("a", F.explode(ancestors(F.col("directory"))))
    nearest = above.select("directory", F.col("a.name").alias("name"), F.col("a.depth").alias("depth")).join(given, "name").groupBy("directory").agg(F.max(F.struct("depth", "name", "given")).alias("g"))
    out = found.join(nearest, "directory", "left")
    inherits = F.col("own").isNull() & F.col("path").isNotNull()
    return out.select("doc_id", "path", "own", "score", F.coalesce("own", F.when(inherits, F.col("g.given"))).alias("license"), F.when(inherits, F.col("g.name")).alias("inherited_from"))
