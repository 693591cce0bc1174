"""Licence scores against a plain version over all words, parts and windows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from calibra.llm import license_scan as ls

SF = "/root/testdata/sf0.001"
NOTICE = "Released under the MIT License."
FILL = " ".join(f"word{i} ordinary text" for i in range(40))


def terms(text):
    return re.findall(r"[^ \n]+", re.sub(r"[\x00-\x7f]", lambda m: m.group().lower() if m.group().isalnum() else ("\n" if m.group() == "\n" else " "), text))


def plain_score(text, df, n):
    weigh = lambda w: {x: c * (1 + math.log((1 + n) / (1 + df[x]))) for x, c in Counter(w).items()}
    templates = [terms(t) for v in ls.TEMPLATES.values() for t in v]
    best = 0.0
    for block in ls.blocks(text or ""):
        parts = [(terms(p), None) for p in [block, *block.split("\n"), *block.replace("\n", ". ").split(". ")]]
        w = terms(block)
        at = [len(terms(block[: m.start()] + "x")) - 1 for mark in ls.MARKS for m in re.finditer(mark, block.lower())]
        for k, t in enumerate(templates):
            for s in range(len(w) - len(t) + 1):
                if any(s <= a < s + len(t) for a in at):
                    parts.append((w[s : s + len(t)], k))
        for p, only in parts:
            a = weigh(p)
            for k, t in enumerate(templates):
                if p and only in (None, k):
                    b = weigh(t)
                    best = max(best, sum(a[x] * b.get(x, 0) for x in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    return best if best >= ls.THRESHOLD else 0.0


def test_scores_against_a_plain_version(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()]
    texts += ["Everything here is released under the MIT License", "This project is released under the MIT License", f"{FILL} this code is released under the MIT License {FILL}", "a licence of the licence of the licence of a licence, the warranty and the warranty", f"{FILL}\nLicensed under the Apache\nLicense, Version 2.0, {FILL}", None, ""]
    df = Counter(x for t in texts for x in set(terms(t or "")))
    files = spark.createDataFrame([(i, f"p/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").repartition(3)
    vectors = {r["doc_id"]: (r["own"], r["score"]) for r in ls.scan(files).collect()}
    for i, t in enumerate(texts):
        assert vectors[i][1] == pytest.approx(plain_score(t, df, len(texts)), abs=2e-6), (i, t)
    assert [vectors[i][0] for i in range(150, 155)] == ["MIT", "MIT", "MIT", None, "Apache-2.0"]


def test_share_is_of_all_blocks_but_prose_lines_are_not_licence_files(spark):
    permission = ls.TEMPLATES["MIT"][1]
    paragraphs = f"{NOTICE}\n\n\n\n\n{permission}.\n\n\n\n\n{ls.TEMPLATES['BSD-3-Clause'][1]}.\n\n\n\n\n{permission}."
    files = [(1, "a/terms.txt", paragraphs), (2, "a/x.txt", "no word of it"), (3, "b/y.txt", f"{FILL} {NOTICE} {FILL}"), (4, "b/z.txt", "no word of it")]
    got = {r["doc_id"]: (r["own"], r["license"], r["inherited_from"]) for r in ls.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "MIT", "a")
    assert got[3][0] == "MIT" and got[4] == (None, None, None)


def test_strides_and_held_terms_change_nothing(monkeypatch):
    text = f"{FILL} released under the MIT License {FILL} licence of the licence {ls.TEMPLATES['GPL-3.0'][1]} {FILL}\nwarranty"
    known = ls.vocabulary()
    templates = ls.term_hashes([t for v in ls.TEMPLATES.values() for t in v])
    vectors = np.array([np.bincount(np.searchsorted(known, h), minlength=len(known)) for h in templates]).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    widths = np.array([len(h) for h in templates])
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, "a a b", text])], ["text"])
    found = []
    for stride, held in ((4096, 1 << 20), (7, 3)):
        monkeypatch.setattr(ls, "STRIDE", stride)
        monkeypatch.setattr(ls, "HELD_TERMS", held)
        monkeypatch.setattr(ls, "chunks", lambda b: (b.slice(i, 1) for i in range(b.num_rows)))
        counts = Counter()
        for out in ls.document_counts([batch]):
            counts.update(dict(zip(*(c.to_pylist() for c in out.columns), strict=True)))
        k, score, n = ls.judge(text, known, vectors, widths, lambda h: np.ones(len(h)))
        found.append((k, round(score, 9), n, counts))
    assert found[0] == found[1] and found[0][1] == 1.0
    assert sorted(found[0][3].values())[:2] == [1, 1] and set(found[0][3].values()) == {1, 2}
