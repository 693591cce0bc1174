"""Passages of one or two lines, and repeats within a document, against a plain version."""

from __future__ import annotations

from helpers import documents, split

import corpus_pipeline as cp
from calibra.llm import line_dedup

SF = "/root/testdata/sf0.001"
W = line_dedup.PASSAGE_WORDS
LONG = " ".join(f"z{i}" for i in range(46))


def plain(rows):
    """{(doc_id, text): kept_text}; each (doc_id, text) once. doc_id and order of texts must differ."""
    docs = sorted(set(rows))
    first, own = {}, {}

    def windows(text):
        worded = [(i, x) for i, x in enumerate((text or "").split("\n")) if split(x)]
        for run in (1, 2, 3):
            for at in range(len(worded) - run + 1):
                part = worded[at : at + run]
                if run == 3 or sum(len(split(x)) for _, x in part) >= W:
                    yield at, tuple(x for _, x in part), [i for i, _ in part]

    for d, t in docs:
        for at, w, _ in windows(t):
            first.setdefault(w, (d, t, at))
    for d, t in docs:
        gone = {i for at, w, places in windows(t) if first[w] != (d, t, at) for i in places}
        seen = set()
        for i, x in enumerate(t.split("\n")):
            if split(x) and x in seen:
                gone.add(i)
            seen.add(x)
        own[(d, t)] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return own


def test_passages_against_a_plain_version(spark):
    extra = [(5000, f"own start\n{LONG}"), (5001, f"{LONG}\nown end"), (5002, LONG), (5003, "a b c\nx\na b c\n\nx"), (5004, "five words stand on here\nand five more on this"), (5005, "q\nfive words stand on here\n\nand five more on this\nr"), (5005, "q\nfive words stand on here\n\nand five more on this\nr")]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text is not null").collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["text"]): r["kept_text"] for r in line_dedup.remove_repeated_lines(df, words=W).collect()}
    assert got == plain(rows)
    assert got[extra[1]] == "own end" and got[extra[2]] == "" and got[extra[3]] == "a b c\nx\n" and got[extra[5]] == "q\n\nr"


def test_pipeline_drops_single_line_copies(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "s", 1), (2, LONG + "\nown", "en", "s", 1), (3, LONG, "en", "s", 1)], documents(spark).select(*cp.COLUMNS).schema)
    assert {r["doc_id"]: r["text"] for r in cp.remove_lines(spark, docs, SF).collect()} == {1: LONG, 2: "own"}


def test_awkward_rows_stay_whole_in_number(spark):
    df = documents(spark)
    assert line_dedup.remove_repeated_lines(df, words=W).count() == df.count()
