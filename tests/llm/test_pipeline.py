"""The pipeline's stages, each on its own input."""

from __future__ import annotations

from helpers import documents, empty, lowered

import corpus_pipeline as cp
from calibra.llm import langid

SF = "/root/testdata/sf0.001"


def test_stages_in_order_on_the_smallest_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [lowered(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert tuple(docs.columns) == cp.COLUMNS
        assert docs.count() <= before
    rows = docs.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    for r in rows:
        w = " " + " ".join(lowered(r["text"])) + " "
        assert not any(" " + " ".join(b) + " " in w for b in bench)
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in rows}


def test_stages_on_awkward_and_empty_tables(spark):
    docs = documents(spark).select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() > 0
        assert stage(spark, empty(spark).select(*cp.COLUMNS), SF).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], documents(spark).select(*cp.COLUMNS).schema)


def test_near_duplicates_tell_rows_apart_by_id_and_text(spark):
    """Against a plain version: one row of each group; no unique text is lost, no copy stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = " ".join(f"a{i}" for i in range(38)) + " z1 z2"
    rows = [(1, a), (1, b), (1, b), (2, near), (None, c), (None, c), (3, c), (4, None), (4, ""), (5, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in cp.one_of_each(spark, rows_of(spark, rows), SF).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (3, c), (4, None), (4, ""), (5, None)], key=repr)


def test_benchmark_texts_go_whatever_their_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, item), (1, item), (1, "one clean text of some words that no item holds"), (None, "another clean text"), (2, None)]
    got = {(r["doc_id"], r["text"]) for r in cp.clean_of_benchmarks(spark, rows_of(spark, rows), SF).collect()}
    assert got == {(1, rows[2][1]), (None, "another clean text"), (2, None)}


def test_language_stage_hands_python_each_text_once(spark):
    """What is carried stays in the JVM: the text is Python's only input, and only language and score return."""
    docs = spark.createDataFrame([(i, t, "x", "s", 3) for i, t in enumerate(["one two", None, "", "123", "two three"])], "doc_id long, text string, lang string, source string, n_chars long")
    found = langid.identify(docs, carry=("text", "source", "n_chars"))
    assert {(r["doc_id"], r["text"], r["lang_pred"]) for r in found.collect()} >= {(1, None, "und"), (2, "", "und"), (3, "123", "und")}
    plan = found.where("score >= 0.5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1 and "MapInArrow" not in plan
