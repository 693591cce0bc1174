"""Ordinary words around a notice weigh as they occur in the corpus."""

from __future__ import annotations

from calibra.llm import license_scan as ls


def test_frequent_words_around_a_notice_do_not_hide_it(spark):
    plain = [f"everything here of this project is under the number{i}" for i in range(1000)]
    texts = [*plain, "Everything here of this project is released under the MIT License", "Zyx wvu tsr qpo nml kji hgf License"]
    files = [(i, f"p/{i}", t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["own"] for r in ls.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[0] is None and got[1000] == "MIT" and got[1001] is None
