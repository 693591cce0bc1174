"""Quality classifier, filter audit and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, documents, empty, split
from pyspark.sql import functions as F

from calibra.llm import embedding, interaction, resampling

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int, text string, `a.b` string"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, clashing columns included, with the smallest table's."""
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    more = spark.createDataFrame([(50, "Äb " + "q" * 70 + " x " + "z" * 64 + " y1 " * 30, "l"), (51, "", None), (52, "Wort " * 60, "l")], "doc_id long, text string, source string")
    return documents(spark).unionByName(table, allowMissingColumns=True).unionByName(more, allowMissingColumns=True)


@pytest.fixture(scope="module")
def labels(spark):
    table = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    more = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (12, None, 1), (7, 5, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    return table.unionByName(more).withColumn("text", F.lit("clash")).withColumn("a.b", F.lit("x"))


def test_audit_applies_every_order_to_every_document(spark, docs, labels):
    rows = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]
    good, toxic = ({r["doc_id"] for r in labels.collect() if r[c] == 1} for c in ("quality", "toxic"))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    plain = []
    for d, t, part in rows:
        w = split(t)
        copy = t in least and (d is None or least[t] < d)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        plain.append((d, part, fails))
    want, removed = {}, Counter()
    for part in {p for _, p, _ in plain}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for d, p, f in plain if p == part]
            gone = 0
            for i, name in enumerate(order):
                out = [(d, f) for d, f in left if f[name]]
                left = [(d, f) for d, f in left if not f[name]]
                fails = sum(f[name] for _, p, f in plain if p == part)
                only = sum(f[name] and sum(f.values()) == 1 for _, p, f in plain if p == part)
                ids = [d for d, _ in out if d is not None]
                want[part, order, i + 1] = (len(left), len(out), fails - len(out), only, sum(d in good for d in ids), sum(d in toxic for d in ids))
                removed[part, name] += len(out)
                gone += len(out)
    got = interaction.audit(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert tuple(r)[3:9] == want[key], key
        assert r["shapley"] == removed[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_of_nothing(spark, labels):
    assert interaction.audit(empty(spark), labels).count() == 0
    assert interaction.audit(documents(spark), labels.where("false")).agg(F.max("good_lost")).first()[0] == 0


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_resampling(spark, docs):
    target = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("doc_id", F.lit("clash"))
    rows = [(r["doc_id"], *grams(r["text"])) for r in docs.collect()]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for r in target.collect():
        t.update(grams(r["text"])[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    scored = []
    for d, n, f in rows:
        weight = sum(gain[b] * c for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append((d, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = order[: len(order) * 5 // 100]
    want = Counter((r[0], r[2], r[3], r[4], i + 1) for i, r in enumerate(drawn)) + Counter((r[0], r[2], r[3], r[4], None) for r in scored)
    want -= Counter((r[0], r[2], r[3], r[4], None) for r in drawn)
    got = resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == want


def test_resampling_of_nothing_and_towards_nothing(spark):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(empty(spark), target).count() == 0
    assert resampling.resample(documents(spark), target).count() == documents(spark).count()


def test_draws_rank_many_equal_scores(spark):
    """Ranks are those of one sorted list, whatever the ranges; more rows are drawn than one interval has."""
    rows = [(i, 30, 5, 7, (i * i) % 50 - 10**12 * (i % 7 == 0)) for i in range(3000)] + [(-i, 3, 1, 1, 10**9) for i in range(1, 50)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    order = sorted(((-r[4], r[0]) for r in rows if r[1] >= 20))[: 3000 * 40 // 100]
    got = {r["doc_id"]: r["rank"] for r in resampling.drawn(df, 40).collect() if r["rank"]}
    assert got == {d: i + 1 for i, (_, d) in enumerate(order)}


def test_features_are_those_of_a_plain_reading():
    texts = ["ab ab  ünï", "", None, "x", "a" * 9 + " b\n" * 4]
    found = [Counter() for _ in texts]
    whole, embedding.PIECE = embedding.PIECE, 6
    try:
        for bucket, doc in embedding.features(pa.array(texts, pa.string())):
            for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
                found[d][b] += 1
    finally:
        embedding.PIECE = whole
    names = {}
    for text, have in zip(texts, found, strict=True):
        want, before = Counter({"end": 1}), None
        for w in split(text):
            marked = f"<{w}>"
            want.update([f"word {w}", *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))])
            want["again"] += w == before
            before = w
        want = +want
        assert sorted(want.values()) == sorted(have.values())
        for n in set(want.values()):
            if sum(v == n for v in want.values()) == 1:
                name, bucket = next(k for k, v in want.items() if v == n), next(k for k, v in have.items() if v == n)
                assert names.setdefault(name, bucket) == bucket


def test_training_steps_lower_the_loss_and_reading_is_the_model():
    rng = np.random.default_rng(0)
    buckets = [np.sort(rng.choice(300, 12, replace=False)) + 1000 * (i % 2) for i in range(60)]
    share = [np.full(12, 1 / 12, np.float32)] * 60
    quality = np.arange(60) % 2
    model = embedding.train(buckets, share, quality, np.ones(60))
    table, bias = model.read()
    for b, x, q in zip(buckets, share, quality, strict=True):
        by_vectors = embedding.softmax(x @ model.vectors[b] @ model.output + model.bias)
        assert np.allclose(by_vectors, embedding.softmax(x @ table[b] + bias), atol=1e-5)
        assert by_vectors[q] > 0.9


def test_classifier_on_texts_not_learned_from(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = embedding.classify(table, labels).collect()
    assert len(got) == table.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], r["predicted"], quality[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in quality]
    assert min(s for s, _, q in held if q == 1) > max(s for s, _, q in held if q == 0)
    assert all(p == 1 for _, p, q in held if q == 1)


def test_held_out_labels_change_no_score(spark, docs, labels):
    """Turning the labels of held-out rows around leaves all scores as they are."""
    before = {(r["doc_id"], r["score"]) for r in embedding.classify(docs, labels, sample=40).collect()}
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r["doc_id"], r["score"]) for r in embedding.classify(docs, turned, sample=40).collect()} == before


def test_classifier_awkward_rows(spark, docs, labels):
    assert embedding.classify(docs, labels, sample=40).count() == docs.count()
    assert {r["score"] for r in embedding.classify(documents(spark), labels.where("false")).collect()} == {0.5}
    assert embedding.classify(empty(spark), labels).count() == 0
    one = spark.createDataFrame([(1, LONG * 3, "x")], "doc_id long, text string, held_out string")
    assert embedding.classify(one, labels.where("doc_id = 1")).first()["score"] >= 0
