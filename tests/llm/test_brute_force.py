"""Operators against brute-force versions on awkward documents and on the smallest table."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import documents, empty, lowered, rows, split
from pyspark.sql import functions as F

from calibra.llm import decontam, hmm_lm, langid, license_scan, line_dedup, ngram_join, packing, pii, quality, runtime, substring
from calibra.llm.words import shingles, words

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def both(spark):
    """Awkward rows and the smallest table together, with their plain rows."""
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    df = docs.unionByName(table)
    df = spark.createDataFrame(df.collect(), df.schema).repartition(5, "n_chars")
    return df, [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]


def shingle_set(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(both):
    df, plain = both
    sets = [shingle_set(t) for _, t, _ in plain]
    parent = list(range(len(plain)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(plain)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(plain):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(repr((d, len(sets[i]), least.get(find(i)) if sets[i] else d)) for i, (d, _, _) in enumerate(plain))
    got = ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


@pytest.mark.parametrize("counted", [1 << 19, 1000])
def test_shingle_counts_of_a_worker(monkeypatch, counted):
    """Counts are whole, also if handed on in parts, and take no more memory than the shingles call for."""
    monkeypatch.setattr(ngram_join, "COUNTED", counted, raising=False)
    texts = [" ".join(f"w{(7 * i + j * j) % 997}" for j in range(300)) for i in range(200)] + [None, "", "one"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(203)), "key": list(range(203)), "text": texts})
    tracemalloc.start()
    out = list(ngram_join.sizes_and_sketch(5)(iter([batch.slice(0, 150), batch.slice(150)])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = pa.Table.from_batches(out)
    counts = found.filter(pc.is_valid(found["counts"]))
    total = np.concatenate([ngram_join.summed(counts.filter(pc.equal(counts["part"], p))) for p in range(ngram_join.SKETCH_PARTS)])
    value, _ = shingles(words(batch.column("text"), lower=True), 5)
    assert (total == np.bincount(value >> np.uint64(40), minlength=1 << 24)).all()
    assert found.num_rows - counts.num_rows == 203
    assert most < 40e6


def test_near_duplicates_sends_small_batches(spark, monkeypatch):
    """Texts reach Python in batches bounded by bytes; the session's own setting is as before."""
    texts = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("lorem ipsum "), 200), F.col("id")).alias("text")).coalesce(1)
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", ngram_join.sizes_and_sketch

    def bounded(k):
        def run(batches):
            def checked():
                for b in batches:
                    if b.nbytes > 4 << 20:
                        raise ValueError("a large batch")
                    yield b

            return sizes(k)(checked())

        return run

    monkeypatch.setattr(ngram_join, "sizes_and_sketch", bounded)
    before = spark.conf.get(key)
    assert ngram_join.near_duplicates(texts).count() == 4000
    assert spark.conf.get(key) == before


def test_crowded_near_copies_need_no_pairs_but_lose_no_link(spark):
    """A chain in which only neighbours are similar is one component."""
    words_ = [f"c{i}" for i in range(200)]
    rows_ = [(i, " ".join(words_[i * 3 : i * 3 + 100])) for i in range(30)] + [(100 + i, " ".join(["z", "y", "x", "w", "v"] + [f"u{i}_{k}" for k in range(20)])) for i in range(20)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    sets = {d: shingle_set(t) for d, t in rows_}
    assert any(len(sets[i] & sets[i + 1]) * 100 >= 80 * len(sets[i] | sets[i + 1]) for i in range(29))
    component = {r["doc_id"]: r["component_id"] for r in got}
    for i in range(29):
        linked = 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])
        assert not linked or component[i] == component[i + 1]
    assert all(component[100 + i] == 100 + i for i in range(20))


def test_packing_round_trip(both):
    df, plain = both
    tokenizer = packing.encoder(TOKENIZER)
    want = Counter()
    for d, t, _ in plain:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        n, start, piece = len(ids), 0, 0
        while start < n:
            length = (n - 1) % 64 + 1 if start == 0 else 64
            want[(d, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
            start, piece = start + length, piece + 1
    got = packing.pack(df, TOKENIZER, capacity=64, with_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.05 * math.ceil(sum(r["length"] for r in got) / 64) + 1


def test_very_long_runs_of_one_character_are_packed_whole(spark):
    texts = [c * 1_000_000 for c in " \n\u00a0a1-"] + ["a" + " " * 20_000 + "b", None]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER, with_ids=True).collect()
    tokenizer = packing.encoder(TOKENIZER)
    for i, t in enumerate(texts):
        ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"]))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_best_fit_plan_equals_one_piece_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 33, int(rng.integers(1, 200))).tolist()
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, room in enumerate(bins) if room >= n]
            if fits:
                i = min(fits, key=lambda i: bins[i])
                bins[i] -= n
            else:
                bins.append(32 - n)
        runs, count = packing.plan(dict(Counter(lengths)), 32)
        rooms = [32] * count
        for length, a, b, first, per, _ in runs:
            for i in range(b - a):
                rooms[first + i // per] -= length
        assert min(rooms) >= 0 and sorted(rooms) == sorted(bins)


def test_language_is_learned_and_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_texts(both):
    df, plain = both
    got = langid.identify(df).collect()
    want = Counter((d, langid.in_fold(d, 0), any(map(str.isalpha, t or ""))) for d, t, _ in plain)
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"] != "und") for r in got) == want


def test_code_lengths_are_of_a_distribution():
    """The next byte's probabilities, over all bytes, sum to one in every context."""
    text = np.frombuffer(b"abracadabra abracadabra banana", np.uint8)
    a, b, c, y = (g.astype(np.int64) for g in langid.grams(text, np.array([0, len(text)])))
    code, n = np.unique(((a * 257 + b) * 257 + c) * 257 + y, return_counts=True)
    m = langid.compile_model(["x"], np.zeros(len(code), np.int64), code, n)
    p = 2.0 ** -m.bits[:, :, 0].astype(float)
    known = m.bits.shape[1] - 2
    total = p[:, 1:-1].sum(1) + p[:, -1] * (256 - known)
    assert np.allclose(total, 1, atol=1e-5)


def test_lm_base_and_sums(both):
    df, plain = both
    counts = Counter()
    for d, t, _ in plain:
        if not langid.in_fold(d, 1):
            counts.update([*lowered(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t, _ in plain:
        tokens = [*lowered(t), "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[(d, langid.in_fold(d, 1), len(tokens), sum(counts[w] > 0 for w in tokens), n, f"{base:.5f}")] += 1
    old, hmm_lm.TOP = hmm_lm.TOP, 500
    try:
        got = hmm_lm.score(df, rounds=1).collect()
    finally:
        hmm_lm.TOP = old
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.5f}") for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_forward_equals_enumeration_and_expectations_add_up():
    rng = np.random.default_rng(0)
    start, move, emit = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.3], [0.2, 0.6]])
    sequence, bounds = rng.integers(0, 3, 11), np.array([0, 5, 5 + 6])
    got = hmm_lm.forward(start, move, emit, sequence, bounds)
    for k in range(2):
        s = sequence[bounds[k] : bounds[k + 1]]
        total = 0.0
        for path in np.ndindex(*[2] * len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= move[path[t - 1], path[t]] * emit[s[t], path[t]]
            total += p
        assert got[k] == pytest.approx(math.log10(total))
    starts, moves, emitted = hmm_lm.expect(start, move, emit, sequence, bounds)
    assert starts.sum() == pytest.approx(2) and moves.sum() == pytest.approx(9) and emitted.sum() == pytest.approx(11)


def test_segments_count_each_start_and_move_once():
    rng = np.random.default_rng(1)
    start, move = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]])
    emit = rng.dirichlet(np.ones(5), 2).T
    sequence, bounds = rng.integers(0, 5, 900), np.array([0, 700, 701, 900])
    whole, parts = [], []
    for size, out in ((10_000, whole), (64, parts)):
        old, hmm_lm.SEGMENT = hmm_lm.SEGMENT, size
        try:
            out.extend(hmm_lm.expect(start, move, emit, sequence, bounds))
        finally:
            hmm_lm.SEGMENT = old
        assert out[0].sum() == pytest.approx(3, abs=1e-3) and out[1].sum() == pytest.approx(897, abs=1e-2) and out[2].sum() == pytest.approx(900, abs=1e-2)
    assert all(np.allclose(a, b, atol=0.05) for a, b in zip(whole, parts, strict=True))


def test_the_chain_over_pairs_explains_them():
    pairs = np.zeros((hmm_lm.CLASSES + 2, hmm_lm.CLASSES + 1))
    pairs[0, 1] = pairs[1, 0] = 500
    pairs[2, 2] = 300
    pairs[-1, 0] = 10
    start, move, emit = hmm_lm.class_chain(pairs)
    assert start.sum() == pytest.approx(1) and np.allclose(move.sum(1), 1) and np.allclose(emit.sum(0), 1)
    post = start @ move
    assert (np.argmax(emit[0] * start) != np.argmax(emit[2] * post)) or emit[2].max() > 0.3


def test_substring_dedup(both):
    df, plain = both
    df = df.unionByName(df.sparkSession.createDataFrame([(5000, "z " * 3000)], "doc_id long, text string"), allowMissingColumns=True)
    plain = [*plain, (5000, "z " * 3000, None)]
    for crowd, run in ((1 << 20, 1 << 20), (1, 100)):
        old, (substring.CROWD, substring.RUN) = (substring.CROWD, substring.RUN), (crowd, run)
        try:
            got = substring.remove_repeats(df).collect()
        finally:
            substring.CROWD, substring.RUN = old
        texts = [split(t) for _, t, _ in plain]
        starts = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
        want = Counter()
        for (d, _, _), w in zip(plain, texts, strict=True):
            gone = {j for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in got) == want


def test_automaton_counts_places():
    a = substring.Automaton()
    a.add("a b a b a".encode().split(), 1)
    a.add("b a b".encode().split(), 3)
    a.close()
    assert a.repeated(b"a b a b a".split(), 3) == [True, True, True]
    assert a.repeated(b"a a b".split(), 3) == [False]


def test_quality_base(both):
    df, plain = both
    want = Counter()
    for d, t, _ in plain:
        w, t = split(t), t or ""
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = quality.clean(df, with_text=True).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_quality_keeps_good_and_rejects_poor(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.clean(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] > 0.99 and share[0] < 0.2


def duck(spark, sql, docs, benchmark=None):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    if benchmark is not None:
        con.register("benchmark", benchmark.toArrow())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in found.fetchall())


def test_line_dedup(spark, both):
    df = both[0].where("doc_id is not null and text is not null").select("doc_id", "text")
    got = line_dedup.remove_repeated_lines(df).select("doc_id", F.md5("kept_text").alias("kept_md5"), "n_lines", "n_removed").distinct().collect()
    con_rows = sorted(set(duck(spark, line_dedup.ORACLE_SQL, df)))
    assert sorted(repr([r[c] for c in ("doc_id", "kept_md5", "n_lines", "n_removed")]) for r in got) == con_rows


def test_line_dedup_of_awkward_rows(spark):
    got = {(r["doc_id"], r["text"]): (r["n_removed"], r["kept_text"]) for r in line_dedup.remove_repeated_lines(documents(spark)).collect()}
    one = rows()[0][1]
    assert got[(1, one)] == (0, one) and got[(2, one)] == (4, "")
    assert got[(14, rows()[16][1])] == (3, rows()[16][1].split("\n")[0])
    three = {(r["doc_id"], r["text"]): r["n_removed"] for r in line_dedup.remove_repeated_lines(documents(spark), words=None).collect()}
    assert three[(2, one)] == 4 and three[(14, rows()[16][1])] == 3 and three[(7, "one two three")] == 0
    assert got[(3, None)] == (0, None) and got[(4, "")] == (0, "")


def test_decontamination(spark, both):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = spark.createDataFrame([(900, "one two three"), (901, None), (902, ""), (903, " ".join(f"p{i}" for i in range(40)))], "item_id long, text string")
    bench = bench.unionByName(short)
    df = both[0].select("doc_id", "text")
    got = decontam.contaminated(df, bench).select("doc_id", "item_id", "start", "length", F.round("similarity", 6).alias("similarity")).collect()
    want = duck(spark, decontam.ORACLE_SQL, df.where("doc_id is not null"), bench)
    plain = lambda r: repr([r[c] for c in ("doc_id", "item_id", "length", "similarity", "start")])
    assert sorted(plain(r) for r in got if r["doc_id"] is not None) == want
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(11, 903), (12, 903), (6, 900)}


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = np.random.default_rng(6)
    pairs = []
    for flips in (0, 5, decontam.RADIUS):
        for x in map(int, rng.integers(-(2**63), 2**63 - 1, 20)):
            pairs.append((x, x ^ sum(1 << int(b) for b in rng.choice(63, flips, replace=False))))
    found = spark.createDataFrame(pairs, "x long, y long").select(decontam.blocks(F.col("x")).alias("x"), decontam.blocks(F.col("y")).alias("y")).collect()
    assert all(any(a == b for a, b in zip(r["x"], r["y"], strict=True)) for r in found)


def test_items_of_more_shingles_than_a_lane_counts(spark):
    words_ = [f"v{i % 900}" for i in range(5000)]
    bench = spark.createDataFrame([(1, " ".join(words_))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([*words_, "tail"])), (2, " ".join(words_[:2000]))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in decontam.contaminated(docs, bench).collect()] == [(1, 1, 0)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@x.y", "1.2.3.4.5.6.7.8", "0001.2.3.255", "999.1.1.1.2", "a+b@c-d.e..f", "x@y z@w.q", "é@b.co ü.ö@x.y1", "12@3.4.5.6", "a@b a@b.c"])
def test_patterns_are_leftmost(text):
    assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]
    want = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    assert pii.base_spans(text)["ip"] == want


def test_pii_of_awkward_rows_and_held_out_accuracy(spark):
    model = pii.trained()
    got = {r["doc_id"]: r for r in pii.find(documents(spark), model).collect()}
    r = got[10]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    text = rows()[12][1]
    base = [(k, text.index(v), text.index(v) + len(v)) for k, v in (("email", "bob@site.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100"))]
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    test = pii.drawn(np.random.default_rng(77), 60)
    found = pii.model_spans(model, [t for t, _ in test])
    hit = sum(len(set(s) & set(f)) for (_, s), f in zip(test, found, strict=True))
    assert hit >= 0.9 * sum(len(s) for _, s in test) and hit >= 0.9 * sum(map(len, found))


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    p = pii.fresh(rng)
    x, y = rng.integers(0, pii.SYMBOLS, (6, 2)), rng.integers(0, pii.TAGS, (6, 2))
    _, grad = pii.step(p, x, y)
    for name in ("embed", "xf", "hb", "cf", "out", "move"):
        flat = p[name].reshape(-1)
        i = int(rng.integers(0, len(flat)))
        keep, eps = flat[i], 1e-5
        flat[i] = keep + eps
        up, _ = pii.step(p, x, y)
        flat[i] = keep - eps
        down, _ = pii.step(p, x, y)
        flat[i] = keep
        assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), abs=1e-4)


def test_licenses_and_inheritance(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "no word of it"), (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "z/y.txt", "plain"), (5, "a/k.txt", "prose first. Licensed under CC BY-NC 4.0. and more"), (6, None, "x"), (7, "a/e.txt", None), (7, "a/e.txt", None)]
    got = {r["doc_id"]: (r["own"], r["license"], r["inherited_from"]) for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "MIT", None)
    assert got[2] == (None, "GPL-3.0", "a/b")
    assert got[4] == (None, None, None) and got[6] == (None, None, None)
    assert got[5][0] == "CC-BY-NC-4.0" and got[7] == (None, "MIT", "a")


@pytest.mark.parametrize("name", ["near", "pack", "lang", "lm", "license", "lines", "decontam", "pii", "substring", "quality"])
def test_empty_tables(spark, name):
    docs = empty(spark)
    run = {
        "near": lambda: ngram_join.near_duplicates(docs),
        "pack": lambda: packing.pack(docs, TOKENIZER),
        "lang": lambda: langid.identify(docs),
        "lm": lambda: hmm_lm.score(docs),
        "license": lambda: license_scan.scan(docs.withColumn("path", F.col("source"))),
        "lines": lambda: line_dedup.remove_repeated_lines(docs),
        "decontam": lambda: decontam.contaminated(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).union(decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string"))),
        "pii": lambda: pii.find(docs, pii.fresh(np.random.default_rng(0))),
        "substring": lambda: substring.remove_repeats(docs),
        "quality": lambda: quality.clean(docs),
    }[name]
    assert run().collect() == []


def test_components_in_one_part_and_in_several(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for p in pairs for x in p}
    alone = {a for a, b in pairs if a == b}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for size in (500_000, 60):
        old, runtime.CONTRACTED = runtime.CONTRACTED, size
        try:
            got = {tuple(r) for r in runtime.components(edges).collect()}
        finally:
            runtime.CONTRACTED = old
        assert {x for x in want if x[0] not in alone} <= got <= want
