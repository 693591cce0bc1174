"""Personal data: exact patterns, and a character BiLSTM with a CRF that adds what they miss.

Emails, IP addresses, cards and phone numbers all hold a digit or an @, so the network reads windows
around those characters only; nothing else can be a span. Windows overlap; each span decoded in any
of them is a candidate, and candidates of a whole text are reconciled by margin, greatest first,
without overlaps. Pattern spans always stay. The network is trained in numpy from labelled spans,
by default on drawn texts in which the spans' places are known.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import plain
from .words import process_store

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and characters between the starts of two.
WINDOW, STRIDE = 96, 48
HIDDEN, EMBED = 16, 8
STEPS, BATCH, RATE = 400, 24, 0.03
SEED = 5
#: A decoded span counts if its tags score above `outside` by so much, on average.
MARGIN = 0.5
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", re.A)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails where a run of digits begins fails inside the run as well.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Pattern spans by kind, in order."""
    found = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found["phone"].append(m.span())
    return found


def codes(text: str) -> np.ndarray:
    """A class for each character: digits, letters, and the marks that spans are made of."""
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = np.zeros(128, np.int64)
    table[48:58], table[65:91], table[97:123] = 1, 2, 3
    for i, mark in enumerate("@.-_+()% :/\n\""):
        table[ord(mark)] = 4 + i
    return np.where(wide < 128, table[np.minimum(wide, 127)], 17)


SYMBOLS = 18


def drawn(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of invented words with spans of known places, and look-alikes that are none."""
    word = lambda: "".join(rng.choice(list("etaoinshrdlucmfwypvbgk"), rng.integers(2, 9)))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            pick = rng.random()
            kind, body = None, word() + str(rng.choice(["", "", ",", "."]))
            if pick < 0.06:
                kind, body = "email", f"{word()}{rng.choice(['.', '_', ''])}{digits(rng.integers(0, 3))}@{word()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk'])}"
            elif pick < 0.12:
                kind, body = "ip", ".".join(str(x) for x in rng.integers(1, 256, 4))
            elif pick < 0.18:
                sep = str(rng.choice(["", " ", "-"]))
                number = digits(15)
                number += next(d for d in "0123456789" if luhn(number + d))
                kind, body = "card", sep.join(number[i : i + 4] for i in range(0, 16, 4))
            elif pick < 0.24:
                kind, body = "phone", str(rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]))
            elif pick < 0.32:
                hexed = "".join(rng.choice(list("0123456789abcdef"), rng.integers(8, 40)))
                body = str(rng.choice([f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.", digits(rng.integers(1, 5)), f'"{hexed}"', digits(rng.integers(20, 24)), f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}"]))
            if kind:
                spans.append((kind, len(text), len(text) + len(body)))
            text += body + str(rng.choice([" ", " ", " ", "\n"]))
        out.append((text[: WINDOW + 48], [s for s in spans if s[2] <= WINDOW + 48]))
    return out


def tag_ids(spans, length: int) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[a : min(b, length)] = k + 1
        if a < length:
            tags[a] = k
    return tags


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"embed": rng.normal(0, 0.5, (SYMBOLS, EMBED)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": rng.normal(0, 0.1, (TAGS, TAGS))}
    for side in ("f", "b"):
        p["x" + side], p["h" + side], p["c" + side] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN)), rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)
        p["c" + side][HIDDEN : 2 * HIDDEN] = 1.0
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(p: dict, side: str, codes_: np.ndarray):
    """Hidden states (time, batch, HIDDEN) of one direction, and what its gradient needs."""
    inputs = (p["embed"] @ p["x" + side] + p["c" + side])[codes_]
    h = c = np.zeros((codes_.shape[1], HIDDEN))
    states, kept = [], []
    for z in inputs:
        z = z + h @ p["h" + side]
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, old = h, c
        c = f * c + i * g
        t = np.tanh(c)
        h = o * t
        states.append(h)
        kept.append((i, f, o, g, t, old, before))
    return np.array(states), kept


def lstm_back(p: dict, side: str, codes_: np.ndarray, kept, dh: np.ndarray, grad: dict) -> None:
    next_h = next_c = np.zeros((codes_.shape[1], HIDDEN))
    dx = np.zeros((SYMBOLS, 4 * HIDDEN))
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, tc, old, before = kept[t]
        d = dh[t] + next_h
        dc = d * o * (1 - tc * tc) + next_c
        dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        grad["h" + side] += before.T @ dz
        np.add.at(dx, codes_[t], dz)
        next_h, next_c = dz @ p["h" + side].T, dc * f
    grad["x" + side] += p["embed"].T @ dx
    grad["c" + side] += dx.sum(0)
    grad["embed"] += dx @ p["x" + side].T


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def scores(p: dict, codes_: np.ndarray):
    hf, kf = lstm(p, "f", codes_)
    hb, kb = lstm(p, "b", codes_[::-1])
    both = np.concatenate([hf, hb[::-1]], 2)
    return both @ p["out"] + p["bias"], both, kf, kb


def step(p: dict, codes_: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Negative log-likelihood of the tags under the CRF, and its gradient."""
    s, both, kf, kb = scores(p, codes_)
    time, batch = codes_.shape
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0]
    for t in range(1, time):
        alpha[t] = s[t] + log_sum(alpha[t - 1][:, :, None] + p["move"][None], 1)
    for t in range(time - 2, -1, -1):
        beta[t] = log_sum(p["move"][None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
    total = log_sum(alpha[-1], 1)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    ds = np.exp(alpha + beta - total[None, :, None])
    rows = np.arange(batch)
    gold = s[0][rows, tags[0]].copy()
    for t in range(1, time):
        grad["move"] += np.exp(alpha[t - 1][:, :, None] + p["move"][None] + (s[t] + beta[t] - total[:, None])[:, None, :]).sum(0)
        np.add.at(grad["move"], (tags[t - 1], tags[t]), -1)
        gold += p["move"][tags[t - 1], tags[t]] + s[t][rows, tags[t]]
    for t in range(time):
        ds[t][rows, tags[t]] -= 1
    grad["out"] += both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS)
    grad["bias"] += ds.sum((0, 1))
    dh = ds @ p["out"].T
    lstm_back(p, "f", codes_, kf, dh[:, :, :HIDDEN], grad)
    lstm_back(p, "b", codes_[::-1], kb, dh[::-1, :, HIDDEN:], grad)
    return float((total - gold).mean()), {k: v / batch for k, v in grad.items()}


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]] | None = None, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters from texts with labelled spans (kind, start, end); by default drawn ones. Adam, with
    windows of WINDOW characters cut at random places."""
    rng = np.random.default_rng(seed)
    labelled = labelled or drawn(rng, 600)
    coded = [(codes(t), tag_ids(spans, len(t))) for t, spans in labelled]
    p = fresh(rng)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for n in range(1, steps + 1):
        picked = [coded[i] for i in rng.integers(0, len(coded), BATCH)]
        x, y = np.full((BATCH, WINDOW), SYMBOLS - 1), np.zeros((BATCH, WINDOW), np.int64)
        for row, (c, t) in enumerate(picked):
            at = int(rng.integers(0, max(1, len(c) - WINDOW + 1)))
            own = t[at : at + WINDOW].copy()
            x[row, : len(own)] = c[at : at + WINDOW]
            y[row, : len(own)] = own
        _, grad = step(p, x.T, y.T)
        norm = max(1.0, np.sqrt(sum((g * g).sum() for g in grad.values())) / 5)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g / norm
            second[k] = 0.99 * second[k] + 0.01 * (g / norm) ** 2
            rate = RATE * (1 - n / (steps + 1)) ** 0.5
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    return p


def trained() -> dict[str, np.ndarray]:
    """The default parameters, trained once in a process."""
    kept = process_store()
    if "pii" not in kept:
        kept["pii"] = train()
    return kept["pii"]


def decode(p: dict, codes_: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
    """Spans (kind, start, end, margin) on the best path of each window (codes_: batch, time)."""
    s, *_ = scores(p, codes_.T)
    time, batch, _ = s.shape
    best, back = s[0], []
    for t in range(1, time):
        paths = best[:, :, None] + p["move"][None]
        back.append(paths.argmax(1))
        best = paths.max(1) + s[t]
    tags = np.empty((time, batch), np.int64)
    tags[-1] = best.argmax(1)
    for t in range(time - 2, -1, -1):
        tags[t] = back[t][np.arange(batch), tags[t + 1]]
    out = []
    for b in range(batch):
        spans, t, row = [], 0, tags[:, b]
        while t < time:
            if row[t] % 2 == 1:
                end = t + 1
                while end < time and row[end] == row[t] + 1:
                    end += 1
                margin = float((s[t:end, b][np.arange(end - t), row[t:end]] - s[t:end, b, 0]).mean())
                spans.append((KINDS[row[t] // 2], t, end, margin))
                t = end
            else:
                t += 1
        out.append(spans)
    return out


def plausible(kind: str, body: str) -> bool:
    digits = sum(c in "0123456789" for c in body)
    if kind == "email":
        return "@" in body[1:-1] and "." in body
    if kind == "ip":
        return body.count(".") == 3 and digits >= 4 and all(p.isdigit() and int(p) <= 255 for p in body.split(".") if len(p) < 4) and all(len(p) < 4 for p in body.split("."))
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(c for c in body if c in "0123456789"))
    return 8 <= digits <= 15 and any(c in "+()-. " for c in body)


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows: each digit or @ has STRIDE characters after it in one of them, and
    before it STRIDE or what the window before holds."""
    out, upto = [], -1
    for m in TRIGGER.finditer(text):
        at = m.start()
        if at < upto:
            continue
        start = max(0, at - STRIDE) if not out else max(at - STRIDE, out[-1] + STRIDE // 2)
        out.append(start)
        upto = start + WINDOW - STRIDE
    return out


def model_spans(p: dict, texts: list[str], batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Reconciled spans of each text by the network alone."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    candidates: list[dict] = [{} for _ in texts]
    for a in range(0, len(jobs), batch):
        some = jobs[a : a + batch]
        x = np.full((len(some), WINDOW), SYMBOLS - 1)
        for row, (i, s) in enumerate(some):
            own = codes(texts[i][s : s + WINDOW])
            x[row, : len(own)] = own
        for (i, s), spans in zip(some, decode(p, x), strict=True):
            for kind, b, e, margin in spans:
                cut_off = (b == 0 and s > 0) or (e == WINDOW and s + e < len(texts[i]))
                if margin >= MARGIN and not cut_off and plausible(kind, texts[i][s + b : s + e]):
                    key = (kind, s + b, s + e)
                    candidates[i][key] = max(margin, candidates[i].get(key, margin))
    out = []
    for found in candidates:
        chosen: list[tuple[str, int, int]] = []
        for kind, b, e in sorted(found, key=lambda k: (-found[k], k[1], k[2], k[0])):
            if all(e <= x[1] or b >= x[2] for x in chosen):
                chosen.append((kind, b, e))
        out.append(chosen)
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(documents: DataFrame, model: dict[str, np.ndarray] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one for each row of documents.

    Counts and base_sha256 are of the patterns' spans; spans lists those and the network's that
    overlap none of them, n_spans counts both. Places are code points, ends exclusive. Null and empty texts have none;
    repeated rows are judged alike; of candidates with equal margins the first by place stays. Texts of
    any length are read whole; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(plain(doc_id).alias("doc_id"), plain(text).alias("text"))
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            hit = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
            base = [{k: [] for k in KINDS}] * len(texts)
            extra: list[list] = [[]] * len(texts)
            for i in hit:
                base[i] = base_spans(texts[i])
            for i, spans in zip(hit, model_spans(p, [texts[i] for i in hit]), strict=True):
                taken = [s for v in base[i].values() for s in v]
                extra[i] = [s for s in spans if all(s[2] <= b or s[1] >= e for b, e in taken)]
            own = [[(k, b, e) for k in KINDS for b, e in v[k]] for v in base]
            counts = [pa.array([len(v[k]) for v in base], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in own], pa.string())
            every = pa.array([listed(s + x) for s, x in zip(own, extra, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, every, pa.array([len(s) + len(x) for s, x in zip(own, extra, strict=True)], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
