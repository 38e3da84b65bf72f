"""Operator 8: toxicity by a bidirectional gated recurrent network.

A word's input is the sum of two hashed word vectors (two, so that hardly any
two words agree in both) and the mean of the hashed vectors of its character
trigrams. Windows of ``WIDTH`` words, each starting
``STEP`` after the one before (twice that in training), cover every whole text, so
any run of ``WIDTH - STEP + 1`` words lies whole in one; two gated recurrent
layers read a window in both directions, attention pools their states, and a
document's score is that of its highest window. All of it, training included,
is numpy.

Labels are of documents, windows get theirs from them: a window of a toxic
document counts as toxic if it has a telling word or beginning of a word (picked one by one, each the
word that marks most of the toxic training documents left unmarked), windows of other documents count as clean, the rest is not
used. The fit is on a bounded sample: ``DOCS`` labelled documents of either
kind, those with the least hashes of their ids among those of up to
``LONGEST`` characters, and ``WINDOWS`` windows of either kind. Scoring takes
every whole text. Inputs of the gates are worked out once for each distinct
word and remembered (``CACHE`` words a worker).

Defined results: a null text counts as empty; a text without words has one
window of padding and its score; with no usable label of both kinds the score is
0; rows are scored one by one, so repeated rows give repeated results; a null id
is not held out; other columns are not inputs; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage, table
from .quality import held_out

WIDTH, STEP = 32, 8
DIM, HID, ATT = 16, 8, 8
WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 12
DOCS, LONGEST, WINDOWS, CACHE, BATCH = 1500, 20_000, 3000, 150_000, 1024
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")


class _Grams(dict):
    """Slot of each trigram met, up to ``CACHE`` of them."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        slot = self[gram] = zlib.crc32(gram.encode()) % GRAM_SLOTS
        return slot


_gram_slot = _Grams()


def slots(word: str) -> tuple[list[int], list[int]]:
    """Slots of a word's two vectors and of its trigrams."""
    w = f"^{word}$"
    raw = w.encode()
    h = zlib.crc32(raw)
    return [h % WORD_SLOTS, zlib.adler32(raw, h) * 2654435761 % (1 << 32) % WORD_SLOTS], [_gram_slot[w[i : i + 3]] for i in range(max(1, len(w) - 2))]


def _row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their number in ``rows``, 0 to n - 1."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        at = rows[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiGru:
    """Parameters: word and character vectors, per direction input and state
    weights of the gates (update, reset, new), attention and output."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        n = lambda *s, k=0.3: r.normal(0, k, s).astype(np.float32)
        z = lambda *s: np.zeros(s, np.float32)
        self.p = {"ew": n(WORD_SLOTS, DIM, k=0.05), "ec": n(GRAM_SLOTS, DIM, k=0.05), "wa": n(2 * HID, ATT), "ba": z(ATT), "va": n(ATT), "wo": n(2 * HID), "bo": z(1)}
        for d in "fb":
            self.p |= {"w" + d: n(DIM, 3 * HID), "b" + d: z(3 * HID), "u" + d: n(HID, 3 * HID)}

    def inputs(self, where: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """Vectors of words, given the ``slots`` of each."""
        out = np.empty((len(where), DIM), np.float32)
        for a in range(0, len(where), 8192):
            part = where[a : a + 8192]
            size = np.array([len(g) for _, g in part])
            grams = self.p["ec"][np.fromiter((x for _, g in part for x in g), np.int64, int(size.sum()))]
            means = np.add.reduceat(grams, np.cumsum(size) - size, axis=0) / size[:, None]
            out[a : a + 8192] = self.p["ew"][np.array([w for w, _ in part])].sum(1) + means
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input part of the gates, both directions."""
        return np.concatenate([x @ self.p["w" + d] + self.p["b" + d] for d in "fb"], 1)

    def run(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows. ``gates``: a row for each distinct word;
        ``index`` (steps, windows) picks rows; ``mask`` tells words from padding."""
        steps, n = index.shape
        both = np.empty((steps, n, 2 * HID), np.float32)
        for k, d in enumerate("fb"):
            u, h = self.p["u" + d], np.zeros((n, HID), np.float32)
            part = gates[:, 3 * HID * k : 3 * HID * (k + 1)]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g, s = part[index[t]], h @ u
                zr = _sig(g[:, : 2 * HID] + s[:, : 2 * HID])
                zt, rt = zr[:, :HID], zr[:, HID:]
                nt = np.tanh(g[:, 2 * HID :] + rt * s[:, 2 * HID :])
                m = mask[t][:, None]
                new = h + m * (1 - zt) * (nt - h)
                if tape is not None:
                    tape[d, t] = (h, zt, rt, nt, s[:, 2 * HID :])
                h = new
                both[t, :, HID * k : HID * (k + 1)] = h
        a = np.tanh(both @ self.p["wa"] + self.p["ba"])
        e = np.where(mask > 0, a @ self.p["va"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        c = (alpha[:, :, None] * both).sum(0)
        if tape is not None:
            tape["att"] = (both, a, alpha, c)
        return c @ self.p["wo"] + self.p["bo"]

    def backward(self, tape: dict, index: np.ndarray, mask: np.ndarray, dlogit: np.ndarray, n_words: int) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the rows of ``gates``."""
        both, a, alpha, c = tape["att"]
        g = {"wo": c.T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
        dc = np.outer(dlogit, self.p["wo"])
        dalpha = (both * dc).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["va"] = (a * de[:, :, None]).sum((0, 1))
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        flat = da.reshape(-1, ATT)
        g["wa"], g["ba"] = both.reshape(-1, 2 * HID).T @ flat, flat.sum(0)
        dboth = alpha[:, :, None] * dc + da @ self.p["wa"].T
        dgates = np.zeros((n_words, 6 * HID), np.float32)
        steps, n = index.shape
        block = np.empty((steps, n, 3 * HID), np.float32)
        for k, d in enumerate("fb"):
            u, du, dh = self.p["u" + d], np.zeros((HID, 3 * HID), np.float32), np.zeros((n, HID), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, zt, rt, nt, sn = tape[d, t]
                m = mask[t][:, None]
                dh = dh + dboth[t, :, HID * k : HID * (k + 1)]
                dn = dh * m * (1 - zt) * (1 - nt * nt)
                dz = -dh * m * (nt - h) * zt * (1 - zt)
                dr = dn * sn * rt * (1 - rt)
                ds = np.concatenate([dz, dr, dn * rt], 1)
                block[t] = np.concatenate([dz, dr, dn], 1)
                du += h.T @ ds
                dh = dh * (1 - m * (1 - zt)) + ds @ u.T
            g["u" + d] = du
            dgates[:, 3 * HID * k : 3 * HID * (k + 1)] = _row_sums(block.reshape(-1, 3 * HID), index.ravel(), n_words)
        return g, dgates

    def fit(self, windows: list[list[str]], y: np.ndarray, epochs: int = 3, rate: float = 0.006, seed: int = 3) -> BiGru:
        rng, m1, m2, t = np.random.default_rng(seed), {}, {}, 0
        known = {w: slots(w) for w in {w for ws in windows for w in ws}}
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                names = sorted({w for i in pick for w in windows[i]})
                row = {w: j for j, w in enumerate(names)}
                where = [known[w] for w in names]
                x = self.inputs(where) if names else np.zeros((1, DIM), np.float32)
                index, mask = np.zeros((WIDTH, len(pick)), np.int64), np.zeros((WIDTH, len(pick)), np.float32)
                for j, i in enumerate(pick):
                    k = len(windows[i])
                    index[:k, j], mask[:k, j] = [row[w] for w in windows[i]], 1
                tape: dict = {}
                logit = self.run(self.gates(x), index, mask, tape)
                g, dg = self.backward(tape, index, mask, ((_sig(logit) - y[pick]) / len(pick)).astype(np.float32), len(x))
                dx = np.zeros_like(x)
                for k, d in enumerate("fb"):
                    part = dg[:, 3 * HID * k : 3 * HID * (k + 1)]
                    g["w" + d], g["b" + d] = x.T @ part, part.sum(0)
                    dx += part @ self.p["w" + d].T
                for name, k in (("ew", 0), ("ec", 1)):  # of the tables, only the rows that occur are touched
                    rows, back = np.unique(np.concatenate([x[k] for x in where] or [[0]]).astype(np.int64), return_inverse=True)
                    share = np.repeat(dx, [len(x[k]) for x in where], 0) / (np.repeat([len(x[k]) for x in where], [len(x[k]) for x in where])[:, None] if k else 1)
                    v = _row_sums(share, back[: len(share)], len(rows))
                    held = m2.setdefault(name, np.full(self.p[name].shape, 1e-8, np.float32))
                    held[rows] += v * v
                    self.p[name][rows] -= (5 * rate * v / np.sqrt(held[rows])).astype(np.float32)
                t += 1
                for k, v in g.items():
                    a, b = m1.setdefault(k, np.zeros_like(v)), m2.setdefault(k, np.zeros_like(v))
                    a += 0.1 * (v - a)
                    b += 0.001 * (v * v - b)
                    self.p[k] -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows_of(words: list[str], step: int = 2 * STEP) -> list[list[str]]:
    """Overlapping windows to train on; the last ends with the text."""
    if len(words) <= WIDTH:
        return [words]
    starts = [*range(0, len(words) - WIDTH, step), len(words) - WIDTH]
    return [words[i : i + WIDTH] for i in starts]


class Scorer:
    """Scores texts; holds the gates' inputs of the words it has met."""

    def __init__(self, model: BiGru):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.rows = np.zeros((1 << 12, 6 * HID), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            if len(self.at) + len(new) > CACHE:
                self.clear()
                new = list(dict.fromkeys(words))
            n = len(self.at)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(new)] = self.model.gates(self.model.inputs([slots(w) for w in new]))
            self.at.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def windows(self, windows: list[list[str]]) -> np.ndarray:
        """A score for each window."""
        out = []
        for a in range(0, len(windows), BATCH):
            part = windows[a : a + BATCH]
            index = np.full((len(part), WIDTH), -1, np.int64)
            index[np.array([[k < len(w) for k in range(WIDTH)] for w in part])] = self.ids([x for w in part for x in w])
            out.append(_sig(self.model.run(self.rows, np.maximum(index.T, 0), (index.T >= 0).astype(np.float32))))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window of each text."""
        best = np.full(len(texts), -np.inf)
        index, owner, held = [], [], 0

        def flush() -> None:
            nonlocal index, owner, held
            if not held:
                return
            rows, who = np.concatenate(index), np.concatenate(owner)
            for a in range(0, len(rows), BATCH):
                part = np.ascontiguousarray(rows[a : a + BATCH].T)
                np.maximum.at(best, who[a : a + BATCH], _sig(self.model.run(self.rows, np.maximum(part, 0), (part >= 0).astype(np.float32))))
            index, owner, held = [], [], 0

        for k, text in enumerate(texts):
            words = WORD.findall(text.lower())
            if held and len(self.at) + len(words) > CACHE:  # ids may change
                flush()
                self.clear()
            for a in range(0, max(len(words), 1), 50 * BATCH * STEP):  # a very long text in overlapping pieces
                ids = self.ids(words[a : a + 50 * BATCH * STEP + WIDTH])
                n = len(ids)
                if n <= WIDTH:
                    rows = np.full((1, WIDTH), -1, np.int64)
                    rows[0, :n] = ids
                else:
                    starts = np.append(np.arange(0, n - WIDTH, STEP), n - WIDTH)
                    rows = ids[starts[:, None] + np.arange(WIDTH)]
                index.append(rows)
                owner.append(np.full(len(rows), k))
                held += len(rows)
                if held >= 4 * BATCH or len(words) > 50 * BATCH * STEP:
                    flush()
        flush()
        return best


def parts(word: str) -> list[str]:
    """A word and its beginnings of 4 to 8 characters."""
    return [word, *(word[:k] + "~" for k in range(4, min(len(word), 9)))]


def telling(words: list[list[str]], toxic: list[int]) -> set[str]:
    """Words and beginnings of words that mark toxic documents: again and again
    the one that occurs in most of the toxic documents left unmarked, among
    those eight times as frequent there as among clean ones. What only goes along
    with these marks nothing new and is not picked."""
    n = Counter(toxic)
    sets = [{p for w in set(ws) for p in parts(w)} for ws in words]
    left = [ws for ws, y in zip(sets, toxic) if y]
    clean = Counter(p for ws, y in zip(sets, toxic) if not y for p in ws)
    all_toxic = Counter(p for ws in left for p in ws)
    good = {p for p, c in all_toxic.items() if c >= 3 and c / n[1] > 8 * (clean[p] + 0.5) / n[0]}
    left = [ws & good for ws in left]
    out: set[str] = set()
    while left:
        gain = Counter(p for ws in left for p in ws)
        best = min(gain.items(), key=lambda x: (-x[1], -len(x[0]), x[0]), default=("", 0))
        if best[1] < max(3, 0.01 * n[1]):
            break
        out.add(best[0])
        left = [ws for ws in left if best[0] not in ws]
    return out | {p for p in good if out and all_toxic[p] >= max(5, 0.05 * n[1]) and all_toxic[p] / n[1] > 50 * (clean[p] + 0.5) / n[0]}


def train(texts: list[str], toxic: list[int], seed: int = 5) -> BiGru | None:
    """A model from documents and their labels; None unless both kinds occur."""
    words = [WORD.findall(t.lower()) for t in texts]
    n = Counter(toxic)
    if not n[0] or not n[1]:
        return None
    strong = telling(words, toxic)
    tells = {x for x in {x for ws in words for x in ws} if any(p in strong for p in parts(x))}
    pos, neg, hard = [], [], []
    for ws, y in zip(words, toxic):
        for w in windows_of(ws):
            told = not tells.isdisjoint(w)
            if y and told:
                pos.append(w)
            elif not y:
                (hard if told else neg).append(w)
    rng = np.random.default_rng(seed)
    pos, hard = ([x[i] for i in rng.permutation(len(x))[:WINDOWS]] for x in (pos, hard))
    neg = [neg[i] for i in rng.permutation(len(neg))]
    clean = [neg[i] for i in rng.permutation(len(neg))[: 8 * WINDOWS]] + hard
    neg = neg[:WINDOWS] + hard
    if not pos or not neg:
        return None
    model = BiGru().fit([*pos, *neg], np.array([1] * len(pos) + [0] * len(neg), np.float32), epochs=2)
    for _ in range(2):  # what it takes for toxic by mistake joins the clean windows
        scorer = Scorer(model)
        worst = np.argsort(-scorer.windows(clean), kind="stable")[:WINDOWS]
        neg = neg[: 2 * WINDOWS] + [clean[i] for i in worst]
        model.fit([*pos, *neg], np.array([1] * len(pos) + [0] * len(neg), np.float32), epochs=1)
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> BiGru | None:
    """A model from labelled rows that are not held out."""
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    free = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("id"), modulus, remainder) & F.col("toxic").isin(0, 1))
    short = text.select("id", F.length("text").alias("n")).where(F.col("n") <= LONGEST)
    pool = stage(free.join(short, "id").groupBy("id").agg(F.max("toxic").alias("toxic")), "pool")
    some = [pool.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(DOCS) for k in (0, 1)]
    sample = stage(some[0].unionByName(some[1]), "sample")  # 2 * DOCS rows at most
    got = text.join(F.broadcast(sample), "id").where(F.length("text") <= LONGEST).groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["id"])
    return train([r["text"] for r in got], [r["toxic"] for r in got])


def score(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """``doc_id, score`` for each row."""
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    sent = spark.sparkContext.broadcast(model)  # about 3 MB, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for b in batches:
            texts = b.column(1).to_pylist()
            s = scorer.score(texts) if scorer and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, f"doc_id {kind}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
