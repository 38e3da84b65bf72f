"""Operator 7: quality classifier by positive-unlabelled learning.

Trusted positives are documents that ``labels`` marks with quality 1; the other
input is unlabelled text of the corpus. A small network over surface features
(lengths, shares of characters, repetition of words, word pairs and lines)
minimises the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with logistic loss; where the second part falls below zero its gradient is
turned round. The class prior is estimated from positives and unlabelled text
alone: a first model is fitted without a quarter of the positives and half of the
unlabelled rows, and over all scores the least ratio of the share of held-back
unlabelled rows at or above it to the share of held-back positives there bounds
the prior (with a confidence bound, whose level is a parameter). Labels of 0 are not used.

The fit is on a bounded sample: ``POSITIVES`` labelled and ``UNLABELLED`` other
rows, those with the least hashes of their ids, of which only feature vectors
reach the driver. Scoring takes every whole text. The hold-out rule is a
parameter (modulus and remainder of crc32 of the id as text).

Defined results: a null text counts as empty; empty texts get the score of
their features like all others; with no usable label the score is 0.5; rows are
scored one by one, so repeated rows give repeated results; an id that is null is
not held out; other columns are not inputs; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage, table

POSITIVES, UNLABELLED, HIDDEN, THRESHOLD = 4000, 8000, 16, 0.3
MARKS = "!*#$%&|.,;:?'\"-_/\\()[]{}<>=+@~^\n\t0123456789"
UPPER = bytes(range(65, 91)) + bytes(range(0xC0, 0xDF))


def features(text: str) -> list[float]:
    """Surface features of a whole text; shares are per character, word or line."""
    chars, words = max(len(text), 1), text.split()
    n = max(len(words), 1)
    counts, lines = Counter(words), text.split("\n")
    raw = text.encode("latin-1", "replace")
    marks = [text.count(c) / chars for c in MARKS[:-10]]
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(len(words)), math.log1p(len(text)), sum(map(len, words)) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, pairs / max(n - 1, 1), 1 - len(set(lines)) / len(lines), math.log1p(len(text) / len(lines)),
        (len(raw) - len(raw.translate(None, UPPER))) / chars, sum(text.count(c) for c in MARKS[-10:]) / chars, *(math.sqrt(m) for m in marks),
    ]


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def risk(par: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple:
    """Both parts of the risk, that of positives and that of negatives, and
    their gradients by the parameters."""

    def grads(x, d, h):
        dh = np.outer(d, par[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    hp, hu = np.tanh(xp @ par[0] + par[1]), np.tanh(xu @ par[0] + par[1])
    gp, gu = hp @ par[2] + par[3], hu @ par[2] + par[3]
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    up = grads(xp, -prior * (1 - sp) / len(xp), hp)
    down = [a + b for a, b in zip(grads(xu, su / len(xu), hu), grads(xp, -prior * sp / len(xp), hp))]
    return positive, negative, up, down


class PuModel:
    """One hidden layer; fitted with Adam on the non-negative risk."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    @classmethod
    def fit(cls, pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.01, seed: int = 7) -> PuModel:
        rng = np.random.default_rng(seed)
        mean, scale = unl.mean(0), unl.std(0) + 1e-3
        p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
        par = [rng.normal(0, 1 / math.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        m1, m2, t = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par], 0

        for _ in range(epochs):
            steps = max(1, len(u) // 512)
            pp, uu = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
            for ip, iu in zip(pp, uu):
                if not len(ip):
                    continue
                xp, xu = p[ip], u[iu]
                positive, negative, up, down = risk(par, xp, xu, prior)
                g = [-x for x in down] if negative < 0 else [a + b for a, b in zip(up, down)]
                t += 1
                for k, x in enumerate(g):
                    x = x + 1e-4 * par[k]
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * x, 0.999 * m2[k] + 0.001 * x * x
                    par[k] = par[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        return cls(mean, scale, *par)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2)))


def _featured(df: DataFrame, keep: str) -> DataFrame:
    """Columns of ``keep`` (a schema) and the features of column ``text``."""
    names = [x.split()[0] for x in keep.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(rows, pa.list_(pa.float64()))], [*names, "f"])

    return df.mapInArrow(work, f"{keep}, f array<double>")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> PuModel | None:
    """A model from rows that are not held out; None without positives."""
    ship(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    free = labels.select(F.col("doc_id").alias("id"), "quality").where(~held_out(F.col("id"), modulus, remainder) & F.col("quality").isNotNull())
    least = lambda df, seed, n: df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    pos = least(free.where("quality = 1").select("id").distinct(), 1, POSITIVES).withColumn("kind", F.lit(1))
    unl = least(text.select("id").where(~held_out(F.col("id"), modulus, remainder) & F.col("id").isNotNull()).distinct(), 2, UNLABELLED).withColumn("kind", F.lit(0))
    sample = stage(pos.unionByName(unl), "sample")  # POSITIVES + UNLABELLED rows at most
    # One row for each id and kind, in one order: the model does not depend on partitions.
    got = _featured(text.join(F.broadcast(sample), "id").select("id", "kind", "text"), f"id {kind}, kind int")
    got = sorted(got.groupBy("kind", "id").agg(F.min("f").alias("f")).collect(), key=lambda r: (r["kind"], r["id"]))
    x = {k: np.array([r["f"] for r in got if r["kind"] == k]) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return None
    return PuModel.fit(x[1], x[0], prior_of(x[1], x[0]))


def prior_of(pos: np.ndarray, unl: np.ndarray, doubt: float = 0.1) -> float:
    """The class prior of ``unl``, given positives: the best bound over all
    thresholds on scores of a model that has not seen the rows it is taken on, a
    quarter of ``pos`` and a half of ``unl``."""
    held, half = np.arange(len(pos)) % 4 == 0, np.arange(len(unl)) % 2 == 0
    if held.all() or half.all():
        return 0.5
    model = PuModel.fit(pos[~held], unl[~half], 0.5, epochs=20)
    p, u = np.sort(model.score(pos[held])), np.sort(model.score(unl[half]))
    share_p = 1 - np.arange(len(p)) / len(p)  # at or above each score of p
    share_u = 1 - np.searchsorted(u, p) / len(u)
    wide = sum(math.sqrt(math.log(4 / doubt) / (2 * len(x))) for x in (u, p))
    k = int(np.argmin((share_u + wide) / share_p))
    return float(min(max(share_u[k] / share_p[k], 0.02), 0.98))


def score(docs: DataFrame, model: PuModel | None) -> DataFrame:
    """``doc_id, score`` for each row."""
    ship(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            s = model.score(np.array([features(t) for t in texts])) if model and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: PuModel | None, least: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they
    are; judged as they are read, without a shuffle."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            s = model.score(np.array([features(t) for t in texts])) if model and texts else np.full(len(texts), 0.5)
            yield b.filter(pa.array(s >= least))

    return docs.mapInArrow(work, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
