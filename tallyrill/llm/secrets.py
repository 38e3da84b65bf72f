r"""Operator 4: secrets in texts.

Three base kinds by pattern (assign, access, hex), and spans of kind
``entropy``: over each candidate string (a run of 20 or more of
``[A-Za-z0-9+/_=-]``) a window of ``WIDTH`` characters slides; for each class
(hex digits, letters and digits, base64) the Shannon entropy of the window is
kept up to date by counts: a character enters, one leaves, and two terms of
``sum(c log c)`` change. Windows at or above the class's bound that mix letters
and digits join into a span. Runs and spans that the allow-list knows as a whole
are dropped: UUIDs, words and short numbers between separators, short patterns
over and over, counting strings. Base spans always stay.

Defined results: a null text counts as empty (no spans); each row is looked at
for itself, so repeated rows give repeated results; offsets are code points, end
exclusive; ties in start go by kind (assign, access, hex, entropy); other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

WIDTH = 20
#: Least entropy in bits a character of a window of WIDTH, by class.
CLASSES = (("hex", frozenset("0123456789abcdefABCDEF"), 3.0), ("alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.6), ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.8))
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
SEPARATOR, WORDY, LAST = re.compile(r"[-_/=+]"), re.compile(r"[A-Za-z]?[a-z]*|\d{1,4}"), re.compile(r"[A-Za-z]?[a-z]*\d{0,4}|\d{1,8}")
PERIODIC = re.compile(r"(.{1,4})\1{4,}.{0,3}")
#: Of a counting string, so many of the steps from one character to the next are by one.
COUNTING = 0.8
TERM = [0.0] + [c * math.log2(c) for c in range(1, WIDTH + 2)]  # one more while a character enters


def entropy_windows(run: str, letters: frozenset, least: float) -> list[tuple[int, int]]:
    """Spans of ``run`` (start, end) that windows of at least ``least`` bits
    cover, among windows of characters of ``letters`` with a digit and a letter."""
    spans: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, begin, digits, alphas = 0.0, 0, 0, 0
    bound = math.log2(WIDTH) - least  # entropy = log2(WIDTH) - total / WIDTH
    for i, c in enumerate(run):
        if c not in letters:
            counts, total, begin, digits, alphas = {}, 0.0, i + 1, 0, 0
            continue
        n = counts.get(c, 0)
        total += TERM[n + 1] - TERM[n]
        counts[c] = n + 1
        digits += c.isdigit()
        alphas += c.isalpha()
        if i - begin == WIDTH:
            d = run[begin]
            n = counts[d]
            total += TERM[n - 1] - TERM[n]
            counts[d] = n - 1
            digits -= d.isdigit()
            alphas -= d.isalpha()
            begin += 1
        if i - begin == WIDTH - 1 and digits >= 2 and alphas >= 2 and total / WIDTH <= bound + 1e-9:
            if spans and spans[-1][1] >= begin:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((begin, i + 1))
    return spans


def allowed(text: str) -> bool:
    """Whether ``text`` as a whole is a UUID, words and short numbers between
    separators, a short pattern over and over, or counts up. Linear in its length."""
    if UUID.fullmatch(text) or PERIODIC.fullmatch(text):
        return True
    *parts, last = SEPARATOR.split(text)
    if LAST.fullmatch(last) and all(WORDY.fullmatch(p) for p in parts):
        return True
    return sum(ord(b) - ord(a) == 1 for a, b in zip(text, text[1:])) >= COUNTING * max(len(text) - 1, 1)


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for c in CANDIDATE.finditer(text):  # all access and long hex strings lie in candidates
        run, at = c[0], c.start()
        base = [(m.start(), m.end(), "access") for m in ACCESS.finditer(run) if len(m[0]) >= 20]
        base += [(m.start(), m.end(), "hex") for m in HEX.finditer(run) if len(m[0]) >= 24]
        out += [(at + a, at + b, k) for a, b, k in base]
        if allowed(run):
            continue
        found = sorted(s for _, letters, least in CLASSES for s in entropy_windows(run, letters, least))
        joined: list[list[int]] = []
        for a, b in found:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        out += [(at + a, at + b, "entropy") for a, b in joined if not allowed(run[a:b]) and not any(x <= a and b <= y for x, y, _ in base)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``found``: an array of (start, end, kind) for each row."""
    ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            found = [[{"start": x, "end": y, "kind": k} for x, y, k in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], ["doc_id", "found"])

    return rows.mapInArrow(work, f"doc_id {kind}, found array<struct<start:bigint,end:bigint,kind:string>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
