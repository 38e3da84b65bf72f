"""Operator 5: removal of repeated strings of ``LENGTH`` = 200 bytes.

Each byte goes that lies in a 200-byte string which also starts anywhere else in
the corpus. The suffixes to compare are first dealt out so that equal ones meet:

1.  In each window of 200 bytes the leftmost least hash of its 32-byte grams is
    the window's anchor; equal windows have equal anchors at equal places. The
    windows of one anchor are neighbours and form a block: a row (hash of the
    anchor's gram, hash of the block, where).
2.  Grams that occur once are done: nothing in their blocks repeats. Blocks that
    occur more than once, by their 128-bit BLAKE2 digest, are repeats as a whole.
    What is left are single blocks beside others of the same gram, at the edges
    of repeats.
3.  The texts of these blocks meet by gram. There the suffixes are sorted by
    mergesort; two of them are compared by binary search over prefix polynomial
    hashes for the length of their common start, and by the byte after it.
    Neighbours with 200 bytes in common are compared byte by byte (collisions)
    and are repeats.

No task sorts more than ``GROUP`` blocks of one key. Where more of them share a
gram, the windows are parted by their distance to the anchor, the near half and
the far half. All windows of one half share the bytes between the start of the
last and the end of the first of them, so equal windows agree in these, and
blocks cut to that half meet by the digest of these bytes instead of the gram.
Step 2 is repeated on them, then step 3, and halves with too many blocks are
halved again. After eight turns a half is one window, whose bytes are its key.

Memory is bounded by pieces of ``PIECE`` bytes, whatever the length of a text.

Defined results
  * a null text counts as empty; texts under 200 bytes lose nothing;
  * equal texts remove each other, all of them; matches never cross texts;
  * rows that repeat an id are texts of their own;
  * other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage, table
from .near_dedup import mix

LENGTH, GRAM = 200, 32
PIECE, GROUP, SORT_BYTES = 1 << 20, 2000, 1 << 20
#: The distances of a window's anchor to its start.
FAR = LENGTH - GRAM
U = np.uint64
#: An odd base of the polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15


class Hashes:
    """Prefix polynomial hashes of a buffer: any substring's hash in two steps."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data) + 1
        power = np.full(n, U(base), U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.inverse = np.full(n, U(pow(base, -1, 1 << 64)), U)
        self.inverse[0] = 1
        self.inverse = np.multiply.accumulate(self.inverse)
        self.sums = np.zeros(n, U)
        np.add.accumulate((mix_bytes[data]) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


#: Each byte value stands for a scrambled 64-bit number.
mix_bytes = mix(np.arange(1, 257, dtype=U) * U(0xFF51AFD7ED558CCD))


def anchors(data: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
    """Of one text or piece: gram hash, the two halves of the block's digest,
    first and last start of each anchor's windows, and the anchor, counted from
    ``begin``."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (U, U, U, np.int32, np.int32, np.int32))
    h = Hashes(data)
    grams = mix(h.of(np.arange(len(data) - GRAM + 1), GRAM))
    least = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)  # ties go to the left
    width, have = LENGTH - GRAM + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    at = at[first]
    digest = digests(memoryview(data), first.tolist(), (last + LENGTH).tolist())
    return grams[at], digest[:, 0], digest[:, 1], *((x + begin).astype(np.int32) for x in (first, last, at))


def digests(data: memoryview, first: list[int], end: list[int]) -> np.ndarray:
    """(parts, 2) halves of the digests of parts of ``data``."""
    found = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first, end)])
    return np.frombuffer(found, U).reshape(-1, 2)


def _bytes_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["r1", "r2", "gram", "b1", "b2", "first", "last", "at"]

    def made(rows: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U else c) for c in cols], names)

    for b in batches:
        rows, held = [], 0
        for r1, r2, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _bytes_of(b.column(2))):
            for a in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
                got = anchors(data[a : a + PIECE + LENGTH - 1], a)
                rows.append((np.full(len(got[0]), r1, np.int64), np.full(len(got[0]), r2, np.int64), *got))
                held += len(got[0])
                if held > 50_000:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)


def common_start(h: Hashes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common start of suffixes i and j, up to 255: binary search
    by hashes. Both have LENGTH bytes at least; more is never asked for."""
    k = np.zeros(len(i), np.int64)
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        fits = k + step <= LENGTH
        a, b = np.where(fits, i + k, i), np.where(fits, j + k, j)
        k += np.where(fits & (h.of(a, step) == h.of(b, step)), step, 0)
    return k


def suffix_sort(data: np.ndarray, h: Hashes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes by group, then by their first LENGTH bytes, then by
    place: bottom-up mergesort of all groups at once. An element's place in a
    merged run is its own rank and its rank in the run beside it, found by binary
    search."""

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = common_start(h, at[x], at[y])
        full = k >= LENGTH
        k = np.minimum(k, LENGTH - 1)
        return np.where(full, x < y, data[at[x] + k] < data[at[y] + k])

    order = np.argsort(group, kind="stable")
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(g)))
    begin, end = np.repeat(start, size), np.repeat(start + size, size)
    width = 1
    while len(size) and width < size.max():
        k = np.flatnonzero(end - begin > width)
        t = k - begin[k]
        run = t // width
        beside = begin[k] + (run ^ 1) * width
        lo, hi = np.zeros(len(k), np.int64), np.clip(end[k] - beside, 0, width)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            below = less(order[beside[open_] + mid], order[k[open_]])
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        merged = order.copy()
        merged[begin[k] + (run & ~1) * width + t - run * width + lo] = order[k]
        order, width = merged, width * 2
    return order


def repeated(texts: list[bytes], groups: list[int], anchor: list[int]) -> list[np.ndarray]:
    """Of each text of ``groups``, which of its windows another text of its
    group also has. Equal windows have their anchor at one place, hence suffixes
    are sorted among those with the same distance to their anchor; ``anchor`` is
    that of each text's first window."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + (np.cumsum(sizes) - sizes)[owner]
    h, group = Hashes(data), np.unique(np.array(groups), return_inverse=True)[1][owner] * LENGTH + np.array(anchor)[owner] - (at - (np.cumsum(sizes) - sizes)[owner])
    order = suffix_sort(data, h, at, group)
    hit = np.zeros(len(at), bool)
    x, y = order[:-1], order[1:]
    same = np.flatnonzero((group[x] == group[y]) & (h.of(at[x], LENGTH) == h.of(at[y], LENGTH)))
    span = np.arange(LENGTH)
    for a in range(0, len(same), 4096):  # hashes may collide, bytes may not
        k = same[a : a + 4096]
        k = k[(data[at[x[k]][:, None] + span] == data[at[y[k]][:, None] + span]).all(1)]
        hit[x[k]] = hit[y[k]] = True
    return np.split(hit, np.cumsum(windows)[:-1])


def _spans(hit: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered bytes (from, to) of runs of repeated windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2] + first, edge[1::2] + first + LENGTH - 1


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as ``_cut`` gives them, sorted by their key; whole groups at a time."""
    held: list[tuple] = []
    size = 0

    def work() -> pa.RecordBatch:
        k1, k2, _, _, r1, r2, first, at, text = zip(*held)
        of = {k: i for i, k in enumerate(dict.fromkeys(zip(k1, k2)))}
        out: list[tuple] = []
        for x, y, begin, hit in zip(r1, r2, first, repeated(text, [of[k] for k in zip(k1, k2)], [a - f for a, f in zip(at, first)])):
            out += [(x, y, int(a), int(b)) for a, b in zip(*_spans(hit, begin))]
        return _spans_of(out)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > SORT_BYTES and row[:2] != held[-1][:2]:
                yield work()
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
    if held:
        yield work()


def _spans_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], ["r1", "r2", "a", "b"])


#: Blocks with their texts: key, range of distances, row, first window, anchor, text.
BLOCKS = "k1 long, k2 long, lo int, hi int, r1 long, r2 long, first long, at long"
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]


def _blocks_of(rows: list[tuple], digest: bool = False) -> pa.RecordBatch:
    kinds = [*KINDS, *[pa.int64()] * (2 * digest), pa.binary()]
    names = [x.split()[0] for x in BLOCKS.split(", ")] + ["b1", "b2"] * digest + ["text"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of blocks; the key is the gram."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for r1, r2, packed, parts in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpack.decompress(packed)
            rows = [(p["gram"], 0, 0, FAR, r1, r2, p["first"], p["at"], text[p["first"] : p["last"] + LENGTH]) for p in parts]
            for a in range(0, len(rows), 5000):
                yield _blocks_of(rows[a : a + 5000])


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks cut to either half of their range of distances, with digests."""
    for batch in batches:
        out: list[tuple] = []
        for _, _, lo, hi, r1, r2, first, at, text in zip(*(c.to_pylist() for c in batch.columns)):
            last, mid = first + len(text) - LENGTH, (lo + hi) // 2
            for near, far in ((lo, mid), (mid + 1, hi)):
                a, b = max(first, at - far), min(last, at - near)
                if near > far or a > b:
                    continue
                shared = text[at - near - first : at - far + LENGTH - first]  # by all windows of this half
                key = np.frombuffer(blake2b(shared, digest_size=16, salt=bytes([near, far])).digest(), np.int64).tolist()
                part = text[a - first : b + LENGTH - first]
                digest = np.frombuffer(blake2b(part, digest_size=16).digest(), np.int64).tolist()
                out.append((*key, near, far, r1, r2, a, at, *digest, part))
        for a in range(0, len(out), 5000):
            yield _blocks_of(out[a : a + 5000], True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([pack.compress(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())], b.schema.names)


def repeat_spans(rows: DataFrame) -> DataFrame:
    """``r1, r2, a, b``: bytes to remove, as spans that may overlap, of rows
    ``r1, r2, data`` (two hashes that name a row, ``data`` binary)."""
    found = stage(rows.mapInArrow(_anchor_rows, "r1 long, r2 long, gram long, b1 long, b2 long, first int, last int, at int"), "anchors")
    same = (F.min("b1") == F.max("b1")) & (F.min("b2") == F.max("b2"))
    live = stage(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), same.alias("alike")).where("n > 1").select("gram", "alike"), "grams")
    beside = stage(found.join(live, "gram"), "live-anchors")
    span = lambda df: df.select("r1", "r2", F.col("first").cast("long").alias("a"), (F.col("last") + LENGTH).cast("long").alias("b"))
    mixed = beside.where("NOT alike").drop("alike")
    blocks = mixed.groupBy("gram", "b1", "b2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "first", "last", "at")).alias("one"))
    blocks = stage(blocks, "blocks")
    again = mixed.join(blocks.where("n > 1").select("gram", "b1", "b2"), ["gram", "b1", "b2"])
    # One of each different block goes on, with its text.
    each = blocks.select("gram", "one.*")
    parts = each.groupBy("r1", "r2").agg(F.collect_list(F.struct("gram", "first", "last", "at")).alias("parts"))  # bounded by the text's length
    texts = rows.mapInArrow(_packed, "r1 long, r2 long, data binary").groupBy("r1", "r2").agg(F.first("data").alias("data"))
    cut = stage(texts.join(parts, ["r1", "r2"]).select("r1", "r2", "data", "parts").mapInArrow(_cut, f"{BLOCKS}, text binary"), "block-texts")
    return _settled(cut, [span(beside.where("alike")), span(again)])


def _settled(cut: DataFrame, done: list[DataFrame]) -> DataFrame:
    """The spans of ``done`` and those of different blocks, as ``_cut`` gives them."""
    key, columns = ["k1", "k2"], cut.columns
    while True:
        crowd = stage(cut.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select(key), "crowds")
        few = cut.join(crowd, key, "left_anti").select(columns)
        done.append(few.repartition(*key).sortWithinPartitions(*key).mapInArrow(_sorted_groups, "r1 long, r2 long, a long, b long"))
        if crowd.limit(1).count() == 0:
            break
        many = cut.join(crowd, key, "left_semi").select(columns)
        half = stage(many.mapInArrow(_halved, f"{BLOCKS}, b1 long, b2 long, text binary"), "halves")
        seen = stage(half.groupBy(*key, "b1", "b2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*columns)).alias("one")), "half-blocks")
        again = half.join(seen.where("n > 1").select(*key, "b1", "b2"), [*key, "b1", "b2"])
        done.append(again.select("r1", "r2", F.col("first").alias("a"), (F.col("first") + F.length("text")).alias("b")))
        beside = seen.groupBy(key).agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select(key)
        cut = stage(seen.select("one.*").join(beside, key).select(columns), "half-texts")
    return reduce(DataFrame.unionByName, done)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc, packed, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpack.decompress(packed)
            keep, at, n, removed = hashlib.sha256(), 0, 0, 0
            edges: list[list[int]] = []
            for x, y in sorted(zip(a or [], b or [])):
                if edges and x <= edges[-1][1]:
                    edges[-1][1] = max(y, edges[-1][1])
                else:
                    edges.append([x, y])
            for x, y in edges:
                keep.update(text[at:x])
                at, n, removed = y, n + 1, removed + y - x
            keep.update(text[at:])
            out.append((doc, len(text), removed, n, keep.hexdigest()))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows of one id and text have one name, and lose the same spans.
    names = F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(text, F.lit(1), F.col(id_col)).alias("r2")
    rows = docs.select(*names, F.col(id_col).alias("doc_id"), text.cast("binary").alias("data"))
    spans = repeat_spans(rows.select("r1", "r2", "data")).groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("s"))  # bounded by the text's length
    packed = rows.mapInArrow(_packed, f"r1 long, r2 long, doc_id {kind}, data binary")
    return packed.join(spans, ["r1", "r2"], "left").select("doc_id", "data", "s.a", "s.b").mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
