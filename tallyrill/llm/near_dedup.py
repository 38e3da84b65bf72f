"""Operator 6: near-duplicates by DartMinHash.

A document is the multiset of its runs of ``SHINGLE`` = 5 words; its similarity
to another is the weighted Jaccard of the two multisets. The region of an
element of weight c on the weight axis is cut into unit cells (element, 1..c).
Onto the strip above each cell darts fall as a Poisson process of rate 1 that
the cell's hash drives, so equal cells get equal darts. A dart has a rank (its
height) and a coordinate; the dart of least rank in each of ``COORDS``
coordinates is the signature. Only darts below a height of ``DARTS`` over the
document's total weight are thrown, about k ln k + 2k for each document whatever
its length; where a coordinate stays empty, the height is raised.

``BANDS`` bands of ``ROWS`` coordinates: documents of similarity 0.8 share none
with a probability under 1e-4. Documents of equal multisets are first reduced to
one representative. In each bucket every member is paired with the least and
with the greatest id (two pairs a member). The best pair of each document is
verified exactly, and components are formed; pairs whose ends are then in two
components are verified next. In buckets whose other members still lie in
several components, all pairs of these that components part are compared too, in
blocks of ``BLOCK`` by ``BLOCK`` members, each pair in the first bucket it
shares; so no two texts that share a bucket stay uncompared. Components grow by
hooking and pointer jumping over tables in the shared folder.

Defined results
  * a null text counts as empty; texts of 1 to 4 words are one shingle; texts
    without words are classes of their own, one for each id;
  * equal multisets are one class; a class is named by its least id;
  * rows that repeat an id are one document, whose multiset is that of its
    longest text; rows with a null id are classes of their own;
  * other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import adler32, crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ranges, ship, small, stage, table

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 5, 25
COORDS = ROWS * BANDS
DARTS = COORDS * np.log(COORDS) + 2 * COORDS
CACHE = 100_000
#: Members and cells of one side of a block, about.
BLOCK, BLOCK_CELLS = 512, 1 << 20
#: Up to so many ids of candidates (8 bytes each) are broadcast; beyond that all texts are shuffled.
BROADCAST_ROWS = 1_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Hashes(dict):
    """Hash of each word met, up to ``CACHE`` of them."""

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        value = crc32(raw) << 32 | crc32(raw, adler32(raw) ^ 0x5BD1E995)
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


_words = _Hashes()


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of all texts: hashes, sorted within each text, and how many each text has."""
    lists = [t.lower().split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((_words[w] for x in lists for w in x), U, int(sizes.sum()))
    flat = mix(flat)
    n = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(lists)), n)
    first = np.cumsum(sizes) - sizes
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(owner), U)
    for k in range(SHINGLE):
        inside = at + k < (first + sizes)[owner]
        h = mix(h * U(31) + np.where(inside, flat[np.minimum(at + k, len(flat) - 1)], U(k + 1))) if len(flat) else h
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))  # 0, 1, .. within equal shingles
    h = mix(h + run.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.lexsort((h, owner))
    return h[order], n


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, COORDS) hashes of the earliest darts; texts without cells have zeros."""
    docs = len(n)
    sig, rank = np.zeros(docs * COORDS, U), np.full(docs * COORDS, np.inf)
    owner = np.repeat(np.arange(docs), n)
    height = DARTS / np.maximum(n, 1)
    low = np.zeros(len(h))  # rank of each cell's last dart
    count = np.zeros(len(h), np.int64)
    active = np.arange(len(h))
    while len(active):
        live = active
        while len(live):
            seed = mix(h[live] ^ ((count[live].astype(U) + U(1)) * U(0xD6E8FEB86659FD93)))
            step = -np.log1p(-((seed >> U(11)).astype(np.float64) * 2.0**-53))
            here = low[live] + step
            hit = here < height[owner[live]]
            live, seed, here = live[hit], seed[hit], here[hit]
            low[live] = here
            count[live] += 1
            dart = mix(seed + U(0xA0761D6478BD642F))
            key = owner[live] * COORDS + (dart % U(COORDS)).astype(np.int64)
            np.minimum.at(rank, key, here)
            won = rank[key] == here
            sig[key[won]] = dart[won]
        short = np.isinf(rank.reshape(docs, COORDS)).any(1) & (n > 0)
        height[short] *= 1.5
        active = np.flatnonzero(short[owner])
    return sig.reshape(docs, COORDS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes, the band's number mixed in."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * U(0x9FB21C651E98DF25) + parts[:, :, k])
    return out.view(np.int64)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _sums(h: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Two sums of hashes for each text, which tell multisets apart."""
    sums = np.zeros((2, len(n)), U)
    owner = np.repeat(np.arange(len(n)), n)
    np.add.at(sums[0], owner, h)
    np.add.at(sums[1], owner, mix(h ^ U(0x1234567890ABCDEF)))
    return [pa.array(x.view(np.int64), pa.int64()) for x in sums]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 1):
        h, n = cells(b.column(1).to_pylist())
        keys = band_keys(signatures(h, n)) if len(n) else np.zeros((0, BANDS), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *_sums(h, n), _lists(keys.ravel(), np.full(len(n), BANDS))], ["id", "n", "s1", "s2", "keys"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in small(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack.compress(x) for x in b.column(1).to_pylist()], pa.binary())], ["id", "packed"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in small(batches, 1, 1 << 19):
        h, n = cells([unpack.decompress(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(h, n), *_sums(h, n)], ["id", "cells", "s1", "s2"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, root`` of all ``id`` of nodes, given edges ``a, b``; the root is
    the least id of the component."""
    return _joined(nodes.select("id", F.col("id").alias("root")), edges)


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (``id, root``) with the components that ``links`` tie made one.

    The links become edges between roots. Each round every root takes the least
    one among its neighbours, roots hook onto lesser roots, and pointers jump.
    What a round needs more than once is kept on the executors and made again if
    they are lost; each round's result is written."""
    root_of = lambda c: found.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    edges = links.select("a", "b").join(root_of("a"), "a").join(root_of("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    both = stage(edges.union(edges.select("b", "a")).distinct(), "edges")
    roots = both.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = roots.join(near, roots["id"] == near["a"], "left").select("id", "root", F.least("root", F.coalesce("r", "root")).alias("low")).persist()
        hook = step.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("to")).where("to < of").persist()
        if hook.limit(1).count() == 0:
            break
        # A node's root is replaced by the least root seen from its tree, then by that one's own.
        jump = hook.join(hook.select(F.col("of").alias("to"), F.col("to").alias("further")), "to", "left").select("of", F.coalesce("further", "to").alias("to"))
        roots = stage(step.join(jump, step["root"] == jump["of"], "left").select("id", F.least("low", F.coalesce("to", "low")).alias("root")), "roots")
        step.unpersist()
        hook.unpersist()
    step.unpersist()
    hook.unpersist()
    up = roots.select(F.col("id").alias("root"), F.col("root").alias("top"))
    return stage(found.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "components")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of similarity THRESHOLD or more, measured exactly."""
    left = pairs.join(bags.select(F.col("id").alias("a"), F.col("cells").alias("x")), "a")
    both = left.join(bags.select(F.col("id").alias("b"), F.col("cells").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("sim")).where(F.col("sim") >= THRESHOLD).select("a", "b")


def _compare(block: pa.Table) -> pa.Table:
    """The links ``a, b`` among the members of one block: pairs of its two sides
    that lie in two components, have this bucket as the first in common, and
    are of similarity THRESHOLD or more."""
    block = block.combine_chunks()
    key, i, j = (block.column(c)[0].as_py() for c in ("key", "i", "j"))
    ids, roots, side = (block.column(c).to_numpy() for c in ("id", "root", "g"))
    cells_of = block.column("cells").combine_chunks()
    keys = block.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
    ends = cells_of.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    n = np.diff(ends)
    codes = np.unique(cells_of.flatten().to_numpy(), return_inverse=True)[1]
    mark = np.zeros(len(codes), bool)
    right, found = np.flatnonzero(side == j), []
    for a in np.flatnonzero(side == i):
        other = right[right > a] if i == j else right
        other = other[roots[other] != roots[a]]
        other = other[np.minimum(n[other], n[a]) / np.maximum(n[other], n[a]) >= THRESHOLD]
        same = keys[other] == keys[a]
        other = other[~same.any(1) | (keys[a][same.argmax(1)] == key)]
        if not len(other):
            continue
        mine = codes[ends[a] : ends[a + 1]]
        mark[mine] = True
        starts = np.cumsum(n[other]) - n[other]
        common = np.add.reduceat(mark[codes[ranges(ends[other], ends[other + 1])]], starts, dtype=np.int64)
        mark[mine] = False
        found += [(ids[a], ids[b]) for b in other[common / (n[a] + n[other] - common) >= THRESHOLD]]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _settled(met: DataFrame, lone: DataFrame, found: DataFrame, bags: DataFrame) -> DataFrame | None:
    """The links ``a, b`` between components among members of a bucket that are
    not its ends; None where no bucket has such members. What is joined by id
    has one row for each id, whose buckets are a list of up to ``BANDS``."""
    inner = met.where("id <> first AND id <> last").groupBy("id").agg(F.collect_list("key").alias("inside"))
    inner = stage(inner.join(found, "id").join(lone.select("id", "n"), "id"), "inside").select("id", "root", "n", F.explode("inside").alias("key"))
    groups = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_CELLS)).cast("int").alias("groups")
    loose = inner.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), groups).where("low < high").select("key", "groups")
    dealt = inner.join(loose, "key").groupBy("id", "root").agg(F.collect_list(F.struct("key", "groups")).alias("inside"))
    dealt = stage(dealt, "loose")
    if dealt.limit(1).count() == 0:
        return None
    whole = dealt.join(bags, "id").join(lone.select("id", "keys"), "id").select("id", "root", "cells", "keys", F.explode("inside").alias("of"))
    whole = whole.select("of.*", "id", "root", "cells", "keys").withColumn("g", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    sides = whole.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    sides = sides.select("key", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "g", "id", "root", "cells", "keys")
    return stage(sides.groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept``: a row for each distinct id."""
    ship(docs.sparkSession)
    if not isinstance(docs.select(id_col).schema[0].dataType, IntegralType):
        raise TypeError(f"{id_col} is no whole number")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stage(text.mapInArrow(_sketch, "id long, n long, s1 long, s2 long, keys array<long>"), "sketches")
    # One text for each id, and one id for each multiset, with its keys.
    known = rows.where("n > 0 AND id IS NOT NULL")
    full = stage(known.groupBy("id").agg(F.max(F.struct("n", "s1", "s2")).alias("x")).select("id", "x.*"), "longest")
    reps = stage(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "representatives")
    member = stage(full.join(reps, ["s1", "s2", "n"]).select("id", "rep"), "members")
    lone = known.join(reps.withColumnRenamed("rep", "id"), ["id", "s1", "s2", "n"]).select("id", "n", "keys")
    lone = stage(lone.dropDuplicates(["id"]), "signatures")
    # Buckets of representatives that hold two or more, and their pairs.
    banded = lone.select("id", F.explode("keys").alias("key"))
    ends = banded.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    met = stage(banded.join(ends, "key"), "buckets")
    paired = met.select("id", F.explode(F.array("first", "last")).alias("with")).where("id <> with")
    pairs = stage(paired.select(F.least("id", "with").alias("a"), F.greatest("id", "with").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("bands")), "pairs")
    some = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # Whole texts of candidates go packed to where their ids are. Few ids are met by broadcast, before that.
    some = stage(some, "candidates")
    wanted = text.join(F.broadcast(some), "id", "left_semi") if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else text
    packed = wanted.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_pack, "id long, packed binary")
    bags = stage(packed.join(some.hint("merge"), "id").mapInArrow(_cells, "id long, cells array<long>, s1 long, s2 long").groupBy("id").agg(F.max_by("cells", F.struct(F.size("cells"), "s1", "s2")).alias("cells")), "bags")
    # The pair of most bands of each later document first, then what still parts components.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a")).select("a", "b")
    found = components(lone, _verified(best, bags))
    apart = _apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), found)
    more = stage(_verified(apart, bags), "links")
    if more.limit(1).count():
        found = _joined(found, more)
    # Then what the ends of the buckets do not settle.
    inside = _settled(met, lone, found, bags)
    if inside is not None and inside.limit(1).count():
        found = _joined(found, inside)
    named = member.select("id", "rep").join(found.select(F.col("id").alias("rep"), "root"), "rep").select("id", F.col("root").alias("class_id"))
    sizes = stage(named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"), F.min("id").alias("least")), "sizes")
    named = named.join(sizes, "class_id").select("id", F.col("least").alias("class_id"), "class_size")
    everyone = rows.select("id").distinct()
    alone = F.coalesce("class_id", F.col("id"))
    return everyone.join(named, "id", "left").select(F.col("id").alias("doc_id"), alone.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("id").eqNullSafe(alone).alias("kept"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in two components."""
    known = pairs.join(found.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(found.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    return known.where("ra <> rb").select("a", "b")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
