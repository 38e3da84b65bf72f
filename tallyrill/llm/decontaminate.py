r"""Operator 1: benchmark decontamination by winnowing.

Texts become words (A-Z lower-cased, runs of letters, digits and all non-ASCII
characters). Of each window of ``WINDOW`` = 10 consecutive words the least hash
of its six ``GRAM`` = 5 word grams is a fingerprint. Two equal windows have the
same least hash at the same place, the leftmost one, so each span of ten or more
shared words gives a shared fingerprint, and its places tell how the texts lie to
each other. Documents' fingerprints are joined with those of the benchmark; each
match is then extended: words of document and item are compared around it,
and only windows that are equal word by word count.

An item of 1 to 9 words is a window of its own length; its fingerprint is the
hash of all its words, and documents are hashed in windows of these lengths
(nine at most) only where such items exist.

Main path: built-in DataFrame functions only.

Defined results
  * a null or empty text has no words; such a document has n_words 0 and no
    hits, such an item matches nothing;
  * repeated or tied items each count in ``n_items``; item ids are compared as
    strings, a null id as the empty string;
  * rows that repeat a document id are one document here, and what is hit in
    any of them counts once for each word position; n_words is that of the
    longest;
  * other columns are not looked at, whatever their names; empty tables give
    an empty result or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

WINDOW, GRAM = 10, 5
#: Up to so many distinct benchmark fingerprints (8 bytes each), or ids of
#: documents with candidates, are broadcast; beyond that the joins shuffle.
BROADCAST_ROWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in order. ASCII texts take the faster lower()."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def grams(n: Column, w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; empty if there are fewer."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.expr("array()").cast("array<bigint>"))


def minima(n: Column, g: Column) -> Column:
    """The least of each run of WINDOW - GRAM + 1 hashes, without repetition."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.array_min(F.slice(g, i, WINDOW - GRAM + 1))))


def minima_at(n: Column, g: Column) -> Column:
    """The leftmost least hash of each such run, with its place from 1, without
    repetition. Equal windows pick theirs at one place in the window."""
    placed = F.transform(g, lambda x, i: F.struct(x.alias("fp"), (i + 1).alias("at")))
    runs = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    least = lambda p: F.array_distinct(F.transform(runs, lambda i: F.array_min(F.slice(p, i, WINDOW - GRAM + 1))["at"]))
    return let(placed, lambda p: F.transform(least(p), lambda i: F.element_at(p, i)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for each row: a plain
    column would be inlined into the lambdas and computed at each step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each document."""
    spark = docs.sparkSession
    bench = stage(
        items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(item_text)).alias("iw"))
        .withColumn("m", F.size("iw")).where("m > 0").groupBy("iw", "m").agg(F.collect_list("item").alias("items"))
        .select(F.xxhash64("iw").alias("text_id"), "iw", "m", "items"),
        "benchmark",
    )
    # Fingerprints of the benchmark: (hash, size of its gram, text, position from 1).
    long_fp = (
        bench.where(F.col("m") >= WINDOW).select("text_id", F.explode(minima_at(F.col("m"), grams(F.col("m"), F.col("iw"), GRAM))).alias("x"))
        .select("x.fp", F.lit(GRAM).alias("size"), "text_id", F.col("x.at").alias("ipos"))
    )
    short_fp = bench.where(F.col("m") < WINDOW).select(F.xxhash64("iw").alias("fp"), (F.col("m") + 100).alias("size"), "text_id", F.lit(1).alias("ipos"))
    fps = stage(long_fp.unionByName(short_fp), "benchmark-fingerprints")
    kinds = [(r["size"], r["size"] - 100 if r["size"] > 100 else GRAM) for r in fps.select("size").distinct().collect()]  # ten at most
    known = fps.select("fp", "size").distinct()
    small = _few(known)
    hint = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    none = F.expr("cast(array() as array<struct<fp:bigint,size:int>>)")

    def prints(w: Column, size: int, length: int) -> Column:
        """Fingerprints of a document, each distinct one once."""
        n = F.size(w)
        found = F.when(n >= WINDOW, let(grams(n, w, GRAM), lambda g: minima(n, g))) if size == GRAM else F.array_distinct(grams(n, w, length))
        return F.transform(F.coalesce(found, F.expr("cast(array() as array<bigint>)")), lambda x: F.struct(x.alias("fp"), F.lit(size).alias("size")))

    marked = text.select("doc_id", let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.concat(none, *[prints(w, *k) for k in kinds]).alias("prints"))).alias("s"))
    marked = marked.select("doc_id", F.col("s.n_words").alias("n_words"), F.explode_outer("s.prints").alias("x")).select("doc_id", "n_words", F.col("x.fp").alias("fp"), F.col("x.size").alias("size"))
    seen = (
        marked
        .join(hint(known.withColumn("known", F.lit(1))), ["fp", "size"], "left")
        .groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.max("known").alias("known"))
    )
    seen = stage(seen, "documents-seen")
    some = seen.where("known = 1").select("doc_id")
    few = _few(some)

    # The texts of candidates alone are read again, their fingerprints are met with the benchmark's by place, and matches extended.
    own = F.col("doc_id").eqNullSafe(F.col("__id"))
    picked = some.withColumnRenamed("doc_id", "__id")
    near = text.join(F.broadcast(picked) if few else picked, own, "left_semi")
    near = stage(near.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w")), "candidates")
    n, w = F.col("n_words"), F.col("w")

    def placed(size: int, length: int) -> Column:
        if size == GRAM:
            found = F.transform(minima_at(n, grams(n, w, GRAM)), lambda x: F.struct(x["fp"].alias("fp"), F.lit(size).alias("size"), x["at"].alias("dpos")))
            return F.when(n >= WINDOW, found).otherwise(F.expr("cast(array() as array<struct<fp:bigint,size:int,dpos:int>>)"))
        return F.transform(grams(n, w, length), lambda x, i: F.struct(x.alias("fp"), F.lit(size).alias("size"), (i + 1).alias("dpos")))

    at = [placed(*k) for k in kinds]
    pairs = (
        near.select("doc_id", "row", F.explode(F.concat(F.expr("cast(array() as array<struct<fp:bigint,size:int,dpos:int>>)"), *at)).alias("x"))
        .select("doc_id", "row", F.col("x.fp").alias("fp"), F.col("x.size").alias("size"), F.col("x.dpos").alias("dpos"))
        .join(F.broadcast(fps) if small and _few(fps) else fps, ["fp", "size"])
        .select("doc_id", "row", "text_id", (F.col("dpos") - F.col("ipos")).alias("shift")).distinct()
    )
    pairs = stage(pairs, "alignments")
    iw, m, shift = F.col("iw"), F.col("m"), F.col("shift")
    size = F.least(m, F.lit(WINDOW))
    first, last = F.greatest(F.lit(1), 1 - shift), F.least(m, n - shift) - size + 1
    starts = F.when(first <= last, F.filter(F.sequence(first, F.greatest(first, last)), lambda i: F.slice(w, i + shift, size) == F.slice(iw, i, size)))
    spans = (
        pairs.join(near.withColumnRenamed("doc_id", "__id").withColumnRenamed("row", "__row"), own & (F.col("row") == F.col("__row")))
        .join(bench.drop("items"), "text_id")
        .select("doc_id", "text_id", "shift", size.alias("size"), starts.alias("starts")).where(F.size("starts") > 0)
    )
    spans = stage(spans, "spans")
    hit = (
        spans.select("doc_id", "size", F.explode(F.transform("starts", lambda i: i + F.col("shift"))).alias("s")).distinct()
        .select("doc_id", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("size") - 1)).alias("p")).distinct()
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    listed = (
        spans.select("doc_id", "text_id").distinct().join(bench.select("text_id", "items"), "text_id")
        .groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
        .select("doc_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    )
    found = hit.join(listed, hit["doc_id"].eqNullSafe(listed["doc_id"])).select(hit["doc_id"].alias("__id"), "n_hit", "n_items", "items_sha256")
    return seen.join(found, own, "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), it AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), sizes AS (SELECT DISTINCT least(len(w), 10) AS k FROM it WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM it WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, sizes WHERE len(w) >= k)
), m AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id
), l AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""
