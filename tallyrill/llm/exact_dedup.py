"""Operator 3: exact deduplication over a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text,
with a partition for each batch that was appended. New rows are reduced to one
row for each digest, a sort-merge anti-join against the index tells which
digests are new, and these are appended. What became of each row is read back
from the index. The index side of these joins is neither shuffled nor sorted by
hash again.

A call takes its rows in two batches, the longer texts first: the row that stays
of equal texts is the longest, so whatever the second batch has of a text of the
first one goes, and the anti-join decides it. An append replaces its own batch
and an anti-join leaves its own batch out, so a call repeated under one batch
name after a failure gives the same result. One writer at a time.

Defined results
  * a null text counts as the empty text; empty texts equal each other;
  * of equal texts the longest original stays, then the smallest id; a null id
    comes after all others;
  * rows that repeat an id are rows of their own in ``group_size``, and all
    rows with the id that stays are kept;
  * a text that the index held before keeps the id that it has there, and no
    row of it is kept, not even one with that id;
  * columns other than the id and the text are not looked at, whatever their
    names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: What normalisation deletes: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
#: The rows of one digest go to so many tasks before they meet.
SALTS = 64


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, chars``: sha256 of the normalised text and the length of
    the original text in code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )


def winners(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, n`` of rows as ``digests`` gives them.

    The aggregate combines before the shuffle, so the rows of a hot digest
    shrink to one for each task."""
    return rows.groupBy("digest").agg(
        F.min(F.struct((-F.col("chars")).alias("neg"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("best"),
        F.count(F.lit(1)).alias("n"),
    ).select("digest", F.col("best.id").alias("keep_id"), "n")


class DigestIndex:
    """A persistent index: table ``name``, bucketed and sorted by digest. With a
    ``path`` its files lie there, and any later session can open it again; else
    they lie in the warehouse. There are as many buckets as shuffle partitions
    by default, so joins take the index as it lies."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def open(self, kind: str) -> None:
        """Create the table, or meet the files at ``path``; ``kind``: type of the ids."""
        if self.exists():
            return
        place = f" LOCATION '{self.path}'" if self.path else ""
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {kind}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{place}"
        )
        if self.path:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
            self.spark.catalog.recoverPartitions(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, best: DataFrame, batch: str) -> DataFrame:
        """The rows of ``best`` (one a digest) whose digest no other batch of the index has."""
        known = self.read().where(F.col("batch") != batch).select("digest").hint("merge")
        return best.join(known, "digest", "left_anti")

    def append(self, new: DataFrame, batch: str) -> None:
        """Put the rows of ``new`` in place of what this batch appended before, if anything."""
        rows = new.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").sortWithinPartitions("digest")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)

    def take(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Take the texts of ``rows`` (as ``digests`` gives them, written) that
        the index lacks; ``digest, keep_id`` of these."""
        batch = batch or uuid.uuid4().hex
        self.open(dict(rows.dtypes)["id"])
        middle = rows.agg(F.avg("chars")).first()[0] or 0.0
        for k, part in enumerate((F.col("chars") >= middle, F.col("chars") < middle)):
            self.append(self.unseen(winners(rows.where(part)), f"{batch}-{k}"), f"{batch}-{k}")
        return self.read().where(F.col("batch").isin(f"{batch}-0", f"{batch}-1")).select("digest", "keep_id")

    def dedup(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """The rows of ``df`` that stay: the best one of each text that the
        index lacks. The index then holds these texts too. Rows that the id
        cannot tell apart stay together. Only ids that go meet the whole rows."""
        rows = stage(digests(df, id_col, text_col), "rows")
        keep = self.take(rows, batch).select(F.col("keep_id").alias("__keep"))
        gone = rows.join(keep, F.col("id").eqNullSafe(F.col("__keep")), "left_anti").select(F.col("id").alias("__gone"))
        gone = stage(gone.distinct(), "gone")
        return df.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def report(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Each row of ``df`` with what became of it: ``id, keep_id, group_size,
    kept, text_sha256``. The index gets the new texts.

    Rows meet their group's result by (digest, salt): each digest has at most
    ``SALTS`` such keys, hence no task gets all rows of a hot text."""
    rows = stage(digests(df, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "rows")
    new = index.take(rows, batch)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    held = sizes.join(index.read().select("digest", "keep_id").hint("merge"), "digest")
    groups = stage(held.join(new.select("digest", F.lit(True).alias("new")), "digest", "left"), "groups")
    salted = rows.select("digest", "salt").distinct().join(groups, "digest")
    many = rows.join(salted.hint("shuffle_hash"), ["digest", "salt"])
    return many.select(
        F.col("id"), "keep_id", F.col("n").cast("long").alias("group_size"),
        (F.col("new").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    found = report(table(spark, sf_dir, "documents"), index).withColumnRenamed("id", "doc_id")
    index.drop()  # the result has what it needs of it
    return found


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS n
  FROM t
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
