"""A corpus pipeline of five stages over ``documents``.

Each stage gets the rows that the stage before kept; all but the last return the
columns of ``documents``, the last one the ids of the pieces of each text and
the text that they decode to. Between stages ``run`` writes the rows to the
shared folder and reads them again.

Each row is judged by itself: where a stage decides by more than the row's own
text, each row has a key of its own (its file and place), so rows that repeat an
id or have a null one neither stay nor go together. Whole rows are not shuffled
to be filtered: only the keys of those that go meet them.

Defined results
  * a null text counts as empty; its row stays or goes like any other text;
  * of equal texts the longest stays, then the least id, null ids last, then the
    first row; of a class of near-duplicates the least id, in the same order;
  * a benchmark window in a row drops that row alone;
  * all but the last stage return all columns of ``documents``, others too; names
    that begin with two underscores are the pipeline's own;
  * without labels every row scores 0.5 and passes; without a benchmark nothing is
    contaminated; empty documents give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.llm import decontaminate, exact_dedup, near_dedup, pieces, quality
from tallyrill.llm.common import BATCHES, keyed, stage, table


def _place() -> Column:
    """The order in which one row of a group is picked."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__key").alias("key"))


def _few_at_once(spark: SparkSession) -> None:
    """Stages follow each other on the same executors, whose Python workers keep
    what they have loaded: rows pass to and from them 1024 at a time, unless the
    session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) in ("10000", BATCHES[key][1]):
        spark.conf.set(key, "1024")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` less those whose key is in the one column of ``gone``."""
    return rows.join(stage(gone.toDF("__key"), "gone"), "__key", "left_anti").drop("__key")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents below the threshold of quality go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    _few_at_once(spark)
    return quality.accepted(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts one stays."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_index_{uuid.uuid4().hex}")
    kept = index.dedup(keyed(docs).withColumn("__place", _place()), "__place").drop("__key", "__place")
    index.drop()  # the rows that go are known by now
    return kept


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of near-duplicates the least id stays."""
    _few_at_once(spark)
    rows = keyed(docs)
    classes = near_dedup.near_duplicates(rows, "__key").where("class_size > 1").select(F.col("doc_id").alias("__key"), "class_id")
    twins = stage(classes.join(rows.select("__key", "doc_id"), "__key"), "twins")
    best = twins.groupBy("class_id").agg(F.min(_place()).alias("best"))
    return _without(rows, twins.join(best, "class_id").where("__key <> best.key").select("__key"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a benchmark window go."""
    rows = keyed(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), "__key")
    return _without(rows, found.where("contaminated").select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ``doc_id``, the ids of the pieces, and the decoded text."""
    import public_tokenizers

    _few_at_once(spark)
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", dedup),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier's scores and the pieces cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
