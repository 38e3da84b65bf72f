"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of up to so many files (some 100 bytes each) are collected and broadcast.
FILES = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Where that is unset, a local session (tests) gets a temporary folder; on a
    cluster it is an error, as executors would not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tallyrill_folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.sparkContext._tallyrill_folder = "file://" + tempfile.mkdtemp(prefix="tallyrill-")
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than the tasks since
    the last staged table. The tables of an application lie in one folder,
    ``<shared>/tallyrill/<application id>``, which may go once it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyrill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows are whole texts here: fewer at a time than Spark takes of narrow rows.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4096")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. Where the session has Spark's defaults, its readers
    take smaller batches from here on."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, name: str = "__key") -> DataFrame:
    """``docs`` and a column ``name``: a whole number of its own for each row,
    the number of its file and its place in that, so it is the same whenever and
    wherever the row is read. Rows that come from no Parquet files, or from more
    than ``FILES`` of them, are written first."""
    try:
        of_file = docs.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).select("f").distinct()
    except AnalysisException:
        return keyed(stage(docs, "rows"), name)
    files = sorted(r[0] for r in of_file.limit(FILES + 1).collect())
    if len(files) > FILES:
        return stage(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")
    spark = docs.sparkSession
    numbers = spark.createDataFrame(list(zip(files, range(len(files)))) or [("", 0)], "__file string, __number long")
    rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    rows = rows.join(F.broadcast(numbers), "__file")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.shiftleft("__number", 40).bitwiseOR(F.col("__place")).alias(name))


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if getattr(context, "_tallyrill_shipped", False):
        return
    top, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    target = Path(tempfile.mkdtemp(prefix="tallyrill-")) / "tallyrill_code.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))  # the driver serves it to all executors
    context._tallyrill_shipped = True


def small(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2 << 20, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most_rows`` rows and ``most_bytes``
    in ``column`` (strings or bytes); a longer value comes alone. This bounds
    what a worker holds beside one batch of input."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + most_bytes, "right")), at + 1), at + most_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give memory that a worker has freed back to the system before it idles."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL(None).malloc_trim(0)


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges from ``first`` to under ``last`` in turn."""
    size = last - first
    place = np.cumsum(size)
    return np.repeat(first - place + size, size) + np.arange(place[-1] if len(place) else 0)


class WordIds:
    """Ids of words, which ``work`` gives for an array of distinct sorted words:
    all ids in turn, and the words' ends in them, 0 first. Words of about the
    last ``most`` to twice ``most`` met are remembered, in Arrow and numpy arrays:
    those met since the last turn of generations, and the generation before."""

    def __init__(self, work: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]], most: int):
        self.work, self.most = work, most
        none = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.young = self.old = self.none = none

    def encode(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of all lists in turn, and the ends of the lists in
        them, 0 first."""
        if not len(lists):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        at = pc.index_in(words, value_set=self.young[0]).fill_null(-1).to_numpy(zero_copy_only=False)
        rest = words.filter(pa.array(at < 0))
        more, ends = self._rest(rest)
        # Distinct words lie in the young generation first, then in what is met again or new.
        first, last = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        known, flat = at >= 0, self.young[1]
        first[known], last[known] = self.young[2][at[known]], self.young[2][at[known] + 1]
        first[~known], last[~known] = ends[:-1] + len(flat), ends[1:] + len(flat)
        both = np.concatenate([flat, more])
        if len(self.young[0]) + len(rest) > self.most:
            self.old, self.young = self.young, (rest, more, ends)
        else:
            self.young = pa.concat_arrays([self.young[0], rest]), both, np.concatenate([self.young[2], ends[1:] + len(flat)])
        first, last = first[code], last[code]
        place = np.concatenate([[0], np.cumsum(last - first)])
        return both[ranges(first, last)], place[lists.offsets.to_numpy()]

    def _rest(self, rest: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of words that the young generation lacks."""
        at = pc.index_in(rest, value_set=self.old[0]).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        fresh = rest.take(pa.array(new))
        order = pc.array_sort_indices(fresh).to_numpy()
        flat, ends = self.work(fresh.take(pa.array(order))) if len(new) else self.none[1:]
        first, last = np.empty(len(rest), np.int64), np.empty(len(rest), np.int64)
        known = at >= 0
        first[known], last[known] = self.old[2][at[known]], self.old[2][at[known] + 1]
        first[new[order]], last[new[order]] = ends[:-1] + len(self.old[1]), ends[1:] + len(self.old[1])
        out = np.concatenate([self.old[1], flat])[ranges(first, last)]
        return out, np.concatenate([[0], np.cumsum(last - first)])
