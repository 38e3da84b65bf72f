"""Operator 2: token ids in bit-plane shuffled files.

Documents are ordered by id (range partitions, sorted within), encoded, and
their ids written in chunks: whole documents up to about ``CHUNK`` ids. A chunk
is cut into fixed-size blocks of ``BLOCK`` ids (the last one may be short);
each block is transposed into the four byte planes of its unsigned 32-bit
little-endian ids, and each plane is compressed with zstandard. Planes of zeros
shrink to a few bytes. The chunks of a table lie in Parquet files, one row a
chunk, which Spark's committer makes safe against lost executors and repeated
tasks; the columns beside the planes are the chunk index: part, chunk number,
number of ids, first and last document, and each document's id and length.
A reader finds chunks by document through the statistics of these columns.

Defined results
  * a null text counts as empty: its ids are the end id alone;
  * rows that repeat an id follow each other, longer texts later, and each is
    a document of its own; a null id comes first;
  * special tokens in a text are encoded as the tokenizers library does it
    without ``add_special_tokens``;
  * other columns are not looked at; an empty table gives no chunks and an
    empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import WordIds, ranges, shared_dir, ship, small, table

END_ID = 2
BLOCK, CHUNK = 1 << 16, 1 << 20
#: A worker keeps the ids of up to twice so many words; older ones are forgotten.
CACHE = 400_000
#: Texts are encoded in batches of up to so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 8192
#: White space that may run on with a space or a line break beside it.
ODD_SPACE = re.compile(r"[^\S \n]")

CHUNKS = "part int, chunk int, n_ids long, first_doc long, last_doc long, docs array<long>, lengths array<int>, planes array<binary>"


def planes(ids: np.ndarray) -> list[bytes]:
    """Four compressed byte planes for each block of ``BLOCK`` ids."""
    pack, out = zstandard.ZstdCompressor(level=3), []
    for i in range(0, len(ids), BLOCK):
        block = ids[i : i + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4)
        out += [pack.compress(np.ascontiguousarray(block[:, k]).tobytes()) for k in range(4)]
    return out


def unplanes(packed: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of a chunk, uint32."""
    unpack, out = zstandard.ZstdDecompressor(), np.empty((n, 4), np.uint8)
    for i in range(0, len(packed), 4):
        at = i // 4 * BLOCK
        for k in range(4):
            out[at : at + BLOCK, k] = np.frombuffer(unpack.decompress(packed[i + k]), np.uint8)
    return out.reshape(-1).view("<u4")


class WordEncoder:
    """Encodes whole texts word by word, each distinct word once while it is remembered.

    Byte-level BPE splits a text before the space that opens a word and before
    a line break between words, so the ids of a text are those of its words in
    turn. That holds for texts whose words are parted by single spaces and
    single line breaks and that have no other white space; all others are
    encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        names = self.tok.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for x, i in names.items() if x[:1] in ("\u0120", "\u010a")]] = True  # a byte-level vocabulary's space and line break
        self.remembered = WordIds(self.find, CACHE)

    def plain(self, text: str) -> bool:
        return bool(text) and not text[0].isspace() and not text[-1].isspace() and not any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\0")) and not ODD_SPACE.search(text) and not any(x in text for x in self.special)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and their ends, 0 first."""
        found = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that open with a space or a line break and have no
        other. They are encoded as one text; a token that opens with either opens
        a word."""
        flat = np.array(self.tok.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.int32)
        first = np.flatnonzero(self.opens[flat])
        if len(first) != len(texts) or len(first) and first[0]:
            return self.whole(texts)
        return flat, np.append(first, len(flat))

    def find(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct sorted words; one that opens a text is marked by
        a space before it. These come after those with a line break, and before
        most others."""
        opening = pc.starts_with(words, " ").to_numpy(zero_copy_only=False)
        broken = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        lead = pc.if_else(pa.array(broken), "", " ")
        rest = pc.binary_join_element_wise(lead, words, "").filter(pa.array(~opening))
        parts = self.whole([w[1:] for w in words.filter(pa.array(opening)).to_pylist()]), self.words(rest.to_pylist())
        first, last = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for where, (_, ends), shift in zip((opening, ~opening), parts, (0, len(parts[0][0]))):
            first[where], last[where] = ends[:-1] + shift, ends[1:] + shift
        flat = np.concatenate([parts[0][0], parts[1][0]])
        return flat[ranges(first, last)], np.concatenate([[0], np.cumsum(last - first)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        flat, ends = self.encode_batch(texts)
        return [flat[a:b].view(np.uint32) for a, b in zip(ends, ends[1:])]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and their ends, 0 first."""
        plain = np.array([self.plain(t) for t in texts], bool)
        # NUL parts the words; it is in no plain text.
        cut = pa.array([" " + texts[k].replace(" ", "\0").replace("\n", "\0\n") for k in np.flatnonzero(plain)], pa.string())
        parts = self.remembered.encode(pc.split_pattern(cut, "\0")), self.whole([texts[k] for k in np.flatnonzero(~plain)])
        first, last = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for where, (_, ends), shift in zip((plain, ~plain), parts, (0, len(parts[0][0]))):
            first[where], last[where] = ends[:-1] + shift, ends[1:] + shift
        flat = np.concatenate([parts[0][0], parts[1][0]])
        return flat if plain.all() else flat[ranges(first, last)], np.concatenate([[0], np.cumsum(last - first)])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _schema(ddl_frame_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_frame_schema)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode all documents and write them as a table of chunks at ``path``."""
    spark = docs.sparkSession
    ship(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(docs.select(id_col).schema[0].dataType, IntegralType):
        raise TypeError(f"{id_col} is no whole number")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Length and hash part the rows of one id, null ones too, among tasks.
    order = [F.col("id"), F.length("text"), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = spark.createDataFrame([], CHUNKS).schema
    arrow = _schema(out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code, number = TaskContext.get().partitionId(), encoder(tokenizer), 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # ids, lengths and names of whole documents

        def chunk() -> pa.RecordBatch:
            flat, lengths = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            names = pa.concat_arrays([h[2] for h in held])
            real = pc.min_max(names).as_py()
            of = pa.array([0, len(names)], pa.int32())
            row = [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(flat)], pa.int64()),
                pa.array([real["min"]], pa.int64()), pa.array([real["max"]], pa.int64()),
                pa.ListArray.from_arrays(of, names), pa.ListArray.from_arrays(of, pa.array(lengths, pa.int32())),
                pa.array([planes(flat)], pa.list_(pa.binary())),
            ]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(row, arrow)], schema=arrow)

        for batch in small(batches, 1, BATCH_BYTES, BATCH_ROWS):
            bare, ends = code.encode_batch(batch.column(1).to_pylist())
            lengths = np.diff(ends) + 1
            flat = np.full(len(bare) + len(lengths), END_ID, np.int32)
            flat[np.arange(len(bare)) + np.repeat(np.arange(len(lengths)), lengths - 1)] = bare
            ends = np.concatenate([[0], np.cumsum(lengths)])
            at, full = 0, sum(len(h[0]) for h in held)
            while at < len(lengths):
                to = min(int(np.searchsorted(ends, ends[at] + CHUNK - full)), len(lengths))
                held.append((flat[ends[at] : ends[to]], lengths[at:to], batch.column(0).slice(at, to - at)))
                full += int(ends[to] - ends[at])
                at = to
                if full >= CHUNK:
                    yield chunk()
                    held, full, number = [], 0, number + 1
        if held:
            yield chunk()

    rows.mapInArrow(encode, out).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in the files.

    Starts are sums at two levels: of chunks within a part, and of parts; the
    latter are as few rows as there are parts."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.select("part", "chunk", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = sizes.select("part", "chunk", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids")).alias("chunk_start"))
    schema = spark.createDataFrame([], "part int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long").schema
    arrow = _schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unplanes(row["planes"], row["n_ids"])
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                k = len(ends)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row["part"]), pa.int32()), pa.array(np.full(k, row["chunk"]), pa.int32()), pa.array(row["docs"], pa.int64()), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())], schema=arrow)

    docs = chunks.select("part", "chunk", "n_ids", "docs", "lengths", "planes").mapInArrow(decode, schema)
    placed = starts.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("base"))
    return docs.join(placed, ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tallyrill/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
