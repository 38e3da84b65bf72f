"""Operator 10: SentencePiece encoding and decoding by shared-prefix Viterbi.

The pieces and scores come from a SentencePiece model file. Spaces become the
mark U+2581, one is put before a text, and the text is cut into marked words:
marks with what follows them up to the next mark or line break, and line breaks.
No piece reaches over such a cut, so the best path of a text is made of those of
its words. Distinct words are sorted; walking them in that order is a depth-first
walk of their trie: the forward scores and back pointers of the prefix shared
with the word before stay, only the rest is worked out. A word's ids are the path
of greatest total score; characters without a piece go as bytes. Of paths of one
score, that whose last piece is longest is taken, from the end on.

The scores of a BPE model are ranks of merges, not logarithms of probability, and
the path of the greatest sum is not what the merges give. For such a model the
same walk carries, for each prefix, the last piece of its merged form instead of
a score: of the pieces that end at a place, the one counts whose border to the
last piece before it no merge would have crossed, and there is exactly one.
``viterbi`` is for models with probabilities, ``merged`` for ranks.

Decoding gives the text back exactly: a mark that stands in a text itself goes as
bytes.

Defined results: a null text counts as empty and has no ids; lone surrogates
cannot occur in Parquet strings; rows are encoded one by one, so repeated rows
give repeated results; other columns are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, ranges, ship, small, table

MARK = "▁"
#: Stands for a mark of the text itself; no word has two line breaks.
OWN = "\n\n"
CACHE = 100_000
#: Of so many pairs of pieces a worker remembers whether a border holds.
BORDERS = 340_000
#: Texts are encoded in batches of up to so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1024
#: Where whole texts and ids go back beside the input, of half as many bytes.
TRIP_BYTES = BATCH_BYTES // 2
WORD = re.compile(r"▁*[^▁\n]+|\n|▁+")


def _backward(values: dict[str, float]) -> dict:
    """A trie of pieces read from their ends, with their values under "": of
    pieces that end at one place it meets the shorter ones first."""
    top: dict = {}
    for piece, value in values.items():
        node = top
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = value
    return top


class Pieces:
    """A model's pieces; encodes and decodes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        raw = [of_byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.text)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.unknown = sp.unk_id()
        plain = [i for i in range(len(self.text)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.text[i]: (sp.get_score(i), i) for i in plain}
        #: A character as bytes scores below all paths of pieces.
        self.worst = min(s for s, _ in self.score.values()) * 16 - 1000
        self.words = WordIds(self.find, CACHE)
        #: Ranks of merges are whole numbers; logarithms of probabilities are not.
        self.ranked = all(x == int(x) for x, _ in self.score.values())
        self.walk = self.merged if self.ranked else self.viterbi
        if self.ranked:
            by_rank = sorted(self.score.items(), key=lambda x: (-x[1][0], x[1][1]))
            self.rank = {piece: k for k, (piece, _) in enumerate(by_rank)}
            self.by_rank = [(piece, i) for piece, (_, i) in by_rank]
            self.halves = {piece: self._halves(piece) for piece in self.score if len(piece) > 1}
            #: By the ranks of two pieces, as one number.
            self.apart: dict[int, bool] = {}
            self.made = _backward({piece: k for piece, k in self.rank.items() if len(piece) == 1 or self.halves[piece]})

    @cached_property
    def backward(self) -> dict:
        """The pieces with their scores."""
        return _backward({piece: score for piece, (score, _) in self.score.items()})

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, given in sorted order."""
        out, last = [], ""
        best: list[float] = [0.0]
        back: list[int] = [0]
        for word in words:
            k, most = 0, min(len(word), len(last))
            while k < most and word[k] == last[k]:
                k += 1
            del best[k + 1 :], back[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                top, origin = best[end - 1] + self.worst, -end  # below zero: as bytes
                node, start = self.backward, end
                while start:
                    node = node.get(word[start - 1])
                    if node is None:
                        break
                    start -= 1
                    found = node.get("")
                    if found is not None and best[start] + found >= top:
                        top, origin = best[start] + found, start
                best.append(top)
                back.append(origin)
            ids: list[int] = []
            end = len(word)
            while end:
                origin = back[end]
                if origin < 0:
                    ids += [self.byte.get(b, self.unknown) for b in reversed(word[-origin - 1 : end].encode())]
                    end = -origin - 1
                else:
                    ids.append(self.score[word[origin:end]][1])
                    end = origin
            out.append(ids[::-1])
            last = word
        return out

    def _merge(self, word: str, whole: bool = True) -> list[str]:
        """Merge the characters of ``word`` by rank, leftmost first, up to two
        parts unless ``whole``."""
        parts, left = list(word), len(word)
        after, before = list(range(1, left + 1)), list(range(-1, left - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else left_end
            if j < left_end:
                found = self.score.get(parts[i] + parts[j])
                if found is not None:
                    heapq.heappush(heap, (-found[0], i, len(parts[i]) + len(parts[j])))

        left_end = left
        for i in range(left_end - 1):
            offer(i)
        while heap and (whole or left > 2):
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= left_end or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i], parts[j], left = parts[i] + parts[j], "", left - 1
            after[i] = after[j]
            if after[i] < left_end:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in parts if x]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes ``piece``; None if merges make something else."""
        parts = self._merge(piece, False)
        return tuple(parts) if len(parts) == 2 else None

    def border(self, a: int, b: int) -> bool:
        """Whether the merges of two pieces, given by rank, leave the border
        between them, the one before the other. Their own merges are undone from the last one back; the border holds
        unless what lies at it could have been merged before that."""
        known = self.apart.get(a * len(self.by_rank) + b)
        if known is not None:
            return known
        x, y, limit, holds = self.by_rank[a][0], self.by_rank[b][0], len(self.rank) + 1, True
        while True:
            if self.rank.get(x + y, limit) < limit:
                holds = False
                break
            # The later merge is undone first; of one piece twice, the right one was made later.
            p, q = (self.rank[z] if len(z) > 1 else -1 for z in (x, y))
            if p < 0 and q < 0:
                break
            if p > q:
                x, limit = self.halves[x][1], p
            else:
                y, limit = self.halves[y][0], q + 1
        if len(self.apart) >= BORDERS:
            self.apart.clear()
        self.apart[a * len(self.by_rank) + b] = holds
        return holds

    def merged(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, given in sorted order, as the merges give them."""
        out, last = [], ""
        back: list[int] = [0]  # where the last piece of each prefix starts
        rank: list[int] = [-1]  # and its rank; below zero: one character, as bytes
        for word in words:
            if MARK * 2 in word:  # pieces of marks have one rank: merged as they stand
                out.append([i for part in self._merge(word) for i in self._ids(part)])
                continue
            k, most = 0, min(len(word), len(last))
            while k < most and word[k] == last[k]:
                k += 1
            del back[k + 1 :], rank[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                node, start, found = self.made, end, []
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    if "" in node:
                        found.append((start, node[""]))
                origin, mine = end - 1, -1
                for start, one in reversed(found):
                    before = rank[start]
                    if before < 0 or self.border(before, one):
                        origin, mine = start, one
                        break
                back.append(origin)
                rank.append(mine)
            ids: list[int] = []
            end = len(word)
            while end:
                if rank[end] < 0:
                    ids += reversed(self._ids(word[end - 1 : end]))
                else:
                    ids.append(self.by_rank[rank[end]][1])
                end = back[end]
            out.append(ids[::-1])
            last = word
        return out

    def _ids(self, part: str) -> list[int]:
        found = self.score.get(part)
        return [found[1]] if found else [self.byte.get(b, self.unknown) for b in part.encode()]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the ends of the texts in them, 0 first."""
        # Single spaces between words and line breaks only: words can be cut by replacement.
        plain = np.array([t[:1] != " " and "  " not in t and MARK not in t and "\0" not in t for t in texts], bool)
        parts = []
        for k, cut in ((np.flatnonzero(plain), self._cut_plain), (np.flatnonzero(~plain), self._cut)):
            parts.append((k, *self.words.encode(cut([texts[i] for i in k]))))
        first, last = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for (k, flat, ends), shift in zip(parts, (0, len(parts[0][1]))):
            first[k], last[k] = ends[:-1] + shift, ends[1:] + shift
        flat = np.concatenate([parts[0][1], parts[1][1]])
        return flat[ranges(first, last)], np.concatenate([[0], np.cumsum(last - first)])

    def _cut_plain(self, texts: list[str]) -> pa.Array:
        return pc.split_pattern(pa.array([(MARK + t).replace(" ", "\0" + MARK).replace("\n", "\0\n\0") if t else "" for t in texts], pa.string()), "\0")

    def _cut(self, texts: list[str]) -> pa.Array:
        out = []
        for t in texts:
            words: list[str] = []
            for k, part in enumerate(t.split(MARK)):
                words += [OWN] * (k > 0) + WORD.findall(MARK * (k == 0 and t != "") + part.replace(" ", MARK))
            out.append(words)
        return pa.array(out, pa.list_(pa.string()))

    def find(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct sorted words in turn, and the words' ends, 0 first."""
        marks = [self.byte.get(b, self.unknown) for b in MARK.encode()]
        names = words.to_pylist()
        walked = iter(self.walk([w for w in names if w != OWN]))
        found = [marks if w == OWN else next(walked) for w in names]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends

    def decode_batch(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ids ``flat[ends[k]:ends[k + 1]]``."""
        flat = np.asarray(flat)
        places = np.concatenate([[0], np.cumsum(self.byte_ends[flat + 1] - self.byte_ends[flat])])
        raw = self.bytes[ranges(self.byte_ends[flat], self.byte_ends[flat + 1])].tobytes()
        cut = places[ends].tolist()
        return [raw[x:y].decode("utf-8", "replace")[1:] for x, y in zip(cut, cut[1:])]


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each row."""
    ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1, BATCH_BYTES, BATCH_ROWS):
            flat, ends = pieces(model).encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text`` of rows as ``encode`` gives them."""
    ship(encoded.sparkSession)
    kind = dict(encoded.select("doc_id").dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            texts = pieces(model).decode_batch(flat, ends)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one worker: ``doc_id, ids, text`` of each row."""
    ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pieces(model)
        for b in small(batches, 1, TRIP_BYTES, BATCH_ROWS):
            flat, ends = code.encode_batch(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(code.decode_batch(flat, ends), pa.string())], ["doc_id", "ids", "text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>, text string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_sha256`` of each row: crc32 is of
    the ids as little-endian unsigned 32-bit integers, sha256 of the text that
    decoding gives back, in UTF-8."""
    ship(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pieces(model)
        for b in small(batches, 1, BATCH_BYTES, BATCH_ROWS):
            flat, ends = code.encode_batch(b.column(1).to_pylist())
            crcs = [zlib.crc32(flat[x:y].astype("<u4").tobytes()) for x, y in zip(ends, ends[1:])]
            shas = [hashlib.sha256(t.encode()).hexdigest() for t in code.decode_batch(flat, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
