"""Byte-level BPE encoding and decoding.

A word is an array of token ids beside an array of the ranks of neighbouring
pairs. The smallest rank is searched by scanning, its boundary is deleted and
the two ranks next to it are looked up again. Words beyond LONG bytes, where
scanning again and again would be quadratic, take a heap of ranks over linked
neighbours instead; both give the same ids, so the bound is one of speed alone.

Nulls and empty texts have no ids and decode to ''. Texts of any length are
encoded whole; null ids and repeated rows are each a row, an empty table has
none, and extra columns are ignored, whatever their names. Equal ranks go to
the leftmost pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.llm.chunked import ChunkedEncoder
from codemap_spark.llm.scratch import trimmed

PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
LONG = 400
NONE = 1 << 62
#: Pieces and chunks remembered in a worker.
PIECES, CHUNKS = 150_000, 300_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class Bpe:
    """Encodes and decodes as the tokenizers library does with the same JSON."""

    def __init__(self, model: str):
        j = json.loads(model)
        vocab, merges, symbols = j["model"]["vocab"], j["model"]["merges"], _byte_symbols()
        self.start = [vocab[s] for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        self.shift = max(vocab.values()).bit_length()
        # Key: both ids; value: rank, then the id that the pair becomes.
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for s, k in vocab.items():
            self.bytes[k] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, k in self.special.items():
            self.bytes[k] = s.encode()
        self.names = [str(k) for k in range(size)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, list[int]] = {}
        self.encoder = ChunkedEncoder(self.plain, self.encode, list(self.special), CHUNKS)

    def word(self, piece: bytes) -> list[int]:
        ids, get = [self.start[b] for b in piece], self.pairs.get
        if len(ids) > LONG:
            return self._long(ids)
        ranks = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            k = ranks.index(least)
            ids[k] = least & 0xFFFFFFFF
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], NONE)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pairs.get
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, k) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if not alive[k] or (j := after[k]) < 0 or get(ids[k] << 32 | ids[j], NONE) != rank:
                continue
            ids[k], alive[j], after[k] = rank & 0xFFFFFFFF, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if (r := get(ids[k] << 32 | ids[after[k]], NONE)) != NONE:
                    heapq.heappush(heap, (r, k))
            if (i := before[k]) >= 0 and (r := get(ids[i] << 32 | ids[k], NONE)) != NONE:
                heapq.heappush(heap, (r, i))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out, pieces = [], self.pieces
        for piece in PATTERN.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.word(piece.encode())
                if len(piece) <= 48:
                    if len(pieces) >= PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if self.split is None:
            return self.plain(text)
        out: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.encoder.ids(text), np.uint32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_MODELS: dict[int, Bpe] = {}


def loaded(model: str) -> Bpe:
    if (key := hash(model)) not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Bpe(model)
    return _MODELS[key]


def digests(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256."""
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            n, coded, back = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.ids(text or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], schema.names)

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(trimmed(run), schema)


def encode(spark: SparkSession, docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs, all columns, with the ids of text_col as an array of int."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        bpe = loaded(shared.value)
        return texts.map(lambda t: bpe.ids(t or ""))

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(spark: SparkSession, docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the text of an array of ids; null ids give ''."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def text(ids):
        bpe = loaded(shared.value)
        return ids.map(lambda x: bpe.decode([] if x is None else list(x)))

    return docs.withColumn(text_col, text(F.col(ids_col)))
