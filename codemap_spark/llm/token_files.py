"""Token ids as Arrow IPC files of fixed-size-list batches.

Documents in ascending id order make one stream of ids, each document followed
by an end id. Each range partition writes files of its own: every row of a
batch holds a fixed-size list of ids and one of mask bits (false only where the
last sequence of a file is padded). Equal rows a batch and equal ids a row make
any token's place a division, read without copying from a memory map.

A task writes under a name of its own and returns it; only names in the
manifest, a Parquet table that Spark commits, count. So a lost executor leaves
at most an unreferenced file, and a rerun agrees.

Nulls and empty texts hold the end id alone. Null ids come first; rows that
repeat an id all stay, by text. An empty table has no file and no row.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.llm.chunked import ChunkedEncoder
from codemap_spark.llm.scratch import materialize, new_path, trimmed

#: Ids a sequence, sequences a batch, batches a file.
SEQUENCE, BATCH_ROWS, FILE_BATCHES = 2048, 128, 256

_ENCODERS: dict[int, ChunkedEncoder] = {}


def library_encoder(model: str) -> ChunkedEncoder:
    """The tokenizers library behind a memo; model is the tokenizer's JSON."""
    if (key := hash(model)) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model)
        t.no_truncation()
        t.no_padding()
        encode = lambda text: t.encode(text, add_special_tokens=False).ids
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkedEncoder(encode, encode, [x.content for x in t.get_added_tokens_decoder().values()])
    return _ENCODERS[key]


def filesystem(uri: str) -> tuple["pa.fs.FileSystem", str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Files of one task; put() takes ids and says where they went."""

    def __init__(self, folder: str, dtype: np.dtype, sequence: int, rows: int, batches: int):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.dtype, self.sequence, self.rows, self.most = dtype, sequence, rows, batches
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = None

    def put(self, ids: np.ndarray) -> tuple[str, int]:
        if self.sink is None:
            self.name = f"{uuid.uuid4().hex}.arrow"
            self.sink = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.file = pa.ipc.new_file(self.sink, self.schema)
            self.parts, self.held, self.at, self.done = [], 0, 0, 0
        place = (self.name, self.at)
        self.parts.append(ids)
        self.held += len(ids)
        self.at += len(ids)
        if self.held >= self.rows * self.sequence:
            self._write(False)
            if self.done >= self.most:  # a document's ids stay in one file
                self.close()
        return place

    def _write(self, last: bool) -> None:
        flat, size = np.concatenate(self.parts), self.rows * self.sequence
        for k in range(0, len(flat), size) if last else range(0, len(flat) - size + 1, size):
            ids = flat[k : k + size]
            padded = np.zeros(-(-len(ids) // self.sequence) * self.sequence, self.dtype)
            padded[: len(ids)] = ids
            mask = np.zeros(len(padded), bool)
            mask[: len(ids)] = True
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (padded, mask)], schema=self.schema))
            self.done += 1
        self.parts = [] if last else [flat[len(flat) // size * size :]]
        self.held = sum(map(len, self.parts))

    def close(self) -> None:
        if self.sink is not None:
            if self.held:
                self._write(True)
            self.file.close()
            self.sink.close()
            self.sink = None


class SequenceReader:
    """Random access to the ids of one file, without copies where its batches hold them together."""

    def __init__(self, folder: str, name: str, rows: int, sequence: int):
        files, root = filesystem(folder)
        path = f"{root}/{name}"
        self.source = pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path)
        self.file, self.size = pa.ipc.open_file(self.source), rows * sequence

    def ids(self, at: int, n: int) -> np.ndarray:
        parts = []
        while n:
            k, i = divmod(at, self.size)
            flat = self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)[i : i + n]
            parts.append(flat)
            at, n = at + len(flat), n - len(flat)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])


def write(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, folder: str | None = None, sequence: int = SEQUENCE, rows: int = BATCH_ROWS, batches: int = FILE_BATCHES) -> tuple[str, DataFrame]:
    """Write docs; the folder and the manifest (id, part, file, at_file, at_part, n_tokens)."""
    folder = folder or new_path(spark, "tokens")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("at_file", "at_part", "n_tokens"))])

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = library_encoder(shared.value), TaskContext.get().partitionId(), 0
        out = SequenceWriter(folder, np.dtype(np.uint16), sequence, rows, batches)
        for batch in batches_in:
            found = []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder.ids(text or ""), np.uint32)
                ids = np.append(ids, np.uint32(end_id))
                if ids.max() > 0xFFFF:
                    raise ValueError("this vocabulary needs more than 16 bits an id")
                found.append((*out.put(ids.astype(np.uint16)), at, len(ids)))
                at += len(ids)
            file, at_file, at_part, n = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(found), pa.int32()), pa.array(file, pa.string()), *(pa.array(x, pa.int64()) for x in (at_file, at_part, n))], schema.names)
        out.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col(id_col), F.col(text_col).alias("text")).repartitionByRange(parts, F.col(id_col)).sortWithinPartitions(id_col, "text")
    return folder, materialize(spark, df.mapInArrow(trimmed(run), schema), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id", sequence: int = SEQUENCE, rows: int = BATCH_ROWS) -> DataFrame:
    """From the files, per document: id, start, n_tokens, ids_crc32."""
    # One row a partition; the running sum over them is as small as the number of files' writers.
    per_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = manifest.join(F.broadcast(starts), "part").select(id_col, "file", "at_file", "n_tokens", (F.col("before") + F.col("at_part")).alias("start"))
    schema = T.StructType([manifest.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            crc = []
            for file, at, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if file != name:
                    name, reader = file, SequenceReader(folder, file, rows, sequence)
                crc.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(crc, pa.int64())], schema.names)

    return placed.mapInArrow(trimmed(run), schema)
