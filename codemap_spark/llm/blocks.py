"""Groups of a key as pairs of bounded blocks, read as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """members of keys with several rows, with columns i, j, blk: block i of a key meets block j.

    A key with n rows is dealt by hash into ceil(n / size) blocks. Each row goes
    to every pair (i <= j) that its block is in, so no task sees more than two
    blocks of a key, however large that is.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    df = members.join(sizes, key)
    df = df.withColumn("__nb", F.ceil(F.col("__n") / F.lit(size)).cast("int"))
    df = df.withColumn("blk", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("__nb").cast("long")).cast("int"))
    df = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    return df.withColumn("i", F.least("blk", "__o")).withColumn("j", F.greatest("blk", "__o")).drop("__n", "__nb", "__o")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Each run of rows with equal first n_keys columns of a sorted stream, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = tuple(k[0] for k in keys)
        new[0] = last is not None and first != last
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for c in cuts:
            if c > at:
                held.append(batch.slice(at, c - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
        last = tuple(k[-1] for k in keys)
    if held:
        yield pa.Table.from_batches(held)
