"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to their few principal directions, rotated at random,
shifted, quantized and put in the order of a Hilbert curve, once for each of
CURVES curves. Spark range-partitions each order; a curve is cut into blocks of
BLOCK rows. A query meets the blocks around its own place on every curve; a row
that an earlier curve's window held is not scored again, and what is found is
merged and ranked by the inner product of the original vectors.

How many blocks to either side is fitted: for at most SAMPLE queries (by hash
of their id) the true neighbours are found by brute force, and the least reach
is taken that holds TARGET of them. Where vectors have few intrinsic dimensions
that is a small window at any size of the table. Where they have none to speak
of, near neighbours are hardly nearer than others. Once the windows of all
curves would hold as many rows as the table, every block of one curve is met
instead, which costs less and finds all: so no query is ever compared with more
rows than the table has.

Largest inner product becomes least distance by one more coordinate that brings
all candidates to the same norm. Vectors that are null or zero, hold nulls or
non-finite components, or have another length than most take no part, nor do
rows without an id. A row is compared with every other row, also of its own
id; equal scores go to the smaller id. Rows that repeat a query's id are
queries of their own, each with its ranks. An empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.llm.blocks import groups
from codemap_spark.llm.scratch import materialize, trimmed

CURVES, DIMS, BITS, BLOCK, SAMPLE, TARGET, SEED = 6, 5, 12, 1024, 128, 0.96, 77
#: Rows of a block where every block is met.
SCAN_BLOCK = 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of whole coordinates below 2**bits (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the top bit down
        p = q - 1
        for i in range(n):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(up, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray encoding
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[:, i] >> b & 1
    return key


def raised(vectors: np.ndarray, norm: float, query: np.ndarray) -> np.ndarray:
    """Vectors over the largest norm, with the coordinate that brings candidates to norm 1."""
    v = vectors / norm
    return np.column_stack([v, np.where(query, 0.0, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1))))])


def principal(spark: SparkSession, vectors: DataFrame, norm: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, DIMS principal directions and the largest deviation of all raised vectors, from one sum of squares a task."""
    schema = T.StructType([T.StructField("m", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = np.column_stack([raised(_matrix(batch.column(0)), norm, np.zeros(batch.num_rows, bool)), np.ones(batch.num_rows)])
                total = v.T @ v + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    # Matrices of the dimension alone; a tree of sums keeps what the driver gets to a few.
    parts = vectors.select("vec").mapInArrow(trimmed(run), schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    flat = sum(np.frombuffer(r.m) for r in parts.repartition(8).mapInArrow(add, schema).collect())
    m = flat.reshape(int(len(flat) ** 0.5), -1)
    n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    values, directions = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    k = min(DIMS, len(values))
    # Signs are fixed, so that reruns agree.
    turn = directions[:, ::-1][:, :k]
    turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return mean, turn, float(np.sqrt(max(values[-1], 1e-24)))


def curve_keys(vectors: np.ndarray, curve: int, norm: float, query: np.ndarray, mean: np.ndarray, turn: np.ndarray, deviation: float) -> np.ndarray:
    """The key of each vector on a curve; norm is the largest of any vector."""
    rng = np.random.default_rng([SEED, curve, vectors.shape[1]])
    k = turn.shape[1]
    spin = np.linalg.qr(rng.standard_normal((k, k)))[0]
    # Four deviations to either side cover the cube.
    x = (raised(vectors, norm, query) - mean) @ turn @ spin / (8 * deviation) + 0.5 + (rng.random(k) - 0.5) / 4
    return hilbert_keys(np.clip(x * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def exact_scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in order of the components, so that equal rows get equal scores."""
    return np.cumsum(rows * q, axis=1)[:, -1] if rows.size else np.zeros(len(rows))


def nearest(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, skip=None) -> Iterator[tuple]:
    """(query rows, rows, ids, scores) of each query's k best of the vectors m, in slices of queries; skip(a, b) marks pairs to leave out."""
    for s in range(0, len(q), 256):
        rough = q[s : s + 256] @ m.T
        out = q_rows[s : s + 256, None] == rows[None, :]
        if skip is not None:
            out |= skip(s, s + 256)
        rough[out] = -np.inf
        found = [[], [], [], []]
        for x, line in enumerate(rough):
            if len(rows) > k:
                edge = np.partition(line, len(rows) - k)[len(rows) - k]
                at = np.flatnonzero(line >= edge - 1e-9 * max(1.0, abs(edge))) if edge > -np.inf else np.flatnonzero(line > -np.inf)
            else:
                at = np.flatnonzero(line > -np.inf)
            score = exact_scores(q[s + x], m[at])
            best = np.lexsort((rows[at], ids[at], -score))[:k]
            for held, new in zip(found, (np.full(len(best), q_rows[s + x]), rows[at][best], ids[at][best], score[best]), strict=True):
                held.append(new)
        yield tuple(map(np.concatenate, found))


_FOUND = T.StructType([*(T.StructField(c, T.LongType()) for c in ("q", "row", "vec_id")), T.StructField("score", T.DoubleType())])


def _batch(q: np.ndarray, row: np.ndarray, i: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(row, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], _FOUND.names)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(spark: SparkSession, vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of (row, vector bytes)."""
    shared = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows = np.array([i for i, _ in shared.value], np.int64)
        q = np.frombuffer(b"".join(v for _, v in shared.value), np.float64).reshape(len(q_rows), -1)
        for batch in batches:
            if batch.num_rows:
                for x in nearest(q_rows, q, batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)), k):
                    yield _batch(*x)

    return _top(vectors.select("row", "id", "vec").mapInArrow(trimmed(run), _FOUND), k)


def usable(spark: SparkSession, table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, vec as bytes of doubles, norm) of the rows that take part; row is a number of their own."""
    v = F.col(vec_col)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    df = table.where(F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    most = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("norm", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary()), pa.array(np.sqrt((m * m).sum(1)))], schema.names)

    return materialize(spark, df.where(F.size("v") == (most["d"] if most else 0)).mapInArrow(trimmed(run), schema).withColumn("row", F.monotonically_increasing_id()), "vectors")


def place(spark: SparkSession, vectors: DataFrame, norm: float, every: int, curves: int, block: int) -> DataFrame:
    """(row, is_query, blks): the block of each row on each curve."""
    schema = T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("row", T.LongType()), T.StructField("is_query", T.BooleanType())])
    fit = principal(spark, vectors, norm)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                asks, m = batch.column(1).to_numpy() % every == 0, _matrix(batch.column(2))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asks), c, np.int32)), pa.array(curve_keys(m, c, norm, asks, *fit)), batch.column(0), pa.array(asks)], schema.names)

    numbered = T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("is_query", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column(0).to_numpy()
            at = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                own = np.flatnonzero(curve == c)
                at[own] = seen.get(c, 0) + np.arange(len(own))
                seen[c] = seen.get(c, 0) + len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.full(len(curve), part, np.int32)), pa.array(at)], numbered.names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = vectors.select("row", "id", "vec").mapInArrow(trimmed(keys), schema).repartitionByRange(parts, "curve", "key", "row").sortWithinPartitions("curve", "key", "row")
    rows = materialize(spark, df.mapInArrow(trimmed(number), numbered), "order")
    # One row a curve and partition: how many rows of the curve lie in earlier partitions.
    before = rows.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = before.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))
    out = rows.join(F.broadcast(before), ["curve", "part"]).select("row", "is_query", "curve", ((F.col("before") + F.col("at")) / block).cast("int").alias("blk"))
    # A row has one entry a curve.
    blks = F.transform(F.array_sort(F.collect_list(F.struct("curve", "blk"))), lambda x: x["blk"])
    return materialize(spark, out.groupBy("row", "is_query").agg(blks.alias("blks")), "blocks")


def fitted_reach(spark: SparkSession, vectors: DataFrame, placed: DataFrame, every: int, k: int, target: float, sample: int) -> int:
    """The least number of blocks to either side that holds target of the sampled queries' true neighbours."""
    chosen = vectors.where(F.col("id") % every == 0).orderBy(F.xxhash64("id"), "id", "row").limit(sample).select("row", "vec").collect()
    true = brute_force(spark, vectors, [(r.row, bytes(r.vec)) for r in chosen], k).select("q", "row")
    far = true.join(placed.select(F.col("row").alias("q"), F.col("blks").alias("qb")), "q").join(placed.select("row", "blks"), "row")
    far = far.select(F.array_min(F.zip_with("qb", "blks", lambda a, b: F.abs(a - b))).alias("far")).groupBy("far").count().orderBy("far").collect()
    total, sum_ = sum(r["count"] for r in far), 0
    for r in far:
        sum_ += r["count"]
        if sum_ >= target * total:
            return int(r.far)
    return 0


def search(spark: SparkSession, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, curves: int = CURVES, block: int = BLOCK, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """Neighbours of every row whose id is divisible by every: query_id, rank, vec_id, score."""
    vectors = usable(spark, table, id_col, vec_col)
    norm, n = vectors.agg(F.max("norm"), F.count("*")).first()
    if norm is None:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    placed = place(spark, vectors, norm, every, curves, block)
    reach = fitted_reach(spark, vectors, placed, every, k, target, sample)
    if curves * (2 * reach + 1) * block >= n:
        # Windows would hold more than the table: larger blocks of one curve, each of them met.
        many = max(1, SCAN_BLOCK // block)
        placed = placed.withColumn("blks", F.array((F.col("blks")[0] / many).cast("int")))
        curves, reach = 1, -(-n // block) + 1
    most = placed.agg(*(F.max(F.col("blks")[c]).alias(f"m{c}") for c in range(curves))).first()
    each = F.array(*(F.struct(F.lit(c).alias("curve"), F.col("blks")[c].alias("blk"), F.lit(most[c]).alias("most")) for c in range(curves)))
    at = placed.select("row", "is_query", "blks", F.explode(each).alias("x")).select("row", "is_query", "blks", "x.curve", "x.blk", "x.most")
    asked = at.where("is_query").select("curve", F.explode(F.sequence(F.greatest(F.lit(0), F.col("blk") - reach), F.least("most", F.col("blk") + reach))).alias("blk"), F.lit(True).alias("asks"), "row", "blks")
    rows = at.select("curve", "blk", F.lit(False).alias("asks"), "row", "blks").unionByName(asked)
    rows = rows.join(vectors.select("row", "id", "vec"), "row").select("curve", "blk", "asks", "row", "id", "vec", "blks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            curve = g.column(0)[0].as_py()
            asks, row, ids, m = g.column(2).to_numpy(zero_copy_only=False).astype(bool), g.column(3).to_numpy(), g.column(4).to_numpy(), _matrix(g.column(5))
            if not asks.any() or asks.all():
                continue
            blks = np.array(g.column(6).to_pylist(), np.int64)
            b = blks[~asks]

            def seen(x: int, y: int, q=blks[asks], b=b, curve=curve) -> np.ndarray:
                """Pairs that lay in a window of an earlier curve."""
                return np.logical_or.reduce([np.abs(q[x:y, c, None] - b[None, :, c]) <= reach for c in range(curve)])

            for x in nearest(row[asks], m[asks], row[~asks], ids[~asks], m[~asks], k, seen if curve else None):
                yield _batch(*x)

    found = rows.repartition("curve", "blk").sortWithinPartitions("curve", "blk").mapInArrow(trimmed(meet), _FOUND)
    names = vectors.select(F.col("row").alias("q"), F.col("id").alias("query_id"))
    return _top(found, k).join(names, "q").select("query_id", "rank", "vec_id", "score")
