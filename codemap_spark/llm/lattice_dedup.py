"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to eight dimensions, shifted and decoded
to the nearest point of the E8 lattice, in TABLES tables. A vector is stored
under its own cell and looked up under that cell and under its PROBES nearest
neighbouring cells. Pairs that meet are verified by cosine in double precision.

Equal vectors become one class first; a class counts its size, so copies are
never paired. Classes of one cell meet in bounded blocks in the first table
where they share a cell. A block gives each of its classes the number of rows
it links with and one link to a root of its component there, never a list of
its pairs. Pairs that meet only by probing follow; those that share a cell are
left out as they meet, so a group of near copies does not come up again.

A null, zero or non-finite vector, or one that holds a null, links with
nothing; vectors link with those of their own length alone. Rows that repeat an
id, or have none, are compared as rows of their own. A component is named by
its smallest id, by null where no row of it has one; a row is kept if it has
that id, or if there is none. An empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.llm.blocks import block_pairs, groups
from codemap_spark.llm.components import connected_components
from codemap_spark.llm.scratch import materialize, trimmed

TABLES, PROBES, WIDTH, SEED = 16, 16, 0.9, 20240607
#: Of 64 signs of random projections, so many may differ; at cosine 0.9 more do with probability below 1e-4.
SIGNS_APART = 21
#: Longs that hold 16 bits of each table's own cell; pairs that agree in one share a cell (but for 2.4e-4 of those that don't).
LANES = TABLES // 4
BLOCK = 512

_M = np.uint64(0x9E3779B97F4A7C15)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1).astype(np.int64) & 1)
    if len(odd):
        r = x[odd] - f[odd]
        k = np.abs(r).argmax(1)
        f[odd, k] += np.where(r[np.arange(len(odd)), k] >= 0, 1, -1)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _keys(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key of each lattice point; doubled coordinates are whole."""
    q = np.rint(points * 2).astype(np.int64).view(np.uint64)
    # The table is mixed in first, else a table and a coordinate could trade places.
    key = np.full(q.shape[:-1], np.uint64((table + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF), np.uint64)
    for c in range(8):
        key = (key ^ q[..., c]) * _M
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Own keys (n, tables) and probed keys (n, tables, probes)."""
    own, near = np.empty((len(unit), tables), np.int64), np.empty((len(unit), tables, probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, unit.shape[1]])
        x = unit @ rng.standard_normal((unit.shape[1], 8)) / width + rng.random(8) * 2
        y = decode(x)
        own[:, t] = _keys(y, t)
        if probes:
            order = np.argpartition(-((x - y) @ ROOTS.T), probes, axis=1)[:, :probes]
            near[:, t] = _keys(y[:, None] + ROOTS[order], t)
    return own, near


_CELLS = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("signs", T.LongType()), *(T.StructField(f"l{k}", T.LongType()) for k in range(LANES)), T.StructField("own", T.ArrayType(T.LongType())), T.StructField("near", T.ArrayType(T.LongType()))])
#: A link of classes a and b, or without b the number of rows that a links with.
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)
    v = vectors / scale
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _signs(unit: np.ndarray) -> np.ndarray:
    """The signs of 64 random projections as the bits of a long."""
    up = unit @ np.random.default_rng([SEED, 10_000, unit.shape[1]]).standard_normal((unit.shape[1], 64)) > 0
    return np.packbits(up, axis=1).view(np.int64).ravel()


def _lanes(own: np.ndarray) -> list[np.ndarray]:
    """16 bits of each table's own key, four tables a long."""
    bits = np.zeros((len(own), LANES * 4), np.uint16)
    bits[:, : own.shape[1]] = (own.view(np.uint64) >> np.uint64(41)).astype(np.uint16)
    return [np.ascontiguousarray(bits[:, 4 * k : 4 * k + 4]).view(np.int64).ravel() for k in range(LANES)]


def _shares(p: str, q: str) -> str:
    """SQL: whether two rows' lanes agree in some table."""
    masks = (0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -(1 << 48))
    return "(" + " OR ".join(f"(({p}{k} ^ {q}{k}) & {m}L) = 0" for k in range(LANES) for m in masks) + ")"


def _hashed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                u = _unit(np.array([vectors[k] for k in at], np.float64))
                own, near = cells(u)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([x.tobytes() for x in u], pa.binary()), pa.array(_signs(u)), *map(pa.array, _lanes(own)), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(near.reshape(len(at), -1)), pa.list_(pa.int64()))], _CELLS.names)

    return classes.select("id", "vec").mapInArrow(trimmed(run), _CELLS)


def roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for first in range(len(linked)):
        if root[first] < 0:
            new = np.array([first])
            while len(new):
                root[new] = first
                new = np.flatnonzero(linked[new].any(0) & (root < 0))
    return root


def _emit(ids: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts and spanning links of the matrix ok between rows left and right of a block."""
    if not ok.any():
        return
    same = left is right
    count = np.zeros(len(ids), np.int64)
    count[left] += ok @ sizes[right]
    if not same:
        count[right] += ok.T @ sizes[left]
    both = left if same else np.concatenate([left, right])
    full = ok if same else np.block([[np.zeros((len(left),) * 2, bool), ok], [ok.T, np.zeros((len(right),) * 2, bool)]])
    root = roots(full)
    tied, met = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(count)
    a, b = np.concatenate([ids[met], ids[both[tied]]]), pa.array([None] * len(met) + ids[both[root[tied]]].tolist(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.concatenate([count[met], np.zeros(len(tied), np.int64)]))], _LINKS.names)


def _within(members: DataFrame, least: float) -> DataFrame:
    """Links of classes that share a cell, each in the first table where they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            i, j, table = (g.column(c)[0].as_py() for c in (1, 2, 3))
            ids, blk, vecs, n = g.column(4).to_numpy(), g.column(5).to_numpy(), g.column(6).to_pylist(), g.column(8).to_numpy()
            own = np.array(g.column(7).to_pylist(), np.int64)
            sizes = np.array([len(v) for v in vecs])
            for d in np.unique(sizes):
                left = np.flatnonzero((sizes == d) & (blk == i))
                right = left if i == j else np.flatnonzero((sizes == d) & (blk == j))
                if not len(left) or not len(right):
                    continue
                u, v = (np.frombuffer(b"".join(vecs[x] for x in k), np.float64).reshape(len(k), -1) for k in (left, right))
                ok = u @ v.T >= least
                if i == j:
                    np.fill_diagonal(ok, False)
                for t in range(table):
                    ok &= own[left, t][:, None] != own[right, t][None, :]
                yield from _emit(ids, n, left, right, ok)

    df = block_pairs(members, "key", "c", BLOCK).select("key", "i", "j", "table", "c", "blk", "vec", "own", "n")
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(trimmed(run), _LINKS)


def _across(pairs: DataFrame, least: float) -> DataFrame:
    """Links among pairs with both vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(batch.num_rows, bool)
            sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(u, v, strict=True)], np.int64)
            for d in np.unique(sizes[sizes > 0]):
                k = np.flatnonzero(sizes == d)
                x, y = (np.frombuffer(b"".join(w[m] for m in k), np.float64).reshape(len(k), -1) for w in (u, v))
                ok[k] = np.einsum("ij,ij->i", x, y) >= least
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.nulls(ok.true_count, pa.int64())], _LINKS.names)

    return pairs.select("a", "b", "va", "vb").mapInArrow(trimmed(run), _LINKS)


def valid(vec: F.Column) -> F.Column:
    """A vector that can link: finite, without nulls and not zero."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)


def near_duplicates(spark: SparkSession, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per row of table: id, n_links, component_id, kept."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 + 0.0 is 0.0
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    rows = rows.withColumn("ok", F.coalesce(valid(F.col("vec")), F.lit(False)))
    rows = rows.withColumn("f", F.when(F.col("ok"), F.sha2(F.to_json("vec").cast("binary"), 256)))
    classes = rows.where("ok").groupBy("f").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = materialize(spark, classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # from here on a class is its number c
    hashed = materialize(spark, _hashed(classes.select(F.col("c").alias("id"), "vec")).withColumnRenamed("id", "c"), "cells")
    own = hashed.select("c", F.posexplode("own").alias("table", "key"))
    many = own.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    members = own.join(many, "key").join(hashed.select("c", "vec", "own").join(classes.select("c", "n"), "c"), "c").select("key", "table", "c", "vec", "own", "n")
    within = materialize(spark, _within(members, least), "within")
    # Probed cells; pairs that share a cell in some table are done.
    lanes = lambda x: [F.col(f"l{k}").alias(f"{x}{k}") for k in range(LANES)]
    probed = hashed.select(F.col("c").alias("p"), F.col("signs").alias("sp"), *lanes("lp"), F.explode("near").alias("key"))
    met = hashed.select(F.col("c").alias("q"), F.col("signs").alias("sq"), *lanes("lq"), F.explode("own").alias("key")).join(probed, "key")
    met = met.where(f"p <> q AND bit_count(sp ^ sq) <= {SIGNS_APART} AND NOT {_shares('lp', 'lq')}")
    met = materialize(spark, met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "met")
    left = hashed.select(F.col("c").alias("a"), F.col("vec").alias("va"), F.col("own").alias("oa"))
    right = hashed.select(F.col("c").alias("b"), F.col("vec").alias("vb"), F.col("own").alias("ob"))
    rest = met.join(left, "a").join(right, "b").where(~F.exists(F.zip_with("oa", "ob", lambda x, y: x == y), lambda x: x))
    across = materialize(spark, _across(rest, least), "across")
    sizes = classes.select("c", "n")
    ends = across.select("a", "b").unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes.toDF("b", "n"), "b").select("a", "n")
    degree = within.where("b IS NULL").select("a", "n").unionByName(ends).groupBy("a").agg(F.sum("n").alias("m"))
    comps = connected_components(spark, within.where("b IS NOT NULL").select("a", "b").unionByName(across.select("a", "b"))).toDF("c", "root")
    of = classes.select("f", "c", "id", "n").join(degree.withColumnRenamed("a", "c"), "c", "left").join(comps, "c", "left").withColumn("root", F.coalesce("root", "c"))
    of = materialize(spark, of, "of")
    named = of.groupBy("root").agg(F.min("id").alias("component_id"))
    of = of.join(named, "root").select("f", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    out = rows.select("id", "f").join(of, "f", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
