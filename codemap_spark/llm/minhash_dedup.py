"""MinHash near-dedup by fast similarity sketching.

A text's set holds its distinct word shingles, hashed to 64 bits. The sketch
has T coordinates. In round i of the first T rounds each element is hashed to a
bin and a value i + h; in round T + k all elements go to bin k. A coordinate
keeps the smallest value it gets, and rounds stop as soon as every coordinate
is filled, which by then is certain; most sets need few rounds. Coordinates of
two sets agree with the probability of their Jaccard similarity and with
as narrow a spread as for independent hashes.

Equal sets become one class. Bands of the sketch give buckets; a bucket's
classes are first paired with its smallest and its largest class (those that
most of a class's buckets have), verified on the full sets and merged to
components. In a bucket whose classes are then still in several components,
those outside its largest component meet all others in bounded blocks. A block
names the classes whose sketches can be a link; their full sets are verified
there, and what became linked on the way is not looked at again. No list of
pairs is ever made, so nothing grows with the square of a group of copies, and
no link between components is lost. What can be missed is only what banding
misses: with 32 bands of 5 a pair at the threshold 0.8 shares no bucket with
probability 3e-6, and an estimate SLACK deviations off (below 1e-8).

Nulls, empty texts and texts without words have an empty set and link with
nothing; a text of fewer words than a shingle has its whole sequence as its
one shingle. Rows that repeat an id are one document: linked if any is. A null
id has a row with a null component, kept if it has no twin with an id. Ties
are no matter: a component is named by its smallest id. Texts of any length are
taken whole, extra columns are ignored, and an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.llm.blocks import groups
from codemap_spark.llm.components import connected_components
from codemap_spark.llm.scratch import join_ids, materialize, trimmed

COORDINATES, BANDS = 160, 32
BLOCK = 256
#: Standard deviations below the threshold at which an estimate still counts as a candidate.
SLACK = 6.0
#: Words that a task remembers.
MEMO = 150_000

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(r: int) -> np.uint64:
    return np.uint64(r * int(_MULT) & 0xFFFFFFFFFFFFFFFF)


class Words(dict):
    """word -> hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, k: int, memo: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; bytes split and fold ASCII only."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map((Words() if memo is None else memo).__getitem__, words), np.uint64, len(words))
    n = min(k, len(a))
    out = np.full(len(a) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):  # depends on the order of the words
        out = _mix(out * _MULT + a[i : len(a) - n + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates of a set that isn't empty: the hash that won each bin, with its round."""
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    size = np.uint64(t)
    for r in range(t):
        h = _mix(items + _salt(r + 1))
        # 8 bits of the round lead, so an earlier round always wins; then 56 bits of value.
        np.minimum.at(best, (h % size).astype(np.int64), np.uint64(r) << np.uint64(56) | _mix(h) >> np.uint64(8))
        if best.max() != np.iinfo(np.uint64).max:
            return best
    for k in np.flatnonzero(best == np.iinfo(np.uint64).max):
        best[k] = np.uint64(255) << np.uint64(56) | (_mix(items + _salt(t + 1 + int(k))) >> np.uint64(8)).min()
    return best


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = coordinates.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for c in range(rows.shape[1]):
        key = _mix(key * _MULT + rows[:, c])
    return key.view(np.int64)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_SKETCHED = T.StructType([*_long("id", "n", "f1", "f2"), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
_SETS = T.StructType([*_long("id", "v"), T.StructField("items", T.BinaryType())])
_PAIRS = T.StructType(_long("a", "b"))
_MEMBERS = T.StructType([*_long("key", "i", "j", "band", "id", "v", "comp", "n", "blk"), T.StructField("sig", T.BinaryType())])


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two longs."""
    x = xxhash.xxh3_128_intdigest(items.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            n, f1, f2, keys, sig = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k, memo)
                n.append(len(s))
                if not len(s):
                    f1.append(None), f2.append(None), keys.append(None), sig.append(None)
                    continue
                one, two = fingerprint(s)
                f1.append(one), f2.append(two)
                c = sketch(s)
                keys.append(band_keys(c))
                sig.append(c.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], _SKETCHED.names)

    return docs.mapInArrow(trimmed(run), _SKETCHED)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, v, items): the sorted hashes of a set as bytes; v tells the sets of an id that repeats apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            sets = [shingles(t, k, memo) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x)[0] for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], _SETS.names)

    return docs.mapInArrow(trimmed(run), _SETS)


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    at = np.searchsorted(t, s)
    both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def _items(column: pa.Array, row: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), np.uint64)


def _stars(spark: SparkSession, hits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each class b with the ends of its buckets; a hub's set goes to each block of its classes, not to each pair."""
    ends = [_usual(hits, end).select(F.col("other").alias("hub"), F.col("id").alias("b")) for end in ("low", "high")]
    pairs = materialize(spark, ends[0].unionByName(ends[1]).distinct(), "stars")
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("nb"))
    members = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("b", F.lit(7)), F.col("nb")).alias("blk"), F.col("b").alias("id"), F.lit(1).cast("long").alias("leaf"))
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("blk"), F.col("hub").alias("id"), F.lit(0).cast("long").alias("leaf"))
    rows = members.unionByName(hubs).join(sets, "id").select("hub", "blk", "leaf", "id", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, []
        for batch in batches:  # sorted: a block's hub, all its sets, comes before its classes
            a, b = [], []
            heads, leaf, ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k in range(batch.num_rows):
                if not leaf[k]:
                    block, own = heads[k], [*(own if block == heads[k] else ()), _items(batch.column(4), k).copy()]
                elif any(linked(x, _items(batch.column(4), k), percent) for x in own):
                    a.append(heads[k][0]), b.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], _PAIRS.names)

    dealt = rows.repartition("hub", "blk").sortWithinPartitions("hub", "blk", "leaf")
    return materialize(spark, dealt.mapInArrow(trimmed(run), _PAIRS), "links")


def _possible(x: int, others: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Those of others that can be a link of row x in another component and share no earlier band; likeliest first."""
    rest = others[(comp[others] != comp[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
    if not len(rest):
        return rest
    t, p = sig.shape[1], percent / 100
    same = sig[rest] == sig[x]
    sum_ = same.sum(1)
    ok = sum_ >= t * p - SLACK * (t * p * (1 - p)) ** 0.5
    if band:
        ok &= ~same[:, : band * (t // BANDS)].reshape(len(rest), band, -1).all(2).any(1)
    return rest[ok][np.argsort(-sum_[ok], kind="stable")]


def _facing(i: int, j: int, blk: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of block i with the rows that it meets: those of block j, or the larger ids of its own block."""
    left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
    for x in left:
        yield x, right if i != j else left[ids[left] > ids[x]]


def _group(g: pa.Table) -> tuple:
    i, j, band = (g.column(c)[0].as_py() for c in (1, 2, 3))
    ids, comp, n, blk = (g.column(c).to_numpy() for c in (4, 6, 7, 8))
    return i, j, band, ids, comp, n, blk, np.frombuffer(b"".join(g.column(9).to_pylist()), np.uint16).reshape(len(ids), -1)


def _blocks(labelled: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of _MEMBERS: in buckets of several components, blocks of classes outside the largest one meet all blocks."""
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sizes = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.max("c").alias("in"), F.sum("c").alias("all")).where("in < all")
    sizes = sizes.select("key", "most", F.ceil((F.col("all") - F.col("in")) / F.lit(BLOCK)).alias("few"), F.ceil(F.col("in") / F.lit(BLOCK)).alias("many"))
    df = labelled.join(sizes, "key").join(reps.select("id", "v", "n", "sig"), ["id", "v"])
    h, inside = F.xxhash64("id", F.lit(7)), F.col("comp") == F.col("most")
    df = df.withColumn("blk", F.when(inside, F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))))
    last = F.when(inside, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    df = df.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return df.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), F.col("band").cast("long").alias("band"), "id", "v", "comp", "n", "blk", "sig")


def _meet(spark: SparkSession, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components, of classes that meet in blocks; each pair in the first bucket that it shares."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            i, j, band, ids, comp, n, blk, sig = _group(g)
            need = np.zeros(len(ids), bool)
            for x, others in _facing(i, j, blk, ids):
                if len(rest := _possible(x, others, ids, comp, n, sig, band, percent)):
                    need[x], need[rest] = True, True
            if need.any():
                yield from g.filter(pa.array(need)).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            i, j, band, ids, comp, n, blk, sig = _group(g)
            comp, items, a, b = comp.copy(), g.column(10).combine_chunks(), [], []
            for x, others in _facing(i, j, blk, ids):
                own = _items(items, x)
                for y in _possible(x, others, ids, comp, n, sig, band, percent):
                    if comp[x] != comp[y] and linked(own, _items(items, y), percent):
                        a.append(ids[x]), b.append(ids[y])
                        comp[comp == comp[y]] = comp[x]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], _PAIRS.names)

    key = ["key", "i", "j"]
    need = materialize(spark, members.repartition(*key).sortWithinPartitions(*key).mapInArrow(trimmed(find), _MEMBERS), "near")
    full = need.join(sets, ["id", "v"]).select(*_MEMBERS.names, "items")
    return materialize(spark, full.repartition(*key).sortWithinPartitions(*key).mapInArrow(trimmed(verify), _PAIRS), "links")


def _usual(hits: DataFrame, end: str) -> DataFrame:
    """(id, other): the end that most of a class's buckets share."""
    n = hits.where(F.col(end) != F.col("id")).groupBy("id", end).agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.max(F.struct("n", end)).alias("m")).select("id", F.col(f"m.{end}").alias("other"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(spark, _sketches(docs, k), "sketches")
    # Classes of equal sets, named by their smallest id.
    classes = rows.where("f1 IS NOT NULL AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("class"))
    classes = materialize(spark, classes, "classes")
    reps = rows.where("f1 IS NOT NULL").join(classes.withColumnRenamed("class", "id"), ["id", "f1", "f2"]).dropDuplicates(["id", "f1", "f2"])
    reps = materialize(spark, reps.select("id", F.col("f1").alias("v"), "n", "keys", "sig"), "reps")
    banded = reps.select("id", "v", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    hits = materialize(spark, banded.join(buckets, "key"), "hits")  # only rows of buckets with several classes
    sets = materialize(spark, _sets(join_ids(docs, materialize(spark, hits.select("id").distinct(), "ids"), "id", "left_semi"), k).dropDuplicates(["id", "v"]), "sets")
    # Classes that a repeated id has rows in are one document's.
    twice = rows.where("f1 IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    own = join_ids(rows.where("f1 IS NOT NULL"), materialize(spark, twice, "twice"), "id", "left_semi").join(classes, ["f1", "f2"]).select("id", "class").distinct()
    same = own.join(own.groupBy("id").agg(F.min("class").alias("a")), "id").where("a <> class").select("a", F.col("class").alias("b"))
    links = _stars(spark, hits, sets, percent).unionByName(materialize(spark, same, "same"))
    comps = materialize(spark, connected_components(spark, links), "comps")
    labelled = hits.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", "v", F.coalesce("component", "id").alias("comp"))
    labelled = materialize(spark, labelled, "labelled")
    more = _meet(spark, _blocks(labelled, reps), sets, percent)
    if not more.isEmpty():
        comps = materialize(spark, connected_components(spark, links.unionByName(more)), "comps")
    of = classes.join(comps.withColumnRenamed("node", "class"), "class", "left").select("f1", "f2", F.coalesce("component", "class").alias("component_id"))
    out = rows.select("id", "n", "f1", "f2").join(of, ["f1", "f2"], "left")
    # Rows that repeat an id with other texts count as one document.
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.col("component_id").isNull()).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that another document of their group stands for; of rows that repeat an id and a set, one stays."""
    found = near_duplicates(spark, docs, id_col, text_col, k, percent)
    found = materialize(spark, found.select(id_col, "kept"), "kept")
    gone = materialize(spark, found.where(f"NOT kept AND {id_col} IS NOT NULL").select(id_col).distinct(), "gone")
    out = join_ids(docs, gone, id_col, "left_anti")
    twice = materialize(spark, found.where(f"{id_col} IS NOT NULL").groupBy(id_col).count().where("count > 1").select(id_col), "twice")
    if twice.isEmpty():
        return out
    again = join_ids(out, twice, id_col, "left_semi").dropDuplicates([id_col])
    return join_ids(out, twice, id_col, "left_anti").unionByName(again)
