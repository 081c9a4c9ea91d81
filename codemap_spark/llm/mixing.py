"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all rates of its documents that
give the target, those nearest to 1 in relative entropy are exp(t * size), cut
off at MOST; the multiplier t of each source is found by Newton's method on the
convex dual. Documents of one source and size share a rate, so every iteration
runs over counts by source and size, aggregated once before any shuffle of
documents, however hot a source is. Then the rates become whole copies: by
falling size, each cell rounds the running sum of the wanted copies, which
leaves a source less than one document from its target; cells whose size comes
nearest to what is left give or take single copies. Within a cell the documents
with the smallest hashes of id and text get the odd ones. Reruns agree, and
nothing of this needs Python.

Null and empty texts have size 0 and a null source is a source of its own,
ordered last. Texts of any length count whole. Rows that repeat an id, or have
none, are each mixed as rows of their own; equal rows get copies in any order.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codemap_spark.llm.scratch import fresh, join_ids, materialize, numbered

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
ROUNDS, CLOSE = 60, 1e-9
#: Cells (source, size) up to which they are broadcast; documents of a cell ranked together.
BROADCAST_CELLS, BUCKET = 200_000, 1000
#: Rounds that move single copies after rounding.
FIXES = 4


def size_of(text: Column) -> Column:
    """How many runs of other characters than space, tab and line ends the text has."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(spark: SparkSession, hist: DataFrame) -> DataFrame:
    """(skey, source_size, target) of each source, by filling up to the caps until no free source lies above its own."""
    src = numbered(spark, hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "skey", "place")
    w = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    src = materialize(spark, src.select("skey", "source_size", w.alias("w"), (F.col("source_size") * MOST).alias("cap")), "sources")
    level = 0.0
    while True:  # a level only rises and frees no source that it has capped
        over = F.col("w") * level > F.col("cap")
        s = src.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("full"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        next_ = ((s["all"] or 0) * SHARE - (s["full"] or 0.0)) / s["w"] if s["w"] else level
        if next_ <= level * (1 + 1e-15):
            break
        level = next_
    return src.select("skey", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def rate(t: Column, x: Column) -> Column:
    """exp(t * x), at most MOST."""
    return F.exp(F.least(t * x, F.log(F.lit(MOST))))


def multipliers(spark: SparkSession, hist: DataFrame, src: DataFrame) -> DataFrame:
    """src with the multiplier t and the scale of sizes, by Newton steps kept inside a bracket."""
    scale = hist.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("scale"))
    state = src.join(scale, "skey").select("skey", "source_size", "target", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))
    full = F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)
    state = state.select("*", F.when(full, float("inf")).otherwise(0.0).alias("t"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), full.alias("done"))
    state = materialize(spark, state, "multipliers")
    for _ in range(ROUNDS):
        if state.where("NOT done").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        r = rate(F.col("t"), x)
        moments = hist.where("size > 0").join(state.where("NOT done").select("skey", "t", "scale"), "skey").groupBy("skey").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("f"), F.sum(F.when(r < MOST, F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("df"))
        s = state.join(moments, "skey", "left")
        gap = F.col("f") - F.col("target")
        s = s.withColumn("close", F.col("done") | F.coalesce(F.abs(gap) <= CLOSE * F.greatest("target", F.lit(1.0)), F.lit(True)))
        s = s.withColumn("lo", F.when(gap < 0, F.col("t")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("t")).otherwise(F.col("hi")))
        step = F.when(F.col("df") > 0, F.col("t") - gap / F.col("df"))
        # A step that leaves the bracket is replaced by its middle, or by going twice as far on the open side.
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        open_ = (F.abs("lo") == float("inf")) | (F.abs("hi") == float("inf"))
        far = F.when(gap < 0, F.greatest(F.col("t") * 2, F.lit(1.0))).otherwise(F.least(F.col("t") * 2, F.lit(-1.0)))
        far = F.when(gap < 0, F.least(far, F.col("hi"))).otherwise(F.greatest(far, F.col("lo")))
        next_ = F.when(F.coalesce(inside, F.lit(False)) & (F.abs(step - F.col("t")) <= 4 + F.abs("t")), step).when(open_, far).otherwise((F.col("lo") + F.col("hi")) / 2)
        s = s.select("skey", "source_size", "target", "scale", F.when(F.col("close"), F.col("t")).otherwise(next_).alias("t"), "lo", "hi", F.col("close").alias("done"))
        state = materialize(spark, s, "multipliers")
    return state


def copies_by_cell(spark: SparkSession, hist: DataFrame, state: DataFrame) -> DataFrame:
    """hist with source_size, target, rate and the whole number of copies of each cell.

    Rounding the running sum keeps every prefix within half a copy, so a source
    is off by less than its largest document; each of FIXES rounds moves one
    copy in the cell whose size is nearest to what is left.
    """
    cells = hist.join(state.select("skey", "source_size", "target", "scale", "t"), "skey")
    wanted = F.when(F.col("size") == 0, 1.0).otherwise(rate(F.col("t"), F.col("size") / F.col("scale")))
    cells = cells.withColumn("rate", wanted)
    e = F.col("n") * F.col("rate")
    sum_ = F.sum(e - F.floor(e)).over(Window.partitionBy("skey").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    k = F.floor(e) + F.round(sum_ - 1e-9) - F.round(sum_ - (e - F.floor(e)) - 1e-9)
    cells = cells.select("skey", "size", "n", "source_size", "target", "rate", F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.greatest(k, F.lit(0)), F.col("n") * 2)).cast("long").alias("k"))
    cells = materialize(spark, cells, "copies")
    for _ in range(FIXES):
        gap = materialize(spark, cells.groupBy("skey", "target").agg((F.col("target") - F.sum(F.col("k") * F.col("size"))).alias("gap")), "gaps")
        may = cells.join(F.broadcast(gap.drop("target")) if gap.count() <= BROADCAST_CELLS else gap.drop("target"), "skey")
        may = may.where("size > 0 AND size < 2 * abs(gap) AND IF(gap > 0, k < 2 * n, k > 0)")
        step = materialize(spark, may.groupBy("skey").agg(F.min_by(F.struct("size", F.signum("gap").cast("long").alias("by")), F.struct(F.abs(F.abs("gap") - F.col("size")), "size")).alias("s")).select("skey", "s.size", "s.by"), "steps")
        if step.isEmpty():
            break
        cells = materialize(spark, cells.join(step, ["skey", "size"], "left").select("skey", "size", "n", "source_size", "target", "rate", (F.col("k") + F.coalesce("by", F.lit(0))).alias("k")), "copies")
    return cells


def _mix(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows (row, size, skey, h) with source_size, target, rate and copies."""
    hist = materialize(spark, rows.groupBy("skey", "size").agg(F.count("*").alias("n")), "cells")
    state = multipliers(spark, hist, materialize(spark, targets(spark, hist), "targets"))
    cells = copies_by_cell(spark, hist, state)
    small = cells.count() <= BROADCAST_CELLS
    d = rows.join(F.broadcast(cells) if small else cells, ["skey", "size"])
    d = d.withColumn("every", F.floor(F.col("k") / F.col("n")).cast("long")).withColumn("odd", F.col("k") % F.col("n"))
    d = d.withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("n") / F.lit(float(BUCKET))).cast("long")))
    counts = d.where("odd > 0").groupBy("skey", "size", "bucket").agg(F.count("*").alias("c"))
    before = counts.select("skey", "size", "bucket", (F.sum("c").over(Window.partitionBy("skey", "size").orderBy("bucket")) - F.col("c")).alias("before"))
    d = d.join(before, ["skey", "size", "bucket"], "left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("h", "row"))
    copies = F.col("every") + F.when(place <= F.col("odd"), 1).otherwise(0)
    return d.withColumn("copies", copies.cast("int"))


def _rows(docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    skey = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    return docs.select(row.alias("row"), size_of(F.col(text_col)).alias("size"), skey.alias("skey"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(20240607)).alias("h"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies, rate."""
    d = _mix(spark, materialize(spark, _rows(docs, F.col(id_col), id_col, text_col, source_col), "sizes"))
    return d.select(F.col("row").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


def mixed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all columns, each row as often as the mix takes it; rows are told apart by a number, not by their id."""
    row, copies = fresh(docs, "row"), fresh(docs, "copies")
    docs = materialize(spark, docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    d = _mix(spark, materialize(spark, _rows(docs, F.col(row), id_col, text_col, source_col), "sizes"))
    n = materialize(spark, d.where("copies <> 1").select(F.col("row").alias(row), F.col("copies").alias(copies)), "other")
    out = join_ids(docs, n, row, "left")
    return out.withColumn(copies, F.explode(F.expr(f"array_repeat(1, coalesce({copies}, 1))"))).drop(row, copies)
