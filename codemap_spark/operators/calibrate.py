"""Reconciling declared contracts with what the code exports and imports: one plan a kind of change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codemap_spark.functions.keyed import by_key, sides

#: Changes that rewrite a manifest, and those that only show.
APPLIED = ("add_expose", "remove_expose", "add_consume", "add_consume_interface", "coarsen_consume", "remove_consume_interface", "remove_consume_edge", "reattribute_consume")
SHOWN = ("needs_review", "unknown_consume")
_KEYED = ("add_expose", "remove_expose", "add_consume", "add_consume_interface", "remove_consume_interface", "remove_consume_edge")


def _rows(df: DataFrame, change: str | Column, target: str | Column, detail: str | Column | None = None) -> DataFrame:
    col = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    return df.select(F.col("subsystem"), (F.lit(change) if isinstance(change, str) else change).alias("change"), col(target).cast("string").alias("target"), col(detail).cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_declarations(symbols: DataFrame) -> DataFrame:
    """(subsystem, name, kind, path): each name's first symbol in the order of paths and places; names that begin with _ are left out."""
    first = symbols.where(~F.col("name").cast("string").startswith("_")).groupBy("subsystem", "name").agg(F.min(F.struct("path", "ord", "kind")).alias("s"))
    return first.select("subsystem", "name", "s.kind", "s.path")


def exposes(declared: DataFrame, actual: DataFrame, consumed: DataFrame, unsupported: DataFrame, accept: bool = False, tasks: int | None = None) -> DataFrame:
    """(subsystem, change, target, detail) of a surface.

    declared has subsystem, name, internal; actual subsystem, name, kind,
    generated; consumed provider, name; unsupported the subsystems with files
    of languages without an extractor, whose interfaces are never proven gone.
    accept takes out what only other manifests hold. All may repeat rows.
    """
    key = ["subsystem", "name"]
    add = by_key(actual.where("NOT generated").select(*key, "kind"), tasks, *key).join(by_key(declared.select(*key), tasks, *key), key, "left_anti").distinct()
    per = sides(tasks, key, declared.where("NOT internal"), actual, consumed.select(F.col("provider").alias("subsystem"), "name"))
    dark = unsupported.select("subsystem").distinct().withColumn("dark", F.lit(True))
    gone = per.where("side IN (1, 5)").join(dark, "subsystem", "left")
    reason = F.when(F.col("dark"), "unsupported_language").when((F.col("side") == 5) & F.lit(not accept), "consumed_contract")
    change = F.when(reason.isNotNull(), "needs_review").otherwise("remove_expose")
    return _union([_rows(add, "add_expose", "name", "kind"), _rows(gone, change, "name", reason)])


def consumes(declared: DataFrame, used: DataFrame, exposed: DataFrame, known: DataFrame, track: bool = False, coarsen: bool = False) -> DataFrame:
    """(subsystem, change, target, detail) of the edges.

    declared has consumer, provider, name (null where an edge names no
    interface); used has consumer, provider, name (null for an import of no
    exposed name); exposed provider, name; known the subsystems' names.
    """
    d = declared.withColumnRenamed("consumer", "subsystem").distinct()
    edges = d.groupBy("subsystem", "provider").agg(F.max(F.col("name").isNotNull()).alias("tracked"))
    e = exposed.select("provider", "name").distinct()
    u = used.withColumnRenamed("consumer", "subsystem").join(known.select(F.col("subsystem").alias("provider")), "provider", "left_semi")
    real = u.select("subsystem", "provider").distinct()
    names = u.where("name IS NOT NULL").join(e, ["provider", "name"], "left_semi").select("subsystem", "provider", "name").distinct()
    both = ["subsystem", "provider"]
    listed = F.array_join(F.array_sort(F.collect_list("name")), ",")
    new = real.join(edges, both, "left_anti")
    if track:
        new = new.join(names, both, "left").groupBy(*both).agg(listed.alias("list"))
    parts = [_rows(new, "add_consume", "provider", "list" if track else None)]
    if not coarsen:
        more = names.join(edges if track else edges.where("tracked"), both, "left_semi").join(d.where("name IS NOT NULL"), [*both, "name"], "left_anti")
        parts.append(_rows(more, "add_consume_interface", "provider", "name"))
    else:
        parts.append(_rows(d.where("name IS NOT NULL").groupBy(*both).agg(listed.alias("list")), "coarsen_consume", "provider", "list"))
    alive = edges.join(known.select(F.col("subsystem").alias("provider")), "provider", "left_semi")
    parts.append(_rows(edges.join(known.select(F.col("subsystem").alias("provider")), "provider", "left_anti"), "unknown_consume", "provider"))
    parts.append(_rows(alive.join(real, both, "left_anti"), "remove_consume_edge", "provider"))
    stale = d.where("name IS NOT NULL").join(alive, both, "left_semi").join(e, ["provider", "name"], "left_anti").select(*both, "name")
    parts.append(_rows(stale.join(real, both, "left_semi"), "remove_consume_interface", "provider", "name"))
    # Where the interface is imported from now: the first provider by name.
    owner = names.groupBy("subsystem", "name").agg(F.min("provider").alias("owner"))
    moved = stale.join(owner, ["subsystem", "name"]).where("owner <> provider")
    parts.append(_rows(moved, "reattribute_consume", "owner", F.concat_ws(":", F.col("provider").cast("string"), F.col("name").cast("string"))))
    return _union(parts)


def changed(proposals: DataFrame, prune_unknown: bool = False) -> DataFrame:
    """(subsystem, any, applicable): whether anything differs, and whether applying it writes."""
    writes = F.col("change").isin(*APPLIED) | (F.lit(prune_unknown) & (F.col("change") == "unknown_consume"))
    return proposals.groupBy("subsystem").agg(F.max(F.col("change") != "reattribute_consume").alias("any"), F.max(writes & (F.col("change") != "reattribute_consume")).alias("applicable"))


def summary(proposals: DataFrame) -> DataFrame:
    """(change, n, subsystems) over all kinds that occur."""
    return proposals.groupBy("change").agg(F.count("*").alias("n"), F.countDistinct("subsystem").alias("subsystems"))


def drift_keys(proposals: DataFrame, tasks: int | None = None) -> DataFrame:
    """(key): one tab-joined key a change that the gate knows; what needs review is never one."""
    target = F.when(F.col("change") == "add_consume", F.concat_ws(":", "target", F.coalesce("detail", F.lit("")))).when(F.col("change").endswith("_interface"), F.concat_ws(":", "target", "detail")).otherwise(F.col("target"))
    keys = proposals.where(F.col("change").isin(*_KEYED)).select(F.concat_ws("\t", F.col("subsystem").cast("string"), "change", target).alias("key"))
    return by_key(keys, tasks, "key").distinct()


def drift_check(now: DataFrame, baseline: DataFrame, tasks: int | None = None) -> DataFrame:
    """(key, status): new since the baseline, or resolved."""
    return sides(tasks, ["key"], now, baseline).where("side < 3").select("key", F.when(F.col("side") == 1, "new").otherwise("resolved").alias("status"))


def key_parts(keys: DataFrame) -> DataFrame:
    """(subsystem, change, target) of drift keys."""
    p = F.split("key", "\t")
    return keys.select(p[0].alias("subsystem"), p[1].alias("change"), p[2].alias("target"))


def ranked_first(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
