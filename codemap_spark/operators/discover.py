"""Subsystems that a tree suggests: candidates, their edges and what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemap_spark.functions.paths import is_framework_entry, is_test_file, is_test_symbol
from codemap_spark.operators.calibrate import ranked_first

SCHEMA = ("sql", "prisma")


def grouped(files: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """files with candidate: the first merge whose prefix holds the file, else its folder; files at the top have none.

    merges has ord, name, prefix.
    """
    own = files.withColumn("folder", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")))
    if merges is None:
        return own.withColumn("candidate", F.col("folder"))
    parts = F.split("path", "/")
    above = own.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    hit = above.join(merges, "prefix").groupBy("path").agg(F.min_by("name", "ord").alias("merged"))
    return own.join(hit, "path", "left").withColumn("candidate", F.coalesce("merged", "folder"))


def scored(grouped_: DataFrame, merged: list[str] = ()) -> DataFrame:
    """(candidate, n, score, kept): five files are sure, three likely; schema folders and merges stay at any size."""
    n = grouped_.where("candidate IS NOT NULL").groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.col("language").isin(*SCHEMA)).alias("s"))
    score = F.when((F.col("s") >= 1) & (F.col("s") * 2 >= F.col("n")), "schema").when(F.col("n") >= 5, "high").when(F.col("n") >= 3, "medium").otherwise("low")
    n = n.select("candidate", "n", score.alias("score"))
    return n.withColumn("kept", (F.col("score") != "low") | F.col("candidate").isin(*merged))


def edges(imports: DataFrame, kept: DataFrame) -> DataFrame:
    """(u, v): imports between candidates that stay; imports has consumer, provider."""
    e = imports.where("consumer <> provider").select(F.col("consumer").alias("u"), F.col("provider").alias("v")).distinct()
    k = kept.select(F.col("candidate").alias("k"))
    return e.join(k.withColumnRenamed("k", "u"), "u", "left_semi").join(k.withColumnRenamed("k", "v"), "v", "left_semi").select("u", "v")


def roles(degrees: DataFrame) -> DataFrame:
    """(id, role, criticality) from fan_in and fan_out."""
    i, o = F.col("fan_in"), F.col("fan_out")
    role = F.when(i >= 3, "library").when((o > 0) & (i == 0), "service").when((o > 0) & (i > 0), "connector").otherwise("library")
    return degrees.select("id", role.alias("role"), F.when(i >= 3, "core").when(i >= 1, "connector").otherwise("leaf").alias("criticality"))


def surface(symbols: DataFrame) -> DataFrame:
    """(candidate, name, kind, path): exported names, a declaration before what is only passed on, then the first.

    symbols has candidate, path, ord, name, kind, exported, generated.
    """
    p = F.col("path")
    s = symbols.where(F.col("exported") & ~F.col("generated") & ~is_framework_entry(p) & ~(is_test_file(p) & is_test_symbol(F.col("name"), F.col("kind"))))
    return ranked_first(s, ["candidate", "name"], [F.col("kind") == "unknown", "path", "ord"]).select("candidate", "name", "kind", "path")
