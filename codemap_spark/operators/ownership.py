"""Who owns a file: prefix joins with the most specific claim, ties to the smallest name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codemap_spark.functions.paths import prefixes


def claims_of(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, owner, spec): every claim on a file; spec is the claimed prefix's depth plus one, 0 for '.'."""
    above = files.select("path", F.explode(F.concat(prefixes(F.col("path")), F.array(F.lit(".")))).alias("prefix"))
    spec = F.when(F.col("prefix") == ".", 0).otherwise(F.size(F.split("prefix", "/")) + F.when(F.col("prefix") == F.col("path"), 2).otherwise(1))
    return above.join(claims.select("owner", "prefix").distinct(), "prefix").groupBy("path", "owner").agg(F.max(spec).alias("spec"))


def owners(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, owner, spec) of the winning claim."""
    first = Window.partitionBy("path").orderBy(F.desc("spec"), "owner")
    return claims_of(files, claims).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def overlaps(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(contenders, n_files): sets of owners that tie at the winning depth."""
    best = claims_of(files, claims).withColumn("m", F.max("spec").over(Window.partitionBy("path"))).where("spec = m AND spec > 0")
    sets = best.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("contenders"), F.count("*").alias("k")).where("k > 1")
    return sets.groupBy("contenders").agg(F.count("*").alias("n_files"))


def linked(docs: DataFrame, claims: DataFrame, names: DataFrame) -> DataFrame:
    """(path, owner): an explicit claim, else a folder named after the owner, else the stem; first that holds."""
    explicit = owners(docs, claims.where("prefix <> '.'")).select("path", F.col("owner").alias("o1"))
    parts = F.split("path", "/")
    folder = docs.select("path", F.explode(F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))).alias("owner")).join(names, "owner").groupBy("path").agg(F.min("owner").alias("o2"))
    stem = docs.select("path", F.regexp_replace(F.element_at(parts, -1), r"\..*$", "").alias("owner")).join(names, "owner").select("path", F.col("owner").alias("o3"))
    out = docs.select("path").join(explicit, "path", "left").join(folder, "path", "left").join(stem, "path", "left")
    return out.select("path", F.coalesce("o1", "o2", "o3").alias("owner"))


def coverage(files: DataFrame, owned: DataFrame, supported: list[str]) -> DataFrame:
    """(language, total, supported, mapped, dark, percent) and the status of each language."""
    f = files.select("path", "language").join(owned.select("path", "owner"), "path", "left").withColumn("s", F.col("language").isin(*supported))
    agg = f.groupBy("language").agg(F.count("*").alias("total"), F.count_if("s").alias("supported"), F.count_if(F.col("s") & F.col("owner").isNotNull()).alias("mapped"), F.count_if(~F.col("s") & F.col("owner").isNull()).alias("dark"))
    from codemap_spark.functions.paths import percent

    return agg.withColumn("permille", percent(F.col("mapped"), F.col("supported")))


def explain(files: DataFrame, owned: DataFrame, supported: list[str]) -> DataFrame:
    """(path, status): an ordered list of reasons, the first that holds."""
    from codemap_spark.functions.paths import is_config_file, is_generated, is_test_file

    f = files.join(owned.select("path", "owner"), "path", "left")
    status = (
        F.when(is_test_file(F.col("path")), "test_file").when(is_config_file(F.col("path")), "config_file").when(is_generated(F.col("text")), "generated")
        .when(~F.col("language").isin(*supported) & F.col("owner").isNotNull(), "declared_unsupported").when(~F.col("language").isin(*supported), "dark")
        .when(F.col("owner").isNotNull(), "mapped").otherwise("unowned")
    )
    return f.select("path", status.alias("status"))
