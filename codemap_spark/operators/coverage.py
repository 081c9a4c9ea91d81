"""How much of the source is mapped, and what to do about the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemap_spark.functions.paths import is_config_file, is_test_file, percent, sampled

SAMPLE = 10


def classify(files: DataFrame, owned: DataFrame, supported: list[str], known: list[str] | None = None) -> DataFrame:
    """files (path, language, and where they exist ignored, gitignored) with owner and class.

    The order of the reasons counts: ignore rules, then tests, then what is no
    source, then who claims it; known are the languages that count as source.
    """
    f = files.join(owned.select("path", "owner"), "path", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in files.columns else F.lit(False)
    source = F.col("language").isNotNull() if known is None else F.coalesce(F.col("language").isin(*known), F.lit(False))
    ok = F.col("language").isin(*supported)
    owner = F.col("owner").isNotNull()
    kind = (
        F.when(flag("ignored"), "ignored").when(flag("gitignored"), "gitignored").when(is_test_file(F.col("path")), "test_file").when(~source, "non_source")
        .when(ok & owner, "mapped").when(ok & is_config_file(F.col("path")), "algorithm_miss").when(ok, "user_decision").when(owner, "declared").otherwise("dark")
    )
    return f.withColumn("class", kind)


def _n(kind: str) -> Column:
    return F.count_if(F.col("class") == kind)


def mapping(classified: DataFrame) -> DataFrame:
    """One row of counts: supported, mapped, user_decision, algorithm_miss, declared, dark, exclusions, permille."""
    agg = classified.agg(*(_n(k).alias(k) for k in ("mapped", "user_decision", "algorithm_miss", "declared", "dark", "ignored", "gitignored", "test_file", "non_source")))
    total = F.col("mapped") + F.col("user_decision") + F.col("algorithm_miss")
    return agg.select(total.alias("supported"), *agg.columns, percent(F.col("mapped"), total).alias("permille"))


def has_gap(mapped: DataFrame) -> DataFrame:
    """mapped with gap: whether anything can still be closed."""
    return mapped.withColumn("gap", F.col("user_decision") + F.col("algorithm_miss") + F.col("dark") > 0)


def samples(classified: DataFrame, kinds: tuple[str, ...] = ("user_decision", "algorithm_miss", "dark"), k: int = SAMPLE) -> DataFrame:
    """(class, n, sample): the first k paths of each kind, kept per task before they meet."""
    c = classified.where(F.col("class").isin(*kinds))
    return c.groupBy("class").agg(F.count("*").alias("n"), sampled(F.collect_list("path"), k).alias("sample"))


def by_language(classified: DataFrame) -> DataFrame:
    """(language, n) of source without an extractor."""
    return classified.where("class IN ('declared', 'dark')").groupBy("language").agg(F.count("*").alias("n"))


def next_step(mapped: DataFrame) -> DataFrame:
    """(next_step): the first action that helps."""
    then = F.when(F.col("user_decision") > 0, F.concat(F.lit(", then assign "), F.col("user_decision").cast("string"), F.lit(" files"))).otherwise("")
    step = (
        F.when(F.col("algorithm_miss") > 0, F.concat(F.lit("fix-coverage --auto"), then))
        .when(F.col("user_decision") > 0, F.concat(F.lit("assign "), F.col("user_decision").cast("string"), F.lit(" files")))
        .when(F.col("dark") > 0, F.concat(F.lit("declare "), F.col("dark").cast("string"), F.lit(" files"))).otherwise("complete")
    )
    return mapped.select(step.alias("next_step"))


#: What each class means to someone who asks about one path.
EXPLAINED = {
    "ignored": ("excluded_by_design", "matched an ignore file"), "gitignored": ("excluded_by_design", "ignored by git"), "test_file": ("excluded_test", "named or placed as a test"),
    "non_source": ("non_source", "no source language"), "mapped": ("owned", "claimed by a manifest"), "declared": ("unsupported_declared", "claimed by a manifest"), "dark": ("unsupported_declarable", "no extractor and no claim"),
    "algorithm_miss": ("algorithm_miss", "build or tool configuration"), "user_decision": ("needs_your_decision", "claimed by no manifest"),
}


def explain(classified: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, status, reason, owner) of asked paths; those outside the project and those that are no files are told apart."""
    c = classified.select("path", "class", "owner")
    table = F.create_map(*(F.lit(x) for k, (s, r) in EXPLAINED.items() for x in (k, f"{s}\t{r}")))
    j = asked.select("path").distinct().join(c, "path", "left")
    outside = F.col("path").startswith("/") | F.col("path").rlike(r"^(?:[^/]+/)*?\.\.(?:/|$)")
    told = F.when(outside, "outside_project\toutside the project").when(F.col("class").isNull(), "not_found\tno such file").otherwise(table[F.col("class")])
    p = F.split(told, "\t")
    return j.select("path", p[0].alias("status"), p[1].alias("reason"), F.when(F.col("class").isin("mapped", "declared"), F.col("owner")).alias("owner"))


def auto_rules(classified: DataFrame, existing: DataFrame) -> DataFrame:
    """(path) of misses that no ignore rule names yet."""
    return classified.where("class = 'algorithm_miss'").select("path").distinct().join(existing.select("path"), "path", "left_anti")


def linkage(linked: DataFrame) -> DataFrame:
    """(total, linked, unlinked) of documents or tests with an owner."""
    return linked.agg(F.count("*").alias("total"), F.count("owner").alias("linked"), F.count_if(F.col("owner").isNull()).alias("unlinked"))
