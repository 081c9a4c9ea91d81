"""Re-evaluation against a saved state table, and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap_spark.functions.keyed import sides


def compared(now: DataFrame, state: DataFrame) -> DataFrame:
    """(path, change): hit, changed, new or deleted, from content hashes."""
    both = now.select("path", F.col("content_hash").alias("h")).join(state.select("path", F.col("content_hash").alias("p")), "path", "full_outer")
    change = F.when(F.col("h").isNull(), "deleted").when(F.col("p").isNull(), "new").when(F.col("h") == F.col("p"), "hit").otherwise("changed")
    return both.select("path", change.alias("change"))


def merged(now: DataFrame, state: DataFrame, live: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """The next state: now's rows, and those of the state that now does not replace, of live paths, under their present owner."""
    old = state.join(now.select("path"), "path", "left_anti")
    if live is not None:
        old = old.join(live.select("path").distinct(), "path", "left_semi")
    out = now.unionByName(old)
    if owners is None:
        return out
    o = owners.select("path", F.col("owner").alias("subsystem"))
    return out.drop("subsystem").join(o, "path", "left").select(*now.columns)


def dirty(now: DataFrame, state: DataFrame) -> DataFrame:
    """(path): files whose structure differs from the saved one; new files and cold starts make nothing dirty."""
    both = now.select("path", F.col("structure_hash").alias("h")).join(state.select("path", F.col("structure_hash").alias("p")), "path")
    return both.where("NOT h <=> p").select("path")


def vanished_owners(state: DataFrame, live: DataFrame) -> DataFrame:
    """(subsystem): owners of saved paths that are gone; to be asked before the state is pruned."""
    return state.join(live.select("path"), "path", "left_anti").where("subsystem IS NOT NULL").select("subsystem").distinct()


def pruned(state: DataFrame, live: DataFrame) -> DataFrame:
    """The state without paths that are gone."""
    return state.join(live.select("path").distinct(), "path", "left_semi")


def baseline_diff(current: DataFrame, baseline: DataFrame, tasks: int | None = None) -> DataFrame:
    """current's columns and change: new above the baseline, or resolved since; each row once."""
    keys = current.columns
    return sides(tasks, keys, current, baseline).where("side < 3").select(*keys, F.when(F.col("side") == 1, "new").otherwise("resolved").alias("change"))


def surface_stale(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(path, why): baselined surfaces that changed or went; additions don't count."""
    b = baseline.select("path", F.col("content_hash").alias("b")).join(current.select("path", F.col("content_hash").alias("c")), "path", "left")
    return b.where(F.col("c").isNull() | (F.col("c") != F.col("b"))).select("path", F.when(F.col("c").isNull(), "removed").otherwise("changed").alias("why"))


def write_state(state: DataFrame, path: str, version: int = 1) -> None:
    """Partitioned by subsystem, so one subsystem's part is pruned at the scan; the version is in the path."""
    out = state.write.mode("overwrite")
    (out.partitionBy("subsystem") if "subsystem" in state.columns else out).parquet(f"{path}/v={version}")


def read_state(spark: SparkSession, path: str, schema, subsystem: str | None = None, version: int = 1) -> DataFrame:
    """The saved state, empty where there is none of this version."""
    from pyspark.errors import AnalysisException

    at = f"{path}/v={version}"
    try:
        df = spark.read.schema(schema).parquet(at)
    except AnalysisException as e:  # only a missing table is a cold start
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.where(F.col("subsystem") == subsystem) if subsystem is not None else df


def migrate(spark: SparkSession, path: str, schema, old: int, new: int) -> bool:
    """Rewrite a state of an old version under the new one; columns that it lacks are null. False where there is none."""
    found = read_state(spark, path, schema, version=old)
    if found.isEmpty():
        return False
    write_state(found, path, new)
    return True


def inspect(state: DataFrame) -> DataFrame:
    """(subsystem, language, n) in total and by either."""
    return state.groupingSets([("subsystem",), ("language",), ()], "subsystem", "language").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
