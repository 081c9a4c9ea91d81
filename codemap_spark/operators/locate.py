"""Finding symbols and files, and who is hit when they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap_spark.operators.graph import reached_from

NEAR, HITS = 8, 6


def by_path(symbols: DataFrame, exposed: DataFrame, path: str) -> DataFrame:
    """(name, line, kind, subsystem, exposed) of all that a file defines."""
    e = exposed.select("subsystem", "name").distinct().withColumn("e", F.lit(True))
    s = symbols.where(F.col("path") == path).join(e, ["subsystem", "name"], "left")
    return s.select("name", "line", "kind", "subsystem", F.coalesce("e", F.lit(False)).alias("exposed")).orderBy("name", "line", "kind")


def near_symbols(symbols: DataFrame, query: str, k: int = NEAR) -> DataFrame:
    """(name, subsystem): the first names that contain the query, each once a subsystem."""
    hit = symbols.where(F.lower("name").contains(query.lower())).select("name", F.coalesce("subsystem", F.lit("")).alias("subsystem")).distinct()
    return hit.orderBy("name", "subsystem").limit(k)


def near_subsystems(subsystems: DataFrame, query: str, k: int = HITS) -> DataFrame:
    """(subsystem, matched_on): subsystems whose name, or else description, mentions the query."""
    q = query.lower()
    named, told = F.lower("subsystem").contains(q), F.coalesce(F.lower("description").contains(q), F.lit(False))
    return subsystems.where(named | told).select("subsystem", F.when(named, "name").otherwise("description").alias("matched_on")).orderBy("subsystem").limit(k)


def interface_impact(spark: SparkSession, consumed: DataFrame, edges: DataFrame, name) -> DataFrame:
    """(consumer, direct): who names an interface, and who consumes these in turn; edges are (u, v) with u consuming v."""
    direct = consumed.where(F.col("name") == name).select(F.col("consumer").alias("id")).distinct()
    far = reached_from(spark, edges, direct).select("id").distinct()
    all_ = direct.withColumn("direct", F.lit(True)).unionByName(far.join(direct, "id", "left_anti").withColumn("direct", F.lit(False)))
    return all_.select(F.col("id").alias("consumer"), "direct")


def undeclared(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(consumer, provider, n_files): imports across subsystems that no manifest declares; used has consumer, provider, path."""
    extra = used.where("consumer <> provider").join(declared.select("consumer", "provider").distinct(), ["consumer", "provider"], "left_anti")
    return extra.groupBy("consumer", "provider").agg(F.countDistinct("path").alias("n_files"))


#: Questions about structure: an inclusive test, as a miss costs nothing.
SHAPES = (
    r"(?i)\b(?:what|which)\s+(?:file|function|module|subsystem|component|part)s?\b|\b(?:what|who)\s+(?:depends?\s+on|breaks?|calls?|uses?|imports?)\b"
    r"|\b(?:depends?\s+on|consumed?\s+by|blast\s+radius|impact\s+of)\b|\bwhere\s+(?:is|are|does|do)\b|\bhow\s+(?:does|do|is|are)\b.{0,40}\b(?:work|wired|connect|structured|architect)"
    r"|\b(?:architecture|data\s*flow|call\s*graph|dependenc(?:y|ies))\b|\bneeds?\s+to\s+(?:touch|change|modify|edit)\b|\b(?:trace|map\s+out|understand)\b.{0,30}\b(?:code|flow|system|app|project|repo)"
)


def is_architectural(prompt):
    """Whether a prompt asks about structure."""
    return F.coalesce(prompt.rlike(SHAPES), F.lit(False))


def covered_targets(targets: DataFrame, exposed: DataFrame, subsystems: DataFrame) -> DataFrame:
    """targets (id, text) that the declared surface names: a word that is exposed, or a subsystem's name; neither is guessed."""
    words = targets.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z_][a-z0-9_]{2,})"), F.lit(1)))).alias("w"))
    known = exposed.select(F.lower(F.col("name").cast("string")).alias("w")).unionByName(subsystems.where(F.length("subsystem") >= 3).select(F.lower("subsystem").alias("w"))).distinct()
    return words.join(known, "w", "left_semi").select("id").distinct()


def once(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key: a note is given once a session."""
    first = events.groupBy(*keys).agg(F.min(F.struct(*order)).alias("f"))
    return first.select(*keys, *(F.col(f"f.{c}").alias(c) for c in order))
