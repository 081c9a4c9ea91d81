"""Parquet tables, and the fact relations that stand in for a source tree on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codemap_spark.functions.keyed import by_key

#: Bytes of a table's files that one task of a step by key is given; some 300,000 lines of the test tables.
SHARE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int | None:
    """Tasks for a step over all rows of a table by key, in proportion to its files; None where they are small and Spark's own number does."""
    size = int(str(table(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(spark.sparkContext.defaultParallelism, -(-size // SHARE)) if size > SHARE else None


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsystems: id, name, namespace, role, criticality."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    role = F.element_at(F.array(*map(F.lit, ("service", "platform", "connector", "library"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    crit = F.element_at(F.array(*map(F.lit, ("core", "connector", "leaf"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("namespace"), role.alias("role"), crit.alias("criticality"))


def edges(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """Consumer u consumes provider v; distinct, thinned to a sparse graph."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("u"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("v"))
    pairs = li.join(o, li.l_orderkey == o.o_orderkey).select("l_suppkey", "o_custkey").distinct()
    pairs = pairs.join(c, pairs.o_custkey == c.c_custkey).join(s, pairs.l_suppkey == s.s_suppkey)
    return pairs.where((F.col("u") != F.col("v")) & (F.pmod(F.col("u") * 7 + F.col("v") * 13, F.lit(25)) < k)).select("u", "v").distinct()


def surface_lines(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """(subsystem, name), a row a line: 'O' lines declare an interface, 'F' lines are found in the code."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status)
    return li.select(F.col("l_suppkey").alias("subsystem"), F.col("l_partkey").alias("name"))


def surface(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """surface_lines(), each interface once."""
    return by_key(surface_lines(spark, sf_dir, status), tasks(spark, sf_dir), "subsystem", "name").distinct()


def consumed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(consumer, provider, name), a row a line: returned and late lines use an interface of their supplier."""
    n = tasks(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' OR l_shipdate >= TIMESTAMP '1998-01-01'").select("l_orderkey", F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("name"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("consumer"))
    j = by_key(li, n, "l_orderkey").join(by_key(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("consumer", "provider", "name")


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """consumed_lines(), each use once."""
    return by_key(consumed_lines(spark, sf_dir), tasks(spark, sf_dir), "provider", "name").distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: path, language, source, doc_id, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat_ws(".", F.col("doc_id").cast("string"), "lang")).alias("path"), F.col("lang").alias("language"), "source", "doc_id", "text")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, prefix): every source folder, the English part of even ones, and a second claim on every fifth."""
    s = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", F.regexp_extract("source", r"(\d+)", 1).cast("int"))
    base = s.select(F.concat(F.lit("s"), F.col("n")).alias("owner"), F.col("source").alias("prefix"))
    part = s.where("n % 2 = 0").select(F.concat(F.lit("s"), F.col("n"), F.lit("_en")).alias("owner"), F.concat(F.col("source"), F.lit("/en")).alias("prefix"))
    twice = s.where("n % 5 = 0").select(F.concat(F.lit("t"), F.col("n")).alias("owner"), F.col("source").alias("prefix"))
    return base.unionByName(part).unionByName(twice)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): the url's path without query, fragment and slash at its ends."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", ""), "^/+|/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, module): two imports of every page."""
    p = page_files(spark, sf_dir)
    one = p.select("page_id", F.lit(0).cast("long").alias("ord"), F.concat(F.lit("en/"), (F.col("page_id") * 37 % 1000).cast("string")).alias("module"))
    two = p.select("page_id", F.lit(1).cast("long").alias("ord"), F.concat(F.lit("en/"), F.regexp_extract("path", r"(\d+)$", 1)).alias("module"))
    return one.unionByName(two)


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema operations: tbl, seq, op, col."""
    e = table(spark, sf_dir, "events")
    op = F.create_map(*map(F.lit, ("signup", "create_table", "view", "add_column", "click", "drop_column", "error", "drop_table", "purchase", "rename_column")))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("tbl"), seq.cast("long").alias("seq"), op[F.col("event_type")].alias("op"), F.get_json_object("props", "$.k").alias("col"))


def previous_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved state (path, content_hash) of an earlier run: some files changed since, some are new, some went."""
    f = files(spark, sf_dir).where("doc_id % 10 <> 7")
    text: Column = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    gone = files(spark, sf_dir).where("doc_id % 25 = 0").select(F.concat(F.lit("old/"), "path").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return f.select("path", F.sha2(text, 256).alias("content_hash")).unionByName(gone)
