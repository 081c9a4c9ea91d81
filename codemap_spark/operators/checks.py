"""Checks between declared interfaces, code and the edges that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemap_spark.functions.keyed import by_key, sides
from codemap_spark.functions.paths import sampled
from codemap_spark.operators.graph import _saved

SEVERITY = {
    "E_STRUCTURAL_DRIFT": "error", "E_BOUNDARY_VIOLATION": "error", "E_CONTRACT_MISSING_EXPORT": "error", "E_UNRESOLVED_REFERENCE": "warning", "E_STALE_INTERFACE": "error",
    "E_CYCLE_DETECTED": "error", "E_COMPOSITION_ROOT": "warning", "E_ORPHAN_EXPORT": "warning", "E_UNOWNED_FILE": "error", "E_COVERAGE_GAP": "warning",
    "E_SCHEMA_INVALID": "error", "E_SUBSYSTEM_NOT_FOUND": "error", "E_MANIFEST_PARSE_ERROR": "error", "E_EXTERNAL_SYMLINK": "warning", "E_UNSUPPORTED_LANGUAGE": "warning",
    "E_SUBSYSTEM_OVERLAP": "warning", "E_EXTRACTION_FAILED": "warning", "E_SCHEMA_UNPARSED": "warning", "E_SCHEMA_NO_ORDER": "warning", "E_ADAPTER_CONTRACT": "warning", "E_UNSUPPORTED_SURFACE_STALE": "warning",
}


def drift_missing(declared: DataFrame, actual: DataFrame, tasks: int | None = None) -> DataFrame:
    """(subsystem, name) declared but not in the code, each once; both may repeat rows."""
    return sides(tasks, ["subsystem", "name"], declared, actual).where("side = 1").select("subsystem", "name")


def drift_undeclared(declared: DataFrame, actual: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(subsystem, n, sample): exports of subsystems that declare something, but not these."""
    extra = actual.join(declared, ["subsystem", "name"], "left_anti").join(declared.select("subsystem").distinct(), "subsystem", "left_semi")
    return extra.groupBy("subsystem").agg(F.count("*").alias("n"), sampled(F.collect_list(F.lpad(F.col("name").cast("string"), 8, "0"))).alias("sample"))


def contract_missing(consumed: DataFrame, declared: DataFrame) -> DataFrame:
    """(consumer, provider, name): interfaces consumed of a known provider that doesn't declare them."""
    known = declared.select(F.col("subsystem").alias("provider")).distinct()
    return consumed.join(declared.select(F.col("subsystem").alias("provider"), "name"), ["provider", "name"], "left_anti").join(known, "provider", "left_semi").select("consumer", "provider", "name")


def unresolved(consumed: DataFrame, declared: DataFrame) -> DataFrame:
    """(consumer, provider) whose provider declares nothing at all."""
    return consumed.join(declared.select(F.col("subsystem").alias("provider")).distinct(), "provider", "left_anti").select("consumer", "provider").distinct()


def boundary(used: DataFrame, actual: DataFrame, declared: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each use of a provider's symbol that it does not declare; uses of the own subsystem don't count. actual and declared may repeat rows."""
    key = ["provider", "name"]
    # One aggregate tells what is a symbol and not declared, in place of a semi and an anti join on one key.
    inner = sides(tasks, ["subsystem", "name"], actual, declared).where("side = 1").select(F.col("subsystem").alias("provider"), "name")
    return by_key(used.where("consumer <> provider"), tasks, *key).join(inner, key, "left_semi")


def orphans(declared: DataFrame, consumed: DataFrame, tasks: int | None = None) -> DataFrame:
    """(subsystem, name): declared, but consumed by none, of providers of which anything is consumed; both may repeat rows. A null name is never consumed."""
    per = sides(tasks, ["subsystem", "name"], declared, consumed.select(F.col("provider").alias("subsystem"), "name"))
    tracked = per.where("side >= 2").select("subsystem").distinct()
    return per.where("side = 1 OR (side = 3 AND name IS NULL)").join(tracked, "subsystem", "left_semi").select("subsystem", "name")


def orphan_rollup(orphaned: DataFrame) -> DataFrame:
    """(subsystem, n, sample): one row a subsystem."""
    return orphaned.groupBy("subsystem").agg(F.count("*").alias("n"), sampled(F.collect_list(F.col("name").cast("string"))).alias("sample"))


def contract_columns(missing: DataFrame, declared: DataFrame, tables: DataFrame) -> DataFrame:
    """missing (with provider, name) without names ``table.column`` whose table is declared and still has the column."""
    parts = F.split(F.col("name").cast("string"), r"\.", 2)
    live = tables.select(F.col("subsystem").alias("provider"), F.col("tbl").alias("t"), F.explode("columns").alias("c")).distinct()
    d = declared.select(F.col("subsystem").alias("provider"), F.col("name").cast("string").alias("t")).distinct()
    live = live.join(d, ["provider", "t"], "left_semi").select("provider", F.concat_ws(".", "t", "c").alias("full"))
    m = missing.withColumn("full", F.when(F.size(parts) > 1, F.col("name").cast("string")))
    return m.join(live, ["provider", "full"], "left_anti").select(*missing.columns)


def stale_interfaces(edges: DataFrame, propagated: DataFrame, dirty: DataFrame) -> DataFrame:
    """(consumer, providers): propagated consumers with those of their providers that changed; none where they lie further up."""
    hit = edges.join(dirty.select(F.col("id").alias("v")), "v", "left_semi").groupBy(F.col("u").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("v")), lambda x: x.cast("string")), ",").alias("providers"))
    return propagated.join(hit, "id", "left").select(F.col("id").alias("consumer"), "providers")


def cross_impact(edges: DataFrame, dirty: DataFrame) -> DataFrame:
    """(consumer, providers): consumers with their changed providers."""
    hit = edges.join(dirty.select(F.col("id").alias("v")), "v", "left_semi")
    return hit.groupBy(F.col("u").alias("consumer")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("v")), lambda x: x.cast("string")), ",").alias("providers"))


def undeclared_edges(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(u, v) in the code, but not declared."""
    return found.join(declared, ["u", "v"], "left_anti").select("u", "v").distinct()


def issues(df: DataFrame, code: str, subsystem: str, message) -> DataFrame:
    """Rows of a check as findings with the code's canonical severity."""
    return df.select(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), F.col(subsystem).cast("string").alias("subsystem"), message.alias("message"))


def apply_policy(found: DataFrame, rules: DataFrame) -> DataFrame:
    """found with severity and suppressed by the first rule whose filled fields all match.

    The lines of a rule file become one chain of conditions: no join, no
    shuffle, and equal findings stay apart.
    """
    action = F.lit(None).cast("string")
    for r in sorted(rules.collect(), key=lambda r: r.rule_ord, reverse=True):
        match = F.lit(True)
        for field, value in (("code", r.code), ("subsystem", r.subsystem)):
            match = match if value is None else match & (F.col(field) == value)
        match = match if r.contains is None else match & F.col("message").contains(r.contains)
        action = F.when(match, r.action).otherwise(action)
    rows = found.withColumn("action", action)
    severity = F.when(F.col("action") == "suppress", "info").otherwise(F.coalesce("action", "severity"))
    keep = [c for c in found.columns if c not in ("code", "subsystem", "message", "severity")]
    return rows.select("code", "subsystem", "message", severity.alias("severity"), F.coalesce(F.col("action") == "suppress", F.lit(False)).alias("suppressed"), *keep)


def ranked(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """found with its place in the report: severity, code, subsystem, file where there is one, message.

    Ranges of that order, of a number that tasks gives, are sorted and numbered
    where they lie, and each goes on from the count of those before it; only the
    counts meet in one task. The numbered ranges are saved first, as a second
    sampling could cut them elsewhere.
    """
    from pyspark.sql import Window

    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    file = [F.coalesce("file", F.lit(""))] if "file" in found.columns else []
    order = [rank, F.col("code"), F.coalesce("subsystem", F.lit("")), *file, F.col("message")]
    ranges = found.repartitionByRange(tasks, *order) if tasks else found.repartitionByRange(*order)
    # The id is the range's number before 33 bits that count its rows from 0.
    parts = _saved(found.sparkSession, ranges.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    parts = parts.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return parts.join(F.broadcast(starts), "part").select(*found.columns, (F.col("start") + F.col("place") + 1).cast("long").alias("rank"))


def tsv(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws("\t", "severity", "code", F.coalesce("subsystem", F.lit("-")), "message").alias("line"))


def gate(found: DataFrame, mode: str = "full", enforce: str = "on", fail_on: tuple[str, ...] = ()) -> DataFrame:
    """(status, blocked): one row. Unowned errors always block, then advisory modes never, then fail_on, then the mode."""
    live = ~F.col("suppressed")
    err = live & (F.col("severity") == "error")
    n = found.agg(F.count_if(err).alias("errors"), F.count_if(err & (F.col("code") == "E_UNOWNED_FILE")).alias("unowned"), F.count_if(F.col("code") == "E_UNRESOLVED_REFERENCE").alias("unresolved"), F.count_if(live & F.col("code").isin(*fail_on) if fail_on else F.lit(False)).alias("failing"))
    advisory, strict = F.lit(mode in ("audit", "hotfix")), F.lit(mode == "preflight" and enforce != "warn" or mode == "full" and enforce == "on")
    blocked = F.when(F.col("unowned") > 0, True).when(advisory, False).when(F.col("failing") > 0, True).when(F.lit(enforce == "warn"), False).otherwise(strict & (F.col("errors") > 0))
    status = F.when(F.col("errors") > 0, "stale").when(F.col("unresolved") > 0, "unresolved").otherwise("fresh")
    return n.select(status.alias("status"), blocked.alias("blocked"))


def tally(found: DataFrame) -> DataFrame:
    """(code, severity, n): findings by code, each weighted by the count that it stands for."""
    n = F.coalesce(F.col("count"), F.lit(1)) if "count" in found.columns else F.lit(1)
    return found.groupBy("code", "severity").agg(F.sum(n.cast("long")).alias("n"))


#: In which order kinds of findings are best mended, and how.
LADDER = [
    ("E_COVERAGE_GAP", "map the files"), ("E_CYCLE_DETECTED", "break the cycle in the source"), ("E_STRUCTURAL_DRIFT", "calibrate"), ("E_CONTRACT_MISSING_EXPORT", "calibrate"), ("E_STALE_INTERFACE", "calibrate"),
    ("E_UNRESOLVED_REFERENCE", "declare, rename or prune the reference"), ("E_BOUNDARY_VIOLATION", "import what is exposed"), ("E_SUBSYSTEM_OVERLAP", "narrow a claim"), ("E_UNSUPPORTED_SURFACE_STALE", "look at the interfaces and confirm them"),
]


def ladder(found: DataFrame) -> DataFrame:
    """(step, action): what to do, in order, for the codes that occur; codes with one action share its step."""
    rung = {a: k for k, a in enumerate(dict.fromkeys(a for _, a in LADDER), 1)}
    step = F.create_map(*(F.lit(x) for code, a in LADDER for x in (code, rung[a])))
    name = F.create_map(*(F.lit(x) for code, a in LADDER for x in (code, a)))
    return found.select(step[F.col("code")].alias("step"), name[F.col("code")].alias("action")).where("step IS NOT NULL").distinct()


def fail_codes(given: list[str], policy: list[str]) -> list[str]:
    """Codes that fail a run, those of the call first, each once."""
    split = [c.strip() for g in given for c in g.split(",")]
    return list(dict.fromkeys(c for c in [*split, *policy] if c))
