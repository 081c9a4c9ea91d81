"""Folding an ordered log of schema operations to the state that it leaves."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live_columns(log: DataFrame) -> DataFrame:
    """(tbl, col) alive at the end of a log without renames: a column's last add stands after its last drop and its table's last create or drop."""
    w = Window.partitionBy("tbl")
    reset = F.max(F.when(F.col("op").isin("create_table", "drop_table"), F.col("seq"))).over(w)
    rows = log.withColumn("reset", F.coalesce(reset, F.lit(0)))
    last = rows.where(F.col("op").isin("add_column", "drop_column") & F.col("col").isNotNull() & (F.col("seq") > F.col("reset"))).groupBy("tbl", "col").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'add_column'").select("tbl", "col")


def fold_rows(rows: list[tuple]) -> dict[str, set[str]]:
    """Tables and columns after (op, table, column, columns, to) in order."""
    state: dict[str, set[str]] = {}
    for op, table, column, columns, to in rows:
        if op == "create_table":
            state[table] = set(columns if columns is not None else ())
        elif op == "add_column":
            state.setdefault(table, set()).add(column)
        elif op == "drop_column":
            state.get(table, set()).discard(column)
        elif op == "rename_column" and column in state.get(table, ()):
            state[table].discard(column)
            state[table].add(to)
        elif op == "drop_table":
            state.pop(table, None)
        elif op == "rename_table":
            state[to] = state.pop(table, set())
    return state


def fold_tables(log: DataFrame) -> DataFrame:
    """(subsystem, tbl, columns) of a log with renames: subsystem, rank, ord, op, tbl, col, columns, to.

    Renames make the fold depend on order, so each subsystem's log is one group;
    a subsystem's migrations, not the number of subsystems, bound it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "ord"])
        state = fold_rows(list(zip(pdf.op, pdf.tbl, pdf.col, pdf["columns"], pdf.to, strict=True)))
        return pd.DataFrame([(pdf.subsystem.iloc[0], t, sorted(c)) for t, c in sorted(state.items())], columns=["subsystem", "tbl", "columns"])

    return log.groupBy("subsystem").applyInPandas(run, "subsystem string, tbl string, columns array<string>")


def liveness(log: DataFrame, on: str, off: str) -> DataFrame:
    """(tbl, n_on, enabled): whether the last of two opposed operations is on."""
    rows = log.where(F.col("op").isin(on, off))
    return rows.groupBy("tbl").agg(F.count_if(F.col("op") == on).alias("n_on"), (F.max_by("op", "seq") == on).alias("enabled"))


def posture(tables: DataFrame, rls: DataFrame, policies: DataFrame) -> DataFrame:
    """(status, n_tables): protected with row security and policies, locked without policies, open without either."""
    p = policies.groupBy("tbl").agg(F.count("*").alias("n"))
    t = tables.join(rls.select("tbl", "enabled"), "tbl", "left").join(p, "tbl", "left")
    status = F.when(F.coalesce("enabled", F.lit(False)) & (F.coalesce("n", F.lit(0)) > 0), "protected").when(F.coalesce("enabled", F.lit(False)), "locked").otherwise("open")
    return t.groupBy(status.alias("status")).agg(F.count("*").alias("n_tables"))


def catalog_hash(columns: DataFrame) -> DataFrame:
    """(tbl, hash) of each table's sorted columns."""
    return columns.groupBy("tbl").agg(F.sha2(F.concat_ws("|", F.col("tbl").cast("string"), F.array_join(F.array_sort(F.collect_set("col")), ",")), 256).alias("hash"))


def object_counts(log: DataFrame) -> DataFrame:
    """(op, n_tables, n_objects): how many tables and named objects each operation touches."""
    named = F.when(F.col("col").isNotNull(), F.concat_ws(".", F.col("tbl").cast("string"), F.col("col").cast("string")))
    return log.groupBy("op").agg(F.countDistinct("tbl").alias("n_tables"), F.countDistinct(named).alias("n_objects"))


def migration_order(files: DataFrame) -> DataFrame:
    """(subsystem, path, rank): explicit order first, then a leading number, then the name."""
    name = F.element_at(F.split("path", "/"), -1)
    digits = F.regexp_extract(name, r"^(\d+)", 1)
    key = F.when(digits != "", F.lpad(digits, 32, "0"))
    w = Window.partitionBy("subsystem").orderBy(F.col("explicit").asc_nulls_last(), key.asc_nulls_last(), "path")
    return files.select("subsystem", "path", F.row_number().over(w).cast("long").alias("rank"))


def revision_chain(revisions: list[tuple[str, str | None]]) -> list[str] | None:
    """The one linear order of (revision, down revision), or None."""
    heads = [r for r, d in revisions if d is None]
    after: dict[str, str] = {}
    for r, d in revisions:
        if d is not None:
            if d in after:
                return None
            after[d] = r
    if len(heads) != 1 or len({r for r, _ in revisions}) != len(revisions):
        return None
    chain = [heads[0]]
    while chain[-1] in after and len(chain) <= len(revisions):
        chain.append(after[chain[-1]])
    return chain if len(chain) == len(revisions) else None


def migration_ranks(migrations: DataFrame) -> DataFrame:
    """(subsystem, path, rank, no_order): explicit order, else the revision chain, else numbers and names.

    migrations has subsystem, path, explicit, revision, down, sensitive; no_order
    where several files with order-sensitive operations have names alone.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: None if pd.isna(v) else v for k, v in r.items()} for r in pdf.to_dict("records")]
        number = {r["path"]: numeric_prefix(r["path"].rsplit("/", 1)[-1]) for r in rows}
        rows.sort(key=lambda r: (r["explicit"] is None, r["explicit"] or 0, number[r["path"]] is None, number[r["path"]] or "", r["path"]))
        explicit, known = any(r["explicit"] is not None for r in rows), {r["revision"] for r in rows}
        chain = None
        if len(rows) > 1 and not explicit and None not in known:
            chain = revision_chain([(r["revision"], r["down"] if r["down"] in known else None) for r in rows])
        if chain is not None:
            rows.sort(key=lambda r: chain.index(r["revision"]))
        no_order = len(rows) > 1 and not explicit and chain is None and not any(number.values()) and any(r["sensitive"] for r in rows)
        return pd.DataFrame([(r["subsystem"], r["path"], k, no_order) for k, r in enumerate(rows, 1)], columns=["subsystem", "path", "rank", "no_order"])

    return migrations.groupBy("subsystem").applyInPandas(run, "subsystem string, path string, rank long, no_order boolean")


def numeric_prefix(name: str) -> str | None:
    m = re.match(r"\d+", name)
    return m[0].zfill(32) if m else None
