import re

import pytest

from codemap_spark.plans.queries import ORACLES, QUERIES
from codemap_spark.sources import tables as S
from tests.oracle import SF, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, SF).collect()


def test_fold_with_renames_agrees_with_a_sequential_fold(spark):
    state: dict[int, set] = {}
    for r in sorted(S.oplog(spark, SF).collect(), key=lambda r: (r.tbl, r.seq)):
        if r.op == "create_table":
            state[r.tbl] = set()
        elif r.op == "drop_table":
            state.pop(r.tbl, None)
        elif r.op == "add_column":
            state.setdefault(r.tbl, set()).add(r.col)
        elif r.col in state.get(r.tbl, ()):
            state[r.tbl].remove(r.col)
            if r.op == "rename_column":
                state[r.tbl].add("r" + r.col)
    got = {(r.subsystem, r.tbl): set(r.columns) for r in QUERIES["fold_with_renames"](spark, SF).collect()}
    assert got == {(str(t % 16), str(t)): c for t, c in state.items()}


def test_linkage_of_every_owned_document(spark):
    assert QUERIES["test_owner_linkage_all"](spark, SF).count() == QUERIES["owner_most_specific"](spark, SF).count()


def test_report_ranks_every_finding(spark):
    found = QUERIES["policy_apply"](spark, SF).count()
    assert sorted(r["rank"] for r in QUERIES["report_order"](spark, SF).select("rank").collect()) == list(range(1, found + 1))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["target", "radius", "consumers"]
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def dealt(df):
    """(keys, number) of the exchanges by hash in a plan, number 0 where Spark may merge the parts."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\), (\w+)", plan)
    return {(re.sub(r"#\w+", "", keys), int(n) if how == "REPARTITION_BY_NUM" else 0) for keys, n, how in found}


INTERFACES = [
    "orphan_exports",
    "orphan_rollup",
    "calibrate_drift_check",
    "calibrate_drift_keys",
    "boundary_violations",
    "ci_tsv",
    "policy_apply",
    "baseline_new_resolved",
    "calibrate_accept",
    "gate_status",
    "issue_tally",
    "calibrate_changed",
    "calibrate_exposes",
    "calibrate_summary",
    "calibrate_proposals",
    "drift_missing",
    "drift_undeclared_rollup",
    "contract_missing",
    "describe_verify",
    "impact_interface",
]


@pytest.mark.parametrize("name", INTERFACES)
def test_steps_by_interface_take_tasks_in_proportion(spark, monkeypatch, name):
    """Merged parts would hold a fixed share of the table in one task's memory, however large the table."""
    monkeypatch.setattr(S, "SHARE", 1 << 12, raising=False)
    many = {n for keys, n in dealt(QUERIES[name](spark, SF)) if keys in ("subsystem, name", "provider, name", "consumer, provider, name", "key")}
    assert many and min(many) > 20
    assert differences(spark, QUERIES[name], ORACLES[name]) == ([], [])


def test_report_is_ranked_in_ranges_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 1 << 12, raising=False)
    assert len(QUERIES["report_order"](spark, SF).inputFiles()) > 20
    assert differences(spark, QUERIES["report_order"], ORACLES["report_order"]) == ([], [])
