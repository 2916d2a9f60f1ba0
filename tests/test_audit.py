"""The audit of the repeat report notices any cell that the raw rows do not give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from capturelens.operators import rollup as ru
from capturelens.operators.audit import Registered, audit, audit_summary
from capturelens.plans.bindings import Tables
from capturelens.plans.queries_reports import audited, registered_cells, repeat_cells
from capturelens.plans.queries_study import repeat_runs

WRONG = {"n": "n + 1", "success_count": "success_count - 1", "success_rate": "'12.3 %'", "registered": "'7.5 [1–50]'", "first_pairs": "first_pairs + 1"}


@pytest.fixture(scope="module")
def study(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    out = ru.repeat_summary(repeat_runs(t), "condition", "run", "largest", F.col("ok"), {"first_pairs": F.col("pair")})
    return t, spark.createDataFrame(out.select("condition", *repeat_cells()).collect())


def verdicts(df):
    return {r["condition"]: r["agrees"] for r in df.collect()}


def test_any_wrong_cell_is_noticed(study):
    t, report = study
    right = verdicts(audited(report, t.orders, t.lineitem))
    assert len(right) == 5 and all(right.values())
    for cell, wrong in WRONG.items():
        changed = report.withColumn(cell, F.when(F.col("condition") == "5-LOW", F.expr(wrong)).otherwise(F.col(cell)))
        assert verdicts(audited(changed, t.orders, t.lineitem)) == right | {"5-LOW": False}


def test_missing_conditions_and_changed_rows_are_noticed(study):
    t, report = study
    assert verdicts(audited(report.where("condition <> '5-LOW'"), t.orders, t.lineitem))["5-LOW"] is False
    first = report.first()["condition"]
    fewer = t.orders.where((F.col("o_orderpriority") != first) | (F.col("o_orderkey") % 2 == 0))
    assert [c for c, ok in verdicts(audited(report, fewer, t.lineitem)).items() if not ok] == [first]


def test_a_planted_error_of_each_report_is_found(spark):
    """All cells of six reports agree; one wrong, one missing and one repeated row of each do not."""
    t = Tables(spark, "/root/testdata/sf0.001")
    registry = [Registered(r.report, r.rows.cache(), r.key, r.cells, r.again.cache()) for r in registered_cells(t)]
    whole = {r["report"]: r for r in audit_summary(audit(registry)).collect()}
    assert len(whole) == 6 and all(r["differing"] == 0 and r["cells"] > 0 for r in whole.values())
    for r in registry:
        keys = [x[0] for x in r.rows.select(F.col(r.key).cast("string")).orderBy(r.key).limit(2).collect()]
        here = F.col(r.key).cast("string") == keys[0]
        cell = r.cells[-1]
        wrong = r.rows.withColumn(cell, F.when(here, F.concat(F.lit("9"), F.coalesce(F.col(cell).cast("string"), F.lit("")))).otherwise(F.col(cell).cast("string")))
        for rows, differing in ((wrong, 1), (r.rows.where(~here), len(r.cells)), (r.rows.union(r.rows.where(here)), len(r.cells))):
            found = audit([Registered(r.report, rows, r.key, r.cells, r.again)]).where("NOT agrees").collect()
            assert len(found) == differing and {f["key"] for f in found} == {keys[0]}, r.report
    some = audit(registry, share=0.2, seed=3).collect()
    total = sum(r["cells"] for r in whole.values())
    assert 0.1 * total < len(some) < 0.3 * total and all(r["agrees"] for r in some)


def test_cells_are_listed_after_their_rows_have_met(spark):
    """A row goes through the exchange once, not once for each of its cells."""
    rows = spark.range(3).selectExpr("id", "id * 2 AS a", "id * 3 AS b", "CAST(NULL AS STRING) AS c")
    found = audit([Registered("r", rows, "id", ["a", "b", "c"], rows)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate [")
    assert found.count() == 9 and found.where("agrees").count() == 9
