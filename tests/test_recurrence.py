"""Identities of the recurrences over years."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recurrence
from tidemark.plans import model


def test_sweep_is_the_loop(spark):
    flows = [-3.0, 1.0, -8.0, 20.0, 0.5, -30.0, 2.0]
    df = spark.createDataFrame([(k, y, x * (k + 1)) for k in range(3) for y, x in enumerate(flows)], "k int, y int, x double")
    got = {(r.k, r.y): (r.draw, r.debt, r.cash) for r in recurrence.cash_sweep(df.repartition(4), ["k"], "y", "x", 5.0, 1.0).collect()}
    for k in range(3):
        cash, debt = 5.0, 0.0
        for y, x in enumerate(flows):
            before = cash + x * (k + 1)
            move = 1.0 - before if before < 1.0 else -min(debt, before - 1.0)
            cash, debt = before + move, debt + move
            assert got[k, y] == pytest.approx((move, debt, cash)) and cash >= 1.0 - 1e-9 and debt >= 0
    assert recurrence.cash_sweep(df.where("k > 9"), ["k"], "y", "x", 5.0, 1.0).collect() == []


def test_null_keys_and_one_year(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, -9.0), (4, 1, None)], "k int, y int, x double")
    got = {(r.k, r.y): r.cash for r in recurrence.cash_sweep(df, ["k"], "y", "x", 5.0, 1.0).collect()}
    assert got == {(None, 1): 7.0, (None, 2): 1.0, (4, 1): None}


def test_parts_add_up_to_the_depreciation(spark):
    rows = [(1, y, [0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 5.0) for y in range(4)] + [(2, y, [7.0, 2.0, 1.0], [0.1, 0.0, 0.0], 4.0) for y in range(4)] + [(3, y, [5.0], [1.0], 0.0) for y in range(3)]
    df = spark.createDataFrame(rows, "k int, y int, opening array<double>, capex array<double>, life double")
    out = recurrence.fixed_assets(df, ["k"], "y", "opening", "capex", "life").collect()
    assert all(sum(r.depreciation_by_class) == pytest.approx(r.depreciation) for r in out)
    first = {r.k: r for r in out if r.y == 0}
    # an opening of zero: half a year of the capex, all of it in the last class
    assert first[1].depreciation == pytest.approx(0.6) and first[1].depreciation_by_class[:2] == [0, 0]
    assert first[2].depreciation_by_class == pytest.approx([0.7 * first[2].depreciation, 0.2 * first[2].depreciation, 0.1 * first[2].depreciation])
    assert [sum(r.balances) for r in out if r.k == 3] == [6.0, 7.0, 8.0]


@pytest.fixture(scope="module")
def years(spark, sf):
    return model._inputs(spark, sf).where("k < 60")


def test_the_balance_closes_where_the_told_totals_do(years):
    got = recurrence.three_statements(years, ["k"], "year").collect()
    assert len(got) == years.count()
    for r in got:
        assert abs(r.check - (7 if r.k % 10 == 1 and r.k % 9 else 0)) < 1e-6
        if r.year > model._HISTORY:
            assert r.cash >= 0.04 * 0 and r.revolver >= -1e-9


def test_flows_add_up_to_the_change_of_cash(years):
    got = sorted(recurrence.three_statements(years, ["k"], "year").collect(), key=lambda r: (r.k, r.year))
    for before, now in zip(got, got[1:], strict=False):
        if before.k == now.k and now.year > model._HISTORY:
            assert now.free == pytest.approx(now.operating + now.investing)
            assert now.cash - before.cash == pytest.approx(now.free + now.financing)
            assert now.revolver - before.revolver == pytest.approx(now.draw)


@pytest.mark.parametrize("column, by", [("debt", 3.0), ("equity", -2.0), ("cash", 1.0)])
def test_an_amount_without_counterpart_opens_the_balance(years, column, by):
    broken = years.where("k % 10 <> 1").withColumn(column, F.col(column) + by)
    got = recurrence.three_statements(broken.withColumn("told_current_assets", F.lit(None).cast("double")).withColumn("told_equity", F.lit(None).cast("double")), ["k"], "year").collect()
    gap = by if column == "cash" else -by
    assert all(r.check == pytest.approx(gap) for r in got)


def test_plugs_follow_the_told_totals(years):
    told = years.withColumn("told_current_claims", F.when(F.col("historical"), F.lit(1000.0))).withColumn("told_other_claims", F.when(F.col("historical"), F.lit(2000.0)))
    rows = recurrence.three_statements(told, ["k"], "year").where("year <= 2023").collect()
    assert all(r.current_claims == pytest.approx(1000) and r.other_claims_total == pytest.approx(2000) for r in rows)


def test_no_python_in_the_plan(years):
    plan = recurrence.three_statements(years, ["k"], "year")._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "BatchEvalPython" not in plan


def test_covenants(spark):
    df = spark.createDataFrame([(10.0, 40.0, 5.0, 2.0, 3.0, 8.0, 2.0, 4.0, 20.0), (-1.0, 40.0, 5.0, 0.0, 0.0, 8.0, 2.0, 0.0, 0.0)], "e double, d double, c double, i double, a double, ca double, s double, cc double, q double")
    shown = recurrence.covenants(*(F.col(x) for x in df.columns))
    one, two = df.select(*(x.alias(n) for n, x in shown.items())).collect()
    assert (one.net_leverage, one.service_cover, one.interest_cover, one.current_ratio, one.quick_ratio, one.debt_to_equity) == (3.5, 2.0, 5.0, 2.0, 1.5, 2.0)
    assert (one.leverage_state, one.cover_state, one.liquidity_state) == ("broken", "ok", "ok")
    assert (two.net_leverage, two.gross_leverage, two.service_cover, two.interest_cover, two.current_ratio, two.debt_to_equity) == (None, None, None, None, 0.0, None)
    assert (two.leverage_state, two.cover_state, two.liquidity_state) == ("none", "none", "broken")
