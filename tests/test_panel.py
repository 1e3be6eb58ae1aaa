"""Panel reports: invariants and hand-written growth cases."""

from pyspark.sql import functions as F

from cursus.config import TEST
from cursus.operators import panel as P
from cursus.operators.periods import periods_dim
from cursus.plans.base import from_tables


def test_growth_invariants(base):
    g = P.growth_accounting(base.panel, base.periods, base.cfg).orderBy("period_index").collect()
    for r in g:
        assert r["new_users"] + r["recurring"] + r["reactivated"] == r["total_active"]
    for prev, cur in zip(g, g[1:]):
        assert cur["lost"] == prev["total_active"] - cur["recurring"]


def test_cohort_invariants(base):
    c = P.cohort_retention(base.panel, base.periods, base.cfg)
    zero = c.where(F.col("period_offset") == 0).collect()
    assert all(r["rate"] == 1.0 for r in zero if r["n"] > 0)
    ever = base.panel.where("active").select("user_id").distinct().count()
    assert sum(r["n"] for r in zero) == ever


def test_growth_hand_written(spark):
    # user a: periods 1 and 3 (gap); user b: 1,2,3; period 4 has rows but nobody active.
    rows = [("a", 1, 1.0), ("a", 3, 2.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0), ("c", 4, 0.0)]
    u = spark.createDataFrame(rows, "user_id string, period_index int, hours double").withColumns({
        "brand": F.lit("AMER"), "population": F.lit("Alumnos"), "course_id": F.lit("x"),
        "course_name": F.lit("x"), "progress_band": F.lit(None).cast("string"),
        "certified_raw": F.lit(None).cast("string")})
    b = from_tables(TEST, u, None, None)
    g = {r["period_index"]: r for r in P.growth_accounting(b.panel, b.periods, b.cfg).collect()}
    assert (g[1]["new_users"], g[1]["total_active"]) == (2, 2)
    assert (g[2]["recurring"], g[2]["lost"]) == (1, 1)
    assert (g[3]["reactivated"], g[3]["recurring"]) == (1, 1)
    assert (g[4]["total_active"], g[4]["lost"]) == (0, 2)


def test_periods_dim_sides(base):
    p = {r["side"]: r["period_index"] for r in base.periods.where("side is not null").collect()}
    assert p["cur"] == 2001 * 4 + 1 and p["prev"] == 2001 * 4      # 2001-Q2 and 2001-Q1
    partial = [r["period_index"] for r in base.periods.where("partial").collect()]
    assert partial == [2001 * 4 + 2]
