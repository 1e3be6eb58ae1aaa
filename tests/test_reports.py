"""Report invariants: shares sum to 1, populations partition users,
the funnel narrows, and the slice cube agrees with per-slice reports."""

from pyspark.sql import functions as F

from cursus.operators import snapshot as S
from cursus.operators.slicing import slice_cube


def test_shares_sum_to_one(base):
    for df in (S.activation_share(base.cur, base.cfg), S.intensity_share(base.cur, base.cfg),
               S.progress_distribution(base.cur, base.cfg)):
        assert abs(sum(r["share"] for r in df.collect()) - 1) < 1e-5


def test_populations_partition_users(base):
    allu = base.cur.where("user_id is not null").select("user_id").distinct().count()
    t = base.restrict(population="Docentes").cur.where("user_id is not null").select("user_id").distinct().count()
    s = base.restrict(population="Alumnos").cur.where("user_id is not null").select("user_id").distinct().count()
    assert t + s == allu


def test_funnel_narrows(base):
    f = [r["users"] for r in S.funnel(base.cur, base.roster, base.cfg).orderBy("step").collect()]
    assert all(a >= b for a, b in zip(f, f[1:]))


def test_slice_cube_matches_slices(base):
    cube = {(r["brand"], r["population"]): r for r in slice_cube(base.cur, base.cfg).collect()}
    total = S.hours_distribution(base.cur, base.cfg).first()
    assert cube[(None, None)]["users"] == total["n_users"]
    assert cube[(None, None)]["activated"] == total["n_activated"]
    for b in base.cfg.reported_brands:
        one = S.hours_distribution(base.cur.where(F.col("brand") == b), base.cfg).first()
        if one["n_users"]:
            assert cube[(b, None)]["users"] == one["n_users"]


def test_materialised_base_matches_lazy(spark):
    from conftest import SF_SMALL
    from cursus.plans import registry
    registry.load_all()
    rows = registry.run("result_diff", spark, SF_SMALL).collect()
    assert rows and all(r["only_left"] == 0 and r["only_right"] == 0 for r in rows), rows
