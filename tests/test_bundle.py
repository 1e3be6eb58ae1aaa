"""Report bundle: concurrent digests equal serial ones; digests ignore row order."""

import pytest

from cursus.plans.bundle import (bundle_builders, bundle_diff, bundle_digest, digest_diff, read_digests, result_diff,
                                 result_digest, store_digests)

from conftest import SF_SMALL

SOME = ("growth_accounting", "funnel", "hours_distribution", "course_catalog", "lift_pooled", "pop_by_period")


def _rows(df):
    return {r["report"]: (r["rows"], r["digest"]) for r in df.collect()}


def test_concurrent_digest_equals_serial(base):
    builders = {k: v for k, v in bundle_builders(base, brands=["AMER"], population="Alumnos").items() if k in SOME}
    assert set(builders) == set(SOME)
    serial = _rows(bundle_digest(builders, parallelism=1))
    concurrent = _rows(bundle_digest(builders, parallelism=6))
    assert serial == concurrent
    direct = {k: result_digest(f()).first() for k, f in builders.items()}
    assert serial == {k: (r["rows"], r["digest"]) for k, r in direct.items()}


def test_digest_ignores_order_and_partitioning(base):
    df = bundle_builders(base)["course_catalog"]()
    a = result_digest(df).first()
    b = result_digest(df.repartition(5).orderBy("course_id", ascending=False)).first()
    assert (a["rows"], a["digest"]) == (b["rows"], b["digest"])
    d = result_diff(df, df.limit(3)).first()
    assert (d["only_left"], d["only_right"]) == (a["rows"] - 3, 0)


def test_materialized_base_is_memoised_and_gives_same_digests(base):
    from cursus.plans.base import materialized
    mat = materialized(base)
    assert materialized(base) is mat and materialized(mat) is mat
    assert mat.restrict(brands=["AMER"], population="Alumnos").materialized
    pick = ("growth_accounting", "group_breakdown", "yoy_by_month")
    a = _rows(bundle_digest({k: v for k, v in bundle_builders(base).items() if k in pick}))
    b = _rows(bundle_digest({k: v for k, v in bundle_builders(mat).items() if k in pick}))
    assert a == b


def test_diff_shows_a_changed_row_in_every_report(base):
    from dataclasses import replace
    other = replace(base, usage=base.usage.where("user_id is not null").limit(500), _panel=None)
    pick = ("funnel", "course_catalog", "yoy_by_month")
    a, b = ({k: v for k, v in bundle_builders(x).items() if k in pick} for x in (base, other))
    got = {r["report"]: (r["only_left"], r["only_right"]) for r in bundle_diff(a, b).collect()}
    assert set(got) == set(pick) and got["funnel"][0] and got["course_catalog"][0] and got["yoy_by_month"] == (0, 0)
    tiny = base.usage.sparkSession.range(1).selectExpr("1.0D AS x"), base.usage.sparkSession.range(1).selectExpr("1.0000001D AS x")
    assert bundle_diff({"t": tiny[0]}, {"t": tiny[1]}).first()[1:] == ("values", 1, 1)


def test_stored_digests_tell_the_kinds_of_change_apart(spark, tmp_path):
    def ranked(*rows):
        return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, course string, hours double")

    one, two, three = ("a", 5.0), ("b", 3.0), ("c", 3.0)
    before = {"top_courses_hours": ranked(one, two, three), "funnel": ranked(one), "gone": ranked(two), "renamed": ranked(one),
              "top_gainers": ranked(one, two), "rolling_7": ranked(one, two).drop("rank")}
    after = {"top_courses_hours": ranked(one, three, two), "funnel": ranked(("a", 5.5)), "new": ranked(two, one),
             "renamed": ranked(one).withColumnRenamed("hours", "h"), "top_gainers": ranked(one, two).repartition(3),
             "rolling_7": ranked(two, one).drop("rank")}
    root = str(tmp_path)
    store_digests(bundle_digest(before), root, "monday")
    store_digests(bundle_digest(after), root, "tuesday")
    got = {r["report"]: (r["change"], r["rows_before"], r["rows_after"])
           for r in digest_diff(read_digests(spark, root, "monday"), read_digests(spark, root, "tuesday")).collect()}
    assert got == {"top_courses_hours": ("order", 3, 3), "funnel": ("values", 1, 1), "gone": ("removed", 1, None), "new": ("added", None, 2),
                   "renamed": ("columns", 1, 1), "top_gainers": ("same", 2, 2), "rolling_7": ("same", 2, 2)}
    with pytest.raises(Exception, match="exists"):
        store_digests(bundle_digest(after), root, "monday")
    full = {r["report"]: tuple(r)[1:] for r in bundle_diff(before, after).collect()}
    assert full == {"top_courses_hours": ("order", 0, 0), "funnel": ("values", 1, 1), "gone": ("removed", 1, 0), "new": ("added", 0, 2),
                    "renamed": ("columns", 1, 1), "top_gainers": ("same", 0, 0), "rolling_7": ("same", 0, 0)}


def test_digests_of_parts_add_up(base):
    df = bundle_builders(base)["certification_by_group"]()
    whole = result_digest(df).first()
    parts = [result_digest(df.where(c)).first() for c in ("rank <= 3", "rank > 3")]
    for k in ("rows", "digest", "order_digest"):
        assert int(whole[k]) == sum(int(p[k]) for p in parts)


def test_registered_diff_and_digest_read_all_reports(spark, base, monkeypatch):
    from cursus.plans import bundle, registry
    every = set(bundle_builders(base))
    assert len(every) > 80
    monkeypatch.setattr(bundle, "bundle_diff", lambda a, b: (set(a), set(b)))
    assert registry.run("result_diff", spark, SF_SMALL) == (every, every)
    monkeypatch.setattr(bundle, "sliced_digest", lambda b, slices: slices)
    assert registry.run("result_digest", spark, SF_SMALL) == {"total": None} | {x: [x] for x in base.cfg.reported_brands}


def test_registered_diff_joins_the_tables_once(spark, base, monkeypatch):
    from cursus.plans import bundle, registry
    monkeypatch.setattr(bundle, "bundle_diff", lambda a, b: (a, b))
    lazy, mat = registry.run("result_diff", spark, SF_SMALL)
    for side in (lazy, mat):
        for report in ("course_catalog", "growth_accounting", "funnel"):
            assert not [f for f in side[report]().inputFiles() if "lineitem" in f or "orders" in f]
    pick = ("growth_accounting", "course_catalog", "yoy_by_month")
    want = _rows(bundle_digest({k: v for k, v in bundle_builders(base).items() if k in pick}))
    assert _rows(bundle_digest({k: lazy[k] for k in pick})) == want == _rows(bundle_digest({k: mat[k] for k in pick}))
    # the lazy side reads usage itself, no rollup of it
    assert all("/usage/" in f for f in lazy["hours_per_user"]().inputFiles()) and not any(
        "/usage/" in f for f in mat["hours_per_user"]().inputFiles())


def test_shared_reports_are_those_of_each_slice(base):
    brand = base.cfg.reported_brands[0]
    pick = ("funnel", "growth_by_brand", "yoy_by_month", "pop_by_period")
    got = {r["report"]: (r["rows"], r["digest"]) for r in sliced_some(base, brand, pick).where(f"slice = '{brand}'").collect()}
    assert got == _rows(bundle_digest({k: v for k, v in bundle_builders(base, [brand]).items() if k in pick}))


def sliced_some(base, brand, pick):
    from cursus.plans import bundle
    whole = bundle.bundle_builders
    bundle.bundle_builders = lambda *a: {k: v for k, v in whole(*a).items() if k in pick}
    try:
        return bundle.sliced_digest(base, {"total": None, brand: [brand]})
    finally:
        bundle.bundle_builders = whole


def test_slices_of_a_report_run_one_after_another(base, monkeypatch):
    from cursus.plans import bundle
    ran = []
    monkeypatch.setattr(bundle, "bundle_digest", lambda jobs, *a: ran.extend(jobs) or jobs and base.usage.sparkSession.createDataFrame(
        [(*k, 0, "", "", "") for k in jobs], "slice string, " + bundle.DIGESTS))
    slices = {"total": None, "AMER": ["AMER"], "ASIA": ["ASIA"]}
    got = bundle.sliced_digest(base, slices).select("slice", "report").collect()
    reports = list(bundle_builders(base))
    assert sorted(map(tuple, got)) == sorted((x, r) for x in slices for r in reports)
    shared = bundle.BY_BRAND | bundle.WHOLE_SERIES | bundle.EVERY_SLICE
    assert ran == [(x, r) for r in reports for x in (["total"] if r in shared else slices)]


def test_rollup_rows_lie_by_slice(base):
    import pyarrow.parquet as pq

    from cursus.plans.base import materialized
    for level in ("pairs", "users"):
        table = materialized(base).rollups[level]
        files = [f.removeprefix("file:") for f in table.inputFiles()]
        rows = [[(x or "", y or "") for x, y in zip(t["brand"].to_pylist(), t["population"].to_pylist())]
                for t in (pq.ParquetFile(f"/{f.lstrip('/')}").read(["brand", "population"]) for f in files)]
        assert all(r == sorted(r) for r in rows) and any(len(set(r)) > 2 for r in rows)
