"""Matching courses to a target list: any number of targets, in one plan."""

from dataclasses import replace

from cursus.config import TEST
from cursus.functions.names import normalise_text
from cursus.operators import paths


def brute(names, targets):
    form = {}
    for t in targets:
        form[normalise_text(t)] = t
    order = {t: i for i, t in enumerate(targets)}
    out = set()
    for name in set(names) - {None}:
        n = normalise_text(name)
        hit = form.get(n, next((t for k, t in form.items() if k and k in n), None))
        out.add((name, n, hit, order.get(hit)))
    return out


def match(spark, names, targets):
    df = spark.createDataFrame([(n,) for n in names], "course_name string")
    return paths.path_match(df, replace(TEST, path_targets=tuple(targets)))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


NAMES = ["Cursó Brand#1", "curso brand 11", "Álgebra I", "algebra", "álgebra II (nivel 2)", "", "!!!", "ab", "xaby", "ﬁnanzas ½", None,
         "Straße", "Intro a Álgebra y Brand 7", "IBM: a b", "brand"]


def test_matches_equal_brute_force(spark):
    for targets in (["Brand 1", "algebra", "Algebra II", "ab", "¡¡", "finanzas 1"], ["a", "b", "", "brand"], ["algebra", "ALGEBRA!", "brand 7"], []):
        assert {tuple(r) for r in match(spark, NAMES, targets).collect()} == brute(NAMES, targets)


def test_thousands_of_targets_make_no_larger_plan(spark):
    many = [f"Course {k} of {k % 7}" for k in range(2000)] + ["Brand 7"]
    got = {tuple(r) for r in match(spark, [*NAMES, "Course 1500 of 2", "The course 19 of 5, again"], many).collect()}
    assert got == brute([*NAMES, "Course 1500 of 2", "The course 19 of 5, again"], many)
    few = len(plan(match(spark, NAMES, ["Brand 7", "Course 3 of 3"]).where("target is not null")))
    assert len(plan(match(spark, NAMES, many).where("target is not null"))) < 1.1 * few < 60_000


def test_found_and_not_found(spark, base):
    n = paths.path_found(base.cur, base.cfg).first()
    missing = paths.path_not_found(base.cur, base.cfg).count()
    assert n["targets"] == len(base.cfg.path_targets) and n["found"] == n["targets"] - missing > 0
