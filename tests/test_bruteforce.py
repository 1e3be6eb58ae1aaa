"""Lift and gateway against a direct set-based evaluation of their definitions
on the small fixture, with thresholds low enough that rows exist."""

from collections import defaultdict

import pytest

from cursus.operators import lift as L


@pytest.fixture(scope="module")
def data(base):
    u = base.usage.select("user_id", "course_id", "period_index", "hours").toPandas()
    order = sorted(u["period_index"].unique())
    act = defaultdict(set)
    for (p, usr), h in u.dropna(subset=["user_id"]).groupby(["period_index", "user_id"])["hours"].sum().items():
        if h > 0:
            act[p].add(usr)
    return u, order, act


def test_lift_pooled_bruteforce(base, data):
    u, order, act = data
    cfg = base.cfg.with_(min_transitions=5)
    num = den = 0
    for a, b in zip(order, order[1:]):
        num += len(act[a] & act[b])
        den += len(act[a])
    base_pct = 100 * num / den if den else 0.0
    cons = u[(u["hours"] > 0) & u["user_id"].notna()].groupby(["course_id", "period_index"])["user_id"].apply(set)
    stats = defaultdict(lambda: [0, 0])
    for (c, p), users in cons.items():
        i = order.index(p)
        if i == len(order) - 1:
            continue
        stats[c][0] += len(users)
        stats[c][1] += len(users & act[order[i + 1]])
    expect = {c: (d, round(100 * n / d - base_pct, 1)) for c, (d, n) in stats.items() if d >= 5}
    got = {r["course_id"]: (r["n_user_transitions"], r["lift_pp"]) for r in
           L.lift_pooled(base.usage, base.panel, cfg).collect()}
    assert set(got) == set(expect)
    for c in expect:
        assert got[c][0] == expect[c][0] and abs(got[c][1] - expect[c][1]) <= 0.1 + 1e-9


def test_gateway_bruteforce(base, data):
    u, order, act = data
    cfg = base.cfg.with_(min_starters=2)
    seen, starts = set(), defaultdict(lambda: [0, 0])
    for a, b in zip(order, order[1:]):
        rows = u[(u["period_index"] == a) & (u["hours"] > 0) & u["user_id"].notna()]
        new = set(rows["user_id"]) - seen
        top = (rows[rows["user_id"].isin(new)].sort_values(["user_id", "hours", "course_id"],
                                                           ascending=[True, False, True])
               .groupby("user_id").first())
        for usr, r in top.iterrows():
            starts[r["course_id"]][0] += 1
            starts[r["course_id"]][1] += usr in act[b]
        seen |= set(rows["user_id"])
    expect = {c: v for c, v in starts.items() if v[0] >= 2}
    got = {r["course_id"]: r["n"] for r in L.gateway_courses(base.usage, base.panel, cfg).collect()}
    assert got == {c: v[0] for c, v in expect.items()}


def test_cohort_bruteforce(base, data):
    from cursus.operators.panel import cohort_retention
    _, order, act = data
    first = {}
    for p in order:
        for usr in act[p]:
            first.setdefault(usr, p)
    got = {(r["cohort_index"], r["period_offset"]): r["active"] for r in
           cohort_retention(base.panel, base.periods, base.cfg).collect()}
    for i, c in enumerate(order):
        members = {x for x, f in first.items() if f == c}
        for j in range(i, len(order)):
            assert got[(c, j - i)] == len(members & act[order[j]])
