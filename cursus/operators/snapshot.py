"""Single-period aggregate reports: KPIs, segments, hours distribution, progress,
funnel and certification.

Each function takes a usage slice (usually the current period; ``usage_sides``
carries a ``side`` column in {cur, prev}) and returns a small DataFrame.
Per-user measures are a first aggregation by user_id (partial + final hash
aggregate); the report is a second aggregation over it. Several reports return
a fixed list of labelled rows; they are produced by exploding a literal array,
never by a join with invented data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACTIVATED, NOT_ACTIVATED, SEGMENT_ORDER, Config
from ..functions import columns as C
from ..functions.aggs import count_if, dsum, dsum0, median, n_rows, r6, ratio
from .order_stats import order_stats
from .quantiles import quantiles_all_and_active
from .slicing import SLICE, user_slices


def _label_dim(df: DataFrame, key: str, labels) -> DataFrame:
    """Fixed list of labels (with their order) as a tiny frame derived from df's session."""
    arr = F.array(*[F.struct(F.lit(l).alias(key), F.lit(i).alias("ord")) for i, l in enumerate(labels)])
    return df.sparkSession.range(1).select(F.inline(arr))


# ---------------------------------------------------------------- panorama
def panorama_kpis(daily_sides: DataFrame, cfg: Config) -> DataFrame:
    """Four KPIs of the daily platform series, current vs previous, with % change."""
    s = F.col("side")

    def both(c, f):
        return f(F.when(s == "cur", F.col(c))), f(F.when(s == "prev", F.col(c)))

    h = both("hours", lambda x: dsum0(x, cfg))
    c = both("contents", lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double"))
    a = both("active", lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double"))
    e = both("effective", lambda x: dsum0(x, cfg))
    one = daily_sides.agg(
        h[0].alias("h0"), h[1].alias("h1"), c[0].alias("c0"), c[1].alias("c1"),
        a[0].alias("a0"), a[1].alias("a1"), e[0].alias("e0"), e[1].alias("e1"))
    arr = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(x0).alias("current"), F.col(x1).alias("previous"))
                    for k, x0, x1 in (("hours", "h0", "h1"), ("unique_contents", "c0", "c1"),
                                      ("active_users", "a0", "a1"), ("effective_users", "e0", "e1"))])
    out = one.select(F.inline(arr))
    return out.select("kpi", r6("current").alias("current"), r6("previous").alias("previous"),
                      r6(C.pct_change("current", "previous")).alias("delta_pct"))


def panorama_snapshot(usage_sides: DataFrame, cfg: Config) -> DataFrame:
    """Hours, contents and distinct users with any row, current vs previous."""
    s = F.col("side")
    one = usage_sides.agg(
        dsum0(F.when(s == "cur", F.col("hours")), cfg).alias("h0"),
        dsum0(F.when(s == "prev", F.col("hours")), cfg).alias("h1"),
        dsum0(F.when(s == "cur", F.col("contents")), cfg).alias("c0"),
        dsum0(F.when(s == "prev", F.col("contents")), cfg).alias("c1"),
        F.count_distinct(F.when(s == "cur", F.col("user_id"))).cast("double").alias("u0"),
        F.count_distinct(F.when(s == "prev", F.col("user_id"))).cast("double").alias("u1"))
    arr = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(x0).alias("current"), F.col(x1).alias("previous"))
                    for k, x0, x1 in (("hours", "h0", "h1"), ("contents", "c0", "c1"),
                                      ("users_with_rows", "u0", "u1"))])
    out = one.select(F.inline(arr))
    return out.select("kpi", r6("current").alias("current"), r6("previous").alias("previous"),
                      r6(C.pct_change("current", "previous")).alias("delta_pct"))


def panorama_by_brand(usage_sides: DataFrame, cfg: Config) -> DataFrame:
    """Always the reported brands (zeros when absent): hours, contents, users per side."""
    s = F.col("side")
    g = (usage_sides.where(F.col("brand").isin(list(cfg.reported_brands))).groupBy("brand")
         .agg(dsum(F.when(s == "cur", F.col("hours")), cfg).alias("hours_current"),
              dsum(F.when(s == "prev", F.col("hours")), cfg).alias("hours_previous"),
              dsum(F.when(s == "cur", F.col("contents")), cfg).alias("contents_current"),
              dsum(F.when(s == "prev", F.col("contents")), cfg).alias("contents_previous"),
              F.count_distinct(F.when(s == "cur", F.col("user_id"))).alias("users_current"),
              F.count_distinct(F.when(s == "prev", F.col("user_id"))).alias("users_previous")))
    dim = _label_dim(usage_sides, "brand", cfg.reported_brands).drop("ord")
    out = dim.join(g, "brand", "left")
    return out.select("brand",
                      *[r6(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in
                        ("hours_current", "hours_previous", "contents_current", "contents_previous")],
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in
                        ("users_current", "users_previous")])


# ---------------------------------------------------------------- segments
def hours_per_user(usage: DataFrame, cfg: Config, keys=()) -> DataFrame:
    """(keys..., user_id, hours, segment): sum of hours per user (missing users drop out)."""
    return (usage.where(F.col("user_id").isNotNull()).groupBy(*keys, "user_id")
            .agg(dsum0("hours", cfg).alias("hours"))
            .withColumn("segment", C.segment(F.col("hours"))))


def activation_share(usage: DataFrame, cfg: Config) -> DataFrame:
    """Share of users not activated (0 h) vs activated, fixed rows."""
    hpu = hours_per_user(usage, cfg)
    g = hpu.groupBy(C.activation(F.col("hours")).alias("label")).agg(F.count(F.lit(1)).alias("users"))
    tot = hpu.agg(F.count(F.lit(1))).scalar()
    dim = _label_dim(usage, "label", [NOT_ACTIVATED, ACTIVATED])
    return dim.join(g, "label", "left").select(
        "label", r6(F.coalesce(ratio(F.col("users"), tot), F.lit(0.0))).alias("share"))


def intensity_share(usage: DataFrame, cfg: Config) -> DataFrame:
    """Share of each intensity segment among activated users, fixed rows."""
    hpu = hours_per_user(usage, cfg).where(F.col("segment") != NOT_ACTIVATED)
    g = hpu.groupBy("segment").agg(F.count(F.lit(1)).alias("users"))
    tot = hpu.agg(F.count(F.lit(1))).scalar()
    dim = _label_dim(usage, "segment", SEGMENT_ORDER)
    return dim.join(g, "segment", "left").select(
        "segment", r6(F.coalesce(ratio(F.col("users"), tot), F.lit(0.0))).alias("share"))


def segment_counts(usage: DataFrame, cfg: Config) -> DataFrame:
    """Users per segment, five fixed rows."""
    g = hours_per_user(usage, cfg).groupBy("segment").agg(F.count(F.lit(1)).alias("users"))
    dim = _label_dim(usage, "segment", (NOT_ACTIVATED,) + SEGMENT_ORDER)
    return dim.join(g, "segment", "left").select(
        "segment", F.coalesce(F.col("users"), F.lit(0)).cast("long").alias("users"))


SEGMENT_COLUMNS = ("explorers", "constant", "intensive", "power_users")


def segments_by_brand(usage: DataFrame, cfg: Config) -> DataFrame:
    """Per reported brand with rows: users, activation shares, intensity shares."""
    hpu = hours_per_user(usage.where(F.col("brand").isin(list(cfg.reported_brands))), cfg, keys=("brand",))
    act = F.col("hours") != 0
    n_act = count_if(act)
    aggs = [F.count(F.lit(1)).alias("n_users"),
            ratio(count_if(~act), F.count(F.lit(1))).alias("not_activated"),
            ratio(n_act, F.count(F.lit(1))).alias("activated")]
    for name, seg in zip(SEGMENT_COLUMNS, SEGMENT_ORDER):
        aggs.append(F.coalesce(ratio(count_if(F.col("segment") == seg), n_act), F.lit(0.0)).alias(name))
    g = hpu.groupBy("brand").agg(*aggs)
    return g.select("brand", F.col("n_users").cast("long"),
                    *[r6(c).alias(c) for c in ("not_activated", "activated") + SEGMENT_COLUMNS])


# ---------------------------------------------------------------- distribution
def top_k_sums(values: DataFrame, col: str, pcts, cfg: Config) -> DataFrame:
    """(p, k, top): exact sum of the k = max(1, round-half-even(n*p)) largest values.

    Distributed selection without sorting the values or putting them in one
    task: (1) count/sum per log-scale bucket (a few hundred buckets) and find,
    per p, the bucket where the k-th largest value falls; (2) split that bucket
    into 4096 linear sub-buckets and find the boundary sub-bucket; (3) inside it
    (a sliver of the value range) take the exact values. Every pass is a filter
    plus a small aggregation; windows run only over those aggregates.
    """
    dec = cfg.sum_type
    v = F.col("v")
    x = values.select(F.col(col).alias("v")).where(v.isNotNull())
    ps = F.array(*[F.lit(float(p)) for p in pcts])

    def boundary(df, key, before0, full0):
        w = Window.partitionBy("p").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({"before": F.col(before0) + F.coalesce(F.sum("c").over(w), F.lit(0)),
                             "full": F.col(full0) + F.coalesce(F.sum("s").over(w), F.lit(0).cast(dec))})
        return df.where((F.col("before") < F.col("k")) & (F.col("before") + F.col("c") >= F.col("k")))

    x = x.withColumn("b1", F.when(v > 0, F.floor(F.log2(v) * 16)).otherwise(F.lit(-(10 ** 6))).cast("long"))
    l1 = x.groupBy("b1").agg(F.count(F.lit(1)).alias("c"), F.sum(v.cast(dec)).alias("s"),
                             F.min(v).alias("lo"), F.max(v).alias("hi"))
    # n and the total come from the (few hundred) bucket rows, not from another pass.
    everything = Window.partitionBy("p")
    l1 = l1.withColumn("p", F.explode(ps)).withColumns({
        "n": F.sum("c").over(everything), "total": F.sum("s").over(everything)}).withColumn(
        "k", F.greatest(F.lit(1), F.bround(F.col("n").cast("double") * F.col("p"), 0).cast("long")))
    b1 = boundary(l1.withColumns({"z": F.lit(0).cast("long"), "zs": F.lit(0).cast(dec)}), "b1", "z", "zs").select(
        "p", "k", "b1", F.col("before").alias("before1"), F.col("full").alias("full1"), "lo", "hi", "total")
    key2 = F.when(F.col("hi") > F.col("lo"),
                  F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 4096), F.lit(4095))
                  ).otherwise(F.lit(0)).cast("long")
    x2 = x.join(F.broadcast(b1), "b1").withColumn("b2", key2)
    l2 = x2.groupBy("p", "k", "before1", "full1", "b2").agg(F.count(F.lit(1)).alias("c"),
                                                            F.sum(v.cast(dec)).alias("s"))
    b2 = boundary(l2, "b2", "before1", "full1").select(
        "p", "b2", F.col("before").alias("before2"), F.col("full").alias("full2"))
    l3 = (x2.join(F.broadcast(b2), ["p", "b2"])
          .groupBy("p", "k", "before2", "full2", "v").agg(F.count(F.lit(1)).alias("c")))
    w3 = Window.partitionBy("p").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    l3 = l3.withColumn("before", F.col("before2") + F.coalesce(F.sum("c").over(w3), F.lit(0)))
    take = F.least(F.col("c"), F.greatest(F.col("k") - F.col("before"), F.lit(0)))
    res = l3.groupBy("p").agg(F.max("k").alias("k"),
                              (F.max("full2") + F.sum(v.cast(dec) * take)).cast("double").alias("top"))
    res = res.join(b1.select("p", F.col("total").cast("double").alias("total")), "p")
    dim = values.sparkSession.range(1).select(F.explode(ps).alias("p"))
    return dim.join(res, "p", "left")


def top_share(usage: DataFrame, cfg: Config, pcts=(0.01, 0.05, 0.10), active_only: bool = False) -> DataFrame:
    """Share of total hours held by the top p of users, k = max(1, round-half-even(n*p))."""
    hpu = hours_per_user(usage, cfg)
    if active_only:
        hpu = hpu.where(F.col("hours") > 0)
    g = top_k_sums(hpu, "hours", pcts, cfg)
    return g.select((F.col("p") * 100).alias("pct"), F.col("k").cast("long").alias("k"),
                    r6(F.when(F.col("total") > 0, F.col("top") / F.col("total") * 100)).alias("share"))


def hours_distribution(usage: DataFrame, cfg: Config, keys=()) -> DataFrame:
    """One row (a group, with keys): users, activated, total, mean/median (all and activated), p25/p75/p90
    of activated, concentration (top 1/5/10%), shares at 20 min and 1 h.

    One index of the users' hours gives counts and sums and tells where each order statistic lies.
    """
    hpu = hours_per_user(usage, cfg, keys)
    h = F.col("hours")
    tops = {"share_top1": 0.01, "share_top5": 0.05, "share_top10": 0.10}
    exact = cfg.distributed_quantiles and not cfg.approx_quantiles
    all_q, act_q = {"median_all": 0.5}, {"median_act": 0.5, "p25_act": 0.25, "p75_act": 0.75, "p90_act": 0.9}
    g = order_stats(hpu, "hours", cfg, keys, all_q if exact else {}, act_q if exact else {}, tops,
                    {"n_ge20min": (h > 0) & (h >= cfg.twenty_minutes), "n_ge1h": (h > 0) & (h >= 1)})
    if not exact:
        q = quantiles_all_and_active(hpu, "hours", all_q, act_q, keys, cfg)
        if keys:
            cond = [F.col(f"_q_{c}").eqNullSafe(F.col(c)) for c in keys]
            g = g.join(q.withColumnsRenamed({c: f"_q_{c}" for c in keys}), cond, "left")
        else:
            g = g.withColumn("_q", q.select(F.struct(*all_q, *act_q)).scalar()).select("*", "_q.*")
    n, n_act, total = F.col("n"), F.col("n_positive"), F.coalesce(F.col("total").cast("double"), F.lit(0.0))
    share = lambda c: F.when(total > 0, F.col(c) / total * 100)
    pct = lambda c: ratio(F.col(c), n_act) * 100
    doubles = {"hours_total": total, "mean_all": ratio(F.col("total").cast("double"), n), "median_all": F.col("median_all"),
               "mean_act": ratio(F.col("total_positive").cast("double"), n_act), **{c: F.col(c) for c in act_q},
               "pct_ge20min": pct("n_ge20min"), "pct_ge1h": pct("n_ge1h")}
    return g.select(*keys, n.alias("n_users"), n_act.alias("n_activated"), r6(ratio(n_act, n) * 100).alias("pct_activated"),
                    *[r6(c).alias(name) for name, c in doubles.items()], "n_ge20min", *[r6(share(c)).alias(c) for c in tops])


def hours_distribution_slices(usage: DataFrame, cfg: Config) -> DataFrame:
    """``hours_distribution`` of total, each brand, each population and both, from one job."""
    return hours_distribution(user_slices(usage, cfg), cfg, SLICE)


def segment_slices(usage: DataFrame, cfg: Config) -> DataFrame:
    """Users of each segment in every slice; every slice has all five segments."""
    hpu = hours_per_user(user_slices(usage, cfg), cfg, SLICE)
    labels = (NOT_ACTIVATED, *SEGMENT_ORDER)
    g = hpu.groupBy(*SLICE).agg(*[count_if(F.col("segment") == x).alias(x) for x in labels])
    rows = F.array(*[F.struct(F.lit(x).alias("segment"), F.col(f"`{x}`").alias("users")) for x in labels])
    return g.select(*SLICE, F.inline(rows))


# ---------------------------------------------------------------- progress
def max_progress(usage: DataFrame, cfg: Config, keys=()) -> DataFrame:
    """Max progress per (user, course); pairs whose max is unknown are dropped."""
    return (usage.where(F.col("user_id").isNotNull())
            .groupBy(*keys, "user_id", "course_id").agg(F.max("progress").alias("progress"))
            .where(F.col("progress").isNotNull()))


def progress_distribution(usage: DataFrame, cfg: Config) -> DataFrame:
    """Pairs and share of pairs per observed max-progress value."""
    g = max_progress(usage, cfg).groupBy("progress").agg(F.count(F.lit(1)).alias("pairs"))
    tot = F.sum("pairs").over(Window.partitionBy())   # at most 4 rows
    return g.select("progress", F.col("pairs").cast("long"), r6(F.col("pairs") / tot).alias("share"))


def progress_summary(usage: DataFrame, cfg: Config) -> DataFrame:
    """Pairs, share of pairs below 20% and at or above 80%."""
    mp = max_progress(usage, cfg)
    p = F.col("progress")
    return mp.agg(F.count(F.lit(1)).alias("pairs"),
                  r6(ratio(count_if(p < 20), F.count(F.lit(1)))).alias("pct_below20"),
                  r6(ratio(count_if(p >= 80), F.count(F.lit(1)))).alias("pct_at_least80"))


def progress_by_brand(usage: DataFrame, cfg: Config) -> DataFrame:
    """Per reported brand with rows: pairs and share of pairs at 10/35/65/90."""
    u = usage.where(F.col("brand").isin(list(cfg.reported_brands)))
    present = u.select("brand").distinct()
    mp = max_progress(u, cfg, keys=("brand",))
    vals = [v for _, v in cfg.progress_bands]
    g = mp.groupBy("brand").agg(F.count(F.lit(1)).alias("pairs"),
                                *[count_if(F.col("progress") == v).alias(f"n{v}") for v in vals])
    out = present.join(g, "brand", "left")
    return out.select("brand", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"),
                      *[r6(F.coalesce(ratio(F.col(f"n{v}"), F.col("pairs")), F.lit(0.0))).alias(f"share_{v}")
                        for v in vals])


# ---------------------------------------------------------------- funnel
FUNNEL_STAGES = ("licensed", "enrolled", "hours_gt_0", "hours_ge_20min", "hours_ge_1h", "hours_ge_5h")


def funnel(usage: DataFrame, roster: DataFrame | None, cfg: Config, whole_roster: DataFrame | None = None) -> DataFrame:
    """Unique-user funnel: licences -> enrolled -> >0 h -> >=20 min -> >=1 h -> >=5 h.

    The licence row appears only when the roster has at least as many distinct
    users as are enrolled; otherwise it is omitted and ``roster_omitted`` is set.
    A roster counts as given if it has users before it was cut to the slice
    (``whole_roster``), so a slice without licences says that its row is omitted.
    """
    hpu = hours_per_user(usage, cfg)
    h = F.col("hours")
    one = hpu.agg(F.count(F.lit(1)).alias("enrolled"), count_if(h > 0).alias("gt0"),
                  count_if(h >= cfg.twenty_minutes).alias("ge20"), count_if(h >= 1).alias("ge1"),
                  count_if(h >= 5).alias("ge5"))
    if roster is not None:
        lic = roster.agg(F.count_distinct("user_id")).scalar()
        one = one.withColumn("lic", lic)
        given = (roster if whole_roster is None else whole_roster).agg(F.count("user_id").alias("n")).scalar() > 0
        use_roster = (F.col("lic") > 0) & (F.col("lic") >= F.col("enrolled"))
        omitted = given & (F.col("lic") < F.col("enrolled"))
    else:
        one = one.withColumn("lic", F.lit(None).cast("long"))
        use_roster, omitted = F.lit(False), F.lit(False)
    src_r, src_s = F.lit("roster"), F.lit("snapshot")
    arr = F.array(
        F.struct(F.lit(0).alias("step"), F.lit(FUNNEL_STAGES[0]).alias("stage"), F.col("lic").alias("users"),
                 src_r.alias("source"), use_roster.alias("keep")),
        *[F.struct(F.lit(i).alias("step"), F.lit(FUNNEL_STAGES[i]).alias("stage"), F.col(c).alias("users"),
                   src_s.alias("source"), F.lit(True).alias("keep"))
          for i, c in ((1, "enrolled"), (2, "gt0"), (3, "ge20"), (4, "ge1"), (5, "ge5"))])
    rows = one.select(F.inline(arr), omitted.alias("roster_omitted")).where(F.col("keep")).drop("keep")
    w = Window.orderBy("step")   # at most 6 rows
    first = F.first("users").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("step", "stage", F.col("users").cast("long").alias("users"), "source",
                       r6(ratio(F.col("users"), first) * 100).alias("pct_base"),
                       r6(ratio(F.col("users"), F.lag("users").over(w)) * 100).alias("pct_step"),
                       "roster_omitted")


def funnel_compare(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Current funnel with the previous funnel's numbers by stage (left join)."""
    p = prev.select("stage", F.col("users").alias("users_prev"), F.col("pct_base").alias("pct_base_prev"),
                    F.col("pct_step").alias("pct_step_prev"))
    return cur.select("step", "stage", "users", "pct_base", "pct_step").join(p, "stage", "left")


# ---------------------------------------------------------------- daily platform users
def active_vs_effective(daily_sides: DataFrame, cfg: Config) -> DataFrame:
    """Per side: user-day sums of active and raw effective users, their ratio,
    daily mean/median of both and the number of days."""
    g = daily_sides.groupBy("side").agg(
        F.coalesce(F.sum("active"), F.lit(0)).cast("double").alias("active_ud"),
        F.coalesce(F.sum("effective_raw"), F.lit(0)).cast("double").alias("effective_ud"),
        F.avg("active").alias("active_day_mean"), median(F.col("active").cast("double"), cfg).alias("active_day_median"),
        median(F.col("effective_raw").cast("double"), cfg).alias("effective_day_median"),
        F.count(F.lit(1)).alias("days"))
    return g.select(
        "side", r6("active_ud").alias("active_ud"), r6("effective_ud").alias("effective_ud"),
        r6(ratio("effective_ud", "active_ud") * 100).alias("ratio"),
        r6("active_day_mean").alias("active_day_mean"), r6("active_day_median").alias("active_day_median"),
        r6(ratio("effective_ud", "days")).alias("effective_day_mean"),
        r6("effective_day_median").alias("effective_day_median"), F.col("days").cast("long"))


# ---------------------------------------------------------------- certification
def _cert_per_user(usage: DataFrame, cfg: Config, keys=()) -> DataFrame:
    """First level: per (keys, user) row counts; the null user forms its own group."""
    cert, p = F.col("certified"), F.col("progress")
    return usage.groupBy(*keys, "user_id").agg(
        n_rows(usage).alias("rows"), n_rows(usage, cert).alias("certs"),
        n_rows(usage, p >= 90).alias("done"), n_rows(usage, (p >= 90) & cert).alias("done_cert"),
        n_rows(usage, cert & (p < 20)).alias("incoherent"),
        dsum0("hours", cfg).alias("hours"),
        dsum0(F.when(cert, F.col("hours")), cfg).alias("cert_hours"))


def certification(usage: DataFrame, cfg: Config) -> DataFrame:
    """One row of certification metrics over a usage slice."""
    pu = _cert_per_user(usage, cfg)
    u = F.col("user_id")
    with_cert = F.when(u.isNotNull() & (F.col("certs") > 0), F.col("certs"))
    pairs, certs = F.sum("rows"), F.sum("certs")
    users = F.count(u)
    uwc = F.count(with_cert)
    one = pu.agg(
        pairs.cast("long").alias("pairs"), certs.cast("long").alias("certificates"),
        (ratio(certs, pairs) * 100).alias("rate_pair"),
        users.cast("long").alias("users"), uwc.cast("long").alias("users_with_cert"),
        (ratio(uwc, users) * 100).alias("rate_user"),
        F.avg(with_cert).alias("cert_per_user_mean"), median(with_cert.cast("double"), cfg).alias("cert_per_user_median"),
        F.sum("done").cast("long").alias("pairs_done"),
        (ratio(F.sum("done_cert"), F.sum("done")) * 100).alias("cert_rate_done"),
        F.sum("incoherent").cast("long").alias("incoherent"),
        (ratio(F.sum(F.col("cert_hours").cast(cfg.sum_type)), F.sum(F.col("hours").cast(cfg.sum_type))) * 100)
        .alias("pct_hours_cert"))
    dbl = ("rate_pair", "rate_user", "cert_per_user_mean", "cert_per_user_median", "cert_rate_done", "pct_hours_cert")
    return one.select(*[r6(c).alias(c) if c in dbl else F.col(c) for c in one.columns])


def certification_by_period(usage: DataFrame, periods: DataFrame, cfg: Config) -> DataFrame:
    """Per period: certificates, users with one, rate per user (1 dp) and per row (2 dp)."""
    pu = _cert_per_user(usage, cfg, keys=("period_index",))
    u = F.col("user_id")
    g = pu.groupBy("period_index").agg(
        F.sum("certs").cast("long").alias("certificates"),
        F.count(F.when(u.isNotNull() & (F.col("certs") > 0), u)).cast("long").alias("users_with_cert"),
        F.bround(ratio(F.count(F.when(u.isNotNull() & (F.col("certs") > 0), u)), F.count(u)) * 100, 1)
        .alias("rate_user"),
        F.bround(ratio(F.sum("certs"), F.sum("rows")) * 100, 2).alias("rate_pair"))
    return F.broadcast(periods.select("period_index", "label")).join(g, "period_index")


def certification_by_group(usage: DataFrame, col: str, cfg: Config) -> DataFrame:
    """Per value of ``col`` (brand / center / level): users, certificates, certified
    users, rate per user (1 dp), mean (2 dp) and median certificates per certified user."""
    pu = _cert_per_user(usage.where(F.col(col).isNotNull()), cfg, keys=(col,))
    u = F.col("user_id")
    with_cert = F.when(u.isNotNull() & (F.col("certs") > 0), F.col("certs"))
    g = pu.groupBy(col).agg(
        F.count(u).cast("long").alias("users"), F.sum("certs").cast("long").alias("certificates"),
        F.count(with_cert).cast("long").alias("users_with_cert"),
        F.bround(ratio(F.count(with_cert), F.count(u)) * 100, 1).alias("rate_user"),
        F.bround(F.avg(with_cert), 2).alias("cert_per_user_mean"),
        r6(median(with_cert.cast("double"), cfg)).alias("cert_per_user_median"))
    return g.withColumnRenamed(col, "group_value").withColumn("group_column", F.lit(col))
