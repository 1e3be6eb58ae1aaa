"""File sources, refresh and sinks on hand-written exports."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cursus.config import DEFAULT, TEST, USAGE_COLUMNS
from cursus.operators.panel import recurring_pct
from cursus.operators.snapshot import funnel
from cursus.sources import files as FS
from cursus.sources import sinks, versions
from cursus.streaming.refresh import refresh_usage

NAMES = [src for src, _ in USAGE_COLUMNS]


def export(path, users, hours=1.0, columns=NAMES, course="C1"):
    """A usage export by hand: one row a user, columns in the given order."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    value = {"Horas de aprendizaje": str(hours), "ID de la LE": course, "Nombre de la LE": course, "Centro": "Z"}
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(columns) + "\n")
        for u in users:
            f.write(",".join(u if c == "Usuario" else value.get(c, "") for c in columns) + "\n")


def age(path, seconds):
    t = time.time() - seconds
    os.utime(path, (t, t))


def rows(df):
    return sorted((r.period_index, r.user_id, r.course_id, r.hours) for r in df.collect())


def test_columns_are_read_by_name(spark, tmp_path):
    export(f"{tmp_path}/ene_26/consumo_por_usuario__1.csv", ["a@x.mx"])
    reverse = NAMES[::-1]
    export(f"{tmp_path}/feb_26/consumo_por_usuario__1.csv", ["b@x.mx"], 2.5, reverse[:2] + ["Extra"] + reverse[2:])
    export(f"{tmp_path}/mar_26/consumo_por_usuario__1.csv", ["c@x.mx"], 3.5, [c for c in NAMES if c != "Centro"])
    got = rows(FS.read_period_snapshots(spark, str(tmp_path), DEFAULT))
    assert got == [(24312, "a@x.mx", "C1", 1.0), (24313, "b@x.mx", "C1", 2.5), (24314, "c@x.mx", "C1", 3.5)]


@pytest.mark.parametrize("small", [FS.SMALL_FILE, 0])
def test_headers_with_line_feeds_and_byte_order_marks(spark, tmp_path, monkeypatch, small):
    """Files packed into a task, or each in a task of its own that stops after the header."""
    monkeypatch.setattr(FS, "SMALL_FILE", small)

    def file(name, text):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w", encoding="utf-8") as f:
            f.write(text)

    file("a b/ñ%20x.csv", "\ufeffUsuario,Centro\na@x.mx,Z\n")
    file("b/plain.csv", "Usuario,Centro\n" + "b@x.mx,Z\n" * 1000)
    file("b/feed.csv", '"Otra\ncosa",Usuario,Centro\n1,c@x.mx,Z\n"2\n3",d@x.mx,Z\n')
    file("c/parts.csv/part-0.csv", "Centro,Usuario\nZ,e@x.mx\n")
    file("c/parts.csv/_SUCCESS", "")
    file("c/empty.csv", "")
    file("c/header_only.csv", "Usuario,Centro\n")
    paths = f"{tmp_path}/*/*.csv"
    got = {h: [f.rsplit("/", 1)[-1] for f in files] for h, files in FS.headers(spark, paths).items()}
    assert got == {"Usuario,Centro": ["ñ%20x.csv", "plain.csv", "header_only.csv"], "Centro,Usuario": ["part-0.csv"],
                   '"Otra\ncosa",Usuario,Centro': ["feed.csv"]}
    users = FS.read_csv_by_header(spark, paths, DEFAULT).groupBy("user_id", "center").count().collect()
    assert sorted(map(tuple, users)) == [("a@x.mx", "Z", 1), ("b@x.mx", "Z", 1000), ("c@x.mx", "Z", 1), ("d@x.mx", "Z", 1),
                                         ("e@x.mx", "Z", 1)]
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(FS.ALONE)
    with pytest.raises(FileNotFoundError):
        FS.read_csv_by_header(spark, f"{tmp_path}/none/*.csv", DEFAULT)
    assert FS.read_csv_by_header(spark, f"{tmp_path}/c/empty.csv", DEFAULT).count() == 0


def test_a_task_stops_after_the_header_of_a_large_file():
    read = []

    def batches():
        for k in range(100):
            read.append(k)
            yield FS.pa.RecordBatch.from_pydict({"file": ["f"] * 2, "value": [f"a,b{k}", "x"], "alone": [True] * 2})

    out = [b.to_pylist() for b in FS._head_lines(batches())]
    assert out == [[{"file": "f", "header": "a,b0"}]] and read == [0]


def test_many_small_files_share_tasks(spark, tmp_path):
    for k in range(400):
        export(f"{tmp_path}/d{k % 7}/f{k}.csv", ["a@x.mx"], columns=NAMES if k % 2 else NAMES[::-1])
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    found = FS.headers(spark, f"{tmp_path}/*/*.csv")
    tasks = [jobs.getStageInfo(s).numTasks for j in jobs.getJobIdsForGroup("headers") for s in jobs.getJobInfo(j).stageIds]
    assert sorted(map(len, found.values())) == [200, 200] and max(tasks) < 100


def test_calendar_periods_come_from_names(spark, tmp_path):
    for month in ("ene_26", "feb_26"):
        export(f"{tmp_path}/{month}/consumo_por_usuario__1.csv", ["a@x.mx"])
    with open(f"{tmp_path}/feb_26/consumo_por_usuario__1.csv", "wb") as f:
        f.write(b"\xff not read")
    assert [r.period_index for r in FS.snapshot_periods(spark, str(tmp_path)).collect()] == [24312, 24313]


def test_one_period_for_two_spellings_and_the_other_name_forms(spark, tmp_path):
    export(f"{tmp_path}/ene_26/consumo_por_usuario__1.csv", ["old@x.mx"])
    age(f"{tmp_path}/ene_26/consumo_por_usuario__1.csv", 500)
    export(f"{tmp_path}/jan_26/consumo_por_usuario__1.csv", ["new@x.mx"])
    export(f"{tmp_path}/xyz_26/consumo_por_usuario__1.csv", ["none@x.mx"])
    assert rows(FS.read_period_snapshots(spark, str(tmp_path), DEFAULT)) == [(24312, "new@x.mx", "C1", 1.0)]
    other = f"{tmp_path}/other"
    export(f"{other}/consumo__marzo.csv", ["m@x.mx"])
    spark.createDataFrame([("p@x.mx", "C2", 4.0)], "Usuario string, `ID de la LE` string, `Horas de aprendizaje` double").write.parquet(
        f"{other}/snapshot_7.parquet")
    assert rows(FS.read_period_snapshots(spark, other, DEFAULT)) == [(3, "m@x.mx", "C1", 1.0), (7, "p@x.mx", "C2", 4.0)]


def test_refresh_takes_the_newest_export_whole(spark, tmp_path):
    land, out, ckpt = f"{tmp_path}/land", f"{tmp_path}/out", f"{tmp_path}/ckpt"
    glob = f"{land}/*/*.csv"
    for k, users in enumerate((["a@x.mx"], ["b@x.mx", "c@x.mx"])):  # two part files of one write
        export(f"{land}/mar_26/part-0000{k}-1111-c000.csv", users)
        age(f"{land}/mar_26/part-0000{k}-1111-c000.csv", 300 - k)
    export(f"{land}/abr_26/consumo_por_usuario__1.csv", ["d@x.mx"], columns=NAMES[::-1])
    export(f"{land}/nomonth/consumo_por_usuario__1.csv", ["e@x.mx"])
    refresh_usage(spark, glob, out, ckpt, DEFAULT, pseudonymise=False)
    assert [r[:2] for r in rows(spark.read.parquet(out))] == [(24314, "a@x.mx"), (24314, "b@x.mx"), (24314, "c@x.mx"), (24315, "d@x.mx")]
    export(f"{land}/mar_26/part-00000-2222-c000.csv", ["f@x.mx"])   # delivered again
    export(f"{land}/abr_26/consumo_por_usuario__0.csv", ["late@x.mx"])  # an older export that comes late
    age(f"{land}/abr_26/consumo_por_usuario__0.csv", 9_000)
    refresh_usage(spark, glob, out, ckpt, DEFAULT, pseudonymise=False)
    assert [r[:2] for r in rows(spark.read.parquet(out))] == [(24314, "f@x.mx"), (24315, "d@x.mx")]
    refresh_usage(spark, glob, f"{tmp_path}/hidden", f"{tmp_path}/ckpt2", DEFAULT)
    assert all(r.user_id.startswith("u_") for r in spark.read.parquet(f"{tmp_path}/hidden").collect())


def usage(spark, rows):
    return spark.createDataFrame(rows, "user_id string, course_id string, hours double, period_index int")


def test_a_rebuild_drops_periods_that_are_gone(spark, base, tmp_path):
    root = str(tmp_path / "prepared")
    for periods in ((1, 2), (2,)):
        u = usage(spark, [("a", "c", 1.0, p) for p in periods])
        sinks.write_prepared(u, base.daily, None, base.periods, root)
        assert sorted(r.period_index for r in spark.read.parquet(f"{versions.current(spark, root)}/usage").collect()) == list(periods)
    assert FS.read_manifest(spark, root).first().mode == "calendario"
    assert FS.read_manifest(spark, str(tmp_path)).first().mode is None


class Killed(Exception):
    pass


def test_a_publisher_killed_at_any_step_leaves_one_whole_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")

    def tables(version, killed_at=None):
        def write(k):
            def run(to):
                if killed_at == (k, "before"):
                    raise Killed
                spark.range(version, version + 1).coalesce(1).write.parquet(to)
                if killed_at == (k, "after"):
                    raise Killed
            return run
        return {k: write(k) for k in ("usage", "daily", "manifest")}

    def seen():
        folder = versions.current(spark, root)
        return {spark.read.parquet(f"{folder}/{k}").first().id for k in ("usage", "daily", "manifest")}

    versions.publish(spark, root, tables(1))
    for k in ("usage", "daily", "manifest"):
        for when in ("before", "after"):
            with pytest.raises(Killed):
                versions.publish(spark, root, tables(2, (k, when)))
            assert seen() == {1}
    clean = versions.clean

    def killed(*a):
        raise Killed
    monkeypatch.setattr(versions, "clean", killed)
    with pytest.raises(Killed):  # after the mark, before old versions go
        versions.publish(spark, root, tables(3))
    assert seen() == {3}
    monkeypatch.setattr(versions, "clean", clean)
    reader = versions.current(spark, root)  # began before the next versions
    for v in (4, 5):
        versions.publish(spark, root, tables(v), keep=3)
        assert seen() == {v} and spark.read.parquet(f"{reader}/usage").first().id == 3
    assert len(versions.published(spark, root)) == 3
    versions.publish(spark, root, tables(6), keep=2)
    assert seen() == {6}
    # folders without a mark stay for the grace time, then go
    folders = tmp_path / "tables" / "versions"
    left = {f.name for f in folders.iterdir()}
    assert len(left) == 2 + 5  # killed before its first table, a publisher leaves none
    versions.clean(spark, root, keep=2, grace_hours=-1)
    assert len({f.name for f in folders.iterdir()}) == 2 and seen() == {6}


def test_a_folder_that_was_never_published_is_read_as_it_is(spark, tmp_path):
    assert versions.current(spark, str(tmp_path)) == str(tmp_path)
    assert versions.current(spark, f"{tmp_path}/none") == f"{tmp_path}/none"


def test_a_large_period_is_written_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        big = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("user_id"), F.lit("c").alias("course_id"),
                                         F.lit(1.0).alias("hours"), F.lit(5).alias("period_index"))
        sinks.write_usage(big, f"{tmp_path}/u", pseudonymise=False)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old) if old else spark.conf.unset(
            "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len([f for f in os.listdir(f"{tmp_path}/u/period_index=5") if f.endswith(".parquet")]) > 1


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from cursus import session
    assert session.is_local(spark)

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster())


def test_a_few_seconds_of_learning_count(spark):
    from cursus.operators.snapshot import hours_per_user
    u = usage(spark, [("a", "c", 4e-7, 1), ("b", "c", 0.0, 1)])
    got = {r.user_id: r.hours for r in hours_per_user(u, DEFAULT).collect()}
    assert got["a"] > 0 and got["b"] == 0


def test_halves_round_to_even(spark):
    g = spark.createDataFrame([(1, 8), (3, 8)], "recurring long, total_active long")
    assert [r.recurring_pct for r in recurring_pct(g).collect()] == [12.0, 38.0]


def test_a_slice_without_licences_says_so(spark):
    u = spark.createDataFrame([("a", "c", 1.0, 1)], "user_id string, course_id string, hours double, period_index int")
    whole = spark.createDataFrame([("z",)], "user_id string")
    none = whole.where("false")
    assert all(r.roster_omitted for r in funnel(u, none, TEST, whole).collect())
    assert not any(r.roster_omitted for r in funnel(u, none, TEST).collect())
    assert not any(r.roster_omitted for r in funnel(u, None, TEST).collect())


def test_names_as_column_equal_names_as_text(spark):
    from cursus.functions.names import normalise_name, normalise_text
    names = ["Cursó Brand#1", "  MS - Ética: Uso\tResponsable ", "a–b", "ﬁn ½ Ⅷ ①", "ÀÉÎõü ß Ø", "日本 x", "", "ĳ ŉ …"]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string").select("n", normalise_name(F.col("n")).alias("v"))
    assert {r.n: r.v for r in df.collect()} == {**{n: normalise_text(n) for n in names}, None: None}


def test_calendar_mode_needs_two_whole_months(spark, tmp_path):
    def daily(folder, last):
        os.makedirs(folder, exist_ok=True)
        days = [f"2026-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in range(1, 29)] + [f"2026-01-{d}" for d in (29, 30, 31)] + last
        for name, columns in (("Horas_de_aprendizaje_1", ["Horas de aprendizaje (SUM)"]),
                              ("Consumo_mensual_1", ["cadenarecurso (DISTINCT_COUNT)"]),
                              ("Usuarios_mensuales_1", ["Nº Usuarios activos (DISTINCT_COUNT)", "Nº Usuarios efectivos (DISTINCT_COUNT)"])):
            with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as f:
                f.write(",".join(["fecha", *columns]) + "\n" + "".join(",".join([x, *["2"] * len(columns)]) + "\n" for x in days))

    for month in ("ene_26", "feb_26", "mar_26"):
        export(f"{tmp_path}/m/{month}/consumo_por_usuario__1.csv", [f"{month}@x.mx"])
    daily(f"{tmp_path}/d", [])
    u, d = FS.read_calendar(spark, f"{tmp_path}/m", f"{tmp_path}/d", DEFAULT)
    assert sorted((r.side, r.user_id) for r in u.collect()) == [("cur", "feb_26@x.mx"), ("prev", "ene_26@x.mx")]
    assert {(r.side, r.n) for r in d.groupBy("side").agg(F.count("*").alias("n")).collect()} == {("cur", 28), ("prev", 31)}
    with pytest.raises(FileNotFoundError):
        FS.read_calendar(spark, f"{tmp_path}/m", f"{tmp_path}/d", DEFAULT, file_glob="nothing*.csv")
