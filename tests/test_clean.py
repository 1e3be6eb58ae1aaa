"""Cleaning rules on hand-written frames."""

from pyspark.sql import functions as F

from cursus.config import DEFAULT
from cursus.functions import columns as C
from cursus.functions.clean import clean_users
from cursus.functions.names import normalise_text


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_clean_users_rules(spark):
    data = [("a@b@ula.edu.mx", None, "Superior"),        # test pattern: '@ula.edu.mx' -> dropped
            ("Prueba.x@uane.mx", None, None),              # test pattern, case-insensitive -> dropped
            ("paula@utc.mx", "", " medioSuperior"),        # 'ula' is tested before 'utc' -> ULA
            ("ana@ALUMNOS.UTEG.EDU.MX", None, "MedioSuperior ,Superior"),
            ("x@indo.edu.mx", "Centro propio", "MedioSuperior, Superior"),
            ("z@uteg.edu.mx", None, "Docentes"),
            (None, None, None)]
    df = spark.createDataFrame(data, "user_id string, center string, level string")
    out = {r["user_id"]: r for r in clean_users(df, DEFAULT).collect()}
    assert "a@b@ula.edu.mx" not in out and "Prueba.x@uane.mx" not in out
    assert out["paula@utc.mx"]["brand"] == "ULA"
    assert out["paula@utc.mx"]["center"] == "Universidad Tres Culturas"       # empty center -> domain
    assert out["paula@utc.mx"]["level"] == "Medio superior"
    assert out["ana@ALUMNOS.UTEG.EDU.MX"]["center"] == "Centro Universitario UTEG"   # domain lowered
    assert out["ana@ALUMNOS.UTEG.EDU.MX"]["population"] == "Docentes"
    assert out["x@indo.edu.mx"]["center"] == "Centro propio"                   # supplied center kept
    assert out["x@indo.edu.mx"]["level"] == "Sin dato"                         # space after comma
    assert out["z@uteg.edu.mx"]["population"] == "Docentes"                    # Q1: idempotent
    assert out[None]["brand"] == "OTRAS" and out[None]["center"] == "OTROS"    # null user kept


def test_segments_and_bands(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.01,), (5.0,), (20.0,), (20.5,), (-1.0,)], "h double")
    got = [r[0] for r in df.select(C.segment(F.col("h"))).collect()]
    assert got == ["No activados", "Exploradores", "Constantes", "Constantes", "Intensivos", "Power users",
                   "Exploradores"]
    b = spark.createDataFrame([("Entre 0% y 20%",), ("Entre 80% y 100%",), ("otro",), (None,)], "b string")
    assert [r[0] for r in b.select(C.progress_value(F.col("b"), DEFAULT)).collect()] == [10.0, 90.0, None, None]
    c = spark.createDataFrame([(" Si ",), ("SI",), ("No",), (None,), ("sí",)], "c string")
    assert [r[0] for r in c.select(C.cert_flag(F.col("c"))).collect()] == [True, True, False, False, False]


def test_period_labels_and_pct(spark):
    df = spark.createDataFrame([(1,), (12,), (2025 * 12 + 10,), (2026 * 12,)], "o int")
    got = [r[0] for r in df.select(C.period_label(F.col("o"), "month")).collect()]
    assert got == ["Ene", "Dic", "Nov-25", "Ene-26"]
    p = spark.createDataFrame([(110.0, 100.0), (5.0, 0.0), (5.0, None)], "a double, b double")
    assert [r[0] for r in p.select(C.pct_change(F.col("a"), F.col("b"))).collect()] == [10.000000000000009, None, None] \
        or [round(r[0], 9) if r[0] is not None else None for r in p.select(C.pct_change("a", "b")).collect()] == [10.0, None, None]


def test_pseudonym_keeps_null(spark):
    df = spark.createDataFrame([("a@b.c",), (None,)], "u string")
    got = [r[0] for r in df.select(C.pseudonym(F.col("u"))).collect()]
    assert got[0].startswith("u_") and len(got[0]) == 18 and got[1] is None   # Q16


def test_normalise_name():
    assert normalise_text("MS - Ética: Uso Responsable de Datos") == "ms etica uso responsable de datos"
    assert normalise_text("Cursó Brand#1") == "curso brand 1"
    assert normalise_text("a–b") == "ab"          # non-ASCII dash is dropped, not spaced
