"""Unit rows with known results for cleaning, enrichment, labels, bands and classification."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortline.functions import academic
from cohortline.functions.names import pretty_name, safe_name
from cohortline.functions.text import classify, normalize_text, strip
from cohortline.operators import counting, history, taxonomy


def values(df, *columns):
    return [tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect()]


def test_sentinel_becomes_null_in_numeric_metrics_only(spark):
    df = spark.createDataFrame(
        [("a", -10.0, "-10"), ("a", -5.0, "x"), ("a", 0.0, None), ("", 1.0, "y"), (None, 1.0, "z")],
        "matricula string, pf double, p1 string")
    out = history.sanitize(df)
    assert values(out, "matricula", "pf", "p1") == [
        ("a", None, "-10"), ("a", -5.0, "x"), ("a", 0.0, None), ("", 1.0, "y")]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", float("nan"), 1), ("b", 7.0, -10), ("c", None, 5)],
                               "matricula string, pf double, pa int")
    assert values(history.sanitize(df), "pf", "pa") == [(None, 1), (7.0, None), (None, 5)]


def test_hash_strips_all_white_space(spark):
    df = spark.createDataFrame(
        [("\t 2020A  ", 3), ("\x1f2020A ", 3), (None, None)], "m string, c int")
    got = values(df.select(academic.entity_hash("m", "c").alias("h")), "h")
    want = hashlib.sha256(b"2020A_3").hexdigest()
    assert got[:2] == [want, want]
    assert got[2] == hashlib.sha256(b"nan_nan").hexdigest()


@pytest.mark.parametrize("text", ["\x85a\xa0", "　b c ", "\x1c\x1dd\n", "​e​", ""])
def test_strip_equals_python(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df.select(strip(F.col("t")).alias("t")), "t") == [text.strip()]


def test_period_parts_and_parity(spark):
    df = spark.createDataFrame(
        [("a", 1, 40, 2), ("a", 1, 999, 3), ("a", 1, 35, None), ("a", 1, None, 4)],
        "matricula string, id_carrera int, periodo int, semestre int")
    out = history.enrich(df)
    assert values(out, "nombre_periodo", "año_academico", "tipo_periodo",
                  "es_periodo_regular", "tipo_semestre") == [
        ("2017-2018V", "2017-2018", "V", False, "Par"),
        (None, None, None, False, "Impar"),
        ("2017-2018A", "2017-2018", "A", True, "Impar"),
        (None, None, None, False, "Par")]


def test_labels(spark):
    rows = [("a", 10), ("a", 1), ("b", 9), ("c", None), ("c", None), ("d", None), ("d", 11)]
    df = spark.createDataFrame(rows, "alumno_carrera_hash string, semestre int")
    out = history.label_rows(df)
    assert out.count() == len(rows)
    assert dict(values(out.distinct(), "alumno_carrera_hash", "resultado_final")) == {
        "a": 1, "b": 0, "c": 0, "d": 1}
    assert dict(out.dtypes)["resultado_final"] == "int"


def test_band_edges(spark):
    edges = [(-1.0, None), (0.0, "1"), (79.99, "1"), (79.995, "2"), (84.99, "2"), (94.99, "4"),
             (95.0, "5"), (101.0, "5"), (101.5, None), (None, None)]
    df = spark.createDataFrame([(e,) for e, _ in edges], "x double")
    got = values(df.select(academic.band(F.col("x")).alias("b")), "b")
    assert [g and g[0] for g in got] == [w for _, w in edges]


def test_category_join_matches_null_and_fans_out(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id_materia long")
    dictionary = spark.createDataFrame(
        [(1, "a"), (1, "b"), (None, "z")], "id_materia long, categoria_materia string")
    out = history.attach_category(df, dictionary)
    assert sorted(values(out, "categoria_materia")) == ["Otra", "a", "b", "z"]
    assert set(values(history.attach_category(df, None), "categoria_materia")) == {"Otra"}


def test_normalise(spark):
    texts = [" Señales/Ópticas II\n", None, "ética", "ẠÑÅK9", "a b", "ß½ł", "  "]
    want = ["senalesopticas ii", "", "etica", "anak9", "a b", "", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(normalize_text("t").alias("t")), "t") == want


def test_classifier_order(spark):
    want = {
        "termodinamica": "Ingeniería Mecánica", "analisis de alimentos": "Matemáticas y Estadística",
        "quimica de alimentos": "Materiales y Procesos", "costos": "Administración y Gestión",
        "mercado": "Economía y Finanzas", "genetica": "Humanidades y Comunicación",
        "telecomunicacion": "Electrónica y Control", "base  de datos": "Otra", "": "Otra",
        "base de datos": "Programación y Computación", "plc": "Automatización y Robótica",
        "dibujo": "Diseño y Arquitectura", "optica": "Física y Química"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert dict(values(df.select("t", classify("t").alias("c")), "t", "c")) == want


def test_classifier_takes_expressions_too(spark):
    df = spark.createDataFrame([("calc 1",), ("recalc",), ("x",)], "t string")
    rules = (("start", "^calc"), ("anywhere", "calc"))
    assert values(df.select(classify("t", rules).alias("c")), "c") == ["start", "anywhere", "Otra"]


def test_dictionary_keeps_each_pair_once(spark):
    df = spark.createDataFrame(
        [(1, "Cálculo I"), (1, "CALCULO II"), (1, "Ventas"), (2, None)], "id_materia long, materia string")
    got = sorted(values(taxonomy.subject_dictionary(df), "id_materia", "categoria_materia"))
    assert got == [(1, "Administración y Gestión"), (1, "Matemáticas y Estadística"), (2, "Otra")]


def test_frequencies_and_contingency(spark):
    df = spark.createDataFrame(
        [("a", 0), ("a", 1), ("b", 1), ("b", 1), (None, 1), ("b", None)], "k string, y int")
    assert values(counting.value_counts(df, "k"), "k", "n") == [("b", 3), ("a", 2)]
    wide = counting.contingency_wide(df, "k", "y").orderBy("k")
    assert values(wide, "k", "0", "1") == [("a", 1, 1), ("b", 0, 2)]
    rate = counting.rate_table(df, "k", "y").orderBy("k", "y")
    assert values(rate, "percent") == [50.0, 50.0, 100.0]


def test_names():
    assert safe_name("Matemáticas y Estadística") == "matemáticas_estadística"
    assert safe_name("Otra") == "otra"
    assert pretty_name("promedio_pf_física_química", "promedio_pf_") == "Física Química"
