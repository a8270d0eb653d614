"""Snapshots against a nested-loop recomputation, their properties, and the odd cases."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.operators import history, snapshots
from cohortline.plans.studies import enriched_history
from workload import views

HASH = "alumno_carrera_hash"


def loops(rows: pd.DataFrame, categories=()):
    """One snapshot at a time, each from all rows up to its semester."""
    out = {}
    for key in rows[HASH].unique():
        mine = rows[rows[HASH] == key]
        label = int((mine["semestre"].max() or 0) >= 10)
        for semester in mine["semestre"].unique():
            seen = mine[mine["semestre"] <= semester]
            pf, pa = seen["pf"].fillna(0), seen["pa"].fillna(0)
            if seen.empty:
                out[key, 0] = [0.0, 0.0, 0, 0, 0, 0.0, label] + [0.0, 0] * len(categories)
                continue
            summer = {t == "V" for t in seen["tipo_periodo"]}
            row = [pf.mean(), pa.mean(), len(seen), int((pf < 6).sum()), len(summer),
                   math.sqrt(((pf - pf.mean()) ** 2).mean()), label]
            for c in categories:
                part = pf[seen["categoria_materia"] == c]
                row += [part.mean() if len(part) else 0.0, int((part < 6).sum())]
            out[key, int(semester)] = row
    return out


def check(df, want, categories=()):
    names = [c for c in df.columns if c not in (HASH, "semestre_actual", "categoria_asistencia")]
    got = {(r[HASH], r["semestre_actual"]): [r[n] for n in names] for r in df.collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=1e-9), key


@pytest.fixture(scope="module")
def merged(spark, folder):
    enriched = enriched_history(views.history(spark, folder))
    return history.attach_category(enriched, views.part_types(spark, folder)).cache()


def test_progress_equals_loops(merged):
    pdf = merged.select(HASH, "semestre", "pf", "pa", "tipo_periodo").toPandas()
    check(snapshots.progress_snapshots(merged), loops(pdf))


def test_granular_equals_loops(merged):
    categories = snapshots.category_list(merged)
    pdf = merged.select(HASH, "semestre", "pf", "pa", "tipo_periodo", "categoria_materia").toPandas()
    check(snapshots.granular_snapshots(merged), loops(pdf, categories), categories)


def toy(spark, rows):
    return spark.createDataFrame(
        rows, f"{HASH} string, semestre int, pf double, pa double, tipo_periodo string")


def test_cumulative_frame_with_null_semester(spark):
    df = toy(spark, [("u", 2, 5.0, 50.0, "A"), ("u", None, 7.0, 70.0, "V"), ("u", 1, 9.0, 90.0, "A")])
    rows = {r["semestre_actual"]: r for r in snapshots.progress_snapshots(df).collect()}
    assert (rows[1]["promedio_calificacion_final"], rows[1]["materias_cursadas"]) == (9.0, 1)
    assert (rows[2]["promedio_calificacion_final"], rows[2]["materias_cursadas"]) == (7.0, 2)
    assert rows[2]["std_calificacion_final"] == 2.0
    empty = rows[0].asDict()
    assert empty["categoria_asistencia"] == "1. Riesgo (<80%)"
    assert all(not v for k, v in empty.items() if k not in (HASH, "categoria_asistencia"))


@pytest.mark.parametrize("types, want", [("AB", 1), ("VV", 1), ("AVV", 2), ([None, "V"], 2)])
def test_summer_count_is_the_number_of_distinct_answers(spark, types, want):
    df = toy(spark, [("u", 1, 7.0, 80.0, t) for t in types])
    assert snapshots.progress_snapshots(df).first()["periodos_verano_cursados"] == want


def test_missing_grade_counts_as_failed_zero(spark):
    df = toy(spark, [("u", 1, None, None, "A"), ("u", 1, 8.0, 90.0, "A")])
    row = snapshots.progress_snapshots(df).first()
    assert (row["promedio_calificacion_final"], row["materias_reprobadas"]) == (4.0, 1)
    assert row["promedio_asistencia_final"] == 45.0


def test_given_label_is_carried(spark):
    df = toy(spark, [("u", 1, 7.0, 80.0, "A"), ("u", 2, 7.0, 80.0, "A")]).withColumn(
        "resultado_final", F.lit(1))
    assert [r["resultado_final"] for r in snapshots.progress_snapshots(df).collect()] == [1, 1]


def test_empty_history_keeps_the_schema(spark):
    out = snapshots.progress_snapshots(toy(spark, []), keep_key=False)
    assert out.columns == [
        "semestre_actual", "promedio_calificacion_final", "promedio_asistencia_final",
        "materias_cursadas", "materias_reprobadas", "periodos_verano_cursados",
        "std_calificacion_final", "resultado_final", "categoria_asistencia"]
    assert out.count() == 0


def test_deviation_keeps_its_digits_far_from_zero(spark):
    base = 1e9
    rows = [("u", s, base + v, 0.0, "A") for s, v in [(1, 1.0), (1, 2.0), (2, 4.0), (3, 7.0)]]
    got = {r["semestre_actual"]: r["std_calificacion_final"]
           for r in snapshots.progress_snapshots(toy(spark, rows)).collect()}
    assert got[1] == pytest.approx(0.5, abs=1e-6)
    assert got[3] == pytest.approx(math.sqrt(5.25), abs=1e-6)


def test_unlisted_category_is_an_error(merged):
    with pytest.raises(Exception, match="no column for category"):
        snapshots.granular_snapshots(merged, ["ECONOMY"]).collect()


def test_long_form_adds_up(merged):
    out = snapshots.category_snapshots(merged)
    last = out.groupBy(HASH, "categoria_materia").agg(F.max("materias_cursadas").alias("n"))
    total = last.groupBy(HASH).agg(F.sum("n").alias("n"))
    plain = merged.filter("semestre is not null").groupBy(HASH).agg(F.count("*").alias("n"))
    assert total.exceptAll(plain).count() == 0


def test_granular_properties(merged):
    out = snapshots.granular_snapshots(merged)
    failed = [c for c in out.columns if c.startswith("materias_reprobadas_") and "totales" not in c]
    total = sum((F.col(c) for c in failed), F.lit(0))
    assert out.filter(total != F.col("materias_reprobadas_totales")).count() == 0
    last = out.groupBy(HASH).agg(F.max("materias_cursadas_totales").alias("n"))
    plain = merged.groupBy(HASH).agg(F.count("*").alias("n"))
    assert last.exceptAll(plain).count() == 0
    assert out.groupBy(HASH).agg(F.countDistinct("resultado_final").alias("k")).filter("k > 1").count() == 0


def test_one_student_with_a_third_of_all_rows(spark):
    """The hot student's rows combine before the shuffle: each state arrives once per task."""
    rng = random.Random(7)
    hot = [("hot", rng.randint(1, 12), float(rng.randint(0, 50)) / 5, 80.0, "A") for _ in range(20_000)]
    cold = [(f"s{i % 4000}", rng.randint(1, 9), 7.0, 80.0, "V") for i in range(40_000)]
    df = toy(spark, hot + cold).repartition(16)
    out = snapshots.progress_snapshots(df)
    last = out.filter(F.col(HASH) == "hot").orderBy(F.desc("semestre_actual")).first()
    grades = [r[2] for r in hot]
    mean = sum(grades) / len(grades)
    assert last["materias_cursadas"] == len(hot)
    assert last["promedio_calificacion_final"] == pytest.approx(mean)
    assert last["std_calificacion_final"] == pytest.approx(
        math.sqrt(sum((g - mean) ** 2 for g in grades) / len(grades)))
    assert last["resultado_final"] == 1


def test_result_does_not_depend_on_partitioning(merged):
    one = snapshots.progress_snapshots(merged.repartition(1)).select(
        HASH, "semestre_actual", F.round("promedio_calificacion_final", 9),
        F.round("std_calificacion_final", 9), "categoria_asistencia")
    many = snapshots.progress_snapshots(merged.orderBy(F.rand(3)).repartition(13)).select(
        HASH, "semestre_actual", F.round("promedio_calificacion_final", 9),
        F.round("std_calificacion_final", 9), "categoria_asistencia")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_too_many_categories_are_an_error(spark):
    rows = spark.range(snapshots.MOST_COLUMNS + 1).selectExpr("cast(id as string) as categoria_materia")
    assert len(snapshots.category_list(rows.limit(snapshots.MOST_COLUMNS))) == snapshots.MOST_COLUMNS
    with pytest.raises(ValueError, match="category_snapshots"):
        snapshots.category_list(rows)
