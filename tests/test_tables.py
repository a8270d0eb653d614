"""Sources and sinks, sampling, profile, skewed keys, and the composite jobs."""

import os
import random
import re
from unittest import mock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.constants import METRICS, PERIODS
from cohortline.functions import text
from cohortline.functions.names import numeric_columns
from cohortline.operators import history, profile, sampling
from cohortline.operators.bounded import small
from cohortline.operators.distribution import column_histograms
from cohortline.plans import studies
from cohortline.sources import tables
from workload import views


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


# --- sources and sinks ---

def test_jdbc_reads_are_split_by_group(spark):
    options = {"url": "jdbc:postgresql://host/db", "user": "u", "driver": "org.postgresql.Driver"}
    with mock.patch("pyspark.sql.readwriter.DataFrameReader.load") as load, \
            mock.patch("pyspark.sql.readwriter.DataFrameReader.options", autospec=True,
                       side_effect=lambda self, **kw: self) as given:
        load.side_effect = [
            spark.createDataFrame([("m", 1, 2, *[1.0] * 13)],
                                  "matricula string, id_grupo long, id_materia long, "
                                  + ", ".join(f"{m} double" for m in METRICS)),
            spark.createDataFrame([(1, 3, 4, 35), (2, 3, 4, 35)],
                                  "id_grupo long, id_carrera int, semestre int, id_periodo int")]
        out = tables.read_grade_history(spark, options, (1, 1000), 8)
    assert out.columns == ["matricula", "id_carrera", "id_grupo", "id_materia", "semestre",
                           "periodo", *METRICS]
    assert out.count() == 1
    passed = [call.kwargs for call in given.call_args_list]
    assert {"partitionColumn": "id_grupo", "lowerBound": "1", "upperBound": "1000",
            "numPartitions": "8"} in passed and options in passed


def test_csv_keeps_text_and_missing_cells(spark, tmp_path):
    path = str(tmp_path / "subjects")
    titles = ['Cálculo, "I"', "línea\ndos", None, "NA", "señal"]
    df = spark.createDataFrame(list(enumerate(titles)), "id_materia long, materia string")
    tables.write_csv(df, path)
    got = dict(rows(tables.read_subjects(spark, path)))
    assert got == {0: 'Cálculo, "I"', 1: "línea\ndos", 2: None, 3: None, 4: "señal"}
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    assert pd.read_csv(os.path.join(path, part)).columns.tolist() == ["id_materia", "materia"]


def test_absent_dictionary(spark, tmp_path):
    assert tables.read_subject_categories(spark, str(tmp_path / "none.csv")) is None


def test_csv_columns_by_name_and_blanks(spark, tmp_path):
    path = str(tmp_path / "subjects")
    spark.createDataFrame([("  lead ", 3, "7"), ("x", 4, "no number")],
                          "materia string, carrera int, id_materia string").write.mode(
        "overwrite").options(header=True, ignoreLeadingWhiteSpace=False,
                             ignoreTrailingWhiteSpace=False).csv(path)
    assert rows(tables.read_subjects(spark, path)) == [(7, "  lead "), (None, "x")] or set(
        rows(tables.read_subjects(spark, path, multi_line=False))) == {(7, "  lead "), (None, "x")}
    with pytest.raises(ValueError):
        tables.read_subject_categories(spark, path)
    tables.write_csv(spark.createDataFrame([(1, "  lead ")], "id_materia long, materia string"), path)
    assert rows(tables.read_subjects(spark, path)) == [(1, "  lead ")]


def test_period_dimension(spark):
    assert tables.period_dimension(spark).count() == len(PERIODS) == 23


# --- skewed keys ---

@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_labels_with_a_hot_entity(spark, threshold):
    data = [("hot", i) for i in range(3000)] + [(f"k{i % 300}", i) for i in range(5000)] + [(None, i) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, i int").repartition(8)
    per_key = {k: max(i for x, i in data if x == k) for k in {k for k, _ in data} - {None}}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = history.label_rows(df, "k", "i", 2_900, "y")
        assert out.columns == ["k", "i", "y"] and out.count() == len(data)
        got = {(r["k"], r["y"]) for r in out.select("k", "y").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(k, int(top >= 2_900)) for k, top in per_key.items()} | {(None, 0)}


def test_small_hands_over_either_way(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") / 7).alias("x"))
    assert rows(small(df)) == rows(small(df, max_rows=10)) == rows(df)
    assert "LocalTableScan" in small(df)._jdf.queryExecution().toString()


# --- sampling ---

@pytest.mark.parametrize("ranked", [1_000_000, 10])
def test_sample_is_exact_and_independent_of_partitioning(spark, monkeypatch, ranked):
    monkeypatch.setattr(sampling, "RANKED_ROWS", ranked)
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    one = sampling.sample_exact(df.repartition(3), 700, ["id"])
    two = sampling.sample_exact(df.orderBy(F.desc("id")).repartition(11), 700, ["id"])
    assert one.count() == 700 == one.select("id").distinct().count()
    assert rows(one) == rows(two)
    other = sampling.sample_exact(df, 700, ["id"], seed=1)
    assert rows(one) != rows(other)
    assert sampling.sample_exact(df, 5000, ["id"]).count() == 5000
    assert sampling.sample_exact(df, 0, ["id"]).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_exact(df, 5001, ["id"])


def test_shape_and_preview(spark):
    df = spark.range(9).withColumn("x", F.lit(1))
    assert sampling.shape(df) == (9, 2)
    assert [r["id"] for r in sampling.preview(df, F.desc("id")).collect()] == [8, 7, 6, 5, 4]


# --- profile ---

@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(11)
    data = [(rng.choice([None, 0.0, -1.5, 2.0, rng.gauss(3, 2)]), rng.randint(0, 5), 4,
             rng.choice(["x", "yy", None, "zzz"]), rng.random() < 0.5, None) for _ in range(400)]
    data += data[:20]
    return spark.createDataFrame(
        data, "a double, b int, c int, s string, t boolean, e double").repartition(5)


def test_numeric_profile_equals_pandas(frame):
    pdf = frame.toPandas()
    got = {r["column"]: r for r in profile.numeric_summary(frame).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for name in ("a", "b"):
        r, s = got[name], pdf[name].dropna().astype(float)
        want = [len(pdf), len(pdf) - len(s), s.nunique(), int((s == 0).sum()), int((s < 0).sum()),
                s.min(), s.max(), s.mean(), s.std(), s.var(), s.skew(), s.kurt(), s.quantile(0.05),
                s.quantile(0.95), s.quantile(0.75) - s.quantile(0.25),
                (s - s.median()).abs().median(), s.std() / s.mean()]
        names = ["n_rows", "n_missing", "n_distinct", "n_zeros", "n_negative", "min", "max", "mean",
                 "sd", "variance", "skewness", "kurtosis", "p05", "p95", "iqr", "mad", "cv"]
        assert [r[n] for n in names] == pytest.approx(want)
    assert got["c"]["variance"] == 0 and got["c"]["skewness"] is None
    assert got["e"]["n_missing"] == 420 and got["e"]["mean"] is None and got["e"]["n_distinct"] == 0


def test_overview_and_duplicates(frame):
    pdf = frame.toPandas()
    row = profile.overview(frame).first()
    assert row["n_rows"] == 420 and row["n_duplicate_rows"] == int(pdf.duplicated().sum())
    assert row["n_missing_cells"] == int(pdf.isna().sum().sum())
    assert (row["n_numeric"], row["n_text"], row["n_boolean"]) == (4, 1, 1)
    copies = profile.duplicates(frame)
    assert copies.agg(F.sum(F.col("n_copies") - 1)).first()[0] == row["n_duplicate_rows"]


def test_text_profile(frame):
    pdf = frame.toPandas()
    row = profile.text_summary(frame).filter("column = 's'").first()
    s = pdf["s"].dropna()
    assert (row["n_missing"], row["n_distinct"], row["min_length"], row["max_length"]) == (
        420 - len(s), 3, 1, 3)
    assert row["mean_length"] == pytest.approx(s.str.len().mean())
    top = [(r["value"], r["n"]) for r in profile.top_text_values(frame, 2).filter(
        "column = 's'").orderBy("rank").collect()]
    assert [n for _, n in top] == s.value_counts().head(2).tolist()


def test_missing_and_co_missing(frame):
    pdf = frame.toPandas()
    got = {r["column"]: r["n_missing"] for r in profile.missingness(frame).collect()}
    assert got == pdf.isna().sum().to_dict()
    pairs = {(r["column_1"], r["column_2"]): r for r in profile.co_missing(frame).collect()}
    both = (pdf["a"].isna() & pdf["s"].isna()).sum()
    assert pairs["a", "s"]["n_both"] == both
    want = pdf[["a", "s"]].isna().astype(int).corr().iloc[0, 1]
    assert pairs["a", "s"]["nullity_correlation"] == pytest.approx(want)
    assert pairs["a", "e"]["nullity_correlation"] is None


def test_extremes(frame):
    pdf = frame.toPandas()
    low = [r["value"] for r in profile.extremes(frame, 3).filter(
        "column = 'a' and side = 'low'").orderBy("rank").collect()]
    assert low == sorted(pdf["a"].dropna().unique())[:3]


# --- composite jobs ---

def test_studies_run_end_to_end(spark, folder, tmp_path):
    raw = views.history(spark, folder)
    study = studies.snapshot_study(raw)
    assert study["snapshots"].count() > 0
    assert study["trend"].count() == study["student_profiles"].select("id_carrera").distinct().count()
    assert study["chi_square_attendance"].first()["dof"] > 0
    written = studies.dictionary_job(views.part_subjects(spark, folder), str(tmp_path / "dictionary"))
    dictionary = tables.read_subject_categories(spark, str(tmp_path / "dictionary"))
    assert rows(dictionary) == rows(written["dictionary"])
    categories = studies.category_study(
        raw, views.part_types_with_gaps(spark, folder), "promedio_pf_promo",
        ["materias_reprobadas_totales", "materias_reprobadas_promo"])
    assert categories["backlog_box"].count() == 4
    assert categories["predictive_power"].count() == 7
    profiled = studies.profile_study(raw, str(tmp_path / "profile"), 1000)
    assert spark.read.parquet(str(tmp_path / "profile" / "overview")).first()["n_rows"] == 1000
    assert sorted(os.listdir(tmp_path / "profile")) == sorted(profiled)


def test_histogram_of_a_profile_frame(frame):
    cells = column_histograms(frame, numeric_columns(frame))
    totals = dict(rows(cells.groupBy("column").agg(F.sum("n"))))
    assert totals["b"] == 420 and "e" not in totals


def test_overlapping_keywords_take_the_least_rule(spark):
    rules = (("first", "abcd|zz"), ("second", "bc|abc"), ("third", r"x+y$"), ("fourth", "b c|é"))
    texts = ["xabcx", "abcd", "bcd abcd", "zbcz", "q xxxy", "bc xy", "b c", "café", "none", "", None, "a\nzz", "ab cd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", text.classify("t", rules, "rest").alias("c")).collect()}

    def first(t):
        return next((name for name, p in rules if t is not None and re.search(p, t)), "rest")

    assert [got[i] for i in range(len(texts))] == [first(t) for t in texts]
    only = df.select(text.classify("t", (("odd", "^a.c"),)).alias("c")).collect()
    assert [r["c"] for r in only] == ["odd" if t and re.search("^a.c", t) else "Otra" for t in texts]
    assert {r["c"] for r in df.select(text.classify("t", ()).alias("c")).collect()} == {"Otra"}
