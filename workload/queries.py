"""One registered query per operator group, over the whole given tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortline.functions.names import numeric_columns
from cohortline.functions.text import normalize_text
from cohortline.operators import (
    correlation, counting, distribution, history, inference, profile, sampling, snapshots, taxonomy,
)
from cohortline.operators.bounded import cut, shared_folder
from cohortline.plans import studies
from cohortline.sources import tables
from workload import views

HASH = "alumno_carrera_hash"
OUTCOME = "resultado_final"
BAND = "categoria_asistencia"
GRADE = "promedio_calificacion_final"
ATTENDANCE = "promedio_asistencia_final"
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "Otra", "PROMO", "SMALL", "STANDARD"]
BACKLOG = ["materias_reprobadas_totales", "materias_reprobadas_economy",
           "materias_reprobadas_promo", "materias_reprobadas_absent"]
PART_RULES = (
    ("Flat", "plate|ring"),
    ("Small red", "small widget|red"),
    ("Device", "widget|gizmo"),
    ("Stock", "rod|bolt"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, significant: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to 6 decimals, or to 9 significant digits where magnitudes differ widely."""
    def shown(field):
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, DoubleType):
            return c
        if field.name in significant:
            return F.when(c.isNotNull(), F.format_string("%.8e", c)).cast("double").alias(field.name)
        return (F.round(c, 6) + F.lit(0.0)).alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def enriched(spark, folder):
    return studies.enriched_history(views.history(spark, folder))


def labelled(spark, folder):
    return studies.labelled_history(views.history(spark, folder))


def progress(spark, folder):
    return studies.progress(views.history(spark, folder))


def granular(spark, folder):
    return studies.granular(
        views.history(spark, folder), views.part_types(spark, folder), PART_TYPES)


def profiles(spark, folder):
    return studies.profiles(views.history(spark, folder))


# --- history ---

@query
def grade_history_join(spark, folder):
    return rounded(views.history(spark, folder))


@query
def sanitized_history(spark, folder):
    return rounded(history.sanitize(views.history(spark, folder)))


@query
def sanitized_nan(spark, folder):
    """Grades that are not a number count as missing."""
    grade = F.when(F.col("id_materia") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("pf"))
    cleaned = history.sanitize(views.history(spark, folder).withColumn("pf", grade))
    return rounded(cleaned.select("id_grupo", "id_materia", "semestre", "pf"))


@query
def enriched_rows(spark, folder):
    return rounded(enriched(spark, folder))


@query
def graduation_labels(spark, folder):
    return labelled(spark, folder).select(
        HASH, "id_grupo", "id_materia", "semestre", "periodo", OUTCOME)


@query
def entity_labels(spark, folder):
    return history.entity_labels(enriched(spark, folder))


@query
def label_value_counts(spark, folder):
    return counting.value_counts(labelled(spark, folder), OUTCOME)


@query
def category_merge(spark, folder):
    merged = history.attach_category(
        enriched(spark, folder), views.part_types_with_gaps(spark, folder))
    return merged.select(HASH, "id_grupo", "id_materia", "semestre", "categoria_materia")


@query
def category_merge_duplicates(spark, folder):
    """Dictionary from classified part names and types: most parts keep two categories."""
    names = taxonomy.subject_dictionary(views.part_subjects(spark, folder), rules=PART_RULES)
    both = names.unionByName(views.part_types(spark, folder))
    merged = history.attach_category(enriched(spark, folder), both)
    return counting.value_counts(merged, "categoria_materia")


@query
def category_merge_fallback(spark, folder):
    absent = tables.read_subject_categories(spark, f"{folder}/no_such_dictionary.csv")
    merged = history.attach_category(enriched(spark, folder), absent)
    return merged.select(HASH, "id_grupo", "id_materia", "categoria_materia")


@query
def history_preview(spark, folder):
    cleaned = history.sanitize(views.history(spark, folder))
    return rounded(sampling.preview(
        cleaned.select("id_grupo", "id_materia", "pf", "pa"),
        "id_grupo", "id_materia", "pf", "pa"))


# --- snapshots ---

@query
def progress_snapshots(spark, folder):
    return rounded(progress(spark, folder))


@query
def granular_snapshots(spark, folder):
    return rounded(granular(spark, folder))


@query
def granular_long(spark, folder):
    """Totals so far with one category per part, as rows."""
    def job(rows):
        return snapshots.category_snapshots(
            rows.withColumn("categoria_materia", F.col("id_materia").cast("string")))

    return rounded(studies.by_text_key(views.history(spark, folder), job))


@query
def snapshot_categories(spark, folder):
    """Granular snapshots with the category columns looked up in the data."""
    merged = history.attach_category(enriched(spark, folder), views.part_types(spark, folder))
    states = snapshots.granular_snapshots(merged, keep_key=False)
    return rounded(states.groupBy("semestre_actual").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in states.columns if c.startswith("materias_reprobadas_")]))


# --- statistics ---

@query
def student_profiles(spark, folder):
    return rounded(profiles(spark, folder))


@query
def attendance_trend(spark, folder):
    return rounded(inference.linear_trend(
        profiles(spark, folder), "id_carrera", "promedio_asistencia", "promedio_calificacion"))


@query
def trend_bootstrap(spark, folder):
    return rounded(inference.trend_band(
        profiles(spark, folder), "id_carrera", HASH,
        "promedio_asistencia", "promedio_calificacion"))


@query
def correlation_matrix(spark, folder):
    return rounded(correlation.correlation_matrix(progress(spark, folder)))


@query
def correlation_matrix_rows(spark, folder):
    """All numeric columns of the history, many of them with nulls: pairwise-complete."""
    return rounded(correlation.correlation_matrix(labelled(spark, folder)))


@query
def correlation_matrix_wide(spark, folder):
    long = correlation.correlation_matrix(progress(spark, folder), [GRADE, ATTENDANCE, OUTCOME])
    return rounded(correlation.matrix_wide(long, [GRADE, ATTENDANCE, OUTCOME]))


@query
def target_correlation(spark, folder):
    return rounded(correlation.target_correlation(progress(spark, folder)))


@query
def category_predictive_power(spark, folder):
    return rounded(correlation.category_predictive_power(granular(spark, folder)))


@query
def anova_grade_by_outcome(spark, folder):
    return rounded(inference.anova_statistic(progress(spark, folder), GRADE, OUTCOME), ("f_stat",))


@query
def anova_attendance_by_outcome(spark, folder):
    return rounded(
        inference.anova_statistic(progress(spark, folder), ATTENDANCE, OUTCOME), ("f_stat",))


@query
def anova_grade_by_semester(spark, folder):
    return rounded(inference.anova_statistic(labelled(spark, folder), "pf", "semestre"), ("f_stat",))


@query
def chi_square_attendance(spark, folder):
    return rounded(inference.chi_square_statistic(progress(spark, folder), BAND, OUTCOME))


@query
def chi_square_two_by_two(spark, folder):
    """Two levels on both sides, so the Yates correction applies."""
    return rounded(inference.chi_square_statistic(
        labelled(spark, folder), "es_periodo_regular", OUTCOME))


@query
def chi_square_p_value(spark, folder):
    test = inference.chi_square(labelled(spark, folder), "id_carrera", OUTCOME)
    return rounded(test.select("chi2", "dof", "p_value", "significant"))


@query
def anova_p_value(spark, folder):
    """Five majors, so four degrees of freedom between groups: the tail has a closed form."""
    test = inference.anova(labelled(spark, folder), "pf", "id_carrera")
    return rounded(test.select("f_stat", "p_value", "significant"), ("f_stat",))


@query
def test_p_values(spark, folder):
    states = progress(spark, folder)
    tests = [
        ("anova_grade", inference.anova(states, GRADE, OUTCOME), "f_stat"),
        ("anova_attendance", inference.anova(states, ATTENDANCE, OUTCOME), "f_stat"),
        ("chi_square_attendance", inference.chi_square(states, BAND, OUTCOME), "chi2"),
    ]
    out = None
    for name, test, statistic in tests:
        row = test.select(F.lit(name).alias("test"), F.col(statistic).alias("statistic"),
                          "p_value", "significant")
        out = row if out is None else out.unionByName(row)
    return out


@query
def retention_rate_by_band(spark, folder):
    return rounded(counting.rate_table(progress(spark, folder), BAND, OUTCOME))


@query
def crosstab_wide(spark, folder):
    wide = counting.contingency_wide(progress(spark, folder), BAND, OUTCOME, [0, 1])
    return wide.withColumnsRenamed({"0": "dropout", "1": "graduated"})


@query
def expected_counts(spark, folder):
    return rounded(inference.expected_counts(labelled(spark, folder), "periodo", "semestre"))


# --- distributions ---

@query
def grade_histogram(spark, folder):
    return rounded(distribution.histogram(enriched(spark, folder), "pf", "id_carrera"))


@query
def grade_kde(spark, folder):
    return rounded(distribution.grade_kde(enriched(spark, folder)))


@query
def kde_by_outcome(spark, folder):
    return rounded(distribution.survival_kde(granular(spark, folder), "promedio_pf_economy"))


@query
def box_by_outcome(spark, folder):
    return rounded(distribution.box_summary(progress(spark, folder), GRADE, [OUTCOME]))


@query
def backlog_long(spark, folder):
    melted = distribution.melt_backlog(granular(spark, folder), BACKLOG)
    return rounded(melted.groupBy("resultado_final", "categoria_rezago", "cantidad").agg(
        F.count("*").alias("n")))


@query
def backlog_box(spark, folder):
    return rounded(distribution.backlog_box(granular(spark, folder), BACKLOG))


# --- subjects ---

@query
def normalized_text(spark, folder):
    documents = views.document_subjects(spark, folder)
    return documents.select("id_materia", normalize_text("materia").alias("materia_normalizada"))


@query
def subject_classification(spark, folder):
    return taxonomy.subject_dictionary(views.document_subjects(spark, folder))


@query
def part_classification(spark, folder):
    return taxonomy.subject_dictionary(views.part_subjects(spark, folder), rules=PART_RULES)


@query
def subject_category_counts(spark, folder):
    pairs = taxonomy.subject_dictionary(views.document_subjects(spark, folder))
    return counting.value_counts(pairs, "categoria_materia")


@query
def csv_round_trip(spark, folder):
    """Dictionary written as CSV to the shared folder and read back."""
    path = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    tables.write_csv(
        taxonomy.subject_dictionary(views.part_subjects(spark, folder), rules=PART_RULES), path)
    return tables.read_subject_categories(spark, path)


@query
def csv_subjects(spark, folder):
    """Titles written as CSV, read back as the subject list and classified."""
    path = f"{shared_folder(spark)}/subjects-{uuid.uuid4().hex}"
    tables.write_csv(views.document_subjects(spark, folder), path)
    return taxonomy.subject_dictionary(tables.read_subjects(spark, path))


@query
def csv_reordered(spark, folder):
    """Columns are found by name: another order and a further column change nothing."""
    path = f"{shared_folder(spark)}/reordered-{uuid.uuid4().hex}"
    tables.write_csv(views.part_subjects(spark, folder).select(
        "materia", F.lit(1).alias("carrera"), "id_materia"), path)
    return tables.read_subjects(spark, path)


@query
def csv_white_space(spark, folder):
    """Blanks at the ends of a cell survive the way through a file."""
    path = f"{shared_folder(spark)}/blanks-{uuid.uuid4().hex}"
    tables.write_csv(views.part_subjects(spark, folder).withColumn(
        "materia", F.concat(F.lit("  "), "materia", F.lit(" "))), path)
    return tables.read_subjects(spark, path)


# --- sampling and profile ---

@query
def deterministic_sample(spark, folder):
    rows = cut(labelled(spark, folder).select(
        "id_grupo", "id_materia", "semestre", "pf", OUTCOME))
    return rounded(sampling.sample_exact(rows, 2000, ["id_grupo", "id_materia", "semestre", "pf"]))


@query
def profile_overview(spark, folder):
    return profile.overview(labelled(spark, folder))


@query
def profile_numeric(spark, folder):
    return rounded(
        profile.numeric_summary(labelled(spark, folder)),
        ("sum", "mean", "sd", "variance", "cv"))


@query
def profile_categorical(spark, folder):
    return rounded(profile.text_summary(labelled(spark, folder)))


@query
def profile_top_values(spark, folder):
    return profile.top_text_values(labelled(spark, folder))


@query
def profile_distinct_estimates(spark, folder):
    """Distinct values of every column, from sketches per semester added up, beside the exact number."""
    rows = cut(enriched(spark, folder))
    estimates = profile.distinct_estimates(profile.distinct_sketches(rows, "semestre"))
    exact = rows.unpivot([], [F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns if c != "semestre"],
                         "column", "value").groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy(
        "column").agg(F.count("value").alias("exact"))
    return estimates.join(exact, "column").select(
        "column", "n_rows", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within"))


@query
def profile_extremes(spark, folder):
    return rounded(profile.extremes(labelled(spark, folder)))


@query
def profile_histograms(spark, folder):
    rows = labelled(spark, folder)
    return distribution.column_histograms(rows, numeric_columns(rows)).select("column", "bin", "n")


@query
def profile_missing(spark, folder):
    return rounded(profile.missingness(labelled(spark, folder)))


@query
def profile_co_missing(spark, folder):
    return rounded(profile.co_missing(labelled(spark, folder)))


@query
def profile_head(spark, folder):
    """First rows in the order of all columns."""
    rows = labelled(spark, folder)
    return rounded(sampling.preview(rows, *[F.col(f"`{c}`") for c in rows.columns]))


@query
def profile_duplicates(spark, folder):
    rows = enriched(spark, folder).select("id_carrera", "semestre", "id_materia", "pf")
    return rounded(profile.duplicates(rows))


@query
def profile_duplicate_rows(spark, folder):
    """Whole rows of the history, every seventh subject's grades given twice."""
    grades = views.grades(spark, folder)
    again = grades.unionByName(grades.filter("id_materia % 7 = 0"))
    rows = history.sanitize(history.grade_history(again, views.groups(spark, folder)))
    return rounded(profile.duplicates(rows))


# --- composite jobs ---

def figures(report: str, df: DataFrame, item, value) -> DataFrame:
    """One table of a study as rows (report, item, value)."""
    return rounded(df.select(
        F.lit(report).alias("report"), item.cast("string").alias("item"),
        value.cast("double").alias("value")))


def together(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


@query
def history_shape(spark, folder):
    rows, columns = sampling.shape(history.sanitize(views.history(spark, folder)))
    return spark.createDataFrame([(rows, columns)], "n_rows long, n_columns long")


@query
def profile_study(spark, folder):
    """The profile of the whole history, written table by table and read back."""
    path = f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}"
    studies.profile_study(views.history(spark, folder), path)
    written = {name: tables.read_parquet(spark, f"{path}/{name}")
               for name in ("overview", "numeric", "text", "missing", "histograms", "top_values",
                            "extremes", "correlations", "co_missing", "duplicates", "head")}
    return together(
        *[figures("overview", written["overview"], F.lit(c), F.col(c))
          for c in ("n_rows", "n_columns", "n_missing_cells", "n_duplicate_rows")],
        figures("distinct", written["numeric"], F.col("column"), F.col("n_distinct")),
        figures("distinct", written["text"], F.col("column"), F.col("n_distinct")),
        figures("missing", written["missing"], F.col("column"), F.col("n_missing")),
        figures("histograms", written["histograms"],
                F.concat_ws("/", "column", F.col("bin").cast("string")), F.col("n")),
        figures("top", written["top_values"], F.concat_ws("/", "column", "value"), F.col("n")),
        figures("extremes", written["extremes"],
                F.concat_ws("/", "column", "side", F.col("rank").cast("string")), F.col("n")),
        figures("correlations", written["correlations"].filter("variable_1 <> 'id_carrera' and variable_2 <> 'id_carrera'"),
                F.concat_ws("/", "variable_1", "variable_2"), F.col("correlation")),
        figures("co_missing", written["co_missing"], F.concat_ws("/", "column_1", "column_2"), F.col("n_both")),
        figures("duplicates", written["duplicates"].agg(F.count("*").alias("n")), F.lit("rows"), F.col("n")),
        figures("head", written["head"], F.concat_ws("/", "id_grupo", "id_materia"), F.col("pf")))


@query
def snapshot_study(spark, folder):
    study = studies.snapshot_study(views.history(spark, folder))
    return together(
        figures("label_counts", study["label_counts"], F.col(OUTCOME), F.col("n")),
        figures("trend", study["trend"], F.col("id_carrera"), F.col("slope")),
        figures("correlation", study["target_correlation"], F.col("variable"), F.col("correlation")),
        figures("chi_square", study["chi_square_attendance"], F.lit("chi2"), F.col("chi2")),
        figures("retention", study["retention_rate"],
                F.concat_ws("/", BAND, F.col(OUTCOME).cast("string")), F.col("percent")),
        figures("histogram", study["grade_histogram"], F.concat_ws("/", "id_carrera", "bin"), F.col("n")),
        figures("kde", study["grade_kde"], F.concat_ws("/", "id_carrera", "point"), F.col("density")),
        figures("band_low", study["trend_band"], F.concat_ws("/", "id_carrera", "point"), F.col("low")),
        figures("band_high", study["trend_band"], F.concat_ws("/", "id_carrera", "point"), F.col("high")),
        figures("matrix", study["correlation_matrix"], F.concat_ws("/", "variable_1", "variable_2"),
                F.col("correlation")),
        *[figures(f"anova_{name}", study[f"anova_{name}"], F.lit("log F"), F.log10("f_stat"))
          for name in ("grade", "attendance")],
        *[figures("box_grade", study["box_grade"], F.concat_ws("/", F.col(OUTCOME).cast("string"), F.lit(c)), F.col(c))
          for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "n", "n_outliers")])


@query
def category_study(spark, folder):
    study = studies.category_study(
        views.history(spark, folder), views.part_types(spark, folder),
        "promedio_pf_economy", BACKLOG, PART_TYPES)
    failed = study["snapshots"].agg(*[
        F.sum(c).alias(c) for c in study["snapshots"].columns if c.startswith("materias_reprobadas_")])
    return together(
        figures("power", study["predictive_power"], F.col("variable"), F.col("correlation")),
        figures("kde", study["kde"], F.concat_ws("/", OUTCOME, "point"), F.col("density")),
        *[figures("box", study["backlog_box"], F.concat_ws("/", "categoria_rezago", F.col(OUTCOME).cast("string"), F.lit(c)),
                  F.col(c)) for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "n")],
        *[figures("failed", failed, F.lit(c), F.col(c)) for c in failed.columns])


@query
def dictionary_job(spark, folder):
    """Subjects per category as the job counts them, and as its file holds them."""
    path = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    job = studies.dictionary_job(views.document_subjects(spark, folder), path)
    written = counting.value_counts(
        tables.read_subject_categories(spark, path), "categoria_materia")
    return together(
        figures("counted", job["counts"], F.col("categoria_materia"), F.col("n")),
        figures("written", written, F.col("categoria_materia"), F.col("n")))
