"""The composite jobs: profile, snapshot study, category study, subject dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import academic
from cohortline.functions.names import numeric_columns
from cohortline.operators import (
    correlation, counting, distribution, history, inference, profile, sampling, snapshots, taxonomy,
)
from cohortline.operators.bounded import cut, in_passes, release, written
from cohortline.sources.tables import write_csv, write_tables


def enriched_history(raw: DataFrame) -> DataFrame:
    return raw.transform(history.sanitize).transform(history.enrich)


def labelled_history(raw: DataFrame, label: str = "resultado_final") -> DataFrame:
    """Cleaned and enriched rows with the label last; labels join on the short text key, and the
    key is hashed once, after the join."""
    rows = raw.transform(history.sanitize).withColumn(
        "_entity", academic.entity_text("matricula", "id_carrera"))
    done = rows.transform(history.label_rows, entity="_entity", label=label).drop("_entity")
    return done.transform(history.enrich).select("*", F.col(label).alias("_label")).drop(
        label).withColumnRenamed("_label", label)


def by_text_key(raw: DataFrame, job, key: str = "alumno_carrera_hash") -> DataFrame:
    """Run a job that groups by the entity on the short text key, then hash the key it returns.

    Rows shuffle a key of some ten bytes instead of 64, and only result rows are hashed.
    """
    rows = enriched_history(raw).withColumn(key, academic.entity_text("matricula", "id_carrera"))
    return job(rows).withColumn(key, F.sha2(key, 256))


def progress(raw: DataFrame) -> DataFrame:
    """Progress snapshots from raw grade rows."""
    return by_text_key(raw, snapshots.progress_snapshots)


def granular(raw: DataFrame, dictionary: DataFrame | None,
             categories: list[str] | None = None) -> DataFrame:
    """Granular snapshots from raw grade rows and a subject dictionary."""
    def job(rows):
        merged = history.attach_category(rows, dictionary)
        return snapshots.granular_snapshots(merged, categories)

    return by_text_key(raw, job)


def profiles(raw: DataFrame) -> DataFrame:
    """Student profiles from raw grade rows."""
    return by_text_key(raw, inference.student_profiles)


def profile_tables(df: DataFrame) -> dict[str, DataFrame]:
    """All profile tables of one frame.  Pass a checkpointed or stored frame: each scans it, and none
    keeps rows of its own.  The shuffles of a table go before the next one begins."""
    steps = {
        "overview": lambda: profile.overview(df, stored=True),
        "numeric": lambda: profile.numeric_summary(df, stored=True),
        "text": lambda: profile.text_summary(df),
        "top_values": lambda: profile.top_text_values(df, stored=True),
        "extremes": lambda: profile.extremes(df),
        "histograms": lambda: distribution.column_histograms(df, numeric_columns(df), stored=True),
        "correlations": lambda: correlation.correlation_matrix(df, numeric_columns(df)),
        "missing": lambda: profile.missingness(df),
        "co_missing": lambda: profile.co_missing(df),
        "duplicates": lambda: profile.duplicates(df, stored=True),
        "head": lambda: sampling.preview(df, *[F.col(f"`{c}`") for c in df.columns]),
    }
    tables = {}
    for name, step in steps.items():
        tables[name] = step()
        release(df.sparkSession)
    return tables


def profile_study(raw: DataFrame, folder: str,
                  sample_size: int | None = None) -> dict[str, DataFrame]:
    """Clean, enrich, label, profile the whole table, or a sample where a size is given."""
    labelled = in_passes(raw, academic.entity_text("matricula", "id_carrera"), labelled_history)
    if sample_size is not None:
        labelled = written(sampling.sample_exact(
            labelled, sample_size, ["alumno_carrera_hash", "id_grupo", "id_materia"]))
    tables = profile_tables(labelled)
    write_tables(tables, folder)
    return tables


def snapshot_study(raw: DataFrame) -> dict[str, DataFrame]:
    """Descriptive and inferential tables over grade rows and cumulative snapshots."""
    raw = cut(raw)  # the source is read once, whatever number of tables follows
    enriched = enriched_history(raw)
    states = cut(progress(raw))
    students = cut(profiles(raw))
    return {
        "label_counts": counting.value_counts(labelled_history(raw), "resultado_final"),
        "grade_histogram": distribution.histogram(enriched, "pf", "id_carrera"),
        "grade_kde": distribution.grade_kde(enriched),
        "student_profiles": students,
        "trend": inference.linear_trend(
            students, "id_carrera", "promedio_asistencia", "promedio_calificacion"),
        "trend_band": inference.trend_band(
            students, "id_carrera", "alumno_carrera_hash",
            "promedio_asistencia", "promedio_calificacion"),
        "snapshots": states,
        "correlation_matrix": correlation.correlation_matrix(states),
        "target_correlation": correlation.target_correlation(states),
        "anova_grade": inference.anova(states, "promedio_calificacion_final", "resultado_final"),
        "anova_attendance": inference.anova(
            states, "promedio_asistencia_final", "resultado_final"),
        "box_grade": distribution.box_summary(
            states, "promedio_calificacion_final", ["resultado_final"]),
        "box_attendance": distribution.box_summary(
            states, "promedio_asistencia_final", ["resultado_final"]),
        "chi_square_attendance": inference.chi_square(
            states, "categoria_asistencia", "resultado_final"),
        "retention_rate": counting.rate_table(states, "categoria_asistencia", "resultado_final"),
    }


def category_study(raw: DataFrame, dictionary: DataFrame | None, critical: str,
                   backlog: list[str], categories: list[str] | None = None) -> dict[str, DataFrame]:
    """Per-category snapshots with their predictive power, one density pair and backlog boxes."""
    states = cut(granular(raw, dictionary, categories))
    return {
        "snapshots": states,
        "predictive_power": correlation.category_predictive_power(states),
        "kde": distribution.survival_kde(states, critical),
        "backlog_box": distribution.backlog_box(states, backlog),
    }


def dictionary_job(subjects: DataFrame, path: str) -> dict[str, DataFrame]:
    """Classify the subjects, write the dictionary as CSV, count subjects per category."""
    pairs = cut(taxonomy.subject_dictionary(subjects))
    write_csv(pairs, path)
    return {"dictionary": pairs, "counts": counting.value_counts(pairs, "categoria_materia")}
