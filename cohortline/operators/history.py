"""From raw grade rows to labelled grade rows: join, clean, enrich, label, categorise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, NumericType

from cohortline.constants import FINAL_SEMESTER, METRICS, OTHER_CATEGORY, SENTINEL
from cohortline.functions import academic
from cohortline.functions.names import present


def grade_history(grades: DataFrame, groups: DataFrame) -> DataFrame:
    """Grades inner-joined with their group, as the 19 history columns.

    No join hint: Catalyst broadcasts the groups if their size allows it, otherwise both sides
    shuffle on ``id_grupo`` and AQE splits a group that holds very many grades.
    """
    return grades.join(groups, "id_grupo").select(
        "matricula", "id_carrera", "id_grupo", "id_materia", "semestre",
        F.col("id_periodo").alias("periodo"), *METRICS,
    )


def sanitize(history: DataFrame, metrics=METRICS, key: str = "matricula") -> DataFrame:
    """Sentinel and NaN to null in the numeric metrics that exist; rows without a key dropped."""
    kinds = {f.name: f.dataType for f in history.schema.fields if isinstance(f.dataType, NumericType)}

    def known(metric):
        missing = [SENTINEL]
        if isinstance(kinds[metric], FractionalType) and not isinstance(kinds[metric], DecimalType):
            missing.append(float("nan"))
        return F.when(~F.col(metric).isin(*missing), F.col(metric))

    cleaned = {m: known(m) for m in present(history, metrics) if m in kinds}
    return history.withColumns(cleaned).filter(F.col(key).isNotNull())


def enrich(history: DataFrame) -> DataFrame:
    """Period name and parts, semester parity, regular-period flag and the student key."""
    return (
        history
        .withColumn("nombre_periodo", academic.period_name("periodo"))
        .withColumns({
            "año_academico": academic.academic_year("nombre_periodo"),
            "tipo_periodo": academic.period_type("nombre_periodo"),
            "tipo_semestre": academic.semester_parity("semestre"),
        })
        .withColumns({
            "es_periodo_regular": academic.is_one_of("tipo_periodo", ["A", "B"]),
            "alumno_carrera_hash": academic.entity_hash("matricula", "id_carrera"),
        })
    )


def reached(order: str, threshold: int):
    """1 where the largest ``order`` of a group reaches the threshold, else 0 (also if all null)."""
    return F.coalesce(F.max(order) >= threshold, F.lit(False)).cast("int")


def entity_labels(history: DataFrame, entity: str = "alumno_carrera_hash",
                  order: str = "semestre", threshold: int = FINAL_SEMESTER,
                  label: str = "resultado_final") -> DataFrame:
    """One row per entity: its label and how many rows it has."""
    return history.groupBy(entity).agg(
        reached(order, threshold).alias(label), F.count("*").alias("n_rows"))


def label_rows(history: DataFrame, entity: str = "alumno_carrera_hash",
               order: str = "semestre", threshold: int = FINAL_SEMESTER,
               label: str = "resultado_final") -> DataFrame:
    """Every row with its entity's label; 0 where the entity is null.

    The label comes from a map-side combined aggregate joined back, not from a window over the
    entity: one entity may own a large share of all rows.  The join carries no hint: the labels are
    broadcast if they are small when it runs, else AQE splits the partitions of heavy entities.
    """
    labels = history.groupBy(F.col(entity).alias("_labelled")).agg(
        reached(order, threshold).alias(label))
    rows = history.join(labels, F.col(entity) == F.col("_labelled"), "left").drop("_labelled")
    return rows.withColumn(label, F.coalesce(label, F.lit(0)))


def attach_category(history: DataFrame, categories: DataFrame | None,
                    key: str = "id_materia", category: str = "categoria_materia",
                    default: str = OTHER_CATEGORY) -> DataFrame:
    """Left join with the subject dictionary; unmatched rows get the default category.

    A null key matches a null key, and a key with several categories multiplies its rows.
    Without a dictionary every row gets the default.
    """
    if categories is None:
        return history.withColumn(category, F.lit(default))
    right = categories.select(F.col(key).alias("_dictionary_key"), F.col(category))
    return (
        history.join(right, F.col(key).eqNullSafe(F.col("_dictionary_key")), "left")
        .drop("_dictionary_key")
        .withColumn(category, F.coalesce(F.col(category), F.lit(default)))
    )
