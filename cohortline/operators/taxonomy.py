"""Subject dictionary: normalise titles, classify them, keep each pair once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortline.constants import OTHER_CATEGORY, TAXONOMY
from cohortline.functions.text import classify, normalize_text


def classify_subjects(subjects: DataFrame, title: str = "materia", rules=TAXONOMY,
                      default: str = OTHER_CATEGORY) -> DataFrame:
    """Subjects with ``materia_normalizada`` and ``categoria_materia``."""
    return (
        subjects
        .withColumn("materia_normalizada", normalize_text(title))
        .withColumn("categoria_materia", classify("materia_normalizada", rules, default))
    )


def subject_dictionary(subjects: DataFrame, key: str = "id_materia", title: str = "materia",
                       rules=TAXONOMY, default: str = OTHER_CATEGORY) -> DataFrame:
    """Distinct (key, category) pairs; a key with two titles may keep two categories."""
    return (
        classify_subjects(subjects, title, rules, default)
        .select(key, "categoria_materia")
        .dropDuplicates()
    )
