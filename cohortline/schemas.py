"""Explicit schemas of the source tables and files."""

from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from cohortline.constants import METRICS

GRADES = StructType(
    [StructField("matricula", StringType()),
     StructField("id_grupo", LongType()),
     StructField("id_materia", LongType())]
    + [StructField(m, DoubleType()) for m in METRICS]
)

GROUPS = StructType([
    StructField("id_grupo", LongType()),
    StructField("id_carrera", IntegerType()),
    StructField("semestre", IntegerType()),
    StructField("id_periodo", IntegerType()),
])

SUBJECTS = StructType([
    StructField("id_materia", LongType()),
    StructField("materia", StringType()),
])

SUBJECT_CATEGORIES = StructType([
    StructField("id_materia", LongType()),
    StructField("categoria_materia", StringType()),
])
