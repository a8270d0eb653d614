"""Readers and writers: JDBC, CSV, parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from cohortline.constants import CSV_MISSING, PERIODS
from cohortline.functions.names import require
from cohortline.operators.bounded import release
from cohortline.operators.history import grade_history
from cohortline.schemas import SUBJECT_CATEGORIES, SUBJECTS


def jdbc_reader(spark: SparkSession, options: dict[str, str], table: str,
                partition_column: str | None = None, bounds: tuple[int, int] | None = None,
                partitions: int = 1):
    """Reader of one relational table, split into key ranges read in parallel.

    ``options`` carries url, user, password and driver; nothing of that lives here.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader


def read_grade_history(spark: SparkSession, options: dict[str, str],
                       group_bounds: tuple[int, int] | None = None,
                       partitions: int = 1) -> DataFrame:
    """Grade history of a relational source: both tables read in parallel, joined in Spark."""
    def table(name):
        return jdbc_reader(spark, options, name, "id_grupo", group_bounds, partitions).load()

    return grade_history(table("nes_calificaciones"), table("nes_grupos"))


def read_parquet(spark: SparkSession, path: str,
                 schema: StructType | str | None = None) -> DataFrame:
    """Parquet table."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def _read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool) -> DataFrame:
    """The columns of the schema, found by their names in the header, whatever their order.

    The texts pandas takes as missing are null, as are cells that are no number where one is due.
    A missing name is an error.  Cells with line breaks need ``multi_line``, which makes every file
    one task; without them, pass False.
    """
    df = spark.read.options(
        header=True, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8").csv(path)
    require(df, *schema.names)

    def cell(field):
        text = F.when(~F.col(field.name).isin(*CSV_MISSING), F.col(field.name))
        return text if isinstance(field.dataType, StringType) else text.try_cast(field.dataType)

    return df.select(*[cell(f).alias(f.name) for f in schema.fields])


def read_subjects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Unclassified subjects."""
    return _read_csv(spark, path, SUBJECTS, multi_line)


def read_subject_categories(spark: SparkSession, path: str,
                            multi_line: bool = True) -> DataFrame | None:
    """Classified subjects, or None where the path does not exist."""
    try:
        return _read_csv(spark, path, SUBJECT_CATEGORIES, multi_line)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(df: DataFrame, path: str) -> None:
    """CSV directory with header, UTF-8, cells as they are, replacing what is there."""
    df.write.mode("overwrite").options(
        header=True, quote='"', escape='"', encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as parquet in its own subfolder; the shuffles of one go before the next is written."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
        release(df.sparkSession)


def period_dimension(spark: SparkSession, calendar=PERIODS) -> DataFrame:
    """The period calendar as a table: id, name, position."""
    return spark.createDataFrame(
        [(pid, name, i) for i, (pid, name) in enumerate(calendar)],
        "periodo int, nombre_periodo string, orden int")
