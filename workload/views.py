"""The grade history played by the given tables: lineitem as grades, orders as groups.

The expressions are plain SQL text that Spark and the oracle read alike, so both start from the
same rows; everything after that is computed independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortline.constants import METRICS, PERIODS
from cohortline.operators.history import grade_history
from cohortline.sources.tables import read_parquet

METRIC_SQL = {
    "p1": "case when l_tax = 0.01 then -10 else l_quantity / 5 end",
    "p2": "case when l_tax = 0.02 then -10 else (51 - l_quantity) / 5 end",
    "p3": "case when l_linenumber = 2 then -10 else l_quantity / 10 + 5 end",
    "o": "case when l_linestatus = 'O' then l_quantity / 8 else -10 end",
    "pf": "case when l_returnflag = 'R' and l_linenumber = 1 then -10 else l_quantity / 5 end",
    "e1": "case when l_returnflag = 'A' then l_quantity / 5 else -10 end",
    "e2": "case when l_returnflag = 'A' and l_linenumber > 3 then l_discount * 100 else -10 end",
    "esp": "case when l_returnflag = 'N' and l_linenumber > 5 then l_tax * 100 else -10 end",
    "a1": "(1 - l_discount) * 100",
    "a2": "(1 - 2 * l_discount) * 100",
    "a3": "case when l_linenumber = 3 then -10 else (1 - l_tax) * 100 end",
    "oa": "case when l_linestatus = 'O' then (1 - 2 * l_tax) * 100 else -10 end",
    "pa": "case when l_tax = 0 then -10 else (1 - 3 * l_discount) * 100 end",
}

GRADES_SQL = [
    "l_orderkey as id_grupo",
    "l_partkey as id_materia",
    *[f"cast({METRIC_SQL[m]} as double) as {m}" for m in METRICS],
]

SEMESTER_SQL = ("(year(o_orderdate) - 1995) * 2 "
                "+ case when month(o_orderdate) > 6 then 1 else 0 end + 1")
PERIOD_INDEX_SQL = ("(year(o_orderdate) - 1995) * 3 + case when month(o_orderdate) <= 5 then 0 "
                    "when month(o_orderdate) <= 9 then 1 else 2 end")
PERIOD_IDS = ", ".join(str(pid) for pid, _ in PERIODS)

GROUPS_SQL = [
    "o_orderkey as id_grupo",
    "concat('C', cast(o_custkey as string)) as matricula",
    "cast(substr(o_orderpriority, 1, 1) as int) as id_carrera",
    f"cast({SEMESTER_SQL} as int) as semestre",
]
PERIOD_SQL = f"get(array({PERIOD_IDS}), cast({PERIOD_INDEX_SQL} as int)) as id_periodo"


SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def grades(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*GRADES_SQL)


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*GROUPS_SQL, PERIOD_SQL)


def history(spark: SparkSession, folder: str) -> DataFrame:
    return grade_history(grades(spark, folder), groups(spark, folder))


def part_types(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary by part type."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey as id_materia", "p_type as categoria_materia")


def part_types_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary without every seventh part: the merge has to meet unmatched subjects."""
    return part_types(spark, folder).filter("id_materia % 7 <> 0")


def part_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr("p_partkey as id_materia", "p_name as materia")


def document_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr("doc_id as id_materia", "text as materia")
