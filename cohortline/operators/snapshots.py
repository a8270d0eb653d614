"""Cumulative progress snapshots: one row per entity and semester, over all semesters so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.constants import FINAL_SEMESTER, PASSING_GRADE
from cohortline.functions.academic import band
from cohortline.functions.names import require, safe_name

#: Categories that one frame can have columns for.
MOST_COLUMNS = 1_000


def category_list(history: DataFrame, column: str = "categoria_materia") -> list[str]:
    """Distinct categories, sorted, to make columns of.

    More than ``MOST_COLUMNS`` are an error: ``category_snapshots`` keeps any number of them as rows.
    """
    found = history.select(column).distinct().filter(F.col(column).isNotNull()).limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} categories do not make columns; use category_snapshots")
    return sorted(r[0] for r in found)


def category_snapshots(history: DataFrame, entity: str = "alumno_carrera_hash",
                       order: str = "semestre",
                       category: str = "categoria_materia") -> DataFrame:
    """Long form: one row per entity, semester and category taken in it, totals so far.

    Any number of categories: they stay rows.  A missing grade counts as 0; rows without a
    semester enter no total.
    """
    require(history, entity, order, category, "pf")
    grade = F.coalesce(F.col("pf"), F.lit(0.0))
    states = history.filter(F.col(order).isNotNull()).groupBy(entity, order, category).agg(
        F.count("*").alias("n"), F.sum(grade).alias("sum"),
        F.count_if(grade < PASSING_GRADE).alias("failed"))
    so_far = Window.partitionBy(entity, category).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return states.select(
        entity, F.col(order).alias("semestre_actual"), category,
        F.sum("n").over(so_far).alias("materias_cursadas"),
        F.sum("failed").over(so_far).alias("materias_reprobadas"),
        (F.sum("sum").over(so_far) / F.sum("n").over(so_far)).alias("promedio_pf"))


def progress_snapshots(history: DataFrame, entity: str = "alumno_carrera_hash",
                       order: str = "semestre", label: str = "resultado_final",
                       threshold: int = FINAL_SEMESTER, keep_key: bool = True) -> DataFrame:
    """Snapshots over all subjects.  Needs ``pf``, ``pa`` and ``tipo_periodo``."""
    return _snapshots(history, entity, order, label, threshold, keep_key, None)


def granular_snapshots(history: DataFrame, categories: list[str] | None = None,
                       entity: str = "alumno_carrera_hash", order: str = "semestre",
                       label: str = "resultado_final", threshold: int = FINAL_SEMESTER,
                       keep_key: bool = True) -> DataFrame:
    """Snapshots with the mean grade and the failed count of each subject category.

    ``categories`` fixes the columns, and a row of any other category is an error; without it they
    are looked up in the data (one more pass).
    """
    require(history, "categoria_materia")
    if categories is None:
        categories = category_list(history)
    names = [safe_name(c) for c in categories]
    if len(set(names)) < len(names):
        raise ValueError("two categories share one column name")
    return _snapshots(history, entity, order, label, threshold, keep_key,
                      dict(zip(names, categories)))


def _snapshots(history, entity, order, label, threshold, keep_key, categories):
    """Two phases: states per (entity, semester), then running totals over an entity's states.

    The first phase combines on the map side, so an entity with very many rows shrinks to one
    state per semester before it meets a single task.  Grades and attendance missing in the
    history count as 0.
    """
    require(history, entity, order, "pf", "pa", "tipo_periodo")
    failed = F.col("pf") < PASSING_GRADE
    summer = F.coalesce(F.col("tipo_periodo") == "V", F.lit(False))
    has_label = label in history.columns

    filled = history.withColumns({
        "pf": F.coalesce(F.col("pf"), F.lit(0.0)),
        "pa": F.coalesce(F.col("pa"), F.lit(0.0)),
    })
    per_state = {
        "n": F.count("*"),
        "sum_pf": F.sum("pf"),
        "sum_pa": F.sum("pa"),
        "sq_pf": F.var_pop("pf") * F.count("*"),
        "n_failed": F.count_if(failed),
        "any_summer": F.max(summer),
        "all_summer": F.min(summer),
        "last": F.max(label) if has_label else F.max(order),
    }
    if categories is not None:
        own = F.col("categoria_materia")
        listed = own.isNull() | own.isin(*categories.values())
        filled = filled.withColumn("categoria_materia", F.when(listed, own).otherwise(
            F.raise_error(F.concat(F.lit("no column for category "), own)).cast("string")))
    for i, category in enumerate((categories or {}).values()):
        member = F.col("categoria_materia") == category
        per_state[f"n_{i}"] = F.count_if(member)
        per_state[f"sum_{i}"] = F.sum(F.when(member, F.col("pf")))
        per_state[f"failed_{i}"] = F.count_if(member & failed)
    states = filled.groupBy(entity, order).agg(*[c.alias(k) for k, c in per_state.items()])

    whole = Window.partitionBy(entity)
    # a null semester sorts last and so enters no other semester's totals
    so_far = whole.orderBy(F.col(order).asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    mean = F.col("sum_pf") / F.col("n")
    states = states.withColumns({
        # distance to the first state's mean: keeps the variance sum free of cancellation
        "shift": mean - F.first(mean).over(so_far),
        "label": (F.max("last").over(whole) if has_label
                  else reached_over("last", threshold, whole)),
    })

    weighted = F.col("n") * F.col("shift")
    totals = {c: F.sum(c).over(so_far) for c in ("n", "sum_pf", "sum_pa", "n_failed")}
    totals["sq_pf"] = F.sum(F.col("sq_pf") + weighted * F.col("shift")).over(so_far)
    totals["offset"] = F.sum(weighted).over(so_far)
    totals["any_summer"] = F.max("any_summer").over(so_far)
    totals["all_summer"] = F.min("all_summer").over(so_far)
    for i in range(len(categories or {})):
        totals.update({c: F.sum(c).over(so_far) for c in (f"n_{i}", f"sum_{i}", f"failed_{i}")})
    running = states.withColumns({f"run_{c}": total for c, total in totals.items()})

    def run(name: str) -> Column:
        return F.col(f"run_{name}")

    known = F.col(order).isNotNull()

    def known_or(value: Column, zero) -> Column:
        """A state without a semester has an empty history: all zero."""
        return F.coalesce(F.when(known, value), F.lit(zero))

    squares = run("sq_pf") - run("offset") * run("offset") / run("n")
    total = "_totales" if categories is not None else ""
    out = {
        "semestre_actual": F.coalesce(F.col(order), F.lit(0)),
        "promedio_calificacion_final": known_or(run("sum_pf") / run("n"), 0.0),
        "promedio_asistencia_final": known_or(run("sum_pa") / run("n"), 0.0),
        f"materias_cursadas{total}": known_or(run("n"), 0).cast("long"),
        f"materias_reprobadas{total}": known_or(run("n_failed"), 0).cast("long"),
        # number of distinct answers to "is it a summer period": 1 or 2
        "periodos_verano_cursados": known_or(
            F.when(run("any_summer") & ~run("all_summer"), 2).otherwise(1), 0).cast("long"),
        "std_calificacion_final": known_or(
            F.sqrt(F.greatest(squares, F.lit(0.0)) / run("n")), 0.0),
        "resultado_final": F.coalesce(F.col("label"), F.lit(0)),
    }
    for i, name in enumerate(categories or {}):
        mean_so_far = F.try_divide(run(f"sum_{i}"), run(f"n_{i}"))
        out[f"promedio_pf_{name}"] = known_or(mean_so_far, 0.0)
        out[f"materias_reprobadas_{name}"] = known_or(run(f"failed_{i}"), 0).cast("long")
    key = [F.col(entity)] if keep_key else []
    out["categoria_asistencia"] = band(out["promedio_asistencia_final"])
    return running.select(*key, *[c.alias(k) for k, c in out.items()])


def reached_over(order: str, threshold: int, window) -> Column:
    return F.coalesce(F.max(order).over(window) >= threshold, F.lit(False)).cast("int")
