"""Column expressions for the academic dimensions: key hash, period parts, parity, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.constants import ATTENDANCE_BANDS, PERIODS
from cohortline.functions.text import strip


def entity_text(student: str, program: str) -> Column:
    """``<student, stripped>_<program>``; a missing part reads ``nan``.

    One to one with the hash and a fraction of its size: jobs group by this text and hash the
    few rows that come out.
    """
    nan = F.lit("nan")
    return F.concat(
        F.coalesce(strip(F.col(student).cast("string")), nan),
        F.lit("_"),
        F.coalesce(F.col(program).cast("string"), nan),
    )


def entity_hash(student: str, program: str) -> Column:
    """SHA-256 hex of the entity text."""
    return F.sha2(entity_text(student, program), 256)


def period_name(period: str, calendar=PERIODS) -> Column:
    """Name of a period id; null for an id outside the calendar."""
    pairs = [F.lit(x) for entry in calendar for x in entry]
    return F.try_element_at(F.create_map(*pairs), F.col(period))


def academic_year(name: str) -> Column:
    return F.substring(F.col(name), 1, 9)


def period_type(name: str) -> Column:
    """What follows the academic year in a period name."""
    return F.expr(f"substring(`{name}`, 10)")


def semester_parity(semester: str) -> Column:
    """``Par`` or ``Impar``; a missing semester counts as ``Impar``."""
    return F.when(F.pmod(F.col(semester), F.lit(2)) == 0, "Par").otherwise("Impar")


def is_one_of(column: str, values) -> Column:
    """Membership test that is never null."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def band(value: Column, bands=ATTENDANCE_BANDS) -> Column:
    """Label of the right-closed interval a value lies in; null outside all of them."""
    out = None
    for low, high, label in bands:
        inside = (value > low) & (value <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out
