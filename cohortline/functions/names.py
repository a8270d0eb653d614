"""Column-name rules; they act on the schema, so they are plain Python on a handful of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


def safe_name(category: str) -> str:
    """Category label as the tail of a column name; accents stay."""
    words = category.lower().split()
    joining = [w for i, w in enumerate(words) if w != "y" or i in (0, len(words) - 1)]
    return "_".join(joining)


def pretty_name(column: str, prefix: str) -> str:
    """Column name as a title: prefix removed, underscores as blanks, title case."""
    return " ".join(part.capitalize() for part in column.removeprefix(prefix).split("_"))


def numeric_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns (booleans and strings are not) without the dropped ones."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in drop]


def present(df: DataFrame, columns) -> list[str]:
    """Those of ``columns`` the frame has, in the given order."""
    return [c for c in columns if c in df.columns]


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
