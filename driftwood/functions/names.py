"""Column-name and projection helpers (prefix selection, tolerant
projection, required-column checks, float32 casting, clean names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

PREFIXES = ("cat__", "num__", "pass__")


def select_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns whose name starts with ``prefix``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.startswith(prefix)])


def map_prefix(m: Column, prefix: str) -> Column:
    """Entries of a map column whose key starts with ``prefix``."""
    return F.map_filter(m, lambda k, v: k.startswith(prefix))


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Schema-tolerant projection: wanted columns that exist, in order."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in have])


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> None:
    """Analysis-time check (no job): raise when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def to_float32(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Model-boundary cast: numbers and booleans to float; text parsed as a
    number, null when it is not one."""
    keep = set(exclude or [])
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in keep:
            out.append(c)
        elif isinstance(f.dataType, (NumericType, BooleanType)):
            out.append(c.cast("float").alias(f.name))
        elif isinstance(f.dataType, StringType):
            out.append(F.expr(f"try_cast(`{f.name}` AS FLOAT)").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def clean_name(name: str) -> str:
    """Strip a transformer prefix: ``num__Age`` -> ``Age``."""
    return name.split("__", 1)[-1]


def clean_name_col(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^_]*?__", "")


def strip_prefixes(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: clean_name(c) for c in df.columns if "__" in c})
