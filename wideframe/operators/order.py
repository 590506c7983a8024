"""The one order of cells: by version, then by ``seq``, the order of writes.

Cells of a table without ``seq``, or with a null one, count as written first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def written(columns: list[str]) -> Column:
    """Place of a cell among writes of one version."""
    return F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)) if "seq" in columns else F.lit(-1).cast("bigint")


def age(columns: list[str]) -> Column:
    """Larger for newer cells, for ``max_by``."""
    return F.struct(F.col("version"), written(columns).alias("seq")) if "seq" in columns else F.col("version")


def newest_first(columns: list[str]) -> list[Column]:
    """Columns to sort cells by."""
    return [F.desc("version"), *([written(columns).desc()] if "seq" in columns else [])]


def hash60(*parts: Column) -> Column:
    """60-bit hash of values as texts, joined by colons: the first 15 hexadecimal digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")
