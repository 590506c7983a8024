"""Operators on the cells that a request returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideframe.operators.order import newest_first
from wideframe.plans.compiler import newest
from wideframe.plans.request import parse_column


def narrow(cells: DataFrame, column: str) -> DataFrame:
    """Cells of one family or column of a result."""
    family, qualifier = parse_column(column)
    out = cells.where(F.col("family") == family)
    return out if qualifier is None else out.where(F.col("qualifier") == qualifier)


def ordered(cells: DataFrame) -> DataFrame:
    """By key, column ascending, newest first."""
    return cells.orderBy("key", "family", "qualifier", *newest_first(cells.columns))


def count_columns(cells: DataFrame) -> DataFrame:
    """Cells of each column of each row."""
    return cells.groupBy("key", "family", "qualifier").agg(F.count(F.lit(1)).alias("n_cells"))


def latest(cells: DataFrame) -> DataFrame:
    """Newest cell of each column of each row."""
    return newest(cells, 1)


def first_cell(cells: DataFrame) -> DataFrame:
    """First cell of each row, in result order."""
    return newest_by(cells, ["key"], [F.col("family"), F.col("qualifier"), *newest_first(cells.columns)])


def by_components(rows: DataFrame, components: list[str]) -> DataFrame:
    """Rows with ``place``, their place (from 1) by key components, nulls first, in range partitions.

    Places are counted within ranges and carried over their totals, so no task holds all rows.
    """
    order = [F.asc_nulls_first(c) for c in components]
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_inside", inside).join(F.broadcast(totals), "_part").withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def newest_by(cells: DataFrame, by: list[str], order: list) -> DataFrame:
    """First row of each group in an order."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return cells.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def exact_version(cells: DataFrame, version: int) -> DataFrame:
    """Cells of one version."""
    return cells.where(F.col("version") == version)


def contains(cells: DataFrame, column: str, version: int | None = None) -> DataFrame:
    """(key, present) for each row: whether it has a cell of the column, or of one version of it."""
    family, qualifier = parse_column(column)
    here = F.col("family") == family
    if qualifier is not None:
        here = here & (F.col("qualifier") == qualifier)
    if version is not None:
        here = here & (F.col("version") == version)
    return cells.groupBy("key").agg(F.coalesce(F.bool_or(here), F.lit(False)).alias("present"))


def qualifiers(cells: DataFrame) -> DataFrame:
    """Distinct sorted qualifiers of each family of each row."""
    return cells.groupBy("key", "family").agg(F.sort_array(F.collect_set("qualifier")).alias("qualifiers"))


def timestamps(cells: DataFrame) -> DataFrame:
    """Distinct versions of each column of each row, newest first."""
    return cells.groupBy("key", "family", "qualifier").agg(F.sort_array(F.collect_set("version"), asc=False).alias("versions"))


def project(cells: DataFrame, what: str) -> DataFrame:
    """Column names, versions or values of a result, one for each cell (not distinct)."""
    if what not in ("column", "version", "value"):
        raise ValueError(f"unknown projection {what!r}")
    return cells.select("key", F.concat_ws(":", "family", "qualifier").alias("column") if what == "column" else F.col(what))


def materialize(cells: DataFrame) -> DataFrame:
    """One row for each column of each row: its (version, value) list, newest first."""
    return cells.groupBy("key", "family", "qualifier").agg(F.sort_array(F.collect_list(F.struct("version", "value")), asc=False).alias("cells"))


def row_views(cells: DataFrame) -> DataFrame:
    """One row for each key: family -> qualifier -> version -> value."""
    columns = cells.groupBy("key", "family", "qualifier").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("version", "value")), asc=False)).alias("versions"))
    families = columns.groupBy("key", "family").agg(F.map_from_entries(F.collect_list(F.struct("qualifier", "versions"))).alias("columns"))
    return families.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("family", "columns"))).alias("row"))


def group_family(cells: DataFrame, family: str, columns: list[str]) -> DataFrame:
    """One row for each key with the newest value of each declared column."""
    here = latest(cells.where((F.col("family") == family) & F.col("qualifier").isin(columns)))
    made = [F.max(F.when(F.col("qualifier") == c, F.col("value"))).alias(c) for c in columns]
    return here.groupBy("key").agg(*made)
