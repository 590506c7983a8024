"""Cell tables: stored as Parquet, and shaped from ordinary tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wideframe.plans.layout import Layout
from wideframe.plans.request import DataRequest


def cells(rows: DataFrame, key: Column | str, family: Column | str, qualifier: Column | str, version: Column | str, value: Column | str, **components: Column | str) -> DataFrame:
    """Cells shaped from a table, with any key components as further columns."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    named = {"key": key, **components, "family": family, "qualifier": qualifier, "version": version, "value": value}
    return rows.select(*[as_column(c).alias(n) for n, c in named.items()])


def unpivot(rows: DataFrame, key: str, family: str, columns: list[str], version: Column | str, kind: str = "string") -> DataFrame:
    """Cells of a group family: one for each non-null column of each row."""
    at = F.col(version) if isinstance(version, str) else version
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("qualifier"), F.col(c).cast(kind).alias("value")) for c in columns])).alias("c")
    out = rows.select(F.col(key).alias("key"), F.lit(family).alias("family"), at.alias("version"), each)
    return out.select("key", "family", "c.qualifier", "version", "c.value").where("value is not null")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without zone is taken as UTC, whatever the session's zone."""
    instant = F.unix_micros(F.col(column).cast("timestamp"))
    return F.when(F.typeof(F.col(column)) == "timestamp", instant).otherwise(_civil_micros(column))


def _civil_micros(column: str) -> Column:
    days = F.datediff(F.to_date(column), F.lit("1970-01-01")).cast("bigint")
    seconds = (F.hour(column) * 3600 + F.minute(column) * 60).cast("bigint")
    return days * 86_400_000_000 + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")


def in_time(rows: DataFrame, column: str, request: DataRequest) -> DataFrame:
    """Rows whose timestamp (without zone, taken as UTC) lies in a request's time range in microseconds.

    The test is on the source's own column, so it reaches the scan.
    """
    epoch = datetime.datetime(1970, 1, 1)
    out = rows
    for bound, test in ((request.min_version, lambda c, t: c >= t), (request.max_version, lambda c, t: c < t)):
        if 0 < bound < 2**63 - 1:
            at = epoch + datetime.timedelta(microseconds=bound)
            out = out.where(test(F.col(column), F.lit(at.isoformat(" ")).cast("timestamp_ntz")))
    return out


def write(table: DataFrame, path: str, layout: Layout | None = None, regions: int | None = None, mode: str = "overwrite") -> None:
    """Stores cells, one folder for each locality group, sorted by key within range partitions.

    A read of some families lists only their groups' folders, and key ranges skip
    row groups by their statistics.
    """
    if layout is not None:
        group = F.lit(None).cast("string")
        for g in layout.groups.values():
            group = F.when(F.col("family").isin(sorted(g.families)), g.name).otherwise(group)
        table = table.withColumn("locality_group", group)
    by = ["locality_group", "key"] if layout is not None else ["key"]
    spread = table.repartitionByRange(regions, *by) if regions else table.repartitionByRange(*by)
    writer = spread.sortWithinPartitions(*by, "family", "qualifier", F.desc("version")).write.mode(mode)
    (writer.partitionBy("locality_group") if layout is not None else writer).parquet(path)


def load(spark: SparkSession, path: str, groups: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """Stored cells, of some locality groups only if asked; a table without any cell needs its schema."""
    out = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    if "locality_group" not in out.columns:
        return out
    return (out if groups is None else out.where(F.col("locality_group").isin(groups))).drop("locality_group")


def regions(table: DataFrame) -> DataFrame:
    """First key, last key and cells of each partition."""
    return table.groupBy(F.spark_partition_id().alias("region")).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n_cells"))
