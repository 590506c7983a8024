"""Compiles data requests to DataFrame plans over a table's cells.

A table is one long DataFrame of cells: ``key``, any key component columns,
``family``, ``qualifier``, ``version``, ``value`` and optionally ``seq`` (write
order).  A request becomes

1. predicates on family, qualifier and version, which reach the Parquet scan,
   and on the key: equality, range, or what row filters ask of the key;
2. the row filter: one aggregation of booleans by key, over the cells of the
   columns that it names, and a left semi join;
3. column filters, then the newest ``max_versions`` cells of each column.  One
   version is a ``max_by`` aggregation, which combines before the shuffle; more are
   a ``row_number`` that Catalyst limits before the shuffle; all versions need no
   shuffle.

Time ranges apply before versions are counted.  Rows come out long: one cell each.
With a layout, families go by their aliases too; with a layout and a clock, only
cells that the table still retains are read.
"""

from __future__ import annotations

import functools
from dataclasses import replace
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideframe.operators.filters import RowFilter, StripRowValues
from wideframe.operators.mutations import retain
from wideframe.operators.order import age, hash60, newest_first
from wideframe.plans.layout import Layout
from wideframe.plans.request import ALL_VERSIONS, Column, DataRequest, RequestError

CELL = ["key", "family", "qualifier", "version", "value"]


def _wanted(column: Column, layout: Layout | None) -> SparkColumn:
    """Predicate for the cells of one requested column."""
    out = F.col("family") == column.family
    if column.qualifier is not None:
        return out & (F.col("qualifier") == column.qualifier)
    family = layout.family(column.family) if layout else None
    return out & F.col("qualifier").isin(sorted(family.columns)) if family and family.columns else out


def in_time(request: DataRequest) -> SparkColumn:
    """Predicate for the request's time range."""
    out = F.lit(True)
    if request.min_version > 0:
        out = out & (F.col("version") >= request.min_version)
    if request.max_version < 2**63 - 1:
        out = out & (F.col("version") < request.max_version)
    return out


def newest(cells: DataFrame, limit: SparkColumn | int, by: list[str] | None = None) -> DataFrame:
    """The newest ``limit`` cells of each column of each key, later writes first among equal versions."""
    by = by or ["key", "family", "qualifier"]
    if isinstance(limit, int) and limit >= ALL_VERSIONS:
        return cells
    if isinstance(limit, int) and limit == 1:
        rest = [c for c in cells.columns if c not in (*by, "version", "seq")]
        if len(rest) == 1 and "seq" not in cells.columns:  # plain values keep the hash aggregation
            return cells.groupBy(*by).agg(F.max("version").alias("version"), F.max_by(rest[0], "version").alias(rest[0])).select(*cells.columns)
        rest += ["seq"] if "seq" in cells.columns else []
        one = cells.groupBy(*by).agg(F.max_by(F.struct(*rest), age(cells.columns)).alias("_r"), F.max("version").alias("version"))
        return one.select(*by, "version", *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*cells.columns)
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first(cells.columns)))
    return cells.withColumn("_turn", turn).where(F.col("_turn") <= limit).drop("_turn")


def select_rows(cells: DataFrame, row_filter: RowFilter | None) -> DataFrame:
    """Cells of the rows that pass a row filter."""
    if row_filter is None:
        return cells
    kind = dict(cells.dtypes)["value"]
    known, part = row_filter.key_condition(), row_filter.key_part()
    out = cells if part is None else cells.where(part)
    if known is None:
        needed = row_filter.cells_needed()
        tested = out if needed is None else out.where(functools.reduce(lambda a, b: a | b, [(F.col("family") == f) & (F.col("qualifier") == q) for f, q in needed]))
        passed = tested.groupBy("key").agg(row_filter.condition(kind, age(cells.columns)).alias("_pass")).where("_pass").select("key")
        out = out.join(passed, "key", "left_semi")
    return out.withColumn("value", F.lit(None).cast(kind)) if isinstance(row_filter, StripRowValues) else out


def key_range(cells: DataFrame, start: Any = None, stop: Any = None) -> DataFrame:
    """Cells of keys in ``[start, stop)``; None is open."""
    out = cells
    if start is not None:
        out = out.where(F.col("key") >= F.lit(start))
    if stop is not None:
        out = out.where(F.col("key") < F.lit(stop))
    return out


def read(
    cells: DataFrame, request: DataRequest, layout: Layout | None = None, keys: list[Any] | None = None, start: Any = None, stop: Any = None, row_filter: RowFilter | None = None,
    now: int | None = None, per_second: int = 1000,
) -> DataFrame:
    """The cells that a request selects, of some keys, a key range or all rows.

    Columns with a page size are left to ``paging.pages`` and ``paging.page``.
    ``now`` is the clock of the layout's retention, with ``per_second`` versions a second.
    """
    if layout is not None:
        request = resolved(request, layout)
    kind = dict(cells.dtypes)["value"]
    rows = key_range(cells, start, stop)
    if keys is not None:
        rows = rows.where(F.col("key").isin(keys)) if keys else rows.where(F.lit(False))
    if layout is not None and now is not None:
        rows = retain(rows, layout, now, per_second)
    rows = select_rows(rows, row_filter)
    request = request.unpaged
    if not request.columns:
        return rows.where(F.lit(False))
    return _typed(_columns(rows, request, layout, kind), request)


def _columns(rows: DataFrame, request: DataRequest, layout: Layout | None, kind: str) -> DataFrame:
    """The requested columns of selected rows."""
    wants = [(c, _wanted(c, layout) & (c.filter.condition(kind) if c.filter else F.lit(True))) for c in request.columns]
    rows = rows.where(in_time(request))
    placed = [(c, want) for c, want in wants if c.filter is not None and c.filter.by_place]
    plain = [want for c, want in wants if c.filter is None or not c.filter.by_place]
    parts = [rows.where(functools.reduce(lambda a, b: a | b, plain))] if plain else []
    parts += [c.filter.placed(rows.where(want)) for c, want in placed]
    rows = functools.reduce(lambda a, b: a.unionByName(b), parts)
    limits = {c.max_versions for c in request.columns}
    if len(limits) == 1:
        rows = newest(rows, limits.pop())
    else:
        limit = functools.reduce(lambda acc, c: F.when(_wanted(c, layout), F.lit(c.max_versions)).otherwise(acc), request.columns, F.lit(1))
        rows = newest(rows, limit)
    changed, any_changed = F.col("value"), False
    for c in request.columns:
        value = c.filter.value(kind) if c.filter else None
        if value is not None:
            changed, any_changed = F.when(_wanted(c, layout), value).otherwise(changed), True
    return rows.withColumn("value", changed) if any_changed else rows


def _typed(rows: DataFrame, request: DataRequest) -> DataFrame:
    """Values as the type that the request's columns are read as, if any."""
    readers = {c.reader for c in request.columns}
    if len(readers) > 1:
        raise RequestError(f"columns of one read have one type: {sorted(map(str, readers))}")
    reader = readers.pop()
    if reader is None:
        return rows
    return rows.withColumn("value", reader(F.col("value")) if callable(reader) else F.col("value").cast(reader))


def get(cells: DataFrame, key: Any, request: DataRequest, layout: Layout | None = None) -> DataFrame:
    """Cells of one row."""
    return read(cells, request, layout, keys=[key])


def bulk_get(cells: DataFrame, keys: DataFrame, request: DataRequest, layout: Layout | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Cells for a table of (ordinal, key): one result for each input, repeated or unknown keys too."""
    wanted = keys.select("key").distinct()
    found = read(cells.join(wanted, "key", "left_semi"), request, layout)
    return keys.select(ordinal, "key").join(found, "key", "left")


def scan(cells: DataFrame, request: DataRequest, layout: Layout | None = None, start: Any = None, stop: Any = None, row_filter: RowFilter | None = None) -> DataFrame:
    """Cells of a key range."""
    return read(cells, request, layout, start=start, stop=stop, row_filter=row_filter)


def token_scan(cells: DataFrame, request: DataRequest, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Cells of keys whose 60-bit hash lies in ``[start, stop)``."""
    token = hash60(F.col("key"))
    rows = cells if start is None else cells.where(token >= start)
    return read(rows if stop is None else rows.where(token < stop), request)


def entity_ids(*groups: DataFrame) -> DataFrame:
    """Distinct keys of one or more locality groups."""
    return functools.reduce(lambda a, b: a.union(b), [g.select("key") for g in groups]).distinct()


def validate(request: DataRequest, layout: Layout) -> None:
    """Raises if a request names what a layout does not have."""
    for c in request.columns:
        family = layout.family(c.family)
        if family is None:
            raise RequestError(f"table {layout.name!r} has no family {c.family!r}")
        if c.qualifier is not None and family.columns and c.qualifier not in family.columns:
            raise RequestError(f"table {layout.name!r} has no column {c.name!r}")


def resolved(request: DataRequest, layout: Layout) -> DataRequest:
    """The request, valid for a layout, with families by their own names."""
    validate(request, layout)
    return replace(request, columns=tuple(replace(c, family=layout.family(c.family).name) for c in request.columns))
