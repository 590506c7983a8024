"""Paging over versions and qualifiers, in plans and on the driver.

A page is found by its key, so pages of all rows can be read in one plan; the
iterators read one page of one row at a time.  A requested column's ``page_size``
is the size of its pages: of versions for a column, of qualifiers for a family.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from wideframe.operators import filters
from wideframe.operators.order import newest_first
from wideframe.plans.compiler import get, read, resolved
from wideframe.plans.layout import Layout
from wideframe.plans.request import ALL_VERSIONS, Column, DataRequest, RequestError


def version_page(cells: DataFrame, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) of the versions of each column of each row."""
    turn = F.row_number().over(Window.partitionBy("key", "family", "qualifier").orderBy(*newest_first(cells.columns)))
    return cells.withColumn("_turn", turn).where((F.col("_turn") > page * size) & (F.col("_turn") <= (page + 1) * size)).drop("_turn")


def qualifier_page(cells: DataFrame, page: int, size: int) -> DataFrame:
    """(key, family, qualifier) of page ``page`` of the qualifiers of each family of each row."""
    turn = F.row_number().over(Window.partitionBy("key", "family").orderBy("qualifier"))
    names = cells.select("key", "family", "qualifier").distinct().withColumn("_turn", turn)
    return names.where((F.col("_turn") > page * size) & (F.col("_turn") <= (page + 1) * size)).drop("_turn")


def first_qualifiers(cells: DataFrame, limit: int) -> DataFrame:
    """Cells of the first ``limit`` qualifiers of each family of each row."""
    return filters.FirstQualifiers(limit).placed(cells)


def first_key_only(cells: DataFrame) -> DataFrame:
    """First cell of each row."""
    return filters.FirstKeyOnly().placed(cells)


def family_page(cells: DataFrame, page: int, size: int) -> DataFrame:
    """A page of qualifiers as row views without values: qualifiers of each family of each row."""
    return qualifier_page(cells, page, size).groupBy("key", "family").agg(F.sort_array(F.collect_list("qualifier")).alias("qualifiers"))


def page(cells: DataFrame, request: DataRequest, number: int, layout: Layout | None = None) -> DataFrame:
    """Page ``number`` (from 0) of each paged column of a request, for all rows, in one plan.

    A column's page is of its versions, a family's of its qualifiers with their cells.
    """
    request = resolved(request, layout) if layout is not None else request
    parts = []
    for c in request.paged.columns:
        found = read(cells, replace(request, columns=(replace(c, page_size=0),)), layout)
        if c.qualifier is not None:
            parts.append(version_page(found, number, c.page_size))
        else:
            parts.append(found.join(qualifier_page(found, number, c.page_size), ["key", "family", "qualifier"], "left_semi"))
    if not parts:
        raise RequestError("no column of the request is paged")
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def pages(cells: DataFrame, key: Any, request: DataRequest, column: str, size: int | None = None, layout: Layout | None = None) -> Iterator[list[Row]]:
    """Pages of one paged column of one row, in order; ``size`` overrides the request's page size.

    Of a column, pages of cells; of a family, pages of qualifiers with their newest cells.
    """
    request = resolved(request, layout) if layout is not None else request
    own = request.column(column)
    if own is None or not own.page_size:
        raise RequestError(f"column {column!r} is not paged in the request")
    if own.qualifier is not None:
        yield from versions(cells, key, own.name, size or own.page_size, request)
        return
    whole = replace(request, columns=(replace(own, page_size=0),))
    here = read(cells, whole, layout, keys=[key])
    for names in qualifiers(here, key, own.family, size or own.page_size):
        yield here.where(F.col("qualifier").isin(names)).orderBy("qualifier", *newest_first(here.columns)).collect()


def row_limit(cells: DataFrame, limit: int) -> DataFrame:
    """Cells of the first ``limit`` rows by key; 0 keeps all."""
    if limit <= 0:
        return cells
    first = cells.select("key").distinct().orderBy("key").limit(limit)
    return cells.join(F.broadcast(first) if limit <= 10_000 else first, "key", "left_semi")


def versions(cells: DataFrame, key: Any, column: str, size: int, request: DataRequest | None = None) -> Iterator[list[Row]]:
    """Pages of one column's cells, newest first; the next page ends where the last one did."""
    family, _, qualifier = column.partition(":")
    low, high = (request.min_version, request.max_version) if request else (0, 2**63 - 1)
    own = request.column(column) if request else None
    left, kept = (own.max_versions, own.filter) if own else (ALL_VERSIONS, None)
    while left > 0:
        want = min(size, left)
        found = get(cells, key, DataRequest((Column(family, qualifier, max_versions=want, filter=kept),), low, high))
        page = found.orderBy(*newest_first(found.columns)).collect()
        if not page:
            return
        yield page
        high, left = page[-1]["version"], left - len(page)
        if len(page) < want:
            return


def qualifiers(cells: DataFrame, key: Any, family: str, size: int) -> Iterator[list[str]]:
    """Pages of one map family's qualifiers in order."""
    here = cells.where((F.col("key") == F.lit(key)) & (F.col("family") == family))
    last: str | None = None
    while True:
        rest = here if last is None else here.where(F.col("qualifier") > last)
        page = [r["qualifier"] for r in rest.select("qualifier").distinct().orderBy("qualifier").limit(size).collect()]
        if not page:
            return
        yield page
        last = page[-1]


def family_cells(cells: DataFrame, key: Any, family: str) -> Iterator[Row]:
    """All cells of one map family, qualifiers ascending, newest first, streamed to the driver."""
    here = cells.where((F.col("key") == F.lit(key)) & (F.col("family") == family))
    return here.orderBy("qualifier", *newest_first(here.columns)).toLocalIterator()
