"""Data requests: a declarative description of the cells to read.

A request is a set of columns, each a whole family or one ``family:qualifier``,
with a limit of versions, an optional column filter and an optional page size,
and one time range ``[min_version, max_version)`` for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column as SparkColumn

#: Upper end of a time range that excludes nothing.
END_OF_TIME = 2**63 - 1
#: A version limit that keeps everything.
ALL_VERSIONS = 2**31 - 1


class RequestError(ValueError):
    """A request that contradicts itself or the layout."""


def parse_column(name: str) -> tuple[str, str | None]:
    """``family`` or ``family:qualifier``; the first colon parts them."""
    family, colon, qualifier = name.partition(":")
    if not family:
        raise RequestError(f"no family in column name {name!r}")
    return family, qualifier if colon and qualifier else None


@dataclass(frozen=True)
class Column:
    """One requested family (no qualifier) or column; ``reader`` is a type to read its values as, or a function of the value's column that decodes it."""

    family: str
    qualifier: str | None = None
    max_versions: int = 1
    filter: Any = None
    page_size: int = 0
    reader: str | Callable[[SparkColumn], SparkColumn] | None = None

    def __post_init__(self) -> None:
        if self.max_versions <= 0:
            raise RequestError(f"max_versions must be positive, not {self.max_versions}")
        if self.page_size < 0:
            raise RequestError(f"page_size must not be negative: {self.page_size}")

    @property
    def name(self) -> str:
        return self.family if self.qualifier is None else f"{self.family}:{self.qualifier}"


@dataclass(frozen=True)
class DataRequest:
    """Columns and a time range.  An empty request reads no cell."""

    columns: tuple[Column, ...] = ()
    min_version: int = 0
    max_version: int = END_OF_TIME
    _by_name: dict = field(init=False, repr=False, compare=False, hash=False, default=None)

    def __post_init__(self) -> None:
        if self.min_version < 0 or self.max_version < self.min_version:
            raise RequestError(f"bad time range [{self.min_version}, {self.max_version})")
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise RequestError(f"a column is requested twice: {sorted(names)}")
        whole = {c.family for c in self.columns if c.qualifier is None}
        for c in self.columns:
            if c.qualifier is not None and c.family in whole:
                raise RequestError(f"family {c.family!r} and its column {c.name!r} are both requested")
        object.__setattr__(self, "_by_name", dict(zip(names, self.columns, strict=True)))

    @staticmethod
    def of(*names: str, max_versions: int = 1, min_version: int = 0, max_version: int = END_OF_TIME, page_size: int = 0) -> DataRequest:
        """A request for families and columns by name, all with the same limits."""
        return DataRequest(tuple(Column(*parse_column(n), max_versions=max_versions, page_size=page_size) for n in names), min_version, max_version)

    def column(self, name: str) -> Column | None:
        """The request for a column: its own, or that of its family."""
        return self._by_name.get(name) or self._by_name.get(parse_column(name)[0])

    def with_column(self, column: Column) -> DataRequest:
        return replace(self, columns=(*self.columns, column))

    @property
    def paged(self) -> DataRequest:
        return replace(self, columns=tuple(c for c in self.columns if c.page_size))

    @property
    def unpaged(self) -> DataRequest:
        return replace(self, columns=tuple(c for c in self.columns if not c.page_size))

    def merge(self, other: DataRequest) -> DataRequest:
        """A request that covers both: widest time range, most versions, smallest page.

        A family request takes in the other's columns of that family.
        """
        for c in (*self.columns, *other.columns):
            if c.filter is not None:
                raise RequestError(f"requests with column filters cannot be merged: {c.name}")
        merged: dict[str, Column] = {}
        whole = {c.family for c in (*self.columns, *other.columns) if c.qualifier is None}
        for c in (*self.columns, *other.columns):
            if c.qualifier is not None and c.family in whole:
                c = replace(c, qualifier=None)
            old = merged.get(c.name)
            if old is not None:
                if old.reader != c.reader:
                    raise RequestError(f"{c.name} is read as {old.reader} and as {c.reader}")
                pages = [p for p in (old.page_size, c.page_size) if p]
                c = replace(c, max_versions=max(old.max_versions, c.max_versions), page_size=min(pages, default=0))
            merged[c.name] = c
        return DataRequest(tuple(merged.values()), min(self.min_version, other.min_version), max(self.max_version, other.max_version))
