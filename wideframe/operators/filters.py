"""Row filters and column filters.

A row filter decides on whole rows.  It is one boolean over the cells of a key:
an aggregate expression, so any and/or tree of row filters costs a single
map-side-combined aggregation.  A filter tells which columns it reads and whether a
row without their cells can pass, so that only those cells are read; what it asks of
the key alone is a plain predicate, which reaches the scan.

A column filter decides on cells, as a boolean over a cell's columns, or on their
places within a row, as a window over what was asked for.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideframe.operators.order import hash60, newest_first


def encoded_size(value: Column, kind: str) -> Column:
    """Bytes of a cell's value: its length, or the width of its type."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
    return F.lit(widths[kind]) if kind in widths else F.octet_length(value.cast("string") if kind not in ("string", "binary") else value)


def _here(family: str, qualifier: str) -> Column:
    return (F.col("family") == family) & (F.col("qualifier") == qualifier)


class RowFilter:
    """Decides which rows a read returns."""

    def condition(self, kind: str, age: Column) -> Column:
        """Aggregate boolean over the cells of a key; ``kind`` is the value's type, ``age`` is larger for newer cells."""
        return F.bool_or(self.key_condition())

    def key_condition(self) -> Column | None:
        """The same as a predicate on the key's columns, or None if cells are needed."""
        return None

    def key_part(self) -> Column | None:
        """A predicate on the key's columns that every row that passes fulfils, or None."""
        return self.key_condition()

    def cells_needed(self) -> list[tuple[str, str]] | None:
        """Columns without whose cells a row cannot pass and that decide by themselves; None if others may be needed."""
        return None

    def __and__(self, other: RowFilter) -> RowFilter:
        return AllOf((self, other))

    def __or__(self, other: RowFilter) -> RowFilter:
        return AnyOf((self, other))


@dataclass(frozen=True)
class HasColumnData(RowFilter):
    """Rows whose newest cell of the column is there and not empty."""

    family: str
    qualifier: str

    def condition(self, kind: str, age: Column) -> Column:
        here = _here(self.family, self.qualifier)
        size = F.when(F.col("value").isNull(), F.lit(0)).otherwise(encoded_size(F.col("value"), kind))
        return F.coalesce(F.max_by(F.when(here, size), F.when(here, age)) > 0, F.lit(False))

    def cells_needed(self) -> list[tuple[str, str]]:
        return [(self.family, self.qualifier)]


@dataclass(frozen=True)
class ColumnValueEquals(RowFilter):
    """Rows whose newest cell of the column equals a value; rows without the column fail."""

    family: str
    qualifier: str
    value: Any

    def condition(self, kind: str, age: Column) -> Column:
        here = _here(self.family, self.qualifier)
        return F.coalesce(F.max_by(F.when(here, F.col("value")), F.when(here, age)) == F.lit(self.value), F.lit(False))

    def cells_needed(self) -> list[tuple[str, str]]:
        return [(self.family, self.qualifier)]


@dataclass(frozen=True)
class RandomRows(RowFilter):
    """Each row with the given chance; the same rows for the same seed."""

    chance: float
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.chance <= 1:
            raise ValueError(f"chance must lie in [0, 1]: {self.chance}")

    def key_condition(self) -> Column:
        return hash60(F.lit(self.seed), F.col("key")) < round(self.chance * (1 << 60))


@dataclass(frozen=True)
class KeyComponents(RowFilter):
    """Rows whose key components equal the given ones; None matches anything, also nothing."""

    components: tuple[tuple[str, Any], ...]

    def key_condition(self) -> Column:
        tests = [F.col(name) == F.lit(value) for name, value in self.components if value is not None]  # a null is no match
        return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


class _Many(RowFilter):
    filters: tuple[RowFilter, ...]

    @staticmethod
    def _checked(filters: Any) -> tuple[RowFilter, ...]:
        out = tuple(f for f in filters if f is not None)
        if not out:
            raise ValueError("no filters to combine")
        return out

    def _joined(self, parts: list[Column]) -> Column:
        raise NotImplementedError

    def condition(self, kind: str, age: Column) -> Column:
        return self._joined([f.condition(kind, age) for f in self.filters])

    def key_condition(self) -> Column | None:
        parts = [f.key_condition() for f in self.filters]
        return None if any(p is None for p in parts) else self._joined(parts)


@dataclass(frozen=True)
class AllOf(_Many):
    """Rows that pass every filter; missing (None) filters are skipped."""

    filters: tuple[RowFilter, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "filters", self._checked(self.filters))

    def _joined(self, parts: list[Column]) -> Column:
        return functools.reduce(lambda a, b: a & b, parts)

    def key_part(self) -> Column | None:
        parts = [p for f in self.filters if (p := f.key_part()) is not None]
        return self._joined(parts) if parts else None

    def cells_needed(self) -> list[tuple[str, str]] | None:
        # filters of the key alone read no cells; the others must all tell theirs
        parts = [f.cells_needed() for f in self.filters if f.key_condition() is None]
        return None if not parts or any(p is None for p in parts) else sorted({c for p in parts for c in p})


@dataclass(frozen=True)
class AnyOf(_Many):
    """Rows that pass at least one filter; missing (None) filters are skipped."""

    filters: tuple[RowFilter, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "filters", self._checked(self.filters))

    def _joined(self, parts: list[Column]) -> Column:
        return functools.reduce(lambda a, b: a | b, parts)

    def key_part(self) -> Column | None:
        parts = [f.key_part() for f in self.filters]
        return None if any(p is None for p in parts) else self._joined(parts)

    def cells_needed(self) -> list[tuple[str, str]] | None:
        parts = [f.cells_needed() for f in self.filters]
        return None if any(p is None for p in parts) else sorted({c for p in parts for c in p})


@dataclass(frozen=True)
class StripRowValues(RowFilter):
    """All rows, with nulls for values (keys only)."""

    def key_condition(self) -> Column:
        return F.lit(True)


class ColumnFilter:
    """Decides which cells a column request returns, and what their value is."""

    def condition(self, kind: str) -> Column:
        return F.lit(True)

    def value(self, kind: str) -> Column | None:
        """A replacement for the value, None to leave it."""
        return None

    def placed(self, cells: DataFrame) -> DataFrame:
        """Those of the column's cells (that fulfil the condition) whose place in their row is asked for."""
        return cells

    @property
    def by_place(self) -> bool:
        """Whether ``placed`` leaves anything out."""
        return False

    def __and__(self, other: ColumnFilter) -> ColumnFilter:
        return AllCells((self, other))

    def __or__(self, other: ColumnFilter) -> ColumnFilter:
        return AnyCell((self, other))


@dataclass(frozen=True)
class QualifierRegex(ColumnFilter):
    """Qualifiers that begin with a match of the pattern; end it with ``$`` to match whole ones."""

    pattern: str

    def condition(self, kind: str) -> Column:
        return F.col("qualifier").rlike(f"^(?:{self.pattern})")


@dataclass(frozen=True)
class QualifierRange(ColumnFilter):
    """Qualifiers in a range, by binary order; a missing bound is open."""

    low: str | None = None
    low_inclusive: bool = True
    high: str | None = None
    high_inclusive: bool = False

    def condition(self, kind: str) -> Column:
        q, out = F.col("qualifier"), F.lit(True)
        if self.low is not None:
            out = out & (q >= self.low if self.low_inclusive else q > self.low)
        if self.high is not None:
            out = out & (q <= self.high if self.high_inclusive else q < self.high)
        return out


@dataclass(frozen=True)
class StripValues(ColumnFilter):
    """All cells, without their values."""

    def value(self, kind: str) -> Column:
        return F.lit(None).cast(kind)


@dataclass(frozen=True)
class ByteSizes(ColumnFilter):
    """All cells, each with its value's size in bytes for a value, as the value's own type."""

    def value(self, kind: str) -> Column:
        return encoded_size(F.col("value"), kind).cast(kind)


class _Placed(ColumnFilter):
    @property
    def by_place(self) -> bool:
        return True


@dataclass(frozen=True)
class FirstQualifiers(_Placed):
    """Cells of the first qualifiers of each family of each row, of those that an inner filter leaves."""

    limit: int
    inner: ColumnFilter | None = None

    def __post_init__(self) -> None:
        if self.limit < 1:
            raise ValueError(f"limit must be positive: {self.limit}")

    def condition(self, kind: str) -> Column:
        return self.inner.condition(kind) if self.inner else F.lit(True)

    def value(self, kind: str) -> Column | None:
        return self.inner.value(kind) if self.inner else None

    def placed(self, cells: DataFrame) -> DataFrame:
        cells = self.inner.placed(cells) if self.inner else cells
        turn = F.dense_rank().over(Window.partitionBy("key", "family").orderBy("qualifier"))
        return cells.withColumn("_turn", turn).where(F.col("_turn") <= self.limit).drop("_turn")


@dataclass(frozen=True)
class FirstKeyOnly(_Placed):
    """The first cell of each row, in result order."""

    def placed(self, cells: DataFrame) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy("key").orderBy("family", "qualifier", *newest_first(cells.columns)))
        return cells.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


@dataclass(frozen=True)
class AllCells(ColumnFilter):
    """Cells that pass every filter; places are counted in turn, each among what the one before left."""

    filters: tuple[ColumnFilter, ...]

    def condition(self, kind: str) -> Column:
        return functools.reduce(lambda a, b: a & b, [f.condition(kind) for f in self.filters])

    def value(self, kind: str) -> Column | None:
        return next((v for v in (f.value(kind) for f in self.filters) if v is not None), None)

    def placed(self, cells: DataFrame) -> DataFrame:
        return functools.reduce(lambda rows, f: f.placed(rows), self.filters, cells)

    @property
    def by_place(self) -> bool:
        return any(f.by_place for f in self.filters)


@dataclass(frozen=True)
class AnyCell(ColumnFilter):
    """Cells that pass at least one filter; filters by place cannot be alternatives."""

    filters: tuple[ColumnFilter, ...]

    def __post_init__(self) -> None:
        if any(f.by_place for f in self.filters):
            raise ValueError("a filter by place is no alternative")

    def condition(self, kind: str) -> Column:
        return functools.reduce(lambda a, b: a | b, [f.condition(kind) for f in self.filters])


#: Filters that a description may name; nothing else is ever built from one.
KNOWN = {
    c.__name__: c
    for c in (HasColumnData, ColumnValueEquals, RandomRows, KeyComponents, AllOf, AnyOf, StripRowValues, QualifierRegex, QualifierRange, StripValues, ByteSizes, FirstQualifiers, FirstKeyOnly, AllCells, AnyCell)
}


def to_dict(made: RowFilter | ColumnFilter) -> dict[str, Any]:
    """A description of a filter that JSON can hold."""
    out: dict[str, Any] = {"filter": type(made).__name__}
    for f in fields(made):
        value = getattr(made, f.name)
        if f.name == "filters":
            value = [to_dict(x) for x in value]
        elif f.name == "components":
            value = [list(x) for x in value]
        elif f.name == "inner" and value is not None:
            value = to_dict(value)
        out[f.name] = value
    return out


def from_dict(described: dict[str, Any]) -> RowFilter | ColumnFilter:
    """The filter of a description."""
    rest = dict(described)
    name = rest.pop("filter", None)
    if name not in KNOWN:
        raise ValueError(f"unknown filter {name!r}")
    if "filters" in rest:
        rest["filters"] = tuple(from_dict(x) for x in rest["filters"])
    if "components" in rest:
        rest["components"] = tuple((n, v) for n, v in rest["components"])
    if rest.get("inner") is not None:
        rest["inner"] = from_dict(rest["inner"])
    return KNOWN[name](**rest)
