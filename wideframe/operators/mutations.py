"""Writes and deletes as plans: each takes cells and mutations and returns the new cells.

``seq`` is the order of writes.  Cells that lack it count as written first, new
writes that lack it as written last.
"""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wideframe.operators.order import age, newest_first, written
from wideframe.plans.layout import FOREVER, Layout, LayoutError
from wideframe.plans.request import parse_column

CELL_ID = ["key", "family", "qualifier", "version"]
COLUMN_ID = ["key", "family", "qualifier"]
#: Parts that the cells of one deleted row, family or column are dealt into.
SALTS = 16


def put(cells: DataFrame, new: DataFrame, now: int | None = None) -> DataFrame:
    """Adds cells; of equal (cell, version) the last write wins.  A null version is ``now``.

    A new cell without ``seq`` is written after all that the table has, and in a
    table with ``seq`` gets the next one of its cell.  Cells that are not written
    over pass without a shuffle where the writes are small enough to be broadcast.
    Writes are dealt by cell before they are joined to the table and before they are
    ordered, so that no task holds the steps of the others.
    """
    if now is not None:
        new = new.withColumn("version", F.coalesce("version", F.lit(now)))
    ids = new.select(*CELL_ID).repartition(*CELL_ID).distinct()
    kept = cells.join(ids, CELL_ID, "left_anti")
    fresh = F.col("seq").isNull() if "seq" in new.columns else F.lit(True)
    both = cells.join(ids, CELL_ID, "left_semi").withColumn("_fresh", F.lit(False)).unionByName(new.withColumn("_fresh", fresh), allowMissingColumns=True)
    turn = Window.partitionBy(*CELL_ID).orderBy(F.desc("_fresh"), written(both.columns).desc())
    highest = F.max(written(both.columns)).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    made = _first(both.repartition(*CELL_ID).withColumn("_seq", highest), turn)
    if "seq" in made.columns:
        made = made.withColumn("seq", F.when(F.col("_fresh"), F.col("_seq") + 1).otherwise(F.col("seq")))
    return kept.unionByName(made.drop("_fresh", "_seq"), allowMissingColumns=True)


def _first(rows: DataFrame, turn: WindowSpec) -> DataFrame:
    """The first row of each partition of an ordered window.

    No row comes before it.  A test of ``row_number`` would let Spark sort whole splits
    before the shuffle, as an aggregation of texts does: memory that grows with a
    split, for tables in which few cells are written twice.
    """
    return rows.withColumn("_before", F.lag(F.lit(True)).over(turn)).where("_before is null").drop("_before")


def last_write(cells: DataFrame) -> DataFrame:
    """One cell for each (cell, version): the last one written."""
    return _first(cells, Window.partitionBy(*CELL_ID).orderBy(written(cells.columns).desc()))


def _checked(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, committed) for each expected row: whether the newest cells of its columns are as expected.

    Cells of the expected columns and expectations meet in one window by column, dealt
    anew so that its tasks hold no join.
    """
    columns = expected.dropna(subset=COLUMN_ID).select(*COLUMN_ID).distinct()
    mine = cells.join(columns, COLUMN_ID, "left_semi").select(*COLUMN_ID, F.struct("value").alias("_cell"), age(cells.columns).alias("_age"))
    both = mine.unionByName(expected.select(*COLUMN_ID, F.struct("value").alias("_want")), allowMissingColumns=True)
    newest = F.max_by("_cell", "_age").over(Window.partitionBy(*COLUMN_ID))
    checks = both.repartition(*COLUMN_ID).withColumn("_now", newest).where("_want is not null")
    held: Column = F.when(F.col("_want.value").isNull(), F.col("_now").isNull()).otherwise(F.coalesce(F.col("_now.value") == F.col("_want.value"), F.lit(False)))
    return checks.groupBy("key").agg(F.bool_and(held).alias("committed"))


def increment(cells: DataFrame, deltas: DataFrame, now: int, layout: Layout | None = None, columns: list[str] | None = None) -> DataFrame:
    """Adds (key, family, qualifier, delta) to counters: one new cell for each counter.

    The sum is written at ``now``, or at the counter's newest version if that is later.
    Counters and deltas meet in one aggregation, so that a task holds few sorts and
    tables of groups; only cells of the version that is written are then left out.
    """
    if layout is not None:
        for name in columns or []:
            family, qualifier = parse_column(name)
            if not layout.schema_of(family, qualifier or "").is_counter:
                raise LayoutError(f"{name} is no counter")
    kind = dict(cells.dtypes)["value"]
    newest = cells.dropna(subset=COLUMN_ID).select(*COLUMN_ID, F.struct("value", "version", written(cells.columns).alias("seq")).alias("_cell"), age(cells.columns).alias("_age"))
    total = deltas.groupBy(*COLUMN_ID).agg(F.sum("delta").alias("delta")).withColumn("_delta", F.lit(True))
    both = newest.unionByName(total, allowMissingColumns=True)
    both = both.groupBy(*COLUMN_ID).agg(F.max("delta").alias("delta"), F.max("_delta").alias("_delta"), F.max_by("_cell", "_age").alias("_cell"))
    made = both.where("_delta")
    version = F.greatest(F.lit(now).cast("bigint"), F.col("_cell.version"))  # skips nulls
    value = (F.coalesce(F.col("_cell.value").cast("bigint"), F.lit(0)) + F.col("delta")).cast(kind)
    seq = F.when(F.col("_cell.version") >= now, F.col("_cell.seq") + 1).otherwise(0)
    made = made.select(*COLUMN_ID, version.alias("version"), value.alias("value"), *([seq.alias("seq")] if "seq" in cells.columns else []))
    kept = cells.join(made.select(*CELL_ID), CELL_ID, "left_anti")
    return kept.unionByName(made, allowMissingColumns=True).select(*cells.columns)


def delete(cells: DataFrame, targets: DataFrame, level: str, up_to: int | None = None) -> DataFrame:
    """Removes cells of the targets: rows (key), families (key, family) or columns.

    With ``up_to``, or an ``up_to`` column in the targets, only versions up to it go.
    """
    by = {"row": COLUMN_ID[:1], "family": COLUMN_ID[:2], "column": COLUMN_ID}[level]
    if up_to is None and "up_to" not in targets.columns:
        return cells.join(targets.select(*by).distinct(), by, "left_anti")
    limit = F.lit(up_to) if up_to is not None else F.col("up_to")
    last = targets.groupBy(*by).agg(F.max(limit).alias("_upto"))  # one tombstone for each target
    kept = cells.join(last, by, "left").where(F.col("_upto").isNull() | (F.col("version") > F.col("_upto")))
    return kept.select(*cells.columns)


def delete_cell(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Removes exact versions if the targets have a version, else each target column's newest cell."""
    if "version" in targets.columns:
        return cells.join(targets.select(*CELL_ID).distinct(), CELL_ID, "left_anti")
    newest = cells.join(targets.select(*COLUMN_ID).distinct(), COLUMN_ID, "left_semi").groupBy(*COLUMN_ID).agg(F.max("version").alias("version"))
    return cells.join(newest, CELL_ID, "left_anti")


def replay(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Applies a log of puts and deletes in the order of ``seq``.

    The log has op (put, delete_row, delete_family, delete_column, delete_cell),
    key, family, qualifier, version, value and seq; a delete's null version
    means all.  A delete hides what was written before it, not what comes later.
    The latest tombstone that covers a cell is found by a window over the cells of
    deleted rows, families and columns only, dealt into ``SALTS`` parts each; other
    cells pass by.
    """
    base = cells if "seq" in cells.columns else cells.withColumn("seq", F.lit(-1).cast("bigint"))
    puts = log.where("op = 'put'").select(*base.columns)
    out = last_write(base.unionByName(puts))
    levels = {"delete_row": COLUMN_ID[:1], "delete_family": COLUMN_ID[:2], "delete_column": COLUMN_ID}
    for op, by in levels.items():
        stones = log.where(F.col("op") == op).groupBy(*by, F.coalesce("version", F.lit(2**63 - 1)).alias("version")).agg(F.max("seq").alias("_stone"))
        named = stones.select(*by).distinct()
        salt = F.pmod(F.xxhash64(*COLUMN_ID, "version"), F.lit(SALTS)).cast("int")
        touched = out.join(named, by, "left_semi").withColumn("_salt", salt).withColumn("_stone", F.lit(None).cast("bigint"))
        stones = stones.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # the latest tombstone among those with at least the cell's version
        over = Window.partitionBy(*by, "_salt").orderBy(F.desc("version")).rangeBetween(Window.unboundedPreceding, 0)
        marked = touched.unionByName(stones, allowMissingColumns=True).withColumn("_last", F.max("_stone").over(over)).where("_stone is null")
        marked = marked.where(~F.coalesce(F.col("_last") > F.col("seq"), F.lit(False))).select(*out.columns)
        out = out.join(named, by, "left_anti").unionByName(marked)
    exact = log.where("op = 'delete_cell' and version is not null").groupBy(*CELL_ID).agg(F.max("seq").alias("_last"))
    out = out.join(exact, CELL_ID, "left").where(~F.coalesce(F.col("_last") > F.col("seq"), F.lit(False)))
    return out.select(*cells.columns)


def flush(cells: DataFrame, deletes: list[tuple[str, DataFrame]], puts: list[DataFrame], now: int | None = None) -> DataFrame:
    """Applies a buffer of writes: all deletes, then all puts, whatever their order was."""
    out = cells
    for level, targets in deletes:
        out = delete_cell(out, targets) if level == "cell" else delete(out, targets, level)
    return put(out, functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), puts), now) if puts else out


def check_and_put(cells: DataFrame, expected: DataFrame, puts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts of the rows all of whose expectations hold, and (key, committed) for each expected row.

    ``expected`` has key, family, qualifier and value; a null value expects no
    cell.  Atomic for a single writer only: Spark has no lock between jobs.
    """
    result = _checked(cells, expected)
    return put(cells, puts.join(result.where("committed"), "key", "left_semi")), result


class RowTransaction:
    """Puts on one row that are committed together or not at all.

    A commit returns the table's new cells; storing them is the caller's step,
    by a single writer.  After a failed check the transaction stays open.
    """

    def __init__(self, cells: DataFrame):
        self.cells, self.key = cells, None
        self._puts: list[tuple] = []

    def begin(self, key: Any) -> RowTransaction:
        if self.key is not None:
            raise ValueError("a transaction is already open")
        self.key, self._puts = key, []
        return self

    def put(self, family: str, qualifier: str, value: Any, version: int | None = None) -> RowTransaction:
        self._open()
        self._puts.append((self.key, family, qualifier, version, value))
        return self

    def _open(self) -> None:
        if self.key is None:
            raise ValueError("no transaction is open")

    def _frame(self, rows: list[tuple], columns: list[str]) -> DataFrame:
        kinds = {**dict(self.cells.dtypes), "version": "bigint"}
        return self.cells.sparkSession.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in columns))

    def commit(self, now: int) -> DataFrame:
        self._open()
        self.cells = put(self.cells, self._frame(self._puts, [*CELL_ID, "value"]), now)
        self.key = None
        return self.cells

    def check_and_commit(self, family: str, qualifier: str, value: Any, now: int) -> bool:
        """Commits if the newest cell of a column has a value (None: if there is no cell)."""
        self._open()
        expected = self._frame([(self.key, family, qualifier, value)], [*COLUMN_ID, "value"])
        if not check_and_put(self.cells.where(F.col("key") == F.lit(self.key)), expected, self._frame([], [*CELL_ID, "value"]))[1].first()["committed"]:
            return False
        self.commit(now)
        return True

    def rollback(self) -> None:
        self._open()
        self.key, self._puts = None, []


def retain(cells: DataFrame, layout: Layout, now: int, per_second: int = 1000) -> DataFrame:
    """What a table keeps: each locality group's newest versions and live cells.

    ``now`` is the clock, in versions; ``per_second`` versions are a second.  Versions are
    counted over all stored cells first.
    """
    limit, oldest = F.lit(FOREVER), F.lit(-(2**63))
    for group in layout.groups.values():
        here = F.col("family").isin(sorted(group.families))
        if group.max_versions < FOREVER:
            limit = F.when(here, group.max_versions).otherwise(limit)
        if group.ttl_seconds < FOREVER:
            oldest = F.when(here, now - group.ttl_seconds * per_second).otherwise(oldest)
    turn = F.row_number().over(Window.partitionBy(*COLUMN_ID).orderBy(*newest_first(cells.columns)))
    kept = cells
    if any(g.max_versions < FOREVER for g in layout.groups.values()):
        kept = kept.withColumn("_turn", turn).where(F.col("_turn") <= limit).drop("_turn")
    return kept.where(F.col("version") >= oldest)
