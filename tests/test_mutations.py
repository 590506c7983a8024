"""Writes, deletes, counters, transactions, retention."""

import random

import pytest

from wideframe.operators import mutations
from wideframe.plans.layout import CellSchema, Family, Layout, LayoutError, LocalityGroup

SCHEMA = "key bigint, family string, qualifier string, version bigint, value string"


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, SCHEMA + extra)


def got(df):
    return sorted(tuple(r) for r in df.select("key", "family", "qualifier", "version", "value").collect())


def test_put_overwrites_and_takes_the_clock(spark):
    old = table(spark, [(1, "f", "q", 5, "a", 0)], ", seq bigint")
    new = table(spark, [(1, "f", "q", 5, "b", 1), (1, "f", "q", None, "c", 2)], ", seq bigint")
    assert got(mutations.put(old, new, now=9)) == [(1, "f", "q", 5, "b"), (1, "f", "q", 9, "c")]


def test_deletes(spark):
    rows = [(k, f, q, v, "x") for k in (1, 2) for f in "fg" for q in "ab" for v in (1, 2, 3)]
    cells = table(spark, rows)
    one = spark.createDataFrame([(1, "f", "a")], "key bigint, family string, qualifier string")
    assert got(mutations.delete(cells, one, "row")) == [r for r in rows if r[0] != 1]
    assert got(mutations.delete(cells, one, "family")) == [r for r in rows if r[:2] != (1, "f")]
    assert got(mutations.delete(cells, one, "column", up_to=2)) == [r for r in rows if r[:3] != (1, "f", "a") or r[3] > 2]
    assert got(mutations.delete_cell(cells, one)) == [r for r in rows if r[:4] != (1, "f", "a", 3)]
    exact = spark.createDataFrame([(1, "f", "a", 2), (9, "f", "a", 2)], "key bigint, family string, qualifier string, version bigint")
    assert got(mutations.delete_cell(cells, exact)) == [r for r in rows if r[:4] != (1, "f", "a", 2)]


def test_replay_equals_one_by_one(spark):
    rnd = random.Random(5)
    ops = ["put"] * 6 + ["delete_row", "delete_family", "delete_column", "delete_cell"]
    log, state = [], {}
    for seq in range(160):
        op, k, f, q, v = rnd.choice(ops), rnd.randrange(3), rnd.choice("fg"), rnd.choice("ab"), rnd.randrange(6)
        if op.startswith("delete") and op != "delete_cell" and rnd.random() < 0.3:
            v = None
        log.append((op, k, f, q, v, str(seq) if op == "put" else None, seq))
        if op == "put":
            state[(k, f, q, v)] = str(seq)
        else:
            by = {"delete_row": 1, "delete_family": 2, "delete_column": 3, "delete_cell": 3}[op]
            state = {c: x for c, x in state.items() if c[:by] != (k, f, q)[:by] or (c[3] != v if op == "delete_cell" else v is not None and c[3] > v)}
    made = spark.createDataFrame(log, "op string, " + SCHEMA + ", seq bigint")
    assert got(mutations.replay(table(spark, []), made)) == sorted((*c, x) for c, x in state.items())


def test_flush_deletes_before_it_puts(spark):
    cells = table(spark, [(1, "f", "a", 1, "old")])
    new = table(spark, [(1, "f", "a", 2, "new")])
    assert got(mutations.flush(cells, [("row", new)], [new])) == [(1, "f", "a", 2, "new")]


def test_counters(spark):
    cells = spark.createDataFrame([(1, "c", "n", 3, 10)], SCHEMA.replace("value string", "value bigint"))
    deltas = spark.createDataFrame([(1, "c", "n", 2), (1, "c", "n", 3), (2, "c", "n", -1)], "key bigint, family string, qualifier string, delta bigint")
    assert got(mutations.increment(cells, deltas, now=4)) == [(1, "c", "n", 3, 10), (1, "c", "n", 4, 15), (2, "c", "n", 4, -1)]
    layout = Layout("t", groups={"g": LocalityGroup("g", {"c": Family("c", {"n": CellSchema()})})})
    with pytest.raises(LayoutError):
        mutations.increment(cells, deltas, 4, layout, ["c:n"])


def test_check_and_put(spark):
    cells = table(spark, [(1, "f", "a", 1, "x"), (2, "f", "a", 1, "y"), (2, "f", "a", 2, "x")])
    expected = spark.createDataFrame([(1, "f", "a", "x"), (2, "f", "a", "y"), (3, "f", "a", None), (1, "f", "b", None)], "key bigint, family string, qualifier string, value string")
    puts = table(spark, [(k, "f", "a", 9, "new") for k in (1, 2, 3)])
    after, done = mutations.check_and_put(cells, expected, puts)
    assert {r["key"]: r["committed"] for r in done.collect()} == {1: True, 2: False, 3: True}
    assert [r[0] for r in got(after) if r[4] == "new"] == [1, 3]


def test_retention_counts_versions_then_age(spark):
    cells = table(spark, [(1, f, "q", v, "x") for f in "fm" for v in (1000, 2000, 3000, 4000)])
    layout = Layout("t", groups={"a": LocalityGroup("a", {"f": Family("f")}, max_versions=2), "b": LocalityGroup("b", {"m": Family("m")}, ttl_seconds=1)})
    assert [(r[1], r[3]) for r in got(mutations.retain(cells, layout, now=3500))] == [("f", 3000), ("f", 4000), ("m", 3000), ("m", 4000)]


@pytest.mark.parametrize(("table_seq", "write_seq"), [(False, False), (True, False), (False, True), (True, True)])
def test_the_later_write_of_a_version_wins(spark, table_seq, write_seq):
    old = table(spark, [(1, "f", "q", 5, "old", *([7] if table_seq else [])), (2, "f", "q", 5, "kept", *([8] if table_seq else []))], ", seq bigint" if table_seq else "")
    new = table(spark, [(1, "f", "q", 5, "new", *([9] if write_seq else []))], ", seq bigint" if write_seq else "")
    made = mutations.put(old, new)
    assert got(made) == [(1, "f", "q", 5, "new"), (2, "f", "q", 5, "kept")]
    again = mutations.put(made, table(spark, [(1, "f", "q", 5, "last")]))
    assert got(again) == [(1, "f", "q", 5, "last"), (2, "f", "q", 5, "kept")]


def test_an_older_seq_does_not_win(spark):
    old = table(spark, [(1, "f", "q", 5, "old", 7)], ", seq bigint")
    assert got(mutations.put(old, table(spark, [(1, "f", "q", 5, "late", 3)], ", seq bigint"))) == [(1, "f", "q", 5, "old")]


def test_increments_add_to_the_newest_write(spark):
    kinds = "key bigint, family string, qualifier string, version bigint, value bigint, seq bigint"
    cells = spark.createDataFrame([(1, "c", "q", 50, 10, 3), (1, "c", "q", 50, 12, 4), (1, "c", "q", 40, 99, 9), (2, "c", "q", 5, 1, 0)], kinds)
    deltas = spark.createDataFrame([(1, "c", "q", 5), (2, "c", "q", 1), (2, "c", "q", 1), (3, "c", "q", 4)], "key bigint, family string, qualifier string, delta bigint")
    for now in (50, 45):
        made = mutations.increment(mutations.last_write(cells), deltas, now)
        newest = {(r["key"], r["version"]): r["value"] for r in made.collect()}
        assert newest == {(1, 50): 17, (1, 40): 99, (2, 5): 1, (2, now): 3, (3, now): 4}


def test_increments_keep_plans_small(spark):
    """Counters and deltas meet once: a task of a large table holds few sorts and tables of groups."""
    kinds = "key bigint, family string, qualifier string, version bigint, value bigint, seq bigint, extra string"
    rows = [(1, "c", "q", 5, 1, 2, "a"), (1, "c", "q", 5, 1, 2, "b"), (2, "c", "q", 5, 7, None, "c"), (2, "c", "q", 4, 7, None, "d"), (3, "c", None, 5, 1, 0, "e"), (4, "c", "q", 9, 3, 1, "f")]
    deltas = spark.createDataFrame([(1, "c", "q", 5), (2, "c", "q", 1), (3, "c", None, 4), (5, "c", "q", None)], "key bigint, family string, qualifier string, delta bigint")
    made = mutations.increment(spark.createDataFrame(rows, kinds), deltas, 5)
    assert sorted(made.collect(), key=str) == sorted(
        [(1, "c", "q", 5, 6, 3, None), (2, "c", "q", 5, 8, 0, None), (2, "c", "q", 4, 7, None, "d"), (3, "c", None, 5, 1, 0, "e"), (3, "c", None, 5, 4, 0, None), (4, "c", "q", 9, 3, 1, "f"), (5, "c", "q", 5, None, 0, None)], key=str
    )
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") <= 4


def test_checks_see_the_newest_write(spark):
    cells = table(spark, [(1, "f", "q", 5, "a", 1), (1, "f", "q", 5, "b", 2), (2, "f", "q", 5, "a", 1)], ", seq bigint")
    expected = spark.createDataFrame([(1, "f", "q", "b"), (2, "f", "q", "b"), (3, "f", "q", None)], "key bigint, family string, qualifier string, value string")
    puts = table(spark, [(k, "f", "q", 5, "new") for k in (1, 2, 3)])
    made, result = mutations.check_and_put(cells, expected, puts)
    assert {r["key"]: r["committed"] for r in result.collect()} == {1: True, 2: False, 3: True}
    assert got(made) == [(1, "f", "q", 5, "new"), (2, "f", "q", 5, "a"), (3, "f", "q", 5, "new")]


def test_transactions_stay_open_after_a_failed_check(spark):
    tx = mutations.RowTransaction(table(spark, [(1, "f", "q", 5, "a")]))
    with pytest.raises(ValueError):
        tx.put("f", "q", "x")
    tx.begin(1).put("f", "q", "b", 6).put("f", "r", "c")
    with pytest.raises(ValueError):
        tx.begin(2)
    assert not tx.check_and_commit("f", "q", "wrong", now=9) and not tx.check_and_commit("f", "q", None, now=9)
    assert tx.check_and_commit("f", "q", "a", now=9)
    want = [(1, "f", "q", 5, "a"), (1, "f", "q", 6, "b"), (1, "f", "r", 9, "c")]
    assert got(tx.cells) == want
    tx.begin(1).put("f", "q", "gone").rollback()
    assert tx.begin(3).put("f", "q", "d", 1).check_and_commit("f", "q", None, now=9) and got(tx.cells) == [*want, (3, "f", "q", 1, "d")]
    assert got(tx.begin(3).put("f", "q", "e", 2).commit(9)) == [*want, (3, "f", "q", 1, "d"), (3, "f", "q", 2, "e")]


def test_untouched_cells_pass_a_replay_without_a_window(spark):
    rows = [(k, "f", "q", v, "x") for k in range(40) for v in range(20)]
    log = spark.createDataFrame([("delete_row", 3, None, None, 10, None, 1), ("delete_row", 3, None, None, 4, None, 2)], "op string, " + SCHEMA + ", seq bigint")
    assert got(mutations.replay(table(spark, rows), log)) == [r for r in rows if r[0] != 3 or r[3] > 10]


def held_at_once(frame):
    """The sorts and tables of groups of each stage of a plan, most first; the sides of a union are tasks of their own."""
    counts, above = [0], []
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        name = line[depth:].lstrip("*()0123456789 ")
        while above and above[-1][0] >= depth:
            above.pop()
        stage = above[-1][1] if above else 0
        if above and above[-1][2].startswith(("Exchange", "BroadcastExchange", "Union")):
            counts.append(0)
            stage = len(counts) - 1
        counts[stage] += name.startswith(("Sort ", "HashAggregate", "ObjectHashAggregate"))
        above.append((depth, stage, name))
    return sorted(counts, reverse=True)


def test_last_writes_are_sorted_after_the_shuffle(spark):
    rows = [(1, "f", "q", 5, "a", 1), (1, "f", "q", 5, "b", 2), (1, "f", "q", 5, "z", None), (None, "f", "q", 5, "c", None), (None, "f", "q", 5, "d", 0), (2, "f", None, None, None, 3)]
    cells = table(spark, rows, ", seq bigint")
    made = mutations.last_write(cells)
    assert made.columns == cells.columns
    assert sorted(map(tuple, made.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)
    assert mutations.last_write(cells.drop("seq")).count() == 3
    for one in (cells, cells.drop("seq")):
        one = mutations.last_write(one)
        top, _, below = one._jdf.queryExecution().executedPlan().toString().partition("Exchange ")
        assert "Sort " in top and "Sort" not in below


def test_a_check_holds_few_sorts_in_one_stage(spark):
    """Rows, checks and writes that all lie by key do not pile up in the tasks of one stage."""
    from pyspark.sql import functions as F

    writes = table(spark, [(k, "f", "a", v, str((k + v) % 3), s) for k in range(6) for v in (1, 2) for s in (1, 2)], ", seq bigint").withColumn("family", F.lit("f"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        expected = writes.select("key").distinct().select("key", F.lit("f").alias("family"), F.lit("a").alias("qualifier"), F.lit("2").alias("value"))
        puts = expected.select("key", "family", "qualifier", F.lit(9).cast("bigint").alias("version"), F.lit("new").alias("value"))
        made, result = mutations.check_and_put(mutations.last_write(writes), expected, puts)
        assert max(held_at_once(made)) <= 5 and max(held_at_once(result)) <= 3
        assert {r["key"]: r["committed"] for r in result.collect()} == {k: k % 3 == 0 for k in range(6)}
        assert got(made) == sorted([(k, "f", "a", v, str((k + v) % 3)) for k in range(6) for v in (1, 2)] + [(k, "f", "a", 9, "new") for k in (0, 3)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_expectation_of_a_row_counts(spark):
    cells = table(spark, [(1, "f", "a", 1, "x"), (2, "f", "a", 1, "x"), (3, "f", "a", 1, None), (4, "f", "a", 1, "x"), (None, "f", "a", 1, "x")])
    wants = [(1, "f", "a", "x"), (1, "f", "a", "x"), (1, "f", "b", None), (2, "f", "a", "x"), (2, "f", "a", "y"), (3, "f", "a", None), (4, "f", "a", "x"), (4, "f", "a", None), (5, "f", "a", "x"), (None, "f", "a", None)]
    expected = spark.createDataFrame(wants, "key bigint, family string, qualifier string, value string")
    result = mutations.check_and_put(cells, expected, table(spark, []))[1]
    assert {r["key"]: r["committed"] for r in result.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, None: True}
