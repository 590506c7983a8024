"""Reads against literal cells and against a plain Python evaluator."""

import json
import os
import random
import re

import pytest

from wideframe.operators import filters, paging, results
from wideframe.plans import compiler, registry
from wideframe.plans.layout import CellSchema, Family, Layout, LocalityGroup
from wideframe.plans.request import ALL_VERSIONS, Column, DataRequest, RequestError
from wideframe.sources import tables

SCHEMA = "key bigint, family string, qualifier string, version bigint, value string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1001)
    made = {(rnd.randrange(6), rnd.choice("fg"), rnd.choice(["a", "b", "c", "ab"]), rnd.randrange(12)) for _ in range(220)}
    return [(*cell, rnd.choice(["", "x", "y", "zz"])) for cell in sorted(made)]


@pytest.fixture(scope="module")
def cells(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def plain(rows, request, keys=None):
    """What a request means, cell by cell."""
    out = []
    for c in request.columns:
        groups = {}
        for k, f, q, v, x in rows:
            named = f == c.family and c.qualifier in (None, q)
            if named and request.min_version <= v < request.max_version and (keys is None or k in keys):
                groups.setdefault((k, f, q), []).append((v, x))
        for (k, f, q), own in groups.items():
            out += [(k, f, q, v, x) for v, x in sorted(own, reverse=True)[: c.max_versions]]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*compiler.CELL).collect())


REQUESTS = [
    DataRequest.of("f"),
    DataRequest.of("f:a", "g:b", max_versions=3),
    DataRequest.of("f", "g", max_versions=2, min_version=3, max_version=9),
    DataRequest((Column("f", "a", max_versions=4), Column("f", "ab"), Column("g", max_versions=2))),
    DataRequest.of("g", max_versions=ALL_VERSIONS, max_version=5),
    DataRequest(),
    DataRequest.of("f", min_version=4, max_version=4),
]


@pytest.mark.parametrize("request_", REQUESTS)
def test_read_equals_the_plain_meaning(cells, rows, request_):
    assert got(compiler.read(cells, request_)) == plain(rows, request_)


def test_get_of_a_key_and_of_none(cells, rows):
    assert got(compiler.get(cells, 3, REQUESTS[1])) == plain(rows, REQUESTS[1], {3})
    assert got(compiler.get(cells, 99, REQUESTS[1])) == []


def test_bulk_get_keeps_repeats_and_unknown_keys(spark, cells, rows):
    wanted = spark.createDataFrame([(0, 2), (1, 2), (2, 77)], "ordinal int, key bigint")
    found = compiler.bulk_get(cells, wanted, DataRequest.of("f")).collect()
    n = len(plain(rows, DataRequest.of("f"), {2}))
    assert sorted(r["ordinal"] for r in found) == [0] * n + [1] * n + [2]


def test_scan_is_half_open(cells, rows):
    assert got(compiler.scan(cells, REQUESTS[0], start=1, stop=4)) == plain(rows, REQUESTS[0], {1, 2, 3})


def test_later_write_wins_among_equal_versions(spark):
    two = spark.createDataFrame([(1, "f", "q", 5, "old", 1), (1, "f", "q", 5, "new", 2)], SCHEMA + ", seq bigint")
    assert got(compiler.read(two, DataRequest.of("f"))) == [(1, "f", "q", 5, "new")]
    assert got(compiler.read(two, DataRequest.of("f", max_versions=2)))[0][4] in ("new", "old")


def test_group_family_expands_to_declared_columns(spark):
    table = spark.createDataFrame([(1, "f", "a", 1, "x"), (1, "f", "zz", 1, "y")], SCHEMA)
    layout = Layout("t", groups={"g": LocalityGroup("g", {"f": Family("f", {"a": CellSchema()})})})
    assert got(compiler.read(table, DataRequest.of("f"), layout)) == [(1, "f", "a", 1, "x")]
    for bad in ("nope", "f:b"):
        with pytest.raises(RequestError):
            compiler.read(table, DataRequest.of(bad), layout)


def keys_of(df):
    return {r["key"] for r in df.select("key").distinct().collect()}


def newest(rows, key, family, qualifier):
    own = [(v, x) for k, f, q, v, x in rows if (k, f, q) == (key, family, qualifier)]
    return max(own)[1] if own else None


def test_row_filters(cells, rows):
    every = DataRequest.of("f", "g", max_versions=ALL_VERSIONS)
    everyone = {r[0] for r in rows}
    has = filters.HasColumnData("f", "a")
    equal = filters.ColumnValueEquals("g", "b", "x")
    wants_has = {k for k in everyone if newest(rows, k, "f", "a")}  # an empty value counts as absent
    wants_equal = {k for k in everyone if newest(rows, k, "g", "b") == "x"}
    assert keys_of(compiler.read(cells, every, row_filter=has)) == wants_has
    assert keys_of(compiler.read(cells, every, row_filter=equal)) == wants_equal
    assert keys_of(compiler.read(cells, every, row_filter=has & equal)) == wants_has & wants_equal
    assert keys_of(compiler.read(cells, every, row_filter=has | equal)) == wants_has | wants_equal


def test_row_filter_may_look_at_unrequested_columns(cells, rows):
    found = compiler.read(cells, DataRequest.of("f:c"), row_filter=filters.HasColumnData("g", "b"))
    assert {(r["family"], r["qualifier"]) for r in found.collect()} <= {("f", "c")}


def test_formatted_key_filter(spark):
    table = spark.createDataFrame([(1, 100, 2000, "value"), (2, 100, None, None), (3, 101, 1, "value"), (4, 100, 5, "other")], "key bigint, a int, b bigint, c string")
    test = filters.KeyComponents((("a", 100), ("b", None), ("c", "value"))).key_condition()
    assert [r["key"] for r in table.where(test).collect()] == [1]


def test_random_rows_are_whole_and_repeatable(cells, rows):
    every = DataRequest.of("f", "g", max_versions=ALL_VERSIONS)
    one = keys_of(compiler.read(cells, every, row_filter=filters.RandomRows(0.5, 7)))
    assert one == keys_of(compiler.read(cells, every, row_filter=filters.RandomRows(0.5, 7)))
    assert keys_of(compiler.read(cells, every, row_filter=filters.RandomRows(1.0))) == {r[0] for r in rows}
    with pytest.raises(ValueError):
        filters.RandomRows(1.5)


@pytest.mark.parametrize(
    ("column_filter", "fits"),
    [
        (filters.QualifierRegex("a"), lambda q: q.startswith("a")),
        (filters.QualifierRegex("a$"), lambda q: q == "a"),
        (filters.QualifierRange("a", False, "c", True), lambda q: "a" < q <= "c"),
        (filters.QualifierRange(high="b"), lambda q: q < "b"),
        (filters.QualifierRegex("a") & filters.QualifierRange("ab"), lambda q: q.startswith("a") and q >= "ab"),
        (filters.QualifierRegex("c") | filters.QualifierRange(high="ab"), lambda q: q.startswith("c") or q < "ab"),
    ],
)
def test_column_filters(cells, rows, column_filter, fits):
    want = plain([r for r in rows if fits(r[2])], DataRequest.of("f", max_versions=2))
    assert got(compiler.read(cells, DataRequest((Column("f", max_versions=2, filter=column_filter),)))) == want


def test_stripped_values(cells):
    assert {r["value"] for r in compiler.read(cells, DataRequest((Column("f", filter=filters.StripValues()),))).collect()} == {None}


def test_filters_survive_json():
    made = (filters.HasColumnData("f", "a") & filters.KeyComponents((("x", 1), ("y", None)))) | filters.RandomRows(0.25, 3)
    assert filters.from_dict(json.loads(json.dumps(filters.to_dict(made)))) == made
    column = filters.QualifierRange("a", True, None, False) | filters.QualifierRegex("b")
    assert filters.from_dict(json.loads(json.dumps(filters.to_dict(column)))) == column
    with pytest.raises(ValueError):
        filters.from_dict({"filter": "os.system"})
    with pytest.raises(ValueError):
        filters.AllOf((None,))


def test_pages_cover_all_versions_once(cells, rows):
    pages = list(paging.versions(cells, 2, "f:a", 2))
    flat = [r["version"] for p in pages for r in p]
    assert flat == sorted((v for k, f, q, v, _ in rows if (k, f, q) == (2, "f", "a")), reverse=True)
    assert all(len(p) == 2 for p in pages[:-1]) and pages[-1]
    names = [q for p in paging.qualifiers(cells, 2, "g", 3) for q in p]
    assert names == sorted({q for k, f, q, *_ in rows if (k, f) == (2, "g")})


def test_paging_stops_at_max_versions(cells):
    limited = DataRequest.of("f:a", max_versions=3)
    assert sum(len(p) for p in paging.versions(cells, 2, "f:a", 2, limited)) <= 3


def test_results(cells, rows):
    counts = {(r["key"], r["family"], r["qualifier"]): r["n_cells"] for r in results.count_columns(cells).collect()}
    assert sum(counts.values()) == len(rows)
    views = {r["key"]: r["row"] for r in results.row_views(cells).collect()}
    assert all(views[k][f][q][v] == x for k, f, q, v, x in rows)
    made = results.materialize(cells).collect()
    assert all([c["version"] for c in r["cells"]] == sorted((c["version"] for c in r["cells"]), reverse=True) for r in made)
    order = [(r["key"], r["family"], r["qualifier"], -r["version"]) for r in results.ordered(cells).collect()]
    assert order == sorted(order)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(compiler.read(none, REQUESTS[2], row_filter=filters.HasColumnData("f", "a"))) == []
    assert results.row_views(none).count() == 0


def test_filters_reach_the_scan(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    plan = compiler.get(spark.read.parquet(str(tmp_path / "t")), 3, DataRequest.of("f:a", min_version=2))._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(key,3)", "EqualTo(family,f)", "GreaterThanOrEqual(version,2)"):
        assert part in plan


# pushed predicates -----------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def scans(df):
    """What the plan's scans push and read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: (\[.*?\]), ReadSchema", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_time_ranges_and_row_filters_reach_the_scan(spark):
    queries = registry.queries()
    for name in ("top_n_versions", "time_range_versions", "merged_request", "narrow_view", "paged_request"):
        assert all("GreaterThanOrEqual(ts," in s for s in scans(queries[name](spark, SF))), name
    assert any("EqualTo(event_type,purchase)" in s for s in scans(queries["has_column_data"](spark, SF)))


def test_row_filters_read_only_their_columns(spark, tmp_path):
    rows = [(k, f, q, v, f"{k}{q}{v}", v) for k in range(6) for f in "fg" for q in "ab" for v in (1, 2)]
    spark.createDataFrame(rows, "key bigint, family string, qualifier string, version bigint, value string, seq bigint").write.parquet(str(tmp_path / "t"))
    cells = spark.read.parquet(str(tmp_path / "t"))
    either = filters.ColumnValueEquals("f", "a", "3a2") | filters.HasColumnData("g", "z")
    made = compiler.read(cells, DataRequest.of("g:b"), row_filter=either)
    assert any("Or(And(EqualTo(family,f),EqualTo(qualifier,a)),And(EqualTo(family,g),EqualTo(qualifier,z)))" in s for s in scans(made))
    assert [r["key"] for r in made.collect()] == [3]
    keyed = filters.RandomRows(1.0) & filters.KeyComponents((("key", 4),)) & filters.HasColumnData("f", "a")
    made = compiler.read(cells, DataRequest.of("g:b"), row_filter=keyed)
    assert all("EqualTo(key,4)" in s for s in scans(made)) and [r["key"] for r in made.collect()] == [4]
    # a row without the named cells can pass by its key
    loose = filters.KeyComponents((("key", 2),)) | filters.HasColumnData("f", "nothing")
    assert [r["key"] for r in compiler.read(cells, DataRequest.of("g:b"), row_filter=loose).collect()] == [2]


def test_filters_see_the_newest_write(spark):
    cells = spark.createDataFrame([(1, "f", "q", 5, "A", 1), (1, "f", "q", 5, "B", 2), (2, "f", "q", 5, "", 4), (2, "f", "q", 5, "x", 3)], "key bigint, family string, qualifier string, version bigint, value string, seq bigint")
    read = lambda f: [(r["key"], r["value"]) for r in compiler.read(cells, DataRequest.of("f"), row_filter=f).collect()]
    assert read(filters.ColumnValueEquals("f", "q", "A")) == [] and read(filters.ColumnValueEquals("f", "q", "B")) == [(1, "B")]
    assert read(filters.HasColumnData("f", "q")) == [(1, "B")]
    assert [r["value"] for r in paging.version_page(cells.where("key = 1"), 0, 1).collect()] == ["B"]


def test_aliases_retention_types_and_pages(spark):
    family = Family("info", {"a": CellSchema(), "b": CellSchema()}, aliases=("i",))
    layout = Layout("t", groups={"main": LocalityGroup("main", {"info": family}, max_versions=2, ttl_seconds=10)})
    rows = [(1, "info", q, v, str(v)) for q in "ab" for v in (1000, 9000, 9500, 9700)]
    cells = spark.createDataFrame(rows, "key bigint, family string, qualifier string, version bigint, value string")
    everything = DataRequest.of("i:a", max_versions=9)
    assert sorted(r["version"] for r in compiler.read(cells, everything, layout).collect()) == [1000, 9000, 9500, 9700]
    assert sorted(r["version"] for r in compiler.read(cells, everything, layout, now=19600).collect()) == [9700]
    assert layout.group_of("i").name == "main"
    typed = compiler.read(cells, DataRequest((Column("i", "a", reader="bigint"),)), layout)
    assert dict(typed.dtypes)["value"] == "bigint" and typed.first()["value"] == 9700
    own = compiler.read(cells, DataRequest((Column("i", "a", reader=lambda v: v.cast("bigint") + 1),)), layout)
    assert own.first()["value"] == 9701
    with pytest.raises(RequestError):
        compiler.read(cells, DataRequest((Column("info", "a", reader="bigint"), Column("info", "b"))), layout)
    with pytest.raises(RequestError):
        DataRequest((Column("f", "a", reader="int"),)).merge(DataRequest((Column("f", "a"),)))
    request = DataRequest((Column("i", "a", max_versions=3, page_size=2), Column("info", "b")))
    assert [r["qualifier"] for r in compiler.read(cells, request, layout).collect()] == ["b"]
    assert [[r["version"] for r in p] for p in paging.pages(cells, 1, request, "info:a", layout=layout)] == [[9700, 9500], [9000]]
    assert [[r["version"] for r in p] for p in paging.pages(cells, 1, request, "info:a", size=1, layout=layout)] == [[9700], [9500], [9000]]
    families = DataRequest.of("info", page_size=1)
    assert [[r["qualifier"] for r in p] for p in paging.pages(cells, 1, families, "info", layout=layout)] == [["a"], ["b"]]
    assert sorted(r["version"] for r in paging.page(cells, request, 1, layout).collect()) == [9000]
    with pytest.raises(RequestError):
        next(paging.pages(cells, 1, request, "info:b", layout=layout))
    with pytest.raises(RequestError):
        paging.page(cells, DataRequest.of("info"), 0)


def test_filters_by_place_have_a_description():
    made = filters.QualifierRegex("a") & filters.FirstQualifiers(3, filters.QualifierRange("b"))
    assert filters.from_dict(filters.to_dict(made)) == made
    with pytest.raises(ValueError):
        filters.FirstKeyOnly() | filters.StripValues()
    with pytest.raises(ValueError):
        filters.FirstQualifiers(0)


def test_clock_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS n, TIMESTAMP'2024-03-31 02:30:00.000001Z' AS z")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/Lima"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert tuple(df.select(tables.micros("n"), tables.micros("z")).first()) == (1711852200000001,) * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
