"""Requests: limits, conflicts and merging."""

import pytest

from wideframe.plans.request import ALL_VERSIONS, Column, DataRequest, RequestError, parse_column


def test_defaults():
    c = DataRequest.of("info:name").column("info:name")
    assert c.max_versions == 1 and not c.page_size
    assert DataRequest().min_version == 0 and DataRequest().max_version == 2**63 - 1


def test_names_split_at_the_first_colon():
    assert parse_column("f:a:b") == ("f", "a:b")
    assert parse_column("f") == ("f", None)
    with pytest.raises(RequestError):
        parse_column(":q")


@pytest.mark.parametrize("columns", [(Column("f"), Column("f", "q")), (Column("f", "q"), Column("f", "q"))])
def test_conflicting_columns(columns):
    with pytest.raises(RequestError):
        DataRequest(columns)


@pytest.mark.parametrize("versions", [0, -1])
def test_versions_must_be_positive(versions):
    with pytest.raises(RequestError):
        Column("f", max_versions=versions)


def test_bad_time_range():
    with pytest.raises(RequestError):
        DataRequest(min_version=5, max_version=4)


def test_merge_takes_the_wider_of_everything():
    one = DataRequest((Column("foo", "bar", max_versions=2),), 3, 4)
    other = DataRequest((Column("baz", "bot"), Column("foo", "bar", max_versions=6)), 2, 4)
    merged = one.merge(other)
    assert (merged.min_version, merged.max_version) == (2, 4)
    assert {(c.name, c.max_versions) for c in merged.columns} == {("foo:bar", 6), ("baz:bot", 1)}


def test_merge_pages_and_families():
    merged = DataRequest((Column("f", "a", page_size=5), Column("g", "a", page_size=7))).merge(DataRequest((Column("f", max_versions=3), Column("g", "a", page_size=2))))
    assert merged.column("f:a").qualifier is None and merged.column("f").max_versions == 3
    assert merged.column("g:a").page_size == 2


def test_merge_refuses_filters():
    with pytest.raises(RequestError):
        DataRequest((Column("f", filter=object()),)).merge(DataRequest())


def test_paged_and_unpaged_halves():
    both = DataRequest((Column("f", "a", page_size=5), Column("g", max_versions=ALL_VERSIONS)))
    assert [c.name for c in both.paged.columns] == ["f:a"] and [c.name for c in both.unpaged.columns] == ["g"]
