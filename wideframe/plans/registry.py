"""Queries over the supplied tables, and their DuckDB SQL.

Cells are shaped from three tables:

``events``    key user_id, map family ``activity``: qualifier event_type, version ts in microseconds;
``orders``    key o_custkey, group family ``order``: status and priority, version o_orderdate, seq o_orderkey;
``lineitem``  key (l_orderkey LONG, l_linenumber INTEGER), family ``line``: quantity, version l_shipdate.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.functions import keys, synth
from wideframe.operators import filters, mutations, paging, results
from wideframe.plans import compiler
from wideframe.plans.layout import CellSchema, Family, KeyFormat, Layout, LocalityGroup
from wideframe.plans.request import ALL_VERSIONS, Column, DataRequest
from wideframe.sources import catalog, tables

Query = Callable[[SparkSession, str], DataFrame]

DAY = 86_400_000_000
#: 2024-01-05 and 2024-01-20, in microseconds.
T0, T1 = 1_704_412_800_000_000, 1_705_708_800_000_000
#: 1998-01-01, in microseconds, a clock for retention.
NOW = 883_612_800_000_000

EVENTS = "cells AS (SELECT user_id AS key, 'activity' AS family, event_type AS qualifier, epoch_us(ts) AS version, value FROM events)"
ORDERS = (
    "cells AS (SELECT o_custkey AS key, 'order' AS family, 'priority' AS qualifier, epoch_us(o_orderdate) AS version, o_orderpriority AS value, o_orderkey AS seq FROM orders "
    "UNION ALL SELECT o_custkey, 'order', 'status', epoch_us(o_orderdate), o_orderstatus, o_orderkey FROM orders)"
)
LINES = "cells AS (SELECT l_orderkey, l_linenumber, 'line' AS family, 'quantity' AS qualifier, epoch_us(l_shipdate) AS version, l_quantity AS value FROM lineitem)"
ALL = "key, family, qualifier, version, value"
#: 60-bit hash of a value as text.
HASH60 = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 15) AS BIGINT)"
_SEEDED = "'1:' || key"
#: One cell for each (cell, version), the last one written.
WRITTEN = "one AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY key, family, qualifier, version ORDER BY seq DESC) = 1)"
#: Latest cell of each column by version, then seq.
LAST = "QUALIFY row_number() OVER (PARTITION BY key, family, qualifier ORDER BY version DESC{seq}) <= {n}"

PAIR = KeyFormat(components=(("l_orderkey", "LONG"), ("l_linenumber", "INTEGER")), hash_size=2, range_scan_from=1)


def event_cells(spark: SparkSession, sf_dir: str, request: DataRequest | None = None) -> DataFrame:
    """Cells of events; with a request, only those of its time range, which the scan then skips by ``ts``."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows if request is None else tables.in_time(rows, "ts", request)
    return tables.cells(rows, "user_id", F.lit("activity"), "event_type", tables.micros("ts"), "value")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), tables.micros("o_orderdate").alias("version"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("qualifier"), F.col(c).alias("value")) for c in ("priority", "status")])).alias("c")
    return rows.select(F.col("o_custkey").alias("key"), F.lit("order").alias("family"), "version", F.col("o_orderkey").alias("seq"), each).select("key", "family", "c.qualifier", "version", "c.value", "seq")


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = keys.encode_key(PAIR, F.col("l_orderkey"), F.col("l_linenumber"))
    return tables.cells(rows, key, F.lit("line"), F.lit("quantity"), tables.micros("l_shipdate"), "l_quantity", l_orderkey="l_orderkey", l_linenumber="l_linenumber")


def order_layout(max_versions: int, ttl_seconds: int) -> Layout:
    family = Family("order", {"status": CellSchema(), "priority": CellSchema()})
    return Layout("orders", KeyFormat(components=(("custkey", "LONG"),)), {"main": LocalityGroup("main", {"order": family}, max_versions=max_versions, ttl_seconds=ttl_seconds)})


def _shown(cells: DataFrame) -> DataFrame:
    return cells.select(*compiler.CELL)


def _flat(cells: DataFrame) -> DataFrame:
    """Cells of nested row views, one row each."""
    rows = results.row_views(cells).select("key", F.explode("row").alias("family", "columns"))
    columns = rows.select("key", "family", F.explode("columns").alias("qualifier", "versions"))
    return columns.select("key", "family", "qualifier", F.explode("versions").alias("version", "value"))


def _events(spark: SparkSession, sf_dir: str, request: DataRequest) -> DataFrame:
    return compiler.read(event_cells(spark, sf_dir, request), request)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest two versions of every (user, event type) cell in a time range."""
    return _events(spark, sf_dir, DataRequest.of("activity", max_versions=2, min_version=T0, max_version=T1))


_QUERIES: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = (function, sql)
        return function

    return add


# reads ---------------------------------------------------------------------------------


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE version >= {T0} AND version < {T1} {LAST.format(seq='', n=2)}")
def top_n_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells {LAST.format(seq='', n=1)}")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.read(event_cells(spark, sf_dir), DataRequest.of("activity"))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE version >= {T0} AND version < {T1}")
def time_range_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, DataRequest.of("activity", max_versions=ALL_VERSIONS, min_version=T0, max_version=T1))


@_query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, version, value FROM cells WHERE version = {NOW - 700 * DAY}")
def exact_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.exact_version(line_cells(spark, sf_dir), NOW - 700 * DAY).select("l_orderkey", "l_linenumber", "version", "value")


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE key = 7 {LAST.format(seq='', n=3)}")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.get(event_cells(spark, sf_dir), 7, DataRequest.of("activity", max_versions=3))


@_query(f"WITH {EVENTS}, wanted(ordinal, key) AS (VALUES (0, 3), (1, 5), (2, 5), (3, 1000000000)), found AS (SELECT {ALL} FROM cells {LAST.format(seq='', n=1)}) SELECT ordinal, w.key, family, qualifier, version, value FROM wanted w LEFT JOIN found f ON w.key = f.key")
def bulk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, 3), (1, 5), (2, 5), (3, 10**9)], "ordinal int, key bigint")
    return compiler.bulk_get(event_cells(spark, sf_dir), wanted, DataRequest.of("activity")).select("ordinal", *compiler.CELL)


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE key >= 10 AND key < 50 {LAST.format(seq='', n=1)}")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.scan(event_cells(spark, sf_dir), DataRequest.of("activity"), start=10, stop=50)


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE key IN (SELECT DISTINCT key FROM cells ORDER BY key LIMIT 25) {LAST.format(seq='', n=1)}")
def row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.read(paging.row_limit(event_cells(spark, sf_dir), 25), DataRequest.of("activity"))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE {HASH60.format('key')} >= {1 << 58} AND {HASH60.format('key')} < {3 << 58} {LAST.format(seq='', n=1)}")
def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.token_scan(event_cells(spark, sf_dir), DataRequest.of("activity"), start=1 << 58, stop=3 << 58)


@_query(f"WITH {ORDERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key, family, qualifier ORDER BY version DESC, seq DESC) AS n FROM cells) SELECT {ALL} FROM ranked WHERE n <= CASE qualifier WHEN 'status' THEN 3 ELSE 1 END")
def mixed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = DataRequest((Column("order", "status", max_versions=3), Column("order", "priority")))
    return _shown(compiler.read(order_cells(spark, sf_dir), request))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE qualifier IN ('click', 'purchase') AND version >= {T0} AND version < {T1 + DAY} {LAST.format(seq='', n=4)}")
def merged_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = DataRequest.of("activity:click", max_versions=2, min_version=T0, max_version=T1)
    other = DataRequest.of("activity:click", "activity:purchase", max_versions=4, min_version=T0 + DAY, max_version=T1 + DAY)
    return _events(spark, sf_dir, one.merge(other))


@_query("SELECT DISTINCT user_id AS key FROM events UNION SELECT o_custkey FROM orders")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.entity_ids(event_cells(spark, sf_dir), order_cells(spark, sf_dir))


# row filters -----------------------------------------------------------------------------

_PURCHASES = "key IN (SELECT key FROM cells WHERE qualifier = 'purchase')"


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE {_PURCHASES} {LAST.format(seq='', n=1)}")
def has_column_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.read(event_cells(spark, sf_dir), DataRequest.of("activity"), row_filter=filters.HasColumnData("activity", "purchase"))


@_query(f"WITH {ORDERS}, latest AS (SELECT * FROM cells {LAST.format(seq=', seq DESC', n=1)}) SELECT {ALL} FROM latest WHERE key IN (SELECT key FROM latest WHERE qualifier = 'status' AND value = 'F')")
def column_value_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return _shown(compiler.read(cells, DataRequest.of("order"), row_filter=filters.ColumnValueEquals("order", "status", "F")))


@_query(
    f"WITH {ORDERS}, latest AS (SELECT * FROM cells {LAST.format(seq=', seq DESC', n=1)}) SELECT {ALL} FROM latest WHERE key IN (SELECT key FROM latest WHERE qualifier = 'status' AND value IN ('F', 'P')) "
    "AND key IN (SELECT key FROM latest WHERE qualifier = 'priority' AND value = '1-URGENT')"
)
def and_or_row_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = filters.ColumnValueEquals("order", "status", "F") | filters.ColumnValueEquals("order", "status", "P")
    both = status & filters.ColumnValueEquals("order", "priority", "1-URGENT")
    return _shown(compiler.read(order_cells(spark, sf_dir), DataRequest.of("order"), row_filter=both))


@_query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, family, qualifier, version, value FROM cells WHERE l_linenumber = 2")
def formatted_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compiler.read(line_cells(spark, sf_dir), DataRequest.of("line", max_versions=ALL_VERSIONS), row_filter=filters.KeyComponents((("l_orderkey", None), ("l_linenumber", 2))))
    return found.select("l_orderkey", "l_linenumber", "family", "qualifier", "version", "value")


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE {HASH60.format(_SEEDED)} < {1 << 59} {LAST.format(seq='', n=1)}")
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.read(event_cells(spark, sf_dir), DataRequest.of("activity"), row_filter=filters.RandomRows(0.5, seed=1))


@_query(f"WITH {EVENTS} SELECT key, family, qualifier, version, CAST(NULL AS DOUBLE) AS value FROM cells {LAST.format(seq='', n=1)}")
def keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.read(event_cells(spark, sf_dir), DataRequest.of("activity"), row_filter=filters.StripRowValues())


# column filters --------------------------------------------------------------------------


def _filtered(spark: SparkSession, sf_dir: str, column_filter: filters.ColumnFilter) -> DataFrame:
    return compiler.read(event_cells(spark, sf_dir), DataRequest((Column("activity", filter=column_filter),)))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE regexp_matches(qualifier, '^(?:[cp])') {LAST.format(seq='', n=1)}")
def qualifier_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.QualifierRegex("[cp]"))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE qualifier >= 'c' AND qualifier < 'purchase' {LAST.format(seq='', n=1)}")
def qualifier_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.QualifierRange("c", True, "purchase", False))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE (qualifier >= 'p' AND regexp_matches(qualifier, '^(?:.*e$)')) OR qualifier <= 'click' {LAST.format(seq='', n=1)}")
def and_or_column_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, (filters.QualifierRange("p") & filters.QualifierRegex(".*e$")) | filters.QualifierRange(high="click", high_inclusive=True))


@_query(f"WITH {EVENTS} SELECT key, family, qualifier, version, CAST(NULL AS DOUBLE) AS value FROM cells {LAST.format(seq='', n=1)}")
def strip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.StripValues())


@_query(f"WITH {EVENTS}, names AS (SELECT *, dense_rank() OVER (PARTITION BY key, family ORDER BY qualifier) AS n FROM cells) SELECT {ALL} FROM names WHERE n <= 2")
def first_n_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.first_qualifiers(event_cells(spark, sf_dir), 2)


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells QUALIFY row_number() OVER (PARTITION BY key ORDER BY family, qualifier, version DESC) = 1")
def first_key_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.first_key_only(event_cells(spark, sf_dir))


@_query(f"WITH {EVENTS}, names AS (SELECT *, dense_rank() OVER (PARTITION BY key, family ORDER BY qualifier) AS n FROM cells WHERE qualifier >= 'c') SELECT {ALL} FROM names WHERE n <= 2 {LAST.format(seq='', n=3)}")
def first_qualifiers_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First qualifiers of those that an inner filter leaves, within a request."""
    request = DataRequest((Column("activity", max_versions=3, filter=filters.FirstQualifiers(2, filters.QualifierRange("c"))),))
    return compiler.read(event_cells(spark, sf_dir), request)


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE qualifier >= 'c' QUALIFY row_number() OVER (PARTITION BY key ORDER BY family, qualifier, version DESC) = 1")
def first_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.QualifierRange("c") & filters.FirstKeyOnly())


@_query(f"WITH {EVENTS} SELECT key, family, qualifier, version, CAST(8 AS DOUBLE) AS value FROM cells {LAST.format(seq='', n=1)}")
def byte_sizes_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filters.ByteSizes())


@_query(f"WITH {EVENTS} SELECT key, family, qualifier, version, CAST(trunc(value) AS INTEGER) AS value FROM cells WHERE qualifier = 'purchase' {LAST.format(seq='', n=1)}")
def read_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column read as another type than it is stored as."""
    return compiler.read(event_cells(spark, sf_dir), DataRequest((Column("activity", "purchase", reader="int"),)))


@_query("SELECT conv_id AS key, role AS qualifier, turn AS version, CAST(strlen(text) AS INTEGER) AS n_bytes FROM conversations")
def cell_byte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.cells(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", F.lit("turn"), "role", "turn", "text")
    return cells.select("key", "qualifier", "version", filters.encoded_size(F.col("value"), "string").alias("n_bytes"))


# helpers on results ----------------------------------------------------------------------


@_query(f"WITH {EVENTS} SELECT key, family, qualifier, count(*) AS n_cells FROM cells GROUP BY ALL")
def count_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.count_columns(event_cells(spark, sf_dir))


@_query(f"WITH {EVENTS} SELECT key, family, string_agg(DISTINCT qualifier, ',' ORDER BY qualifier) AS qualifiers FROM cells GROUP BY key, family")
def distinct_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.qualifiers(event_cells(spark, sf_dir)).withColumn("qualifiers", F.array_join("qualifiers", ","))


@_query(f"WITH {EVENTS} SELECT key, family, qualifier, count(DISTINCT version) AS n_versions, max(version) AS newest, min(version) AS oldest FROM cells GROUP BY ALL")
def distinct_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = results.timestamps(event_cells(spark, sf_dir))
    return made.select("key", "family", "qualifier", F.size("versions").cast("bigint").alias("n_versions"), F.element_at("versions", 1).alias("newest"), F.element_at("versions", -1).alias("oldest"))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells QUALIFY row_number() OVER (PARTITION BY key ORDER BY family, qualifier, version DESC) = 1")
def first_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_cell(event_cells(spark, sf_dir))


@_query(f"WITH {EVENTS} SELECT key, bool_or(qualifier = 'purchase') AS present FROM cells GROUP BY key")
def contains_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.contains(event_cells(spark, sf_dir), "activity:purchase")


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE version >= {T0} AND version < {T1} AND qualifier = 'click' {LAST.format(seq='', n=2)}")
def narrow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.narrow(flagship(spark, sf_dir), "activity:click")


@_query(f"WITH {EVENTS} SELECT key, family || ':' || qualifier AS column FROM cells")
def column_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.project(event_cells(spark, sf_dir), "column")


@_query(f"WITH {EVENTS} SELECT key, version FROM cells")
def version_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.project(event_cells(spark, sf_dir), "version")


@_query(f"WITH {EVENTS} SELECT key, value FROM cells")
def value_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.project(event_cells(spark, sf_dir), "value")


@_query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') NULLS FIRST, o_orderkey) AS place FROM orders")
def key_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of keys by their components, nulls first."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return results.by_components(rows, ["status", "o_orderkey"])


@_query(
    f"WITH {EVENTS}, known(schema_id, schema) AS (VALUES (4, '\"int\"'), (5, '\"string\"'), (8, '\"double\"')) "
    "SELECT key, qualifier, version, schema FROM (SELECT *, length(qualifier) AS schema_id FROM cells) LEFT JOIN known USING (schema_id)"
)
def schemas_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their writers' schemas."""
    known = spark.createDataFrame([(4, '"int"'), (5, '"string"'), (8, '"double"')], "schema_id int, schema string")
    cells = event_cells(spark, sf_dir).withColumn("schema_id", F.length("qualifier"))
    return catalog.with_schemas(cells, known).select("key", "qualifier", "version", "schema")


@_query(f"WITH {EVENTS} SELECT key, family, qualifier, count(*) AS n, max_by(value, version) AS newest, min_by(value, version) AS oldest FROM cells GROUP BY ALL")
def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = results.materialize(event_cells(spark, sf_dir))
    return made.select("key", "family", "qualifier", F.size("cells").cast("bigint").alias("n"), F.element_at("cells", 1)["value"].alias("newest"), F.element_at("cells", -1)["value"].alias("oldest"))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells")
def row_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(event_cells(spark, sf_dir))


@_query(f"WITH {ORDERS} SELECT key, max_by(value, (version, seq)) FILTER (qualifier = 'status') AS status, max_by(value, (version, seq)) FILTER (qualifier = 'priority') AS priority FROM cells GROUP BY key")
def group_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.group_family(order_cells(spark, sf_dir), "order", ["status", "priority"])


# paging ----------------------------------------------------------------------------------


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells QUALIFY row_number() OVER (PARTITION BY key, family, qualifier ORDER BY version DESC) BETWEEN 3 AND 4")
def version_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.version_page(event_cells(spark, sf_dir), 1, 2)


@_query(
    f"WITH {EVENTS}, clicks AS (SELECT * FROM cells WHERE qualifier = 'click' AND version >= {T0} {LAST.format(seq='', n=5)}) "
    f"SELECT {ALL} FROM clicks QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) BETWEEN 3 AND 4"
)
def paged_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a request's paged column, of every row."""
    request = DataRequest((Column("activity", "click", max_versions=5, page_size=2), Column("activity", "view")), min_version=T0)
    return paging.page(event_cells(spark, sf_dir, request), request, 1)


@_query(f"WITH {EVENTS}, latest AS (SELECT * FROM cells {LAST.format(seq='', n=1)}) SELECT {ALL} FROM latest QUALIFY row_number() OVER (PARTITION BY key, family ORDER BY qualifier) BETWEEN 3 AND 4")
def paged_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a family's qualifiers, with their newest cells."""
    return paging.page(event_cells(spark, sf_dir), DataRequest.of("activity", page_size=2), 1)


@_query(f"WITH {EVENTS}, names AS (SELECT DISTINCT key, family, qualifier FROM cells) SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY key, family ORDER BY qualifier) BETWEEN 3 AND 4")
def qualifier_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.qualifier_page(event_cells(spark, sf_dir), 1, 2)


@_query(f"WITH {EVENTS}, names AS (SELECT DISTINCT key, family, qualifier FROM cells), page AS (SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY key, family ORDER BY qualifier) <= 3) SELECT key, family, string_agg(qualifier, ',' ORDER BY qualifier) AS qualifiers FROM page GROUP BY key, family")
def family_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.family_page(event_cells(spark, sf_dir), 0, 3).withColumn("qualifiers", F.array_join("qualifiers", ","))


# mutations -------------------------------------------------------------------------------


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE key NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 12").select(F.col("s_suppkey").alias("key"))
    return mutations.delete(event_cells(spark, sf_dir), gone, "row")


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE version > {T0}")
def delete_family_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(spark, sf_dir)
    return mutations.delete(cells, cells.select("key", "family"), "family", up_to=T0)


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE NOT (qualifier = 'click' AND version <= {T1})")
def delete_column_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(spark, sf_dir)
    return mutations.delete(cells, cells.where("qualifier = 'click'"), "column", up_to=T1)


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells QUALIFY row_number() OVER (PARTITION BY key, family, qualifier ORDER BY version DESC) > 1")
def delete_latest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(spark, sf_dir)
    return mutations.delete_cell(cells, cells.select("key", "family", "qualifier"))


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE version < {T0} OR version >= {T1}")
def delete_exact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(spark, sf_dir)
    return mutations.delete_cell(cells, cells.where(compiler.in_time(DataRequest(min_version=T0, max_version=T1))))


@_query(f"WITH {ORDERS} SELECT {ALL} FROM cells QUALIFY row_number() OVER (PARTITION BY key, family, qualifier, version ORDER BY seq DESC) = 1")
def put_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return _shown(mutations.put(mutations.last_write(cells.where("seq % 2 = 0")), cells.where("seq % 2 = 1")))


@_query(f"WITH {ORDERS}, {WRITTEN} SELECT key, family, qualifier, version, CASE WHEN qualifier = 'status' AND value = 'O' THEN 'X' ELSE value END AS value FROM one")
def put_over_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes without ``seq`` over existing versions."""
    cells = mutations.last_write(order_cells(spark, sf_dir))
    return _shown(mutations.put(cells, cells.where("qualifier = 'status' and value = 'O'").withColumn("value", F.lit("X")).drop("seq")))


@_query(f"SELECT key, family, qualifier, {NOW} AS version, value FROM (SELECT user_id AS key, 'count' AS family, event_type AS qualifier, count(*) AS value FROM events GROUP BY ALL)")
def counter_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = event_cells(spark, sf_dir).select("key", F.lit("count").alias("family"), "qualifier", F.lit(1).cast("bigint").alias("delta"))
    none = spark.createDataFrame([], "key bigint, family string, qualifier string, version bigint, value bigint")
    return mutations.increment(none, deltas, NOW)


@_query(f"SELECT user_id AS key, 'count' AS family, event_type AS qualifier, {T0} AS version, 2 * count(*) AS value FROM events GROUP BY ALL")
def increment_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that are there already, with a newest version after the clock and a ``seq``."""
    events = event_cells(spark, sf_dir).select("key", F.lit("count").alias("family"), "qualifier")
    counters = events.groupBy("key", "family", "qualifier").agg(F.count(F.lit(1)).alias("value")).select("key", "family", "qualifier", F.lit(T0).alias("version"), "value", F.lit(9).cast("bigint").alias("seq"))
    return _shown(mutations.increment(counters, events.withColumn("delta", F.lit(1).cast("bigint")), T0 - DAY))


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    writes = order_cells(spark, sf_dir)
    cells = mutations.last_write(writes)
    expected = writes.select("key").distinct().select("key", F.lit("order").alias("family"), F.lit("status").alias("qualifier"), F.lit("O").alias("value"))
    puts = expected.select("key", "family", "qualifier", F.lit(NOW + 1).alias("version"), F.lit("X").alias("value"))
    return mutations.check_and_put(cells, expected, puts)


@_query(f"WITH {ORDERS}, latest AS (SELECT * FROM cells {LAST.format(seq=', seq DESC', n=1)}) SELECT key, bool_or(qualifier = 'status' AND value = 'O') AS committed FROM latest GROUP BY key")
def check_and_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[1]


@_query(
    f"WITH {ORDERS}, {WRITTEN}, latest AS (SELECT * FROM cells {LAST.format(seq=', seq DESC', n=1)}) SELECT {ALL} FROM one "
    f"UNION ALL SELECT key, 'order', 'status', {NOW + 1}, 'X' FROM latest WHERE qualifier = 'status' AND value = 'O'"
)
def check_and_put_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's cells after such writes."""
    return _shown(_checked(spark, sf_dir)[0])


@_query(f"WITH {EVENTS} SELECT {ALL} FROM cells WHERE qualifier <> 'view' UNION ALL SELECT key, family, qualifier, version, -1.0 FROM cells WHERE qualifier = 'view' AND version >= {T1}")
def flush_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(spark, sf_dir)
    view = cells.where("qualifier = 'view'")
    return mutations.flush(cells, [("column", view)], [view.where(F.col("version") >= T1).withColumn("value", F.lit(-1.0))])


@_query(
    f"WITH {EVENTS} SELECT key, family, qualifier, version, CASE WHEN qualifier = 'view' THEN -1.0 WHEN qualifier = 'purchase' AND version >= {T1 + DAY} THEN 7.0 ELSE value END AS value FROM cells "
    f"WHERE CASE qualifier WHEN 'view' THEN version > {T0 - 2 * DAY} WHEN 'click' THEN version > {T1} WHEN 'purchase' THEN version > {T0} AND (version < {T1} OR version >= {T1 + DAY}) ELSE version > {T0} END"
)
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to T0, a re-put column, families up to an earlier time, a column up to T1, exact cells, and puts after it all."""
    cells = event_cells(spark, sf_dir)
    named = lambda rows, op, seq, *columns: rows.select(F.lit(op).alias("op"), *columns, F.lit(seq).cast("bigint").alias("seq"))
    view, purchase = cells.where("qualifier = 'view'"), cells.where("qualifier = 'purchase'")
    log = [
        named(cells.select("key").distinct(), "delete_row", 1, "key", F.lit(T0).alias("version")),
        named(view.withColumn("value", F.lit(-1.0)), "put", 2, *compiler.CELL),
        named(cells.select("key", "family").distinct(), "delete_family", 3, "key", "family", F.lit(T0 - 2 * DAY).alias("version")),
        named(cells.where("qualifier = 'click'").select("key", "family", "qualifier").distinct(), "delete_column", 4, "key", "family", "qualifier", F.lit(T1).alias("version")),
        named(purchase.where(F.col("version") >= T1), "delete_cell", 5, "key", "family", "qualifier", "version"),
        named(purchase.where(F.col("version") >= T1 + DAY).withColumn("value", F.lit(7.0)), "put", 6, *compiler.CELL),
    ]
    return _shown(mutations.replay(cells, functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), log)))


@_query(f"WITH {ORDERS} SELECT {ALL} FROM cells {LAST.format(seq=', seq DESC', n=2)}")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(mutations.retain(order_cells(spark, sf_dir), order_layout(2, 2**31 - 1), NOW, per_second=1_000_000))


@_query(
    f"WITH {ORDERS}, kept AS (SELECT * FROM cells {LAST.format(seq=', seq DESC', n=3)}), live AS (SELECT * FROM kept WHERE version >= {NOW - 900 * DAY}) "
    f"SELECT {ALL} FROM live WHERE qualifier = 'status' {LAST.format(seq=', seq DESC', n=2)}"
)
def retained_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of what a table retains."""
    request, layout = DataRequest.of("order:status", max_versions=2), order_layout(3, 900 * 86400)
    return _shown(compiler.read(order_cells(spark, sf_dir), request, layout, now=NOW, per_second=1_000_000))


@_query(f"WITH {ORDERS} SELECT {ALL} FROM cells WHERE version >= {NOW - 400 * DAY}")
def time_to_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(mutations.retain(order_cells(spark, sf_dir), order_layout(2**31 - 1, 400 * 86400), NOW, per_second=1_000_000))


# keys ------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS prefix, md5(CAST(o_orderkey AS VARCHAR)) AS hash FROM orders")
def key_hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.col("o_orderkey").cast("string")
    prefixed = keys.encode_key(KeyFormat("hash_prefix", hash_size=2), text)
    whole = keys.encode_key(KeyFormat("hash"), text)
    return rows.select("o_orderkey", F.lower(F.hex(F.substring(prefixed, 1, 2))).alias("prefix"), F.lower(F.hex(whole)).alias("hash"))


@_query("SELECT l_orderkey, l_linenumber, printf('%016x', CAST(l_orderkey AS HUGEINT) + 9223372036854775808) || printf('%08x', CAST(l_linenumber AS BIGINT) + 2147483648) AS tail FROM lineitem")
def key_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = line_cells(spark, sf_dir)
    return cells.select("l_orderkey", "l_linenumber", F.lower(F.hex(F.substring("key", 3, 12))).alias("tail"))


_LONG, _INT = "printf('%016x', CAST(l_orderkey AS HUGEINT) + 9223372036854775808)", "printf('%08x', CAST(l_linenumber AS BIGINT) + 2147483648)"


@_query(f"SELECT l_orderkey, l_linenumber, substr(md5(unhex({_LONG})), 1, 4) || {_LONG} || {_INT} AS key_hex FROM lineitem")
def key_encode_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted keys with the hash that they begin with."""
    return line_cells(spark, sf_dir).select("l_orderkey", "l_linenumber", F.lower(F.hex("key")).alias("key_hex"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem")
def key_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cells(spark, sf_dir).select(*keys.decode_columns(PAIR, F.col("key")))


@_query("SELECT c_name, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def key_decode_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text components, the last of which may be missing."""
    fmt = KeyFormat(components=(("c_name", "STRING"), ("c_nationkey", "INTEGER"), ("c_mktsegment", "STRING")), hash_size=4, nullable_from=2)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = keys.encode_key(fmt, F.col("c_name"), F.col("c_nationkey"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return rows.select(key.alias("key")).select(*keys.decode_columns(fmt, F.col("key")))


@_query(f"SELECT CAST('0x' || substr(md5(unhex({_LONG})), 1, 1) AS INTEGER) AS region, count(*) AS n_keys FROM lineitem GROUP BY region")
def split_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in each of 16 equal regions of the hashed key space."""
    region = keys.region_of(F.col("key"), keys.splits(16, PAIR.hash_size))
    return line_cells(spark, sf_dir).groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n_keys"))


NAMES, HOSTS = ["Ada", "Bo", "Cy", "Di", "Ed"], ["mail.example.com", "post.example.org"]


def _picked(names: list[str], seed: int) -> str:
    return f"list_extract({names!r}, CAST({HASH60.format(f"'{seed}:' || key")} % {len(names)} AS INTEGER) + 1)"


_USERS = f"users AS (SELECT c_custkey AS key, {_picked(NAMES, 3)} || ' ' || {_picked(NAMES, 4)} AS name, lower({_picked(NAMES, 3)}) || '.' || lower({_picked(NAMES, 4)}) || '@' || {_picked(HOSTS, 5)} AS email FROM customer)"


@_query(f"WITH {_USERS} SELECT key, name, email FROM users")
def synthetic_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and mail addresses drawn by key and seed."""
    key = F.col("key")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return rows.select("key", synth.ngram(NAMES, 2, 3, key).alias("name"), synth.email(NAMES, HOSTS, 3, key).alias("email"))


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
