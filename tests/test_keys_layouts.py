"""Key codecs, layouts and their evolution, schema compatibility, the catalog."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wideframe.functions import keys, schemas
from wideframe.plans.layout import CellSchema, Family, KeyFormat, Layout, LayoutError, LocalityGroup, check_write, update
from wideframe.sources import files, tables
from wideframe.sources.catalog import CatalogError, Instance, make_uri, parse_uri, resolve_uri

FORMAT = KeyFormat(components=(("a", "INTEGER"), ("b", "LONG"), ("c", "STRING")), hash_size=3, nullable_from=1, range_scan_from=2)


def test_key_expression_equals_the_codec(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([0, -1, 2**31 - 1, -(2**31), rnd.randrange(1000)]), rnd.choice([0, 2**63 - 1, -(2**63), rnd.randrange(10**12)]), rnd.choice(["", "é", "x" * 9])) for _ in range(60)]
    rows += [(1, None, None), (1, 5, None)]
    made = spark.createDataFrame(rows, "a int, b bigint, c string").withColumn("key", keys.encode_key(FORMAT, F.col("a"), F.col("b"), F.col("c")))
    for r in made.collect():
        assert bytes(r["key"]) == keys.encode(FORMAT, [r["a"], r["b"], r["c"]])
        assert keys.decode(FORMAT, bytes(r["key"])) == [r["a"], r["b"], r["c"]]


def test_encoded_numbers_keep_their_order():
    plain = KeyFormat(components=(("a", "STRING"), ("n", "LONG")), range_scan_from=1)
    numbers = [-(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    encoded = [keys.encode(plain, ["k", n]) for n in numbers]
    assert encoded == sorted(encoded)


@pytest.mark.parametrize("bad", [[None, 1, "x"], [1, None, "x"], [1, 2, "a\0b"], [1, 2, "x", 4]])
def test_bad_components(bad):
    with pytest.raises(ValueError):
        keys.encode(FORMAT, bad)


def test_parsed_keys():
    assert keys.parse_key("hex:0aff", FORMAT) == b"\x0a\xff"
    assert keys.parse_key("url:%0Aab", FORMAT) == b"\x0aab"
    assert keys.parse_key('[1, 2, "x"]', FORMAT) == keys.encode(FORMAT, [1, 2, "x"])
    assert keys.parse_key('[1, [], "x"]', FORMAT) == [1, None, "x"]
    with pytest.raises(ValueError):
        keys.parse_key('["one"]', FORMAT)


def test_splits_and_varints():
    assert keys.splits(4, 1) == [b"\x40", b"\x80", b"\xc0"]
    for n in (0, 1, -1, 300, -(2**63), 2**63 - 1):
        data = keys.varint(n)
        assert keys.read_varint(b"?" + data + b"!", 1) == (n, 1 + len(data))


@pytest.mark.parametrize("bad", [{"hash_size": 0}, {"hash_size": 17}, {"components": ()}, {"nullable_from": 0}, {"range_scan_from": 0}, {"suppress_materialization": True}, {"components": (("a", "INTEGER"), ("a", "LONG"))}])
def test_bad_key_formats(bad):
    with pytest.raises(LayoutError):
        replace(FORMAT, **bad)


def layout(**changes):
    info = Family("info", {"name": CellSchema(), "count": CellSchema("counter", storage="FINAL")})
    made = Layout("users", FORMAT, {"main": LocalityGroup("main", {"info": info}), "mem": LocalityGroup("mem", {"tags": Family("tags", map_schema=CellSchema(value="int"))}, max_versions=1)})
    return replace(made, **changes)


def test_layout_json_round_trip():
    assert Layout.from_json(layout().to_json()) == layout()


def test_layout_update():
    now = layout()
    more = replace(now.groups["main"], families={"info": replace(now.family("info"), columns=now.family("info").columns | {"mail": CellSchema()})})
    made = update(now, replace(now, groups=now.groups | {"main": more}, reference_id="1"))
    assert made.layout_id == "2" and "mail" in made.family("info").columns
    moved = replace(now.groups["mem"], families={"labels": replace(now.family("tags"), name="labels")})
    assert update(now, replace(now, groups=now.groups | {"mem": moved}, reference_id="1"), renamed={"mem.labels": "mem.tags"}).family("labels").is_map


@pytest.mark.parametrize(
    "change",
    [
        lambda x: replace(x, reference_id="7"),
        lambda x: replace(x, name="other"),
        lambda x: replace(x, key=KeyFormat()),
        lambda x: replace(x, groups={"main": x.groups["main"]}),
        lambda x: replace(x, groups=x.groups | {"mem": replace(x.groups["mem"], families={"tags": Family("tags", {"a": CellSchema()})})}),
        lambda x: replace(x, groups=x.groups | {"main": replace(x.groups["main"], families={"info": replace(x.family("info"), columns={"name": CellSchema(storage="HASH"), "count": x.family("info").columns["count"]})})}),
        lambda x: replace(x, groups=x.groups | {"main": replace(x.groups["main"], families={"info": replace(x.family("info"), columns={"name": CellSchema(), "count": CellSchema(storage="FINAL")})})}),
    ],
)
def test_forbidden_updates(change):
    with pytest.raises(LayoutError):
        update(layout(), change(layout(reference_id="1")))


def test_write_policies():
    declared = replace(layout(), policy="STRICT")
    with pytest.raises(LayoutError):
        check_write(declared, "info", "name", "string")
    grown = check_write(replace(declared, policy="DEVELOPER"), "info", "name", "string")
    assert grown.schema_of("info", "name").writers == ("string",)
    assert check_write(replace(declared, policy="NONE"), "info", "name", "long").schema_of("info", "name").writers == ()


RECORD = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "string"}]}


@pytest.mark.parametrize(
    ("reader", "writer", "ok"),
    [
        ("long", "int", True), ("int", "long", False), ("double", "float", True), ("string", "bytes", False),
        (["null", "long"], "int", True), ("long", ["int", "long"], True), ("int", ["int", "null"], False), (["int"], "int", True),
        ({"type": "array", "items": "double"}, {"type": "array", "items": "int"}, True), ({"type": "map", "values": "int"}, {"type": "map", "values": "string"}, False),
        ({"type": "enum", "name": "E", "symbols": ["A", "B"]}, {"type": "enum", "name": "E", "symbols": ["A"]}, True),
        ({"type": "enum", "name": "E", "symbols": ["A"]}, {"type": "enum", "name": "E", "symbols": ["A", "B"]}, False),
        (RECORD | {"fields": [*RECORD["fields"], {"name": "b", "type": "int", "default": 0}]}, RECORD, True),
        (RECORD | {"fields": [*RECORD["fields"], {"name": "b", "type": "int"}]}, RECORD, False),
        ({"type": "fixed", "name": "F", "size": 2}, {"type": "fixed", "name": "F", "size": 3}, False),
    ],
)
def test_schema_compatibility(reader, writer, ok):
    assert schemas.can_read(reader, writer) is ok


def test_recursive_records_end():
    node = {"type": "record", "name": "N", "fields": [{"name": "next", "type": ["null", "N"]}]}
    assert schemas.can_read(node, node)


def test_values_to_json_and_back():
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "string"]}, {"name": "b", "type": {"type": "array", "items": "bytes"}}, {"name": "c", "type": "int", "default": 4}]}
    value = {"a": "x", "b": [b"\0\1"], "c": 5}
    assert schemas.from_json(schemas.to_json(value, schema), schema) == value
    assert schemas.from_json({"a": None, "b": []}, schema) == {"a": None, "b": [], "c": 4}
    with pytest.raises(ValueError):
        schemas.from_json({"a": None, "b": [], "z": 1}, schema)


def test_catalog(spark, tmp_path):
    home = Instance(spark, f"file://{tmp_path}/i").install()
    cells = spark.createDataFrame([(k, f, "q", 1, str(k)) for k in range(20) for f in ("info", "tags")], "key bigint, family string, qualifier string, version bigint, value string")
    home.create(layout(), cells, regions=2)
    assert home.tables() == ["users"] and home.cells("users").count() == 40
    plan = home.cells("users", ["tags"])
    assert {r["family"] for r in plan.collect()} == {"tags"}
    assert "(locality_group#" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(CatalogError):
        home.create(layout())
    grown = home.modify(replace(layout(reference_id="1"), description="new"), dry_run=True)
    assert grown.layout_id == "2" and len(home.layouts("users")) == 1
    home.modify(replace(layout(reference_id="1"), description="new"))
    assert home.layout("users").description == "new"
    assert [home.schema_id(s) for s in ("null", "bytes", ["null", "int"], ["null", "int"])] == [0, 7, 8, 8]
    assert home.schema_by_hash(home.schema_hash(["null", "int"])) == ["null", "int"]
    for v in (1, 3, 2):
        home.put_value("users", "k", str(v), v)
    assert home.values("users", "k", 2) == [(3, "3"), (2, "2")]
    home.annotate("users", "owner", "me")
    home.annotate("users", "owned_by", "you", "info:name")
    assert home.notes("users", prefix="own") == {("", "owner"): "me", ("info:name", "owned_by"): "you"}
    assert home.notes("users", column="info:name", pattern="^owned") == {("info:name", "owned_by"): "you"}
    home.export_metadata(f"file://{tmp_path}/backup")
    other = Instance(spark, f"file://{tmp_path}/j").install()
    other.restore_metadata(f"file://{tmp_path}/backup")
    assert other.tables() == ["users"] and other.notes("users") == home.notes("users")
    home.drop("users")
    assert home.tables() == []


def test_addresses():
    made = parse_uri("wide://h1:1,h2:2/default/users/info:name,tags")
    assert made == {"scheme": "wide", "hosts": ["h1:1", "h2:2"], "instance": "default", "table": "users", "columns": ["info:name", "tags"]}
    with pytest.raises(ValueError):
        parse_uri("no address")


def test_file_types(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"Obj\x01rest")
    (tmp_path / "d" / "b").write_text("words")
    found = {r["path"][-1]: r["type"] for r in files.file_types(spark, f"file://{tmp_path}/d").collect()}
    assert found == {"a": "avro", "b": "text"}
    spark.range(3).write.parquet(str(tmp_path / "p"))
    (part,) = (tmp_path / "p").glob("*.parquet") if len(list((tmp_path / "p").glob("*.parquet"))) == 1 else [next((tmp_path / "p").glob("*.parquet"))]
    assert files.read_any(spark, f"file://{part}").columns == ["id"]


def test_unpivot_skips_nulls(spark):
    rows = spark.createDataFrame([(1, "a", None, 5)], "k bigint, x string, y string, t bigint")
    made = tables.unpivot(rows, "k", "f", ["x", "y"], "t").collect()
    assert [tuple(r) for r in made] == [(1, "f", "x", 5, "a")]


def test_keys_decode_as_columns(spark):
    fmt = KeyFormat(components=(("a", "STRING"), ("b", "LONG"), ("c", "STRING"), ("d", "INTEGER")), hash_size=3, nullable_from=1)
    rows = [["", -(2**63), "é世", -(2**31)], ["x" * 70, 2**63 - 1, "\x01", 2**31 - 1], ["a", 0, None, None], ["\x10\x01", None, None, None], ["q", 5, "", 0]]
    made = spark.createDataFrame([(keys.encode(fmt, r),) for r in rows], "key binary").select(*keys.decode_columns(fmt, F.col("key")))
    assert [list(r) for r in made.collect()] == rows
    with pytest.raises(ValueError):
        keys.decode_columns(KeyFormat(suppress_materialization=True), F.col("key"))


def test_split_files(spark, tmp_path):
    (tmp_path / "s").write_text("hex:0a0b\n\nab\\x00c\nb\n")
    assert keys.read_splits(spark, str(tmp_path / "s")) == [b"\x0a\x0b", b"ab\x00c", b"b"]
    (tmp_path / "t").write_text("b\na\n")
    with pytest.raises(ValueError):
        keys.read_splits(spark, str(tmp_path / "t"))


def test_addresses_are_built_and_resolved():
    assert make_uri("wide", ["h:1", "g:2"], "i", "t", ["f:q", "g"]) == "wide://h:1,g:2/i/t/f:q,g"
    assert resolve_uri("wide://h:1/i", "t/f") == "wide://h:1/i/t/f" and resolve_uri("wide://h:1/i/", "t") == "wide://h:1/i/t"
    for bad in ((["h"], None, "t"), (["h"], "i", None, ["f"]), (["h"], "1x")):
        with pytest.raises(ValueError):
            make_uri("wide", *bad)


def test_writes_are_checked_and_retained(spark, tmp_path):
    home = Instance(spark, f"file://{tmp_path}/w").install()
    family = Family("info", {"a": CellSchema(readers=("string",)), "n": CellSchema()})
    home.create(Layout("t", groups={"main": LocalityGroup("main", {"info": family, "m": Family("m", map_schema=CellSchema())}, max_versions=1)}, policy="DEVELOPER"))
    cells = spark.createDataFrame([(1, "info", "a", 5, "x"), (1, "info", "a", 6, "y"), (1, "m", "any", 1, "z")], "key bigint, family string, qualifier string, version bigint, value string")
    made = home.check("t", cells)
    assert made.schema_of("info", "a").writers == ("string",) and home.layout("t").schema_of("m", "any").writers == ("string",) and len(home.layouts("t")) == 2
    assert home.check("t", cells) == home.layout("t") and len(home.layouts("t")) == 2
    with pytest.raises(CatalogError):
        home.check("t", cells.withColumn("qualifier", F.lit("unknown")).where("family = 'info'"))
    with pytest.raises(LayoutError):
        home.check("t", cells.where("family = 'info'"), "long")
    home.save("t", cells, now=10)
    assert sorted(r["version"] for r in home.cells("t").collect()) == [1, 6]


def test_hexadecimal_and_versions():
    assert keys.hexed(b"\x00\xff\x1a", ":") == "00:ff:1a" and keys.unhexed("00:FF:1a", ":") == keys.unhexed("00ff1a") == b"\x00\xff\x1a" and keys.unhexed("") == b""
    with pytest.raises(ValueError):
        keys.unhexed("0g")
    assert keys.protocol_version("layout-1.3") == ("layout", (1, 3, 0)) and keys.protocol_version("2") == ("", (2, 0, 0))
    assert keys.protocol_version("layout-1.10.1")[1] > keys.protocol_version("layout-1.9")[1]
    with pytest.raises(ValueError):
        keys.protocol_version("layout-x")


def test_only_the_version_before_stays(spark, tmp_path):
    home = Instance(spark, f"file://{tmp_path}/v").install()
    home.create(Layout("t", groups={"main": LocalityGroup("main", {"m": Family("m", map_schema=CellSchema())})}))
    for i in range(4):
        home.save("t", spark.createDataFrame([(1, "m", "q", i, "x")], "key bigint, family string, qualifier string, version bigint, value string"))
    assert home._list("tables/t/cells") == ["000002", "000003"] and home.cells("t").first()["version"] == 3
