"""Instances: tables with their layout history, schemas, system values, keys and notes.

An instance is a folder.  Metadata is small JSON read and written through Spark,
so that any file system that Spark reaches will do; a change writes a new numbered
version and is checked against the current one (single writer; no lock).
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import replace
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wideframe.functions import schemas
from wideframe.operators import mutations
from wideframe.plans.layout import Layout, check_write, update
from wideframe.sources import tables


class CatalogError(ValueError):
    """An instance, table or entry that is missing or already there."""


class Instance:
    """A namespace of tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._fs = None

    # files -------------------------------------------------------------------------

    def _hadoop(self, name: str) -> tuple[Any, Any]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._hadoop(name)
        return fs.exists(path)

    def _read(self, name: str) -> Any:
        if not self._exists(name):
            return None
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect()
        return json.loads(rows[0]["value"])

    def _write(self, name: str, value: Any) -> None:
        fs, path = self._hadoop(name)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def _delete(self, name: str) -> None:
        fs, path = self._hadoop(name)
        fs.delete(path, True)

    def _list(self, name: str) -> list[str]:
        fs, path = self._hadoop(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    # instance ----------------------------------------------------------------------

    def install(self) -> Instance:
        if self._exists("system.json"):
            raise CatalogError(f"{self.path} is already installed")
        self._write("system.json", {"data-version": "1", "security-version": "0"})
        self._write("schemas.json", [schemas.canonical(p) for p in schemas.PRIMITIVES])
        return self

    def uninstall(self) -> None:
        self._delete("")

    def _open(self) -> None:
        if not self._exists("system.json"):
            raise CatalogError(f"{self.path} is not installed")

    # tables ------------------------------------------------------------------------

    def tables(self) -> list[str]:
        return [n for n in self._list("tables") if self._exists(f"tables/{n}/layouts")]

    def create(self, layout: Layout, first: DataFrame | None = None, regions: int | None = None) -> None:
        self._open()
        if layout.name in self.tables():
            raise CatalogError(f"table {layout.name!r} is already there")
        self._write(f"tables/{layout.name}/layouts/000000.json", json.loads(layout.to_json()))
        if first is not None:
            self.save(layout.name, first, regions)

    def drop(self, table: str) -> None:
        self.layout(table)
        self._delete(f"tables/{table}")

    def layouts(self, table: str) -> list[Layout]:
        """All layouts of a table, oldest first."""
        found = [Layout.from_json(json.dumps(self._read(f"tables/{table}/layouts/{n}"))) for n in self._list(f"tables/{table}/layouts") if n.endswith(".json")]
        if not found:
            raise CatalogError(f"no table {table!r}")
        return found

    def layout(self, table: str) -> Layout:
        return self.layouts(table)[-1]

    def modify(self, wanted: Layout, deleted: tuple[str, ...] = (), renamed: dict[str, str] | None = None, dry_run: bool = False) -> Layout:
        history = self.layouts(wanted.name)
        made = update(history[-1], wanted, deleted, renamed)
        if not dry_run:
            self._write(f"tables/{wanted.name}/layouts/{len(history):06d}.json", json.loads(made.to_json()))
        return made

    def check(self, table: str, cells: DataFrame, schema: Any = None) -> Layout:
        """Raises if cells to be written do not fit the layout; a policy that registers writers stores the next layout.

        ``schema`` is the schema that all of them are written with (by default that of the value's type).
        """
        layout = made = self.layout(table)
        schema = schema if schema is not None else schemas.of_type(dict(cells.dtypes)["value"])
        known = F.lit(False)
        for family in layout.families.values():
            own = F.col("family") == family.name
            known = known | (own if family.is_map else own & F.col("qualifier").isin(sorted(family.columns)))
        wrong = cells.where(~known).select("family", "qualifier").limit(1).collect()
        if wrong:
            raise CatalogError(f"table {table!r} has no column {wrong[0]['family']}:{wrong[0]['qualifier']}")
        if layout.policy != "NONE":
            name = F.when(F.col("family").isin(sorted(f.name for f in layout.families.values() if f.is_map)), "").otherwise(F.col("qualifier"))
            for r in cells.select("family", name.alias("qualifier")).distinct().collect():  # at most the declared columns and families
                made = check_write(made, r["family"], r["qualifier"], schema)
        if made != layout:
            self._write(f"tables/{table}/layouts/{len(self.layouts(table)):06d}.json", json.loads(replace(made, layout_id=f"{layout.layout_id}+w", reference_id=layout.layout_id).to_json()))
        return made

    def save(self, table: str, cells: DataFrame, regions: int | None = None, now: int | None = None, per_second: int = 1000) -> None:
        """Replaces a table's cells by a new version of its folder; with a clock, by what the layout retains of them.

        The version before stays, as plans may still read it; older ones are deleted.
        """
        layout = self.layout(table)
        cells = cells if now is None else mutations.retain(cells, layout, now, per_second)
        found = self._list(f"tables/{table}/cells")
        number = int(found[-1]) + 1 if found else 0
        self._write(f"tables/{table}/schema.json", StructType([*cells.schema.fields, StructField("locality_group", StringType())]).jsonValue())
        tables.write(cells, f"{self.path}/tables/{table}/cells/{number:06d}", layout, regions)
        for old in found[:-1]:
            self._delete(f"tables/{table}/cells/{old}")

    def cells(self, table: str, families: list[str] | None = None) -> DataFrame:
        """A table's cells; with families, only their locality groups are listed."""
        layout = self.layout(table)
        found = self._list(f"tables/{table}/cells")
        if not found:
            raise CatalogError(f"table {table!r} has no cells yet")
        groups = None if families is None else sorted({g.name for f in families if (g := layout.group_of(f)) is not None})
        return tables.load(self.spark, f"{self.path}/tables/{table}/cells/{found[-1]}", groups, StructType.fromJson(self._read(f"tables/{table}/schema.json")))

    # schemas -----------------------------------------------------------------------

    def schema_id(self, schema: Any) -> int:
        """Number of a schema, given to it now if it is new; primitives are 0 to 7."""
        self._open()
        known, text = self._read("schemas.json"), schemas.canonical(schema)
        if text not in known:
            known.append(text)
            self._write("schemas.json", known)
        return known.index(text)

    def schema(self, number: int) -> Any:
        known = self._read("schemas.json")
        if not 0 <= number < len(known):
            raise CatalogError(f"no schema {number}")
        return json.loads(known[number])

    @staticmethod
    def schema_hash(schema: Any) -> bytes:
        return hashlib.md5(schemas.canonical(schema).encode()).digest()

    def schema_by_hash(self, digest: bytes) -> Any:
        return next((json.loads(s) for s in self._read("schemas.json") if hashlib.md5(s.encode()).digest() == digest), None)

    def schema_table(self) -> DataFrame:
        """(schema_id, schema): a dimension to join to cells by their writer's schema."""
        return self.spark.createDataFrame(list(enumerate(self._read("schemas.json"))), "schema_id bigint, schema string")

    # system values, key-values, notes ------------------------------------------------

    def system(self) -> dict[str, str]:
        self._open()
        return self._read("system.json")

    def set_system(self, key: str, value: str) -> None:
        self._write("system.json", self.system() | {key: value})

    def put_value(self, table: str, key: str, value: str, version: int) -> None:
        self.layout(table)
        all_values = self._read(f"tables/{table}/values.json") or {}
        all_values.setdefault(key, {})[str(version)] = value
        self._write(f"tables/{table}/values.json", all_values)

    def values(self, table: str, key: str, versions: int = 1) -> list[tuple[int, str]]:
        """The newest values of a key, newest first."""
        if versions < 1:
            raise ValueError("at least one version")
        found = (self._read(f"tables/{table}/values.json") or {}).get(key, {})
        return sorted(((int(v), x) for v, x in found.items()), reverse=True)[:versions]

    def remove_values(self, table: str, key: str) -> None:
        kept = self._read(f"tables/{table}/values.json") or {}
        kept.pop(key, None)
        self._write(f"tables/{table}/values.json", kept)

    def keys(self, table: str) -> list[str]:
        return sorted(self._read(f"tables/{table}/values.json") or {})

    def annotate(self, table: str, key: str, value: str, column: str = "") -> None:
        """Sets a note on a table, or on one of its families or columns."""
        if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", key):
            raise ValueError(f"bad note key {key!r}")
        self._known(table, column)
        notes = self._read(f"tables/{table}/notes.json") or {}
        notes.setdefault(column, {})[key] = value
        self._write(f"tables/{table}/notes.json", notes)

    def _known(self, table: str, column: str) -> None:
        layout = self.layout(table)
        if column:
            family, _, qualifier = column.partition(":")
            own = layout.family(family)
            if own is None or (qualifier and not own.is_map and qualifier not in own.columns):
                raise CatalogError(f"table {table!r} has no column {column!r}")

    def notes(self, table: str, column: str | None = None, exact: str | None = None, prefix: str | None = None, contains: str | None = None, pattern: str | None = None) -> dict[tuple[str, str], str]:
        """{(column, key): note} of a table (column ``""``) or of one column, by a test of the key."""
        out = {}
        for own, notes in (self._read(f"tables/{table}/notes.json") or {}).items():
            for key, value in notes.items():
                fits = (exact is None or key == exact) and (prefix is None or key.startswith(prefix)) and (contains is None or contains in key) and (pattern is None or re.search(pattern, key))
                if fits and (column is None or own == column):
                    out[(own, key)] = value
        return out

    def remove_notes(self, table: str, column: str | None = None, **tests: Any) -> None:
        gone = self.notes(table, column, **tests)
        notes = self._read(f"tables/{table}/notes.json") or {}
        for own, key in gone:
            del notes[own][key]
        self._write(f"tables/{table}/notes.json", notes)

    # backup ------------------------------------------------------------------------

    def export_metadata(self, path: str) -> None:
        """Writes layouts, schemas, system values and notes as one row of JSON."""
        out = {"system": self.system(), "schemas": self._read("schemas.json"), "tables": {}}
        for t in self.tables():
            out["tables"][t] = {"layouts": [json.loads(x.to_json()) for x in self.layouts(t)], "notes": self._read(f"tables/{t}/notes.json") or {}, "values": self._read(f"tables/{t}/values.json") or {}}
        self.spark.createDataFrame([(json.dumps(out),)], "metadata string").coalesce(1).write.mode("overwrite").json(path)

    def restore_metadata(self, path: str, tables_only: bool = False) -> None:
        saved = json.loads(self.spark.read.schema("metadata string").json(path).first()["metadata"])
        if not tables_only:
            self._write("system.json", saved["system"])
            self._write("schemas.json", saved["schemas"])
        for t, kept in saved["tables"].items():
            for i, layout in enumerate(kept["layouts"]):
                self._write(f"tables/{t}/layouts/{i:06d}.json", layout)
            self._write(f"tables/{t}/notes.json", kept["notes"])
            self._write(f"tables/{t}/values.json", kept["values"])


def parse_uri(uri: str) -> dict[str, Any]:
    """Parts of ``wide://host:port,.../instance/table/column,...``."""
    made = urlparse(uri)
    if not made.scheme or not made.netloc:
        raise ValueError(f"not a table address: {uri!r}")
    parts = [p for p in made.path.split("/") if p]
    if len(parts) > 3:
        raise ValueError(f"too many parts in {uri!r}")
    for part in parts[:2]:
        if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", part):
            raise ValueError(f"bad name {part!r} in {uri!r}")
    instance, table, columns = [*parts, None, None, None][:3]
    return {"scheme": made.scheme, "hosts": made.netloc.split(","), "instance": instance, "table": table, "columns": columns.split(",") if columns else []}


def make_uri(scheme: str, hosts: list[str], instance: str | None = None, table: str | None = None, columns: list[str] | None = None) -> str:
    """The address of such parts; each part needs the one before it."""
    if (table and not instance) or (columns and not table):
        raise ValueError("a table needs an instance, and columns need a table")
    parts = [instance, table, ",".join(columns) if columns else None]
    uri = f"{scheme}://{','.join(hosts)}" + "".join(f"/{p}" for p in parts if p)
    parse_uri(uri)
    return uri


def resolve_uri(base: str, path: str) -> str:
    """An address below another one: ``table/column,...`` of an instance, and so on."""
    return make_uri(*(lambda d: (d["scheme"], d["hosts"], d["instance"], d["table"], d["columns"]))(parse_uri(f"{base.rstrip('/')}/{path.strip('/')}")))


def with_schemas(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Cells with their writers' schemas by ``schema_id``, null for unknown ones."""
    return cells.join(registry, "schema_id", "left")
