"""Table layouts: locality groups, families, columns, the key format, and their evolution."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from wideframe.functions import schemas

NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*\Z")
ALIAS = re.compile(r"[a-zA-Z0-9_-]+\Z")
FOREVER = 2**31 - 1
VALIDATION = ("STRICT", "DEVELOPER", "SCHEMA_1_0", "NONE")
STORAGE = ("HASH", "UID", "FINAL")
COMPONENT_TYPES = ("STRING", "INTEGER", "LONG")


class LayoutError(ValueError):
    """A layout, or a change of one, that the rules forbid."""


def _named(name: str) -> None:
    if not NAME.match(name or ""):
        raise LayoutError(f"bad name {name!r}")


@dataclass(frozen=True)
class CellSchema:
    """Type of a column's cells: a schema (Avro JSON), or ``counter``, or ``raw_bytes``."""

    type: str = "inline"
    value: Any = "string"
    storage: str = "UID"
    readers: tuple = ()
    writers: tuple = ()
    written: tuple = ()

    def __post_init__(self) -> None:
        if self.type not in ("inline", "counter", "raw_bytes"):
            raise LayoutError(f"bad cell type {self.type!r}")
        if self.storage not in STORAGE:
            raise LayoutError(f"bad schema storage {self.storage!r}")
        if self.type == "counter" and self.storage != "FINAL":
            raise LayoutError("a counter's schema storage must be FINAL")

    @property
    def is_counter(self) -> bool:
        return self.type == "counter"


@dataclass(frozen=True)
class Family:
    """A group family with declared columns, or a map family with one schema for all qualifiers."""

    name: str
    columns: dict[str, CellSchema] = field(default_factory=dict)
    map_schema: CellSchema | None = None
    aliases: tuple[str, ...] = ()
    description: str = ""
    enabled: bool = True

    def __post_init__(self) -> None:
        _named(self.name)
        for a in self.aliases:
            if not ALIAS.match(a):
                raise LayoutError(f"bad alias {a!r}")
        for c in self.columns:
            _named(c)
        if self.columns and self.map_schema:
            raise LayoutError(f"family {self.name!r} is both of group and of map type")

    @property
    def is_map(self) -> bool:
        return self.map_schema is not None

    def schema_of(self, qualifier: str) -> CellSchema | None:
        return self.map_schema or self.columns.get(qualifier)


@dataclass(frozen=True)
class LocalityGroup:
    """Families stored together, with their retention."""

    name: str
    families: dict[str, Family] = field(default_factory=dict)
    max_versions: int = FOREVER
    ttl_seconds: int = FOREVER
    compression: str = "NONE"
    in_memory: bool = False

    def __post_init__(self) -> None:
        _named(self.name)
        if self.max_versions <= 0 or self.ttl_seconds <= 0:
            raise LayoutError(f"locality group {self.name!r}: max_versions and ttl_seconds must be positive")


@dataclass(frozen=True)
class KeyFormat:
    """Row keys: ``raw``, ``hash``, ``hash_prefix``, or ``formatted`` of typed components."""

    kind: str = "formatted"
    components: tuple[tuple[str, str], ...] = (("key", "STRING"),)
    hash_size: int = 2
    nullable_from: int | None = None
    range_scan_from: int = 1
    suppress_materialization: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("raw", "hash", "hash_prefix", "formatted"):
            raise LayoutError(f"bad key kind {self.kind!r}")
        if self.kind != "formatted":
            return
        names = [n for n, _ in self.components]
        if not names or len(set(names)) < len(names):
            raise LayoutError(f"key components must have distinct names: {names}")
        for n, t in self.components:
            _named(n)
            if t not in COMPONENT_TYPES:
                raise LayoutError(f"bad type {t!r} of key component {n!r}")
        if not 1 <= self.hash_size <= 16:
            raise LayoutError(f"hash size must lie in 1..16: {self.hash_size}")
        if self.nullable_from is not None and not 0 < self.nullable_from <= len(names):
            raise LayoutError("the first key component must not be nullable")
        if not 0 < self.range_scan_from <= len(names):
            raise LayoutError("the range scan must start after the first key component")
        if self.suppress_materialization and self.range_scan_from != len(names):
            raise LayoutError("without materialised components there is no range scan")


@dataclass(frozen=True)
class Layout:
    """Layout of one table."""

    name: str
    key: KeyFormat = field(default_factory=KeyFormat)
    groups: dict[str, LocalityGroup] = field(default_factory=dict)
    layout_id: str = "1"
    reference_id: str | None = None
    policy: str = "NONE"
    description: str = ""

    def __post_init__(self) -> None:
        _named(self.name)
        if self.policy not in VALIDATION:
            raise LayoutError(f"bad validation policy {self.policy!r}")
        seen: set[str] = set()
        for g in self.groups.values():
            for f in g.families.values():
                for n in (f.name, *f.aliases):
                    if n in seen:
                        raise LayoutError(f"family name or alias {n!r} is used twice")
                    seen.add(n)

    @property
    def families(self) -> dict[str, Family]:
        return {f.name: f for g in self.groups.values() for f in g.families.values()}

    def family(self, name: str) -> Family | None:
        return next((f for f in self.families.values() if name == f.name or name in f.aliases), None)

    def group_of(self, family: str) -> LocalityGroup | None:
        return next((g for g in self.groups.values() if any(family == f.name or family in f.aliases for f in g.families.values())), None)

    def schema_of(self, family: str, qualifier: str) -> CellSchema:
        f = self.family(family)
        schema = f.schema_of(qualifier) if f else None
        if schema is None:
            raise LayoutError(f"table {self.name!r} has no column {family}:{qualifier}")
        return schema

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Layout:
        return from_dict(json.loads(text))


def _tuples(value: Any) -> Any:
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


def _schema(d: dict | None) -> CellSchema | None:
    return None if d is None else CellSchema(d.get("type", "inline"), d.get("value", "string"), d.get("storage", "UID"), *(tuple(d.get(k, ())) for k in ("readers", "writers", "written")))


def from_dict(d: dict[str, Any]) -> Layout:
    """A layout from its JSON form."""
    groups = {}
    for name, g in d.get("groups", {}).items():
        families = {
            fn: Family(fn, {c: _schema(s) for c, s in f.get("columns", {}).items()}, _schema(f.get("map_schema")), tuple(f.get("aliases", ())), f.get("description", ""), f.get("enabled", True)) for fn, f in g.get("families", {}).items()
        }
        groups[name] = LocalityGroup(name, families, *(g.get(k, v) for k, v in (("max_versions", FOREVER), ("ttl_seconds", FOREVER), ("compression", "NONE"), ("in_memory", False))))
    key = {k: _tuples(v) for k, v in d.get("key", {}).items()}
    return Layout(d["name"], KeyFormat(**key), groups, d.get("layout_id", "1"), d.get("reference_id"), d.get("policy", "NONE"), d.get("description", ""))


def update(current: Layout, wanted: Layout, deleted: tuple[str, ...] = (), renamed: dict[str, str] | None = None) -> Layout:
    """The next layout of a table, if the rules allow the change.

    ``deleted`` names groups ``g``, families ``g.f`` and columns ``g.f.c`` that go;
    ``renamed`` maps new such names to old ones.  What is neither kept, renamed
    nor deleted is an error, and so is a change of anything immutable.
    """
    renamed = renamed or {}
    if wanted.reference_id != current.layout_id:
        raise LayoutError(f"the change refers to layout {wanted.reference_id!r}; the current one is {current.layout_id!r}")
    if wanted.name != current.name:
        raise LayoutError("a table keeps its name")
    if wanted.key != current.key:
        raise LayoutError("a table keeps its key format")
    old, new = _paths(current), _paths(wanted)
    back = {n: renamed.get(n, n) for n in new}
    for n, o in renamed.items():
        if n not in new or o not in old:
            raise LayoutError(f"cannot rename {o!r} to {n!r}")
    kept = set(back.values())
    for path in old:
        gone = any(path == d or path.startswith(f"{d}.") for d in deleted)
        moved = any(path.startswith(f"{o}.") for o in renamed.values())
        if path not in kept and not gone and not moved:
            raise LayoutError(f"{path!r} is missing and not deleted")
        if path in kept and path in deleted:
            raise LayoutError(f"{path!r} is both kept and deleted")
    for path, item in new.items():
        before = old.get(back[path])
        if isinstance(item, Family) and isinstance(before, Family) and item.is_map != before.is_map:
            raise LayoutError(f"family {path!r} cannot change between group and map type")
        pairs = [(item, before)] if isinstance(item, CellSchema) else [(item.map_schema, before.map_schema)] if isinstance(item, Family) and isinstance(before, Family) and item.is_map else []
        for schema, was in pairs:
            if isinstance(was, CellSchema):
                _check_schema(path, was, schema, wanted.policy)
    number = str(int(current.layout_id) + 1) if current.layout_id.isdigit() else f"{current.layout_id}+1"
    return replace(wanted, layout_id=wanted.layout_id if wanted.layout_id not in ("", current.layout_id) else number)


def _paths(layout: Layout) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for g in layout.groups.values():
        out[g.name] = g
        for f in g.families.values():
            out[f"{g.name}.{f.name}"] = f
            out |= {f"{g.name}.{f.name}.{c}": s for c, s in f.columns.items()}
    return out


def _check_schema(path: str, old: CellSchema, new: CellSchema, policy: str) -> None:
    if old.storage != new.storage:
        raise LayoutError(f"{path}: schema storage cannot change")
    if old.is_counter != new.is_counter:
        raise LayoutError(f"{path}: a counter stays a counter, any other column becomes none")
    if old.storage == "FINAL" and (old.value, old.type) != (new.value, new.type):
        raise LayoutError(f"{path}: a final schema cannot change")
    if policy in ("STRICT", "DEVELOPER"):
        for reader in new.readers:
            for writer in (*new.writers, *new.written):
                if not schemas.can_read(reader, writer):
                    raise LayoutError(f"{path}: reader {reader!r} cannot read what {writer!r} wrote")


def register(layout: Layout, family: str, qualifier: str | None, schema: Any, role: str) -> Layout:
    """The layout with a schema registered as one of the column's readers, writers or written schemas."""
    if role not in ("readers", "writers", "written"):
        raise LayoutError(f"bad role {role!r}")
    group, own = layout.group_of(family), layout.family(family)
    if group is None or own is None:
        raise LayoutError(f"table {layout.name!r} has no family {family!r}")
    old = own.map_schema if own.is_map else own.columns.get(qualifier or "")
    if old is None:
        raise LayoutError(f"table {layout.name!r} has no column {family}:{qualifier}")
    made = old if schema in getattr(old, role) else replace(old, **{role: (*getattr(old, role), schema)})
    changed = replace(own, map_schema=made) if own.is_map else replace(own, columns=own.columns | {qualifier: made})
    return replace(layout, groups=layout.groups | {group.name: replace(group, families=group.families | {own.name: changed})})


def check_write(layout: Layout, family: str, qualifier: str, schema: Any) -> Layout:
    """Checks a write of a schema by the table's policy; DEVELOPER registers it."""
    cell = layout.schema_of(family, qualifier)
    if layout.policy in ("NONE",) or cell.type != "inline":
        return layout
    if layout.policy == "SCHEMA_1_0":
        if not schemas.can_read(cell.value, schema):
            raise LayoutError(f"{family}:{qualifier}: {schema!r} is not the declared schema")
        return layout
    if schema in cell.writers:
        return layout
    if layout.policy == "STRICT":
        raise LayoutError(f"{family}:{qualifier}: writer schema {schema!r} is not registered")
    for reader in cell.readers:
        if not schemas.can_read(reader, schema):
            raise LayoutError(f"{family}:{qualifier}: reader {reader!r} cannot read {schema!r}")
    return register(layout, family, None if layout.family(family).is_map else qualifier, schema, "writers")
