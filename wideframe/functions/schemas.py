"""Compatibility of Avro schemas (as JSON values), and values to and from JSON."""

from __future__ import annotations

import base64
import json
from typing import Any

PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "string", "bytes")
_WIDER = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",)}


def _kind(schema: Any) -> str:
    return "union" if isinstance(schema, list) else schema if isinstance(schema, str) else schema["type"] if isinstance(schema["type"], str) else _kind(schema["type"])


def _names(schema: Any, known: dict[str, Any]) -> None:
    if isinstance(schema, list):
        for s in schema:
            _names(s, known)
    elif isinstance(schema, dict):
        if "name" in schema:
            known[schema["name"]] = schema
        for s in [schema.get("items"), schema.get("values"), *(f["type"] for f in schema.get("fields", []))]:
            if s is not None:
                _names(s, known)


def can_read(reader: Any, writer: Any) -> bool:
    """Whether data of one schema can be read as another."""
    r_names: dict[str, Any] = {}
    w_names: dict[str, Any] = {}
    _names(reader, r_names)
    _names(writer, w_names)
    return _can_read(reader, writer, r_names, w_names, set())


def _can_read(r: Any, w: Any, rn: dict, wn: dict, open_pairs: set) -> bool:
    r = rn.get(r, r) if isinstance(r, str) else r
    w = wn.get(w, w) if isinstance(w, str) else w
    if isinstance(w, list):  # every branch that may have been written
        return all(_can_read(r, x, rn, wn, open_pairs) for x in w)
    if isinstance(r, list):
        return any(_can_read(x, w, rn, wn, open_pairs) for x in r)
    rk, wk = _kind(r), _kind(w)
    if rk in PRIMITIVES or wk in PRIMITIVES:
        return rk == wk or rk in _WIDER.get(wk, ())
    if rk != wk:
        return False
    if rk == "array":
        return _can_read(r["items"], w["items"], rn, wn, open_pairs)
    if rk == "map":
        return _can_read(r["values"], w["values"], rn, wn, open_pairs)
    if r["name"].rpartition(".")[2] != w["name"].rpartition(".")[2] and w["name"] not in r.get("aliases", ()):
        return False
    if rk == "fixed":
        return r["size"] == w["size"]
    if rk == "enum":
        return set(w["symbols"]) <= set(r["symbols"])
    pair = (r["name"], w["name"])
    if pair in open_pairs:  # a record within itself
        return True
    open_pairs = open_pairs | {pair}
    written = {f["name"]: f for f in w["fields"]}
    for f in r["fields"]:
        there = next((written[n] for n in (f["name"], *f.get("aliases", ())) if n in written), None)
        if there is None:
            if "default" not in f:
                return False
        elif not _can_read(f["type"], there["type"], rn, wn, open_pairs):
            return False
    return True


#: Schemas of the Spark types that cells have.
_OF_TYPE = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes", "void": "null"}


def of_type(kind: str) -> str:
    """Schema of a Spark type."""
    if kind not in _OF_TYPE:
        raise TypeError(f"no schema for {kind}")
    return _OF_TYPE[kind]


def infer(value: Any) -> Any:
    """Schema of a plain value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "int" if -(2**31) <= value < 2**31 else "long"
    for kind, name in ((float, "double"), (str, "string"), (bytes, "bytes")):
        if isinstance(value, kind):
            return name
    raise TypeError(f"no schema can be inferred for {type(value).__name__}")


def to_json(value: Any, schema: Any) -> Any:
    """JSON form of a value: bytes as base64, a union's branch named unless null."""
    if isinstance(schema, list):
        if value is None:
            return None
        branch = next(s for s in schema if s != "null" and fits(value, s))
        return {branch if isinstance(branch, str) else branch.get("name", branch["type"]): to_json(value, branch)}
    kind = _kind(schema)
    if kind in ("bytes", "fixed"):
        return base64.b64encode(value).decode()
    if kind == "array":
        return [to_json(v, schema["items"]) for v in value]
    if kind == "map":
        return {k: to_json(v, schema["values"]) for k, v in value.items()}
    if kind == "record":
        return {f["name"]: to_json(value[f["name"]], f["type"]) for f in schema["fields"]}
    return value


def from_json(form: Any, schema: Any) -> Any:
    """The value of a JSON form; fields that are missing take their defaults."""
    if isinstance(schema, list):
        if form is None:
            return None
        if isinstance(form, dict) and len(form) == 1:
            name = next(iter(form))
            for s in schema:
                if name == (s if isinstance(s, str) else s.get("name", s["type"])):
                    return from_json(form[name], s)
        branch = next((s for s in schema if s != "null" and fits(form, s)), None)
        if branch is None:
            raise ValueError(f"{form!r} fits no branch of {schema!r}")
        return from_json(form, branch)
    kind = _kind(schema)
    if kind in ("bytes", "fixed"):
        return base64.b64decode(form)
    if kind == "array":
        return [from_json(v, schema["items"]) for v in form]
    if kind == "map":
        return {k: from_json(v, schema["values"]) for k, v in form.items()}
    if kind == "record":
        unknown = set(form) - {f["name"] for f in schema["fields"]}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        out = {}
        for f in schema["fields"]:
            if f["name"] in form:
                out[f["name"]] = from_json(form[f["name"]], f["type"])
            elif "default" in f:
                out[f["name"]] = f["default"]
            else:
                raise ValueError(f"field {f['name']!r} is missing")
        return out
    if not fits(form, schema):
        raise ValueError(f"{form!r} is no {kind}")
    return float(form) if kind in ("float", "double") else form


def fits(value: Any, schema: Any) -> bool:
    """Whether a value is one of a schema."""
    kind = _kind(schema)
    if kind == "null":
        return value is None
    if kind == "boolean":
        return isinstance(value, bool)
    if kind in ("int", "long"):
        return isinstance(value, int) and not isinstance(value, bool) and abs(value + 0.5) < 2 ** (31 if kind == "int" else 63)
    if kind in ("float", "double"):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "enum":
        return value in schema["symbols"]
    return isinstance(value, {"string": str, "bytes": (bytes, str), "fixed": (bytes, str), "array": list, "map": dict, "record": dict}[kind])


def canonical(schema: Any) -> str:
    """One text for equal schemas, for hashing."""
    return json.dumps(schema, sort_keys=True, separators=(",", ":"))
