"""Row keys: encoding as columns and in Python, parsing, and splits of the key space."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from typing import Any
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.plans.layout import KeyFormat


def _component(column: Column, kind: str) -> Column:
    """Order-preserving bytes: big-endian with the sign flipped; a string ends with 0."""
    if kind == "STRING":
        return F.concat(F.encode(column, "UTF-8"), F.unhex(F.lit("00")))
    wide = column.cast("bigint")
    if kind == "INTEGER":
        return F.unhex(F.lpad(F.hex(wide + F.lit(2**31)), 8, "0"))
    return F.unhex(F.lpad(F.hex(wide.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def encode_key(fmt: KeyFormat, *columns: Column) -> Column:
    """Row key bytes of the given component columns (or of one raw column)."""
    if fmt.kind == "raw":
        return columns[0].cast("binary")
    if fmt.kind == "hash":
        return F.unhex(F.md5(columns[0].cast("binary")))
    if fmt.kind == "hash_prefix":
        raw = columns[0].cast("binary")
        return F.concat(F.substring(F.unhex(F.md5(raw)), 1, fmt.hash_size), raw)
    empty = F.unhex(F.lit(""))
    parts = [F.coalesce(_component(c, kind), empty) for c, (_, kind) in zip(columns, fmt.components, strict=True)]
    hashed = F.substring(F.unhex(F.md5(F.concat(*parts[: fmt.range_scan_from]))), 1, fmt.hash_size)
    return hashed if fmt.suppress_materialization else F.concat(hashed, *parts)


def encode(fmt: KeyFormat, components: list[Any]) -> bytes:
    """The same for Python values; trailing components may be missing or None."""
    if fmt.kind != "formatted":
        raw = components[0] if isinstance(components[0], bytes) else str(components[0]).encode()
        digest = hashlib.md5(raw).digest()
        return raw if fmt.kind == "raw" else digest if fmt.kind == "hash" else digest[: fmt.hash_size] + raw
    values = [*components, *[None] * (len(fmt.components) - len(components))]
    if len(values) > len(fmt.components):
        raise ValueError("too many key components")
    nullable = fmt.nullable_from if fmt.nullable_from is not None else len(fmt.components)
    parts, ended = [], False
    for i, (v, (name, kind)) in enumerate(zip(values, fmt.components, strict=True)):
        if v is None:
            if i < nullable:
                raise ValueError(f"key component {name!r} must not be null")
            ended = True
            parts.append(b"")
            continue
        if ended:
            raise ValueError(f"key component {name!r} follows a null one")
        if kind == "STRING":
            if "\0" in v:
                raise ValueError("a string key component must not hold a zero byte")
            parts.append(v.encode() + b"\0")
        elif kind == "INTEGER":
            parts.append(struct.pack(">I", v + 2**31))
        else:
            parts.append(struct.pack(">Q", v + 2**63))
    hashed = hashlib.md5(b"".join(parts[: fmt.range_scan_from])).digest()[: fmt.hash_size]
    return hashed if fmt.suppress_materialization else hashed + b"".join(parts)


def decode(fmt: KeyFormat, key: bytes) -> list[Any]:
    """Components of a formatted key; those that were null are None."""
    if fmt.suppress_materialization:
        raise ValueError("the key's components are not stored")
    at, out = fmt.hash_size, []
    for _, kind in fmt.components:
        if at >= len(key):
            out.append(None)
        elif kind == "STRING":
            end = key.index(b"\0", at)
            out.append(key[at:end].decode())
            at = end + 1
        else:
            size = 4 if kind == "INTEGER" else 8
            if at + size > len(key):
                raise ValueError("the key is cut short")
            out.append(int.from_bytes(key[at : at + size], "big") - 2 ** (8 * size - 1))
            at += size
    if at < len(key):
        raise ValueError("bytes are left over after the key's components")
    return out


def decode_columns(fmt: KeyFormat, key: Column) -> list[Column]:
    """Components of a formatted key as columns; those that are missing are null."""
    if fmt.kind != "formatted" or fmt.suppress_materialization:
        raise ValueError("the key's components are not stored")
    out, rest = [], F.hex(F.substring(key, fmt.hash_size + 1, 2**31 - 1))  # two digits a byte
    for name, kind in fmt.components:
        if kind == "STRING":
            # the first 00 at a byte's place ends the string
            end = F.instr(F.regexp_replace(rest, "(..)", "$1 "), "00 ")
            digits = F.when(end > 0, (end - 1) / 3 * 2).cast("int")
            text = F.decode(F.unhex(F.substring(rest, F.lit(1), digits)), "UTF-8")
            out.append(text.alias(name))
            rest = F.substring(rest, digits + 3, F.char_length(rest))
        else:
            size = 8 if kind == "INTEGER" else 16
            digits = F.substring(rest, 1, size)
            whole = F.char_length(digits) == size
            high = F.conv(F.substring(digits, 1, size // 2), 16, 10).cast("bigint") - F.lit(2 ** (size * 2 - 1))
            value = high * F.lit(2 ** (size * 2)) + F.conv(F.substring(digits, size // 2 + 1, size // 2), 16, 10).cast("bigint")
            out.append(F.when(whole, value).cast("int" if kind == "INTEGER" else "bigint").alias(name))
            rest = F.substring(rest, F.lit(size + 1), F.char_length(rest))
    return out


def region_of(key: Column, bounds: list[bytes]) -> Column:
    """Number of the region that a key falls in, by ascending split keys."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)


def read_splits(spark: SparkSession, path: str) -> list[bytes]:
    """Split keys of a text file, one a line: hexadecimal, or text with ``\\xNN`` for other bytes; blank lines are skipped."""
    lines = [r["value"].strip() for r in spark.read.text(path).collect()]
    parse = lambda s: bytes.fromhex(s[4:]) if s.startswith("hex:") else re.sub(rb"\\x([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1].decode()), s.encode())
    out = [parse(s) for s in lines if s]
    if out != sorted(set(out)):
        raise ValueError("split keys must ascend")
    return out


def parse_key(text: str, fmt: KeyFormat) -> bytes | list[Any]:
    """A key as written on a command line.

    ``hex:``, ``utf8:`` and ``url:`` give encoded bytes; a JSON array gives
    components, in which ``[]`` is a wildcard (returned as None in a list that
    only a component filter can use); anything else is one component.
    """
    for prefix, make in (("hex:", bytes.fromhex), ("utf8:", str.encode), ("url:", unquote_to_bytes)):
        if text.startswith(prefix):
            return make(text[len(prefix) :])
    if not text.startswith("["):
        return encode(fmt, [text])
    values = json.loads(text)
    kinds = [k for _, k in fmt.components]
    if len(values) > len(kinds):
        raise ValueError("too many key components")
    for v, k in zip(values, kinds, strict=False):
        if v not in (None, []) and (isinstance(v, str) != (k == "STRING")):
            raise ValueError(f"{v!r} is no {k}")
    if any(v == [] for v in values):
        return [None if v == [] else v for v in values]
    return encode(fmt, values)


def splits(regions: int, hash_size: int = 16) -> list[bytes]:
    """Keys that cut a hashed key space into equal regions."""
    if regions < 1:
        raise ValueError("at least one region")
    if regions > 256**hash_size:
        raise ValueError("more regions than hashes")
    return [(k * 256**hash_size // regions).to_bytes(hash_size, "big") for k in range(1, regions)]


def split_table(cells: DataFrame, regions: int) -> DataFrame:
    """Cells in range partitions by key, sorted within by key, family, qualifier and version."""
    return cells.repartitionByRange(regions, "key").sortWithinPartitions("key", "family", "qualifier", F.desc("version"))


def hexed(data: bytes, delimiter: str = "") -> str:
    """Two lower-case hexadecimal digits a byte."""
    return delimiter.join(f"{b:02x}" for b in data)


def unhexed(text: str, delimiter: str = "") -> bytes:
    """The bytes of such digits."""
    parts = text.split(delimiter) if delimiter and text else [text[i : i + 2] for i in range(0, len(text), 2)]
    if any(not re.fullmatch("[0-9a-fA-F]{2}", p) for p in parts):
        raise ValueError(f"no hexadecimal bytes: {text!r}")
    return bytes.fromhex("".join(parts))


def protocol_version(text: str) -> tuple[str, tuple[int, int, int]]:
    """Name and numbers of a version such as ``layout-1.3``, to be compared as tuples; missing numbers are 0."""
    m = re.fullmatch(r"(?:([a-zA-Z][a-zA-Z0-9_-]*)-)?(\d+)(?:\.(\d+))?(?:\.(\d+))?", text.strip())
    if m is None:
        raise ValueError(f"no protocol version: {text!r}")
    return m[1] or "", (int(m[2]), int(m[3] or 0), int(m[4] or 0))


def varint(value: int) -> bytes:
    """Zig-zag variable-length bytes of a signed 64-bit integer."""
    value = ((value << 1) ^ (value >> 63)) & (2**64 - 1)
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Value and end position of such bytes."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return (value >> 1) ^ -(value & 1), at
        if shift > 63:
            raise ValueError("more than ten bytes")
