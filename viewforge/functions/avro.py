"""Avro's binary encoding of whole Arrow columns, and its decoding.

A column becomes the bytes of all its values and where each begins. Numbers of variable
length, texts, lists and records are put together from such parts by prefix sums over
their lengths, so no value passes through Python on its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pyarrow as pa


@dataclass
class Parts:
    """Value ``i`` is ``data[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    data: np.ndarray

    @classmethod
    def of_lengths(cls, lengths: np.ndarray, data: np.ndarray) -> Parts:
        return cls(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), data)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def spread(self, present: np.ndarray) -> Parts:
        """The values at the places that are present, nothing at the others."""
        lengths = np.zeros(len(present), np.int64)
        lengths[present] = self.lengths
        return Parts.of_lengths(lengths, self.data)

    def grouped(self, bounds: np.ndarray) -> Parts:
        """Consecutive values from one bound to the next as one."""
        return Parts(self.starts[bounds], self.data)

    def values(self) -> pa.Array:
        if self.starts[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.binary(), len(self.starts) - 1, [None, pa.py_buffer(self.starts.astype("<i4")), pa.py_buffer(self.data)])
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts) - 1, [None, pa.py_buffer(self.starts), pa.py_buffer(self.data)])


def together(*columns: Parts) -> Parts:
    """Value by value, the columns one after the other."""
    out = Parts.of_lengths(sum(c.lengths for c in columns), np.empty(int(sum(c.starts[-1] for c in columns)), np.uint8))
    at = out.starts[:-1].copy()
    for column in columns:
        lengths = column.lengths
        out.data[np.repeat(at - column.starts[:-1], lengths) + np.arange(column.starts[-1])] = column.data[: column.starts[-1]]
        at += lengths
    return out


def varints(values: np.ndarray) -> Parts:
    """Zigzag numbers of variable length."""
    values = values.astype(np.int64)
    rest = (values.astype(np.uint64) << np.uint64(1)) ^ (values >> 63).astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        lengths += (rest >> np.uint64(shift)) > 0
    out = Parts.of_lengths(lengths, np.empty(int(lengths.sum()), np.uint8))
    for i in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > i)
        low = (rest[rows] >> np.uint64(7 * i)).astype(np.uint8) & 0x7F
        out.data[out.starts[rows] + i] = low | np.where(lengths[rows] > i + 1, 0x80, 0).astype(np.uint8)
    return out


def _fixed(values: np.ndarray) -> Parts:
    return Parts(np.arange(len(values) + 1) * values.itemsize, np.ascontiguousarray(values).view(np.uint8))


def _texts(column: pa.Array) -> Parts:
    column = column.cast(pa.large_binary())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]]
    return together(varints(np.diff(starts)), Parts(starts - starts[0], data))


def _blocks(items: Parts, bounds: np.ndarray) -> Parts:
    """Lists: one block of a count and its items, and an empty block."""
    counts = np.diff(bounds)
    some = counts > 0
    return together(varints(counts[some]).spread(some), items.grouped(bounds), _fixed(np.zeros(len(counts), np.uint8)))


def encode(column: pa.Array, schema) -> Parts:
    """The values of a column without nulls, or of any column if the schema is a union with null."""
    if isinstance(schema, list):
        null = schema.index("null")
        inner = schema[1 - null]
        present = column.is_valid().to_numpy(False)
        tags = _fixed(np.where(present, 2 * (1 - null), 2 * null).astype(np.uint8))
        return together(tags, encode(column.drop_null(), inner).spread(present))
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind in ("int", "long"):
        if pa.types.is_date32(column.type):
            column = column.cast(pa.int32())
        elif pa.types.is_timestamp(column.type):
            column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
        return varints(column.to_numpy(False))
    if kind in ("string", "bytes"):
        return _texts(column)
    if kind == "boolean":
        return _fixed(column.to_numpy(False).astype(np.uint8))
    if kind in ("float", "double"):
        return _fixed(column.to_numpy(False).astype("<f4" if kind == "float" else "<f8"))
    if kind == "record":
        children = dict(zip((f.name for f in column.type), column.flatten(), strict=True))
        fields = [encode(children[f["name"]], f["type"]) for f in schema["fields"]]
        return together(*fields) if fields else _fixed(np.zeros((len(column), 0), np.uint8))
    bounds = column.offsets.to_numpy()
    first, bounds = (int(bounds[0]), bounds - bounds[0]) if len(bounds) else (0, np.zeros(1, np.int64))
    own = lambda values: values.slice(first, int(bounds[-1]))
    if kind == "array":
        return _blocks(encode(own(column.values), schema["items"]), bounds)
    if kind == "map":
        return _blocks(together(encode(own(column.keys), "string"), encode(own(column.items), schema["values"])), bounds)
    raise ValueError(f"no encoding for {kind}")


def encode_rows(columns: Sequence[pa.Array], schema: dict) -> Parts:
    """One record per row, its columns in the order of the schema's fields."""
    return together(*(encode(c, f["type"]) for c, f in zip(columns, schema["fields"], strict=True)))


class Decoder:
    """Values from bytes, one after the other."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the data ends inside a value")
        self.at += n
        return out

    def long(self) -> int:
        value = shift = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def _items(self) -> Iterator[None]:
        while n := self.long():
            if n < 0:
                n, _ = -n, self.long()
            for _ in range(n):
                yield

    def value(self, schema):
        if isinstance(schema, list):
            return self.value(schema[self.long()])
        kind = schema["type"] if isinstance(schema, dict) else schema
        if kind == "null":
            return None
        if kind in ("int", "long"):
            return _as_logical(self.long(), schema["logicalType"]) if isinstance(schema, dict) and "logicalType" in schema else self.long()
        if kind in ("string", "bytes"):
            raw = self.take(self.long())
            return raw.decode() if kind == "string" else raw
        if kind == "boolean":
            return self.take(1) == b"\x01"
        if kind in ("float", "double"):
            return struct.unpack("<f", self.take(4))[0] if kind == "float" else struct.unpack("<d", self.take(8))[0]
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        if kind == "array":
            return [self.value(schema["items"]) for _ in self._items()]
        if kind == "map":
            return {self.value("string"): self.value(schema["values"]) for _ in self._items()}
        raise ValueError(f"no decoding for {kind}")


def _as_logical(number: int, kind: str):
    if kind == "date":
        return date(1970, 1, 1) + timedelta(days=number)
    micros = {"timestamp-millis": 1000, "local-timestamp-millis": 1000, "timestamp-micros": 1, "local-timestamp-micros": 1}
    if kind not in micros:
        return number
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=number * micros[kind])
    return at.replace(tzinfo=None) if kind.startswith("local") else at
