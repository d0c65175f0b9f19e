"""Files of other formats as sinks and sources: content-addressed archives, safetensors and Arrow IPC.

A writing task puts its rows into files of its own, named by partition and attempt, and returns a row a file; only files
that a finished task returned are read, so what a lost attempt wrote is never seen. Readers take such rows, or any table
with a column `file`, a task's worth of files each. Paths are opened through Arrow's file systems.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rows to a file, and bytes, about: a task holds one file at a time, and a longer row is a file of its own.
ROWS, BYTES = 50_000, 16 << 20
#: Version 1, raw bytes, SHA-256 of 32 bytes.
_CID = bytes([0x01, 0x55, 0x12, 0x20])


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most so many rows and about BYTES."""
    if len(batch) > rows:
        for at in range(0, len(batch), rows):
            yield from _parts(batch.slice(at, rows), rows)
    elif len(batch) > 1 and batch.nbytes > BYTES:
        yield from _parts(batch.slice(0, len(batch) // 2), rows)
        yield from _parts(batch.slice(len(batch) // 2), rows)
    else:
        yield batch


def _write(df: DataFrame, root: str, ending: str, encode: Callable[[pa.Table], bytes], rows: int) -> DataFrame:
    """(file, rows) of the files written; keep the result in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        held: list[pa.RecordBatch] = []
        n = files = size = 0

        def flush() -> pa.RecordBatch:
            name = f"{stem}-{files:04d}.{ending}"
            with store.open_output_stream(name, compression=None) as out:
                out.write(encode(pa.Table.from_batches(held)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "rows"])

        for batch in batches:
            for part in _parts(batch, rows):
                if n and (n + len(part) > rows or size + part.nbytes > BYTES):
                    yield flush()
                    held, n, size, files = [], 0, 0, files + 1
                held.append(part)
                n, size = n + len(part), size + part.nbytes
        if n:
            yield flush()

    return df.mapInArrow(run, "file string, rows long")


def _read(files: DataFrame, root: str, schema: str, decode: Callable[[bytes], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(name) as f:
                    yield from decode(f.read())

    return files.select("file").repartition("file").mapInArrow(run, schema)


def cid(data: bytes) -> bytes:
    return _CID + hashlib.sha256(data).digest()


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _read_varint(f: io.BytesIO) -> int | None:
    n = shift = 0
    while True:
        b = f.read(1)
        if not b:
            return None
        n |= (b[0] & 127) << shift
        shift += 7
        if b[0] < 128:
            return n


def write_car(df: DataFrame, root: str, rows: int = ROWS) -> DataFrame:
    """df (data binary): a section of content id and bytes for each row behind a header that names the first as root.

    Defined results: null data is empty data; equal data are equal sections.
    """

    def encode(t: pa.Table) -> bytes:
        blocks = [(cid(d or b""), d or b"") for d in t.column(0).to_pylist()]
        header = b"\xa2\x65roots\x81\xd8\x2a\x58\x25\x00" + blocks[0][0] + b"\x67version\x01"
        return b"".join([_varint(len(header)), header, *(_varint(len(c) + len(d)) + c + d for c, d in blocks)])

    return _write(df, root, "car", encode, rows)


def read_car(files: DataFrame, root: str) -> DataFrame:
    """(cid, data) of every section; a section whose bytes don't have its content id is an error."""

    def decode(data: bytes) -> Iterator[pa.RecordBatch]:
        f = io.BytesIO(data)
        f.read(_read_varint(f) or 0)
        ids, blocks = [], []
        while (n := _read_varint(f)) is not None:
            section = f.read(n)
            if cid(section[36:]) != section[:36]:
                raise ValueError("a section's bytes differ from its content id")
            ids.append(section[4:36].hex())
            blocks.append(section[36:])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(blocks, pa.binary())], ["cid", "data"])

    return _read(files, root, "cid string, data binary", decode)


def write_safetensors(df: DataFrame, root: str, rows: int = ROWS) -> DataFrame:
    """df (name string, values array<float>): a tensor F32 for each row, behind the header of names, shapes and offsets.

    Defined results: a null name or array is left out; of rows that repeat a name in a file the last is kept.
    """

    def encode(t: pa.Table) -> bytes:
        header, parts, at = {}, [], 0
        kept = {n: v for n, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True) if n is not None and v is not None}
        for n, v in kept.items():
            data = np.array([np.nan if x is None else x for x in v], "<f4").tobytes()
            header[n] = {"dtype": "F32", "shape": [len(v)], "data_offsets": [at, at + len(data)]}
            parts.append(data)
            at += len(data)
        head = json.dumps(header).encode()
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(parts)

    return _write(df, root, "safetensors", encode, rows)


def read_safetensors(files: DataFrame, root: str) -> DataFrame:
    """(name, dtype, shape, values) of every tensor of 32-bit floats."""

    def decode(data: bytes) -> Iterator[pa.RecordBatch]:
        size = int.from_bytes(data[:8], "little")
        header = {n: h for n, h in json.loads(data[8 : 8 + size]).items() if n != "__metadata__"}
        body = memoryview(data)[8 + size :]
        values = [np.frombuffer(body[slice(*h["data_offsets"])], "<f4") for h in header.values()]
        yield pa.RecordBatch.from_arrays([pa.array(header, pa.string()), pa.array([h["dtype"] for h in header.values()], pa.string()), pa.array([h["shape"] for h in header.values()], pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float32()))], ["name", "dtype", "shape", "values"])

    return _read(files, root, "name string, dtype string, shape array<long>, values array<float>", decode)


def write_ipc(df: DataFrame, root: str, rows: int = ROWS) -> DataFrame:
    """df in Arrow's file format."""

    def encode(t: pa.Table) -> bytes:
        out = io.BytesIO()
        with pa.ipc.new_file(out, t.schema) as w:
            w.write_table(t)
        return out.getvalue()

    return _write(df, root, "arrow", encode, rows)


def read_ipc(files: DataFrame, root: str, schema: str) -> DataFrame:
    return _read(files, root, schema, lambda data: iter(pa.ipc.open_file(io.BytesIO(data)).read_all().to_batches()))
