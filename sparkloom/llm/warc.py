"""WARC archives: written with an index beside them, read back by sorted, coalesced byte ranges.

Every record is a gzip member of its own in a .warc.gz file. A writing task puts its records into files of up to
`roll` bytes in the shared folder, named by partition and attempt, and returns the index: file, offset, length, URL,
digest. Only index rows that a finished task returned are ever read, so what a lost or repeated attempt wrote is never
seen. Reading takes any selection of index rows, spreads them by file and range block, sorts each task's by file and
offset, and fetches neighbours less than `gap` bytes apart in one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bits_of, flagged, slices, table

ROLL, GAP, READ = 64 << 20, 64 << 10, 8 << 20
SALTS = 16
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def bare_digest(payload: bytes) -> str:
    return as_base32(hashlib.sha1(payload).hexdigest())


def as_base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with sha (hexadecimal, of the html's UTF-8, empty for null) and refers_to: the smallest
    page_id with that payload, for other rows of at least `least` bytes, else null.

    The smallest id per payload is an aggregate with map-side combination. Pages whose payload occurs once pass by a set of
    the repeated ones and aren't shuffled; the others meet their first id, salted, so that a payload shared by a third of
    all pages is spread over tasks. A row is told by page_id and payload: rows equal in both are alike responses or
    revisits, rows of one page_id with other payloads are pages of their own, and a null page_id revisits the smallest id
    there is; where there is none, all are responses.
    """
    scratch = Scratch(pages.sparkSession, "warcfirst")
    own = pages.withColumn("sha", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))))
    sums = own if least <= 0 else own.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    first = sums.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    first = scratch.table(first.select(F.col("sha").alias("__sha"), "first_id"), "first")
    marked = flagged(own, "sha", scratch.table(bits_of(first, "__sha"), "bits"), "__again")
    salted = first.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = marked.where("__again").withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    met = some.join(salted, (F.col("sha") == F.col("__sha")) & (F.col("__salt") == F.col("__s")), "left")
    met = met.select("page_id", "url", "html", "sha", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    return marked.where("NOT __again").select("page_id", "url", "html", "sha", F.lit(None).cast("long").alias("refers_to")).unionByName(met)


def _header(kind: str, page_id, url: str | None, digest: str, refers_to, body: int) -> bytes:
    """The record's id and date depend on the row alone, so a repeated attempt writes the same bytes."""
    clean = "".join((url or "").split())
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}|{clean}|{digest}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, root: str, roll: int = ROLL) -> DataFrame:
    """Writes a record for each (page_id, url, html, sha, refers_to) and returns the index. Keep the result in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, n, at = None, 0, 0
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for page_id, url, html, sha, refers_to in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    body = (html or "").encode()
                    digest, kind = as_base32(sha), "response" if refers_to is None else "revisit"
                    stored = body if kind == "response" else b""
                    record = _member(_header(kind, page_id, url, digest, refers_to, len(stored)) + stored + b"\r\n\r\n")
                    if out is None or at + len(record) > roll and at:
                        if out is not None:
                            out.close()
                        n, at = n + 1, 0
                        out = store.open_output_stream(f"{stem}-{n:04d}.warc.gz", compression=None)
                    out.write(record)
                    rows.append((page_id, f"{stem}-{n:04d}.warc.gz", at, len(record), url, digest, len(body), kind, refers_to))
                    at += len(record)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    return pages.select("page_id", "url", "html", "sha", "refers_to").mapInArrow(run, INDEX)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and content block of the record in a gzip member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def read_ranges(store: fs.FileSystem, wanted: list[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, bytes]]:
    """(position in wanted, bytes) of (file, offset, length) ranges sorted by file and offset, neighbours in one read."""
    i, name, f = 0, None, None
    while i < len(wanted):
        file, start, length = wanted[i]
        end, j = start + length, i + 1
        while j < len(wanted) and wanted[j][0] == file and wanted[j][1] - end <= gap and wanted[j][1] + wanted[j][2] - start <= most:
            end = max(end, wanted[j][1] + wanted[j][2])
            j += 1
        if file != name:
            if f is not None:
                f.close()
            name, f = file, store.open_input_file(file)
        data = f.read_at(end - start, start)
        for k in range(i, j):
            yield k, data[wanted[k][1] - start : wanted[k][1] - start + wanted[k][2]]
        i = j
    if f is not None:
        f.close()


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, block binary"


def read(index: DataFrame, root: str, block: int = 64 << 20) -> DataFrame:
    """The records that the index rows point at: (page_id, url, record_type, refers_to, payload_digest, block).

    The rows are dealt out by file and `block` of bytes, so that a task's ranges lie side by side.
    """
    spread = index.select("page_id", "file", "offset", "length").withColumn("__block", F.floor(F.col("offset") / F.lit(block)))
    sorted_ = spread.repartition("file", "__block").sortWithinPartitions("file", "offset").drop("__block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            ids, *wanted = (batch.column(i).to_pylist() for i in range(4))
            rows, held = [], 0
            for i, data in read_ranges(store, list(zip(*wanted, strict=True))):
                fields, body = parse(data)
                page = fields["X-Page-ID"]
                if (int(page) if page else None) != ids[i]:
                    raise ValueError(f"the index names page {ids[i]} where the archive holds {page}")
                refers = fields.get("X-Refers-To-Page-ID")
                rows.append((ids[i], fields["WARC-Target-URI"], fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Payload-Digest"].removeprefix("sha1:"), body))
                held += len(body)
                if held > 4 << 20:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return sorted_.mapInArrow(run, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, root: str | None = None, least: int = 0) -> tuple[DataFrame, str]:
    """Writes all pages under root (by default in the shared folder); the index, as a table, and the root.

    Only pages whose payload occurs again cross the network; revisits leave without their payload.
    """
    scratch = Scratch(spark, "warc")
    root = root or scratch.path("archive")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return scratch.table(write(with_first(own, least), root), "index"), root


def resolved(records: DataFrame) -> DataFrame:
    """Length and digest of each record's full payload: a response's from the bytes read back; a revisit's from the response's.

    Revisits meet their responses by page_id; a response with a third of all rows revisiting it is salted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(4).to_pylist()
            digest = [bare_digest(b) for b in blocks]
            kinds, told = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            if any(k == "response" and d != t for k, d, t in zip(kinds, digest, told, strict=True)):
                raise ValueError("a response's payload differs from its digest")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([len(b) for b in blocks], pa.int64())], ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"])

    return records.select("page_id", "record_type", "refers_to", "payload_digest", "block").mapInArrow(run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = archive(spark, table(spark, sf_dir, "pages"))
    back = Scratch(spark, "warcread").table(resolved(read(index, root)))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = back.where("record_type = 'response'").select(cols)
    full = own.join(back.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    full = full.select(F.col("page_id").alias("__id"), F.col("payload_bytes").alias("__n"), F.col("payload_digest").alias("__d"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s")).distinct()
    again = back.where("record_type = 'revisit'").withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = again.join(full, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__d")) & (F.col("__salt") == F.col("__s")), "left")
    return own.unionByName(again.select("page_id", F.col("__n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
