"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length n belongs to class k = capacity // n: k of its class fit into one sequence, whichever they are, so each
class's bins take a fixed number of pieces and workers fill theirs without a word to each other. Documents may be cut:
where a piece would leave more than 1/`slack` of its slot empty, exactly a slot of the next class (capacity // (k + 1))
is cut off, which fills without loss, and the rest is classed anew. What a worker can't fill a bin with (under k pieces of
each class) it puts into mixed bins, longest first, each into the first that has room.

The pieces depend on a document's length alone, and a document's worker on the hash of its id, so a task that runs again
after the loss of an executor gives the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .tokens import PartIds, vocabulary_path

CAPACITY, SLACK = 4096, 32
#: Tokens a worker packs, about: 256 sequences' worth keeps its one or two part-filled last bins under 1 %.
WORKER_TOKENS = 1 << 20


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces, in order, into which a document of n tokens is cut; they add up to n."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        slot = capacity // k
        if (slot - n) * slack <= slot or n <= capacity // slack:
            out.append(n)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        n -= piece
    return out


_IDS: dict[str, PartIds] = {}
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids, ended by end_id, cut into pieces. No shuffle.

    Defined results: a null or empty text is the one piece [end_id]; repeated rows give repeated pieces.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _IDS:
            _IDS[path] = PartIds(path)
        ids_of = _IDS[path].of_text
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = memoryview(ids_of(text or "") + end)
                    at, n = 0, len(ids) // 4
                    for size in cuts(n, capacity):
                        row.append(i), start.append(at), length.append(size), total.append(n)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at += size
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, {PIECES}")


def fill(worker: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Bin and offset of each of a worker's pieces: bounded by WORKER_TOKENS, twice or so at most."""
    worker = worker.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    k = capacity // worker["length"]
    rank, size = k.groupby(k).cumcount(), k.groupby(k).transform("size")
    full = rank < size // k * k
    first = (size // k).groupby(k).first()
    base = first.cumsum() - first
    bins = k.map(base) + rank // k
    free: list[int] = []
    nxt = int(first.sum())
    for i in worker.index[~full]:
        n = worker.at[i, "length"]
        at = next((b for b, room in enumerate(free) if room >= n), None)
        if at is None:
            at = len(free)
            free.append(capacity)
        free[at] -= n
        bins[i] = nxt + at
    worker["bin"] = bins
    worker["offset"] = worker.groupby("bin")["length"].cumsum() - worker["length"]
    return worker


def pack(pieces: DataFrame, capacity: int = CAPACITY, worker_tokens: int = WORKER_TOKENS) -> DataFrame:
    """pieces with sequence_id and offset. The rows carry lengths and checksums, never ids, so the one shuffle is small.

    Pieces go to as many workers as there are `worker_tokens` tokens, by hash of id and start, and each is packed by
    itself; full-capacity pieces need no partner and take part like the others.
    """
    total = pieces.agg(F.sum("length").alias("t")).first()["t"] or 0
    workers = max(1, round(total / worker_tokens))
    kind = dict(pieces.dtypes)["doc_id"]
    dealt = pieces.withColumn("__worker", F.pmod(F.xxhash64("doc_id", "start"), F.lit(workers)))

    def run(key: tuple, worker: pd.DataFrame) -> pd.DataFrame:
        done = fill(worker, capacity)
        done["sequence_id"] = (int(key[0]) << 32) + done["bin"]
        return done[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("__worker").applyInPandas(run, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokenises once (the pieces are kept in the shared folder) and packs."""
    from .common import Scratch

    kept = Scratch(spark, "pack").table(pieces(docs, path or vocabulary_path("word_bpe_49k.json")))
    return pack(kept)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


