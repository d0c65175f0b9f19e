"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by the contracts of the operators: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.frames: list[DataFrame] = []
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{name}{self.n}"

    def table(self, df: DataFrame, name: str = "t", tasks: int | None = None) -> DataFrame:
        """df, written and to be read again; tasks: at most so many files, where the rows are known to be few."""
        path = self.path(name)
        (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.frames.append(out)  # so that no other gets its id
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            self._delete(id(t))

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all other tables."""
        for key in self.paths.keys() - {id(t) for t in tables}:
            self._delete(key)

    def _delete(self, key: int) -> None:
        if path := self.paths.pop(key, None):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of the set that bits_of() makes: its table has at most BITS / 64 rows, so it can be broadcast at any scale.
BITS = 1 << 26


def bits_of(keys: DataFrame, column: str) -> DataFrame:
    """A set of hashed keys as rows (__word, __bits) of 64 bits: a million rows at most, whatever the number of keys."""
    h = F.pmod(F.xxhash64(column), F.lit(BITS))
    words = keys.select(F.floor(h / 64).cast("int").alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")).alias("b"))
    return words.groupBy("__word").agg(F.bit_or("b").alias("__bits"))


def flagged(df: DataFrame, column: str, bits: DataFrame, name: str = "__maybe") -> DataFrame:
    """df with a column that is true for all rows whose key is in the set, and for a few others; no shuffle of df."""
    h = F.pmod(F.xxhash64(column), F.lit(BITS))
    own = [F.col(f"`{c}`") for c in df.columns]
    hit = df.join(F.broadcast(bits), F.floor(h / 64).cast("int") == F.col("__word"), "left")
    found = F.call_function("shiftrightunsigned", F.col("__bits"), F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return hit.select(*own, F.coalesce(found, F.lit(False)).alias(name))


def likely(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The rows of df whose key is in the set, and a few others."""
    return flagged(df, column, bits).where("__maybe").drop("__maybe")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of text each; a longer row is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield batch.slice(at, len(sizes) - at)


def held_out(column: str, modulus: int, rest: int):
    """True where crc32 of the id as text leaves `rest`; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def hash_sample(df: DataFrame, key: str, at_most: int) -> DataFrame:
    """Rows whose key's hash is under a threshold that lets about `at_most` rows through (all, if there are fewer)."""
    n = df.count()
    if n <= at_most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1_000_000)) < int(1e6 * at_most / n))
