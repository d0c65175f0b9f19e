"""Round trips through the other file formats: what was written is read back and judged."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import vectors as V
from ..sources import archives as A
from ..sources.shared import kept, new_path
from ..sources.tables import table


@query("SELECT sha256(text) AS cid, strlen(text) AS size, COUNT(*) AS n FROM (SELECT COALESCE(text, '') AS text FROM documents) GROUP BY 1, 2")
def car_archive(spark, sf):
    """Texts as sections of content-addressed archives, read back and checked."""
    root = new_path(spark, "car")
    d = table(spark, sf, "documents").select(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("data"))
    files = kept(A.write_car(d, f"{root}/files"), "car")
    return A.read_car(files, root).groupBy("cid", F.octet_length("data").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, 'F32' AS dtype, len(embedding) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def safetensors_files(spark, sf):
    """Vectors as named tensors in chunks of 10,000 with an index of files, read back."""
    root = new_path(spark, "tensors")
    t = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("values"))
    files = kept(A.write_safetensors(t, f"{root}/files", 10_000), "tensors")
    return A.read_safetensors(files, root).select(F.col("name").cast("long").alias("vec_id"), "dtype", F.col("shape")[0].alias("dims"), F.round(V.norm(F.col("values")), 6).alias("norm"))


@query("SELECT label, COUNT(*) AS n, round(SUM(embedding[1]::DOUBLE), 5) AS first FROM embeddings GROUP BY label")
def arrow_files(spark, sf):
    """A table in Arrow's file format, read back."""
    root = new_path(spark, "arrow")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    files = kept(A.write_ipc(e, f"{root}/files"), "arrow")
    back = A.read_ipc(files, root, "vec_id long, embedding array<float>, label int")
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 5).alias("first"))
