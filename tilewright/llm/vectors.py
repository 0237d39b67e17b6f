"""Blocks of vectors: rows packed into one row of bytes each, and block meeting block in grouped tasks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, about.
BLOCK = 1024


def usable(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, dim, vector as doubles) of rows whose vector is not null or empty and whose components are all finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_column).cast("long").alias("id"), F.size(v).alias("dim"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.col("dim") > 0) & finite)


def rows_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def packed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys: int, id, vector) to one row (keys, ids, vectors) for each group, in the order of ids."""

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        out = {k: pa.array([rows.column(k)[0].as_py()], pa.int32()) for k in keys}
        return pa.table(out | {"ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([rows_of(rows.column("vector"))[order].tobytes()], pa.binary())})

    return df.select(*keys, "id", "vector").groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} int" for k in keys) + ", ids binary, vectors binary")


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.float64).reshape(len(i), -1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) to the k best of each query with their rank; ties to smaller ids.

    Rows that repeat an id are one query and one candidate, with the best score that any two of them have.
    """
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def parts_of(rows: DataFrame, *keys: str, name: str = "parts") -> DataFrame:
    """For each value of ``keys`` how many blocks of about ``BLOCK`` rows it has."""
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))


def batches_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, kind: pa.DataType) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, kind)})
