"""Nearest neighbours by cosine over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import ship

#: Queries whose vectors go to every task at once; more queries take several passes.
QUERY_BYTES = 64_000_000
#: Scores that a task holds at once: its vectors meet so many queries at a time.
BLOCK_BYTES = 16_000_000


def normalized(vector: Column) -> Column:
    """The vector with length 1; null for null, empty and zero vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors as a column expression."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return dot / F.sqrt(square(a) * square(b))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")


def search(vectors: DataFrame, queries: DataFrame, limit: int, threshold: float | None = None, dim: int | None = None) -> DataFrame:
    """(query_id, id, score, place): for each query (query_id, vector) the `limit` nearest of vectors (id, vector).

    Exact: each task multiplies its vectors with all queries, block by block, and keeps its own
    best `limit` a query, so what is shuffled is limit rows a query and task, and what a task
    holds beyond that doesn't grow with either table. Vectors of another dimension, null, zero
    and infinite vectors are left out; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    ship(spark)
    if dim is None:
        first = queries.where("vector is not null").select(F.size("vector").alias("n")).first()
        dim = first["n"] if first else 0
    asked = queries.where(F.size("vector") == dim) if dim else queries.limit(0)
    table = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    if not table.num_rows:
        return spark.createDataFrame([], "query_id long, id long, score double, place int")
    ids = table.column("query_id").to_numpy()
    matrix = _matrix(table.column("vector").combine_chunks(), dim)
    step = max(1, QUERY_BYTES // (8 * dim))
    usable = vectors.where(F.size("vector") == dim).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    out = None
    for lo in range(0, len(ids), step):
        part = matrix[lo : lo + step]
        norm = np.linalg.norm(part, axis=1)
        good = (norm > 0) & np.isfinite(norm)
        shared = spark.sparkContext.broadcast((ids[lo : lo + step][good], part[good] / norm[good][:, None]))
        best = usable.mapInArrow(_best(shared, dim, limit, threshold), "query_id long, id long, score double")
        out = best if out is None else out.union(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(shared, dim: int, limit: int, threshold: float | None):
    floor = -np.inf if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        held_id, held = np.zeros((len(ids), limit), np.int64), np.full((len(ids), limit), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("id").to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column("vector"), dim)
            norm = np.linalg.norm(matrix, axis=1)
            good = (norm > 0) & np.isfinite(norm)
            own, unit = own[good], (matrix[good] / norm[good][:, None]).T
            step = max(1, BLOCK_BYTES // (8 * max(1, len(own))))
            for lo in range(0, len(ids) if len(own) else 0, step):
                _keep(held_id[lo : lo + step], held[lo : lo + step], own, queries[lo : lo + step] @ unit, floor)
        step = max(1, BLOCK_BYTES // (24 * limit))
        for lo in range(0, len(ids), step):
            keep = held[lo : lo + step] > -np.inf
            query = np.broadcast_to(ids[lo : lo + step, None], keep.shape)
            yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(held_id[lo : lo + step][keep]), pa.array(held[lo : lo + step][keep])], ["query_id", "id", "score"])

    return run


def _keep(held_id: np.ndarray, held: np.ndarray, own: np.ndarray, score: np.ndarray, floor: float) -> None:
    """Put the scores (a row a query, a column a vector) that are among the best into held, in place.

    Scores count rounded to six digits; only those that may get in after rounding are rounded and sorted.
    """
    limit = held.shape[1]
    least = held[:, -1].copy()
    open_ = np.flatnonzero(least == -np.inf)
    if len(open_) and score.shape[1] > limit:
        least[open_] = np.partition(score[open_], -limit, axis=1)[:, -limit]
    row, col = np.nonzero(score >= np.maximum(least, floor)[:, None] - 1e-6)
    value = np.round(score[row, col], 6)
    row, col, value = row[value >= floor], col[value >= floor], value[value >= floor]
    touched = np.unique(row)
    old = held[touched] > -np.inf
    rows = np.concatenate([row, np.broadcast_to(touched[:, None], old.shape)[old]])
    found, values = np.concatenate([own[col], held_id[touched][old]]), np.concatenate([value, held[touched][old]])
    order = np.lexsort((found, -values, rows))
    rows, found, values = rows[order], found[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = place < limit
    held_id[rows[top], place[top]], held[rows[top], place[top]] = found[top], values[top]


def hydrate(found: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """found with the rows of table it names, in its order; ids without a row are dropped."""
    return found.join(table, key)
