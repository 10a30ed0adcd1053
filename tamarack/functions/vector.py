"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Bytes of query vectors that are broadcast at once (components are counted as doubles).
BROADCAST_BYTES = 64 << 20
#: Rows that are told apart by cell, rows and queries whose products are held at once.
_BATCH, _ROWS, _QUERIES = 16_384, 1024, 2048
#: Places of what is no similarity: not filled, NULL, NaN (which Spark orders above all numbers).
_EMPTY, _NULL, _NAN = -3.0, -2.0, 2.0


def plain_queries(queries: DataFrame) -> tuple[int, int, Column]:
    """Of queries (query_id, query): their number, their longest length, and whether one is a finite vector of that length that
    is not zero. Others are scored by the plain expression."""
    n, longest = queries.agg(F.count("*"), F.max(F.size("query"))).first()
    longest = max(0, longest or 0)
    plain = (F.size("query") == longest) & F.forall("query", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return n, longest, F.coalesce(plain & (dot(F.col("query"), F.col("query")) > 0), F.lit(False))


def nearest(vectors: DataFrame, queries: pa.Table, k: int, schema: T.StructType) -> DataFrame:
    """From each task over vectors (id, embedding) the k rows most like each of queries (query_id, query: finite vectors of one
    length, none of them zero): (query_id, id, similarity) of the given schema, similarity as round(cosine, 6), ties by lower id.

    With columns least and cells of the queries and place of the vectors, a query meets only rows whose place is a bit set in its
    cells, and rows below least (null: none) are left out."""
    matrix = queries.column("query").combine_chunks().flatten().to_numpy().reshape(queries.num_rows, -1)
    told = {"query_ids": queries.column("query_id").combine_chunks(), "units": matrix / np.linalg.norm(matrix, axis=1, keepdims=True)}
    by_cell = "cells" in queries.column_names
    if by_cell:
        told["cells"] = np.frombuffer(b"".join(queries.column("cells").to_pylist()), np.uint8).reshape(queries.num_rows, -1).T.copy()
        least = queries.column("least")
        told["least"] = np.where(least.is_null().to_numpy(), _EMPTY, np.nan_to_num(least.fill_null(0).to_numpy(), nan=_NAN))
    shared = vectors.sparkSession.sparkContext.broadcast(told)

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
        """Rows with the queries (None: all) that meet them."""
        if not by_cell:
            yield batch, None
            return
        place, cells = batch.column("place").to_numpy(), shared.value["cells"]
        order = np.argsort(place, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            p = place[at[0]]
            asking = np.flatnonzero(cells[p >> 3] & (128 >> (p & 7)))
            if len(asking):
                yield batch.take(pa.array(at)) if len(at) < batch.num_rows else batch, asking

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, units = shared.value["query_ids"], shared.value["units"]
        best, ids = np.full((len(units), k), _EMPTY), np.zeros((len(units), k), np.int64)
        floor = shared.value.get("least", np.full(len(units), _EMPTY))
        for batch in batches:
            for a in range(0, batch.num_rows, _BATCH):
                for group, asking in groups(batch.slice(a, _BATCH)):
                    for b in range(0, group.num_rows, _ROWS):
                        part = group.slice(b, _ROWS)
                        rows, null = _matrix(part.column("embedding"), units.shape[1])
                        own = part.column("id").to_numpy(zero_copy_only=False)
                        for q in range(0, len(units) if asking is None else len(asking), _QUERIES):
                            at = slice(q, q + _QUERIES) if asking is None or len(asking) == len(units) else asking[q : q + _QUERIES]
                            with np.errstate(invalid="ignore"):
                                near = units[at] @ rows.T
                            near[np.isnan(near)] = _NAN
                            near[:, null] = _NULL
                            _merge(best, ids, at, near, own, floor[at])
        q, place = np.nonzero(best > _EMPTY)
        value = best[q, place]
        told = pa.array(np.where(value == _NAN, np.nan, value), mask=value == _NULL)
        whole = pa.table([query_ids.take(pa.array(q)), pa.array(ids[q, place]), told], names=["query_id", "id", "similarity"])
        yield from whole.to_batches(max_chunksize=100_000)

    more = ["place"] if by_cell else []
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), *more).mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows have no similarity (null, null in a component, another length, zero)."""
    flat, lengths = column.flatten(), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    if (lengths == width).all() and not flat.null_count:
        rows, null = flat.to_numpy(zero_copy_only=False).reshape(len(column), width), np.zeros(len(column), bool)
    else:
        told = [x if x is not None and len(x) == width and None not in x else None for x in column.to_pylist()]
        null = np.array([x is None for x in told])
        rows = np.array([x or [0.0] * width for x in told])
    with np.errstate(invalid="ignore"):
        norm = np.linalg.norm(rows, axis=1)
        return rows / np.where(norm == 0, 1, norm)[:, None], null | (norm == 0)


def _merge(best: np.ndarray, ids: np.ndarray, at: slice | np.ndarray, near: np.ndarray, own: np.ndarray, floor: np.ndarray) -> None:
    """Puts rows `own` of similarity `near` (queries by rows) among the best of the queries `at`, in place; none below floor."""
    k = best.shape[1]
    least = np.maximum(best[at, -1], floor)
    if (least == _EMPTY).any() and near.shape[1] > k:
        least = np.maximum(least, -np.partition(-near, k - 1, axis=1)[:, k - 1])
    q, row = np.nonzero(near >= least[:, None] - 1e-6)
    if not len(q):
        return
    value = near[q, row]
    value = np.where(np.abs(value) < 1.5, np.sign(value) * np.floor(np.abs(value) * 1e6 + 0.5) / 1e6, value)
    met, q = np.unique(q, return_inverse=True)
    whole = np.arange(len(best))[at][met]
    q, value, found = np.concatenate([np.repeat(np.arange(len(met)), k), q]), np.concatenate([best[whole].ravel(), value]), np.concatenate([ids[whole].ravel(), own[row]])
    order = np.lexsort((found, -value, q))
    starts = np.searchsorted(q[order], np.arange(len(met)))
    taken = order[starts[:, None] + np.arange(k)]
    best[whole], ids[whole] = value[taken], found[taken]
