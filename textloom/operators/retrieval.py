"""Vectors: norms, similarity, exact top-k in rounds, weighted means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent out in one round, at most; rows that meet them in one product.
QUERY_ROUND, ROW_BLOCK = 4096, 1024


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(vector: Column, length: Column) -> Column:
    """``vector`` over its ``length``; unchanged if that is zero."""
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def scaled(vector: Column, kind: str, p: float = 2.0) -> Column:
    """``vector`` by its largest absolute value (``max``), its p-norm (``norm``) or as it is (``none``); unchanged
    where that is zero."""
    if kind == "none":
        return F.transform(vector, lambda x: x.cast("double"))
    size = {
        "max": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))),
        "norm": lambda v: F.pow(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")), F.lit(p))), F.lit(1.0 / p)),
    }[kind](vector)
    own = F.get(F.transform(F.array(F.struct(vector.alias("v"), size.alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double")))), F.lit(0))
    return F.when(vector.isNotNull(), own)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    fit = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fit, dot / (norm(a) * norm(b))).otherwise(0.0)


def weighted_mean(df: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """(keys, mean): the mean vector of a key by weight, dimensions summed map-side."""
    parts = df.select(*keys, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("dim", "x"))
    sums = parts.groupBy(*keys, "dim").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.sum("_w")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return sums.groupBy(*keys).agg(F.transform(ordered, lambda s: s["x"]).alias("mean"))


def _rounds(queries: DataFrame, size: int) -> Iterator[dict[int, tuple[np.ndarray, ...]]]:
    """Queries (id, label, vector, excluded) in rounds of ``size``: by number of dimensions, ids, labels, unit
    vectors and excluded ids."""
    held: dict[int, list[tuple]] = {}

    def packed() -> dict[int, tuple]:
        out = {}
        for dims, rows in held.items():
            ids, labels, vectors, excluded = zip(*rows)
            v = np.array(vectors, dtype=np.float64)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            out[dims] = (np.array(ids), np.array([np.nan if x is None else x for x in labels]), np.divide(v, n, out=np.zeros_like(v), where=n > 0), excluded)
        return out

    count = 0
    for row in queries.toLocalIterator():
        if row[2]:
            held.setdefault(len(row[2]), []).append(tuple(row))
            count += 1
        if count == size:
            yield packed()
            held, count = {}, 0
    if count:
        yield packed()


def _best_of_partition(shared: Broadcast, top_k: int, bonus: float):
    """Keeps, over all rows of a partition, the ``top_k`` best a query, and gives them at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = {d: (np.full((len(q[0]), top_k), -np.inf), np.full((len(q[0]), top_k), np.iinfo(np.int64).max)) for d, q in queries.items()}

        def meet(dims: int, ids: list, labels: list, vectors: list) -> None:
            q_ids, q_labels, unit, excluded = queries[dims]
            v = np.array(vectors, dtype=np.float64)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            own = np.array(ids)
            label = np.array([np.nan if x is None else x for x in labels])
            sims = np.round(unit @ np.divide(v, n, out=np.zeros_like(v), where=n > 0).T + bonus * (q_labels[:, None] == label[None, :]), 6)
            sims[q_ids[:, None] == own[None, :]] = -np.inf
            for k, out in enumerate(excluded):
                if out:
                    sims[k, np.isin(own, out)] = -np.inf
            scores = np.concatenate([best[dims][0], sims], axis=1)
            names = np.concatenate([best[dims][1], np.broadcast_to(own, sims.shape)], axis=1)
            order = np.lexsort((names, -scores), axis=1)[:, :top_k]
            best[dims] = (np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1))

        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns)):
                if v and len(v) in queries:
                    ids, labels, vectors = held.setdefault(len(v), ([], [], []))
                    ids.append(i)
                    labels.append(label)
                    vectors.append(v)
                    if len(ids) == ROW_BLOCK:
                        meet(len(v), *held.pop(len(v)))
        for dims, rows in held.items():
            meet(dims, *rows)
        for dims, (scores, names) in best.items():
            q, k = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(queries[dims][0][q]), pa.array(names[q, k]), pa.array(scores[q, k])], names=["query_id", "id", "score"])

    return run


def nearest(
    df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, label_col: str, top_k: int, bonus: float = 0.02, exclude_col: str | None = None
) -> DataFrame:
    """(query_id, id, score, rank): the ``top_k`` rows most similar by cosine, plus ``bonus`` for an equal label;
    ties go to the smaller id; a row is no match of itself, nor of a query whose ``exclude_col`` (array<bigint>)
    holds its id.

    Exact. Queries are sent out in rounds of at most ``QUERY_ROUND``; every partition of the rows is read once a
    round, by matrix products, and keeps a running top-k, so what is shuffled is top-k lists of partitions. Empty
    vectors and vectors of another length than the query's match nothing; a null label equals none.
    """
    pick = lambda d: d.select(F.col(id_col).cast("bigint"), F.col(label_col).cast("int"), F.col(vector_col).cast("array<double>"))
    excluded = (F.col(exclude_col).cast("array<bigint>") if exclude_col else F.lit(None).cast("array<bigint>")).alias("_x")
    asked = queries.select(F.col(id_col).cast("bigint"), F.col(label_col).cast("int"), F.col(vector_col).cast("array<double>"), excluded)
    rows, spark = pick(df).where(F.col(id_col).isNotNull()), df.sparkSession
    parts: DataFrame | None = None
    for round_ in _rounds(asked.where(F.col(id_col).isNotNull()), QUERY_ROUND):
        shared = spark.sparkContext.broadcast(round_)
        part = rows.mapInArrow(_best_of_partition(shared, top_k, bonus), "query_id bigint, id bigint, score double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
