"""Nearest neighbours in a table of vectors by cosine."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Query vectors that travel to every task; more of them are searched block by block.
MAX_QUERIES = 4096
#: Rows of a block on either side, at most. Both sides travel once for each block of the other.
BLOCK_ROWS = 32_768
#: Queries that are multiplied at once, and the parts of their products of which the largest are looked for.
_AT_ONCE, _PARTS = 256, 32


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _close(asked: np.ndarray, vectors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places among which are those of the n most similar vectors of each row, by products of single precision.

    The largest of n parts of a row are n products, so the n-th of all is no less
    than the n-th of these. What may be larger by the error of a product stays too."""
    width = -(-len(vectors) // _PARTS)
    if width < 2 * n:
        return tuple(x.ravel() for x in np.indices((len(asked), len(vectors))))
    error = (asked.shape[1] + 8) * 2.0**-23
    right = np.zeros((width * _PARTS, vectors.shape[1]), dtype=np.float32)
    right[: len(vectors)] = vectors
    rows, places = [], []
    for a in range(0, len(asked), _AT_ONCE):
        product = asked[a : a + _AT_ONCE].astype(np.float32) @ right.T
        product[:, len(vectors) :] = -np.inf
        parted = product.reshape(len(product), _PARTS, width)
        largest = parted.max(axis=1)
        least = np.partition(largest, width - n, axis=1)[:, width - n] - np.float32(2 * error)
        row, part = np.nonzero(largest >= least[:, None])
        some, of = np.nonzero(parted[row, :, part] >= least[row, None])
        rows.append(a + row[some])
        places.append(of * width + part[some])
    return np.concatenate(rows), np.concatenate(places)


def _nearest(ids: np.ndarray, asked: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int, key: str) -> pd.DataFrame:
    """The k nearest of own to each of ids, itself left out; of equal ones (to nine digits) those of smaller keys."""
    q, v = _close(asked, vectors, k + 1)
    other = ids[q] != own[v]
    q, v = q[other], v[other]
    value = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", asked[q[a : a + (1 << 16)]], vectors[v[a : a + (1 << 16)]]) for a in range(0, len(q), 1 << 16))]).round(9)
    order = np.lexsort((own[v], -value, q))
    q, v, value = q[order], v[order], value[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pd.DataFrame({"query": ids[q[best]], key: own[v[best]], "similarity": value[best]})


def most_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query, key, similarity, rank): the k nearest of each query, itself left out.

    Exact. With up to MAX_QUERIES queries every task holds them all and finds the
    k nearest of its own rows, so only k rows a query and task are shuffled. Beyond,
    both sides are cut into blocks and every pair of blocks is one matrix product.
    Rows without key or vector are left out."""
    some = F.col(key).isNotNull() & F.col(value).isNotNull()
    vectors, queries = vectors.where(some).select(key, value), queries.where(some).select(key, value)
    rows = queries.limit(MAX_QUERIES + 1).collect()
    schema = f"query long, {key} long, similarity double"
    if len(rows) > MAX_QUERIES:
        near = _by_blocks(vectors, queries, k, key, value, schema)
    else:
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        asked = _unit(r[1] for r in rows) if rows else None

        def run(batches):
            for batch in batches:
                if asked is not None and len(batch):
                    yield _nearest(ids, asked, batch[key].to_numpy(), _unit(batch[value]), k, key)

        near = vectors.mapInPandas(run, schema)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), key)))
    return ranked.where(F.col("rank") <= k)


def _by_blocks(vectors: DataFrame, queries: DataFrame, k: int, key: str, value: str, schema: str) -> DataFrame:
    # blocks are as large as memory allows, but there are pairs of them for every core
    least = math.ceil(math.sqrt(4 * vectors.sparkSession.sparkContext.defaultParallelism))
    parts = lambda df: max(least, -(-df.count() // BLOCK_ROWS))
    n_q, n_v = parts(queries), parts(vectors)
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a number of partitions that is asked for stays: small pairs are a lot of work and aren't put together
    dealt = lambda df: df.repartition(n_q * n_v, "_q", "_v")
    left = dealt(queries.select(key, value, block(n_q).alias("_q"), every(n_v).alias("_v")))
    right = dealt(vectors.select(key, value, block(n_v).alias("_v"), every(n_q).alias("_q")))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        return _nearest(a[key].to_numpy(), _unit(a[value]), b[key].to_numpy(), _unit(b[value]), k, key)

    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(pair, schema)
