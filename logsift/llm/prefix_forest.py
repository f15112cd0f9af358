"""Approximate nearest neighbours by cosine with a forest of hash-prefix trees.

Every vector gets one long hash string per tree. A symbol of the string names the axis (and its
sign) that the vector, turned by a random rotation, is closest to; near vectors share symbols far
more often than others, so a long common prefix means a small angle. A tree is the sorted array of
its strings. A query descends in every tree to its longest-prefix matches, and if all trees together
offer fewer than ``share`` of the rows as different candidates, all trees ascend by one symbol, until
they do; from there they ascend until one more symbol leaves the best unchanged. At the root everything
is a candidate. Candidates are ranked by their exact cosine.

The index is cut into blocks of rows, each a forest of its own that one task builds and asks, and the
best of all blocks are merged. So no task holds more than a block and a chunk of queries, whatever
the data look like: a dense cluster or a vector repeated in a third of the rows is spread by its id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import arrow_batch
from logsift.sources.scratch import materialize

AXES = 64
BITS = 7  # an axis of 64 and its sign
FOUND = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
)


def _rotation(seed: int, tree: int, level: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng((seed, tree, level))
    gauss = rng.standard_normal((max(dim, AXES), max(dim, AXES)))
    return np.linalg.qr(gauss)[0][:dim, :AXES].astype(np.float32)


def hash_strings(
    unit: np.ndarray, trees: int, symbols: int, seed: int, step: int = 4096
) -> np.ndarray:
    """One integer per tree and row; its leading 7-bit groups are the leading symbols."""
    out = np.zeros((trees, len(unit)), dtype=np.int64)
    for tree in range(trees):
        for level in range(symbols):
            rotation = _rotation(seed, tree, level, unit.shape[1])
            for at in range(0, len(unit), step):
                turned = unit[at : at + step] @ rotation
                axis = np.abs(turned).argmax(axis=1)
                sign = np.take_along_axis(turned, axis[:, None], axis=1)[:, 0] > 0
                part = out[tree, at : at + step]
                out[tree, at : at + step] = (part << BITS) | (axis * 2 + sign)
    return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two where their squares could overflow or vanish."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    extreme = (top > 1e150) | (top < 1e-150)
    return np.where(extreme, vectors / np.exp2(np.floor(np.log2(top))), vectors)


def search_block(
    ids, vectors, query_ids, queries, k, trees, symbols, share, seed
) -> list[tuple[int, int, float]]:
    """The ``k`` best of one block for each query, ties to the smaller id, never the query itself."""
    vectors, queries = _scaled(vectors), _scaled(queries)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    query_norms = np.sqrt((queries * queries).sum(axis=1))
    strings = hash_strings((vectors / norms[:, None]).astype(np.float32), trees, symbols, seed)
    asked = hash_strings((queries / query_norms[:, None]).astype(np.float32), trees, symbols, seed)
    order = np.argsort(strings, axis=1, kind="stable")
    strings = np.take_along_axis(strings, order, axis=1)

    # enough different ids, the query itself not counted; then at least one level more, until the best
    # are the same at two levels: in a crowded place the deep levels show only a part of the crowd
    wanted = max(k, math.ceil(share * len(ids)))
    best: list[tuple | None] = [None] * len(queries)
    open_ = np.arange(len(queries))
    for level in range(symbols, -1, -1):
        if not len(open_):
            break
        shift = BITS * (symbols - level)
        lo = np.zeros((trees, len(open_)), dtype=np.int64)
        hi = np.full((trees, len(open_)), len(ids), dtype=np.int64)
        for tree in range(trees if level else 0):
            first = (asked[tree, open_] >> shift) << shift
            lo[tree] = np.searchsorted(strings[tree], first, "left")
            hi[tree] = np.searchsorted(strings[tree], first + (1 << shift), "left")
        left = []
        for at, q in enumerate(open_):
            mark = np.zeros(len(ids), dtype=bool)
            for tree in range(trees if level else 1):
                mark[order[tree, lo[tree, at] : hi[tree, at]]] = True
            near = np.flatnonzero(mark)
            near = near[ids[near] != query_ids[q]]
            if level and len(near) < wanted:
                left.append(q)
                continue
            score = (vectors[near] * queries[q]).sum(axis=1) / (norms[near] * query_norms[q])
            top = np.lexsort((ids[near], -score))[:k]
            now = ids[near[top]], score[top]
            if best[q] is None or not np.array_equal(best[q][0], now[0]):
                left.append(q)
            best[q] = now
        open_ = np.array(left, dtype=np.int64)
    return [
        (int(query_id), int(i), float(s))
        for query_id, top in zip(query_ids, best, strict=True)
        for i, s in zip(*top, strict=True)
    ]


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): finite, non-zero vectors as doubles, one per id.

    Rows with a null id take no part; of several rows with one id the smallest vector counts.
    """
    vec = F.col("vec")
    finite = F.forall(
        vec,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return (
        df.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vec_col).cast("array<double>").alias("vec"),
        )
        .filter(F.col("vec_id").isNotNull() & vec.isNotNull())
        .filter(finite & F.exists(vec, lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
    )


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    is_query=None,
    k: int = 5,
    trees: int = 48,
    symbols: int = 6,
    share: float = 0.04,
    block_rows: int = 8192,
    chunk_queries: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other vectors by cosine.

    ``is_query`` is a condition on ``vec_id``; without one every vector asks. Null, zero and
    non-finite vectors neither ask nor are found; vectors of each length are searched by themselves. An
    empty table gives no rows. ``share`` trades work for recall: the trees
    ascend until they offer that share of a block as different rows, then on until the best stay.
    """
    vectors = materialize(valid_vectors(df, id_col, vec_col), "vectors")
    asks = F.lit(True) if is_query is None else is_query
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    sizes = vectors.groupBy(F.size("vec").alias("dim")).agg(
        parts(F.count("*"), block_rows).alias("blocks"), parts(F.count_if(asks), chunk_queries).alias("chunks")
    )
    sizes = materialize(sizes, "sizes")
    vectors = vectors.withColumn("dim", F.size("vec")).join(sizes, "dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    index = vectors.select(
        F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
        every("chunks").alias("chunk"),
        "vec_id",
        "vec",
        F.col("dim").alias("length"),
    )
    queries = vectors.filter(asks).select(
        every("blocks").alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"),
        F.col("vec_id").alias("query_id"),
        F.col("vec").alias("query"),
        F.col("dim").alias("length"),
    )

    def arrays(part: pa.Table):
        ids, vec = (part.column(at).combine_chunks() for at in (2, 3))
        return ids.to_numpy(), vec.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], FOUND)
        rows = search_block(*arrays(left), *arrays(right), k, trees, symbols, share, seed)
        names = ("query_id", "vec_id", "score")
        columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
        return pa.Table.from_batches([arrow_batch(FOUND, **columns)])

    keys = ("length", "block", "chunk")
    found = (
        index.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInArrow(ask, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
