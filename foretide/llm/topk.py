"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, and each segment is summed up by its mean and deviation. For two vectors q and c,
|q - c|^2 is at least the sum over segments of L ((mq - mc)^2 + (sq - sc)^2), L being the segment's length; with both norms
known that is the same as: the inner product is at most the sum of L (mq mc + sq sc). Both are one product of short rows of
statistics. Bounds are taken from few segments to many, each only for pairs that the last one left, and the exact inner product
only for pairs that no bound could rule out. Where most pairs are left, a level is one matrix product over all of them.

The same bound holds for groups: rows are dealt to the nearest of a bounded number of pivots, and a group's statistics lie between its
lowest and its highest ones. A query first meets a bounded sample of rows, and what it finds there bounds its k-th best score
from below; then it is sent only to groups whose bound reaches that. Groups are cut into blocks of bounded size, each pair of
a block of queries and one of rows is one group, and a window over the winners of all blocks gives the ranks.

Vectors that point every way alike leave no bound to rule out groups, and every query meets every row, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import checkpointed, table

SCALE = 256
SEGMENTS = (4, 8, 16, 32)
#: Rows in a block, at most about.
QUERIES = 8192
CANDIDATES = 32768
#: Pairs are looked at for so many queries at a time.
AT_ONCE = 64
#: Groups at most, each of so many rows at least; rows that every query meets first; and numbers in all of these, at most.
PIVOTS = 256
GROUP = 2048
SAMPLE = 2048
NUMBERS = 1 << 20
#: Share of pairs beyond which a level is computed for all of them at once.
DENSE = 0.02
_LONG = (-(2**63), 2**63 - 1)
_ROW = "vec_id long, dim int, vector binary"


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not vector.is_valid or vector.values.null_count:
                    continue
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(values).all() and np.isfinite(values := np.floor(values * scale)).all():
                    ids.append(vec_id)
                    dims.append(len(values))
                    packed.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "dim", "vector"])

    return run


def _matrix(vectors) -> np.ndarray:
    vectors = list(vectors)
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, times the root of their length."""
    out = []
    for part in np.array_split(rows, segments, axis=1):
        root = np.sqrt(part.shape[1])
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1)


def _exact(queries: np.ndarray, rows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products of whole numbers; beyond what doubles hold exactly in Python's numbers, kept within 64 bits."""
    most = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    if most * most * queries.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", queries[pairs[0]], rows[pairs[1]]).astype(np.int64)
    whole = lambda x: [int(v) for v in x]
    sums = [sum(a * b for a, b in zip(whole(queries[i]), whole(rows[j]), strict=True)) for i, j in zip(*pairs, strict=True)]
    return np.array([min(max(s, _LONG[0]), _LONG[1]) for s in sums], np.int64)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None, segments: tuple[int, ...] = SEGMENTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, places of rows, scores) of the k best rows of each query, and of some more. least: what is known to be no
    more than a query's k-th best score among all rows. Rows with the query's id are passed over."""
    known = np.full(len(queries), -np.inf) if least is None else least
    levels = [(statistics(queries, s), statistics(rows, s)) for s in segments if s <= rows.shape[1]]
    slack = np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0) * 1e-9 + 1e-6
    most = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    whole = most * most * queries.shape[1] < 2.0**53  # products are exact in any order
    for a in range(0, len(queries), AT_ONCE):
        part, own, margin = queries[a : a + AT_ONCE], query_ids[a : a + AT_ONCE], slack[a : a + AT_ONCE]
        bounds = levels[0][0][a : a + AT_ONCE] @ levels[0][1].T if levels else np.full((len(part), len(rows)), np.inf)
        bounds[own[:, None] == ids[None, :]] = -np.inf
        some = min(4 * k, len(rows))
        first = np.argpartition(-bounds, some - 1, axis=1)[:, :some]
        pairs = (np.repeat(np.arange(len(part)), some), first.ravel())
        scores = _exact(part, rows, pairs).astype(np.float64)
        scores[np.isneginf(bounds[pairs])] = -np.inf
        scores = np.sort(scores.reshape(len(part), some), axis=1)
        needed = known[a : a + AT_ONCE]
        if some >= k:  # the k-th best cannot be lower
            needed = np.maximum(needed, scores[:, -k])
        left = (bounds + margin[:, None] >= needed[:, None]) & ~np.isneginf(bounds)
        for of_queries, of_rows in levels[1:]:
            if left.mean() > DENSE:
                left &= of_queries[a : a + AT_ONCE] @ of_rows.T + margin[:, None] >= needed[:, None]
            else:
                q, c = np.nonzero(left)
                left[q, c] = np.einsum("ij,ij->i", of_queries[a + q], of_rows[c]) + margin[q] >= needed[q]
        if whole and left.mean() > DENSE:
            products = part @ rows.T
            left &= products >= needed[:, None]
            q, c = np.nonzero(left)
            exact = products[q, c].astype(np.int64)
        else:
            q, c = np.nonzero(left)
            exact = _exact(part, rows, (q, c))
        kept = exact >= needed[q]
        yield a + q[kept], c[kept], exact[kept]


def _best(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: pd.Series, k: int) -> pd.DataFrame:
    """query (its place), vec_id, score of the k best of each query."""
    parts = list(found)
    q, c, score = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    out = pd.DataFrame({"query": q, "vec_id": ids.iloc[c].to_numpy(), "score": score})
    return out.sort_values(["query", "score", "vec_id"], ascending=[True, False, True], na_position="last").groupby("query").head(k)


#: An id that stands for none in comparisons; a query has one that is divisible, and this is not used as such.
_NONE = _LONG[0] + 1


def _numbers(ids: pd.Series) -> np.ndarray:
    return ids.fillna(_NONE).to_numpy(np.int64)


def _rows(batch: pa.RecordBatch) -> pd.DataFrame:
    return batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def _deal(pivots: dict[int, np.ndarray]):
    """pivot: the place of the nearest one by the finest statistics, among those of the same length; -1 if there is none."""
    segments = SEGMENTS[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = _rows(part)
                to = np.full(len(rows), -1)
                for dim, index in rows.groupby("dim").indices.items():
                    if dim in pivots and dim:
                        mine, theirs = (statistics(x, min(segments, dim)) for x in (_matrix(rows["vector"].iloc[index]), pivots[dim]))
                        to[index] = ((theirs**2).sum(axis=1) - 2 * mine @ theirs.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to, pa.int32())], [*part.schema.names, "pivot"])

    return run


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lowest and highest statistics of each pivot's rows in a task."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rows = _rows(batch.slice(at, 4096))
            for (dim, pivot), index in rows.groupby(["dim", "pivot"]).indices.items():
                if pivot >= 0:
                    of = statistics(_matrix(rows["vector"].iloc[index]), min(SEGMENTS[-1], dim))
                    ends = np.stack([-of.min(axis=0), of.max(axis=0)])
                    held[dim, pivot] = np.maximum(held[dim, pivot], ends) if (dim, pivot) in held else ends
    keys = list(held)
    columns = [pa.array([x[i] for x in keys], pa.int32()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([held[x].ravel().tolist() for x in keys], pa.list_(pa.float64()))], ["dim", "pivot", "ends"])


def _sent(k: int, sample: dict[int, tuple[np.ndarray, np.ndarray]], ends: dict[int, np.ndarray]):
    """least, and a row for each pivot (-1 for rows without one) whose group can hold one of the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = _rows(part)
                takes, pivots, leasts = [], [], []
                for dim, index in rows.groupby("dim").indices.items():
                    queries, least = _matrix(rows["vector"].iloc[index]), np.full(len(index), -np.inf)
                    if dim in sample:
                        found = _best(search(_numbers(rows["vec_id"].iloc[index]), queries, sample[dim][0], sample[dim][1], k), pd.Series(sample[dim][0]), k)
                        full = found.groupby("query")["score"].agg(["size", "min"])
                        full = full[full["size"] == k]
                        least[full.index.to_numpy(np.int64)] = full["min"].to_numpy()
                    reach = np.ones((len(index), 1), bool)
                    if dim in ends:
                        of = statistics(queries, min(SEGMENTS[-1], dim))
                        low, high = -ends[dim][:, 0], ends[dim][:, 1]
                        bound = np.maximum(of, 0) @ high.T + np.minimum(of, 0) @ low.T
                        slack = np.linalg.norm(of, axis=1)[:, None] * np.linalg.norm(np.maximum(np.abs(low), np.abs(high)), axis=1) * 1e-9 + 1e-6
                        reach = np.concatenate([reach, bound + slack >= least[:, None]], axis=1)
                    q, to = np.nonzero(reach)
                    takes.append(index[q])
                    pivots.append(to - 1)
                    leasts.append(least[q])
                taken = part.take(pa.array(np.concatenate(takes)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(pivots), pa.int32()), pa.array(np.concatenate(leasts), pa.float64())], [*part.schema.names, "pivot", "least"])

    return run


def _cell(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})
        queries, rows = queries.reset_index(drop=True), rows.reset_index(drop=True)
        ids = pd.Series([None if x is None or x != x else int(x) for x in rows["vec_id"].tolist()], dtype="Int64")
        best = _best(search(queries["vec_id"].to_numpy(np.int64), _matrix(queries["vector"]), _numbers(ids), _matrix(rows["vector"]), k, queries["least"].to_numpy(np.float64)), ids, k)
        return pd.DataFrame({"query_id": queries["vec_id"].to_numpy(np.int64)[best["query"].to_numpy(np.int64)], "vec_id": best["vec_id"].array, "score": best["score"].to_numpy()})

    return run


def _by_dim(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of each length, as many as NUMBERS allows; lengths of over NUMBERS go without."""
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.dim, []).append(r)
    kept = {dim: of[: max(1, NUMBERS // max(1, dim * len(out)))] for dim, of in out.items() if dim <= NUMBERS // len(out)}
    return {dim: (np.array([_NONE if r.vec_id is None else r.vec_id for r in of]), _matrix(r.vector for r in of)) for dim, of in kept.items()}


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, queries: int = QUERIES, candidates: int = CANDIDATES, pivots: int = PIVOTS, group_rows: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding) for which is_query, a condition
    on vec_id, holds, the k rows with the highest inner product of floor(scale x), ties to the smaller vec_id.

    All rows but those with the query's own vec_id are candidates, those without a vec_id as well, which come last in a tie and
    are never queries. Vectors that are null or hold nulls, NaN or infinities take no part. Only vectors of one length are
    compared; empty ones score 0. Rows that repeat a vec_id are candidates each; as queries their lists are merged. Scores
    beyond 64 bits are held at their ends. An empty table, or no query, gives an empty result.

    The driver gets `pivots` + SAMPLE vectors, NUMBERS numbers at most, and two rows of statistics for each pivot.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = checkpointed(given.mapInArrow(_scaled(scale), _ROW))
    fits = rows.filter(F.col("dim") <= NUMBERS)
    some = _by_dim(fits.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).collect())
    groups = max(1, min(pivots, rows.count() // group_rows))
    chosen = {dim: of[1][:groups] for dim, of in some.items()}
    dealt = checkpointed(rows.mapInArrow(_deal(chosen), _ROW + ", pivot int"))
    ends: dict[int, np.ndarray] = {}
    extents = dealt.mapInArrow(_extent, "dim int, pivot int, ends array<double>").select("dim", "pivot", F.posexplode("ends").alias("at", "x"))
    extents = extents.groupBy("dim", "pivot", "at").agg(F.max("x").alias("x")).groupBy("dim", "pivot").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("ends"))
    for r in extents.collect():  # a pivot has two rows of statistics
        ends.setdefault(r.dim, np.full((len(chosen[r.dim]), 2, 2 * min(SEGMENTS[-1], r.dim)), -np.inf))[r.pivot] = np.array([e.x for e in r.ends]).reshape(2, -1)
    ends = {dim: np.where(np.isinf(x), 0, x) for dim, x in ends.items()}
    asked = checkpointed(dealt.filter(is_query & F.col("vec_id").isNotNull()).drop("pivot").mapInArrow(_sent(k, some, ends), _ROW + ", pivot int, least double"))
    group, parts = ["dim", "pivot"], lambda n, most: F.ceil(F.count(F.lit(1)) / most).cast("int").alias(n)
    sizes = checkpointed(dealt.groupBy(group).agg(parts("row_blocks", candidates)).join(asked.groupBy(group).agg(parts("query_blocks", queries)), group))
    spread = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, group).withColumn("query_block", spread("query_blocks", "vec_id", "vector")).withColumn("row_block", each("row_blocks"))
    right = dealt.withColumn("salt", F.monotonically_increasing_id()).join(sizes, group)
    right = right.withColumn("row_block", spread("row_blocks", "salt")).withColumn("query_block", each("query_blocks"))
    cell = [*group, "query_block", "row_block"]
    columns = [*cell, "vec_id", "vector"]
    best = left.select(*columns, "least").groupBy(cell).cogroup(right.select(*columns).groupBy(cell)).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a vec_id are candidates each; those without one are candidates, never queries."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH whole AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
