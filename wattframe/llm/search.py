"""Exact top-k inner products by ball-tree branch and bound.

Vectors are quantised to integers in the JVM and written once. A shard is a run of rows that a task reads: it builds
a ball tree over them and searches it for a block of queries. Nodes are bounded by q.c + |q| r; a query descends
into the best node first, then visits the leaves whose bound can still reach its k-th best score, in falling
order of the bound, and drops the rest. The k-th scores are shared: a first wave searches a few shards, its merged
k-th scores are broadcast with the queries, and all other shards start from them.

Queries go in blocks of a fixed number of rows, so that what is broadcast and held per task has a bound; more
queries make more blocks, each a pass over the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import materialize, scratch_dir

SHARD_ROWS = 20_000
LEAF_ROWS = 64
QUERY_BLOCK = 8_192
FIRST_WAVE = 0.05
_EXACT = float(1 << 53)
_LOWEST = -(1 << 63)
_HIGHEST = (1 << 63) - 1
#: `beyond` is null inside 64 bits; at the ends it holds the whole score, in bytes that sort like the number.
_RESULT = "query_id bigint, vec_id bigint, score bigint, beyond binary"
_FOUND = ["query_id", "vec_id", "score", "beyond"]
_BEYOND_BYTES = 24


def quantise(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) per component, as 64-bit integers (saturating)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _usable(vector: Column) -> Column:
    # NaN equals NaN in Spark, and infinity minus itself is NaN
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double") - x.cast("double")))
    return vector.isNotNull() & finite


@dataclass
class _Tree:
    """Rows reordered so that a node is a run of them; nodes in levels, children of i at first[i], first[i] + 1."""

    vectors: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    center: np.ndarray
    radius: np.ndarray


def _build(vectors: np.ndarray, ids: np.ndarray) -> _Tree:
    """Splits a node at the median along the direction between two far points, until it is a leaf."""
    order = np.arange(len(vectors))
    start, end, child, center, radius = [0], [len(vectors)], [-1], [], []
    i = 0
    while i < len(start):
        rows = vectors[order[start[i]:end[i]]]
        middle = rows.mean(axis=0)
        away = ((rows - middle) ** 2).sum(axis=1)
        center.append(middle)
        radius.append(np.sqrt(away.max()) if len(rows) else 0.0)
        if len(rows) > LEAF_ROWS and away.max() > 0:
            far = rows[away.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            cut = len(rows) // 2
            side = np.argpartition(rows @ (far - other), cut)
            order[start[i]:end[i]] = order[start[i]:end[i]][side]
            child[i] = len(start)
            at = start[i] + cut
            start += [start[i], at]
            end += [at, end[i]]
            child += [-1, -1]
        i += 1
    return _Tree(vectors[order], ids[order], np.array(start), np.array(end), np.array(child), np.array(center), np.array(radius))


class _Best:
    """The k best (score, id) of each query, best first, ties to the smaller id; empty places hold the floor."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def limit(self) -> np.ndarray:
        """What a score must reach to matter."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        pick = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(score, pick, axis=1)
        self.ids[rows] = np.take_along_axis(ids, pick, axis=1)


def _search(tree: _Tree, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> _Best:
    best = _Best(len(queries), k, floor)
    norm = np.sqrt((queries**2).sum(axis=1))

    def bound(nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        inner = np.einsum("ij,ij->i", queries[rows], tree.center[nodes]) + norm[rows] * tree.radius[nodes]
        # rounding must not make a bound too small
        return inner + 1e-9 * norm[rows] * (np.sqrt((tree.center[nodes] ** 2).sum(axis=1)) + tree.radius[nodes]) + 1e-6

    def visit(leaf: int, rows: np.ndarray) -> None:
        part = slice(tree.start[leaf], tree.end[leaf])
        score = queries[rows] @ tree.vectors[part].T
        score[query_ids[rows][:, None] == tree.ids[part][None, :]] = -np.inf
        best.add(rows, score, tree.ids[part])

    def by_leaf(leaves: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(leaves, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
            if len(group):
                visit(int(leaves[group[0]]), rows[group])

    everyone = np.arange(len(queries))
    # descend: each query to the child with the higher bound, down to a leaf
    node = np.zeros(len(queries), np.int64)
    while (inner := tree.child[node] >= 0).any():
        rows = everyone[inner]
        left = tree.child[node[rows]]
        node[rows] = left + (bound(left + 1, rows) > bound(left, rows))
    by_leaf(node, everyone)
    seen = node
    # branch and bound over the levels
    rows, nodes = everyone, np.zeros(len(queries), np.int64)
    leaves, leaf_rows, leaf_bounds = [], [], []
    while len(rows):
        limit = bound(nodes, rows)
        alive = limit >= best.limit()[rows]
        rows, nodes, limit = rows[alive], nodes[alive], limit[alive]
        at_leaf = tree.child[nodes] < 0
        fresh = at_leaf & (nodes != seen[rows])
        leaves.append(nodes[fresh])
        leaf_rows.append(rows[fresh])
        leaf_bounds.append(limit[fresh])
        rows, left = rows[~at_leaf], tree.child[nodes[~at_leaf]]
        rows, nodes = np.concatenate([rows, rows]), np.concatenate([left, left + 1])
    leaf, row, limit = np.concatenate(leaves), np.concatenate(leaf_rows), np.concatenate(leaf_bounds)
    # each query's leaves in falling order of their bounds, the n-th of all queries together
    order = np.lexsort((-limit, row))
    leaf, row, limit = leaf[order], row[order], limit[order]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
    turn = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
    order = np.argsort(turn, kind="stable")
    for now in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
        now = now[limit[now] >= best.limit()[row[now]]]
        by_leaf(leaf[now], row[now])
    return best


def _matrix(column: pa.Array) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integers beyond the doubles' exact range, as whole numbers of any size."""
    return queries.astype(object) @ vectors.astype(object).T


def _beyond(score: int) -> bytes | None:
    """The score as sortable bytes where 64 bits saturate; |score| is below 2^126 times the vector's length."""
    if _LOWEST < score < _HIGHEST:
        return None
    return (score + (1 << (8 * _BEYOND_BYTES - 1))).to_bytes(_BEYOND_BYTES, "big")


def _search_rows(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    query_ids, queries, floor = shared.value
    held_ids: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def shard() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(held_ids)
        lengths = np.array([len(v) for v in held])
        for length in np.unique(lengths):
            mine, theirs = np.flatnonzero(lengths == length), np.flatnonzero([len(q) == length for q in queries])
            if not len(theirs):
                continue
            x = np.stack([held[i] for i in mine]).reshape(len(mine), length)
            q = np.stack([queries[i] for i in theirs]).reshape(len(theirs), length)
            large = np.sqrt((x.astype(float) ** 2).sum(axis=1).max() * (q.astype(float) ** 2).sum(axis=1).max())
            if large < _EXACT:
                best = _search(_build(x.astype(float), ids[mine]), q.astype(float), query_ids[theirs], floor[theirs], k)
                keep = (best.score > -np.inf) & (best.score >= floor[theirs][:, None])
                row, place = np.nonzero(keep)
                found = query_ids[theirs][row], best.ids[row, place], best.score[row, place].astype(np.int64)
                beyond = pa.nulls(len(row), pa.binary())
            else:  # huge components: whole numbers, without a tree
                score = _exact_scores(q, x)
                apart = query_ids[theirs][:, None] != ids[mine][None, :]
                found, exact = ([], [], []), []
                for r in range(len(theirs)):
                    ranked = sorted((-int(s), int(i)) for s, i, a in zip(score[r], ids[mine], apart[r], strict=True) if a)[:k]
                    found[0].extend([int(query_ids[theirs[r]])] * len(ranked))
                    found[1].extend([i for _, i in ranked])
                    found[2].extend([max(min(-s, _HIGHEST), _LOWEST) for s, _ in ranked])
                    exact.extend([_beyond(-s) for s, _ in ranked])
                beyond = pa.array(exact, pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found), beyond], _FOUND)

    rows = 0
    for batch in batches:
        for start in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(start, SHARD_ROWS)
            if rows and rows + part.num_rows > SHARD_ROWS:
                yield from shard()
                held_ids, held, rows = [], [], 0
            held_ids.append(part.column("id").to_numpy(zero_copy_only=False))
            held.extend(_matrix(part.column("q")))
            rows += part.num_rows
    if rows:
        yield from shard()


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", row_id: str = "vec_id",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among rows of other ids, all if fewer.

    Ties go to the smaller id. Rows with a null id, a null vector, or null or non-finite components take no part.
    Vectors of different length have no inner product. Rows that share an id are candidates of their own, and a
    query ignores all rows of its id; several vectors of one query id are answered together. Scores are exact
    integers; ranks follow their full values, and what is returned saturates at 64 bits, as components do. Empty
    tables give an empty result.
    """
    spark = vectors.sparkSession

    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col(row_id).isNotNull() & _usable(F.col(vector)))
        return rows.select(F.col(row_id).cast("bigint").alias("id"), quantise(F.col(vector)).alias("q"))

    stored = materialize(prepared(vectors), "search-vectors")
    asked = prepared(queries).distinct()
    asked = materialize(asked.withColumn("at", F.pmod(F.xxhash64("id", "q"), F.lit(1 << 20))), "search-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    first = F.pmod(F.xxhash64("id"), F.lit(1000)) < int(1000 * FIRST_WAVE)
    path = scratch_dir(spark, "search-result")
    for block in range(blocks):
        low, high = (block << 20) // blocks, ((block + 1) << 20) // blocks
        rows = asked.where((F.col("at") >= low) & (F.col("at") < high)).select("id", "q").toArrow()
        ids, matrix = rows.column("id").to_numpy().astype(np.int64), _matrix(rows.column("q"))

        def wave(part: DataFrame, floor: np.ndarray, ids=ids, matrix=matrix) -> DataFrame:
            shared = spark.sparkContext.broadcast((ids, matrix, floor))
            return part.mapInArrow(lambda batches: _search_rows(shared, k, batches), _RESULT)

        # at most QUERY_BLOCK * k rows come back
        start = wave(stored.where(first), np.full(len(ids), -np.inf))
        start = materialize(_best_rows(start, k), "search-first-wave")
        last = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()
        reached = {r["query_id"]: float(r["s"]) for r in last}
        floor = np.array([reached.get(int(i), -np.inf) for i in ids])
        # beyond the exact doubles the floor is left open
        floor = np.where(np.abs(floor) < _EXACT, floor, -np.inf)
        found = start.select(_FOUND).unionAll(wave(stored.where(~first), floor))
        _best_rows(found, k).write.parquet(f"{path}/block={block}")
    result = spark.read.schema(f"{_RESULT}, rank int").parquet(*[f"{path}/block={b}" for b in range(blocks)])
    return _best_rows(result.select(_FOUND), k).drop("beyond")


def _best_rows(rows: DataFrame, k: int) -> DataFrame:
    """The k best per query; Spark cuts each task's rows to k per query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return (
        rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "beyond")
    )


#: DuckDB: every query against every row.
ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
