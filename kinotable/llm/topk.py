"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are quantised to integers. A task indexes its vectors in blocks: each non-zero component is a posting of its
dimension, its impact is quantised to the number of its bits, and the postings of one impact and dimension are a segment.
Queries come to all tasks in blocks of bounded size and take the segments of a block impact by impact, the highest first,
each adding to accumulators; segments of dimensions that no query of a batch has are not read. After each impact the norm
of what a vector has left bounds what it can still gain or lose. A batch of queries stops only once the bounds prove which
few vectors can be among its best, held against the best of all blocks before; those possible members are scored exactly.
A task gives the best of all its blocks, so what is shuffled is a few rows for each query and task, and no vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinotable.llm import _text

K = 20
SCALE = 64
QUERY_STEP = 20
#: Vectors of an index block, queries that share one table of accumulators, and bytes of queries that go to the tasks at once.
BLOCK, BATCH, QUERY_BYTES = 4096, 256, 32 << 20
#: Possible members for each of the k wanted at which a batch stops early and rescores.
MEMBERS = 4

_FOUND = "query_row long, query_id long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (another number for each row), vec_id and x (integer components) of the vectors that take part. Written rows keep their number."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    # NaN and the infinities, times zero, are not zero
    v = v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & (x * 0 == 0)))
    return v.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda c: F.floor(c * scale)).alias("x"))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of two equally long integer tables; without bound on the way, then held to a long."""
    if int(np.abs(x.astype(np.float64)).max(initial=0)) * int(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, x.shape[1]) < 1 << 62:
        return np.einsum("ij,ij->i", x, q)
    sums = (x.astype(object) * q.astype(object)).sum(1)
    return np.array([max(_NONE + 1, min(-(_NONE + 1), int(s))) for s in sums], np.int64)


class Best:
    """The best k found so far of each query, as (query, -score, vec_id, row) rows."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, _NONE)  # the k-th best score, once there are k
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        rows = [np.concatenate([a, b]) for a, b in zip(self.rows, (query, -score, vec_id, row), strict=True)]
        order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
        rows = [r[order] for r in rows]
        first = np.searchsorted(rows[0], rows[0])
        kept = np.arange(len(first)) - first < self.k
        self.rows = [r[kept] for r in rows]
        last = np.flatnonzero((np.arange(len(first)) - first)[kept] == self.k - 1)
        self.least[self.rows[0][last]] = -self.rows[1][last]


class Index:
    """Posting segments of one block of vectors: by impact, highest first, then by dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.rows, self.x = ids, rows, x
        self.postings, self.read = int(np.count_nonzero(x)), 0
        size = np.abs(x.astype(np.float64))
        impact = np.frexp(size)[1]
        self.levels: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        left = (size**2).sum(1)
        for at in sorted(set(impact[x != 0].tolist()), reverse=True):
            here = (impact == at) & (x != 0)
            dims, where = np.nonzero(here.T)
            ends = np.searchsorted(dims, np.arange(x.shape[1] + 1))
            segments = [(d, where[a:b], x[where[a:b], d]) for d, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            left = left - np.where(here, size**2, 0).sum(1)
            self.levels.append((segments, np.sqrt(np.maximum(left, 0)) if (impact[x != 0] < at).any() else np.zeros(len(x))))

    def search(self, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of each vector that can be among a query's k best, if it has to reach the score in `least`."""
        n, most = len(self.ids), float(np.abs(self.x.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(1, self.x.shape[1])
        if most >= 1 << 52 or not self.levels:  # beyond exact accumulators, or nothing to tell vectors apart: all are possible
            return np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        kind = np.float32 if most < 1 << 22 else np.float64  # sums are exact in it
        q = np.ascontiguousarray(queries.T).astype(kind)
        got, used = np.zeros((n, len(queries)), kind), (q != 0).any(1)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
        for segments, left in self.levels:
            for d, where, x in segments:
                if used[d]:
                    got[where] += x.astype(kind)[:, None] * q[d]
                    self.read += len(where)
            slack = (left[:, None] * norms).astype(kind)
            goal = least.astype(np.float64)
            if n > k and (least == _NONE).any():
                goal = np.maximum(goal, np.partition(got - slack, n - k, axis=0)[n - k])
            possible = got + slack >= (goal - np.abs(goal) * 1e-6 - 1e-3)
            if possible.sum() <= MEMBERS * k * len(queries):
                break
        at, query = np.nonzero(possible)
        return query, at


def _searching(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value  # by number of dimensions: rows, ids and components
        best = {dims: Best(len(q[0]), k + 1) for dims, q in queries.items()}
        for batch in _text.parts(batches, BLOCK):
            x, ids, rows = batch.column("x"), batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
            long = pa.compute.list_value_length(x).to_numpy(zero_copy_only=False)
            for dims in np.unique(long).tolist():
                if dims not in queries:
                    continue
                own = np.flatnonzero(long == dims)
                index = Index(ids[own], rows[own], x.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dims))
                _, _, q = queries[dims]
                for at in range(0, len(q), BATCH):
                    query, where = index.search(q[at : at + BATCH], best[dims].least[at : at + BATCH], k + 1)
                    for lo in range(0, len(query), 1 << 16):
                        u, v = query[lo : lo + (1 << 16)] + at, where[lo : lo + (1 << 16)]
                        best[dims].add(u, _products(index.x[v], q[u]), index.ids[v], index.rows[v])
        for dims, found in best.items():
            query, score, vec_id, row = found.rows
            asked, names, _ = queries[dims]
            other = asked[query] != row
            yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (asked[query], names[query], vec_id, -score)], ["query_row", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: for each query the k vectors with the highest inner product of quantised components.

    vectors and queries have (vec_id, embedding); by default each row of vectors whose id is a multiple of 20 is a query,
    and every row but its own is a candidate. Ties go to the smaller id. Repeated rows and ids each count: a repeated
    query gets its ranks once for each row. Null ids, null vectors and vectors with null or non-finite components take no
    part. Vectors are compared with those of the same length. Components and scores beyond a long count as its ends.
    An empty table gives no rows. Extra columns are ignored.
    """
    vecs = _text.settled(quantised(vectors, scale))
    asked = vecs.where(F.col("vec_id") % QUERY_STEP == 0) if queries is None else _text.settled(quantised(queries, scale).withColumn("row", -1 - F.col("row")))
    size = asked.agg(F.sum(F.size("x") + 2)).first()[0] or 0
    blocks, found = max(1, -(-8 * size // QUERY_BYTES)), []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "x", F.size("x").alias("dims")).toArrow()
        by = {}
        for dims in own.column("dims").unique().to_pylist():
            t = own.filter(pa.compute.equal(own.column("dims"), dims))
            by[dims] = (t.column("row").to_numpy(), t.column("vec_id").to_numpy(), t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, dims))
        sent = vectors.sparkSession.sparkContext.broadcast(by)
        part = vecs.select("row", "vec_id", "x").mapInArrow(_searching(sent, k), _FOUND)
        if blocks > 1:
            part = _text.settled(part)
            sent.destroy()
        found.append(part)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return every.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_text.table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r AND len(q.x) = len(v.x)),
s AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM s WHERE rank <= 20
"""
