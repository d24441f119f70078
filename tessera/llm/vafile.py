"""Exact top-k inner-product search with vector-approximation files.

Each component is quantised to floor(256 * x). A vector's approximation keeps its cell numbers (value >> CELL_BITS); from
the cells alone an inner product is known up to a bound on each side. A block of candidates is scanned by its cells for
a block of queries; exact vectors are then read in order of their bounds until no unread bound reaches the kth exact
score. Query blocks and candidate blocks meet in groups (block of candidates, block of queries), and the best of each
group are merged.

Defined cases: vectors that are null, or hold a null, NaN or infinite component, take no part. A query is compared with
the vectors of its own length. Rows that repeat a vec_id are rows of their own; only the query's own row is left out.
Rows with a null vec_id take no part. Scores are exact; one outside the range of long is given as its nearest end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

CELL_BITS = 2
CANDIDATES = 4096
QUERIES = 8192
SUB = 256
OUT = "query_id long, query_row int, vec_id long, vec_row int, score long"


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(256.0 * flat.astype(np.float64)).reshape(t.num_rows, dim)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of two float matrices that hold integers."""
    if a.size == 0:
        return np.zeros(len(a), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array(
        [min(high, max(low, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for r, s in zip(a, b, strict=True)],
        np.int64,
    )


def search_block(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(query index, vector index, score) that hold each query's k best of a block; own: the query's own row in it or -1.

    ids are in order of preference among equal scores: ascending."""
    width = float(2**CELL_BITS - 1)
    with np.errstate(over="ignore", invalid="ignore"):
        low = np.floor(v / 2**CELL_BITS) * 2**CELL_BITS
        s = q @ low.T
        up = s + width * np.maximum(q, 0).sum(1)[:, None]
        slack = 1e-12 * (np.abs(q).sum(1) * np.abs(v).max(initial=0) + 1)[:, None] * v.shape[1]
        up = np.where(np.isnan(up), np.inf, up + slack)
    rows = np.flatnonzero(own >= 0)
    up[rows, own[rows]] = -np.inf
    k_here = min(k, v.shape[0])
    first = np.argpartition(-up, k_here - 1, axis=1)[:, :k_here] if v.shape[0] > k_here else np.tile(
        np.arange(v.shape[0]), (len(q), 1)
    )
    qi = np.repeat(np.arange(len(q)), first.shape[1])
    score = _exact(q[qi], v[first.ravel()]).reshape(first.shape).astype(float)
    score[np.take_along_axis(up, first, 1) == -np.inf] = -np.inf
    kth = np.nextafter(score.min(axis=1), -np.inf)
    qi, vi = np.nonzero((up >= kth[:, None]) & (up > -np.inf))
    found = np.concatenate([_exact(q[qi[p : p + 65536]], v[vi[p : p + 65536]]) for p in range(0, len(qi), 65536)] or [qi])
    order = np.lexsort((vi, -found.astype(object) if len(found) and found.min() == -(2**63) else -found, qi))
    qi, vi, found = qi[order], vi[order], found[order]
    start = np.searchsorted(qi, np.arange(len(q)))
    best = np.arange(len(qi)) - start[qi] < k
    return qi[best], vi[best], found[best]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own; queries are the ids divisible by every."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    one = F.row_number().over(W.partitionBy("vec_id").orderBy("v"))
    rows = (
        vectors.where(F.col(vec_id).isNotNull() & e.isNotNull() & ~bad)
        .select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("v"))
        .withColumns({"row": one, "dim": F.size("v")})
    )
    rows = cut(rows, "vectors")
    is_query = F.col("vec_id") % every == 0
    n = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_c, n_q = max(1, math.ceil(n["n"] / CANDIDATES)), max(1, math.ceil(n["q"] / QUERIES))
    h = F.xxhash64("vec_id", "row")
    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cands = rows.select("*", F.pmod(h, F.lit(n_c)).cast("int").alias("cb"), blocks(n_q).alias("qb"))
    asks = rows.where(is_query).select("*", F.pmod(h, F.lit(n_q)).cast("int").alias("qb"), blocks(n_c).alias("cb"))

    def search(key, q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and c.num_rows:
            dim = key[0].as_py()
            c = c.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            v, ids, nums = _matrix(c, dim), c.column("vec_id").to_numpy(), c.column("row").to_numpy()
            place = {x: i for i, x in enumerate(zip(ids.tolist(), nums.tolist(), strict=True))}
            qs, q_ids, q_nums = _matrix(q, dim), q.column("vec_id").to_numpy(), q.column("row").to_numpy()
            own = np.array([place.get(x, -1) for x in zip(q_ids.tolist(), q_nums.tolist(), strict=True)])
            for a in range(0, len(qs), SUB):
                qi, vi, s = search_block(qs[a : a + SUB], own[a : a + SUB], v, ids, k)
                out.append((q_ids[a + qi], q_nums[a + qi], ids[vi], nums[vi], s))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        return pa.table(
            [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["query_id", "query_row", "vec_id", "vec_row", "score"]
        )

    keys = ["dim", "cb", "qb"]
    found = asks.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInArrow(search, OUT)
    rank = F.row_number().over(
        W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    )
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP9_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.rid, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
