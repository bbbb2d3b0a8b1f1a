"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees (op 7).

Vectors get one more component that makes all norms equal (rows only; a query gets a zero there), so the largest inner
product is the nearest. A tree halves the space ``DEPTH`` times, each node by a random direction at the median of a
bounded sample (``SAMPLE`` rows of the smallest hashes); every row is indexed, in one leaf of each tree. A query takes leaves of all trees in
the order of one shared priority queue, whose key is the smallest signed distance to the planes on the way to the leaf, until
they hold ``SHARE`` of all tree entries, and k rows in any case. Leaf candidates are reranked exactly, in double precision.

Leaves hold a fixed share of the rows at every size, so the measured recall (README) does not depend on it. A leaf of any size, say of one
vector repeated for a third of all rows, is worked on in blocks of rows and of queries.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows without an id; rows with equal id and vector are one; a query takes no row of its own id; ties go to the smaller id; with fewer
candidates than k all are returned; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.llm.common import ship, written

TREES, DEPTH = 4, 5
SAMPLE = 20_000
SHARE = 0.3
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
SEED = 11


class Forest:
    """Directions and thresholds of all trees; node n of a level has the children 2 n and 2 n + 1 of the next."""

    def __init__(self, sample: np.ndarray, norm: float, trees: int = TREES, depth: int = DEPTH):
        self.norm, self.trees, self.depth = norm, trees, depth
        rng = np.random.default_rng(SEED)
        n = (1 << depth) - 1
        x = self.lifted(sample)
        self.directions = rng.standard_normal((trees, n, x.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.thresholds = np.zeros((trees, n))
        sizes = []
        for t in range(trees):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(depth):
                base = (1 << level) - 1
                side = np.zeros(len(x), dtype=np.int64)
                for k in range(1 << level):
                    at = np.nonzero(node == k)[0]
                    y = x[at] @ self.directions[t, base + k]
                    self.thresholds[t, base + k] = np.median(y) if len(y) else 0.0
                    side[at] = y >= self.thresholds[t, base + k]
                node = 2 * node + side
            sizes.append(np.bincount(node, minlength=1 << depth))
        self.sizes = np.concatenate(sizes) / max(1, len(x))  # share of the rows in each leaf of each tree

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1))
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, numbered over all trees."""
        x, out = self.lifted(x), np.zeros((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            y = x @ self.directions[t].T >= self.thresholds[t]
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = 2 * node + y[np.arange(len(x)), (1 << level) - 1 + node]
            out[:, t] = node + (t << self.depth)
        return out

    def search(self, q: np.ndarray, entries: float) -> Iterator[np.ndarray]:
        """Leaves for each query, nearest first: the order in which one queue over all trees gives them up."""
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        keys = []
        for t in range(self.trees):
            margin = q @ self.directions[t].T - self.thresholds[t]
            key = np.full((len(q), 1), np.inf)
            for level in range(self.depth):
                m = margin[:, (1 << level) - 1 : (2 << level) - 1]
                key = np.stack([np.minimum(key, -m), np.minimum(key, m)], axis=2).reshape(len(q), -1)
            keys.append(key)
        order = np.argsort(-np.concatenate(keys, axis=1), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        for row, h in zip(order, held):
            yield row[: int(np.searchsorted(h, entries)) + 1]


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with rows of v, summed from the first component to the last, so that equal vectors tie."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


def nearest_in_block(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, score) of the k nearest rows of a block for each query of a block."""
    order = np.argsort(v_id, kind="stable")
    v_id, v = v_id[order], v[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 22) // max(1, len(v)))
    for a in range(0, len(q), step):
        rough = q[a : a + step] @ v.T
        rough[q_id[a : a + step, None] == v_id[None, :]] = -np.inf
        if len(v) > k:
            # what rounding could still bring among the k nearest stays in
            least = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k]
            slack = 1e-12 * np.linalg.norm(q[a : a + step], axis=1) * np.linalg.norm(v, axis=1).max() * q.shape[1]
            i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        else:
            i, j = np.nonzero(rough > -np.inf)
        score = np.concatenate([exact_scores(q[a + i[s : s + 100_000]], v[j[s : s + 100_000]]) for s in range(0, len(i), 100_000)] or [np.zeros(0)])
        best = np.lexsort((v_id[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        top = rank < k
        found.append((q_id[a + i[top]], v_id[j[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (array<double>) of the rows that take part."""
    v = F.col("vec")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    lengths = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"))  # a row for each length
    most = lengths.agg(F.max_by("size", F.struct("n", "size")).alias("most"))
    return rows.join(F.broadcast(most), F.size("vec") == F.col("most")).select("id", "vec").dropDuplicates(["id", "vec"])


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in s])


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of df where is_query holds (a condition on its id)."""
    spark = df.sparkSession
    ship(spark)
    rows = written(usable(df, key, vector), "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, most = rows.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return none
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).select("vec").toPandas()
    forest = Forest(_matrix(sample["vec"]), float(most) * (1 + 1e-9))
    # k + 1 entries a tree hold k rows besides the query's own
    entries = forest.trees * max(share, (k + 1) / n)

    @F.pandas_udf("array<int>")
    def index(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(forest.leaves(_matrix(s)).astype(np.int32)) if len(s) else [], dtype=object)

    @F.pandas_udf("array<int>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([x.astype(np.int32) for x in forest.search(_matrix(s), entries)] if len(s) else [], dtype=object)

    queries = rows.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "id")
    fresh = lambda d, udf: d.select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.explode(udf("vec")).alias("leaf"))
    entered, asked = fresh(rows, index), fresh(queries, search)
    blocks = lambda d, size, name: d.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # at most trees * 2 ** depth rows
    counts = F.broadcast(written(blocks(entered, ROW_BLOCK, "nr").join(blocks(asked, QUERY_BLOCK, "nq"), "leaf"), "leaves"))
    spread = lambda d, own, other, mine, theirs: d.join(counts, "leaf").select(
        "leaf", "id", "vec", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)
    )
    by = ["leaf", "r", "q"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        q_id, v_id, score = nearest_in_block(left["id"].to_numpy(), _matrix(left["vec"]), right["id"].to_numpy(), _matrix(right["vec"]), k)
        return pd.DataFrame({"query_id": q_id, "vec_id": v_id, "score": score})

    met = spread(asked, "nq", "nr", "q", "r").groupBy(*by).cogroup(spread(entered, "nr", "nq", "r", "q").groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # found in more than one tree
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
