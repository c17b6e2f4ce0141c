"""Operator 2: approximate nearest neighbours by stable projections.

The largest inner products are the smallest distances once every vector has a
further component that brings all to one length.  A Gaussian projection to M
dimensions turns a squared distance d^2 into d^2 times a chi-square variable
with M degrees of freedom.  A kd-tree over the projected points gives them in
order of projected distance; they are verified on the original vectors until a
point as near as the present k-th would have shown up by now with probability
CONFIDENCE.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import vectors
from palisade.llm.shared import table

#: Projected dimensions; even, for the closed form of the chi-square distribution.
M = 8
CONFIDENCE = 0.97
SEED = 20


def chi_square(x: float, m: int) -> float:
    """P(chi-square with an even number m of degrees <= x)."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    a, b = 0.0, 1.0
    while chi_square(b, m) < p:
        b *= 2
    for _ in range(80):
        c = (a + b) / 2
        a, b = (c, b) if chi_square(c, m) < p else (a, c)
    return b


def projection(dim: int, m: int = M) -> np.ndarray:
    """(dim + 1, m) standard normal numbers, the same everywhere."""
    return np.random.default_rng(SEED).standard_normal((dim + 1, m))


class _Build:
    def __init__(self, length2: float):
        self.length2 = length2

    def __call__(self, ids: np.ndarray, points: np.ndarray) -> bytes:
        points, begin, ids = vectors.distinct(ids, points)
        rest = np.sqrt(np.maximum(0, self.length2 - (points**2).sum(1)))
        projected = np.column_stack([points, rest]) @ projection(points.shape[1])
        nodes, order = vectors.Tree.build(projected)
        low = np.array([projected[order[a:b]].min(0) for a, b, *_ in nodes.tolist()])
        high = np.array([projected[order[a:b]].max(0) for a, b, *_ in nodes.tolist()])
        return vectors.pack(nodes=nodes, low=low, high=high, projected=projected[order], points=points[order], point=order, begin=begin, ids=ids)


class _Look:
    def __init__(self, k: int, length2: float, confidence: float):
        self.k, self.length2, self.limit = k, length2, chi_square_quantile(confidence, M)

    def load(self, arrays: dict) -> dict:
        return arrays | {"tree": vectors.Tree(arrays["nodes"]), "plane": projection(arrays["points"].shape[1])}

    def __call__(self, index: dict, q: int, vector: np.ndarray, own: int, best: vectors.Best, seed: bool) -> None:
        at = vector @ index["plane"][:-1]
        gap = np.maximum(np.maximum(index["low"] - at, at - index["high"]), 0)
        constant = float(vector @ vector) + self.length2
        # a nearest neighbour's projected squared distance stays below this with the given probability
        reach = lambda: self.limit * max(0.0, constant - 2 * best.floor[q])
        first = True
        for slices, left in index["tree"].walk((gap * gap).sum(1).tolist()):
            rows = np.concatenate([np.arange(a, b) for a, b in slices]) if len(slices) > 1 else np.arange(*slices[0])
            if not first:  # the first leaf is verified whole: both rounds must find what set the floor
                away = index["projected"][rows] - at
                rows = rows[(away * away).sum(1) <= reach()]
            first = False
            score = index["points"][rows] @ vector
            good = score >= best.floor[q]
            if good.any():
                chosen, score = rows[good], score[good]
                if len(chosen) > 2 * self.k + 2:
                    edge = np.partition(score, len(score) - self.k - 1)[len(score) - self.k - 1]
                    chosen, score = chosen[score >= edge], score[score >= edge]
                best.add(q, *vectors.expand(index["point"][chosen], score, index["begin"], index["ids"], own, self.k))
            if seed or left > reach():
                return


def nearest(df: DataFrame, k: int = 20, every: int | None = 20, confidence: float = CONFIDENCE, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None, shard_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: about the k largest inner products of each query over all other rows.

    Scores are those of the original vectors in double precision; every row is
    indexed.  Queries are the rows whose id is divisible by `every`, or a table
    of the same columns.  Null and zero vectors, vectors that hold null or
    non-finite components, null ids and odd lengths take no part.  Ties go to
    the smaller id.  An empty table, or a single row, gives an empty result;
    rows with equal ids are candidates each, but none of its own query.
    """
    nonzero = F.exists("vec", lambda x: x != 0)
    rows, n, dim = vectors.usable(df, id_col, vec_col, nonzero)
    length2 = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    length2 *= 1 + 1e-12
    asked = vectors.usable(queries, id_col, vec_col, nonzero)[0].filter(F.size("vec") == dim) if queries is not None else rows.filter(F.col("id") % every == 0)
    asked = asked.dropDuplicates(["id"])
    return vectors.search(rows, n, dim, asked, asked.count(), k, _Build(length2), _Look(k, length2, confidence), "double", shard_rows, block_queries)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: about the 20 largest inner products of every 20th vector with all others."""
    return nearest(table(spark, sf_dir, "embeddings"))
