"""Operator 8: exact top-k inner products by ball-tree branch and bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import vectors
from palisade.llm.shared import table


def build(ids: np.ndarray, points: np.ndarray) -> bytes:
    """Ball tree over the distinct points of a shard."""
    points, begin, ids = vectors.distinct(ids, points)
    nodes, order = vectors.Tree.build(points)
    centre = np.array([points[order[a:b]].mean(0) for a, b, *_ in nodes.tolist()])
    radius = np.array([np.sqrt(((points[order[a:b]] - c) ** 2).sum(1).max()) for (a, b, *_), c in zip(nodes.tolist(), centre)])
    size = np.diff(begin)[order]
    firsts = begin[:-1][order]
    ends = np.cumsum(size)
    at = np.repeat(firsts - (ends - size), size) + np.arange(len(ids))
    return vectors.pack(nodes=nodes, centre=centre, radius=radius, points=points[order], begin=np.concatenate([[0], ends]), ids=ids[at])


#: Sums of whole numbers up to which doubles are exact, and 64-bit integers.
EXACT, LONGEST = float(1 << 53), float(1 << 63)


class _Look:
    """whole: scores are integers; large: their sums may be beyond what doubles hold."""

    def __init__(self, k: int, whole: bool, large: bool = False):
        self.k, self.whole, self.large = k, whole, large

    def load(self, arrays: dict) -> dict:
        return arrays | {"tree": vectors.Tree(arrays["nodes"])}

    def __call__(self, index: dict, q: int, vector: np.ndarray, own: int, best: vectors.Best, seed: bool) -> None:
        points, begin = index["points"], index["begin"]
        # largest inner product inside a ball, with room for rounding
        norm = float(np.sqrt(vector @ vector))
        bound = index["centre"] @ vector + index["radius"] * norm
        bound += 1e-9 * (np.abs(bound) + norm)
        for slices, left in index["tree"].walk((-bound).tolist()):
            rows = np.concatenate([np.arange(a, b) for a, b in slices]) if len(slices) > 1 else np.arange(*slices[0])
            score = points[rows].astype(np.int64) @ vector.astype(np.int64) if self.large else points[rows] @ vector
            good = score >= best.floor[q]
            if good.any():
                chosen, score = rows[good], score[good]
                if len(chosen) > 2 * self.k + 2:  # more points than the list and ties at its end can need
                    edge = np.partition(score, len(score) - self.k - 1)[len(score) - self.k - 1]
                    chosen, score = chosen[score >= edge], score[score >= edge]
                score, got = vectors.expand(chosen, score, begin, index["ids"], own, self.k)
                best.add(q, score.astype(np.int64) if self.whole else score, got)
            if seed or -left < best.floor[q]:
                return


def exact_top_k(df: DataFrame, k: int = 20, every: int | None = 20, scale: float | None = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None, shard_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products over all other rows.

    With scale, components become floor(scale * x) and scores are integers,
    exact as far as 64 bits reach (ValueError where they might not).  Queries are the rows whose id is divisible by
    `every`, or a table of the same columns.  Null vectors, vectors that hold
    null or non-finite components, null ids and odd lengths take no part; zero
    vectors do.  Ties go to the smaller id.  An empty table, or a single row,
    gives an empty result; rows with equal ids are candidates each, but none
    of its own query.
    """
    rows, n, dim = vectors.usable(df, id_col, vec_col)
    to_grid = lambda f: f.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double"))) if scale else f
    asked = vectors.usable(queries, id_col, vec_col)[0].filter(F.size("vec") == dim) if queries is not None else rows.filter(F.col("id") % every == 0)
    asked = asked.dropDuplicates(["id"])
    kind, large = "long" if scale else "double", False
    if scale:
        norm = lambda f: to_grid(f).agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
        sums = (norm(rows) * norm(asked)) ** 0.5  # no inner product is larger
        if sums >= LONGEST / 2:
            raise ValueError("scores may be beyond 64 bits")
        large = sums >= EXACT / 2
    return vectors.search(to_grid(rows), n, dim, to_grid(asked), asked.count(), k, build, _Look(k, bool(scale), large), kind, shard_rows, block_queries)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the 20 highest integer scores of every 20th vector against all others."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    return """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
