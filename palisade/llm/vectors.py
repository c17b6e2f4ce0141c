"""Sharded nearest-vector search: what the projection index and the ball tree have in common.

Rows are dealt to shards of bounded size by a hash of id and vector; each shard gets
one tree, stored as a blob.  Queries come in blocks of bounded size, which are
broadcast one after the other; every task searches its shards for a block and
hands on one short list per query.  A first round visits only the most
promising leaf of each shard; the k-th score that this gives over all shards is
where the second, complete round starts pruning.
"""

from __future__ import annotations

import io
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.shared import materialize, small_batches, tidy

#: Rows of a shard, on average.
SHARD_ROWS = 16_384
#: Queries in one broadcast block, on average.
BLOCK_QUERIES = 50_000
LEAF = 128


def finite(vec: Column) -> Column:
    """Neither null nor empty, and no component null, NaN or infinite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, good)


def usable(df: DataFrame, id_col: str, vec_col: str, extra: Column | None = None) -> tuple[DataFrame, int, int]:
    """(id, vec as array<double>) of the rows that take part, how many, and their dimension.

    A null id, or a length other than the commonest (of several the longest),
    takes no part either.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & finite(F.col("vec")))
    if extra is not None:
        rows = rows.filter(extra)
    found = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    n, dim = (found[0]["count"], found[0]["dim"]) if found else (0, 0)
    return rows.filter(F.size("vec") == dim), n, dim


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """(n, dim) doubles of a list column without nulls."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), dim)


def distinct(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct points, and per point where its ids begin in the ids, which are sorted within a point."""
    order = np.lexsort((ids, *points.T[::-1]))
    ids, points = ids[order], points[order]
    new = np.ones(len(ids), bool)
    new[1:] = (points[1:] != points[:-1]).any(1)
    return points[new], np.append(np.flatnonzero(new), len(ids)), ids


class Tree:
    """Binary tree over points: halves along the widest axis down to leaves; arrays by node, points in leaf order."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes.tolist()  # begin, end, left, right; left is -1 in a leaf

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, order of the points)."""
        order, nodes, todo = np.arange(len(points)), [[0, len(points), -1, -1]], [0]
        while todo:
            k = todo.pop()
            a, b = nodes[k][:2]
            if b - a <= leaf:
                continue
            own = order[a:b]
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            half = (b - a) // 2
            order[a:b] = own[np.argpartition(points[own, axis], half)]
            nodes[k][2:] = [len(nodes), len(nodes) + 1]
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[a, a + half, -1, -1], [a + half, b, -1, -1]]
        return np.array(nodes, np.int64), order

    def walk(self, cost: list[float]):
        """Yields (slices of ever more leaves, least cost of all that is left), cheapest nodes first."""
        heap, batch, want = [(cost[0], 0)], [], 1
        nodes = self.nodes
        while heap:
            _, k = heappop(heap)
            a, b, left, right = nodes[k]
            if left >= 0:
                heappush(heap, (max(cost[left], cost[k]), left))
                heappush(heap, (max(cost[right], cost[k]), right))
            elif b > a:
                batch.append((a, b))
            if batch and (len(batch) >= want or not heap):
                yield batch, heap[0][0] if heap else float("inf")
                batch, want = [], 2 * want


class Best:
    """The k best (score, id) of each query, best first; ties go to the smaller id."""

    def __init__(self, n: int, k: int, dtype):
        self.k = k
        self.score, self.id = [np.zeros(0, dtype)] * n, [np.zeros(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], float(self.score[q][-1]))


def expand(chosen: np.ndarray, score: np.ndarray, begin: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the rows of the chosen points, without own; of equal points the k + 1 smallest ids suffice."""
    first = begin[chosen]
    n = np.minimum(begin[chosen + 1] - first, k + 1)
    ends = np.cumsum(n)
    at = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    score, got = np.repeat(score, n), ids[at]
    other = got != own
    return score[other], got[other]


def search(rows: DataFrame, n: int, dim: int, queries: DataFrame, n_queries: int, k: int, build, look, score_type: str, shard_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score.

    build(ids, points) -> blob; look(index, q, vector, id, best, seed): search
    one unpacked shard for one query, only its best leaf if seed.
    """
    spark = rows.sparkSession
    small_batches(spark)
    dtype = np.int64 if score_type == "long" else np.float64
    shards = max(1, -(-n // (shard_rows or SHARD_ROWS)))

    def built(key, group):
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([build(group["id"].to_numpy(), matrix(group["vec"], dim))], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int"))
    index = materialize(dealt.groupBy("shard").applyInArrow(built, "shard int, blob binary"), "vector-shards")
    blocks = max(1, -(-n_queries // (block_queries or BLOCK_QUERIES)))
    lists = f"query_id long, found array<struct<less:{'long' if score_type == 'long' else 'double'},vec_id:long>>"
    kind = pa.list_(pa.struct([("less", pa.int64() if score_type == "long" else pa.float64()), ("vec_id", pa.int64())]))

    def round_(block, floor, seed: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast((*block, floor))

        def run(batches):
            ids, vectors, start = sent.value
            best = Best(len(ids), k, dtype)
            if start is not None:
                best.floor = start.copy()
            for batch in batches:
                for blob in batch.column(0):
                    own = look.load(unpack(blob.as_buffer()))
                    for q in range(len(ids)):
                        look(own, q, vectors[q], int(ids[q]), best, seed)
            full = [q for q in range(len(ids)) if len(best.id[q])]
            if full:
                size = np.array([len(best.id[q]) for q in full])
                flat = pa.StructArray.from_arrays([pa.array(-np.concatenate([best.score[q] for q in full])), pa.array(np.concatenate([best.id[q] for q in full]))], names=["less", "vec_id"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                yield pa.record_batch([pa.array(ids[full]), pa.ListArray.from_arrays(offsets, flat).cast(kind)], ["query_id", "found"])

        parts = index.select("blob").mapInArrow(tidy(run), lists)
        return parts.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))

    out = []
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
    for b in range(blocks):
        got = numbered.filter(F.col("block") == b).select("id", "vec").toArrow()
        block = got["id"].to_numpy().copy(), matrix(got["vec"], dim)
        floor = np.full(len(block[0]), -np.inf)
        place = {int(i): at for at, i in enumerate(block[0])}
        for r in round_(block, None, True).filter(F.size("found") == k).select("query_id", (-F.element_at("found", -1)["less"]).alias("s")).toLocalIterator():
            floor[place[r["query_id"]]] = r["s"]
        done = round_(block, floor, False)
        out.append(materialize(done, "vector-block") if blocks > 1 else done)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    each = found.select("query_id", F.posexplode("found").alias("rank", "x"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
