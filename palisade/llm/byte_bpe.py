"""Operator 1: byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import scan
from palisade.llm.shared import small_batches, table, text_or_empty, tidy

#: Distinct pre-tokens that a task keeps, of eight ids each on average; the cache starts afresh beyond.
CACHE = 1 << 18


def merge(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    if len(parts) <= 64:
        none = 1 << 60
        get = ranks.get
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not left or j >= n or parts[j] is not right:
            continue
        parts[i] = left + right
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            r = ranks.get(parts[i] + parts[after[i]])
            if r is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
        if before[i] >= 0:
            r = ranks.get(parts[before[i]] + parts[i])
            if r is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
    return [p for p in parts if p is not None]


class ByteBpe:
    """Encoder and decoder over a rank file: lines of base64 token and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = [bytes([i]) for i in range(256)]
        self.tokens = np.empty(max(self.ranks.values()) + 1, object)
        self.tokens[:] = b""
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.bytes, self.at = np.frombuffer(b"".join(self.tokens.tolist()), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.fresh()

    def fresh(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else [self.ranks[p] for p in merge([self.single[b] for b in raw], self.ranks)]
        k = len(self.index)
        if k == len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * k), np.resize(self.size, 2 * k)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.index[piece] = k
        return k

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        for a, b in scan.groups([len(t) for t in texts]):
            if len(self.index) > CACHE or self.used > 8 * CACHE:
                self.fresh()
            parts, counts = scan.pieces(texts[a:b])
            index, learn = self.index.get, self._learn
            found = np.fromiter([k if (k := index(p)) is not None else learn(p) for p in parts], np.int64, len(parts))
            size = self.size[found]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            where = np.repeat(self.begin[found] - (ends - size), size) + np.arange(total)
            ids = self.flat[where]
            cuts = np.concatenate([[0], ends])[np.cumsum(counts)[:-1]] if len(counts) > 1 else []
            out += np.split(ids, cuts)
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token starts."""
        size = self.lengths[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the tokens, each laid at its offset in one buffer."""
        if not len(ids):
            return b""
        size = self.lengths[ids]
        out = np.zeros(int((offsets + size).max()), np.uint8)
        ends = np.cumsum(size)
        within = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        out[np.repeat(offsets, size) + within] = self.bytes[np.repeat(self.at[ids], size) + within]
        return out.tobytes()


@lru_cache(2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ids array<int>, offsets array<int> (byte at which each token starts), the columns in keep.

    A null or empty text has no ids.  Rows with equal ids or texts stay
    separate; a text of any length is encoded whole; an empty table gives an
    empty one.  No shuffle takes place.
    """
    small_batches(df.sparkSession)
    rest = [f"_keep{i}" for i in range(len(keep))]
    source = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *[F.col(c).alias(r) for c, r in zip(keep, rest)])

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = _texts(batch)
            for a, b in scan.groups([len(t) for t in texts]):
                ids = own.encode(texts[a:b])
                lists = [pa.array([f(i).astype(np.int32) for i in ids], pa.list_(pa.int32())) for f in (lambda i: i, own.offsets)]
                yield pa.record_batch([batch.column("_id")[a:b], *lists, *(batch.column(r)[a:b] for r in rest)], ["_id", "ids", "offsets", *rest])

    types = [f"{c} {source.schema[c].dataType.simpleString()}" for c in ("_id", *rest)]
    out = source.mapInArrow(tidy(run, lambda: codec(path).fresh()), f"{types[0]}, ids array<int>, offsets array<int>{''.join(', ' + t for t in types[1:])}")
    return out.select(F.col("_id").alias(id_col), "ids", "offsets", *[F.col(r).alias(c) for c, r in zip(keep, rest)])


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """One row per input row: id, decoded binary; each token's bytes stand at its offset.  Null or empty ids decode to no bytes."""
    small_batches(df.sparkSession)

    def run(batches):
        own = codec(path)
        for batch in batches:
            raw = [own.decode(np.asarray(i, np.int64), np.asarray(at, np.int64)) if i else b"" for i, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary())], [id_col, "decoded"])

    return df.select(id_col, ids_col, offsets_col).mapInArrow(tidy(run), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass, reduced to digests: id, n_tokens, n_bytes, ids_sha256, decoded_sha256.

    Spares the ids two crossings between Python and the JVM.
    """
    small_batches(df.sparkSession)

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = _texts(batch)
            rows = []
            for a, b in scan.groups([len(t) for t in texts]):
                for ids in own.encode(texts[a:b]):
                    raw = own.decode(ids, own.offsets(ids))
                    rows.append((len(ids), len(raw), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            n, size, first, second = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], [id_col, "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"])

    source = df.select(id_col, text_or_empty(text_col).alias("text"))
    return source.mapInArrow(tidy(run, lambda: codec(path).fresh()), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op1: encode every whole document by the multilingual rank file and decode it again."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path)
