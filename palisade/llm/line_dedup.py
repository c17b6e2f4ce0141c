"""Operator 6: dropping lines that many documents share.

Lines are counted by a 128-bit hash.  The hashes found in enough documents go,
shard by shard, under a minimal perfect hash: a rank structure over bit arrays
that maps each of n keys to its own slot below n, beside which lie a
fingerprint and a count.  Documents probe these arrays; lines are not joined.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import scan
from palisade.llm.shared import forget, materialize, small_batches, table, text_or_empty, tidy

_STRIP = b" \t\n\x0b\x0c\r"
#: Keys in one shard, on average.
SHARD_KEYS = 50_000
#: Bytes of shards that documents probe in one pass; more shards take more passes.
PASS_BYTES = 64 << 20
#: Distinct hashes that a task gathers before it hands them on.
GATHER = 200_000


def line_hashes(text: str, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines; (n, 2) hashes of their keys; which keys have at least `least` code points."""
    lines = text.split("\n")
    keys = [k.strip(_STRIP) for k in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]  # bytes.lower() is for A-Z only
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
    if least <= 1:
        long = np.fromiter(map(bool, keys), bool, len(keys)) if least == 1 else np.ones(len(keys), bool)
    else:
        long = np.fromiter((len(k.decode("utf-8", "surrogatepass")) >= least for k in keys), bool, len(keys))
    return lines, hashes, long


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each set where just one remaining key falls."""

    def __init__(self, keys: np.ndarray, room: float = 1.6):
        self.sizes, bits, left = [], [], keys
        while len(left):
            size = max(64, int(room * len(left)) + 63 & ~63)
            at = mix(left, len(self.sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            left = left[~alone[at.astype(np.int64)]]
        self.bits = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
        self._rank()

    def _rank(self) -> None:
        words = self.bits.view(np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @classmethod
    def load(cls, sizes: np.ndarray, bits: np.ndarray) -> "PerfectHash":
        out = cls.__new__(cls)
        out.sizes, out.bits = sizes.tolist(), bits
        out._rank()
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; an unknown key gets any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        words, open_ = self.bits.view(np.uint64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.rank[at[hit] >> 6] + below
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def build_shard(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> bytes:
    """Arrays of a shard: keys are the first halves of the hashes, fingerprints the second."""
    first, second, counts = first.view(np.uint64), second.view(np.uint64), counts.astype(np.int64)
    keys, index = np.unique(first, return_index=True)
    twins = np.setdiff1d(np.arange(len(first)), index)  # equal first halves, different second: looked up in a list
    table_ = PerfectHash(keys)
    slot = table_.slots(keys)
    fingerprint, count = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
    fingerprint[slot], count[slot] = second[index], counts[index]
    out = io.BytesIO()
    np.savez(out, sizes=np.array(table_.sizes, np.int64), bits=table_.bits, fingerprint=fingerprint, count=count, twins=np.stack([first[twins], second[twins], counts[twins].astype(np.uint64)]))
    return out.getvalue()


class Shards:
    """Some of n shards, for probing."""

    def __init__(self, blobs: dict[int, bytes], n: int):
        self.n, self.of = n, {}
        for k, blob in blobs.items():
            a = np.load(io.BytesIO(blob))
            self.of[k] = PerfectHash.load(a["sizes"], a["bits"]), a["fingerprint"], a["count"], a["twins"]

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Documents that hold each hash; 0 for one that no shard here knows."""
        out = np.zeros(len(hashes), np.int64)
        shard = (hashes[:, 0] >> np.uint64(32)) % np.uint64(self.n)
        for k, (index, fingerprint, count, twins) in self.of.items():
            mine = np.flatnonzero(shard == k) if self.n > 1 else np.arange(len(hashes))
            if not len(mine):
                continue
            slot = index.slots(hashes[mine, 0])
            found = slot >= 0
            found[found] = fingerprint[slot[found]] == hashes[mine[found], 1]
            out[mine[found]] = count[slot[found]]
            for a, b, c in twins.T:
                out[mine[(hashes[mine, 0] == a) & (hashes[mine, 1] == b)]] = int(c)
        return out


def count_lines(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """h1, h2, n: documents that hold each distinct line key of at least `least` code points."""

    def run(batches):
        gathered: dict[bytes, int] = {}

        def out():
            raw = np.frombuffer(b"".join(gathered), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(raw[:, 0]), pa.array(raw[:, 1]), pa.array(list(gathered.values()), pa.int64())], ["h1", "h2", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                _, hashes, long = line_hashes(text, least)
                raw = hashes[long].tobytes()
                for key in {raw[i : i + 16] for i in range(0, len(raw), 16)}:
                    gathered[key] = gathered.get(key, 0) + 1
                if len(gathered) >= GATHER:
                    yield out()
                    gathered = {}
        if gathered:
            yield out()

    parts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(tidy(run), "h1 long, h2 long, n long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(counted: DataFrame, least_docs: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """Shards (shard, blob) over the hashes found in least_docs documents, their number, and all their bytes.

    Hashes of fewer documents can't drop a line and stay outside.
    """
    frequent = materialize(counted.filter(F.col("n") >= least_docs), "lines-frequent")
    shards = max(1, -(-frequent.count() // shard_keys))
    number = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(shards)).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [build_shard(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), pdf["n"].to_numpy())]})

    built = materialize(frequent.withColumn("shard", number).groupBy("shard").applyInPandas(build, "shard int, blob binary"), "lines-shards")
    total = built.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("b")).first()["b"]
    forget(frequent)
    return built, shards, total


def _broadcast_shards(built: DataFrame, shards: int, passes: int, k: int):
    blobs = {r["shard"]: bytes(r["blob"]) for r in built.filter(F.pmod("shard", F.lit(passes)) == k).toLocalIterator()}
    return built.sparkSession.sparkContext.broadcast((blobs, shards))


def _kept(lines: list[str], gone: np.ndarray) -> str:
    return "\n".join([x for x, g in zip(lines, gone) if not g]) if gone.any() else "\n".join(lines)


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(c) for c in ("_id", *names)]


def _in_one_pass(source: DataFrame, names: list[str], schema: str, sent, least: int, least_docs: int) -> DataFrame:
    def run(batches):
        index = Shards(*sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            first, second, third = [], [], []
            for a, b in scan.groups([len(t) for t in texts], 1 << 22):
                all_ = [line_hashes(t, least) for t in texts[a:b]]
                hit = index.counts(np.concatenate([h for _, h, _ in all_])) >= least_docs
                at = 0
                for lines, _, long in all_:
                    gone = hit[at : at + len(lines)] & long
                    at += len(lines)
                    first.append(_kept(lines, gone))
                    second.append(len(lines))
                    third.append(int(gone.sum()))
            yield pa.record_batch([*_columns(batch, names), pa.array(first, pa.string()), pa.array(second, pa.int64()), pa.array(third, pa.int64())], ["_id", *names, "kept_text", "n_lines", "n_dropped"])

    return source.mapInArrow(tidy(run), schema)


def _in_many_passes(source: DataFrame, names: list[str], schema: str, built: DataFrame, shards: int, passes: int, least: int, least_docs: int) -> DataFrame:
    """Texts are written once, each hash to the pass that knows its shard; what the passes find are places of lines, which are joined to the texts last."""
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def number(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.record_batch([pa.array(np.arange(row, row + batch.num_rows)), *batch.columns], ["row", *batch.schema.names])
            row += batch.num_rows

    numbered = materialize(source.mapInArrow(number, "row long, " + ", ".join(f"{c} {kinds[c]}" for c in source.columns)), "lines-texts")

    def probes(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                _, hashes, long = line_hashes(text, least)
                at = np.flatnonzero(long)
                h = hashes[at]
                turn = (h[:, 0] >> np.uint64(32)) % np.uint64(shards) % np.uint64(passes)
                yield pa.record_batch([pa.array(turn.astype(np.int32)), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32)), pa.array(h[:, 0].view(np.int64) if len(at) else [], pa.int64()), pa.array(np.ascontiguousarray(h[:, 1]).view(np.int64), pa.int64())], ["turn", "row", "at", "h1", "h2"])

    asked = materialize(numbered.select("row", "text").mapInArrow(tidy(probes), "turn int, row long, at int, h1 long, h2 long"), "lines-probes", ["turn"])
    found = None
    for k in range(passes):
        sent = _broadcast_shards(built, shards, passes, k)

        def probe(batches, sent=sent):
            index = Shards(*sent.value)
            for batch in batches:
                hashes = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")], 1)
                yield batch.select(["row", "at"]).filter(pa.array(index.counts(hashes) >= least_docs))

        hits = materialize(asked.filter(F.col("turn") == k).select("row", "at", "h1", "h2").mapInArrow(tidy(probe), "row long, at int"), "lines-hits")
        found = hits if found is None else found.unionByName(hits)
    drops = found.groupBy("row").agg(F.collect_list("at").alias("drop"))  # lines of one document at most

    def run(batches):
        for batch in batches:
            first, second, third = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
                lines = text.split("\n")
                gone = np.zeros(len(lines), bool)
                gone[drop or []] = True
                first.append(_kept(lines, gone))
                second.append(len(lines))
                third.append(int(gone.sum()))
            yield pa.record_batch([*_columns(batch, names), pa.array(first, pa.string()), pa.array(second, pa.int64()), pa.array(third, pa.int64())], ["_id", *names, "kept_text", "n_lines", "n_dropped"])

    return numbered.join(drops, "row", "left").mapInArrow(tidy(run), schema)


def drop_common_lines(docs: DataFrame, least_docs: int = 10, least: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), pass_bytes: int = PASS_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per input row: id, kept_text, n_lines, n_dropped and the columns in keep.

    A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its
    ends and with A-Z lower-cased.  Keys of at least `least` code points that
    are found in at least least_docs rows (repeated rows count each) lose all
    their lines.  A null or empty text is one empty line.  An empty table gives
    an empty one.  Shards of more than pass_bytes are probed in several passes,
    each of which reads the hashes that its shards know.
    """
    small_batches(docs.sparkSession)
    built, shards, total = build_index(count_lines(docs, text_col, least), least_docs, shard_keys)
    passes = min(shards, max(1, -(-int(total) // pass_bytes)))
    names = [f"_keep{i}" for i in range(len(keep))]
    source = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ("_id", *names)) + ", kept_text string, n_lines long, n_dropped long"
    if passes == 1:
        done = _in_one_pass(source, names, schema, _broadcast_shards(built, shards, 1, 0), least, least_docs)
    else:
        done = _in_many_passes(source, names, schema, built, shards, passes, least, least_docs)
    return done.select(F.col("_id").alias(id_col), "kept_text", "n_lines", "n_dropped", *[F.col(n).alias(c) for n, c in zip(names, keep)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: lines found in at least 10 documents are dropped from all documents."""
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    return r"""
    WITH lines AS (
      SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
      FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ), keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
    ), common AS (
      SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
    )
    SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY row, doc_id
    """
