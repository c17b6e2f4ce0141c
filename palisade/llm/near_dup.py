"""Operator 5: near duplicates by a chosen-path similarity join.

A document's set of word shingles is embedded as SIGNATURE minwise tokens.
In each of TREES independent trees a node chooses some (position, token) pairs
at random, 1 / similarity of them per document on average; documents go to a
child for every chosen token that they hold.  Two sets of the wanted
similarity thus share one child on average, others fewer, and the branching
goes on only in nodes that hold many documents.  Small nodes are compared
exhaustively on sketches of the signature, and what passes is confirmed on the
full sets.

Equal sets are one class from the start.  A node that is still large at DEPTH
holds documents that are much alike.  Its members' shingles are counted: a set
of which too few are found in another member is linked with none of them.  The
others are confirmed against their node's representative, the member with the
commonest shingles; what is not in the representative's group by then is
compared exactly with all members, in the cells of a grid of blocks that give
only as many links as connect them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.components import labels
from palisade.llm.shared import forget, materialize, small_batches, squeeze, table, tidy, unsqueeze

#: Minwise tokens of a set; two bits of each form its sketch.
SIGNATURE = 128
TREES = 20
#: Levels of branching; a pair of exactly the wanted similarity shares a node of the third in 0.37 of all trees.
DEPTH = 3
#: Members up to which a node is compared exhaustively.
SMALL = 64
#: Members of a block of a large node.
BLOCK = 256
#: Shingles of a chunk of sets, and of a shard of shingles, on average, while they are counted.
CHUNK_SHINGLES, SHARD_SHINGLES = 1 << 19, 1 << 20
#: Pairs of one set that are confirmed together; more are dealt out.
PAIRS = 2048
#: Distinct words whose hashes a task keeps, and letters of the longest.
CACHE, CACHED_WORD = 1 << 17, 64
#: Standard deviations of the sketch's estimate that a pair may lie below the wanted similarity.
SLACK = 4.0
_BLOOM_BITS = 1 << 25
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes | None, words: int, cache: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted; with fewer words, of the whole sequence; without any, none."""
    tokens = (text or b"").lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    get, digest = cache.get, xxhash.xxh3_64_intdigest
    hashed = []
    for t in tokens:
        h = get(t)
        if h is None:
            h = digest(t)
            if len(t) <= CACHED_WORD:
                cache[t] = h
        hashed.append(h)
    h = np.array(hashed, np.uint64)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _M1
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, SIGNATURE) minwise tokens of non-empty sets."""
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    a = 0
    while a < len(sets):
        b, total = a + 1, len(sets[a])
        while b < len(sets) and total + len(sets[b]) <= 1 << 15:
            total += len(sets[b])
            b += 1
        h = np.concatenate(sets[a:b])
        x = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : b - 1]])]).astype(np.int64)
        for i, m in enumerate(_multipliers()):
            y = x * m
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            out[a:b, i] = np.minimum.reduceat(y, starts)
        a = b
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def branch(path: np.ndarray, signature: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child's path) of every child that a row with this path goes to."""
    positions = np.arange(1, SIGNATURE + 1, dtype=np.uint64) * _M1
    token = _mix(signature.astype(np.uint64) + positions) ^ path[:, None]
    child = _mix(token * _M1 + np.uint64(1))
    row, at = np.nonzero(_mix(child) < np.uint64(2**64 / (similarity * SIGNATURE)))
    return row, child[row, at]


def sketch(signature: np.ndarray) -> np.ndarray:
    """(n, 4) words of two bits per token."""
    two = (signature & np.uint32(3)).astype(np.uint64).reshape(len(signature), 4, 32)
    return (two << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)


def differing(x: np.ndarray) -> np.ndarray:
    """Tokens that differ, from the exclusive or of two sketches."""
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int32)


def most_differing(similarity: float) -> int:
    p = similarity + (1 - similarity) / 4
    return int(SIGNATURE * (1 - p) + SLACK * (SIGNATURE * p * (1 - p)) ** 0.5)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """id, n, k and k2 (128 bits of the set's hash), sig, sketch; of (id, text, others): also row, a number for each, and all but the id."""
    names = docs.columns[1:] if len(docs.columns) > 2 else []

    def run(batches):
        cache: dict = {}
        rows = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingles(t, words, cache) for t in texts]
            keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig, two = [None] * len(sets), [None] * len(sets)
            signed = signatures([sets[i] for i in full])
            for i, row, bits in zip(full, signed, sketch(signed)):
                sig[i], two[i] = row.tobytes(), bits.tobytes()
            more = [pa.array(np.arange(rows, rows + len(sets))), *(batch.column(c) for c in names)] if names else []
            rows += len(sets)
            own = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sig, pa.binary()), pa.array(two, pa.binary())]
            yield pa.record_batch([*own, *more], ["id", "n", "k", "k2", "sig", "sketch", *(["row", *names] if names else [])])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in docs.columns}
    return docs.mapInArrow(tidy(run), f"id {kinds['id']}, n long, k long, k2 long, sig binary, sketch binary" + "".join([", row long", *(f", {c} {kinds[c]}" for c in names)] if names else []))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _children(nodes: DataFrame, similarity: float) -> DataFrame:
    """path, c of the next level from (path, c, sig); the first level from (c, sig)."""
    root = "path" not in nodes.columns

    def run(batches):
        for batch in batches:
            sig, c = _matrix(batch.column("sig")), batch.column("c").to_numpy()
            for a in range(0, len(c), 2000):
                part, own = sig[a : a + 2000], c[a : a + 2000]
                paths = [np.full(len(part), t * 0x9E3779B97F4A7C15 + 77 & 0xFFFFFFFFFFFFFFFF, np.uint64) for t in range(TREES)] if root else [batch.column("path").to_numpy()[a : a + 2000].view(np.uint64)]
                for path in paths:
                    row, child = branch(path, part, similarity)
                    yield pa.record_batch([pa.array(child.view(np.int64)), pa.array(own[row])], ["path", "c"])

    return nodes.select(*([] if root else ["path"]), "c", "sig").mapInArrow(tidy(run), "path long, c long")


def _groups(batches, columns: tuple[str, ...], least: int = 20_000):
    """Column arrays of whole groups; batches are sorted by the columns, and every group is of bounded size."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def arrays(t: pa.Table) -> dict:
        special = {"sketch": lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(-1, 4), "raw": lambda x: x.to_pylist()}
        return {c: special[c](t[c]) if c in special else t[c].to_numpy() for c in t.column_names}

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held)
            same = np.ones(rows, bool)
            for c in columns:
                x = t[c].to_numpy()
                same &= x == x[-1]
            cut = rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield arrays(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), rows - cut
    if rows:
        yield arrays(pa.Table.from_batches(held))


_PAIRS = "a long, b long"


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.record_batch([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def _alike(n: np.ndarray, m: np.ndarray, s: np.ndarray, t: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Whether sizes and sketches allow the similarity."""
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (differing(s ^ t) <= most)


def _small_pairs(nodes: DataFrame, similarity: float, small: int) -> DataFrame:
    """Pairs within small nodes (path, c, n, sketch) whose sketches and sizes allow the similarity."""
    most = most_differing(similarity)

    def run(batches):
        for g in _groups(batches, ("path",)):
            path, c, n, s = g["path"], g["c"], g["n"].astype(float), g["sketch"]
            left, right = [], []
            for shift in range(1, small + 1):
                at = np.flatnonzero(path[:-shift] == path[shift:])
                if not len(at):
                    break
                at = at[_alike(n[at], n[at + shift], s[at], s[at + shift], similarity, most)]
                left.append(c[at])
                right.append(c[at + shift])
            if left:
                yield _pair_batch(np.concatenate(left), np.concatenate(right))

    return nodes.select("path", "c", "n", "sketch").repartition("path").sortWithinPartitions("path").mapInArrow(tidy(run), _PAIRS)


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the label of their c by the links; a c without a link is its own."""
    own = labels(links, "dup-groups").select(F.col("node").alias("c"), "label")
    return rows.join(own, "c", "left").withColumn("label", F.coalesce("label", "c"))


def _set_chunks(sets: DataFrame, chunk_shingles: int) -> DataFrame:
    """chunk, c (8 bytes each), sizes (4), raw (6 bytes a shingle), n: sets (c, raw) end to end."""

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            c, raws = zip(*held)
            cells = [number, np.array(c, np.int64).tobytes(), np.array([len(r) // 6 for r in raws], np.uint32).tobytes(), b"".join(raws), size]
            return pa.record_batch([pa.array([x], t) for x, t in zip(cells, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], ["chunk", "c", "sizes", "raw", "n"])

        for batch in batches:
            for item in zip(batch.column("c").to_pylist(), batch.column("raw").to_pylist()):
                held.append(item)
                size += len(item[1]) // 6
                if size >= chunk_shingles:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return sets.select("c", "raw").mapInArrow(tidy(run), "chunk long, c binary, sizes binary, raw binary, n long")


def _by_shard(raw: bytes, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk by shard and value, how many sets of the chunk hold each, where shards begin, and the place of each shingle's."""
    keys, number, counts = np.unique(_wide(raw), return_inverse=True, return_counts=True)
    shard = (_mix(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return keys[order], counts[order], np.searchsorted(shard[order], np.arange(shards + 1)), rank[number]


def _able(sets: DataFrame, percent: int, chunk_shingles: int = CHUNK_SHINGLES, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """c, fame (mean number of sets that hold its shingles) of the sets (c, raw) that can be linked with another at all.

    Of a linked set at least percent of a hundred shingles are in the other.
    Shingles travel packed, in one message for each chunk of sets and shard of
    shingles, and so do the answers.
    """
    chunks = materialize(_set_chunks(sets, chunk_shingles), "dup-chunks")
    shards = max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // shard_shingles))

    def ask(batches):
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("raw").to_pylist()):
                keys, counts, cuts, _ = _by_shard(raw, shards)
                for s in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[s], cuts[s + 1])
                    yield pa.record_batch([pa.array([s], pa.int32()), pa.array([chunk]), pa.array([squeeze(np.diff(keys[own], prepend=np.uint64(0)))]), pa.array([squeeze(counts[own])])], ["shard", "chunk", "keys", "counts"])

    def add(key, t):
        keys, counts = ([unsqueeze(x) for x in t[c].to_pylist()] for c in ("keys", "counts"))
        keys = [np.cumsum(k) for k in keys]
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, np.concatenate(counts)).astype(np.uint64)
        raws = [squeeze(total[n]) for n in np.split(number, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"chunk": t["chunk"], "shard": t["shard"], "held": pa.array(raws, pa.binary())})

    def judge(key, left, right):
        if not left.num_rows:
            return left.select(["c"]).cast(pa.schema([("c", pa.int64())])).append_column("fame", pa.array([], pa.float64()))
        row = {c: left[c][0].as_py() for c in ("c", "sizes", "raw")}
        size = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        answers = dict(zip(right["shard"].to_pylist(), right["held"].to_pylist()))
        held = np.concatenate([unsqueeze(answers[s]) for s in sorted(answers)])[_by_shard(row["raw"], shards)[3]].astype(np.int64)
        starts = np.cumsum(size) - size
        shared, fame = np.add.reduceat((held > 1).astype(np.int64), starts), np.add.reduceat(held, starts) / size
        good = shared * 100 >= size * percent
        return pa.table({"c": pa.array(np.frombuffer(row["c"], np.int64)[good]), "fame": pa.array(fame[good])})

    asked = chunks.select("chunk", "raw").mapInArrow(tidy(ask), "shard int, chunk long, keys binary, counts binary")
    answered = asked.groupBy("shard").applyInArrow(add, "chunk long, shard int, held binary")
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(judge, "c long, fame double")


def _dense_links(dense: DataFrame, sets: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame:
    """The links, and those that large nodes (path, c) hold beside them, as many as connect their members."""
    members = dense.join(materialize(_able(sets.join(dense.select("c").distinct(), "c", "left_semi"), percent), "dup-able"), "c")
    hubs = members.groupBy("path").agg(F.max(F.struct("fame", "c")).getField("c").alias("a"))
    groups = materialize(members.join(hubs, "path").select("a", "c").distinct(), "dup-groups")
    found = _confirmed(groups.filter("a <> c").select("a", F.col("c").alias("b")), sets, percent)
    links = materialize(links.unionByName(found), "dup-links")
    rows = materialize(_labelled(groups, links), "dup-labelled")
    main = rows.filter("a = c").select("a", F.col("label").alias("main"))
    sizes = rows.join(main, "a").groupBy("a", "main").agg(F.count("*").alias("members"), F.sum(F.when(F.col("label") != F.col("main"), 1).otherwise(0)).alias("rest")).filter("rest > 0")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    of = lambda n: F.pmod(F.xxhash64("c"), blocks(n)).cast("int")
    live = rows.join(sizes, "a")
    columns = ["a", "i", "j", "first", "c", "label"]
    rest = live.filter("label <> main").withColumn("i", of("rest")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("members") - 1))).withColumn("first", F.lit(True))
    every = live.withColumn("j", of("members")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("rest") - 1))).withColumn("first", F.lit(False))
    cells = rest.select(columns).unionByName(every.select(columns)).join(sets, "c")

    def run(batches):
        for g in _groups(batches, ("a", "i", "j"), 2 * block):
            cell = np.stack([g["a"], g["i"], g["j"]], 1)
            new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1)))
            for x, y in zip(new, np.append(new[1:], len(cell))):
                first, second = (np.flatnonzero(g["first"][x:y] == k) + x for k in (True, False))
                pairs = connecting([g["raw"][i] for i in first], g["label"][first], [g["raw"][i] for i in second], g["label"][second], percent)
                if pairs:
                    left, right = np.array(pairs).T
                    yield pa.record_batch([pa.array(g["c"][first[left]]), pa.array(g["c"][second[right]])], ["a", "b"])

    more = cells.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j").mapInArrow(tidy(run), _PAIRS)
    return links.unionByName(more)


def connecting(first: list[bytes], label: np.ndarray, second: list[bytes], other: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Similar pairs of a packed set of the first and one of the second, of different labels: as many as connect what all such pairs connect."""
    if not first or not second:
        return []
    sets = [_wide(r) for r in second]
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    label, other, out, held = label.copy(), other.copy(), [], np.zeros(len(distinct) + 1, np.int64)
    for x, raw in enumerate(first):
        own = _wide(raw)
        at = np.searchsorted(distinct, own)
        at[at < len(distinct)] = np.where(distinct[at[at < len(distinct)]] == own[at < len(distinct)], at[at < len(distinct)], len(distinct))
        held[at] = 1
        held[-1] = 0
        shared = np.add.reduceat(held[number], starts)
        held[at] = 0
        like = np.flatnonzero((100 * shared >= percent * (size + len(own) - shared)) & (other != label[x]))
        if len(like):
            groups, one = np.unique(other[like], return_index=True)
            out += [(x, int(y)) for y in like[one]]
            for z in (label, other):
                z[np.isin(z, groups)] = label[x]
    return out


def _parted(level: DataFrame, own: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Members (path, c) of small nodes of a level, with what own says of each c, and of large nodes; nodes of one member are gone."""
    sizes = level.groupBy("path").agg(F.count("*").alias("members")).filter("members > 1")
    live = materialize(level.join(sizes, "path"), "dup-live")
    return live.filter(F.col("members") <= small).join(own, "c"), live.filter(F.col("members") > small).select("path", "c")


def _wide(raw: bytes) -> np.ndarray:
    return np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view(np.uint64).ravel()


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """c, raw: the full sets (48 bits of each hash) of the classes wanted (c, k, k2).

    A bit array of fixed size keeps most other documents' sets from being
    shuffled; where it is full, they merely travel.
    """
    place = F.pmod("k", F.lit(_BLOOM_BITS))
    words_ = wanted.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(k, 64) as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bloom = np.zeros(_BLOOM_BITS >> 6, np.uint64)
    bloom[words_["w"].to_numpy()] = words_["bits"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        bits, cache = sent.value, {}
        for batch in batches:
            keys, others, raws = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, words, cache)
                k, k2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                p = k % _BLOOM_BITS
                if len(s) and int(bits[p >> 6]) >> (p & 63) & 1:
                    keys.append(k)
                    others.append(k2)
                    raws.append(np.unique(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(raws, pa.binary())], ["k", "k2", "raw"])

    found = docs.select("text").mapInArrow(tidy(run), "k long, k2 long, raw binary")
    return found.groupBy("k", "k2").agg(F.first("raw").alias("raw")).join(wanted, ["k", "k2"]).select("c", "raw")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; distinct) whose full sets reach the similarity.

    b's set travels with its pair, a's once for each PAIRS of its pairs, to which
    these are dealt.
    """
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    first = per.join(sets.withColumnRenamed("c", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "raw")
    dealt = pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    rows = dealt.join(sets.withColumnRenamed("c", "b"), "b").select("a", "part", "b", "raw").unionByName(first)

    def run(batches):
        own = None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i, raw in enumerate(batch.column("raw")):
                x = _wide(raw.as_buffer())
                if b[i] is None:  # comes before the pairs of its part
                    own = x
                    continue
                both = np.concatenate([own, x])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    good.append(i)
            yield pa.record_batch([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(tidy(run), _PAIRS)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Links join rows whose sets of word shingles have 100 * intersection >=
    percent * union.  Null or empty texts, and texts of white space, have an
    empty set and stand alone.  Rows with equal sets are one class, whatever
    their number.  A null id never is a component's id, unless it has no other:
    then component_id is null, and kept is true where both are null.  Rows with
    equal ids are judged by their own texts.  An empty table gives an empty one.
    """
    signed, belongs = _grouped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), words, percent, small, block)
    own = signed.select("id", "n", "k", "k2")
    linked = own.filter("n > 0").join(belongs.drop("label"), ["k", "k2"], "left").select("id", "n", "component_id")
    out = linked.unionByName(own.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of each group that near_duplicates links, whatever ids its rows have: id, text and the columns in keep.

    The row of the smallest id stays, one with a null id only if the group has
    no other; among rows with this id that of the smallest hash of all
    columns; of equal rows one.  Rows with an empty set all stay.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.lit(0).alias("end"))
    signed, belongs = _grouped(source, words, percent, SMALL, BLOCK)
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64(*source.columns).alias("hash"), "row")
    least = signed.filter("n > 0").groupBy("k", "k2").agg(F.min(order).alias("first"))  # first of each set, then of each group
    first = least.join(belongs.select("k", "k2", "label"), ["k", "k2"]).groupBy("label").agg(F.min("first").alias("first"))
    stay = signed.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").unionByName(signed.filter("n = 0").select("row", *[c for c in signed.columns if c != "row"]))
    return stay.select(F.col("id").alias(id_col), F.col("text").cast("string").alias(text_col), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])


def _grouped(rows: DataFrame, words: int, percent: int, small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """What _signed makes of the rows (id, text, others); and of each set its group and the group's smallest id (k, k2, label, component_id).

    Sets are told apart by 128 bits; a number c stands for each from there on.
    """
    small_batches(rows.sparkSession)
    similarity, source = percent / 100, rows.select("id", "text")
    signed = materialize(_signed(rows, words), "dup-signed")
    classes = signed.filter("n > 0").groupBy("k", "k2").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "dup-classes")
    own = classes.select("c", "n", "sketch")

    pairs, level, dense = [], materialize(_children(classes, similarity), "dup-nodes"), None
    for depth in range(1, DEPTH + 1):
        less, more = _parted(level, own, small)
        forget(level)
        pairs.append(_small_pairs(less, similarity, small))
        if not more.take(1):
            break
        if depth < DEPTH:
            level = materialize(_children(more.join(classes.select("c", "sig"), "c"), similarity), "dup-nodes")
        else:
            dense = more
    all_pairs = pairs[0]
    for more_pairs in pairs[1:]:
        all_pairs = all_pairs.unionByName(more_pairs)
    candidates = materialize(all_pairs.distinct(), "dup-pairs")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("c"))
    if dense is not None:
        wanted = wanted.unionByName(dense.select("c"))
    wanted = materialize(classes.select("c", "k", "k2").join(wanted.distinct(), "c", "left_semi"), "dup-wanted")
    sets = materialize(_sets_of(source, wanted, words), "dup-sets")
    links = materialize(_confirmed(candidates, sets, percent), "dup-links")
    if dense is not None:
        links = _dense_links(dense, sets, links, percent, block)
    label = labels(links)
    forget(sets)
    named = classes.select("c", "k", "k2", "least").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return signed, named.join(smallest, "label").select("k", "k2", "label", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: links at 4-word shingles and a similarity of 0.8 over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
