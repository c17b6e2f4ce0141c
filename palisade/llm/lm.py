"""Operator 10: language-model scores from a sharded Elias-Fano n-gram trie.

Documents are cut into chunks of tokens, numbered within the chunk.  Two
exchanges follow, both of one message per chunk and shard instead of a row per
token.  Words meet by hash: each word's shard adds up its count and answers
every chunk that has the word.  Distinct trigrams of a chunk meet by their
middle word: the shard builds a trie from the training counts, and looks the
chunk's trigrams up in it, held-out ones included.  A word with more than
HOT_SHARE of all tokens is divided among shards by the word before it.  A part
knows all of its pairs (before, word), but not P(after | word), which counts the
words before of all parts: parts give their counts of followers to a third
exchange, which adds them up and answers every chunk that has the follower.
Last, every chunk puts its tokens and the answers together.  No score depends
on the number of shards.

P(c | a b) = A + B * P(c): A and B from the trie, P(c) the smoothed unigram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.elias_fano import Trie, quantise, restore
from palisade.llm.shared import crc_mod, forget, materialize, small_batches, squeeze, table, tidy, trim, unsqueeze

#: Tokens of a chunk; a longer document is a chunk of its own.
CHUNK_TOKENS = 2_000_000
#: Training and other tokens for each shard of words and of trigrams, on average.
SHARD_TOKENS = 3_000_000
#: A word with a larger share of all tokens is divided; at most 1 / HOT_SHARE words are.
HOT_SHARE = 1e-4
DISCOUNT = 0.75
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Chunk:
    """Texts of a chunk: tokens are numbers of words, after the end the most frequent first; hashes of the words."""

    def __init__(self):
        self.index: dict[bytes, int] = {b"\n": 0}  # the end; no word holds white space
        self.ids, self.train, self.sizes, self.tokens, self.n = [], [], [], [], 0

    def add(self, id_, train: bool, text: bytes | None) -> None:
        index = self.index
        words = (text or b"").lower().split()
        own = np.fromiter([index.setdefault(w, len(index)) for w in words], np.uint32, len(words))
        self.ids.append(id_)
        self.train.append(train)
        self.sizes.append(len(words) + 1)
        self.tokens += [own, np.zeros(1, np.uint32)]
        self.n += len(words) + 1

    def row(self, kind: pa.DataType, number: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens)
        counts = np.bincount(tokens, minlength=len(self.index))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.index), np.uint64, len(self.index))
        most = counts.copy()
        most[0] = self.n + 1  # the end keeps number 0, which also stands before a text
        order = np.lexsort((hashes, -most))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        trained = int(np.array(self.sizes)[np.array(self.train)].sum())
        cells = [[number], [self.ids], [self.train], [self.sizes], [squeeze(rank[tokens])], [(hashes[order] >> np.uint64(32)).astype(np.uint32).tobytes()], [hashes[order].astype(np.uint32).tobytes()], [self.n], [trained]]
        types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cells, types)], ["chunk", "ids", "train", "sizes", "tokens", "halves", "lows", "n", "n_train"])


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        number, now = TaskContext.get().partitionId() << 24, None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for id_, train, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                now = now or _Chunk()
                now.add(id_, train, text)
                if now.n >= chunk_tokens:
                    yield now.row(type_, number)
                    number, now = number + 1, None
        if now:
            yield now.row(type_, number)

    return docs.mapInArrow(tidy(run), f"chunk long, ids array<{kind}>, train array<boolean>, sizes array<long>, tokens binary, halves binary, lows binary, n long, n_train long")


def _trained(sizes: np.ndarray, train: np.ndarray) -> np.ndarray:
    return np.repeat(train, sizes)


def _word_order(shard: np.ndarray, half: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Words by shard and upper half of the hash, which is all that travels with a chunk, and where shards begin."""
    order = np.lexsort((half, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _whole(halves: bytes, lows: bytes) -> np.ndarray:
    return np.frombuffer(halves, np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(lows, np.uint32)


def _word_messages(chunks: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk, train, sizes, tokens, halves, lows in zip(*(batch.column(c).to_pylist() for c in ("chunk", "train", "sizes", "tokens", "halves", "lows"))):
                hashes = _whole(halves, lows)
                counts = np.bincount(unsqueeze(tokens).astype(np.int64), _trained(np.array(sizes), np.array(train)), len(hashes)).astype(np.uint64)
                shard = (_mixed(hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                order, cuts = _word_order(shard, hashes >> np.uint64(32), shards)
                for s in range(shards):
                    own = order[cuts[s] : cuts[s + 1]]
                    if len(own):
                        gaps = np.diff(hashes[own], prepend=np.uint64(0))
                        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([chunk]), pa.array([squeeze(gaps)]), pa.array([squeeze(counts[own])])], ["shard", "chunk", "hashes", "counts"])

    return chunks.select("chunk", "train", "sizes", "tokens", "halves", "lows").mapInArrow(tidy(run), "shard int, chunk long, hashes binary, counts binary")


_ANSWER = "chunk long, kind int, shard int, raw binary"


def _word_answers(messages: DataFrame, hot: float) -> DataFrame:
    """For each message the counts of its words; of each shard, as chunk -1, its distinct training words and hot words."""

    def answer(key, t):
        hashes = [np.cumsum(unsqueeze(x)) for x in t["hashes"].to_pylist()]
        counts = [unsqueeze(x).astype(np.int64) for x in t["counts"].to_pylist()]
        known, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(number, np.concatenate(counts), len(known)).astype(np.uint64)
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        raws = [squeeze(total[n]) for n in np.split(number, cuts)]
        large = total > hot
        note = np.concatenate([[np.uint64((total > 0).sum())], known[large], total[large]])
        n, s = len(raws), key[0].as_py()
        trim()
        return pa.table([pa.array(t["chunk"].to_pylist() + [-1]), pa.array([0] * (n + 1), pa.int32()), pa.array([s] * (n + 1), pa.int32()), pa.array([*raws, note.tobytes()], pa.binary())], ["chunk", "kind", "shard", "raw"])

    return messages.groupBy("shard").applyInArrow(answer, _ANSWER)


def trigrams(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (middle, before, after) in order, and for each token the number of its trigram.

    Word 0 begins a text twice over, as it ends one: context and prediction never mix them.
    """
    begin = np.cumsum(sizes) - sizes
    middle, before = np.zeros_like(tokens), np.zeros_like(tokens)
    middle[1:], before[2:] = tokens[:-1], tokens[:-2]
    middle[begin] = 0
    before[begin] = 0
    second = begin[sizes > 1] + 1
    before[second] = 0
    if int(tokens.max()) < 1 << 21:
        keys, number = np.unique(middle << 42 | before << 21 | tokens, return_inverse=True)
        low = (1 << 21) - 1
        return keys >> 42, keys >> 21 & low, keys & low, number
    pairs, pair = np.unique(middle << 32 | before, return_inverse=True)
    keys, number = np.unique(pair << 32 | tokens, return_inverse=True)
    own = pairs[keys >> 32]
    return own >> 32, own & 0xFFFFFFFF, keys & 0xFFFFFFFF, number


def _shares(half: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of parts of each word."""
    words, parts = hot
    share = np.ones(len(half), np.uint64)
    if len(words):
        at = np.minimum(np.searchsorted(words, half), len(words) - 1)
        same = words[at] == half
        share[same] = parts[at[same]]
    return share


def _dealt(half: np.ndarray, middle: np.ndarray, before: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shard of each trigram: by the middle word; for a hot word also by the word before, over its number of parts."""
    share, home = _shares(half, hot), _mixed(half)
    part = _mixed(half * _M)[before] % share[middle]
    return (_mixed(home[middle] + part * _M) % np.uint64(shards)).astype(np.int64)


def _follower_keys(word: np.ndarray, after: np.ndarray, share: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each (divided word, word after), from 40 bits of either hash, and its shard: by the word and the key over the word's number of parts."""
    key = _mixed(_mixed(word * _M) + _mixed(after + _M) * _M) >> np.uint64(16)
    return key, (_mixed(_mixed(word) + (key % share) * _M + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _followers(middle: np.ndarray, after: np.ndarray, hashes: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray]):
    """Distinct (divided word, word after) of a chunk by shard and key: where shards begin, keys, words; trigrams with a divided word, and the pair of each."""
    share = _shares(hashes >> np.uint64(32), hot)
    cut = np.flatnonzero(share[middle] > 1)
    pairs, number = np.unique(middle[cut] << 32 | after[cut], return_inverse=True)
    word, own = pairs >> 32, hashes >> np.uint64(24)
    key, shard = _follower_keys(own[word], own[pairs & 0xFFFFFFFF], share[word], shards)
    order = np.lexsort((key, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return np.searchsorted(shard[order], np.arange(shards + 1)), key[order], own[word[order]], cut, rank[number]


def _follower_messages(chunks: DataFrame, shards: int, sent) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk, sizes, tokens, halves, lows in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "tokens", "halves", "lows"))):
                middle, _, after, _ = trigrams(unsqueeze(tokens).astype(np.int64), np.array(sizes))
                cuts, keys, *_ = _followers(middle, after, _whole(halves, lows), shards, sent.value)
                for s in np.flatnonzero(np.diff(cuts)):
                    raw = squeeze(np.diff(keys[cuts[s] : cuts[s + 1]], prepend=np.uint64(0)))
                    yield pa.record_batch([pa.array([chunk]), pa.array([2], pa.int32()), pa.array([s], pa.int32()), pa.array([raw])], ["chunk", "kind", "shard", "raw"])

    return chunks.select("chunk", "sizes", "tokens", "halves", "lows").mapInArrow(tidy(run), _ANSWER)


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in map(squeeze, arrays))


def _unpacked(raw: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(unsqueeze(raw[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def _follower_answers(messages: DataFrame, discount: float) -> DataFrame:
    """For each chunk (kind 2) the numbers of words before its followers, added up over the parts (kind 3); as chunk -1, of each word the total and what is freed."""

    def answer(key, t):
        kinds = np.array(t["kind"].to_pylist())
        given = [_unpacked(r) for r, k in zip(t["raw"].to_pylist(), kinds) if k == 3]
        words = [np.repeat(w, n.astype(np.int64)) for w, n, _, _ in given]
        keys, numbers = [np.cumsum(k) for *_, k, _ in given], [n for *_, n in given]
        none = [np.zeros(0, np.uint64)]
        known, first, number = np.unique(np.concatenate(keys or none), return_index=True, return_inverse=True)
        before = np.bincount(number, np.concatenate(numbers or none), len(known)).astype(np.uint64)
        chunks, raws = [], []
        for chunk, raw, k in zip(t["chunk"].to_pylist(), t["raw"].to_pylist(), kinds):
            if k == 2:
                asked = np.cumsum(unsqueeze(raw))
                at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
                chunks.append(chunk)
                raws.append(squeeze(np.where(known[at] == asked, before[at], np.uint64(0)) if len(known) else np.zeros(len(asked), np.uint64)))
        owners, owner = np.unique(np.concatenate(words or none)[first], return_inverse=True)
        freed = np.bincount(owner, np.minimum(before, discount), len(owners))
        note = np.concatenate([owners, np.bincount(owner, before, len(owners)).astype(np.uint64), freed.view(np.uint64)])
        n, s = len(raws) + 1, key[0].as_py()
        return pa.table([pa.array(chunks + [-1], pa.int64()), pa.array([2] * n, pa.int32()), pa.array([s] * n, pa.int32()), pa.array([*raws, note.tobytes()], pa.binary())], ["chunk", "kind", "shard", "raw"])

    return messages.groupBy("shard").applyInArrow(answer, _ANSWER)


def _follower_totals(answers: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Divided words (40 bits), total of each and what is freed, over all shards."""
    notes = [np.frombuffer(r["raw"], np.uint64).reshape(3, -1) for r in answers.filter("chunk = -1").select("raw").toLocalIterator()]
    words, total, freed = np.concatenate(notes or [np.zeros((3, 0), np.uint64)], 1)
    known, number = np.unique(words, return_inverse=True)
    return known, np.bincount(number, total, len(known)), np.bincount(number, freed.view(float), len(known))


def _trigram_messages(chunks: DataFrame, shards: int, sent) -> DataFrame:
    def run(batches):
        hot = sent.value
        for batch in batches:
            for chunk, train, sizes, tokens, halves, lows in zip(*(batch.column(c).to_pylist() for c in ("chunk", "train", "sizes", "tokens", "halves", "lows"))):
                hashes, sizes = _whole(halves, lows), np.array(sizes)
                middle, before, after, number = trigrams(unsqueeze(tokens).astype(np.int64), sizes)
                counts = np.bincount(number, _trained(sizes, np.array(train)), len(middle)).astype(np.int64)
                shard = _dealt(hashes >> np.uint64(32), middle, before, shards, hot)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in range(shards):
                    own = order[cuts[s] : cuts[s + 1]]
                    if len(own):
                        words, n = np.unique(np.concatenate([middle[own], before[own], after[own]]), return_inverse=True)
                        m, b, a = np.split(n, 3)
                        parts = [(hashes[words] >> np.uint64(24)), np.diff(m, prepend=0), b, a, counts[own]]
                        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([chunk]), *(pa.array([squeeze(p)]) for p in parts)], ["shard", "chunk", "w", "m", "b", "a", "c"])

    return chunks.select("chunk", "train", "sizes", "tokens", "halves", "lows").mapInArrow(tidy(run), "shard int, chunk long, w binary, m binary, b binary, a binary, c binary")


def _coded(x: np.ndarray) -> np.ndarray:
    """16 bits of a number from 0 to 1, on a logarithmic scale."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.clip(np.rint(np.log2(x) * 256) + 65535, 1, 65535), 0).astype(np.uint64)


def _decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((code.astype(float) - 65535) / 256), 0.0)


def _trigram_answers(messages: DataFrame, discount: float, shards: int, sent) -> DataFrame:
    """For each message A and B of its trigrams (kind 1), for divided words the pair's share of them alone, as 8-bit codes; these words' followers in this part (kind 3).

    Messages are unpacked twice rather than held unpacked.
    """

    def answer(key, t):
        words = [unsqueeze(x) for x in t["w"].to_pylist()]
        vocabulary, number = np.unique(np.concatenate(words), return_inverse=True)
        number = np.split(number.astype(np.int32), np.cumsum([len(w) for w in words])[:-1])
        del words

        def unpacked(i: int):
            m, b, a = (unsqueeze(t[x][i].as_py()).astype(np.int64) for x in ("m", "b", "a"))
            return number[i][b], number[i][np.cumsum(m)], number[i][a]

        share = _shares(vocabulary >> np.uint64(8), sent.value)
        added = _added(unpacked, t["c"])
        to, raws = _part_followers(vocabulary, share, added[1], added[2], shards)
        trie = Trie.build(vocabulary, *added, discount).mapped()
        del added
        kinds = [3] * len(to) + [1] * t.num_rows
        for i in range(t.num_rows):
            b, w, a = unpacked(i)
            cut = share[w] > 1
            given, rest = trie.lookup(b, w, a, cut)
            raws.append(_packed(*(np.where(cut, quantise(x), _coded(x)) for x in (given, rest))))
            del b, w, a, cut, given, rest
        chunks, s = [-1] * len(to) + t["chunk"].to_pylist(), key[0].as_py()
        del trie
        trim()
        return pa.table([pa.array(chunks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(to + [s] * t.num_rows, pa.int32()), pa.array(raws, pa.binary())], ["chunk", "kind", "shard", "raw"])

    return messages.groupBy("shard").applyInArrow(answer, _ANSWER)


def _part_followers(vocabulary: np.ndarray, share: np.ndarray, middle: np.ndarray, after: np.ndarray, shards: int) -> tuple[list[int], list[bytes]]:
    """Shards and, for each, divided words, followers of each, keys, numbers of words before; from a part's distinct trigrams."""
    cut, u = share[middle] > 1, np.int64(max(1, len(vocabulary)))
    pairs, before = np.unique(middle[cut] * u + after[cut], return_counts=True)
    word = pairs // u
    key, shard = _follower_keys(vocabulary[word], vocabulary[pairs % u], share[word], shards)
    order = np.lexsort((key, word, shard))
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    to, raws = np.flatnonzero(np.diff(cuts)).tolist(), []
    for s in to:
        own = order[cuts[s] : cuts[s + 1]]
        words, n = np.unique(word[own], return_counts=True)
        raws.append(_packed(vocabulary[words], n, np.diff(key[own], prepend=np.uint64(0)), before[own]))
    return to, raws


def _added(unpacked, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (before, middle, after) with training counts above 0, added up over the messages, by middle, before, after."""
    parts = []
    for i in range(len(counts)):
        c = unsqueeze(counts[i].as_py()).astype(np.int32)
        trained = np.flatnonzero(c)
        parts.append((*(x[trained] for x in unpacked(i)), c[trained]))
    b, m, a, c = (np.concatenate(x) for x in zip(*parts))
    del parts
    if not len(c):
        return b, m, a, c
    if int(max(b.max(), m.max(), a.max())) < 1 << 21:
        order = np.argsort(m.astype(np.int64) << 42 | b.astype(np.int64) << 21 | a).astype(np.int32)
    else:
        order = np.lexsort((a, b, m)).astype(np.int32)
    b, m, a, c = b[order], m[order], a[order], c[order]
    begin = np.flatnonzero(np.append(True, (np.diff(m) != 0) | (np.diff(b) != 0) | (np.diff(a) != 0)))
    return b[begin], m[begin], a[begin], np.add.reduceat(c, begin)


def score(docs: DataFrame, held_out: tuple[int, int] | None = (5, 1), discount: float = DISCOUNT, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z lower-cased, and one end; n_known counts those
    found in training texts, which are all but the rows whose crc32(id as
    text) has the remainder held_out names.  base_score is the log10
    probability by smoothed unigrams, score that by the trie.  A null or empty
    text is its end alone; a text of any length is scored whole; repeated rows
    count and score each; a null id has the remainder of an empty text; an
    empty table gives an empty one.  Words are told apart by 64 bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = crc_mod(id_col, held_out[0]) != held_out[1] if held_out else F.lit(True)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).cast("binary").alias("text"))
    chunks = materialize(_chunks(source, chunk_tokens), "lm-chunks")
    n_all, n_train = (x or 0 for x in chunks.agg(F.sum("n"), F.sum("n_train")).first())
    shards = max(1, -(-n_all // shard_tokens))
    word_answers = materialize(_word_answers(_word_messages(chunks, shards), HOT_SHARE * n_train), "lm-words")
    notes = [np.frombuffer(r["raw"], np.uint64) for r in word_answers.filter("chunk = -1").select("raw").toLocalIterator()]
    distinct = sum(int(x[0]) for x in notes)
    halves = [np.split(x[1:], 2) for x in notes]
    words, counts = (np.concatenate([h[i] for h in halves] or [np.zeros(0, np.uint64)]) for i in range(2))
    order = np.argsort(words)
    parts = np.ceil(counts[order] / max(1, n_train) * shards * 8).astype(np.uint64)  # each part an eighth of a shard at most
    halves_, first = np.unique(words[order] >> np.uint64(32), return_index=True)
    sent = spark.sparkContext.broadcast((halves_, np.maximum(parts[first], 1)))
    trigram_answers = materialize(_trigram_answers(_trigram_messages(chunks, shards, sent), discount, shards, sent), "lm-trigrams")
    followers = trigram_answers.filter("kind = 3").unionByName(_follower_messages(chunks, shards, sent))
    follower_answers = materialize(_follower_answers(followers, discount), "lm-followers")
    divided = spark.sparkContext.broadcast(_follower_totals(follower_answers))
    answers = word_answers.filter("chunk >= 0").unionByName(trigram_answers.filter("kind = 1")).unionByName(follower_answers.filter("chunk >= 0"))

    def join(key, left, right):
        hot = sent.value
        row = {c: left[c][0].as_py() for c in ("ids", "train", "sizes", "tokens", "halves", "lows")}
        half, sizes = np.frombuffer(row["halves"], np.uint32).astype(np.uint64), np.array(row["sizes"])
        raws = {(k, s): r for k, s, r in zip(right["kind"].to_pylist(), right["shard"].to_pylist(), right["raw"].to_pylist())}
        tokens = unsqueeze(row["tokens"]).astype(np.int64)
        count = np.zeros(len(half))
        shard = (_mixed(half) % np.uint64(shards)).astype(np.int64)
        order, cuts = _word_order(shard, half, shards)
        for s in range(shards):
            if cuts[s] < cuts[s + 1]:
                count[order[cuts[s] : cuts[s + 1]]] = unsqueeze(raws[0, s])
        single = (count + 0.5) / (n_train + 0.5 * (distinct + 1))
        middle, before, after, number = trigrams(tokens, sizes)
        shard = _dealt(half, middle, before, shards, hot)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        codes = np.zeros((2, len(middle)), np.uint64)
        for s in range(shards):
            if cuts[s] < cuts[s + 1]:
                codes[:, order[cuts[s] : cuts[s + 1]]] = _unpacked(raws[1, s])
        cuts, keys, words, cut, pair = _followers(middle, after, _whole(row["halves"], row["lows"]), shards, hot)
        if len(cut):
            known, total, freed = divided.value
            before_ = np.concatenate([unsqueeze(raws[2, s]) for s in np.flatnonzero(np.diff(cuts))]).astype(float)
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            seen, total = known[at] == words, np.maximum(total[at], 1)
            lower = restore(quantise(np.where(seen, np.maximum(before_ - discount, 0) / total, 0.0)))
            left_ = restore(quantise(np.where(seen, freed[at] / total, 1.0)))
            own, share = (restore(x.astype(np.uint8)) for x in codes[:, cut])
            codes[:, cut] = _coded(lower[pair] * share + own), _coded(left_[pair] * share)
        given, rest = (_decoded(x) for x in codes)
        logs = np.log10(np.minimum(given + rest * single[after], 1.0))[number]
        begin = np.cumsum(sizes) - sizes
        cells = [pa.array(row["ids"], left.schema.field("ids").type.value_type), pa.array(~np.array(row["train"])), pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64)[tokens], begin)), pa.array([n_train] * len(sizes), pa.int64()), pa.array(np.add.reduceat(np.log10(single)[tokens], begin)), pa.array(np.add.reduceat(logs, begin))]
        return pa.table(cells, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (
        chunks.select("chunk", "ids", "train", "sizes", "tokens", "halves", "lows")
        .groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(join, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents; those whose crc32 modulo 5 is 1 are not learnt from."""
    return score(table(spark, sf_dir, "documents"))
