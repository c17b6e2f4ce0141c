"""Operator 4: token counts by heap-and-linked-list merging."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palisade.llm import scan
from palisade.llm.shared import small_batches, table, text_or_empty, tidy

#: Distinct words that a task keeps, and letters of the longest; the cache starts afresh beyond.
CACHE, CACHED_WORD = 1 << 18, 128


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class MergeCounter:
    """Counts tokens of a byte-level BPE vocabulary file; gives no ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.of_byte = [number(c) for c in byte_alphabet()]
        #: left << 20 | right -> rank; by rank, that key and the symbol of the union.
        self.rank: dict[int, int] = {}
        self.key, self.union = [], []
        for a, b in merges:
            key = number(a) << 20 | number(b)
            self.rank.setdefault(key, len(self.key))
            self.key.append(key)
            self.union.append(number(a + b))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        #: Of several that begin at one place the longest counts; the first place comes first.
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[str, int] = {}

    @staticmethod
    def _check(spec: dict) -> None:
        """Refuse files whose settings would change the counts in ways not built here."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += ["normalizer"] if spec.get("normalizer") else []
        odd += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) else []
        odd += [f"added_tokens.{k}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        if odd or model.get("type", "BPE") != "BPE":
            raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd) or model['type']}")

    def word(self, piece: str) -> int:
        """Initial symbols less merges."""
        symbols = [self.of_byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = count = len(symbols)
        if n == 1:
            return 1
        rank, keys, unions = self.rank.get, self.key, self.union
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank(a << 20 | b)) is not None]
        heapify(heap)
        while heap:
            item = heappop(heap)
            i, r = item & 0xFFFFFFFF, item >> 32
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[i] << 20 | symbols[j] != keys[r]:
                continue  # one of the pair has been merged meanwhile
            union = symbols[i] = unions[r]
            symbols[j] = -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(union << 20 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 20 | union)) is not None:
                heappush(heap, r << 32 | h)
        return count

    def count(self, texts: list[str]) -> list[int]:
        out = np.zeros(len(texts), np.int64)
        for a, b in scan.groups([len(t) for t in texts]):
            if len(self.cache) > CACHE:
                self.cache = {}
            segments, owner = [], []
            for i in range(a, b):
                parts = self.special.split(texts[i]) if self.special else [texts[i]]
                out[i] += len(parts) - 1  # each special string counts as one token and splits the text
                segments += parts
                owner += [i] * len(parts)
            words, per = scan.pieces(segments)
            cache, learn = self.cache, self.word
            got = np.zeros(len(words) + 1, np.int64)
            for k, w in enumerate(words):
                c = cache.get(w)
                if c is None:
                    c = learn(w)
                    if len(w) <= CACHED_WORD:
                        cache[w] = c
                got[k + 1] = c
            ends = np.cumsum(per)
            total = np.cumsum(got)
            np.add.at(out, owner, total[ends] - total[ends - per])
        return out.tolist()


@lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens.  Texts of any length are
    counted whole; equal rows stay separate; an empty table gives an empty one.
    """

    small_batches(df.sparkSession)

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = own.count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    source = df.select(id_col, text_or_empty(text_col).alias("text"))
    return source.mapInArrow(tidy(run, lambda: counter(path).cache.clear()), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op4: token counts of every whole document by the byte-level vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path)
