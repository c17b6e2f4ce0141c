"""Tokens, lines, near duplicates, toxicity and language model against brute force."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest

from palisade.llm import byte_bpe, elias_fano, line_dedup, lm, near_dup, scan, token_counts, toxicity

from .conftest import TRICKY

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "B", "é", "中", "の", "🙂", "1", "23", "'s", "'LL", "'", " ", "  ", "\n", "\r\n", "\t", " ", "!", "?!", "_", "́", "ß", "don't", "word", " ", "٣", "<|endoftext|>"]


def noise(n, seed):
    pick = random.Random(seed)
    return [(100 + i, "".join(pick.choices(ALPHABET, k=pick.randint(1, 60)))) for i in range(n)]


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


# --- operators 1 and 4


def test_byte_bpe_is_the_library(docs_of):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = TRICKY + noise(300, 1)
    wanted = Counter()
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        wanted[i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((text or "").encode())] += 1
    got = byte_bpe.round_trip(docs_of(rows), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == wanted


def test_offsets_and_decoding(tricky, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(tricky, path)
    texts = Counter((i, (t or "").encode()) for i, t in TRICKY)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded, path).collect()) == texts
    for r in encoded.collect():
        assert len(r.offsets) == len(r.ids) and list(r.offsets) == sorted(set(r.offsets)) and (not r.offsets or r.offsets[0] == 0)
    assert byte_bpe.round_trip(empty, path).count() == 0


def test_special_strings_that_overlap(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    more = [spec["added_tokens"][0] | {"id": 60000 + i, "content": c} for i, c in enumerate(("ab", "abc", "bcd", "<|end"))]
    spec["added_tokens"] += more
    path = str(tmp_path / "special.json")
    json.dump(spec, open(path, "w"))
    library, texts = Tokenizer.from_file(path), ["abcd", "xabc abcd", "<|endoftext|><|end", "babcdab", ""]
    assert token_counts.MergeCounter(path).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    spec["normalizer"] = {"type": "Lowercase"}
    json.dump(spec, open(path, "w"))
    with pytest.raises(ValueError):
        token_counts.MergeCounter(path)


def test_pieces_are_matches_of_the_pattern():
    import regex

    for _, text in noise(200, 2):
        assert scan.pieces([text])[0] == regex.findall(public_tokenizers.PATTERN, text)


def test_token_counts_are_the_library(docs_of, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rows = TRICKY + noise(300, 3)
    wanted = Counter()
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted[i, len((text or "").encode()), n, n > 512] += 1
    got = token_counts.count_tokens(docs_of(rows), path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert Counter(map(tuple, got)) == wanted
    assert token_counts.count_tokens(empty, path).count() == 0


# --- operator 5


def brute_near(rows, words, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {(doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)}


def near_rows():
    pick, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for group in range(40):
        base = pick.choices(vocabulary, k=pick.randint(3, 150))
        for copy in range(pick.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            rows.append((len(rows), (" " if copy % 2 else "\n").join(words)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t"), (len(rows) + 3, "one"), (len(rows) + 4, "ONE ")]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_against_all_pairs(docs_of, words):
    rows = near_rows()
    got = near_dup.near_duplicates(docs_of(rows), words=words).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == brute_near(rows, words, 80)


def test_large_nodes_against_all_pairs(docs_of):
    """Nodes of more than a few members go through counting, representatives and the grid, as those of thousands would."""
    pick = random.Random(15)
    shared, rows = [f"s{i}" for i in range(120)], near_rows()
    for i in range(90):  # half of them boilerplate: alike, but mostly not enough
        own = [f"o{i % 45}x{k}" for k in range(pick.choice([20, 28, 36, 90]))]
        rows.append((1000 + i, " ".join(shared + own)))
    for i in range(80):  # copies of one text with more and more edits: linked through those with few
        words = list(shared)
        for _ in range(i // 8):
            words[pick.randrange(len(words))] = f"e{pick.randrange(400)}"
        rows.append((2000 + i, " ".join(words)))
    for block in (4, near_dup.BLOCK):
        got = near_dup.near_duplicates(docs_of(rows), words=5, small=3, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert len(got) == len(rows) and set(map(tuple, got)) == brute_near(rows, 5, 80)


def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = near_dup.query(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert set(map(tuple, got)) == brute_near(rows, 4, 80)


def test_near_duplicates_of_tricky_rows(tricky, empty):
    got = near_dup.near_duplicates(tricky).collect()
    assert len(got) == len(TRICKY)
    assert sorted(r.component_id for r in got if r.doc_id in (1, 7)) == [1, 1, 1]
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in got if r.doc_id in (2, 3, 4))
    assert near_dup.near_duplicates(empty).count() == 0


# --- operator 6


def brute_lines(rows, least_docs, least=1):
    white = " \t\n\x0b\x0c\r"

    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(white))

    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or found[key(x)] < least_docs]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup_against_brute_force(docs_of, empty):
    pick = random.Random(6)
    shared = ["Share this", "share THIS\r", "  share this\t", "", " ", "All rights reserved.", "ünïcode line", "é" * 300]
    rows = TRICKY + [(200 + i, "\n".join(pick.choices(shared + [f"own {i} {k}" for k in range(6)], k=pick.randint(0, 12)))) for i in range(60)]
    for least_docs in (2, 10):
        got = line_dedup.drop_common_lines(docs_of(rows), least_docs=least_docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
        assert Counter(map(tuple, got)) == brute_lines(rows, least_docs)
        many = line_dedup.drop_common_lines(docs_of(rows), least_docs=least_docs, pass_bytes=1, shard_keys=2).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
        assert Counter(map(tuple, many)) == brute_lines(rows, least_docs)
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_perfect_hash_has_a_slot_for_each_key():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        first, second = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        assert len(line_dedup.build_shard(first, second, np.full(n, 12, np.int64))) > 0


# --- operator 9


@pytest.mark.parametrize("sf", ["sf0.01", "check_s"])
def test_toxicity_on_rows_held_out(spark, sf):
    """Of 14 toxic documents at sf0.01, with 37 toxic labels to learn from, 9 are found; on the larger table 98 %."""
    sf = f"/root/testdata/{sf}"
    if not os.path.isdir(sf):
        pytest.skip("table not here")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.query(spark, sf).collect()
    assert len(got) == documents(spark, sf).count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and toxic.get(r.doc_id) is not None]
    bad, good = [p for p, t in held if t == 1], [p for p, t in held if t == 0]
    found, false = sum(bad) / len(bad), sum(good) / len(good)
    print(f"{sf}: found {found:.3f} of {len(bad)}, false alarms {false:.4f} of {len(good)}")
    assert (found >= 0.9 and false <= 0.02) if sf.endswith("check_s") else (found >= 0.6 and false <= 0.02)


def test_toxicity_of_tricky_rows(spark, tricky, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    detector = toxicity.train(documents(spark), labels)
    got = toxicity.score(tricky, detector).collect()
    assert len(got) == len(TRICKY) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, detector).count() == 0
    assert len(toxicity.score(tricky, toxicity.train(empty, labels)).collect()) == len(TRICKY)


def test_toxicity_ignores_labels_held_out(spark):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = documents(spark)
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, x)).collect()} for x in (labels, wrong))
    assert a == b


# --- operator 10


def brute_base(rows):
    tokens = [words_of(t) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    for (i, _), t, h in zip(rows, tokens, held):
        yield i, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)


def test_language_model_against_brute_force(spark, docs_of, empty):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()] + [(None, None), (None, "x y"), (5000, ""), (5001, " \n"), (5002, "the THE the"), (5002, "the THE the")]
    got = sorted(lm.score(docs_of(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    wanted = sorted(brute_base(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    for r, w in zip(got, wanted, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    for held in (True, False):
        ours, base, n = (sum(getattr(r, x) for r in got if r.held_out is held) for x in ("score", "base_score", "n_tokens"))
        assert ours / n > base / n + 0.2
    assert lm.score(empty).count() == 0


def test_elias_fano_gives_back_its_numbers():
    import numpy as np

    values = np.sort(np.random.default_rng(2).integers(0, 10_000, 500)).astype(np.int64)
    found = elias_fano.EliasFano.encode(values)
    assert found.access(np.arange(500)).tolist() == values.tolist()
    asked = np.arange(10_050)
    assert found.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    assert [i >= 0 for i in found.find(asked)] == [x in set(values.tolist()) for x in asked]


@pytest.mark.parametrize("n, below", [(0, 1), (1, 1), (1, 10**6), (500, 300), (5, 10**12), (20_000, 10**5), (1000, 1 << 50)])
def test_elias_fano_of_any_density(n, below):
    import numpy as np

    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, below, n)).astype(np.uint64)
    coded = elias_fano.EliasFano.encode(values)
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, below + 50, 2000).astype(np.uint64)])
    assert coded.access(np.arange(n)).tolist() == values.tolist()
    assert coded.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    assert [i >= 0 for i in coded.find(asked)] == np.isin(asked, values).tolist()
    if n == 20_000:
        assert sum(x.nbytes for x in (coded.low, coded.high, coded.rank)) <= 2 * n  # 16 bits a value, the directory included


def test_language_model_of_long_texts(docs_of):
    """A text far longer than a chunk is scored whole, and counts as all others do."""
    pick = random.Random(10)
    rows = [(1, " ".join(pick.choices([f"w{i}" for i in range(300)], k=60_000)))] + [(2 + i, f"w{i} w{i + 1} once{i}") for i in range(20)]
    got = {r.doc_id: r for r in lm.score(docs_of(rows), chunk_tokens=1000, shard_tokens=5000).collect()}
    wanted = {w[0]: w for w in brute_base(rows)}
    assert all((r.n_tokens, r.n_known) == wanted[i][2:4] and r.base_score == pytest.approx(wanted[i][5]) for i, r in got.items()) and len(got) == len(rows)


def test_language_model_does_not_depend_on_sizes(spark):
    """Neither shards, nor chunks, nor partitions change a score."""
    df = documents(spark)
    scores = []
    for shard_tokens, chunk_tokens, parts in ((10**9, 10**9, 1), (40_000, 10**9, 2), (4_000, 5_000, 3), (30_000, 1, 5)):
        scores.append({r.doc_id: r.score for r in lm.score(df.repartition(parts), shard_tokens=shard_tokens, chunk_tokens=chunk_tokens).collect()})
    assert all(s == pytest.approx(scores[0], rel=1e-12) for s in scores[1:])


def brute_trigram(rows, d=lm.DISCOUNT):
    """Interpolated Kneser-Ney without quantisation: log10 probability of each text."""
    texts = [words_of(t) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    grams = [[(a, b, c) for a, b, c in zip([None, None, *x], [None, *x], x)] for x in texts]
    three = Counter(g for x, h in zip(grams, held) if not h for g in x)
    kinds = Counter((b, c) for _, b, c in three)
    one = Counter(x for t, h in zip(texts, held) if not h for x in t)
    n, v = sum(one.values()), len(one)
    pair, pair_left, word, word_left = Counter(), Counter(), Counter(), Counter()
    for (a, b, _), k in three.items():
        pair[a, b] += k
        pair_left[a, b] += min(k, d)
    for (b, _), k in kinds.items():
        word[b] += k
        word_left[b] += min(k, d)

    def p(a, b, c):
        out = (one[c] + 0.5) / (n + 0.5 * (v + 1))
        if word[b]:
            out = (max(kinds[b, c] - d, 0) + word_left[b] * out) / word[b]
        return (max(three[a, b, c] - d, 0) + pair_left[a, b] * out) / pair[a, b] if pair[a, b] else out

    return [sum(math.log10(p(*g)) for g in x) for x in grams]


@pytest.mark.parametrize("shard_tokens", [10**9, 2_000])
def test_language_model_against_brute_trigrams(spark, docs_of, tricky, shard_tokens):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()] + TRICKY
    got = lm.score(docs_of(rows), shard_tokens=shard_tokens).collect()
    brute = sorted(((i is None, i or 0, s, len(words_of(t)) + 1) for (i, t), s in zip(rows, brute_trigram(rows))))
    ours = sorted((r.doc_id is None, r.doc_id or 0, r.score, r.n_tokens) for r in got)
    assert len(ours) == len(brute)
    for (*a, x, n), (*b, y, m) in zip(ours, brute):
        assert a == b and n == m and abs(x - y) <= 0.03 * n  # 8-bit factors: at most 0.014 each
    assert abs(sum(x[2] for x in ours) - sum(x[2] for x in brute)) <= 0.006 * sum(x[3] for x in brute)  # most factors are a few frequent ones, each rounded alike
