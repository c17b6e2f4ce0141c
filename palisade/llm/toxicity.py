"""Operator 9: toxicity by class-conditional Kneser-Ney models.

Two models over the letters of running text, one of toxic and one of ordinary
documents, share the counts they back off to.  A document's toxic and ordinary
log-likelihoods are compared, normalised by its length; a logistic scale is
fitted to labelled documents that neither model has seen.  A second feature of
that scale adds up only what words are likelier as toxic beyond a margin: in a
long document thousands of ordinary words differ a little by chance, and would
drown the few that matter.

Contexts reach over word ends: the letters before a word tell the language, so
that languages commoner in one class do not speak for that class.  Texts stay
on the executors; counted n-grams and a row of features per labelled document
of the sample are what reaches the driver.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import scan
from palisade.llm.shared import crc_mod, forget, materialize, small_batches, table, text_or_empty, tidy

#: Labelled documents of each class that a model is fitted on, at most: those of smallest MD5 of the id.
SAMPLE = 4000
ORDER = 4
#: Margins and powers of the length to choose from for the second feature.
MARGINS = (0.0, 1.0, 2.0, 3.0)
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
_BITS = 6
_GAP = 1


@lru_cache(1)
def letter_symbols() -> np.ndarray:
    """6-bit symbol of every code point: letters without case, all else one gap; rare letters share symbols."""
    out = np.full(sys.maxunicode + 1, _GAP, np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ord(ch.lower()[0])
            out[c] = 2 + low - 97 if 97 <= low <= 122 else 28 + low % 36
    return out


def symbols(text: str) -> np.ndarray:
    """Symbols of a text; runs of other characters are one gap, and gaps stand at both ends."""
    points = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = letter_symbols()[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _GAP) | (out[:-1] != _GAP)
    return out[keep]


def gram_codes(text: str, order: int) -> np.ndarray:
    """Codes of the n-grams that end at each symbol but the first."""
    s = np.concatenate([np.zeros(order - 2, np.uint8), symbols(text)]).astype(np.int64)
    n = len(s) - order + 1
    out = np.zeros(max(n, 0), np.int64)
    for i in range(order):
        out = out << _BITS | s[i : i + len(out)]
    return out


def gram_counts(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and their counts, gathered block by block."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0)
    for a, b in scan.groups([len(t) for t in texts], 1 << 20):
        new, n = np.unique(np.concatenate([gram_codes(t, order) for t in texts[a:b]]), return_counts=True)
        grams, where = np.unique(np.concatenate([grams, new]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), len(grams))
    return grams, counts


def discounts(n: np.ndarray) -> np.ndarray:
    """What Kneser-Ney takes from counts of 0, 1, 2 and more, by the counts of counts."""
    c = np.maximum([(n == k).sum() for k in range(1, 5)], 1).astype(float)
    y = c[0] / (c[0] + 2 * c[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.3 * k), 0.95 * k) for k in (1, 2, 3))])


class SharedBackoff:
    """Interpolated Kneser-Ney: class counts back off to those of both classes together, these to continuation counts.

    Where a class has seen little, its estimate is the common one.  All that
    scoring needs is one number for each n-gram that a class has seen, and one
    for each context, for the n-grams in it that none has.
    """

    def __init__(self, order: int = ORDER):
        self.order = order

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> "SharedBackoff":
        """parts: distinct n-grams and their counts, of class 0 (ordinary) and 1 (toxic)."""
        grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        own = np.stack([np.bincount(w, n, len(grams)) for w, (_, n) in zip(np.split(where, [len(parts[0][0])]), parts)])
        common = self._common(grams, own.sum(0))
        contexts, of = np.unique(grams >> _BITS, return_inverse=True)
        logs, left = [], []
        for n in own:
            total = np.bincount(of, n, len(contexts))
            d = discounts(n)[np.minimum(n, 3).astype(np.int64)]
            freed = np.bincount(of, np.minimum(n, d), len(contexts))
            share = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
            p = np.maximum(n - d, 0) / np.maximum(total, 1)[of] + share[of] * common
            logs.append(np.log(np.maximum(p, 1e-300)))
            left.append(np.log(share))
        self._table(grams, logs[1] - logs[0], contexts, left[1] - left[0])
        return self

    def _common(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(last symbol | those before) of each n-gram by the common counts."""
        orders = []
        for k in range(self.order, 0, -1):
            contexts, of = np.unique(grams >> _BITS, return_inverse=True)
            total = np.bincount(of, n, len(contexts))
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = min(0.95, max(0.3, once / max(1, once + 2 * twice)))
            freed = np.bincount(of, np.minimum(n, d), len(contexts))
            shorter, suffix = np.unique(grams & (1 << _BITS * (k - 1)) - 1, return_inverse=True)
            orders.append((np.maximum(n - d, 0) / total[of], (freed / total)[of], suffix))
            grams, n = shorter, np.bincount(suffix, minlength=len(shorter)).astype(float)
        p = np.full(1, 1 / 62)
        for direct, share, suffix in reversed(orders):
            p = direct + share * p[suffix]
        return p

    def _table(self, grams, contrast, contexts, context_contrast) -> None:
        """One open-addressed table; contexts are keyed apart by the sign bit."""
        keys = np.concatenate([grams, contexts | np.int64(-(1 << 62))])
        values = np.concatenate([contrast, context_contrast]).astype(np.float32)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift = 64 - bits
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            first, which = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[which]
            self.keys[first], self.values[first] = keys[left[chosen]], values[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key (0 if unknown) and whether it is known."""
        at, mask = self._slot(keys), len(self.keys) - 1
        found = self.keys[at]
        hit = found == keys
        value = np.where(hit, self.values[at], np.float32(0))
        open_ = np.flatnonzero(~hit & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            same = found == keys[open_]
            hit[open_[same]] = True
            value[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (found != -1)]
        return value, hit

    def contrasts(self, codes: np.ndarray) -> np.ndarray:
        """log P(symbol | toxic) - log P(symbol | ordinary) of each n-gram's last symbol."""
        value, known = self._find(codes)
        rest = np.flatnonzero(~known)
        if len(rest):
            value[rest] = self._find(codes[rest] >> _BITS | np.int64(-(1 << 62)))[0]
        return value


@dataclass
class Detector:
    """Fitted models, margin and power of the second feature, slopes and offset of the logistic scale."""

    model: SharedBackoff
    margin: float = 0.0
    power: float = 1.0
    slopes: tuple[float, float] = (1.0, 0.0)
    offset: float = 0.0

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic less ordinary log-likelihood of each word, and the number of words of each text."""
        out, size = [np.zeros(0)], np.zeros(len(texts), np.int64)
        for a, b in scan.groups([len(t) for t in texts], 1 << 19):
            codes = [gram_codes(t, self.model.order) for t in texts[a:b]]
            size[a:b] = [int((c & 63 == _GAP).sum()) for c in codes]
            joined = np.concatenate(codes)
            ends = np.flatnonzero(joined & 63 == _GAP) + 1  # a text ends with a gap
            sums = np.concatenate([[0.0], np.cumsum(self.model.contrasts(joined), dtype=float)])
            out.append(np.diff(sums[ends], prepend=0.0))
        return np.concatenate(out), size

    def features(self, texts: list[str], choices: list[tuple[float, float]]) -> np.ndarray:
        """For each text its log-likelihood ratio by its number of words; then, for each (margin, power), what words exceed the margin by the number's power."""
        words, size = self.words(texts)
        ends, least = np.cumsum(size), np.maximum(size, 1)

        def added(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return sums[ends] - sums[ends - size]

        above = {m: added(np.maximum(words - m, 0.0)) for m, _ in choices}
        return np.stack([added(words) / least, *(above[m] / least**p for m, p in choices)], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts, [(self.margin, self.power)]) @ np.array(self.slopes) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Slopes (none below 0), offset and mean log loss of the logistic fit of y on the columns of x."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack([x[:, used] / scale[used], np.ones(len(x))])
        b, penalty = np.zeros(z.shape[1]), ridge * len(x) * np.append(np.ones(int(used.sum())), 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * b)
            b = b - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        if (b[:-1] >= 0).all():
            break
        used[np.flatnonzero(used)[b[:-1] < 0]] = False
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-12, 1 - 1e-12)
    slopes = np.zeros(x.shape[1])
    slopes[used] = b[:-1] / scale[used]
    return slopes, float(b[-1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


CHOICES = [(m, p) for m in MARGINS for p in POWERS]


def _counted(rows: DataFrame, order: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """n-grams and their counts by (label, half) of the rows (text, y, half)."""

    def run(batches):
        for batch in batches:
            y, half = batch.column("y").to_numpy(), batch.column("half").to_numpy()
            texts = batch.column("text").to_pylist()
            for key in {*zip(y.tolist(), half.tolist())}:
                grams, n = gram_counts([t for t, a, b in zip(texts, y, half) if (a, b) == key], order)
                yield pa.record_batch([pa.array([key[0]] * len(grams), pa.int32()), pa.array([key[1]] * len(grams), pa.int32()), pa.array(grams), pa.array(n.astype(np.int64))], ["y", "half", "gram", "n"])

    got = rows.select("text", "y", "half").mapInArrow(tidy(run), "y int, half int, gram long, n long").groupBy("y", "half", "gram").agg(F.sum("n").alias("n")).toArrow()
    y, half, gram, n = (got[c].to_numpy() for c in ("y", "half", "gram", "n"))
    order_ = np.lexsort((gram, half, y))
    y, half, gram, n = y[order_], half[order_], gram[order_], n[order_].astype(float)
    return {(a, b): (gram[(y == a) & (half == b)], n[(y == a) & (half == b)]) for a in (0, 1) for b in (0, 1)}


def _both(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([x[1], y[1]]), len(grams))


def _seen_apart(rows: DataFrame, models: list[SharedBackoff]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the rows (text, y, half), each by the model of the other half, in a fixed order."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = [Detector(m) for m in sent.value]
        for batch in batches:
            texts, half = batch.column("text").to_pylist(), batch.column("half").to_numpy()
            x = np.zeros((len(texts), 1 + len(CHOICES)))
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                x[at] = own[1 - h].features([texts[i] for i in at], CHOICES)
            yield pa.record_batch([batch.column("key"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["key", "y", "x"])

    got = rows.select("text", "y", "half", "key").mapInArrow(tidy(run), "key string, y int, x array<double>").toArrow().sort_by("key")
    return np.array(got["x"].to_pylist()).reshape(-1, 1 + len(CHOICES)), got["y"].to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] | None = (4, 2), sample: int = SAMPLE, order: int = ORDER) -> Detector:
    """Fit on at most `sample` labelled documents of each class, by smallest MD5 of the id.

    held_out = (modulus, remainder): documents whose crc32(id as text) has it
    are not learnt from.  Null ids, null or other labels than 0 and 1, and ids
    with contradicting labels are left out; repeated documents and labels
    count once, of different texts with one id that of the smallest hash.
    Without both labels every text scores the base rate.
    """
    small_batches(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out:
        marked = marked.filter(crc_mod(id_col, held_out[0]) != held_out[1])
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).alias("z")).filter("y = z")
    parted = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    base_rate = parted.get(1, 0) / max(1, sum(parted.values()))
    marked = marked.withColumn("key", F.md5(F.col("id").cast("string").cast("binary"))).drop("z")
    chosen = marked.filter("y = 0").orderBy("key", "id").limit(sample).unionByName(marked.filter("y = 1").orderBy("key", "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")  # 2 * sample short rows
    rows = rows.groupBy("id", "key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    half = (F.conv(F.substring("key", 32, 1), 16, 10).cast("int") % 2).alias("half")
    rows = materialize(rows.select("text", "y", half, "key"), "toxic-sample")
    counts = _counted(rows, order)
    whole = [_both(counts[c, 0], counts[c, 1]) for c in (0, 1)]
    final = Detector(SharedBackoff(order).fit(whole))
    if not all(len(g) for g, _ in whole):
        final.slopes, final.offset = (0.0, 0.0), math.log((base_rate + 1e-3) / (1 - base_rate + 1e-3))
        return final
    x, y = _seen_apart(rows, [SharedBackoff(order).fit([counts[0, h], counts[1, h]]) for h in (0, 1)])
    forget(rows)
    fits = [(logistic(x[:, [0, 1 + i]], y), m, p) for i, (m, p) in enumerate(CHOICES)]
    (slopes, offset, _), final.margin, final.power = min(fits, key=lambda c: c[0][2])
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)  # the sample may hold more toxic documents than the corpus
    final.slopes, final.offset = tuple(slopes), offset + math.log((base_rate + 1e-6) / (1 - base_rate + 1e-6)) - math.log(rate / (1 - rate))
    return final


def score(docs: DataFrame, detector: Detector, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 from threshold on) and the columns in keep.

    Null and empty texts score as texts without evidence; texts of any length
    are scored whole; repeated rows score alike; an empty table
    gives an empty one.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(detector)
    columns = [F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]]
    source = docs.select(*columns)
    names = [c for c in source.columns if c != "_text"]

    def run(batches):
        own = sent.value
        for batch in batches:
            got = own.scores(batch.column("_text").to_pylist())
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], [*names, "_score", "_predicted"])

    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in names)
    out = source.mapInArrow(tidy(run), schema + ", _score double, _predicted int")
    return out.select(F.col("_id").alias(id_col), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents; labels of rows whose crc32 modulo 4 is 2 are not learnt from."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
