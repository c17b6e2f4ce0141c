"""Profiling and retrieval: cell index, BM25, n-grams, substring match, vectors, text extraction."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.names import norm

#: Parts of column names whose cells are not worth an index.  Fixed values.
SKIP = ("_id", " id", "url", "email", "web", "time", "date", "address")


def text_cells(frames: dict[str, DataFrame], keys: dict[str, str] = {}, longest: int = 256) -> DataFrame:
    """table_name, column_name, value: distinct texts of every text column that is no key and no identifier."""
    parts = []
    for table, df in sorted(frames.items()):
        names = [c for c, t in df.dtypes if t == "string" and c != keys.get(table) and not norm(c).endswith("id") and not any(s in norm(c) for s in SKIP)]
        if names:
            stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in names])).alias("x"))
            parts.append(stacked.select(F.lit(table).alias("table_name"), "x.column_name", "x.value").filter((F.col("value") != "") & (F.length("value") <= longest)).distinct())
    return reduce(DataFrame.unionByName, parts)


def content_index(cells: DataFrame, longest: int = 40) -> DataFrame:
    """doc_id (table-**-column-**-n), content: short texts that are not numbers, numbered in order within their column.

    Values are numbered among those that begin alike, and what begins with less
    is added: no task holds a whole column.
    """
    column, begin = ["table_name", "column_name"], F.substring("value", 1, 3).alias("begin")
    kept = cells.filter((F.length("value").between(1, longest)) & F.expr("try_cast(value AS double)").isNull()).select(*column, "value", begin)
    sizes = kept.groupBy(*column, "begin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*column).orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(W.partitionBy(*column, "begin").orderBy("value")) - 1 + F.col("before")
    placed = kept.join(sizes.select(*column, "begin", before.alias("before")), [*column, "begin"])
    return placed.select(F.concat_ws("-**-", *column, n.cast("string")).alias("doc_id"), F.col("value").alias("content"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def spaced_tokens(c: Column) -> Column:
    """tokens() joined by blanks, without an array."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, doc_id, tf, length: one row for each term of each row of docs.

    Words are counted within their row, sorted, by where another word begins:
    nothing is shuffled.  Rows of the same id are added up by bm25_of_index().
    """
    each = docs.select(F.col(id_col).alias("doc_id"), F.sort_array(tokens(F.col(text_col))).alias("t")).filter(F.size("t") > 0)
    begin = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    each = each.select("doc_id", "t", F.size("t").alias("length"), begin.alias("begin"))
    counted = F.transform("begin", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("begin", k + 1), F.col("length")) - i).cast("long").alias("tf")))
    return each.select("doc_id", "length", F.explode(counted).alias("x")).select("x.term", "doc_id", "length", "x.tf")


#: Distinct terms of all queries up to which they are looked for in place; beyond, they meet the documents' terms in a join.
TERMS = 5000


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4, id_col: str = "doc_id", text_col: str = "text", most: int = TERMS) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query (query_id, text); ties to the smaller id.

    Only terms that a query has leave the scan.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = [r["term"] for r in asked.select("term").distinct().limit(most + 1).collect()]
    each = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t")).select("doc_id", "t", F.size("t").alias("length"))
    found = each.select("doc_id", "length", F.explode(F.filter("t", lambda x: x.isin(terms)) if len(terms) <= most else F.col("t")).alias("term"))
    if len(terms) > most:
        found = found.join(asked.select("term").distinct(), "term", "left_semi")
    index = found.groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))
    return ranked(index, each.agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean")), asked, k, k1, b)


def bm25_of_index(index: DataFrame, n_docs: int, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4, most: int = TERMS) -> DataFrame:
    """The same over stored postings(); rows of the same id and length are one document."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = [r["term"] for r in asked.select("term").distinct().limit(most + 1).collect()]
    found = index.filter(F.col("term").isin(terms)) if len(terms) <= most else index.join(asked.select("term").distinct(), "term", "left_semi")
    found = found.groupBy("term", "doc_id", "length").agg(F.sum("tf").alias("tf"))
    stats = index.select("doc_id", "length").distinct().agg(F.lit(n_docs).alias("n_docs"), F.avg("length").alias("mean"))
    return ranked(found, stats, asked, k, k1, b)


def ranked(index: DataFrame, stats: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    hits = index.join(asked, "term")
    df = hits.groupBy("term", "query_id").agg(F.count_distinct("doc_id").alias("df"))
    rows = hits.join(df, ["term", "query_id"]).crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def grams(text: Column, n: int = 3) -> Column:
    """Character n-grams of a lower-case text between blanks."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.substr(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def text_vectors(items: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """keys, gram, weight: each text as a unit vector over its character n-grams, sparse."""
    counted = items.select(*keys, F.explode(grams(F.col(text_col))).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    norm = counted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counted.join(norm, list(keys)).select(*keys, "gram", (F.col("n") / F.col("norm")).alias("weight"))


def text_search(vectors: DataFrame, asked: DataFrame, keys: list[str], k: int, below: float) -> DataFrame:
    """query_id, keys, distance, rank: of each query (query_id, text) the k nearest texts under a squared distance, by text_vectors().

    Texts without a common n-gram are 2 apart, so that below 2 only those meet
    that share one.
    """
    if below > 2:
        raise ValueError("texts that share nothing are 2 apart")
    q = text_vectors(asked, "text", "query_id").withColumnRenamed("weight", "own")
    near = vectors.join(q, "gram").groupBy("query_id", *keys).agg(F.sum(F.col("weight") * F.col("own")).alias("dot"))
    scored = near.withColumn("distance", F.round(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot")), 6)).filter(F.col("distance") < below)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", *keys))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", *keys, "distance", "rank")


def literal_cells(vectors: DataFrame, literals_: DataFrame, k: int = 5, below: float = 0.8) -> DataFrame:
    """table_name, column_name, content: cells near a literal (literal) that is no number, each once; vectors: text_vectors() of text_cells()."""
    asked = literals_.filter(F.col("literal").isNotNull() & ~F.col("literal").rlike(r"^[0-9]+$")).select(F.col("literal").alias("query_id"), F.col("literal").alias("text")).distinct()
    found = text_search(vectors, asked, ["table_name", "column_name", "value"], k, below)
    return found.select("table_name", "column_name", F.col("value").alias("content")).distinct()


def skeletons(examples: DataFrame, asked: DataFrame, k: int = 15, below: float = 1.5) -> DataFrame:
    """query_id, rank, example: worked examples (skeleton, question, evidence, sql) whose skeleton is near the question's (query_id, text)."""
    near = text_search(text_vectors(examples.select("skeleton").distinct(), "skeleton", "skeleton"), asked, ["skeleton"], k, below)
    text = F.concat(F.lit("Question: "), "question", F.lit("\nEvidence: "), F.coalesce("evidence", F.lit("")), F.lit("\nSQL: "), "sql")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "skeleton", "question", "sql"))
    return near.drop("rank").join(examples, "skeleton").select("query_id", rank.alias("rank"), text.alias("example")).filter(F.col("rank") <= k)


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """Store an index of vectors (table_name, ...), a folder for each table, so that a search reads only those it asks for."""
    vectors.write.mode(mode).partitionBy("table_name").parquet(path)


def matched_text(cells: DataFrame) -> DataFrame:
    """query_id, text: one line per matched cell (query_id, table_name, column_name, values)."""
    name = F.when(F.col("column_name").contains(" "), F.concat(F.lit("`"), "column_name", F.lit("`"))).otherwise(F.col("column_name"))
    each = cells.select("query_id", "table_name", name.alias("name"), F.explode("values").alias("value"))
    each = each.select("query_id", F.concat(F.lit("- "), "table_name", F.lit("."), "name", F.lit(": "), "value", F.lit("\n")).alias("line"))
    return each.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("text"))


def examples_text(examples: list[dict]) -> str:
    return "".join(f"## Example {i}:\n" + "".join(f"{k}: {v}\n" for k, v in e.items()) + "\n" for i, e in enumerate(examples))


def markdown(names: list[str], rows: list[tuple]) -> str:
    """A few rows as a table."""
    if not rows:
        return "(no rows)"
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows)])


#: Characters of a query that are kept, and to which parts of a prompt are cut when it is too long.  Fixed values.
QUERY_CHARS = 10_000
SHORT = {"schema": 7000, "descriptions": 2500, "evidence": 2000, "question": 1500}


def with_retry(generate, parts: dict[str, str]) -> dict[str, str | None]:
    """sql, error of generate(parts): a failure that tells of too long a context is followed by one attempt with shortened parts."""
    def shortened(text: str | None, most: int) -> str:
        return (text or "")[:most]

    error = None
    for attempt in (parts, {k: shortened(v, SHORT.get(k, QUERY_CHARS)) for k, v in parts.items() if k in SHORT}):
        try:
            sql = generate(attempt) or ""
            if len(sql) > QUERY_CHARS:
                return {"sql": sql[:QUERY_CHARS], "error": f"query clipped to {QUERY_CHARS} characters"}
            return {"sql": sql, "error": error and f"retried with a short prompt: {error}"}
        except Exception as e:
            error = f"{error} | {e}" if error else str(e)
            if "context" not in str(e).lower() and "too long" not in str(e).lower() and "token" not in str(e).lower():
                break
    return {"sql": "", "error": error}


def stepwise(question: str, schema_text: str, generate) -> dict[str, str]:
    """links, label, sql of step-wise generation: link the schema, tell how hard the question is, write a query that fits that, correct it.

    generate(step, question, context) answers each step with text as
    prompt_fields() reads it.
    """
    import re

    def field(name: str, text: str, default: str = "") -> str:
        m = re.search(rf"{name}:\s*([^\n]*)", text or "")
        return m[1].strip() if m else default

    links = field("Schema_links", generate("link", question, schema_text), "[]")
    said = generate("classify", question, links)
    label = field("Label", said, '"NESTED"').strip("\"' ").upper()
    asked = field("sub_questions", said) if label not in ("EASY", "NON-NESTED") else ""
    sql = field("SQL", generate({"EASY": "easy", "NON-NESTED": "medium"}.get(label, "hard"), question, "\n".join(x for x in (links, asked) if x)), "SELECT")
    revised = field("Revised_SQL", generate("correct", question, sql))
    return {"links": links, "label": label, "sql": revised or sql}


def ngrams(words: Column, most: int = 8) -> Column:
    """All n-grams up to `most` words, joined by blanks, by length and then place."""
    one = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in range(1, most + 1)])


#: Bytes of texts whose n-grams are made together, and bytes of text whose n-grams are made at a time.
TOGETHER, BLOCK = 1 << 16, 1 << 17


def _digests(texts: list[bytes], most: int, block: int) -> list[tuple[int, str]]:
    """Number and MD5 of the n-grams of each text, its words between single blanks.

    The words of all texts lie in a row.  An n-gram is its first word after ;
    and further words after blanks, so that a block of them is one stretch of
    bytes; of it each text takes its part.
    """
    counts = [t.count(b" ") + 1 if t else 0 for t in texts]
    first = np.cumsum([0, *counts])
    blank = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)
    places = np.flatnonzero(blank == ord(" "))
    begin = blank.copy()
    begin[places] = ord(";")
    offsets = pa.py_buffer(np.append(places, len(blank)).astype(np.int64))
    begin, blank = (pa.Array.from_buffers(pa.large_binary(), len(places), [None, offsets, pa.py_buffer(x)]) for x in (begin, blank))
    hashes, n_grams = [hashlib.md5(usedforsecurity=False) for _ in texts], [0] * len(texts)
    for n in range(1, min(most, max(counts, default=0)) + 1):
        low, last = 0, len(places) - n + 1
        while low < last:
            high = min(max(low + 1, int(np.searchsorted(places, places[low] + block))), last)
            size = high - low
            grams = pc.binary_join_element_wise(begin.slice(low, size), *(blank.slice(low + i, size) for i in range(1, n)), pa.scalar(b"", pa.large_binary()))
            ends, raw = np.frombuffer(grams.buffers()[1], np.int64)[grams.offset :], memoryview(grams.buffers()[2])
            for d in range(int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, high))):
                a, b = max(int(first[d]), low), min(int(first[d + 1]) - n + 1, high)
                if a < b:
                    hashes[d].update(raw[ends[a - low] + (n_grams[d] == 0) : ends[b - low]])
                    n_grams[d] += b - a
            low = high
    return [(n, h.hexdigest()) for n, h in zip(n_grams, hashes)]


def _groups(texts: pa.Array, together: int) -> Iterator[list[bytes]]:
    """The texts in groups of so many bytes at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    low = 0
    for high in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // together)) + 1), len(texts)]:
        if low < high:
            yield [t or b"" for t in texts.slice(low, high - low).to_pylist()]
        low = high


def ngrams_md5(text: Column, most: int = 8, together: int = TOGETHER, block: int = BLOCK) -> Column:
    """n_grams and grams_md5 of a text: size(g) and md5(array_join(g, ";")) of g = ngrams(tokens(text)); of a null as of an empty text.

    The n-grams are many times the text.  They are never held at once, and no
    lambda is asked about each.
    """

    @F.arrow_udf("n_grams int, grams_md5 string")
    def digest(texts: pa.Array) -> pa.Array:
        found = [x for group in _groups(texts.cast(pa.large_binary()), together) for x in _digests(group, most, block)]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array([h for _, h in found], pa.string())], ["n_grams", "grams_md5"])

    return digest(spaced_tokens(text))


def substring_share(query: Column, target: Column) -> Column:
    """Length of the query's longest substring that the target holds, as a share of the query; case does not count."""
    q, t, n = F.lower(query), F.lower(target), F.length(query)
    fits = lambda size: F.exists(F.sequence(F.lit(1), n - size + 1), lambda i: F.contains(t, F.substr(q, i, size)))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), F.lit(0), lambda a, size: F.when((a == size - 1) & fits(size), size.cast("int")).otherwise(a))
    return F.when(n > 0, best / n).otherwise(F.lit(0.0))


#: Characters by which two texts meet, at most.
MEET = 16


def _sharing(held: DataFrame, text: str, holders: DataFrame, other: str, least: float) -> DataFrame:
    """Pairs in which the holder's text holds more than the share `least` of the held text, with the score.

    No cross join arises: such a pair has `need` characters in a row in common,
    and meets by the first MEET of them.  Whole words need not be shared.
    """
    lower, n = F.lower(text), F.length(F.lower(text))
    need = F.greatest(F.lit(1), F.ceil(n * F.lit(least) - 1e-6)).cast("int")
    held = held.distinct().filter(n > 0).withColumn("need", need).filter(F.col("need") <= n)
    pieces = F.transform(F.sequence(F.lit(1), n - F.col("need") + 1), lambda i: F.substr(lower, i, F.least("need", F.lit(MEET))))
    held = held.withColumn("w", F.explode(F.array_distinct(pieces))).drop("need")
    sizes = held.select(F.length("w").alias("size")).distinct()  # MEET rows at most
    whole, n = F.lower(other), F.length(F.lower(other))
    holders = holders.distinct().crossJoin(F.broadcast(sizes)).filter(n >= F.col("size"))
    pieces = F.transform(F.sequence(F.lit(1), n - F.col("size") + 1), lambda i: F.substr(whole, i, F.col("size")))
    holders = holders.withColumn("w", F.explode(F.array_distinct(pieces))).drop("size")
    pairs = held.join(holders, "w").drop("w").distinct()
    return pairs.withColumn("score", substring_share(lower, F.col(other))).filter(F.col("score") > least)


def matching_cells(cells: DataFrame, phrases: DataFrame, least: float = 0.85, most: int = 20, of: str = "value") -> DataFrame:
    """query_id, table_name, column_name, values: cells of which a phrase (query_id, phrase) holds more than the share `least`, the best `most` in all.

    The share is that of the cell's longest substring that the phrase holds;
    with of="phrase", of the phrase's that the cell holds.  Case does not count.
    """
    cells, phrases = cells.select("table_name", "column_name", "value"), phrases.select("query_id", "phrase")
    scored = _sharing(cells, "value", phrases, "phrase", least) if of == "value" else _sharing(phrases, "phrase", cells, "value", least)
    best = scored.groupBy("query_id", "table_name", "column_name", "value").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.length("value")), "table_name", "column_name", "value"))
    return best.withColumn("place", place).filter(F.col("place") <= most).groupBy("query_id", "table_name", "column_name").agg(F.array_sort(F.collect_list("value")).alias("values"))


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def vector_search(df: DataFrame, query: list[float], k: int, below: float | None = None, include: dict[str, list] = {}, exclude: dict[str, list] = {}, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, distance: the k nearest rows under a distance, by metadata in and not in; all conditions hold together."""
    rows = df
    for c, values in include.items():
        rows = rows.filter(F.col(c).isin(*values))
    for c, values in exclude.items():
        rows = rows.filter(~F.col(c).isin(*values))
    rows = rows.select(id_col, F.round(distance(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])), 6).alias("distance"))
    if below is not None:
        rows = rows.filter(F.col("distance") < below)
    return rows.orderBy("distance", id_col).limit(k)


def literals(text: Column, most: int = 20) -> Column:
    """Quoted texts and numbers in a text, distinct without regard to case, at most `most`."""
    quoted = F.regexp_extract_all(text, F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))
    bare = F.regexp_extract_all(F.regexp_replace(text, r"""['"][^'"]*['"]""", " "), F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1))
    every = F.concat(quoted, bare)
    lower = F.transform(every, lambda x: F.lower(x))
    first = F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    """The first JSON object in a text, null if there is none; what follows it does not count."""
    decoder = json.JSONDecoder()

    def first(x: str | None) -> str | None:
        at = (x or "").find("{")
        while at >= 0:
            try:
                _, end = decoder.raw_decode(x, at)
                return x[at:end]
            except ValueError:
                at = x.find("{", at + 1)
        return None

    return text.map(first)


def prompt_fields(text: Column) -> dict[str, Column]:
    """What step-wise generation prints: links, class, sub-questions, SQL and revised SQL."""
    return {
        "schema_links": F.trim(F.regexp_extract(text, r"Schema_links:\s*([^\n]*)", 1)),
        "label": F.upper(F.regexp_extract(text, r"""Label:\s*["']?([A-Za-z-]+)""", 1)),
        "sub_questions": F.filter(F.split(F.regexp_extract(text, r"sub_questions:\s*\[([^\]]*)\]", 1), r"\s*;\s*"), lambda x: x != ""),
        "sql": F.trim(F.regexp_extract(text, r"(?m)^SQL:\s*([^\n]*)", 1)),
        "revised_sql": F.trim(F.regexp_extract(text, r"Revised_SQL:\s*([^\n]*)", 1)),
    }


def samples(df: DataFrame, columns: list[str], n: int = 3, cut: int = 64) -> DataFrame:
    """column_name, value: the n first distinct values of each column, cut."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    kept = each.filter((F.col("value").isNotNull()) & (F.col("value") != "")).distinct()
    place = F.row_number().over(W.partitionBy("column_name").orderBy("value"))
    return kept.withColumn("place", place).filter(F.col("place") <= n).select("column_name", F.substring("value", 1, cut).alias("value"))


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)
