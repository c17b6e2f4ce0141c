"""Profiling and retrieval queries over the data tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import retrieve
from palisade.plans.context import frames, scratch, values
from palisade.sources import catalog
from palisade.sources.catalog import TPCH_KEYS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


_TEXT_COLUMNS = {"customer": ["c_name", "c_mktsegment"], "lineitem": ["l_returnflag", "l_linestatus"], "nation": ["n_name"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_brand", "p_type"], "region": ["r_name"], "supplier": ["s_name"]}
_CELLS = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, {c} AS value FROM {t} WHERE {c} <> '' AND length({c}) <= 256" for t, cs in _TEXT_COLUMNS.items() for c in cs)


@query(_CELLS)
def ret_cells(spark, sf_dir):
    return retrieve.text_cells(frames(spark, sf_dir), TPCH_KEYS["pk"])


@query(f"WITH cells AS ({_CELLS}) SELECT table_name || '-**-' || column_name || '-**-' || (row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) - 1) AS doc_id, value AS content FROM cells WHERE length(value) BETWEEN 1 AND 40 AND TRY_CAST(value AS DOUBLE) IS NULL")
def ret_content_index(spark, sf_dir):
    return retrieve.content_index(retrieve.text_cells(frames(spark, sf_dir), TPCH_KEYS["pk"]))


_ASK = [("q1", "the thing with of"), ("q2", "und der nicht"), ("q3", "idiot license"), ("q4", "zzzz missing")]


@query(
    f"""WITH asked AS ({values(_ASK, 'query_id, text')}), docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM documents),
    p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM docs), tf AS (SELECT term, doc_id, length, count(*) AS tf FROM p GROUP BY ALL),
    stats AS (SELECT (SELECT count(*) FROM documents) AS n_docs, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM tf)),
    q AS (SELECT DISTINCT query_id, unnest(string_split(text, ' ')) AS term FROM asked), hits AS (SELECT * FROM tf JOIN q USING (term)),
    df AS (SELECT query_id, term, count(DISTINCT doc_id) AS df FROM hits GROUP BY ALL),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * length / mean))), 6) AS score FROM hits JOIN df USING (query_id, term) CROSS JOIN stats GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 10"""
)
def ret_bm25(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return retrieve.bm25(docs, spark.createDataFrame(_ASK, "query_id string, text string"))


ORACLES["ret_bm25_index"] = ORACLES["ret_bm25"]


@query()
def ret_bm25_index(spark, sf_dir):
    """The same from a stored index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "postings")
    retrieve.postings(docs, "doc_id", "text").write.parquet(path)
    return retrieve.bm25_of_index(spark.read.parquet(path), docs.count(), spark.createDataFrame(_ASK, "query_id string, text string"))


_LITERAL_ASK = ["united kingdom", "LARGE BRUSHED BRAS", "Brand#1", "building", "zzqqxx", "12345", "Saudi", "MIDDLE EASTERN"]
_GRAMS3 = "list_transform(range(1, greatest(2, length({c}) + 1)), lambda i: substr(' ' || lower({c}) || ' ', i, 3))"


@query(
    f"""WITH cells AS ({_CELLS}), asked AS ({values([(x,) for x in _LITERAL_ASK if not x.isdigit()], 'literal')}),
    cg AS (SELECT table_name, column_name, value, unnest({_GRAMS3.format(c='value')}) AS gram FROM cells), cn AS (SELECT *, count(*) AS n FROM cg GROUP BY ALL),
    cv AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY table_name, column_name, value)) AS w FROM cn),
    ag AS (SELECT literal, unnest({_GRAMS3.format(c='literal')}) AS gram FROM asked), an AS (SELECT *, count(*) AS n FROM ag GROUP BY ALL), av AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY literal)) AS w FROM an),
    near AS (SELECT literal, table_name, column_name, value, round(greatest(0, 2 - 2 * sum(cv.w * av.w)), 6) AS distance FROM cv JOIN av USING (gram) GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY literal ORDER BY distance, table_name, column_name, value) AS place FROM near WHERE distance < 0.8)
    SELECT DISTINCT table_name, column_name, value AS content FROM top WHERE place <= 5"""
)
def ret_literal_cells(spark, sf_dir):
    """Cells near the literals of a question, from a stored index of vectors."""
    cells = retrieve.text_cells(frames(spark, sf_dir), TPCH_KEYS["pk"])
    path = scratch(spark, "vectors")
    retrieve.write_vectors(retrieve.text_vectors(cells, "value", "table_name", "column_name", "value"), path)
    return retrieve.literal_cells(spark.read.parquet(path), spark.createDataFrame([(x,) for x in _LITERAL_ASK], "literal string"))


_EXAMPLES = [("how many _ are in _", "How many customers are in France?", None, "SELECT COUNT(*) FROM customer"), ("list the _ of _", "List the parts of brand 12", "brand is p_brand", "SELECT p_name FROM part"), ("zzz", "z?", None, "SELECT 1")]


@query(values([("q1", 1, "Question: How many customers are in France?\nEvidence: \nSQL: SELECT COUNT(*) FROM customer"), ("q2", 1, "Question: List the parts of brand 12\nEvidence: brand is p_brand\nSQL: SELECT p_name FROM part")], "query_id, rank, example"))
def ret_skeletons(spark, sf_dir):
    examples = spark.createDataFrame(_EXAMPLES, "skeleton string, question string, evidence string, sql string")
    asked = spark.createDataFrame([("q1", "how many _ are there in _"), ("q2", "list the _ of each _"), ("q3", "0000")], "query_id string, text string")
    return retrieve.skeletons(examples, asked).filter("rank = 1")


@query("SELECT 'p' || n_regionkey AS query_id, string_agg('- nation.n_name: ' || n_name || chr(10), '' ORDER BY n_name) AS text FROM nation GROUP BY 1")
def ret_matched_text(spark, sf_dir):
    nation = frames(spark, sf_dir)["nation"]
    cells = nation.groupBy(F.concat(F.lit("p"), "n_regionkey").alias("query_id")).agg(F.collect_list("n_name").alias("values")).select("query_id", F.lit("nation").alias("table_name"), F.lit("n_name").alias("column_name"), "values")
    return retrieve.matched_text(cells)


_JSONS = [('x {"a": {"b": 1}} y {"c": 2}', '{"a": {"b": 1}}'), ("{broken {\"k\": [1, 2]}", '{"k": [1, 2]}'), ("none", None)]


@query(values(_JSONS, "text, found"))
def ret_json_object(spark, sf_dir):
    return spark.createDataFrame([x[:1] for x in _JSONS], "text string").select("text", retrieve.json_object("text").alias("found"))


@query("SELECT 'region' AS table_name, 'r_name' AS column_name, count(*) AS n_rows, count(*) - count(r_name) AS n_nulls, count(DISTINCT r_name) AS n_distinct FROM region UNION ALL SELECT 'region', 'r_regionkey', count(*), count(*) - count(r_regionkey), count(DISTINCT r_regionkey) FROM region UNION ALL SELECT 'nation', 'n_regionkey', count(*), 0, count(DISTINCT n_regionkey) FROM nation")
def src_statistics(spark, sf_dir):
    fs = frames(spark, sf_dir)
    return catalog.statistics({"region": fs["region"], "nation": fs["nation"].select("n_regionkey")})


@query("SELECT 'a b c' AS text, 'a;b;c;a b;b c;a b c' AS grams UNION ALL SELECT 'x', 'x' UNION ALL SELECT '', ''")
def ret_ngrams(spark, sf_dir):
    df = spark.createDataFrame([("a b c",), ("x",), ("",)], "text string")
    return df.select("text", F.array_join(retrieve.ngrams(retrieve.tokens(F.col("text"))), ";").alias("grams"))


_GRAMS = "list_concat(" * 7 + ", ".join(f"list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))" + (")" if n > 1 else "") for n in range(1, 9))


@query(f"""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM documents), grams AS (SELECT doc_id, {_GRAMS} AS g FROM docs)
    SELECT doc_id, len(g)::INTEGER AS n_grams, md5(array_to_string(g, ';')) AS grams_md5 FROM grams""")
def ret_document_ngrams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", retrieve.ngrams_md5("text").alias("x")).select("doc_id", "x.n_grams", "x.grams_md5")


_PAIRS = [("brass", "LARGE BRASS", 1.0), ("brasses", "BRASS", 0.714286), ("abc", "xyz", 0.0), ("tin cup", "a tin c", 0.714286), ("ab", "ba", 0.5)]


@query(values(_PAIRS, "query, target, share"))
def ret_substring_share(spark, sf_dir):
    df = spark.createDataFrame([p[:2] for p in _PAIRS], "query string, target string")
    return df.select("query", "target", F.round(retrieve.substring_share(F.col("query"), F.col("target")), 6).alias("share"))


@query("SELECT 'p' || a.n_nationkey AS query_id, 'nation' AS table_name, 'n_name' AS column_name, string_agg(b.n_name, ',' ORDER BY b.n_name) AS \"values\" FROM nation a JOIN nation b ON contains(lower(b.n_name), lower(a.n_name)) GROUP BY ALL")
def ret_matching_cells(spark, sf_dir):
    fs = frames(spark, sf_dir)
    cells = retrieve.text_cells({"nation": fs["nation"]})
    phrases = fs["nation"].select(F.concat(F.lit("p"), "n_nationkey").alias("query_id"), F.lower("n_name").alias("phrase"))
    found = retrieve.matching_cells(cells, phrases, least=0.95, of="phrase")  # the SQL asks for cells that hold the phrase
    return found.select("query_id", "table_name", "column_name", F.array_join("values", ",").alias("values"))


_QUESTIONS = [
    ("q1", "What is the price of large brass items sold in Saudi Arabia?"), ("q2", "orders of CUSTOMER#00000001 with priority 1-urgent"), ("q3", "brand#1 or Brand#23 in the united  states and asia"),
    ("q4", "economy anodized stee, shipped to the building segment's middle eastern branch"), ("q5", "unitedkingdomfrance"), ("q6", "zzz"), ("q7", ""),
]
_SHARE = "list_max(list_transform(range(1, length(value) + 1), lambda i: list_max(list_transform(range(1, length(value) - i + 2), lambda k: CASE WHEN contains(lower(phrase), substr(lower(value), i, k)) THEN k ELSE 0 END)))) / length(value)"


@query(
    f"""WITH cells AS ({_CELLS}), asked AS ({values(_QUESTIONS, 'query_id, phrase')}), scored AS (SELECT *, {_SHARE} AS score FROM cells CROSS JOIN asked),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(value) DESC, table_name, column_name, value) AS place FROM scored WHERE score > 0.85)
    SELECT query_id, table_name, column_name, string_agg(value, ',' ORDER BY value) AS "values" FROM best WHERE place <= 20 GROUP BY ALL"""
)
def ret_question_cells(spark, sf_dir):
    cells = retrieve.text_cells(frames(spark, sf_dir), TPCH_KEYS["pk"])
    found = retrieve.matching_cells(cells, spark.createDataFrame(_QUESTIONS, "query_id string, phrase string"))
    return found.select("query_id", "table_name", "column_name", F.array_join("values", ",").alias("values"))


_VECTOR = [round(0.1 * ((i % 7) - 3), 2) for i in range(64)]


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {_VECTOR}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 6) AS distance FROM embeddings WHERE label IN (1, 2, 3) AND label NOT IN (3) ORDER BY 2, 1 LIMIT 15")
def ret_vector_search(spark, sf_dir):
    return retrieve.vector_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _VECTOR, 15, None, {"label": [1, 2, 3]}, {"label": [3]})


_LITERALS = [("price of 'Brass' over 12.5 in \"EUROPE\" or 'brass' and 7", "Brass,EUROPE,12.5,7"), ("nothing here", "")]


@query(values(_LITERALS, "text, found"))
def ret_literals(spark, sf_dir):
    df = spark.createDataFrame([x[:1] for x in _LITERALS], "text string")
    return df.select("text", F.array_join(retrieve.literals(F.col("text")), ",").alias("found"))


@query(
    """WITH found AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[''"]([^''"]+)[''"]', 1), regexp_extract_all(regexp_replace(text, '[''"][^''"]*[''"]', ' ', 'g'), '\\b(\\d+(?:\\.\\d+)?)\\b', 1)) AS f FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    low AS (SELECT doc_id, f, list_transform(f, lambda x: lower(x)) AS l FROM found)
    SELECT doc_id, array_to_string(list_filter(f, lambda x, i: list_position(l, lower(x)) = i)[1:20], ',') AS found FROM low"""
)
def ret_document_literals(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(retrieve.literals(F.coalesce("text", F.lit(""))), ",").alias("found"))


_PRINTED = "Schema_links: [a.b, c.d]\nLabel: \"NESTED\"\nsub_questions: [how many?; which one?]\nSQL: SELECT 1\nRevised_SQL: SELECT 2"


@query(values([("[a.b, c.d]", "NESTED", "how many?|which one?", "SELECT 1", "SELECT 2")], "schema_links, label, sub_questions, sql, revised_sql"))
def ret_prompt_fields(spark, sf_dir):
    f = retrieve.prompt_fields(F.col("text"))
    return spark.createDataFrame([(_PRINTED,)], "text string").select(*[(F.array_join(c, "|") if n == "sub_questions" else c).alias(n) for n, c in f.items()])


@query("SELECT column_name, left(value, 8) AS value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS r FROM (SELECT DISTINCT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part)) WHERE r <= 3")
def ret_samples(spark, sf_dir):
    return retrieve.samples(frames(spark, sf_dir)["part"], ["p_brand", "p_type"], 3, 8)


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) ELSE text END AS text FROM documents")
def ret_clipped(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", retrieve.clipped(F.col("text"), 100).alias("text"))
