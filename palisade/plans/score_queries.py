"""Evaluation queries; contributions to summarise are derived from the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import evaluate, retrieve
from palisade.plans.context import engine, scratch, values
from palisade.plans.workload import WORKLOAD
from palisade.sources import io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


_MODES = ["base_none", "base_realign", "view_none"]
_TYPES = ["view_only", "filter_only", "view_and_filter"]


def contributions(spark, sf_dir):
    """One contribution row per order: modes, types and counts from its key."""
    k = F.col("o_orderkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    cells = {
        "policy_viol_count": k % 3, "policy_total_cols": F.lit(10), "policy_viol_binary_count": (k % 3 > 0).cast("long"), "policy_viol_binary_total": F.lit(1), "direct_viol_count": k % 2, "direct_total_cols": k % 5,
        "answer_match": (k % 4 == 0).cast("long"), "answer_total": F.lit(1), "exec_success": (k % 5 > 0).cast("long"), "exec_total": F.lit(1), "syntax_success": (k % 11 > 0).cast("long"), "syntax_total": F.lit(1),
        "expected_query_match_sum": (k % 8) / 8.0, "expected_query_match_total": F.lit(1), "intent_sum": F.least(F.lit(1.0), (k % 6) / 4.0), "intent_total": F.lit(1), "prompt_char_size_sum": k % 1000, "prompt_char_size_total": F.lit(1),
    }
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return orders.select(k.alias("sample_id"), F.floor(k / 3).alias("question_id"), pick(_MODES, k % 3).alias("mode"), pick(_TYPES, F.floor(k / 3) % 3).alias("question_type"), *[c.alias(n) for n, c in cells.items()])


_ROWS = """c AS (SELECT o_orderkey AS k, o_orderkey // 3 AS question_id, ['base_none', 'base_realign', 'view_none'][o_orderkey % 3 + 1] AS mode, ['view_only', 'filter_only', 'view_and_filter'][(o_orderkey // 3) % 3 + 1] AS question_type,
 k % 3 AS pv, 10 AS pt, (k % 3 > 0)::INT AS pb, k % 2 AS dv, k % 5 AS dt, (k % 4 = 0)::INT AS am, (k % 5 > 0)::INT AS es, (k % 11 > 0)::INT AS sy, (k % 8) / 8.0::DOUBLE AS em, least(1.0::DOUBLE, (k % 6) / 4.0::DOUBLE) AS it, k % 1000 AS pc FROM orders)"""
_METRICS = [
    ("samples", "count(*)"), ("policy_violation", "round(sum(pv)::DOUBLE / sum(pt), 6)"), ("policy_violation_binary", "round(sum(pb)::DOUBLE / count(*), 6)"), ("direct_disclosure", "coalesce(round(sum(dv)::DOUBLE / nullif(sum(dt), 0), 6), 0)"),
    ("answer_agreement", "round(sum(am)::DOUBLE / count(*), 6)"), ("execution_success", "round(sum(es)::DOUBLE / count(*), 6)"), ("syntactic_correctness", "round(sum(sy)::DOUBLE / count(*), 6)"),
    ("expected_query_match", "round(sum(em) / count(*), 6)"), ("intent_preservation", "round(sum(it) / count(*), 6)"), ("prompt_chars", "round(sum(pc)::DOUBLE / count(*), 6)"),
]


def _select(prefix: str = "", names=None) -> str:
    return ", ".join(f"{f} AS {prefix}{n}" for n, f in _METRICS if names is None or n in names)


_COHORT = "SELECT DISTINCT question_type, question_id FROM c WHERE mode = 'base_none' AND it >= 1 AND sy = 1"


@query(f"WITH {_ROWS} SELECT {_select()} FROM c")
def ev_totals(spark, sf_dir):
    return evaluate.group_metrics(contributions(spark, sf_dir))


@query(f"WITH {_ROWS}, r AS (SELECT mode AS m, {_select('relative_')} FROM c WHERE question_id IN (SELECT question_id FROM ({_COHORT})) GROUP BY mode), a AS (SELECT mode, {_select()} FROM c GROUP BY mode) SELECT * EXCLUDE (m) FROM a LEFT JOIN r ON a.mode = r.m")
def ev_mode_summary(spark, sf_dir):
    return evaluate.mode_summary(contributions(spark, sf_dir))


@query(
    f"WITH {_ROWS}, r AS (SELECT mode AS m, question_type AS q, {_select('relative_', ('samples', 'intent_preservation', 'execution_success'))} FROM c WHERE (question_type, question_id) IN (SELECT (question_type, question_id) FROM ({_COHORT})) GROUP BY 1, 2), a AS (SELECT mode, question_type, {_select()} FROM c GROUP BY 1, 2) SELECT * EXCLUDE (m, q) FROM a LEFT JOIN r ON a.mode = r.m AND a.question_type = r.q"
)
def ev_type_breakdown(spark, sf_dir):
    return evaluate.type_breakdown(contributions(spark, sf_dir))


@query(
    f"WITH {_ROWS} SELECT mode, question_type, count(*) AS samples, round(avg(pv / pt::DOUBLE), 6) AS policy_violation, round(avg(coalesce(dv::DOUBLE / nullif(dt, 0), 0)), 6) AS direct_disclosure, round(sum(es)::DOUBLE / count(*), 6) AS execution_success, round(sum(sy)::DOUBLE / count(*), 6) AS syntactic_correctness FROM c GROUP BY 1, 2"
)
def ev_type_breakdown_v1(spark, sf_dir):
    return evaluate.type_breakdown_v1(contributions(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT k AS sample_id FROM c WHERE mode = 'base_realign' AND pv > 0")
def ev_failures(spark, sf_dir):
    return evaluate.failures(contributions(spark, sf_dir)).select("sample_id")


@query(
    f"WITH {_ROWS}, good AS (SELECT DISTINCT question_id FROM c WHERE mode = 'base_none' AND it >= 1 AND sy = 1), r AS (SELECT mode AS m, {_select('relative_')} FROM c WHERE question_id IN (FROM good) GROUP BY mode), a AS (SELECT CASE mode WHEN 'base_none' THEN 'base' ELSE mode END AS mode, mode AS n, {_select()} FROM c GROUP BY ALL) SELECT * EXCLUDE (m, n), (SELECT count(*) FROM good) AS relative_questions FROM a LEFT JOIN r ON a.n = r.m"
)
def ev_mode_summary_v1(spark, sf_dir):
    rows = contributions(spark, sf_dir)
    return evaluate.mode_summary_v1(rows.withColumn("mode", F.when(F.col("mode") == "base_none", "base").otherwise(F.col("mode"))))


@query(f"WITH {_ROWS} SELECT row_number() OVER (ORDER BY CASE mode WHEN 'base_none' THEN 1 WHEN 'base_realign' THEN 3 ELSE 7 END) AS place, mode FROM (SELECT DISTINCT mode FROM c)")
def ev_modes_in_order(spark, sf_dir):
    """Modes as the summary lists them: by method, then layer."""
    found = [r["mode"] for r in evaluate.ordered_modes(evaluate.mode_summary(contributions(spark, sf_dir))).select("mode").collect()]  # nine at most
    return spark.createDataFrame(list(enumerate(found, 1)), "place long, mode string")


@query("SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS db_id, 'Staff' AS role FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def ev_chosen(spark, sf_dir):
    """A slice of the questions of one database and role."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("question_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("db_id"), F.lit("Staff").alias("role"))
    return evaluate.chosen(rows, ["a"], ["staff"], 10, 30)


@query("SELECT l_orderkey AS question_id, 'm' || (l_linenumber % 2) AS mode, l_linenumber AS policy_viol_count, (l_linenumber > 0)::INT AS policy_viol_binary_count, CASE WHEN l_linenumber % 3 > 0 THEN (l_returnflag = 'R')::INT ELSE 0 END AS exec_success, (l_linenumber % 3 > 0)::INT AS exec_total, l_discount AS expected_query_match_sum, 1.0::DOUBLE AS expected_query_match_total, l_tax AS intent_sum, 0 AS prompt_char_size_sum, 1 AS syntax_total FROM lineitem")
def ev_contributions(spark, sf_dir):
    """Contributions of stored rows that have the older fields only, and some of none."""
    c, n = F.col, F.col("l_linenumber")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        c("l_orderkey").alias("question_id"), F.concat(F.lit("m"), n % 2).alias("access_control_mode"), n.cast("string").alias("policy_violation_count"), F.when(c("l_returnflag") == "R", "Yes").otherwise("no").alias("execution_success"),
        (n % 3 > 0).alias("execution_scored"), c("l_discount").alias("minimal_distortion_match_count"), F.lit(True).alias("minimal_distortion_scored"), c("l_tax").alias("intent_preservation_match_count"), F.lit(9).alias("prompt_char_size"),
    )
    names = ("policy_viol_count", "policy_viol_binary_count", "exec_success", "exec_total", "expected_query_match_sum", "expected_query_match_total", "intent_sum", "prompt_char_size_sum", "syntax_total")
    return evaluate.contributions(rows).select("question_id", "mode", *names)


_OLD = [
    ("o1", "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation", True, ["nation.n_name"], ["nation.n_regionkey"], True),
    ("o2", "SELECT n_name, n_nationkey FROM nation", "SELECT n_name FROM nation", None, True, ["nation.n_name"], [], False),
    ("o3", "Sorry, no", "SELECT n_name FROM nation", "SELECT n_name FROM nation", True, ["nation.n_name"], [], None),
    ("o4", "SELECT n_name FROM nation", None, "SELECT n_name FROM nation", False, [], [], True),
]
_OLD_COLUMNS = "sample_id string, generated string, expected string, base string, usable boolean, expected_projection array<string>, expected_process array<string>, executes boolean"


@query(values([("o1", 0, 2, 0, 1, 1, 1, 1, 1), ("o2", 1, 1, 1, 1, 0, 1, 0, 0), ("o3", 0, 1, 0, 1, 0, 0, 0, 1), ("o4", 1, 0, 1, 0, 0, 1, 1, 1)], "sample_id, policy_violation_count, policy_total_columns, direct_disclosure_count, direct_total_columns, answer_agreement, syntactic_correct, execution_success, intent_preservation_scored"))
def ev_evaluate_v1(spark, sf_dir):
    found = evaluate.evaluate_v1(spark.createDataFrame(_OLD, _OLD_COLUMNS))
    return found.select("sample_id", *[F.col(c).cast("int").alias(c) for c in ("policy_violation_count", "policy_total_columns", "direct_disclosure_count", "direct_total_columns", "answer_agreement", "syntactic_correct", "execution_success", "intent_preservation_scored")])


@query("SELECT 4 AS samples, 0.5 AS policy_violation_rate, 0.666667 AS direct_disclosure_rate, 0.333333 AS answer_agreement, 0.5 AS execution_success_rate, 0.75 AS syntactic_correctness_rate")
def ev_summary_v1(spark, sf_dir):
    found = evaluate.summary_v1(evaluate.evaluate_v1(spark.createDataFrame(_OLD, _OLD_COLUMNS)))
    return found.select(F.col("samples").cast("int").alias("samples"), "policy_violation_rate", "direct_disclosure_rate", "answer_agreement", "execution_success_rate", "syntactic_correctness_rate")


_RUN = [("x1", "SELECT n_name FROM nation", True), ("x2", "```sql\nSELECT no_such FROM nation\n```", False), ("x3", "I cannot", False), ("x4", "SELECT COUNT(*) FROM region", True), ("x5", "SELECT * FROM nowhere", False), ("x6", "DROP VIEW nation", False)]


@query(values([(a, c) for a, _, c in _RUN], "sample_id, executes"))
def ev_execution(spark, sf_dir):
    """Whether generated queries run over the tables, under a time limit."""
    e = engine(spark, sf_dir)
    return evaluate.with_execution(spark.createDataFrame([x[:2] for x in _RUN], "sample_id string, generated string"), e.runs).select("sample_id", "executes")


@query(values([("Candidate 0", True), ("Candidate 1", False), ("Candidate 2", False), ("| n_name |", True)], "part, shown"))
def ev_previews(spark, sf_dir):
    """First rows of the candidates that a role may run."""
    text = engine(spark, sf_dir).previews(["SELECT n_name FROM nation ORDER BY n_name LIMIT 1", "SELECT c_name FROM customer", "SELECT nothing FROM nation"], "staff")
    return spark.createDataFrame([(p, p in text) for p in ("Candidate 0", "Candidate 1", "Candidate 2", "| n_name |")], "part string, shown boolean")


@query("SELECT sample_id, 'd' AS db_id, '' AS generated_query FROM (SELECT 'd::t::where::' || r_name AS sample_id FROM region)")
def ev_template(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("d::t::where::"), "r_name").alias("sample_id"), F.lit("d").alias("db_id"), F.lit("t").alias("template_id"), F.lit("where").alias("mode"), F.col("r_name").alias("role"))
    return evaluate.prediction_template(rows).select("sample_id", "db_id", "generated_query")


@query(f"WITH {_ROWS} SELECT 'breakdown' AS part, count(*) AS n FROM (SELECT DISTINCT mode, question_type FROM c) UNION ALL SELECT 'eval', count(*) FROM c UNION ALL SELECT 'failures', count(*) FROM c WHERE mode = 'base_realign' AND pv > 0 UNION ALL SELECT 'meta', 1 UNION ALL SELECT 'pending', 0 UNION ALL SELECT 'raw', count(*) FROM c UNION ALL SELECT 'summary', count(DISTINCT mode) FROM c")
def snk_run(spark, sf_dir):
    """What a run leaves behind; writing it twice changes nothing."""
    rows, path = contributions(spark, sf_dir), scratch(spark, "run")
    for _ in range(2):
        io.persist_run(rows, rows.select("sample_id", "mode"), path, "one", {"note": "test"})
    counts = [(n, spark.read.parquet(f"{path}/{n}").count()) for n in ("breakdown", "eval", "failures", "meta", "raw", "summary")]
    counts.append(("pending", io.pending(rows, io.finished(spark, path)).count()))
    return spark.createDataFrame(counts, "part string, n long")


@query(values([("easy", "EASY", "SELECT 2"), ("hard", "NESTED", "SELECT 1")], "question, label, sql"))
def ret_stepwise(spark, sf_dir):
    """Steps of a generator that links, classifies, writes and corrects."""
    said = {"link": "Schema_links: [a.b]", "easy": "SQL: SELECT 1", "hard": "SQL: SELECT 1"}

    def generate_(step, question, context):
        if step == "classify":
            return 'Label: "EASY"' if question == "easy" else 'Label: "NESTED"\nsub_questions: [x?]'
        return ("Revised_SQL: SELECT 2" if question == "easy" else "") if step == "correct" else said[step]

    found = [(q, retrieve.stepwise(q, "# t", generate_)) for q in ("easy", "hard")]
    return spark.createDataFrame([(q, r["label"], r["sql"]) for q, r in found], "question string, label string, sql string")


@query(values([("clipped", 10000, "query clipped to 10000 characters"), ("fails", 0, "broken"), ("long", 9, "retried with a short prompt: context overflow"), ("plain", 8, None)], "attempt, length, error"))
def ret_retries(spark, sf_dir):
    """A generator whose context is too long is asked once more with less."""
    def long_(parts):
        if len(parts["schema"]) > 7000:
            raise ValueError("context overflow")
        return "SELECT 10"

    def fails(parts):
        raise ValueError("broken")

    attempts = {"plain": lambda parts: "SELECT 1", "clipped": lambda parts: "x" * 20_000, "long": long_, "fails": fails}
    found = [(n, retrieve.with_retry(f, {"schema": "s" * 9000, "question": "q"})) for n, f in attempts.items()]
    return spark.createDataFrame([(n, len(r["sql"]), r["error"]) for n, r in found], "attempt string, length int, error string")


_TEXTS = [
    ("Here:\n```sql\nSELECT a FROM t;\n```\nDone", "SELECT a FROM t", False), ("select x from y", "select x from y", False), ("I cannot answer that.", "", True), ("", "", True), ("The query is WITH a AS (SELECT 1) SELECT * FROM a;", "WITH a AS (SELECT 1) SELECT * FROM a", False), ("no query at all", "", True),
]


@query(values([(i, s, d) for i, (_, s, d) in enumerate(_TEXTS)], "id, sql, denial"))
def ev_extract_sql(spark, sf_dir):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(_TEXTS)], "id int, text string")
    return df.select("id", evaluate.extract_sql(F.col("text")).alias("sql"), evaluate.is_denial(F.col("text")).alias("denial"))


_USAGE = [
    ("SELECT c.a, SUM(c.b) FROM cust c JOIN ords o ON c.k = o.k WHERE o.d > 1 GROUP BY c.a ORDER BY c.e", "cust.a", "cust.a,cust.b,cust.e,ords.d", "cust", "cust,ords"),
    ("SELECT * FROM t JOIN u ON t.x = u.x", "", "", "t,u", ""),
    ("SELECT x FROM t WHERE y = 1", "t.x", "t.y", "t", "t"),
    ("not sql", "", "", "", ""),
]


@query(values([(i, *u[1:], i < 3) for i, u in enumerate(_USAGE)], "id, projection_columns, process_columns, projection_tables, process_tables, ok"))
def ev_usage(spark, sf_dir):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(_USAGE)], "id int, sql string").withColumn("u", evaluate.usage_of("sql"))
    return df.select("id", *[F.array_join(F.col("u." + c), ",").alias(c) for c in ("projection_columns", "process_columns", "projection_tables", "process_tables")], F.col("u.ok").alias("ok"))


_LIKE = [("SELECT a FROM t", "select T.a from t", 1.0, False), ("SELECT a FROM t", "SELECT b FROM t", 0.9, False), ("SELECT a FROM t", "nonsense", 0.0, False), ("SELECT x.a AS q FROM t x", "SELECT a AS r FROM t", 1.0, False)]


@query(values([(i, s, e) for i, (_, _, s, e) in enumerate(_LIKE)], "id, similarity, same"))
def ev_similarity(spark, sf_dir):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(_LIKE)], "id int, a string, b string")
    return df.select("id", F.round(evaluate.similarity_of("a", "b"), 6).alias("similarity"), evaluate.same_query("a", "b").alias("same"))


_SAMPLES = [
    ("s1", "q1", True, "SELECT n_name FROM nation", "SELECT n_name FROM nation", ["nation.n_name"], ["nation.n_nationkey"], True, 100),
    ("s2", "q2", True, "SELECT c_name FROM customer WHERE c_acctbal > 1", "SELECT c_custkey FROM customer", ["customer.c_custkey"], ["customer.c_custkey"], False, 50),
    ("s3", "q3", True, "I cannot do that", "SELECT 1", ["t.a"], [], None, None),
    ("s4", "q4", False, "SELECT FROM", None, ["t.a"], ["t.a"], None, 10),
]


@query(
    values([("s1", 0, 4, 0, 1, 1, 1, 1, 1.0, 1.0), ("s2", 2, 4, 1, 0, 0, 1, 1, None, None), ("s3", 0, 2, 0, 0, 0, 0, 0, 0.0, 0.0), ("s4", 0, 4, 0, 0, 0, 0, 0, 0.0, 0.0)], "sample_id, policy_viol_count, policy_total_cols, direct_viol_count, answer_match, exec_success, syntax_success, answer_total, m, i").replace(
        "SELECT *", "SELECT sample_id, policy_viol_count, policy_total_cols, direct_viol_count, answer_match, exec_success, syntax_success"
    )
)
def ev_evaluate(spark, sf_dir):
    schema = "sample_id string, question_id string, usable boolean, generated string, expected string, allowed_view array<string>, allowed_process array<string>, executes boolean, prompt_chars long"
    samples = spark.createDataFrame(_SAMPLES, schema).withColumn("base", F.col("expected")).withColumn("mode", F.lit("base_none")).withColumn("question_type", F.lit("view_only"))
    found = evaluate.evaluate(samples)
    return found.select("sample_id", *[F.col(c).cast("int").alias(c) for c in ("policy_viol_count", "policy_total_cols", "direct_viol_count", "answer_match", "exec_success", "syntax_success")])


@query(values([(len(WORKLOAD), 1.0, 1.0)], "samples, answer_agreement, expected_query_match"))
def ev_self_consistency(spark, sf_dir):
    """Expected queries taken as generated ones must score perfectly."""
    rows = [(k, k, sql) for k, (_, sql, _) in WORKLOAD.items()]
    s = spark.createDataFrame(rows, "sample_id string, question_id string, generated string")
    s = s.select("*", F.col("generated").alias("expected"), F.col("generated").alias("base"), F.lit("base_none").alias("mode"), F.lit("x").alias("question_type"), F.lit(True).alias("usable"), F.array(F.lit("a.b")).alias("allowed_view"), F.array(F.lit("a.b")).alias("allowed_process"), F.lit(True).alias("executes"), F.lit(1).cast("long").alias("prompt_chars"))
    return evaluate.group_metrics(evaluate.evaluate(s)).select(F.col("samples").cast("int").alias("samples"), "answer_agreement", "expected_query_match")


_KINDS = [("View and Filter", "view_and_filter"), ("qa_filter_only", "filter_only"), (" VIEW ", "view_only"), (None, "unknown"), ("Other", "other")]


@query(values([(i, b) for i, (_, b) in enumerate(_KINDS)], "id, kind"))
def ev_question_type(spark, sf_dir):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_KINDS)], "id int, t string")
    return df.select("id", evaluate.question_type(F.col("t")).alias("kind"))


@query(values([("12", 12, 0), ("3.7", 3, 0), ("x", 0, 0), ("true", 0, 1), (None, 0, 0), ("1", 1, 1)], "v, i, b"))
def ev_safe_numbers(spark, sf_dir):
    df = spark.createDataFrame([("12",), ("3.7",), ("x",), ("true",), (None,), ("1",)], "v string")
    return df.select("v", evaluate.safe_int(F.col("v")).cast("int").alias("i"), evaluate.safe_binary(F.col("v")).alias("b"))


_KEYS = "sample_id string, db_id string, template_id string, mode string, role string, row_index int"


@query(values([("d::t1::where::r", "by id", "sample_id"), ("d::t2::where::r", "last", "composite"), ("d::t3::where::r", "by row", "index"), ("d::t4::where::r", None, None)], "sample_id, predicted, found_by"))
def ev_predictions(spark, sf_dir):
    samples = spark.createDataFrame([(f"d::t{i}::where::r", "d", f"t{i}", "where", "r", i) for i in range(1, 5)], _KEYS)
    rows = [("d::t1::where::r", None, None, None, None, None, 0, "by id"), (None, "d", "t1", "where", "r", None, 1, "ignored"), (None, "d", "t2", "where", "r", None, 2, "first"), (None, "d", "t2", "where", "r", None, 3, "last"), (None, None, None, None, None, 3, 4, "by row")]
    return evaluate.resolve_predictions(samples, spark.createDataFrame(rows, _KEYS + ", position int, query string"))


@query(values([("d::t::where::a", "Q1", True), ("d::t::where::b", None, False)], "sample_id, expected_query, is_usable"))
def ev_flatten(spark, sf_dir):
    schema = "db_id string, template_id string, mode string, base_query string, role_expected map<string,struct<expected_query:string,is_usable:boolean>>"
    records = spark.createDataFrame([("d", "t", "where", "B", {"a": ("Q1", True), "b": (None, False)})], schema)
    return evaluate.flatten(records).select("sample_id", "expected_query", "is_usable")


#: Written out: what is counted in each statement.
_PATTERNS = {"where": r"\bWHERE\b", "join": r"\bJOIN\b", "group by": r"\bGROUP BY\b", "order by": r"\bORDER BY\b", "having": r"\bHAVING\b", "limit": r"\bLIMIT\b", "union": r"\bUNION\b", "intersect": r"\bINTERSECT\b", "except": r"\bEXCEPT\b", "subquery": r"\(SELECT"}
_CORPUS = [(i, sql) for i, (_, sql, _) in enumerate(WORKLOAD.values())]
_COUNTED = " UNION ALL ".join(f"SELECT 'SELECT' AS statement, '{n}' AS clause, sum(len(regexp_extract_all(upper(sql), '{p}'))) AS matches, count(*) AS statements FROM w WHERE upper(sql) LIKE 'SELECT%'" for n, p in _PATTERNS.items())


@query(f"WITH w AS ({values(_CORPUS, 'id, sql')}), x AS ({_COUNTED}) SELECT statement, clause, matches::BIGINT AS matches, statements, round(100.0 * matches::DOUBLE / statements, 4) AS percentage FROM x")
def ev_corpus_profile(spark, sf_dir):
    return evaluate.corpus_profile(spark.createDataFrame(_CORPUS, "id int, sql string"))
