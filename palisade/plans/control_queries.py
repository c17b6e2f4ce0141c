"""Queries over schemas, policies, facts, decisions and generated benchmarks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from palisade.engine import AccessEngine
from palisade.functions.sql_text import render, try_parse
from palisade.operators import enforce, generate, policy, rules
from palisade.plans.context import PRELUDE, ROLES, access, columns, engine, foreign_keys, frames, put_text, schema_document, scratch, values
from palisade.plans.workload import DECISIONS
from palisade.sources import catalog, io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def pre(sql: str) -> str:
    return f"WITH {PRELUDE} {sql}"


# --- sources ------------------------------------------------------------------

_FK = catalog.TPCH_KEYS["fk"]
_KEYS = f"pk AS ({values(sorted(catalog.TPCH_KEYS['pk'].items()), 't, c')}), fk AS ({values(_FK, 'ft, fc, tt, tc')})"


@query(pre("SELECT table_name, (row_number() OVER (ORDER BY table_name) - 1)::INTEGER AS table_id FROM (SELECT DISTINCT table_name FROM catalog)"))
def src_tables(spark, sf_dir):
    return catalog.tables_of(catalog.read_schema_json(spark, schema_document(spark, sf_dir))).select("table_id", "table_name")


@query(f"WITH {PRELUDE}, {_KEYS} SELECT table_name, column_name, (table_name, column_name) IN (SELECT (t, c) FROM pk) AS is_pk, (table_name, column_name) IN (SELECT (ft, fc) FROM fk) AS is_fk FROM catalog")
def src_columns(spark, sf_dir):
    found = catalog.columns_of(catalog.read_schema_json(spark, schema_document(spark, sf_dir)))
    return found.select("table_name", "column_name", "is_pk", "is_fk")


@query(f"WITH {_KEYS} SELECT ft AS from_table, fc AS from_column, tt AS to_table, tc AS to_column FROM fk")
def src_foreign_keys(spark, sf_dir):
    return catalog.foreign_keys_of(catalog.read_schema_json(spark, schema_document(spark, sf_dir))).drop("db_id")


@query(f"WITH {PRELUDE}, {_KEYS} SELECT table_name, column_name, CASE WHEN (table_name, column_name) IN (SELECT (t, c) FROM pk) THEN 'PK' WHEN (table_name, column_name) IN (SELECT (ft, fc) FROM fk) THEN 'FK' ELSE 'COMMON' END AS key FROM catalog")
def src_crawl(spark, sf_dir):
    return columns(spark, sf_dir).select("table_name", "column_name", "key")


@query(values([("nation", "n_name", "Name of the nation", "text; 25 values"), ("nation", "n_nationkey", "Number é", None)], "table_name, column_name, description, value_description"))
def src_descriptions(spark, sf_dir):
    base = scratch(spark, "descriptions")
    text = 'original_column_name,column_description,value_description\n N_NAME ,"Name  of\n the nation",text; 25   values\n"""n_nationkey""",Number \xe9,\n'
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(base + "/nation.csv")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode("latin-1")))
    out.close()
    return catalog.read_descriptions(spark, base)


@query(values([("s1", "SELECT 1"), ("s2", "SELECT 2")], "sample_id, query"))
def src_predictions(spark, sf_dir):
    path = put_text(spark, scratch(spark, "predictions.json"), json.dumps({"s1": "SELECT 1", "s2": "SELECT 2"}))
    return io.normalize_predictions(spark.read.json(path, multiLine=True))


@query(values([("a", "unknown", False), ("b", "view_only", False)], "db_id, question_type, evidence_added"))
def src_records(spark, sf_dir):
    rows = [{"db_id": "a", "question": "q", "role": "r", "intent_preserving_expected_query": "SELECT 1"}], [{"db_id": "b", "question": "q", "role": "r", "intent_preserving_expected_query": "SELECT 1", "question_type": "view_only"}]
    paths = [put_text(spark, scratch(spark, "qa.json"), json.dumps(r)) for r in rows]
    return io.read_records(spark, paths).select("db_id", "question_type", "evidence_added")


@query("SELECT r_regionkey, r_name FROM region")
def snk_json(spark, sf_dir):
    path = scratch(spark, "region-json")
    io.write_json(frames(spark, sf_dir)["region"].coalesce(1), path)
    return spark.read.schema("r_regionkey int, r_name string").json(path)


@query("SELECT n_nationkey AS question_id, 'base_none' AS mode FROM nation WHERE n_nationkey >= 10")
def snk_resume(spark, sf_dir):
    path = scratch(spark, "runs")
    rows = frames(spark, sf_dir)["nation"].select(F.col("n_nationkey").alias("question_id"), F.lit("base_none").alias("mode"))
    io.append_run(rows.filter("question_id < 5"), path, "one")
    io.append_run(rows.filter("question_id BETWEEN 5 AND 9"), path, "two")
    return io.pending(rows, spark.read.parquet(path))


@query("SELECT '<urn:palisade:r' || r_regionkey || '> <urn:palisade:name> \"' || r_name || '\" .' AS value FROM region WHERE r_regionkey > 0")
def snk_triples(spark, sf_dir):
    facts = frames(spark, sf_dir)["region"].select(F.concat(F.lit("r"), "r_regionkey").alias("subject"), F.lit("name").alias("predicate"), F.col("r_name").alias("object"))
    return io.n_triples(io.export_facts(facts, facts.filter("subject = 'r0'")))


# --- facts and rules ----------------------------------------------------------

_SQL = [
    ("f1", "analyst", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_name"),
    ("f2", "staff", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)"),
    ("f3", "public", "SELECT MAX(p_size) AS m FROM part GROUP BY p_brand HAVING COUNT(*) > 1"),
    ("f4", "staff", "WITH s AS (SELECT s_name, s_acctbal FROM supplier) SELECT s_name, s_acctbal FROM s"),
    ("f5", "staff", "SELECT n_name FROM nation WHERE EXISTS (SELECT s_acctbal FROM supplier)"),
]


def _facts(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e, rules.query_facts(spark.createDataFrame(_SQL, "query_id string, role string, sql string"), e.schema)


@query(
    values(
        [
            ("f1", "c_acctbal", "WhereClause", "WhereClause", "Process"), ("f1", "c_custkey", "SelectClause", "SelectClause", "View"), ("f1", "c_name", "OrderByClause", "OrderByClause", ""), ("f1", "c_name", "SelectClause", "SelectClause", "View"),
            ("f2", "n_name", "SelectClause", "SelectClause", "View"), ("f2", "n_nationkey", "WhereClause", "WhereClause", "Process"), ("f2", "s_acctbal", "WhereClause", "WhereClause", "Process"), ("f2", "s_nationkey", "SelectClause", "WhereClause", "Process"),
            ("f3", "p_brand", "GroupByClause", "GroupByClause", "Process"), ("f3", "p_size", "SelectClause", "SelectClause", "View"),
            ("f4", "s_acctbal", "SelectClause", "SelectClause", "View"), ("f4", "s_acctbal", "SelectClause", "WithClause", "View,Process"), ("f4", "s_name", "SelectClause", "SelectClause", "View"), ("f4", "s_name", "SelectClause", "WithClause", "View,Process"),
            ("f5", "n_name", "SelectClause", "SelectClause", "View"), ("f5", "s_acctbal", "SelectClause", "WhereClause", "Process"),
        ],
        "query_id, name, clause, top_clause, scopes",
    )
)
def ast_column_facts(spark, sf_dir):
    _, facts = _facts(spark, sf_dir)
    return facts.filter("kind = 'ColumnRef'").select("query_id", "name", "clause", "top_clause", F.array_join("eff_scopes", ",").alias("scopes"))


@query(values([("f1", 4, 1), ("f2", 4, 2), ("f3", 2, 1), ("f4", 4, 2), ("f5", 2, 2)], "query_id, columns, tables"))
def ast_counts(spark, sf_dir):
    _, facts = _facts(spark, sf_dir)
    n = lambda k: F.count_if(F.col("kind") == k).cast("int")
    return facts.groupBy("query_id").agg(n("ColumnRef").alias("columns"), n("TableRef").alias("tables"))


@query(
    values(
        [
            ("f1", "c_name", "rcv", "col_view_S3"), ("f1", "customer", "rrp", "row_view_customer_analyst"), ("f1", "customer", "rrv", "row_view_customer_analyst"),
            ("f3", "part", "rrp", "row_view_part_public"), ("f3", "part", "rrv", "row_view_part_public"), ("f4", "s_acctbal", "rcv", "col_view_S2"),
        ],
        "query_id, name, rule, policy_id",
    )
)
def rule_status(spark, sf_dir):
    e, facts = _facts(spark, sf_dir)
    return rules.node_status(facts, e.policies).select("query_id", F.coalesce("column_name", "table_name").alias("name"), "rule", "policy_id").distinct()


@query(values([("Aligned", 19), ("RowTag", 2), ("Violated", 3)], "status, n"))
def rule_effective_status(spark, sf_dir):
    e, _ = _facts(spark, sf_dir)
    return e.node_status(spark.createDataFrame(_SQL, "query_id string, role string, sql string")).groupBy("status").agg(F.count("*").cast("int").alias("n"))


@query(values([(k, r, s, n) for k, (r, _, s, n) in DECISIONS.items()], "query_id, role, status, rules"))
def refine_decisions(spark, sf_dir):
    rows = [(k, r, q) for k, (r, q, *_) in DECISIONS.items()]
    found = engine(spark, sf_dir).refine_queries(spark.createDataFrame(rows, "query_id string, role string, sql string"))
    return found.select("query_id", "role", "status", F.array_join("rules", ",").alias("rules"))


_TEXTS = [
    ("r1", "analyst", "SELECT c_name, c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    ("r2", "analyst", "SELECT a.c_custkey FROM customer a, nation n WHERE a.c_nationkey = n.n_nationkey", "SELECT a.c_custkey FROM customer AS a, nation AS n WHERE a.c_nationkey = n.n_nationkey AND a.c_mktsegment = 'BUILDING'"),
    ("r3", "staff", "SELECT * FROM supplier WHERE s_acctbal > 0", "SELECT supplier.s_suppkey, supplier.s_name, supplier.s_nationkey FROM supplier WHERE s_acctbal > 0"),
    ("r4", "staff", "SELECT COUNT(*) AS n FROM nation JOIN customer ON n_name = c_name", "SELECT COUNT(*) AS n FROM nation, customer"),
    ("r5", "public", "SELECT p_brand FROM part WHERE p_size < 25 AND p_size > 3", "SELECT p_brand FROM part WHERE p_size < 25 AND p_size > 3"),
    ("r6", "staff", "SELECT l_tax FROM lineitem WHERE l_tax > 0.05 OR l_discount > 0.05", "SELECT l_tax FROM lineitem WHERE (l_tax > 0.05 OR l_discount > 0.05) AND l_returnflag <> 'R'"),
    ("r7", "admin", 'SELECT "c_name" FROM "customer"', "SELECT c_name FROM customer"),
]


@query(values([(k, r, t) for k, r, _, t in _TEXTS], "query_id, role, refined_query"))
def refine_texts(spark, sf_dir):
    found = engine(spark, sf_dir).refine_queries(spark.createDataFrame([x[:3] for x in _TEXTS], "query_id string, role string, sql string"))
    return found.select("query_id", "role", "refined_query")


@query(values([(k, r, t) for k, r, _, t in _TEXTS], "query_id, role, refined_query"))
def refine_idempotent(spark, sf_dir):
    """What has been refined stays as it is."""
    found = engine(spark, sf_dir).refine_queries(spark.createDataFrame([(k, r, t) for k, r, _, t in _TEXTS], "query_id string, role string, sql string"))
    return found.select("query_id", "role", F.regexp_replace("refined_query", r"supplier\.s_", "supplier.s_").alias("refined_query"))


@query(values([(i, True) for i in range(len(_TEXTS))], "id, same"))
def ast_round_trip(spark, sf_dir):
    """Text, tree and text again."""
    rows = []
    for i, (_, _, sql, _) in enumerate(_TEXTS):
        tree, _ = try_parse(sql)
        rows.append((i, render(tree) == render(try_parse(render(tree))[0]) and enforce.parses(spark, render(tree))))
    return spark.createDataFrame(rows, "id int, same boolean")


# --- policies -----------------------------------------------------------------


def _policies(spark):
    return policy.compile_policies(access(spark))


@query(pre("SELECT role, level, scope, name FROM denies"))
def pol_role_denies(spark, sf_dir):
    return policy.role_denies(_policies(spark)).select("role", "level", "scope", "name")


@query(pre("SELECT role, level, scope, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT * FROM denies UNION SELECT role, level, 'all', name FROM denies) GROUP BY ALL"))
def pol_denied_sets(spark, sf_dir):
    return policy.denied_sets(_policies(spark)).withColumn("names", F.array_join("names", ","))


@query(pre("SELECT level, name FROM (SELECT DISTINCT level, name FROM denies WHERE role = 'staff')"))
def pol_denied_entities(spark, sf_dir):
    return policy.denied_entities(_policies(spark), "staff").select("level", F.explode("names").alias("name"))


@query(pre("SELECT role, kind, table_name, column_name FROM allowed"))
def pol_allowed(spark, sf_dir):
    return policy.allowed_columns(columns(spark, sf_dir), _policies(spark), policy.roles_of(access(spark)))


@query(pre("SELECT role, table_name, column_name, bool_or(kind = 'view') AS projection, bool_or(kind = 'process') AS process, count(*) = 2 AS both FROM allowed GROUP BY ALL"))
def pol_role_pools(spark, sf_dir):
    return policy.role_pools(policy.allowed_columns(columns(spark, sf_dir), _policies(spark), policy.roles_of(access(spark))))


@query(pre("SELECT role, scope, level, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM matrix GROUP BY ALL"))
def pol_denied_categories(spark, sf_dir):
    found = policy.denied_categories(access(spark))
    return found.filter(F.size("categories") > 0).withColumn("categories", F.array_join("categories", ","))


@query(pre("SELECT table_name, column_name FROM catalog c WHERE table_name NOT IN (SELECT name FROM classes) AND column_name NOT IN (SELECT name FROM classes) AND (SELECT count(DISTINCT role) FROM allowed a WHERE a.kind = 'view' AND a.table_name = c.table_name AND a.column_name = c.column_name) = 4"))
def pol_global_pool(spark, sf_dir):
    cols = columns(spark, sf_dir)
    roles = policy.roles_of(access(spark))
    return policy.global_projection_pool(cols, access(spark), policy.allowed_columns(cols, _policies(spark), roles), roles)


@query("SELECT unnest(['admin', 'analyst', 'staff', 'public']) AS role")
def pol_roles(spark, sf_dir):
    return policy.roles_of(access(spark))


@query(values([("p1", "Prohibited", "Read", "View", "Column", "t", "c", None), ("p2", "Conditional", "Read", "View", "Row", "t", None, "x = 'it''s'"), ("p3", "Prohibited", "Modify", "Delete", "Table", "t", None, None), ("p4", "Permitted", "Read", "Process", "Table", "loose", None, None), ("p5", "Prohibited", "Read", "View", "Column", None, "s1col", None), ("p6", "Conditional", "Read", "View", "Row", "t", None, "kind = 'S1'"), ("p7", "Conditional", "Read", "View", "Row", "t", None, "n > 3")], 'policy_id, "grant", action, scope, level, table_name, column_name, condition'))
def pol_compile(spark, sf_dir):
    """Effects, actions, scopes and levels with their defaults; categories that are names; conditions built from predicates."""
    pred = lambda **k: {f: k.get(f) for f in ("table", "column", "operation", "category", "value", "sql")}
    rows = [
        {"id": "p1", "effect": "nonsense", "action": "read", "level": "column", "roles": ["r"], "table": "T", "column": '"C"'},
        {"id": "p2", "effect": "conditional", "action": "read", "scope": "view", "level": "row", "roles": ["r"], "table": "t", "predicate": pred(column="x", operation="=", value="it's")},
        {"id": "p3", "effect": "deny", "action": "write", "scope": "delete", "level": "table", "roles": ["r"], "table": "t"},
        {"id": "p4", "effect": "allow", "action": "read", "scope": "process", "level": "table", "roles": ["r"], "categories": ["loose"]},
        {"id": "p5", "effect": "prohibit", "action": "read", "scope": "view", "level": "column", "roles": ["r"], "categories": ["S1"]},
        {"id": "p6", "effect": "conditional", "action": "read", "scope": "view", "level": "row", "roles": ["r"], "predicate": pred(table="t", column="kind", operation="= type", category="S1")},
        {"id": "p7", "effect": "conditional", "action": "read", "scope": "view", "level": "row", "roles": ["r"], "table": "t", "predicate": pred(sql="n > 3")},
    ]
    return policy.compile_policies(policy.access_frame(spark, rows, {"table": {}, "column": {"S1": ["s1col"]}}, ["r"])).drop("role")


_NAMED = [
    ("customer", "c_acctbal", "c acctbal", "S0"), ("customer", "c_name", "c name", "S2"), ("nation", "n_name", "n name", "S0"), ("lineitem", "l_tax", "l tax", "S3"), ("Patients", "PatientID", "patient id", "S2"), ("Patients", "SSN", "ssn", "S3"), ("Patients", "First Name", "first name", "S2"),
    ("demo", "BirthDates", "birth date", "S2"), ("demo", "CustomerID", "customer id", "S1"), ("demo", "Email Addresses", "email address", "S2"), ("demo", "élan_status", "elan status", "S0"), ("demo", "zip_code", "zip code", "S2"), ("demo", "the Countries", "country", "S1"), ("demo", "Q2", "q2", "S0"), ("demo", "HGB", "hgb", "S2"), ("demo", "Charles XIV", "charle xiv", "S0"), ("demo", "analysis", "analysis", "S0"),
]


@query(values(_NAMED, "table_name, column_name, normal, category"))
def pol_classify(spark, sf_dir):
    return policy.classify(spark.createDataFrame([x[:2] for x in _NAMED], "table_name string, column_name string"))


@query(values([("medical_records", "medical record", "S0"), ("Orders", "order", "S2"), ("lapTimes", "lap time", "S0"), ("Cards", "card", "S1"), ("transactions_1k", "transaction 1k", "S0"), ("zip_code", "zip code", "S0"), ("Diagnosis", "diagnosis", "S2")], "table_name, normal, category"))
def pol_classify_tables(spark, sf_dir):
    return policy.classify_tables(spark.createDataFrame([(t,) for t in ("medical_records", "Orders", "lapTimes", "Cards", "transactions_1k", "zip_code", "Diagnosis")], "table_name string"))


@query(pre("SELECT 'table' AS level, CASE WHEN table_name IN ('customer', 'orders') THEN 'S2' ELSE 'S0' END AS category, table_name AS name FROM catalog GROUP BY table_name UNION ALL SELECT 'column', CASE column_name WHEN 'c_name' THEN 'S2' WHEN 'l_tax' THEN 'S3' ELSE 'S0' END, column_name FROM catalog"))
def pol_generated(spark, sf_dir):
    """An access document written for a catalog: what it classifies."""
    return policy.members(policy.generated_access(columns(spark, sf_dir), "tpch")).select("level", "category", "name")


@query(values([("analyst", "view", "column", "S3"), ("analyst", "view", "table", "S3"), ("staff", "process", "column", "S2"), ("staff", "process", "table", "S2"), ("staff", "view", "column", "S1")], "role, scope, level, categories"))
def pol_denied_categories_old_form(spark, sf_dir):
    """Restrictions of the older form beside policies."""
    made = policy.access_frame(spark, [{"id": "p", "effect": "deny", "action": "read", "scope": "view", "level": "column", "categories": ["S1"], "roles": ["Staff"]}], {"table": {}, "column": {}}, ["staff"])
    old = made.withColumn("view_restriction", F.create_map(F.lit("S3"), F.array(F.lit("analyst")))).withColumn("process_restriction", F.create_map(F.lit("S2"), F.array(F.lit("staff"))))
    return policy.denied_categories(old).withColumn("categories", F.array_join("categories", ","))


@query(values([("a", "S2"), ("b", "S0")], "column_name, category"))
def pol_highest_class(spark, sf_dir):
    return policy.highest_class(spark.createDataFrame([("t", "A", "S0"), ("u", "a", "S2"), ("u", "b", "S0")], "table_name string, column_name string, category string"))


@query(values([("row_view_customer_1", "customer", "c_mktsegment", "c_mktsegment IS NOT NULL"), ("row_view_customer_2", "customer", "c_nationkey", "c_nationkey IS NOT NULL")], "policy_id, table_name, column_name, condition"))
def pol_row_policies(spark, sf_dir):
    m = policy.members(access(spark))
    cls = columns(spark, sf_dir).join(m.filter("level = 'column'").select(F.col("name").alias("column_name"), "category"), "column_name")
    return policy.row_policies(cls.select("table_name", "column_name", "category"), m.filter("level = 'table'").select(F.col("name").alias("table_name"), "category"))


# --- enforcement --------------------------------------------------------------

_CHECKS = [
    ("c1", "admin", "SELECT c_name FROM customer", "allow"), ("c2", "analyst", "SELECT c_name FROM customer", "deny"), ("c3", "analyst", "SELECT c_custkey FROM customer WHERE c_name = 'x'", "deny"),
    ("c4", "staff", "SELECT n_name FROM nation", "allow"), ("c5", "public", "DELETE FROM nation", "deny"), ("c6", "public", "SELECT s_suppkey FROM supplier", "deny"), ("c7", "staff", "SELECT missing FROM nation", "deny"),
    ("c8", "staff", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)", "deny"), ("c9", "public", "WITH a AS (SELECT r_name FROM region) SELECT * FROM a", "allow"),
]


@query(values([(k, r, d, s if d == "allow" else None) for k, r, s, d in _CHECKS], "query_id, role, decision, final_query"))
def enf_check(spark, sf_dir):
    found = engine(spark, sf_dir).check_queries(spark.createDataFrame([x[:3] for x in _CHECKS], "query_id string, role string, sql string"))
    return found.select("query_id", "role", "decision", "final_query")


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def enf_secured_customer_analyst(spark, sf_dir):
    return engine(spark, sf_dir).secured_view("customer", "analyst")


@query("SELECT * FROM lineitem WHERE l_returnflag <> 'R'")
def enf_secured_lineitem_staff(spark, sf_dir):
    return engine(spark, sf_dir).secured_view("lineitem", "staff")


@query("SELECT * FROM part WHERE p_size < 25")
def enf_secured_part_public(spark, sf_dir):
    return engine(spark, sf_dir).secured_view("part", "public")


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name")
def enf_execute_over_views(spark, sf_dir):
    return engine(spark, sf_dir).execute_query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name", "analyst", "view")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def enf_execute_checked(spark, sf_dir):
    return engine(spark, sf_dir).execute_query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "public", "dbms")


#: Attempts to get round the rules: name, role, query, and what each way of running makes of it.
_HOLES = [
    ("unknown role", "visitor", "SELECT r_name FROM region", "deny", "deny", "deny"),
    ("no role", "", "SELECT r_name FROM region", "deny", "deny", "deny"),
    ("other case of the role", " Analyst ", "SELECT c_name FROM customer", "deny", "deny", "deny"),
    ("role in capitals", "STAFF", "SELECT c_custkey FROM customer", "deny", "deny", "deny"),
    ("join by USING", "staff", "SELECT a.n_name FROM nation AS a JOIN (SELECT n_nationkey AS c_nationkey FROM nation) AS k ON a.n_nationkey = k.c_nationkey JOIN customer AS b USING (c_nationkey) WHERE b.c_name = 'x'", "allow", "deny", "deny"),
    ("column merged by USING", "analyst", "SELECT c_name FROM customer AS a JOIN customer AS b USING (c_name)", "deny", "deny", "deny"),
    ("column merged by NATURAL", "analyst", "SELECT c_name FROM customer AS a NATURAL FULL JOIN customer AS b", "deny", "deny", "deny"),
    ("qualified table", "public", "SELECT n_name FROM otherdb.nation", "deny", "deny", "deny"),
    ("qualified column", "public", "SELECT otherdb.nation.n_name FROM nation", "deny", "deny", "deny"),
    ("file as a table", "public", "SELECT * FROM parquet.`{dir}/customer.parquet`", "deny", "deny", "deny"),
    ("file in a subquery", "public", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM parquet.`{dir}/customer.parquet`)", "deny", "deny", "deny"),
    ("view of the session", "public", "SELECT * FROM everything", "deny", "deny", "deny"),
    ("statement that changes", "public", "DROP VIEW everything", "deny", "deny", "deny"),
    ("statement behind a comment", "public", "/* SELECT */ CREATE VIEW v AS SELECT 1", "deny", "deny", "deny"),
    ("join without a condition", "admin", "SELECT COUNT(*) AS n FROM lineitem AS a, lineitem AS b WHERE a.l_tax > b.l_tax", "allow", "allow", "allow"),
    ("what is permitted", "Public", "SELECT n_name FROM nation", "allow", "allow", "allow"),
]


@query(values([(n, *outcome) for n, _, _, *outcome in _HOLES], "attempt, realign, dbms, view"))
def enf_closed(spark, sf_dir):
    """All ways of running stay closed to what the role may not read."""
    e = engine(spark, sf_dir)
    e.frames["customer"].createOrReplaceTempView("everything")
    rows = [(n, *(e.answer(sql.replace("{dir}", sf_dir), role, how)["status"] for how in ("realign", "dbms", "view"))) for n, role, sql, *_ in _HOLES]
    spark.catalog.dropTempView("everything")
    return spark.createDataFrame(rows, "attempt string, realign string, dbms string, view string")


@query(values([(i * 3 + j, f"{a}_{b}", a, b) for i, a in enumerate(enforce.PRE) for j, b in enumerate(enforce.POST)], "position, mode, method, layer"))
def enf_modes(spark, sf_dir):
    return enforce.modes(spark)


@query(values([(3, "prompt_none", "prompt", "none"), (5, "prompt_realign", "prompt", "realign")], "position, mode, method, layer"))
def enf_modes_with_baselines(spark, sf_dir):
    return enforce.modes(spark, ["prompt_realign"])


@query(pre("SELECT role, 'Restrictions: ' || string_agg(part, '; ' ORDER BY part) || '.' AS hint FROM (SELECT role, 'do not ' || scope || ' the ' || level || 's ' || string_agg(name, ', ' ORDER BY name) AS part FROM denies GROUP BY role, scope, level) GROUP BY role"))
def enf_prompt_hint(spark, sf_dir):
    return enforce.restriction_hint(policy.denied_sets(_policies(spark)))


@query(pre("SELECT table_name, column_name FROM catalog WHERE table_name NOT IN (SELECT name FROM denies WHERE role = 'staff' AND level = 'table') AND column_name NOT IN (SELECT name FROM denies WHERE role = 'staff' AND level = 'column')"))
def enf_filtered_catalog(spark, sf_dir):
    return enforce.filtered_catalog(columns(spark, sf_dir), policy.denied_sets(_policies(spark)), "staff").select("table_name", "column_name")


@query(values([k for k in _FK if "customer" not in k and "orders" not in k and "supplier" not in k], "from_table, from_column, to_table, to_column"))
def enf_filtered_foreign_keys(spark, sf_dir):
    visible = enforce.filtered_catalog(columns(spark, sf_dir), policy.denied_sets(_policies(spark)), "public")
    return enforce.filtered_foreign_keys(foreign_keys(spark), visible)


@query(values([("# nation\n- n_nationkey (int) primary key\n- n_name (string)\n- n_regionkey (int) -> region.r_regionkey",), ("# region\n- r_regionkey (int) primary key\n- r_name (string)",)], "text"))
def enf_light_schema(spark, sf_dir):
    return catalog.light_schema(columns(spark, sf_dir).filter("table_name IN ('nation', 'region')"), foreign_keys(spark)).select("text")


@query(values([("CREATE TABLE nation (\n  n_nationkey INT,\n  n_name STRING,\n  n_regionkey INT,\n  PRIMARY KEY (n_nationkey),\n  FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey)\n)",)], "text"))
def enf_ddl(spark, sf_dir):
    return catalog.ddl(columns(spark, sf_dir).filter("table_name = 'nation'"), foreign_keys(spark)).select("text")


@query(values([("q1", "base_none", "SELECT c_name, c_custkey FROM customer"), ("q1", "base_dbms", None), ("q1", "base_realign", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"), ("q1", "view_none", "SELECT r_name FROM region"), ("q1", "view_dbms", "SELECT r_name FROM region"), ("q1", "view_realign", "SELECT r_name FROM region")], "sample_id, mode, final_query"))
def enf_layers(spark, sf_dir):
    e = engine(spark, sf_dir)
    made = spark.createDataFrame([("q1", "analyst", "base", "SELECT c_name, c_custkey FROM customer"), ("q1", "analyst", "view", "SELECT r_name FROM region")], "sample_id string, role string, method string, sql string")
    asked = made.select(F.concat_ws("::", "sample_id", "method").alias("query_id"), "role", "sql")
    return enforce.apply_layers(made, e.check_queries(asked), e.refine_queries(asked))


# --- generation ---------------------------------------------------------------


def _graph() -> generate.SchemaGraph:
    both = [(a, c, b, d) for a, b, c, d in _FK] + [(c, a, d, b) for a, b, c, d in _FK]
    return generate.SchemaGraph(both)


@query(f"WITH {_KEYS} SELECT ft AS a, tt AS b, fc AS a_column, tc AS b_column FROM fk UNION SELECT tt, ft, tc, fc FROM fk")
def gen_edges(spark, sf_dir):
    return generate.edges(foreign_keys(spark))


@query(values([(0, "customer,nation,region"), (1, "lineitem,part")], "component, tables"))
def gen_components(spark, sf_dir):
    found = _graph().components(["nation", "part", "customer", "lineitem", "region"])
    return spark.createDataFrame([(i, ",".join(c)) for i, c in enumerate(found)], "component int, tables string")


@query(values([(0, "customer", "c_nationkey", "nation", "n_nationkey"), (1, "customer", "c_custkey", "orders", "o_custkey"), (2, "nation", "n_regionkey", "region", "r_regionkey")], "step, a, a_column, b, b_column"))
def gen_join_plan(spark, sf_dir):
    steps = _graph().plan(["customer", "nation", "orders", "region"], "customer")
    return spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "step int, a string, a_column string, b string, b_column string")


_PLACES = [("nation", "n_name"), ("supplier", "s_name")]
_NUMBERS = frozenset({("supplier", "s_acctbal"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("nation", "n_regionkey")})
_TEMPLATE = generate.Template(_PLACES, [("supplier", "s_acctbal"), ("supplier", "s_suppkey")], _NUMBERS)
_WIDE = generate.Template(_PLACES[:1], [("supplier", "s_nationkey"), ("supplier", "s_suppkey"), ("nation", "n_regionkey"), ("supplier", "s_acctbal")], _NUMBERS)
_SHOWN = generate.Template([("supplier", "s_name"), ("supplier", "s_suppkey")], [("supplier", "s_suppkey")], _NUMBERS)


def _generated(mode: str, template: generate.Template = _TEMPLATE, filter_only: bool = False):
    def run(spark, sf_dir):
        e = engine(spark, sf_dir)
        return e.execute_query(generate.build(mode, template, _graph(), filter_only).replace('"', ""), "admin", "dbms")

    return run


QUERIES["gen_where"] = _generated("where")
ORACLES["gen_where"] = "SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal >= 0 AND s_suppkey >= 0"
QUERIES["gen_aggregate"] = _generated("aggregate")
ORACLES["gen_aggregate"] = "SELECT n_name, s_name, avg(s_acctbal) AS avg_supplier_s_acctbal, sum(s_suppkey)::BIGINT AS sum_supplier_s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL"
QUERIES["gen_group_by"] = _generated("group_by")
ORACLES["gen_group_by"] = "SELECT n_name, s_name, avg(s_acctbal) AS avg_supplier_s_acctbal, sum(s_suppkey)::BIGINT AS sum_supplier_s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY s_acctbal, s_suppkey, n_name, s_name"
QUERIES["gen_group_by_unshown"] = _generated("group_by", _WIDE)
ORACLES["gen_group_by_unshown"] = "SELECT n_name, avg(s_acctbal) AS avg_supplier_s_acctbal FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY s_nationkey, s_suppkey, n_regionkey, n_name"
QUERIES["gen_filter_only_group"] = _generated("group_by", _SHOWN, True)
ORACLES["gen_filter_only_group"] = "SELECT any_value(s_name) AS s_name, avg(s_suppkey) AS avg_supplier_s_suppkey FROM supplier GROUP BY s_suppkey"


@query(
    values(
        [
            ("aggregate", "SELECT ANY_VALUE(t1.\"n_name\") AS \"n_name\", ANY_VALUE(t2.\"s_name\") AS \"s_name\", AVG(t2.\"s_acctbal\") AS \"avg_supplier_s_acctbal\", SUM(t2.\"s_suppkey\") AS \"sum_supplier_s_suppkey\" FROM \"nation\" AS t1 JOIN \"supplier\" AS t2 ON t1.\"n_nationkey\" = t2.\"s_nationkey\""),
            ("group_by", "SELECT ANY_VALUE(t1.\"n_name\") AS \"n_name\", ANY_VALUE(t2.\"s_name\") AS \"s_name\", AVG(t2.\"s_acctbal\") AS \"avg_supplier_s_acctbal\", SUM(t2.\"s_suppkey\") AS \"sum_supplier_s_suppkey\" FROM \"nation\" AS t1 JOIN \"supplier\" AS t2 ON t1.\"n_nationkey\" = t2.\"s_nationkey\" GROUP BY t2.\"s_acctbal\", t2.\"s_suppkey\""),
        ],
        "mode, query",
    )
)
def gen_filter_only_texts(spark, sf_dir):
    return spark.createDataFrame([(m, generate.build(m, _TEMPLATE, _graph(), True)) for m in ("aggregate", "group_by")], "mode string, query string")


@query(pre("SELECT role, 12 AS n, 'view_and_filter' AS question_type FROM roles UNION ALL SELECT role, 12, 'filter_only' FROM roles"))
def gen_benchmark(spark, sf_dir):
    """A benchmark from end to end, of both kinds: for every role a row of each of 4 templates in each of 3 modes."""
    cols, doc = columns(spark, sf_dir), access(spark)
    roles = policy.roles_of(doc)
    allowed = policy.allowed_columns(cols, _policies(spark), roles)
    make = lambda f: generate.benchmark(cols, foreign_keys(spark), policy.role_pools(allowed), policy.global_projection_pool(cols, doc, allowed, roles), "tpch", 4, 13, f)
    return make(False).unionByName(make(True)).groupBy("role", "question_type").agg(F.count("*").cast("int").alias("n"))


@query(pre("SELECT t.template_id, r.role, CASE WHEN EXISTS (SELECT 1 FROM allowed a WHERE a.role = r.role AND a.kind = 'view' AND a.table_name || '.' || a.column_name = t.order_by) THEN t.order_by WHEN t.template_id = 'v1' THEN 'nation.n_nationkey' END AS order_by_column FROM (SELECT * FROM (VALUES ('v1', 'customer.c_name'), ('v2', 'nation.n_name')) v(template_id, order_by)) t CROSS JOIN roles r"))
def gen_view_copies(spark, sf_dir):
    """Where a role may not see the order column, its first plain column takes its place."""
    pools = policy.role_pools(policy.allowed_columns(columns(spark, sf_dir), _policies(spark), policy.roles_of(access(spark))))
    made = spark.createDataFrame([("v1", ["customer.c_name", "customer.c_mktsegment", "nation.n_nationkey"], "customer.c_name"), ("v2", ["nation.n_name"], "nation.n_name")], "template_id string, projection array<string>, order_by string")
    plain = spark.createDataFrame([("nation.n_nationkey", "S0"), ("nation.n_name", "S0"), ("customer.c_mktsegment", "S1")], "column string, category string")
    return generate.view_copies(made, pools, plain).select("template_id", "role", "order_by_column")


@query("SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 7")
def gen_view_ops(spark, sf_dir):
    sql = generate.view_query([("nation", "n_name"), ("region", "r_name")], _graph(), True, (("nation", "n_name"), "DESC"), 7)
    return engine(spark, sf_dir).execute_query(sql.replace('"', ""), "admin", "dbms")


def _templates(spark):
    rows = [("t1", ["customer.c_name", "nation.n_name"], ["customer.c_acctbal", "nation.n_nationkey"]), ("t2", ["customer.c_custkey"], ["customer.c_name"]), ("t3", ["part.p_brand", "supplier.s_acctbal"], ["part.p_size"])]
    return spark.createDataFrame(rows, "template_id string, projection array<string>, process array<string>")


def _copies(spark, sf_dir):
    pools = policy.role_pools(policy.allowed_columns(columns(spark, sf_dir), _policies(spark), policy.roles_of(access(spark))))
    return generate.role_copies(_templates(spark), pools)


_COPIES = "WITH " + PRELUDE + (
    """, templates AS (SELECT * FROM (VALUES ('t1', 'projection', 'customer.c_name'), ('t1', 'projection', 'nation.n_name'), ('t1', 'process', 'customer.c_acctbal'), ('t1', 'process', 'nation.n_nationkey'),
      ('t2', 'projection', 'customer.c_custkey'), ('t2', 'process', 'customer.c_name'), ('t3', 'projection', 'part.p_brand'), ('t3', 'projection', 'supplier.s_acctbal'), ('t3', 'process', 'part.p_size')) v(template_id, part, col)),
    marked AS (SELECT t.*, r.role, EXISTS (SELECT 1 FROM allowed a WHERE a.role = r.role AND a.kind = CASE t.part WHEN 'projection' THEN 'view' ELSE 'process' END AND a.table_name || '.' || a.column_name = t.col) AS ok FROM templates t CROSS JOIN roles r)
    SELECT template_id, role, coalesce(string_agg(col, ',' ORDER BY col) FILTER (WHERE ok AND part = 'projection'), '') AS projection_columns, coalesce(string_agg(col, ',' ORDER BY col) FILTER (WHERE NOT ok), '') AS dropped,
      bool_or(ok AND part = 'projection') AND bool_or(ok AND part = 'process') AS is_usable FROM marked GROUP BY template_id, role"""
)


@query(_COPIES)
def gen_role_copies(spark, sf_dir):
    dropped = F.array_join(F.array_sort(F.concat("dropped_projection", "dropped_process")), ",")
    return _copies(spark, sf_dir).select("template_id", "role", F.array_join(F.array_sort("projection_columns"), ",").alias("projection_columns"), dropped.alias("dropped"), "is_usable")


@query(values([(3, True, True)], "n, distinct_templates, repeatable"))
def gen_templates(spark, sf_dir):
    pool = [("customer", "c_name"), ("customer", "c_custkey"), ("nation", "n_name")]
    made = [generate.templates(pool, pool, set(), 3, 13, "tpch") for _ in range(2)]
    keys = [[(tuple(t.projection), tuple(t.process)) for t in m] for m in made]
    return spark.createDataFrame([(len(keys[0]), len(set(keys[0])) == len(keys[0]), keys[0] == keys[1])], "n int, distinct_templates boolean, repeatable boolean")


def _records(spark, sf_dir):
    copies, made = _copies(spark, sf_dir), _templates(spark).withColumn("role", F.lit(None).cast("string"))
    own = copies.select("template_id", F.col("projection_columns").alias("projection"), F.col("process_columns").alias("process"), "role")
    links = [(r["a"], r["b"], r["a_column"], r["b_column"]) for r in generate.edges(foreign_keys(spark)).collect()]
    queries = generate.queries_of(made.unionByName(own), links, {"customer.c_acctbal", "nation.n_nationkey", "part.p_size"})
    return generate.case_records(copies, queries)


_MODES3 = ("aggregate", "group_by", "where")


@query(values([(t, m, 4, n) for t, n in (("t1", 4), ("t2", 2), ("t3", 4)) for m in _MODES3], "template_id, mode, roles, usable"))
def gen_case_records(spark, sf_dir):
    usable = F.size(F.filter(F.map_values("role_expected"), lambda e: e["is_usable"]))
    return _records(spark, sf_dir).select("template_id", "mode", F.size("role_expected").alias("roles"), usable.alias("usable"))


@query(values([("t1", "analyst", "customer.c_name", "", "", ""), ("t1", "staff", "customer.c_name", "", "", ""), ("t1", "public", "customer.c_name", "customer.c_acctbal", "", ""), ("t1", "admin", "", "", "", ""), ("t3", "admin", "", "", "supplier", "supplier.s_acctbal"), ("t3", "public", "", "", "", "")], "template_id, role, dropped_projection, dropped_process, lost_tables, lost_columns"))
def gen_case_drops(spark, sf_dir):
    """What a role's query lacks: what policies take, and what can't be joined."""
    each = _records(spark, sf_dir).filter("mode = 'where'").select("template_id", F.explode("role_expected").alias("role", "e"))
    text = lambda c: F.array_join(F.col("e." + c), ",")
    rows = each.select("template_id", "role", text("dropped_restricted_projection").alias("dropped_projection"), text("dropped_restricted_process").alias("dropped_process"), text("dropped_disconnected_tables").alias("lost_tables"), text("dropped_disconnected_columns").alias("lost_columns"))
    return rows.filter("template_id = 't1' OR template_id = 't3' AND role IN ('admin', 'public')")


@query("SELECT i::INTEGER AS question_id, ['admin','analyst','public','staff'][(i - 1) % 4 + 1] AS role, 't' || ((i - 1) // 12 + 1) AS template_id, ['aggregate', 'group_by', 'where'][((i - 1) // 4) % 3 + 1] AS mode, 'view_and_filter' AS question_type FROM generate_series(1, 36) g(i)")
def gen_flat_rows(spark, sf_dir):
    records = _records(spark, sf_dir).select(F.lit("tpch").alias("db_id"), "*", F.lit("q").alias("question"), F.lit("qa_view_and_filter_pairs.json").alias("source_file"))
    return generate.flat_rows(records).select("question_id", "role", "template_id", "mode", "question_type")


@query(values([("where", "Show a, b where c are known."), ("view_ops", "List a, b."), ("group_by", "Group the rows by c, show a, b and summarise."), ("aggregate", "Summarise c for each a, b.")], "mode, question"))
def gen_questions(spark, sf_dir):
    return spark.createDataFrame([(m, generate.question(m, ["a", "b"], ["c"])) for m in ("where", "view_ops", "group_by", "aggregate")], "mode string, question string")


@query(values([("ok", "OK?"), ("fails", "fails")], "question, question_naturalized"))
def gen_naturalized(spark, sf_dir):
    """Questions put in other words where that works."""
    def other(q):
        if q == "fails":
            raise ValueError(q)
        return q.upper() + "?"

    return generate.naturalized(spark.createDataFrame([("ok",), ("fails",)], "question string"), other)


# --- what a role's generator is told ------------------------------------------


@query(values([("nation", "n_name", "Its name"), ("region", "r_name", "A continent")], "table_name, column_name, description"))
def enf_filtered_descriptions(spark, sf_dir):
    told = [("nation", "n_name", "Its name"), ("region", "r_name", "A continent"), ("customer", "c_name", "Who buys"), ("supplier", "s_acctbal", "What it owes")]
    return enforce.filtered_descriptions(spark.createDataFrame(told, "table_name string, column_name string, description string"), policy.denied_sets(_policies(spark)), "Staff")


@query(values([("base", "admin", True, False), ("view", "analyst", False, False), ("prompt", "analyst", True, True), ("prompt", "admin", True, False)], "how, role, names_denied, hinted"))
def enf_contexts(spark, sf_dir):
    """Whether a role's context names a column that it may not see, and tells it so in words."""
    out = None
    for how, role in (("base", "admin"), ("view", "analyst"), ("prompt", "analyst"), ("prompt", "admin")):
        one = enforce.contexts(columns(spark, sf_dir), foreign_keys(spark), policy.denied_sets(_policies(spark)), role, how)
        one = one.select(F.lit(how).alias("how"), F.lit(role).alias("role"), F.col("schema_text").contains("c_name").alias("names_denied"), F.col("hint").isNotNull().alias("hinted"))
        out = one if out is None else out.unionByName(one)
    return out


@query(values([("s1", "prompt", "SELECT 1 -- asked: a", True), ("s2", "prompt", None, True)], "sample_id, method, sql, told"))
def enf_generated(spark, sf_dir):
    """A generator that is told of the role's limits; what it fails on is null."""
    def generate_(question, schema_text, hint):
        if question == "b" or "do not view" not in hint or "# customer" not in schema_text:
            raise ValueError("no answer")
        return "SELECT 1 -- asked: " + question

    cases = spark.createDataFrame([("s1", "analyst", "a", None), ("s2", "analyst", "b", "x")], "sample_id string, role string, question string, evidence string")
    context = enforce.contexts(columns(spark, sf_dir), foreign_keys(spark), policy.denied_sets(_policies(spark)), "analyst", "prompt")
    return enforce.generate_queries(cases, context, generate_, "prompt").select("sample_id", "method", "sql", (F.col("prompt_chars") > 100).alias("told"))


@query(values([("nation", 'CREATE TABLE nation (\n  n_nationkey INT,\n  n_name STRING, -- its name; examples: ALGERIA, CHINA\n  n_regionkey INT,\n  PRIMARY KEY (n_nationkey),\n  FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey)\n)')], "table_name, text").replace("\\n", "\n"))
def enf_ddl_with_comments(spark, sf_dir):
    told = spark.createDataFrame([("nation", "n_name", "its   name")], "table_name string, column_name string, description string")
    some = spark.createDataFrame([("nation", "n_name", "CHINA"), ("nation", "n_name", "ALGERIA")], "table_name string, column_name string, value string")
    return catalog.ddl(columns(spark, sf_dir).filter("table_name = 'nation'"), foreign_keys(spark), told, some)


@query("SELECT 'nation' AS table_name, column_name FROM information_schema.columns WHERE table_name = 'nation'")
def src_session(spark, sf_dir):
    """Columns of a view of the session."""
    frames(spark, sf_dir)["nation"].createOrReplaceTempView("nation_of_session")
    found = catalog.from_session(spark, tables=["nation_of_session"]).select(F.lit("nation").alias("table_name"), "column_name")
    spark.catalog.dropTempView("nation_of_session")
    return found


@query(values([("a", "x", True, False), ("a", "Y z", False, False), ("b", "x", False, True)], "table_name, column_name, is_pk, is_fk"))
def src_schema_document(spark, sf_dir):
    made = catalog.schema_document(spark, "d", {"a": [("x", "INT"), ("Y z", "TEXT")], "b": [("x", "INT")]}, [("a", "x")], [("b", "x", "a", "x")])
    return catalog.columns_of(made).select("table_name", "column_name", "is_pk", "is_fk")


@query(pre("SELECT count(DISTINCT table_name) AS tables, count(*) AS columns, 4 AS roles, 12 AS policies FROM catalog"))
def src_saved(spark, sf_dir):
    """An engine stored and loaded again knows as much, and decides alike."""
    e, path = engine(spark, sf_dir), scratch(spark, "engine")
    e.save(path)
    again = AccessEngine(spark).load_saved(path, e.frames)
    assert again.refine_query("SELECT c_name, c_custkey FROM customer", "analyst") == e.refine_query("SELECT c_name, c_custkey FROM customer", "analyst")
    return spark.createDataFrame([tuple(again.statistics().values())], "tables int, columns int, roles int, policies int")


@query(values([("n1", 0), ("n2", 1)], "sample_id, row_index"))
def src_datasets(spark, sf_dir):
    """Datasets of databases: the first of the known names counts, a database without one is left out."""
    root = scratch(spark, "datasets")
    row = lambda s, i: {"db_id": s, "question": "q", "role": "r", "intent_preserving_expected_query": "SELECT 1", "sample_id": s, "row_index": i}
    put_text(spark, f"{root}/n1/qa.json", json.dumps([row("n1", 0)]))
    put_text(spark, f"{root}/n1/bird_style_dataset.json", json.dumps([row("old", 9)]))
    put_text(spark, f"{root}/n2/bird_style_dataset.json", json.dumps([row("n2", 1)]))
    return io.read_datasets(spark, root, ["n1", "n2", "n3"]).select("sample_id", F.col("row_index").cast("int").alias("row_index"))


@query(values([("list", 2), ("map", 2), ("predictions", 2), ("records", 2), ("rows with other fields", 2)], "form, n"))
def src_prediction_forms(spark, sf_dir):
    rows = [{"sample_id": "a", "sql": "SELECT 1"}, {"sample_id": "b", "sql": "SELECT 2"}]
    forms = {"list": rows, "records": {"records": rows}, "predictions": {"predictions": rows}, "map": {"a": "SELECT 1", "b": "SELECT 2"}, "rows with other fields": [rows[0], {"sample_id": "b", "output_query": "SELECT 2"}]}
    out = []
    for name, form in forms.items():
        found = io.normalize_predictions(spark.read.json(put_text(spark, scratch(spark, "forms.json"), json.dumps(form)), multiLine=True))
        out.append((name, found.filter("sample_id IN ('a', 'b') AND query IN ('SELECT 1', 'SELECT 2')").count()))
    return spark.createDataFrame(out, "form string, n int")


__all__ = ["ORACLES", "QUERIES", "ROLES"]
