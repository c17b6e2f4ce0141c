"""The access engine: finance cases with known answers, rules one by one, queries against their SQL, invariants."""

import hashlib
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from palisade.functions.sql_text import parse, render, try_parse
from palisade.operators import enforce, evaluate, policy, retrieve, rewrite, rules
from palisade.operators.facts import Schema, analyse
from palisade.plans import context, data_queries, finance, registry
from palisade.plans.workload import DECISIONS, WORKLOAD

SF = "/root/testdata/sf0.001"
CASES = [  # query, permitted query (None: denied), rules
    ('INSERT INTO "Order" (order_id, account_id) VALUES (1, 1)', None, {"rtm"}),
    ("UPDATE Card SET disp_id = 5 WHERE card_id = 10", "UPDATE Card SET disp_id = 5 WHERE card_id = 10", set()),
    ('DELETE FROM "Card" WHERE card_id = 15', None, {"rtm"}),
    ('SELECT account_id, district_id FROM "Account"', None, {"rcv"}),
    ("SELECT * FROM \"Loan\" WHERE status = 'active'", "SELECT Loan.duration, Loan.payments, Loan.status FROM Loan WHERE status = 'active'", {"rcp", "rcv"}),
    ("SELECT client_id, gender FROM \"Client\" WHERE gender = 'male'", "SELECT gender FROM Client WHERE gender = 'male'", {"rcp", "rrp", "rrv"}),
    ("SELECT * FROM \"Transaction\" WHERE k_symbol = 'UROK'", "SELECT Transaction.operation, Transaction.balance, Transaction.bank, Transaction.account FROM Transaction", {"rcp", "rcv"}),
    ("SELECT * FROM \"Client\" WHERE client_id = 1", "SELECT Client.gender, Client.birth_date FROM Client WHERE gender = 'male'", {"rcp", "rcv", "rrp", "rrv"}),
    ("SELECT birth_date FROM \"Client\"", "SELECT birth_date FROM Client WHERE gender = 'male'", {"rrp", "rrv"}),
    ('SELECT card_id, disp_id, type, issued FROM "Card"', "SELECT type, issued FROM Card", {"rcp"}),
    ("SELECT c.client_id, l.loan_id FROM \"Client\" c JOIN \"Loan\" l ON c.client_id = l.account_id", None, {"rcp", "rrp", "rrv"}),
    ("SELECT SUM(t.amount) AS s FROM Account a JOIN Transaction t ON a.account_id = t.account_id GROUP BY a.account_id HAVING SUM(t.amount) > 10", "SELECT SUM(t.amount) AS s FROM Account AS a JOIN Transaction AS t ON a.account_id = t.account_id GROUP BY a.account_id HAVING SUM(t.amount) > 10", set()),
    ("SELECT payments, status FROM Loan l WHERE l.payments > (SELECT AVG(l2.payments) FROM Loan l2)", "SELECT payments, status FROM Loan AS l WHERE l.payments > (SELECT AVG(l2.payments) FROM Loan AS l2)", set()),
    ("SELECT date, duration FROM Loan WHERE account_id IN (SELECT account_id FROM Account WHERE district_id = 'd002')", "SELECT duration FROM Loan WHERE account_id IN (SELECT account_id FROM Account WHERE district_id = 'd002')", {"rcv"}),
    ("SELECT ROUND(amount) AS r, AVG(amount) AS a FROM Loan", "SELECT AVG(amount) AS a FROM Loan", {"rcv"}),
]


def test_finance_cases(spark):
    access = policy.access_frame(spark, finance.finance_policies(), {"table": {}, "column": {}}, ["Manager"])
    schema = Schema.of({t: c.split() for t, c in finance.FINANCE.items()})
    queries = spark.createDataFrame([(str(i), "Manager", c[0]) for i, c in enumerate(CASES)], "query_id string, role string, sql string")
    found = {r["query_id"]: r for r in rewrite.refine_queries(queries, policy.compile_policies(access), schema, None, strict=False).collect()}
    for i, (sql, want, names) in enumerate(CASES):
        r = found[str(i)]
        assert set(r["rules"]) == names, sql
        assert (r["refined_query"] or "").replace('"', "") == (want or ""), sql
        assert r["status"] == ("allow" if want else "deny")


def test_parser_round_trip():
    for sql in [q for _, q, _ in WORKLOAD.values()] + [c[0] for c in CASES]:
        once = render(parse(sql))
        assert render(parse(once)) == once
    assert try_parse("SELECT FROM")[1] and try_parse(None)[1] and try_parse("SELECT a b c FROM t")[1]


def test_strict_joined_subquery():
    schema = Schema.of({"t": ["a", "b"], "u": ["a"]})
    sql = "SELECT u.a FROM u JOIN (SELECT b FROM t) AS x ON u.a = x.b"
    scopes = {s: {r[13][0] if r[13] else "" for r in analyse("q", "r", sql, schema, s)[1] if r[10] == "b" and r[11] == "SelectClause"} for s in (True, False)}
    assert scopes == {True: {"View"}, False: {"Process"}}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(frame):
    show = lambda x: "NULL" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["flagship", "run_where", "run_cte", "run_self_join", "run_broken_on", "run_left_join", "run_right_join", "run_full_join", "run_using", "run_natural_star", "run_full_using", "run_window_frame", "run_grouping_sets", "enf_closed", "src_columns", "rule_status", "refine_decisions", "refine_idempotent", "refine_finance", "refine_finance_agrees", "pol_denied_sets", "pol_allowed", "pol_compile", "enf_check", "enf_secured_part_public", "gen_role_copies", "gen_where", "ret_bm25", "ev_mode_summary", "ev_predictions", "ev_corpus_profile"])
def test_query_against_sql(spark, oracle, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), oracle.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_secured_rows_are_a_part_and_filters_reach_the_scan(spark):
    e = context.engine(spark, SF)
    view = e.secured_view("customer", "analyst")
    assert "c_name" not in view.columns and view.exceptAll(e.frames["customer"].select(view.columns)).count() == 0
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan
    assert e.secured_view("customer", "public") is None


def test_unknown_role_and_compatibility(spark):
    e = context.engine(spark, SF)
    assert e.refine_query("SELECT r_name FROM region", "visitor")["status"] == "deny"
    assert context.engine(spark, SF, unknown_roles="allow").refine_query("SELECT r_name FROM region", "visitor")["status"] == "allow"
    with pytest.raises(PermissionError):
        e.execute_query("SELECT c_name FROM customer", "analyst", "dbms")


def test_tree_distance():
    a, b = parse("SELECT a, b FROM t"), parse("SELECT a FROM t")
    assert evaluate.tree_distance(a, a) == 0 and evaluate.tree_distance(a, b) == 1 and evaluate.similarity("SELECT a FROM t", None) == 0.0


def test_modes_order(spark):
    assert [r["mode"] for r in enforce.modes(spark).orderBy("position").collect()][:4] == ["base_none", "base_dbms", "base_realign", "prompt_none"]


def test_secured_stream(spark, tmp_path):
    from palisade.streaming.secured import secured_stream

    e = context.engine(spark, SF)
    e.frames["part"].repartition(3).write.parquet(str(tmp_path / "in"))
    stream = secured_stream(spark, str(tmp_path / "in"), e.frames["part"].schema, "part", "public", e.policies)
    done = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.frames["part"].filter("p_size < 25").count()


def test_rules_by_join_and_by_lookup(spark, monkeypatch):
    """Both ways to ask the policies say the same of every query."""
    e = context.engine(spark, SF)
    rows = [(f"{k}{r}", r, sql) for k, (_, sql, _) in WORKLOAD.items() for r in context.ROLES] + [(k, r, q) for k, (r, q, *_) in DECISIONS.items()]
    queries = spark.createDataFrame(rows, "query_id string, role string, sql string")
    joined = rules.node_status(rules.query_facts(queries, e.schema), e.policies).collect()
    looked = [tuple(s.values()) for q, r, sql in rows for s in e.local.statuses(analyse(q, r, sql, e.schema)[1])]
    assert set(map(tuple, joined)) == set(looked) and len(joined) == len(looked)
    by_lookup = rewrite.refine_queries(queries, e.policies, e.schema, e.roles).collect()
    monkeypatch.setattr(rules.Policies, "MOST", 1)
    by_join = rewrite.refine_queries(queries, e.policies, e.schema, e.roles).collect()
    assert sorted(by_lookup) == sorted(by_join)


def test_no_status_for_aligned(spark):
    e = context.engine(spark, SF)
    q = spark.createDataFrame([("q", "admin", "SELECT c_name FROM customer")], "query_id string, role string, sql string")
    assert rules.node_status(rules.query_facts(q, e.schema), e.policies).count() == 0


def test_matching_cells_against_brute_force(spark):
    def share(cell, phrase):
        cell, phrase = cell.lower(), phrase.lower()
        return max(j - i for i in range(len(cell)) for j in range(i, len(cell) + 1) if cell[i:j] in phrase) / len(cell)

    cells = ["LARGE BRASS", "BRASS", "BRASSWARE", "Large brushed brass", "A", "İzmir", "abcdefghijklmnopqrst", "x" * 40, "99.5", "zzz"]
    phrases = ["price of large brass items", "brassware", "brassy", "", "BRUSHED BRASS", "bcdefghijklmnopqrstu", "abcdefghijklmnopq", "x" * 37, "costs 99.5 in izmir"]
    asked = spark.createDataFrame([(str(i), p) for i, p in enumerate(phrases)] + [("9", None)], "query_id string, phrase string")
    held = spark.createDataFrame([("t", "c", c) for c in [*cells, ""]], "table_name string, column_name string, value string")
    for least in (0.85, 0.95, 0.3):
        got = {(r.query_id, v) for r in retrieve.matching_cells(held, asked, least).collect() for v in r["values"]}
        assert got == {(str(i), c) for i, p in enumerate(phrases) for c in cells if share(c, p) > least}


@pytest.mark.parametrize("name", ["ret_question_cells", "ret_matching_cells", "ret_document_ngrams", "ret_document_literals"])
def test_retrieval_over_tables_against_sql(spark, oracle, name):
    if name.startswith("ret_document"):
        oracle.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), oracle.execute(registry.oracle_sql()[name]).fetchdf()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_postings_are_counted_in_their_row(spark, tmp_path):
    """An index is written without a shuffle; ids that occur again, with other texts or the same, and null ids rank as in SQL."""
    texts = [(1, "the thing the"), (1, "of the thing und"), (1, "the thing the"), (1, "nicht und und und x y z"), (2, None), (3, ""), (4, " ;- "), (5, "Idiot license LICENSE, der; dér"), (6, "the"), (None, "the nicht idiot idiot"), (None, "with of a"), (7, "zzz with " * 50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = retrieve.postings(docs, "doc_id", "text")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    counted = [(w, i, len(t), t.count(w)) for i, text in texts if text for t in [[w for w in re.split(r"\W+", text.lower()) if w]] for w in set(t)]
    assert sorted(map(str, index.select("term", "doc_id", "length", "tf").collect())) == sorted(str(Row(term=w, doc_id=i, length=n, tf=k)) for w, i, n, k in counted)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["ret_bm25_index"]).fetchdf()
    assert len(want) and cells(registry.queries()["ret_bm25_index"](spark, str(tmp_path)).toPandas()) == cells(want)
    index.write.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame(data_queries._ASK, "query_id string, text string")
    assert cells(retrieve.bm25_of_index(spark.read.parquet(str(tmp_path / "index")), len(texts), asked, most=1).toPandas()) == cells(want)


def test_ngrams_md5_as_ngrams(spark):
    """Digests of n-grams that are never held at once are those of the whole list, for any blocks, also of a text whose list exceeds 2 GB."""
    texts = [None, "", " ;-, ", "one", "Zwei  Wörter", "a b c d e f g h i; a b", "İzmir ß 北京 x²", "the cat " * 400, "0"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    g = docs.select("doc_id", retrieve.ngrams(retrieve.tokens(F.coalesce("text", F.lit("")))).alias("g"))
    want = sorted(g.select("doc_id", F.size("g"), F.md5(F.array_join("g", ";").cast("binary"))).collect())
    for sizes in ({}, {"block": 1}, {"together": 1, "block": 40}):
        assert sorted(docs.select("doc_id", retrieve.ngrams_md5("text", **sizes).alias("x")).select("doc_id", "x.*").collect()) == want
    words, whole = [str(i % 10) * 10_000 for i in range(6_100)], hashlib.md5()
    for n in range(1, 9):
        for i in range(len(words) - n + 1):
            whole.update((";" if n > 1 or i else "").encode() + " ".join(words[i : i + n]).encode())
    one = spark.range(1).select(F.concat_ws(", ", F.transform(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda i: F.repeat((i % 10).cast("string"), F.lit(10_000)))).alias("text"))
    assert tuple(one.select(retrieve.ngrams_md5("text").alias("x")).select("x.*").first()) == (8 * len(words) - 28, whole.hexdigest())


def test_command_line(spark, tmp_path, capsys):
    import json

    from palisade.__main__ import main

    access = {"db_id": "d", "roles": ["staff"], "classification": {"table": {}, "column": {"S3": ["b"]}}, "policies": [{"id": "p", "effect": "deny", "action": "read", "scope": "view", "level": "column", "categories": ["S3"], "roles": ["staff"]}]}
    schema = {"db_id": "d", "table_names": ["t"], "column_names": [["-1", "*"], ["0", "a"], ["0", "b"]], "column_types": ["TEXT"] * 3, "primary_keys": [], "foreign_keys": []}
    for name, document in (("schema", schema), ("access", access)):
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    common = ["--schema", str(tmp_path / "schema.json"), "--access", str(tmp_path / "access.json"), "--role", "Staff", "--sql", "SELECT a, b FROM t"]
    assert main(["refine", *common]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["refined_query"] == "SELECT a FROM t"
    assert main(["check", *common]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["decision"] == "deny"
    samples = [{"sample_id": f"s{i}", "question_id": f"q{i}", "mode": "base_none", "question_type": "view_only", "usable": True, "expected": "SELECT a FROM t", "base": "SELECT a FROM t", "allowed_view": ["t.a"], "allowed_process": ["t.a"], "role": "staff"} for i in range(3)]
    (tmp_path / "samples.json").write_text(json.dumps(samples))
    (tmp_path / "predictions.json").write_text(json.dumps({"s0": "SELECT a FROM t", "s1": "SELECT b FROM t", "s2": "sorry"}))
    out = str(tmp_path / "run")
    assert main(["evaluate", "--samples", str(tmp_path / "samples.json"), "--predictions", str(tmp_path / "predictions.json"), "--out", out]) == 0
    row = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert row["mode"] == "base_none" and row["samples"] == 3 and row["answer_agreement"] == pytest.approx(0.333333)
    assert main(["evaluate", "--samples", str(tmp_path / "samples.json"), "--use-expected", "--out", out, "--run-id", "two", "--resume"]) == 0
    assert main(["summarize", "--run", out, "--by-type"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["samples"] == 3


def test_views_of_engines_stay_apart(spark):
    """Two engines and the session's own view of a table's name do not disturb each other."""
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("nation")
    one, two = (context.AccessEngine(spark).load_frames({"nation": context.frames(spark, SF)["nation"].limit(n)}, context.access(spark)) for n in (2, 3))
    a, b = (e.execute_query("SELECT COUNT(*) AS n FROM nation", "admin", how) for e, how in ((one, "view"), (two, "realign")))
    assert (a.first()[0], b.first()[0], spark.table("nation").columns) == (2, 3, ["mine"])
    one.close()
    two.close()
    assert spark.table("nation").columns == ["mine"]
    spark.catalog.dropTempView("nation")


def test_realigned_as_over_views(spark):
    """Where a role may use all that a query names, rewriting and secured views give the same rows."""
    e, compared = context.engine(spark, SF), 0
    for name, (role, sql, _) in WORKLOAD.items():
        if role == "admin" or "LIMIT" in sql:
            continue
        found = e.answer(sql, role, "view")
        refined = e.refine_query(sql, role)
        if found["status"] == "allow" and not {"rcp", "rcv", "rtr", "rtv"} & set(refined["rules"]):
            rows = [sorted(map(str, df.collect())) for df in (found["result"], e.execute_query(sql, role))]
            assert rows[0] == rows[1], name
            compared += 1
    assert compared >= 10


def test_large_join_without_a_condition_is_refused(spark, monkeypatch):
    monkeypatch.setattr(enforce, "CROSS_BYTES", 10)
    e = context.engine(spark, SF)
    with pytest.raises(PermissionError):
        enforce.no_explosion(spark.range(10**6).crossJoin(spark.range(10**6).withColumnRenamed("id", "k")), 1000)
    assert e.answer("SELECT COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey", "public")["status"] == "allow"


def test_time_limit(spark):
    e = context.engine(spark, SF)
    assert e.runs("SELECT n_name FROM nation") and not e.runs("SELECT COUNT(*) FROM lineitem AS a, lineitem AS b, lineitem AS c WHERE a.l_tax * b.l_tax * c.l_tax < 0", 1.0)
