"""Enforcement: secured views, checks before and after generation, execution, the nine modes."""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.facts import Schema, analyse
from palisade.operators.rules import Policies

PRE, POST = ("base", "prompt", "view"), ("none", "dbms", "realign")


def modes(spark: SparkSession, wanted: list[str] | None = None) -> DataFrame:
    """position, mode, method, layer: 3 x 3 modes in fixed order; a wanted mode brings its method's plain one along."""
    rows = [(i * 3 + j, f"{a}_{b}", a, b) for i, a in enumerate(PRE) for j, b in enumerate(POST)]
    if wanted:
        methods = {w.split("_")[0] for w in wanted}
        rows = [r for r in rows if r[1] in wanted or r[2] in methods and r[3] == "none"]
    return spark.createDataFrame(rows, "position int, mode string, method string, layer string")


def check(role: str, sql: str | None, denies: dict[str, set[str]], schema: Schema) -> tuple[str, str | None]:
    """(allow or deny, why): a query may read only if no table and no column that it touches is denied; denies: table, column."""
    if not (sql or "").strip().lower().startswith(("select", "with")):
        return "deny", "only SELECT is permitted"
    _, facts, error = analyse("", role, sql, schema)
    if error:
        return "deny", error
    for f in facts:
        for table, column in f[17]:
            if table in denies.get("table", ()):
                return "deny", f"table {table} is denied"
            if column and (column in denies.get("column", ()) or f"{table}.{column}" in denies.get("column", ())):
                return "deny", f"column {table}.{column} is denied"
    return "allow", None


def check_queries(queries: DataFrame, denied: DataFrame, schema: Schema, known_roles: list[str] | None = None) -> DataFrame:
    """query_id, role, decision, reason, final_query (null if denied) for queries (query_id, role, sql); denied: denied_sets().

    Roles outside known_roles are denied everything (None: every role is known).
    """
    known = None if known_roles is None else {r.strip().lower() for r in known_roles}
    sets = denied.filter("scope = 'all'").groupBy("role").agg(F.map_from_entries(F.collect_list(F.struct("level", "names"))).alias("denies"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for q, role, sql, denies in pdf.itertuples(index=False):
                d = {k: set(v) for k, v in (dict(denies).items() if denies is not None else ())}
                unknown = known is not None and (role or "").strip().lower() not in known
                decision, why = ("deny", "unknown role") if unknown else check(role, sql, d, schema)
                rows.append((q, role, decision, why, sql if decision == "allow" else None))
            yield pd.DataFrame(rows, columns=["query_id", "role", "decision", "reason", "final_query"])

    return queries.select("query_id", "role", "sql", F.lower(F.trim("role")).alias("_role")).join(sets.withColumnRenamed("role", "_role"), "_role", "left").select("query_id", "role", "sql", "denies").mapInPandas(run, "query_id string, role string, decision string, reason string, final_query string")


def secured(df: DataFrame, table: str, role: str, policies: DataFrame | Policies, scope: str = "all") -> DataFrame | None:
    """The rows and columns of a table that a role may see; None if the table is denied.

    Both are plain filters and projections: Catalyst pushes them to the scan.
    The policies of one role come to the driver.
    """
    from palisade.operators.policy import denied_entities

    table, role = table.lower(), role.strip().lower()
    if isinstance(policies, DataFrame):
        policies = Policies([r.asDict() for r in policies.filter(F.col("role") == role).collect()]) if scope == "all" else policies
    if isinstance(policies, Policies):
        if scope != "all":
            raise ValueError("a scope other than all needs the policies as a DataFrame")
        names, conditions = policies.denied(role), policies.row_conditions(role, table)
    else:
        names = {r["level"]: set(r["names"]) for r in denied_entities(policies, role, scope).collect()}
        conditions = Policies([r.asDict() for r in policies.filter(F.col("role") == role).collect()]).row_conditions(role, table)
    if table in names.get("table", ()):
        return None
    gone = names.get("column", set())
    kept = [c for c in df.columns if c.lower() not in gone and f"{table}.{c.lower()}" not in gone]
    if not kept:
        return None
    for c in conditions:
        df = df.filter(F.expr(c))
    return df.select(*kept)


def named_views(frames: dict[str, DataFrame], prefix: str) -> dict[str, str]:
    """Temporary views under names of their own, which no other engine or role has: table -> view."""
    out = {}
    for table, df in frames.items():
        out[table] = f"{prefix}_{table}"
        df.createOrReplaceTempView(f"`{out[table]}`")
    return out


def secured_frames(frames: dict[str, DataFrame], role: str, policies: DataFrame | Policies, scope: str = "all") -> dict[str, DataFrame]:
    """What a role may see of each table; tables of which it may see nothing are left out."""
    shown = {t: secured(df, t, role, policies, scope) for t, df in frames.items()}
    return {t: df for t, df in shown.items() if df is not None}


_LEAD = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)


def over_views(sql: str, views: dict[str, str]) -> str:
    """The query with the tables it may read as common table expressions, which stand before all that the session calls so."""
    body = sql[_LEAD.match(sql).end() :]
    named = {t: v for t, v in views.items() if re.search(rf"(?<![\w]){re.escape(t)}(?![\w])", body, re.I)}
    if not named:
        return body
    heads = ", ".join(f"`{t}` AS (SELECT * FROM `{v}`)" for t, v in sorted(named.items()))
    m = re.match(r"with\b(\s+recursive\b)?", body, re.I)
    if m:
        return f"WITH{(m[1] or '').upper()} {heads}, {body[m.end() :]}"
    return f"WITH {heads} {body}"


def _plans(plan, inside: bool = True):
    """A plan's nodes and those of its subqueries, in pre-order; below a node for which the caller sends True nothing is visited."""
    if (yield plan):
        return
    for part in (plan.children(), plan.subqueries()) if inside else (plan.children(),):
        it = part.iterator()
        while it.hasNext():
            yield from _plans(it.next(), inside)


#: Leaves that hold no stored rows.
_HARMLESS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}


def read_only(spark: SparkSession, sql: str) -> None:
    """Refuse what is no query, before anything of it runs."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    named = spark._jvm.java.lang.Class
    kinds = [named.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    nodes = _plans(plan)
    for node in nodes:
        if any(k.isInstance(node) for k in kinds):
            raise PermissionError("only SELECT is permitted")


def only_reads(df: DataFrame, views: set[str]) -> None:
    """Refuse a query that reads anything but the views: files, tables and views of the session."""
    nodes = _plans(df._jdf.queryExecution().analyzed())
    node, below = next(nodes, None), False
    while node is not None:
        below = False
        if node.nodeName() == "View":
            if node.desc().identifier().table() not in views:
                raise PermissionError("the query reads a view that is not the role's")
            below = True
        elif node.children().isEmpty() and node.nodeName() not in _HARMLESS:
            raise PermissionError(f"the query reads {node.nodeName()}, which is no table of the catalog")
        try:
            node = nodes.send(below)
        except StopIteration:
            node = None


#: Estimated bytes of the smaller side up to which a join without a condition runs.
CROSS_BYTES = 64 << 20


def no_explosion(df: DataFrame, most: int = CROSS_BYTES) -> None:
    """Refuse a plan that joins two large relations without a condition, as a query may that has lost its ON."""
    for node in _plans(df._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() == "Join" and node.condition().isEmpty():
            sizes = [int(str(side.stats().sizeInBytes())) for side in (node.left(), node.right())]
            if min(sizes) > most:
                raise PermissionError(f"a join without a condition over about {min(sizes)} bytes on its smaller side")


def parses(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's own parser accepts the text."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        return True
    except Exception:
        return False


def within(df: DataFrame, timeout: float | None) -> DataFrame:
    """df, taken to its first row under a time limit in seconds if one is given; what takes longer fails."""
    if timeout is not None:
        context = df.sparkSession.sparkContext
        group = f"palisade-{threading.get_ident()}-{id(df)}"
        context.setJobGroup(group, "a query under a time limit", True)
        timer = threading.Timer(timeout, lambda: context.cancelJobGroup(group))
        timer.start()
        try:
            df.limit(1).collect()
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
    return df


def restriction_hint(denied: DataFrame) -> DataFrame:
    """role, hint: one sentence that names what the role may not use."""
    named = denied.filter("scope IN ('view', 'process')").select("role", F.concat(F.lit("do not "), "scope", F.lit(" the "), "level", F.lit("s "), F.array_join("names", ", ")).alias("part"))
    return named.groupBy("role").agg(F.concat(F.lit("Restrictions: "), F.array_join(F.sort_array(F.collect_list("part")), "; "), F.lit(".")).alias("hint"))


def filtered_catalog(columns: DataFrame, denied: DataFrame, role: str, scope: str = "all") -> DataFrame:
    """The catalog without what the role is denied; a table with no column left is gone."""
    d = denied.filter((F.col("role") == role.strip().lower()) & (F.col("scope") == scope)).select("level", F.explode("names").alias("name"))
    tables = d.filter("level = 'table'").select(F.col("name").alias("t"))
    names = d.filter("level = 'column'").select(F.col("name").alias("n"))
    left = columns.join(tables, F.lower("table_name") == F.col("t"), "left_anti")
    return left.join(names, (F.lower("column_name") == F.col("n")) | (F.concat_ws(".", F.lower("table_name"), F.lower("column_name")) == F.col("n")), "left_anti")


def filtered_descriptions(descriptions: DataFrame, denied: DataFrame, role: str, scope: str = "all") -> DataFrame:
    """Column descriptions (table_name, column_name, ...) without those of denied tables and columns."""
    return filtered_catalog(descriptions, denied, role, scope)


def contexts(columns: DataFrame, foreign: DataFrame, denied: DataFrame, role: str, how: str) -> DataFrame:
    """schema_text, hint: what a generator is told of a role's database.

    view: what the role may see; prompt: all of it, and in words what the role
    may not use; base: all of it.
    """
    from palisade.sources.catalog import light_schema

    if how == "view":
        columns = filtered_catalog(columns, denied, role)
        foreign = filtered_foreign_keys(foreign, columns)
    text = light_schema(columns, foreign).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "text"))), lambda x: x["text"]), "\n\n").alias("schema_text"))
    hints = restriction_hint(denied).filter(F.col("role") == role.strip().lower()).select("hint") if how == "prompt" else None
    if hints is None:
        return text.withColumn("hint", F.lit(None).cast("string"))
    return text.join(hints, F.lit(True), "left")  # one row each


def generate_queries(cases: DataFrame, context: DataFrame, generate, method: str) -> DataFrame:
    """sample_id, role, method, sql, prompt_chars: what generate(question, schema text, hint) answers to each case (sample_id, role, question, evidence).

    generate runs on executors; a case that it fails on gets a null.
    """
    told = context.first()  # one row: the text of a schema
    schema_text, hint = told["schema_text"], told["hint"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for sample, role, question, evidence in pdf.itertuples(index=False):
                whole = " ".join(x for x in (evidence, hint) if x)
                try:
                    sql = generate(question, schema_text, whole)
                except Exception:
                    sql = None
                rows.append((sample, role, method, sql, len(schema_text or "") + len(question or "") + len(whole)))
            yield pd.DataFrame(rows, columns=["sample_id", "role", "method", "sql", "prompt_chars"])

    return cases.select("sample_id", "role", "question", "evidence").mapInPandas(run, "sample_id string, role string, method string, sql string, prompt_chars long")


def filtered_foreign_keys(foreign: DataFrame, visible: DataFrame) -> DataFrame:
    """Foreign keys both of whose columns are visible."""
    side = lambda t, c: visible.select(F.col("table_name").alias(t), F.col("column_name").alias(c))
    return foreign.join(side("from_table", "from_column"), ["from_table", "from_column"], "left_semi").join(side("to_table", "to_column"), ["to_table", "to_column"], "left_semi")


def apply_layers(generated: DataFrame, decisions: DataFrame, refined: DataFrame) -> DataFrame:
    """sample_id, mode, final_query: each generated query (sample_id, role, method, sql) under no layer, the check, and realignment."""
    base = generated.select("sample_id", "method", "sql")
    none = base.select("sample_id", F.concat_ws("_", "method", F.lit("none")).alias("mode"), F.col("sql").alias("final_query"))
    key = lambda df, c: df.select(F.col("query_id").alias("k"), F.col(c).alias("final_query"))
    joined = lambda df, c, layer: base.join(key(df, c), F.concat_ws("::", "sample_id", "method") == F.col("k"), "left").select("sample_id", F.concat_ws("_", "method", F.lit(layer)).alias("mode"), "final_query")
    return none.unionByName(joined(decisions, "final_query", "dbms")).unionByName(joined(refined, "refined_query", "realign"))
