"""Inference rules as joins of node facts with policies.

Policies come as rows (role, policy_id, grant, action, scope, level,
table_name, column_name, condition); node_status() is one join and seven conditions.
The strata are acyclic (facts, effective scope, status), so one pass is all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.facts import FACTS, Schema, analyse

STATUS = ["query_id", "node_id", "kind", "table_name", "column_name", "status", "policy_id", "rule", "scope", "condition"]


def query_facts(queries: DataFrame, schema: Schema, strict: bool = True) -> DataFrame:
    """FACTS rows of queries (query_id, role, sql); texts that cannot be resolved give none."""

    def run(batches: Iterable):
        import pandas as pd

        names = [f.strip().split(" ")[0] for f in FACTS.replace("array<struct<table:string,column:string>>", "x").split(",")]
        for pdf in batches:
            rows = [r for q, role, sql in zip(pdf["query_id"], pdf["role"], pdf["sql"]) for r in analyse(q, role, sql, schema, strict)[1]]
            out = pd.DataFrame(rows, columns=names)
            out["refs"] = pd.Series([[{"table": t, "column": c} for t, c in r] for r in out["refs"]], dtype=object)
            yield out

    return queries.select("query_id", "role", "sql").mapInPandas(run, FACTS)


def references(facts: DataFrame) -> DataFrame:
    """One row per table or column a node stands for; a column read through a subquery stands for its base columns."""
    return facts.filter(F.col("kind").isin("TableRef", "ColumnRef")).withColumn("ref", F.explode("refs")).withColumn("ref_table", F.col("ref.table")).withColumn("ref_column", F.col("ref.column")).drop("ref", "refs")


#: What a rule asks of a reference and a policy that meets it by role and name, beside equal values.
_FLAGS = {
    "viewed": (lambda: F.array_contains("eff_scopes", "View"), lambda node, p: "View" in node["eff_scopes"]),
    "in_view_clause": (lambda: F.array_contains("clause_scopes", "View"), lambda node, p: "View" in node["clause_scopes"]),
    "bare": (lambda: ~F.col("shielded"), lambda node, p: not node["shielded"]),
    "statement_does_it": (lambda: F.array_contains("stmt_scopes", F.col("p_scope")), lambda node, p: p["p_scope"] in node["stmt_scopes"]),
}
_READ_TABLE = {"kind": "TableRef", "action": "Read"}
_DENY_TABLE = {"p_grant": "Prohibited", "p_action": "Read", "p_level": "Table"}
_DENY_COLUMN = {"kind": "ColumnRef", "action": "Read", "p_grant": "Prohibited", "p_action": "Read", "p_level": "Column"}
_ROWS = {"p_grant": "Conditional", "p_action": "Read", "p_level": "Row", "p_scope": "View"}
#: rule: (status, values that must be equal, flags).
RULES: dict[str, tuple[str, dict[str, str], tuple[str, ...]]] = {
    "rtm": ("Violated", {"kind": "TableRef", "action": "Modify", "p_grant": "Prohibited", "p_action": "Modify", "p_level": "Table"}, ("statement_does_it",)),
    "rtr": ("Violated", _READ_TABLE | _DENY_TABLE, ()),
    "rtv": ("Violated", _READ_TABLE | _DENY_TABLE | {"p_scope": "View"}, ("viewed",)),
    "rcp": ("Violated", _DENY_COLUMN | {"p_scope": "Process"}, ()),
    "rcv": ("Violated", _DENY_COLUMN | {"p_scope": "View"}, ("viewed", "in_view_clause", "bare")),
    "rrp": ("RowTag", _READ_TABLE | _ROWS, ()),
    "rrv": ("RowTag", _READ_TABLE | _ROWS, ("viewed",)),
}


def _condition(equal: dict[str, str], flags: tuple[str, ...]):
    out = F.lit(True)
    for c, v in equal.items():
        out = out & (F.col(c) == v)
    for f in flags:
        out = out & _FLAGS[f][0]()
    return out


class Policies:
    """Compiled policies on one machine, by role and name: those of a database, a few rows for each name of its schema."""

    #: Rows up to which policies are sent to every task; beyond, references meet them in a join.
    MOST = 200_000

    def __init__(self, rows: list[dict]):
        self.by_name: dict[tuple[str, str], list[dict]] = {}
        self.rows = [{"p_" + k: v for k, v in r.items()} for r in rows]
        for p in self.rows:
            name = ("c", p["p_column_name"]) if p["p_level"] == "Column" else ("t", p["p_table_name"])
            self.by_name.setdefault(((p["p_role"] or "").strip().lower(), *name), []).append(p)

    @staticmethod
    def of(policies: DataFrame) -> "Policies | None":
        """None if there are more than MOST."""
        rows = policies.limit(Policies.MOST + 1).collect()
        return Policies([r.asDict() for r in rows]) if len(rows) <= Policies.MOST else None

    def statuses(self, facts: list[tuple]) -> list[dict]:
        """What node_status() says of the facts of one query."""
        names = [f.strip().split(" ")[0] for f in FACTS.replace("array<struct<table:string,column:string>>", "x").split(",")]
        out: dict[tuple, dict] = {}
        for row in facts:
            node = dict(zip(names, row))
            if node["kind"] not in ("TableRef", "ColumnRef"):
                continue
            on_column, role = node["kind"] == "ColumnRef", (node["role"] or "").strip().lower()
            for table, column in node["refs"]:
                for p in self.by_name.get((role, "c", column) if on_column else (role, "t", table), ()):
                    if on_column and p["p_table_name"] not in (None, table):
                        continue
                    values = node | p
                    for rule, (status, equal, flags) in RULES.items():
                        if all(values[k] == v for k, v in equal.items()) and all(_FLAGS[f][1](node, p) for f in flags):
                            key = (node["query_id"], node["node_id"], node["kind"], table, column, status, p["p_policy_id"], rule, p["p_scope"], p["p_condition"])
                            out[key] = dict(zip(STATUS, key))
        return list(out.values())

    def denied(self, role: str) -> dict[str, set[str]]:
        """Names of tables and columns that the role may not view or not process, by level."""
        out: dict[str, set[str]] = {"table": set(), "column": set()}
        for p in self.rows:
            if p["p_role"] == role and p["p_grant"] == "Prohibited" and p["p_action"] == "Read" and p["p_level"] in ("Table", "Column"):
                name = ".".join(x for x in (p["p_table_name"], p["p_column_name"]) if x) if p["p_level"] == "Column" else p["p_table_name"]
                out[p["p_level"].lower()].add(name)
        return out

    def row_conditions(self, role: str, table: str) -> list[str]:
        return sorted({p["p_condition"] for p in self.rows if p["p_role"] == role and p["p_table_name"] == table and p["p_level"] == "Row" and p["p_grant"] == "Conditional" and p["p_condition"]})


def node_status(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """STATUS rows: every (node, policy, rule) that applies.

    References meet policies once, by role and name; the seven rules are
    conditions on the pairs.
    """
    on_column = F.col("kind") == "ColumnRef"
    refs = references(facts).withColumn("name_key", F.when(on_column, F.concat(F.lit("c "), "ref_column")).otherwise(F.concat(F.lit("t "), "ref_table"))).withColumn("role_key", F.lower(F.trim("role")))
    p = policies.select(*[F.col(c).alias("p_" + c) for c in policies.columns])
    p = p.withColumn("name_key", F.when(F.col("p_level") == "Column", F.concat(F.lit("c "), "p_column_name")).otherwise(F.concat(F.lit("t "), "p_table_name"))).withColumn("role_key", F.lower(F.trim("p_role")))
    pairs = refs.join(p, ["role_key", "name_key"]).filter(~on_column | F.col("p_table_name").isNull() | (F.col("p_table_name") == F.col("ref_table")))
    found = F.filter(F.array(*[F.when(_condition(equal, flags), F.struct(F.lit(s).alias("status"), F.lit(r).alias("rule"))) for r, (s, equal, flags) in RULES.items()]), lambda x: x.isNotNull())
    each = pairs.withColumn("hit", F.explode(found))
    return each.select("query_id", "node_id", "kind", F.col("ref_table").alias("table_name"), F.col("ref_column").alias("column_name"), F.col("hit.status").alias("status"), F.col("p_policy_id").alias("policy_id"), F.col("hit.rule").alias("rule"), F.col("p_scope").alias("scope"), F.col("p_condition").alias("condition")).distinct()


def effective_status(facts: DataFrame, status: DataFrame) -> DataFrame:
    """query_id, node_id, name, status: Violated before RowTag before Aligned, for all table and column nodes."""
    worst = status.groupBy("query_id", "node_id").agg(F.max(F.when(F.col("status") == "Violated", 2).otherwise(1)).alias("w"), F.sort_array(F.collect_set("policy_id")).alias("policies"), F.sort_array(F.collect_set("rule")).alias("rules"))
    nodes = facts.filter(F.col("kind").isin("TableRef", "ColumnRef")).select("query_id", "node_id", "kind", "name")
    named = F.when(F.col("w") == 2, "Violated").when(F.col("w") == 1, "RowTag").otherwise("Aligned")
    return nodes.join(worst, ["query_id", "node_id"], "left").select("query_id", "node_id", "kind", "name", named.alias("status"), "policies", "rules")
