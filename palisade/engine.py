"""The public interface: one object that holds a schema and its policies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.sql_text import parse, render
from palisade.operators import enforce, evaluate, policy, rewrite, rules
from palisade.operators.facts import Schema
from palisade.sources import catalog


class AccessEngine:
    """Decides what a role may read, rewrites queries to that, and runs them.

        engine = AccessEngine(spark).load_frames(frames, access)
        engine.refine_query("SELECT * FROM customer", "analyst")
        engine.execute_query("SELECT * FROM customer", "analyst")
    """

    def __init__(self, spark: SparkSession, strict: bool = True, unknown_roles: str = "deny", timeout: float | None = None):
        self.spark, self.strict, self.unknown_roles, self.timeout = spark, strict, unknown_roles, timeout
        self.name = "palisade_" + uuid.uuid4().hex  # no other engine's views are called so
        self.views: set[str] = set()
        self.schema = Schema({})
        self.frames: dict[str, DataFrame] = {}
        self.policies: DataFrame | None = None
        self.local: rules.Policies | None = None  # the same, unless there are very many
        self.access: DataFrame | None = None
        self.roles: list[str] = []

    def load_context(self, schema_path: str, access_path: str, first_key: int = 1) -> "AccessEngine":
        """Schema and access documents in JSON; tables must be registered as views to be run."""
        self.schema = catalog.schema_from(catalog.columns_of(catalog.read_schema_json(self.spark, schema_path), first_key))
        return self._policies(policy.read_access_json(self.spark, access_path))

    def load_frames(self, frames: dict[str, DataFrame], access: DataFrame) -> "AccessEngine":
        self.frames, self.schema = frames, catalog.schema_of(frames)
        return self._policies(access)

    def _policies(self, access: DataFrame) -> "AccessEngine":
        self.access = access
        return self._compiled(policy.compile_policies(access), [r["role"] for r in policy.roles_of(access).collect()])

    def _compiled(self, policies: DataFrame, roles: list[str]) -> "AccessEngine":
        self.policies, self.roles, self.local = policies, roles, rules.Policies.of(policies)
        if self.local:  # compiled once
            self.policies = self.spark.createDataFrame([{k[2:]: v for k, v in r.items()} for r in self.local.rows], policies.schema)
        return self

    def reset(self) -> "AccessEngine":
        self.close()
        self.__init__(self.spark, self.strict, self.unknown_roles, self.timeout)
        return self

    def role(self, role: str | None) -> str:
        """The role as policies name it; PermissionError for one that nothing knows."""
        own = (role or "").strip().lower()
        if self.unknown_roles == "deny" and own not in self.roles:
            raise PermissionError("unknown role")
        return own

    @property
    def _known(self) -> list[str] | None:
        return self.roles if self.unknown_roles == "deny" else None

    def _queries(self, sql: str | None, role: str) -> DataFrame:
        return self.spark.createDataFrame([("q", role, sql)], "query_id string, role string, sql string")

    def refine_queries(self, queries: DataFrame) -> DataFrame:
        """Batch form over (query_id, role, sql)."""
        return rewrite.refine_queries(queries, self.local or self.policies, self.schema, self._known, self.strict)

    def refine_query(self, sql: str | None, role: str) -> dict:
        """status, refined_query, error, policies, rules; anything that fails is denied."""
        if not self.local:
            return self.refine_queries(self._queries(sql, role)).first().asDict()
        if self._known is not None and (role or "").strip().lower() not in self._known:
            found = ("deny", None, "unknown role", [], [])
        else:
            found = rewrite.refine_one(role, sql, None, self.schema, self.strict, self.local)
        return {"query_id": "q", "role": role, "sql": sql} | dict(zip(("status", "refined_query", "error", "policies", "rules"), found))

    def node_status(self, queries: DataFrame) -> DataFrame:
        facts = rules.query_facts(queries, self.schema, self.strict)
        return rules.effective_status(facts, rules.node_status(facts, self.policies))

    def check_queries(self, queries: DataFrame) -> DataFrame:
        return enforce.check_queries(queries, policy.denied_sets(self.policies), self.schema, self._known)

    def check_query(self, sql: str | None, role: str) -> dict:
        if not self.local:
            return self.check_queries(self._queries(sql, role)).first().asDict()
        own = (role or "").strip().lower()
        known = self._known is None or own in self._known
        decision, reason = enforce.check(role, sql, self.local.denied(own), self.schema) if known else ("deny", "unknown role")
        return {"query_id": "q", "role": role, "decision": decision, "reason": reason, "final_query": sql if decision == "allow" else None}

    def secured_view(self, table: str, role: str, scope: str = "all") -> DataFrame | None:
        return enforce.secured(self.frames[table], table, self.role(role), self.local if self.local and scope == "all" else self.policies, scope)

    def _run(self, sql: str, frames: dict[str, DataFrame], prefix: str) -> DataFrame:
        """sql over these frames and nothing else."""
        views = enforce.named_views(frames, f"{self.name}_{prefix}")
        self.views |= set(views.values())
        text = enforce.over_views(sql, views)
        enforce.read_only(self.spark, text)
        df = self.spark.sql(text)
        enforce.only_reads(df, set(views.values()))
        enforce.no_explosion(df)
        return enforce.within(df, self.timeout)

    def execute_query(self, sql: str, role: str, how: str = "realign") -> DataFrame:
        """Run what the role may run: realign rewrites, dbms checks and runs unchanged, view runs over secured views."""
        own = self.role(role)
        if how == "view":
            return self._run(sql, enforce.secured_frames(self.frames, own, self.local or self.policies), own.encode().hex() + "_view")
        if how not in ("realign", "dbms"):
            raise ValueError(f"no way {how}")
        found = self.check_query(sql, own) if how == "dbms" else self.refine_query(sql, own)
        if (found["decision"] if how == "dbms" else found["status"]) != "allow":
            raise PermissionError(found["reason"] if how == "dbms" else found["error"])
        text = found["final_query"] if how == "dbms" else found["refined_query"]
        return self._run(render(rewrite.with_any_value(parse(text))), self.frames, "table")

    def answer(self, sql: str, role: str = "public", how: str = "realign") -> dict:
        """status, error and result (a DataFrame, null unless allowed): execute_query without exceptions."""
        try:
            return {"status": "allow", "error": None, "result": self.execute_query(sql, role, how)}
        except Exception as e:
            return {"status": "deny", "error": str(e).split("\n")[0], "result": None}

    def runs(self, sql: str, timeout: float = 5.0) -> bool:
        """Whether a query over the tables, without any rules, gives its first row in time."""
        try:
            df = self._run(sql, self.frames, "table")
            enforce.within(df, timeout)
            return True
        except Exception:
            return False

    def previews(self, candidates: list[str], role: str | None = None, how: str = "realign", rows: int = 5, title: str = "Candidate") -> str:
        """Text: each candidate query that runs (for a role: that it may run) and its first rows."""
        from palisade.operators.retrieve import markdown

        parts = []
        for i, sql in enumerate(candidates):
            try:
                df = self.execute_query(sql, role, how) if role is not None else self._run(sql, self.frames, "table")
                shown = markdown(df.columns, [tuple(r) for r in df.limit(rows).collect()])
            except Exception:
                continue
            parts.append(f"{title} {i}:\n{sql}\nFive rows from the database execution results: \n{shown}\n\n")
        return "".join(parts)

    def save(self, path: str) -> None:
        """Schema, compiled policies and roles as tables below path."""
        rows = [(t, i, c, self.schema.title(t), self.schema.shown(c)) for t, cs in self.schema.tables.items() for i, c in enumerate(cs)]
        self.spark.createDataFrame(rows, "table_key string, ordinal int, column_key string, table_name string, column_name string").write.mode("overwrite").parquet(f"{path}/schema")
        self.policies.write.mode("overwrite").parquet(f"{path}/policies")
        self.spark.createDataFrame([(r,) for r in self.roles], "role string").write.mode("overwrite").parquet(f"{path}/roles")

    def load_saved(self, path: str, frames: dict[str, DataFrame] | None = None) -> "AccessEngine":
        """What save() wrote."""
        self.schema = catalog.schema_from(self.spark.read.parquet(f"{path}/schema"))
        self.frames, self.access = frames or {}, None
        return self._compiled(self.spark.read.parquet(f"{path}/policies"), [r["role"] for r in self.spark.read.parquet(f"{path}/roles").collect()])

    def statistics(self) -> dict[str, int]:
        """Numbers of tables, columns, roles and policies."""
        policies = self.policies.select("policy_id").distinct().count() if self.policies is not None else 0
        return {"tables": len(self.schema.tables), "columns": sum(map(len, self.schema.tables.values())), "roles": len(self.roles), "policies": policies}

    def evaluate(self, samples: DataFrame) -> DataFrame:
        return evaluate.evaluate(samples, self.schema)

    def summarize(self, rows: DataFrame) -> DataFrame:
        return evaluate.mode_summary(rows)

    def close(self) -> None:
        """Drop the views of this engine; the session's other views are never touched."""
        for name in self.views:
            self.spark.catalog.dropTempView(name)
        self.views = set()


class ContextCache:
    """What has been loaded for a database, by key; the oldest goes when there are `most`."""

    def __init__(self, most: int = 16):
        self.most, self.held = most, {}

    def get(self, key, make):
        if key not in self.held:
            while len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
            self.held[key] = make()
        return self.held[key]

    def clear(self) -> None:
        self.held.clear()
