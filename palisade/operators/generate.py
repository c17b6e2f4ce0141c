"""Deterministic generation of role-specific benchmark queries."""

from __future__ import annotations

import hashlib
import random
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.names import alias_name, is_numeric_type, quote

#: Aggregates that numeric columns take in turn.  Fixed values.
CYCLE = ("AVG", "SUM", "MIN", "MAX")


def edges(foreign: DataFrame) -> DataFrame:
    """a, b, a_column, b_column: foreign keys in both directions, without loops."""
    one = foreign.select(F.col("from_table").alias("a"), F.col("to_table").alias("b"), F.col("from_column").alias("a_column"), F.col("to_column").alias("b_column"))
    two = one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_column").alias("a_column"), F.col("a_column").alias("b_column"))
    return one.unionByName(two).filter("a <> b").distinct()


class SchemaGraph:
    """Tables and the keys that join them; a handful of nodes, walked on the driver."""

    def __init__(self, links: list[tuple[str, str, str, str]]):
        self.next: dict[str, list[tuple[str, str, str]]] = {}
        for a, b, x, y in sorted(links):
            self.next.setdefault(a, []).append((b, x, y))

    def components(self, tables: list[str]) -> list[list[str]]:
        """Sets of the tables that keys among them connect, each sorted; by first table."""
        left, out = set(tables), []
        for t in sorted(tables):
            if t in left:
                seen, todo = {t}, deque([t])
                while todo:
                    for b, *_ in self.next.get(todo.popleft(), []):
                        if b in left and b not in seen:
                            seen.add(b)
                            todo.append(b)
                left -= seen
                out.append(sorted(seen))
        return out

    def plan(self, tables: list[str], root: str) -> list[tuple[str, str, str, str]]:
        """(table, column, joined table, its column) in breadth-first order from root."""
        seen, todo, out = {root}, deque([root]), []
        while todo:
            a = todo.popleft()
            for b, x, y in self.next.get(a, []):
                if b in tables and b not in seen:
                    seen.add(b)
                    todo.append(b)
                    out.append((a, x, b, y))
        return out


def best_component(components: list[list[str]], projection: dict[str, list[str]], process: dict[str, list[str]]) -> list[str]:
    """The component with most: usable first, then all columns, process columns, projected columns, tables."""
    def key(c: list[str]):
        p, q = sum(len(projection.get(t, [])) for t in c), sum(len(process.get(t, [])) for t in c)
        return bool(p and q), p + q, q, p, len(c)

    return max(components, key=key) if components else []


def aggregate_of(column: str, numeric: bool, i: int) -> str:
    return f"{CYCLE[i % 4]}({column})" if numeric else f"COUNT(DISTINCT {column})"


@dataclass
class Template:
    """Columns as (table, column): shown, and used for filtering or grouping."""

    projection: list[tuple[str, str]]
    process: list[tuple[str, str]]
    numeric: frozenset = frozenset()


def aliases(tables: list[str]) -> dict[str, str]:
    return {t: f"t{i}" for i, t in enumerate(sorted(tables), 1)}


def from_clause(graph: SchemaGraph, tables: list[str]) -> str:
    a, root = aliases(tables), sorted(tables)[0]
    out = f"FROM {quote(root)} AS {a[root]}"
    for left, x, right, y in graph.plan(tables, root):
        out += f" JOIN {quote(right)} AS {a[right]} ON {a[left]}.{quote(x)} = {a[right]}.{quote(y)}"
    return out


def conditions(columns: list[str], numeric: list[bool], most: int = 3) -> str:
    return " AND ".join(f"{c} IS NOT NULL" + (f" AND {c} >= 0" if n else "") for c, n in list(zip(columns, numeric))[:most])


#: Columns of a condition, of a grouping and of aggregates, at most.  Fixed values.
MOST_CONDITIONS, MOST_GROUPED, MOST_AGGREGATES = 3, 3, 4


@dataclass
class Built:
    """A query, what it uses of the template, and what could not be joined; without a query the reason."""

    query: str | None
    projection: list[str]
    process: list[str]
    lost_tables: list[str]
    lost_columns: list[str]
    reason: str | None = None


def _aggregated(used: list, grouped: list, shown: list, filter_only: bool) -> list:
    """Columns to aggregate: first those that are neither shown nor grouped, then by preference."""
    kind = lambda x: (x in shown, x in grouped)
    free, in_group, on_show, both = ([x for x in used if kind(x) == k] for k in ((False, False), (False, True), (True, False), (True, True)))
    if filter_only:
        return (free + in_group or on_show + both)[: max(1, min(MOST_AGGREGATES, len(used)))]
    return next((b for b in (free, on_show, in_group, both) if b), [])[: max(1, min(MOST_AGGREGATES, len(used)))]


def built(mode: str, t: Template, graph: SchemaGraph, filter_only: bool = False) -> Built:
    """The query of a template in a mode (where, group_by, aggregate), over the component with most columns.

    group_by groups by the first process columns (and by what is shown) and
    aggregates others; aggregate aggregates process columns for what is shown.
    filter_only groups by process columns alone, or not at all; what is shown
    beside is any value of the group.
    """
    projection: dict[str, list[str]] = {}
    process: dict[str, list[str]] = {}
    for d, cs in ((projection, t.projection), (process, t.process)):
        for table, c in cs:
            d.setdefault(table, []).append(c)
    every = sorted({*projection, *process})
    tables = best_component(graph.components(every), projection, process)
    key = lambda xs: [f"{a}.{b}" for a, b in xs]
    lost = [x for x in [*t.projection, *t.process] if x[0] not in tables]
    outcome = lambda q, p, u, why=None: Built(q, key(p), key(u), sorted(set(every) - set(tables)), sorted(set(key(lost))), why)
    shown, used = [x for x in t.projection if x[0] in tables], [x for x in t.process if x[0] in tables]
    if not shown or not used:
        return outcome(None, [], [], "no_projection_columns" if not shown else "no_process_columns")
    a, source = aliases(tables), from_clause(graph, tables)
    name = lambda tc: f"{a[tc[0]]}.{quote(tc[1])}"
    if mode == "where":
        text = f"SELECT {', '.join(map(name, shown))} {source} WHERE {conditions([name(x) for x in used], [x in t.numeric for x in used], MOST_CONDITIONS)}"
        return outcome(text, shown, used[:MOST_CONDITIONS])
    if mode not in ("group_by", "aggregate"):
        return outcome(None, [], [], f"unsupported_mode:{mode}")
    grouped = used[:MOST_GROUPED] if mode == "group_by" else []
    if mode == "group_by":
        targets = _aggregated(used, grouped, shown, filter_only)
    elif filter_only:
        targets = used
    else:
        free = [x for x in used if x not in shown]
        targets = (free or used)[:MOST_AGGREGATES]
        if not free and len(used) > 1:  # all are shown: one stays as it is
            targets = targets[: len(used) - 1]
        if all(x in targets for x in shown):
            targets = [x for x in targets if x != shown[0]]
    rest = [x for x in shown if x not in targets]
    calls = []
    for i, x in enumerate(targets):
        call = aggregate_of(name(x), x in t.numeric, i)
        calls.append(f"{call} AS {quote(call.split('(')[0].lower() + '_' + alias_name('.'.join(x)))}")
    keys = grouped if filter_only else list(dict.fromkeys([*grouped, *rest]))
    loose = [x for x in rest if x not in keys]  # a bare column beside aggregates
    items = [f"ANY_VALUE({name(x)}) AS {quote(x[1])}" if x in loose else name(x) for x in rest] + calls
    text = f"SELECT {', '.join(items)} {source}" + (f" GROUP BY {', '.join(map(name, keys))}" if keys else "")
    return outcome(text, rest, list(dict.fromkeys([*grouped, *targets])))


def build(mode: str, t: Template, graph: SchemaGraph, filter_only: bool = False) -> str | None:
    return built(mode, t, graph, filter_only).query


def view_query(columns: list[tuple[str, str]], graph: SchemaGraph, distinct: bool = False, order: tuple[tuple[str, str], str] | None = None, limit: int | None = None) -> str:
    tables = sorted({t for t, _ in columns})
    a = aliases(tables)
    name = lambda tc: f"{a[tc[0]]}.{quote(tc[1])}"
    out = f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(map(name, columns))} {from_clause(graph, tables)}"
    if order:
        out += f" ORDER BY {name(order[0])} {order[1]}"
    return out + (f" LIMIT {limit}" if limit else "")


def rng(seed: int, db_id: str) -> random.Random:
    """The same numbers for a seed and a database everywhere."""
    return random.Random(int(hashlib.sha256(f"{seed}:{db_id}".encode()).hexdigest()[:16], 16))


def templates(projection: list[tuple[str, str]], process: list[tuple[str, str]], numeric: set, n: int, seed: int, db_id: str, widest: int = 4) -> list[Template]:
    """Up to n distinct templates; gives up after 50 n attempts."""
    r, seen, out = rng(seed, db_id), set(), []
    for _ in range(50 * n):
        if len(out) == n or not projection or not process:
            break
        p = tuple(sorted(r.sample(sorted(projection), r.randint(1, min(widest, len(projection))))))
        q = tuple(sorted(r.sample(sorted(process), r.randint(1, min(widest, len(process))))))
        if (p, q) not in seen:
            seen.add((p, q))
            out.append(Template(list(p), list(q), frozenset(numeric)))
    return out


def role_copies(templates_: DataFrame, pools: DataFrame) -> DataFrame:
    """template_id, role and what is left of projection and process for the role, what is dropped, and whether it is usable.

    templates_: template_id, projection, process (arrays of table.column); pools: role_pools().
    """
    key = F.concat_ws(".", "table_name", "column_name")
    sets = pools.groupBy("role").agg(F.collect_set(F.when(F.col("projection"), key)).alias("may_view"), F.collect_set(F.when(F.col("process"), key)).alias("may_process"))
    each = templates_.crossJoin(sets)  # templates by roles
    left = lambda c, may: F.filter(F.col(c), lambda x: F.array_contains(may, x))
    out = each.select("template_id", "role", left("projection", "may_view").alias("projection_columns"), left("process", "may_process").alias("process_columns"), F.array_except("projection", "may_view").alias("dropped_projection"), F.array_except("process", "may_process").alias("dropped_process"))
    return out.withColumn("is_usable", (F.size("projection_columns") > 0) & (F.size("process_columns") > 0))


def view_copies(templates_: DataFrame, pools: DataFrame, classes: DataFrame) -> DataFrame:
    """template_id, role, projection_columns, dropped_projection, order_by_column, dropped_order_by, is_usable of view-only templates (template_id, projection, order_by).

    Where a role may not see the order column, its first S0 column that it sees
    takes its place; classes: column (table.column), category.
    """
    key = F.concat_ws(".", "table_name", "column_name")
    sets = pools.groupBy("role").agg(F.collect_set(F.when(F.col("projection"), key)).alias("may_view"))
    plain = classes.filter("category = 'S0'").agg(F.collect_set("column").alias("plain"))
    each = templates_.crossJoin(sets).crossJoin(F.broadcast(plain))  # templates by roles, and one row
    may = lambda c: F.array_contains("may_view", c)
    out = each.withColumn("projection_columns", F.filter("projection", may)).withColumn("dropped_projection", F.filter("projection", lambda c: ~may(c)))
    other = F.get(F.filter("projection_columns", lambda c: F.array_contains("plain", c)), 0)
    out = out.withColumn("order_by_column", F.when(may(F.col("order_by")), F.col("order_by")).otherwise(other)).withColumn("dropped_order_by", F.when(may(F.col("order_by")), F.array().cast("array<string>")).otherwise(F.array("order_by")))
    usable = (F.size("projection_columns") > 0) & F.col("order_by_column").isNotNull()
    return out.select("template_id", "role", "projection_columns", "dropped_projection", "order_by_column", "dropped_order_by", usable.alias("is_usable"))


_BUILT = "query string, used_projection array<string>, used_process array<string>, lost_tables array<string>, lost_columns array<string>, reason string"


def queries_of(rows: DataFrame, links: list[tuple[str, str, str, str]], numeric: set[str], modes: tuple[str, ...] = ("where", "group_by", "aggregate"), filter_only: bool = False) -> DataFrame:
    """template_id, role, mode and what built() makes of projection and process (arrays of table.column) in each mode."""
    split = lambda xs: [tuple(x.rsplit(".", 1)) for x in xs]

    def run(batches):
        graph, numbers = SchemaGraph(links), frozenset(split(sorted(numeric)))
        for pdf in batches:
            out = []
            for template, role, shown, used in pdf.itertuples(index=False):
                for mode in modes:
                    b = built(mode, Template(split(shown), split(used), numbers), graph, filter_only)
                    out.append((template, role, mode, b.query, b.projection, b.process, b.lost_tables, b.lost_columns, b.reason))
            yield pd.DataFrame(out, columns=["template_id", "role", "mode", "query", "used_projection", "used_process", "lost_tables", "lost_columns", "reason"])

    return rows.select("template_id", "role", "projection", "process").mapInPandas(run, "template_id string, role string, mode string, " + _BUILT)


def case_records(copies: DataFrame, queries: DataFrame) -> DataFrame:
    """template_id, mode, base_query, base_reason and role_expected: map from role to its expected query, what it uses, and what it drops against the base.

    What is dropped is told apart by whether a policy took it; queries:
    queries_of() of the templates (role null) and of the roles' copies.
    """
    base = queries.filter("role IS NULL").select("template_id", "mode", F.col("query").alias("base_query"), F.col("reason").alias("base_reason"), F.col("used_projection").alias("b_projection"), F.col("used_process").alias("b_process"))
    own = queries.filter("role IS NOT NULL").join(copies.select("template_id", "role", "dropped_projection", "dropped_process"), ["template_id", "role"]).join(base, ["template_id", "mode"])
    gone = lambda part: F.array_sort(F.array_except(f"b_{part}", f"used_{part}"))
    value = F.struct(
        F.col("query").alias("expected_query"), F.col("used_projection").alias("used_projection_columns"), F.col("used_process").alias("used_process_columns"),
        F.array_intersect(gone("projection"), "dropped_projection").alias("dropped_restricted_projection"), F.array_intersect(gone("process"), "dropped_process").alias("dropped_restricted_process"),
        F.array_except(gone("projection"), "dropped_projection").alias("dropped_not_restricted_projection"), F.array_except(gone("process"), "dropped_process").alias("dropped_not_restricted_process"),
        F.col("lost_tables").alias("dropped_disconnected_tables"), F.col("lost_columns").alias("dropped_disconnected_columns"), F.col("query").isNotNull().alias("is_usable"), F.col("reason").alias("reason_unusable"),
    )
    packed = own.groupBy("template_id", "mode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", value)))).alias("role_expected"))
    return base.drop("b_projection", "b_process").join(packed, ["template_id", "mode"], "left")


def question(mode: str, projection: list[str], process: list[str]) -> str:
    """A plain question for a template."""
    shown, used = ", ".join(projection), ", ".join(process)
    if not projection:
        return f"Summarise {used}."
    return {
        "where": f"Show {shown} where {used} are known.",
        "group_by": f"Group the rows by {used}, show {shown} and summarise.",
        "aggregate": f"Summarise {used} for each {shown}.",
        "view_ops": f"List {shown}.",
    }[mode]


def naturalized(records: DataFrame, rewrite=None) -> DataFrame:
    """records with question_naturalized: rewrite(question) on the executors; without one, or where it fails, the question."""
    if rewrite is None:
        return records.withColumn("question_naturalized", F.col("question"))

    @F.pandas_udf(T.StringType())
    def again(questions: pd.Series) -> pd.Series:
        def one(q):
            try:
                return rewrite(q) or q
            except Exception:
                return q

        return questions.map(one)

    return records.withColumn("question_naturalized", again("question"))


def benchmark(columns: DataFrame, foreign: DataFrame, pools: DataFrame, global_pool: DataFrame, db_id: str, n: int = 10, seed: int = 13, filter_only: bool = False, rewrite=None) -> DataFrame:
    """Flat benchmark rows of a database from end to end: templates, roles' copies, queries, case records, questions, rows.

    columns: table_name, column_name, data_type; foreign: foreign keys; pools:
    role_pools(); global_pool: global_projection_pool(), from which filter_only
    takes what it shows.
    """
    spark = columns.sparkSession
    cells = [(r["table_name"].lower(), r["column_name"].lower(), r["number"]) for r in columns.select("table_name", "column_name", is_numeric_type(F.col("data_type")).alias("number")).distinct().collect()]  # a schema
    every, numeric = sorted((t, c) for t, c, _ in cells), {f"{t}.{c}" for t, c, x in cells if x}
    shown = sorted((r["table_name"], r["column_name"]) for r in global_pool.collect()) if filter_only else every
    made = templates(shown, every, set(), n, seed, db_id)
    key = lambda xs: [f"{t}.{c}" for t, c in xs]
    frame = spark.createDataFrame([(f"t{i:03d}", key(t.projection), key(t.process)) for i, t in enumerate(made, 1)], "template_id string, projection array<string>, process array<string>")
    links = [tuple(r) for r in edges(foreign).select("a", "b", "a_column", "b_column").collect()]
    copies = role_copies(frame, pools)
    rows = frame.withColumn("role", F.lit(None).cast("string")).select("template_id", "role", "projection", "process").unionByName(copies.select("template_id", "role", F.col("projection_columns").alias("projection"), F.col("process_columns").alias("process")))
    queries = queries_of(rows, links, numeric, filter_only=filter_only)
    records = case_records(copies, queries).join(queries.filter("role IS NULL").select("template_id", "mode", "used_projection", "used_process"), ["template_id", "mode"])

    @F.pandas_udf(T.StringType())
    def asked(mode: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([question(m, list(a), list(b)) for m, a, b in zip(mode, p, q)])

    kind = "filter_only" if filter_only else "view_and_filter"
    records = records.withColumn("question", asked("mode", "used_projection", "used_process"))
    return flat_rows(naturalized(records, rewrite).select(F.lit(db_id).alias("db_id"), "template_id", "mode", F.col("question_naturalized").alias("question"), "base_query", F.lit(f"qa_{kind}_pairs.json").alias("source_file"), "role_expected"))


def question_type(file_name) -> F.Column:
    f = F.lower(file_name)
    return F.when(f.contains("view_and_filter"), "view_and_filter").when(f.contains("filter_only"), "filter_only").when(f.contains("view_only"), "view_only").otherwise("unknown")


def flat_rows(records: DataFrame) -> DataFrame:
    """question_id (from 1 in each database), db_id, role, question, evidence, expected queries, type and metadata, from case records."""
    each = records.select("db_id", "template_id", "mode", "question", "base_query", "source_file", F.explode("role_expected").alias("role", "e"))
    number = F.row_number().over(W.partitionBy("db_id").orderBy("source_file", "template_id", "mode", "role"))
    metadata = F.struct(F.col("e.is_usable").alias("queryable"), F.col("e.used_projection_columns").alias("allowed_view_columns"), F.col("e.used_process_columns").alias("allowed_process_columns"), "template_id", "mode", "source_file", F.col("e.reason_unusable").alias("reason_unusable"))
    return each.select(
        number.alias("question_id"), "db_id", "role", "question", F.lit("").alias("evidence"), F.lit(False).alias("evidence_added"), F.col("base_query").alias("intent_preserving_expected_query"),
        F.col("e.expected_query").alias("privacy_preserving_expected_query"), question_type(F.col("source_file")).alias("question_type"), F.col("e.is_usable").alias("queryable"), "template_id", "mode", metadata.alias("metadata"),
    )
