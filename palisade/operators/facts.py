"""Name resolution and node facts: a query becomes rows that rules can join with policies."""

from __future__ import annotations

from dataclasses import dataclass, field

from palisade.functions.names import norm
from palisade.functions.sql_text import CLAUSES, Node, try_parse

#: Functions that shield a column from view rules.  Fixed values.
SHIELDS = ("sum", "count", "avg", "max", "min")
#: Category of a node; kinds that are missing are transparent: their children hang on the grandparent.
CATEGORY = {
    "Column": "ColumnRef", "Table": "TableRef", "Function": "Function", "Alias": "Alias", "Star": "Wildcard", "Literal": "Literal",
    "And": "Operator", "Or": "Operator", "Compare": "Operator", "Like": "Operator", "Between": "Operator", "In": "Operator", "Exists": "Operator",
    "Ordered": "Ordered", "Subquery": "Subquery", "Cte": "CTE",
}
CLAUSE_NAME = {k: k if k.endswith("Clause") else k + "Clause" for k in CLAUSES}
#: What a clause does with what it names.  Fixed values; ordering does nothing.
CLAUSE_SCOPES = {
    "DeleteClause": ["Delete"], "FromClause": ["View", "Process"], "GroupByClause": ["Process"], "HavingClause": ["Process"], "JoinClause": ["Process"],
    "LimitClause": ["Process"], "SetClause": ["Process"], "ValuesClause": ["Process"], "WhereClause": ["Process"], "InsertClause": ["Insert"],
    "SelectClause": ["View"], "UpdateClause": ["Update"], "WithClause": ["View", "Process"], "OrderByClause": [],
}
ACTIONS = {"Select": "Read", "SetOp": "Read", "Insert": "Modify", "Update": "Modify", "Delete": "Modify"}


class ResolveError(ValueError):
    """A name stands for nothing."""


@dataclass
class Source:
    """A relation in a FROM list: its base table, or the lineage of each output column."""

    alias: str
    table: str | None = None
    outputs: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    #: Outputs that USING or NATURAL has merged into another relation's; by name the two of a full join.
    hidden: set[str] = field(default_factory=set)
    merged: dict[str, tuple["Source", "Source"]] = field(default_factory=dict)


@dataclass
class Schema:
    """Tables and their columns, by lower-case name, in order; small, as it describes tables and holds none."""

    tables: dict[str, list[str]]
    names: dict[str, str] = field(default_factory=dict)  # of columns, lower case to the name as given
    titles: dict[str, str] = field(default_factory=dict)  # the same of tables
    databases: frozenset[str] = frozenset()  # qualifiers that tables may carry

    @staticmethod
    def of(tables: dict[str, list[str]]) -> "Schema":
        names = {norm(c): c for cs in tables.values() for c in cs}
        return Schema({norm(t): [norm(c) for c in cs] for t, cs in tables.items()}, names, {norm(t): t for t in tables})

    def shown(self, name: str) -> str:
        return self.names.get(name, name)

    def title(self, name: str) -> str:
        return self.titles.get(name, name)


class Resolver:
    """Expands stars, numbers nodes by path, and tells for every table and column node what it stands for."""

    def __init__(self, schema: Schema):
        self.schema = schema

    def resolve(self, tree: Node) -> Node:
        self.number(tree, "0")
        if tree.kind in ("Select", "SetOp"):
            self.query(tree, {}, [])
        else:
            self.modify(tree)
        self.number(tree, "0")
        return tree

    def number(self, n: Node, path: str) -> None:
        n.extra["id"] = path
        for i, c in enumerate(n.children):
            self.number(c, f"{path}.{i}")

    def modify(self, tree: Node) -> None:
        target = tree.children[0].children[0]
        source = self.table(target, {})
        for c in tree.children[0].children[1:]:
            c.extra["refs"] = [(source.table, norm(c.name))]
        for part in tree.children[1:]:
            if part.kind in ("Select", "SetOp"):
                self.query(part, {}, [])
            else:
                self.expression(part, [source], [], {})

    def table(self, n: Node, ctes: dict) -> Source:
        name, alias = norm(n.name), norm(n.extra.get("alias") or n.name)
        self.qualifier(n)
        if name in ctes:
            n.extra["cte"] = True
            return Source(alias, None, ctes[name])
        if name not in self.schema.tables:
            raise ResolveError(f"unknown table {n.name}")
        n.extra["base"] = name
        return Source(alias, name, {c: [(name, c)] for c in self.schema.tables[name]})

    def qualifier(self, n: Node) -> None:
        """Only names of this catalog stand; its own qualifier goes."""
        given = n.extra.get("qualifier")
        if given and norm(given) not in self.schema.databases:
            raise ResolveError(f"unknown database {given}")
        n.extra["qualifier"] = ""

    def merge(self, part: Node, left: list[Source], right: Source) -> None:
        """Turn USING and NATURAL into an ON condition, so that their columns meet the rules as all others do."""
        natural = "NATURAL" in part.name.split()
        seen = {c for s in left for c in s.outputs if c not in s.hidden}
        names = [c for c in right.outputs if c in seen] if natural else [norm(c) for c in part.extra.get("using") or []]
        if not natural and not names:
            return
        pairs = []
        for c in names:
            owner = next((s for s in left if c in s.outputs and c not in s.hidden), None)
            if owner is None or c not in right.outputs:
                raise ResolveError(f"unknown column {c}")
            if not owner.alias or not right.alias:
                raise ResolveError("a relation joined by column names needs a name")
            if part.name.startswith("FULL"):
                owner.merged[c] = (owner, right)
                right.hidden.add(c)
            elif part.name.startswith("RIGHT"):
                owner.hidden.add(c)
            else:
                right.hidden.add(c)
            pairs.append(Node("Compare", "=", [self.qualified(c, owner), self.qualified(c, right)]))
        part.name = " ".join(w for w in part.name.split() if w != "NATURAL")
        part.extra["using"] = []
        if pairs:
            part.children = [part.children[0], pairs[0] if len(pairs) == 1 else Node("And", "", pairs)]

    def qualified(self, column: str, source: Source) -> Node:
        return Node("Column", self.schema.shown(column), [], {"table": self.schema.title(source.alias)})

    def query(self, n: Node, ctes: dict, outer: list[list[Source]]) -> dict[str, list]:
        """Lineage of the outputs by name."""
        if n["With"]:
            ctes = dict(ctes)
            for c in n["With"].children:
                if n["With"].extra.get("recursive"):
                    first = c.children[0]
                    while first.kind == "SetOp":
                        first = next(x for x in first.children if x.kind in ("Select", "SetOp"))
                    ctes[norm(c.name)] = {norm(x.name): [] for x in first["SelectClause"].children if x.kind in ("Alias", "Column")}
                ctes[norm(c.name)] = self.query(c.children[0], ctes, outer)
        if n.kind == "SetOp":
            sides = [self.query(x, ctes, outer) for x in n.children if x.kind in ("Select", "SetOp")]
            out = {k: v + w for (k, v), w in zip(sides[0].items(), sides[1].values())}
            if n["OrderBy"]:
                self.expression(n["OrderBy"], [Source("", None, out)], outer, ctes)
            return out
        sources: list[Source] = []
        for part in n.children:
            if part.kind in ("From", "Join"):
                relations = part.children if part.kind == "From" else part.children[:1]
                for r in relations:
                    if r.kind == "Table":
                        r.extra["source"] = source = self.table(r, ctes)
                    else:
                        source = Source(norm(r.extra.get("alias")), None, self.query(r.children[0], ctes, outer + [sources]))
                        r.extra["source"] = source
                    if part.kind == "Join":
                        self.merge(part, sources, source)
                    sources.append(source)
        select = n["SelectClause"]
        select.children = [y for x in select.children for y in self.expanded(x, sources)]
        names = [x.name if x.kind == "Column" else "" for x in select.children]
        self.expression(select, sources, outer, ctes)
        select.children = [Node("Alias", c, [x]) if c and x.kind == "Function" else x for c, x in zip(names, select.children)]
        out: dict[str, list] = {}
        for i, x in enumerate(select.children):
            name = norm(x.name) if x.kind in ("Alias", "Column") else f"_{i}"
            out.setdefault(name, [r for y in x.walk() for r in y.extra.get("refs", [])])
        for part in n.children:
            if part.kind == "Join" and len(part.children) > 1:
                self.expression(part.children[1], sources, outer, ctes)
            elif part.kind in ("Where", "GroupBy", "Having", "OrderBy", "Limit"):
                self.expression(part, sources, outer, ctes, out if part.kind != "Where" else {})
        return out

    def expanded(self, x: Node, sources: list[Source]) -> list[Node]:
        if x.kind != "Star":
            return [x]
        own = [s for s in sources if not x.extra.get("table") or s.alias == norm(x.extra["table"])]
        if not own:
            raise ResolveError(f"unknown table {x.extra.get('table')}")
        many = len(sources) > 1
        out = []
        for s in own:
            for c in s.outputs:
                if c in s.hidden and not x.extra.get("table"):
                    continue
                if c in s.merged and not x.extra.get("table"):
                    out.append(Node("Alias", self.schema.shown(c), [Node("Column", self.schema.shown(c), [], {"table": ""})]))
                else:
                    out.append(Node("Column", self.schema.shown(c), [], {"table": self.schema.title(s.alias) if many or s.table else "", "star": True}))
        return out

    def expression(self, n: Node, sources: list[Source], outer: list[list[Source]], ctes: dict, aliases: dict | None = None) -> None:
        if n.kind in ("Select", "SetOp"):
            self.query(n, ctes, outer + [sources])
            return
        if n.kind == "Column":
            self.column(n, sources, outer, aliases or {})
        for c in n.children:
            self.expression(c, sources, outer, ctes, aliases)

    def column(self, n: Node, sources: list[Source], outer: list[list[Source]], aliases: dict) -> None:
        name, table = norm(n.name), norm(n.extra.get("table"))
        self.qualifier(n)
        for level in [sources, *reversed(outer)]:
            shared = any(name in s.hidden for s in level)
            for s in level:
                if (s.alias == table if table else name not in s.hidden) and name in s.outputs:
                    if not table and name in s.merged:  # the first value of a full join's two
                        n.kind, n.name, n.extra = "Function", "coalesce", {"distinct": False, "id": n.extra.get("id")}
                        n.children = [self.qualified(name, x) for x in s.merged[name]]
                        return  # the walk goes on with the two
                    if not table and shared:
                        n.extra["table"] = self.schema.title(s.alias)
                    n.extra |= {"refs": s.outputs[name], "owner": s}
                    return
        if not table and name in aliases:
            n.extra |= {"refs": aliases[name], "by_alias": name}
            return
        if not table and n.extra.get("quoted"):  # some dialects read a quoted unknown name as a string
            n.kind, n.name = "Literal", "'" + n.name.replace("'", "''") + "'"
            return
        raise ResolveError(f"unknown column {n.extra.get('table') + '.' if table else ''}{n.name}")


FACTS = (
    "query_id string, role string, action string, stmt_scopes array<string>, node_id string, parent_id string, logical_parent_id string, depth int, ord int, kind string, name string, clause string, "
    "top_clause string, eff_scopes array<string>, clause_scopes array<string>, shielded boolean, ref_alias string, refs array<struct<table:string,column:string>>, text string"
)


def facts(query_id: str, role: str, tree: Node, strict: bool = True) -> list[tuple]:
    """Rows (FACTS) of a resolved tree in pre-order.

    The top clause is the outermost clause around a node, where every branch
    of a set operation counts as a statement.  strict: what a joined subquery
    selects counts as viewed too.
    """
    rows: list[tuple] = []
    action = ACTIONS[tree.kind]
    stmt_scopes = sorted({s for c in tree.children if c.kind in CLAUSE_NAME for s in CLAUSE_SCOPES[CLAUSE_NAME[c.kind]]})

    def visit(n: Node, parent: str | None, logical: tuple[str | None, bool], clause: str, top: str, depth: int, order: int, joined: bool) -> None:
        here = n.extra["id"]
        statement, is_clause = n.kind in ACTIONS, n.kind in CLAUSE_NAME
        if is_clause:
            clause = CLAUSE_NAME[n.kind]
            top = top or clause
        kind = CLAUSE_NAME.get(n.kind) or CATEGORY.get(n.kind) or ({"SetOp": "Select"}.get(n.kind, n.kind) + "Statement" if statement else n.kind)
        if kind == "Function" and n.name.lower() not in SHIELDS:
            kind = "OtherFunction"
        mapped = statement or is_clause or kind in set(CATEGORY.values())
        effective = list(CLAUSE_SCOPES.get(top, []))
        if strict and top == "JoinClause" and joined and "View" not in effective:
            effective = ["View"] + effective
        refs = [(t, c) for t, c in n.extra.get("refs", [])] if n.kind == "Column" else [(n.extra["base"], None)] if n.kind == "Table" and "base" in n.extra else []
        name = n.name or n.extra.get("alias") or ""
        alias = n.extra.get("alias") or n.extra.get("table") or None
        rows.append((query_id, role, action, stmt_scopes, here, parent, logical[0], depth, order, kind, name, clause or None, top or None, effective, list(CLAUSE_SCOPES.get(clause, [])), logical[1], alias, list(dict.fromkeys(refs)), n.name if n.kind == "Literal" else None))
        logical = (here, kind == "Function") if mapped else logical
        for i, c in enumerate(n.children):
            inner = top if not (n.kind == "SetOp" and c.kind in ("Select", "SetOp") and not top) else ""
            visit(c, here, logical, clause, inner, depth + 1, i, joined or n.kind == "Join" and c.kind == "Subquery")

    visit(tree, None, (None, False), "", "", 0, 0, False)
    return rows


def analyse(query_id: str, role: str, sql: str | None, schema: Schema, strict: bool = True) -> tuple[Node | None, list[tuple], str | None]:
    """(resolved tree, facts, None), or (None, [], error)."""
    tree, error = try_parse(sql)
    if error:
        return None, [], error
    try:
        tree = Resolver(schema).resolve(tree)
        return tree, facts(query_id, role, tree, strict), None
    except (ResolveError, KeyError, StopIteration) as e:
        return None, [], str(e)
