"""Policies: compilation to rows, deny and allowed sets, classification, the base matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions.names import column_phrase_of, norm_col, table_phrase_of

POLICY_FIELDS = ("id", "effect", "action", "scope", "level", "categories", "roles", "table", "column", "condition", "predicate")
_POLICY = (
    "struct<id:string,effect:string,action:string,scope:string,level:string,categories:array<string>,roles:array<string>,`table`:string,`column`:string,condition:string,"
    "predicate:struct<`table`:string,`column`:string,operation:string,category:string,value:string,sql:string>>"
)
_CLASSES = "struct<`table`:map<string,array<string>>,`column`:map<string,array<string>>>"
#: The misspelt key occurs in the wild.
ACCESS_JSON = f"db_id string, roles array<string>, classification {_CLASSES}, classifiction {_CLASSES}, policies array<{_POLICY}>, view_restriction map<string,array<string>>, process_restriction map<string,array<string>>"
DEFAULT_ROLES = ("admin", "analyst", "staff", "public")
#: The base matrix: id, level, scope, category, roles it is denied to.  Fixed values.
BASE_MATRIX = [
    ("col_view_S1", "column", "view", "S1", ["public"]),
    ("col_view_S2", "column", "view", "S2", ["public", "staff"]),
    ("col_view_S3", "column", "view", "S3", ["public", "staff", "analyst"]),
    ("col_proc_S2", "column", "process", "S2", ["public"]),
    ("col_proc_S3", "column", "process", "S3", ["public", "staff"]),
    ("table_view_S2", "table", "view", "S2", ["public", "staff"]),
    ("table_view_S1", "table", "view", "S1", ["public"]),
    ("table_process_S2", "table", "process", "S2", ["public"]),
]
#: Sensitivity of the test tables: tables and columns that are not listed are S0.
TPCH_CLASSES = {
    "table": {"S2": ["customer", "orders"], "S1": ["supplier"]},
    "column": {"S2": ["c_acctbal", "s_acctbal", "o_totalprice"], "S1": ["c_nationkey", "c_mktsegment"], "S3": ["c_name"]},
}
TPCH_ROWS = [("analyst", "customer", "c_mktsegment = 'BUILDING'"), ("staff", "lineitem", "l_returnflag <> 'R'"), ("public", "part", "p_size < 25")]


def read_access_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema=ACCESS_JSON)


def access_frame(spark: SparkSession, policies: list[dict], classes: dict, roles: list[str] | None = None, db_id: str = "db") -> DataFrame:
    """An access document from Python values."""
    fill = lambda p: {f: p.get(f) for f in POLICY_FIELDS}
    return spark.createDataFrame([(db_id, roles, classes, None, [fill(p) for p in policies], None, None)], ACCESS_JSON)


def base_policies(rows: list[tuple[str, str, str]] = ()) -> list[dict]:
    """The base matrix, and a conditional view policy for each (role, table, condition)."""
    out = [{"id": i, "effect": "deny", "action": "read", "scope": s, "level": lv, "categories": [c], "roles": r} for i, lv, s, c, r in BASE_MATRIX]
    return out + [{"id": f"row_view_{t}_{r}", "effect": "conditional", "action": "read", "scope": "view", "level": "row", "roles": [r], "table": t, "condition": c} for r, t, c in rows]


def members(access: DataFrame) -> DataFrame:
    """db_id, level, category, name of every classified table and column; the misspelt key counts too."""
    both = access.select("db_id", F.coalesce("classification", "classifiction").alias("c"))
    one = lambda kind: both.select("db_id", F.lit(kind).alias("level"), F.explode(F.col("c")[kind]).alias("category", "names")).select("db_id", "level", "category", F.explode("names").alias("name"))
    return one("table").unionByName(one("column")).withColumn("name", norm_col(F.col("name")))


def grant_of(effect) -> F.Column:
    e = F.lower(F.trim(effect))
    return F.when(e.isin("allow", "allowed", "permit", "permitted"), "Permitted").when(e == "conditional", "Conditional").otherwise("Prohibited")


def condition_of(p) -> F.Column:
    """condition, else the predicate's SQL, else column, operation and value; an operation on the type compares with the category."""
    pred = p["predicate"]
    op = pred["operation"]
    typed = F.lower(op).contains("type")
    value = F.when(typed, pred["category"]).otherwise(pred["value"])
    shown = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value).otherwise(F.concat(F.lit("'"), F.regexp_replace(value, "'", "''"), F.lit("'")))
    sign = F.when(typed, F.trim(F.regexp_replace(F.lower(op), "type", ""))).otherwise(op)
    built = F.concat_ws(" ", pred["column"], F.coalesce(F.when(sign != "", sign), F.lit("=")), shown)
    return F.coalesce(p["condition"], pred["sql"], F.when(pred["column"].isNotNull() & value.isNotNull(), built))


def compile_policies(access: DataFrame) -> DataFrame:
    """role, policy_id, grant, action, scope, level, table_name, column_name, condition: one row per role and resource.

    A category that classifies nothing is itself a name.  A resource may be
    written table.column; a bare column means that name in every table.
    """
    each = access.select("db_id", F.explode("policies").alias("p"))
    p = F.col("p")
    level = F.initcap(F.coalesce(p["level"], F.lit("table")))
    level = F.when(level.isin("Table", "Column", "Row"), level).otherwise("Table")
    scope = F.initcap(F.coalesce(p["scope"], F.lit("view")))
    scope = F.when(scope.isin("View", "Process", "Insert", "Update", "Delete"), scope).otherwise("View")
    rows = each.select(
        "db_id", p["id"].alias("policy_id"), grant_of(p["effect"]).alias("grant"), F.when(F.lower(p["action"]) == "read", "Read").otherwise("Modify").alias("action"),
        scope.alias("scope"), level.alias("level"), F.explode_outer(F.col("p.roles")).alias("role"), norm_col(p["table"]).alias("t"), norm_col(p["column"]).alias("c"), F.coalesce(p["categories"], F.array().cast("array<string>")).alias("categories"),
        p["predicate"]["table"].alias("pt"), condition_of(p).alias("condition"),
    )
    resources = F.when(F.col("level") == "Column", F.concat(F.filter(F.array(F.when(F.col("t").isNotNull() & F.col("c").isNotNull(), F.concat_ws(".", "t", "c")).otherwise(F.col("c"))), lambda x: x.isNotNull()), F.col("categories"))).otherwise(
        F.concat(F.filter(F.array("t", F.when(F.col("level") == "Row", F.col("pt"))), lambda x: x.isNotNull()), F.col("categories"))
    )
    named = rows.withColumn("resource", F.explode(resources)).withColumn("kind", F.when(F.col("level") == "Column", "column").otherwise("table"))
    m = members(access).select(F.col("db_id").alias("m_db"), F.col("level").alias("m_kind"), F.col("category"), "name")
    found = named.join(m, (F.col("db_id") == F.col("m_db")) & (F.col("kind") == F.col("m_kind")) & (F.col("resource") == F.col("category")), "left")
    name = F.coalesce("name", norm_col(F.col("resource")))
    column = F.when(F.col("kind") == "column", F.regexp_extract(name, r"([^.]+)$", 1))
    table = F.when(F.col("kind") == "table", name).otherwise(F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)))
    return found.select(F.lower(F.trim("role")).alias("role"), "policy_id", "grant", "action", "scope", "level", table.alias("table_name"), column.alias("column_name"), "condition").distinct()


def roles_of(access: DataFrame) -> DataFrame:
    """role: those declared (else the defaults) and those that policies name."""
    declared = access.select(F.explode(F.coalesce("roles", F.array(*map(F.lit, DEFAULT_ROLES)))).alias("role"))
    named = access.select(F.explode("policies").alias("p")).select(F.explode("p.roles").alias("role"))
    return declared.union(named).select(F.lower(F.trim("role")).alias("role")).distinct()


def role_denies(policies: DataFrame) -> DataFrame:
    """role, level (table or column), scope (view or process), name: what a role may not read; other scopes deny both."""
    read = policies.filter("grant = 'Prohibited' AND action = 'Read' AND level IN ('Table', 'Column')")
    scopes = F.when(F.col("scope").isin("View", "Process"), F.array(F.lower("scope"))).otherwise(F.array(F.lit("view"), F.lit("process")))
    name = F.when(F.col("level") == "Column", F.concat_ws(".", "table_name", "column_name")).otherwise(F.col("table_name"))
    return read.select("role", F.lower("level").alias("level"), F.explode(scopes).alias("scope"), name.alias("name")).distinct()


def denied_sets(policies: DataFrame) -> DataFrame:
    """role, level, scope, names: sorted; scope all joins view and process."""
    d = role_denies(policies)
    both = d.select("role", "level", F.lit("all").alias("scope"), "name").distinct()
    return d.unionByName(both).groupBy("role", "level", "scope").agg(F.sort_array(F.collect_set("name")).alias("names"))


def denied_entities(policies: DataFrame, role: str, scope: str = "all") -> DataFrame:
    return denied_sets(policies).filter((F.col("role") == role.lower()) & (F.col("scope") == scope))


def allowed_columns(columns: DataFrame, policies: DataFrame, roles: DataFrame) -> DataFrame:
    """role, kind (view or process), table_name, column_name: the catalog less the denies; a denied table takes its columns along."""
    catalog = columns.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    every = roles.crossJoin(catalog).withColumn("kind", F.explode(F.array(F.lit("view"), F.lit("process"))))  # roles by columns of a schema: control data
    d = role_denies(policies)
    t, c = d.filter("level = 'table'").alias("t"), d.filter("level = 'column'").alias("c")
    left = every.alias("e").join(t, (F.col("e.role") == F.col("t.role")) & (F.col("e.kind") == F.col("t.scope")) & (F.col("e.table_name") == F.col("t.name")), "left_anti")
    named = F.col("c.name").isin("") | (F.col("c.name") == F.col("e.column_name")) | (F.col("c.name") == F.concat_ws(".", "e.table_name", "e.column_name"))
    return left.join(c, (F.col("e.role") == F.col("c.role")) & (F.col("e.kind") == F.col("c.scope")) & named, "left_anti").select("role", "kind", "table_name", "column_name")


def role_pools(allowed: DataFrame) -> DataFrame:
    """role, table_name, column_name, projection, process, both: what each role may do with a column it may use."""
    return allowed.groupBy("role", "table_name", "column_name").agg(F.bool_or(F.col("kind") == "view").alias("projection"), F.bool_or(F.col("kind") == "process").alias("process")).withColumn("both", F.col("projection") & F.col("process"))


def denied_categories(access: DataFrame) -> DataFrame:
    """role, scope, level, categories: sorted; those of the older view_restriction and process_restriction hold for tables and columns."""
    rows = access.select(F.explode("policies").alias("p")).filter("lower(p.effect) IN ('deny', 'denied', 'prohibit') AND coalesce(p.action, 'read') = 'read'")
    each = rows.select(F.explode("p.roles").alias("role"), F.lower("p.scope").alias("scope"), F.lower("p.level").alias("level"), F.explode("p.categories").alias("category"))
    for scope in ("view", "process"):
        old = access.select(F.explode(f"{scope}_restriction").alias("category", "roles")).select(F.explode("roles").alias("role"), F.lit(scope).alias("scope"), F.explode(F.array(F.lit("table"), F.lit("column"))).alias("level"), "category")
        each = each.unionByName(old)
    each = each.withColumn("role", F.lower(F.trim("role")))
    return each.groupBy("role", "scope", "level").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def global_projection_pool(columns: DataFrame, access: DataFrame, allowed: DataFrame, roles: DataFrame) -> DataFrame:
    """table_name, column_name: unclassified columns of unclassified tables that every role may view."""
    catalog = columns.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    m = members(access).filter("category <> 'S0'")
    plain = catalog.join(m.filter("level = 'table'").select(F.col("name").alias("table_name")), "table_name", "left_anti").join(m.filter("level = 'column'").select(F.col("name").alias("column_name")), "column_name", "left_anti")
    seen = allowed.filter("kind = 'view'").groupBy("table_name", "column_name").agg(F.count_distinct("role").alias("n"))
    return plain.join(seen, ["table_name", "column_name"]).join(roles.agg(F.count_distinct("role").alias("all_roles")), F.col("n") == F.col("all_roles")).select("table_name", "column_name")


#: Words that make a column sensitive, the first class that has one counts; "a+b" needs both.  Fixed values.
KEYWORDS = {
    "S3": "password passwd pwd secret token apikey auth oauth session cookie hash salt pin ssn social sin nin passport license tax tin credit cc cvv cvc card iban swift routing account diagnosis".split(),
    "S2": "email mail zip+code postal address phone mobile cell tel fax first+name last+name full+name surname diagnosis symptom examintation dna hgb wbc rbc glu bank dob birth birthday".split(),
    "S1": "gender sex race nationality height weight city state country district".split(),
}
#: Tables of highly and of fairly sensitive matters.  Fixed values.
HIGH_TABLES = ("client", "user", "account", "transaction", "payment", "order", "customer", "employee", "patient", "medical_record", "diagnosis", "symptom", "examination")
FAIR_TABLES = ("card", "loan", "bank", "bond", "income", "laboratory", "transaction", "payment")


def classify_tables(tables: DataFrame, high: tuple[str, ...] = HIGH_TABLES, fair: tuple[str, ...] = FAIR_TABLES) -> DataFrame:
    """table_name, normal, category: S2 highly sensitive, S1 fairly, S0 not."""
    normal = table_phrase_of("table_name")
    named = tables.select("table_name", normal.alias("normal")).distinct()
    return named.withColumn("category", F.when(F.col("normal").isin(*high), "S2").when(F.col("normal").isin(*fair), "S1").otherwise("S0"))


def classify(columns: DataFrame, sensitive_tables: tuple[str, ...] = HIGH_TABLES, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """table_name, column_name, normal, category: an id is S1, in a sensitive table ids and names are S2; else S3 before S2 before S1 by the words."""
    rows = columns.select("table_name", "column_name", column_phrase_of("column_name").alias("normal"), table_phrase_of("table_name").alias("_table"))
    words = F.split("normal", " ")
    has = lambda w: F.forall(F.array(*map(F.lit, w.split("+"))), lambda x: F.array_contains(words, x))
    by_word = F.coalesce(*[F.when(F.greatest(F.lit(False), *[has(w) for w in ws]), c) for c, ws in keywords.items()], F.lit("S0"))
    guarded = F.col("_table").isin(*sensitive_tables) & (has("name") | has("id"))
    return rows.withColumn("category", F.when(guarded, "S2").when(has("id"), "S1").otherwise(by_word)).drop("_table")


def generated_access(columns: DataFrame, db_id: str = "db") -> DataFrame:
    """An access document for a catalog (table_name, column_name): classes by names, the base matrix, and row policies for the S1 columns of S2 tables."""
    tables, each = classify_tables(columns), classify(columns)
    top = each.groupBy("column_name").agg(F.max("category").alias("category"))
    packed = lambda df, c: df.groupBy("category").agg(F.array_sort(F.collect_set(c)).alias("names")).agg(F.map_from_entries(F.collect_list(F.struct("category", "names"))).alias("m"))
    classes = packed(tables, "table_name").select(F.col("m").alias("t")).crossJoin(packed(top, "column_name").select(F.col("m").alias("c"))).first()  # one row each
    rows = row_policies(each, tables.select("table_name", "category")).collect()
    policies = base_policies() + [{"id": r["policy_id"], "effect": "conditional", "action": "read", "scope": "view", "level": "row", "roles": ["public", "staff", "analyst"], "table": r["table_name"], "condition": r["condition"]} for r in rows]
    return access_frame(columns.sparkSession, policies, {"table": classes["t"] or {}, "column": classes["c"] or {}}, list(DEFAULT_ROLES), db_id)


def highest_class(classified: DataFrame) -> DataFrame:
    """column_name, category: a name that several tables have keeps its highest class."""
    return classified.groupBy(F.lower("column_name").alias("column_name")).agg(F.max("category").alias("category"))


def row_policies(classified: DataFrame, table_classes: DataFrame) -> DataFrame:
    """policy_id, table_name, column_name, condition: one conditional policy for each S1 column of an S2 table."""
    s2 = table_classes.filter("category = 'S2'").select("table_name")
    rows = classified.filter("category = 'S1'").join(s2, "table_name")
    number = F.row_number().over(W.partitionBy("table_name").orderBy("column_name"))
    return rows.select(F.concat_ws("_", F.lit("row_view"), "table_name", number.cast("string")).alias("policy_id"), "table_name", "column_name", F.concat(F.col("column_name"), F.lit(" IS NOT NULL")).alias("condition"))
