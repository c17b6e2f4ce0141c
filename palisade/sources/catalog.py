"""Schema catalogs: from JSON, from DataFrames, from the session; and column descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.names import norm_col
from palisade.operators.facts import Schema

SCHEMA_JSON = "db_id string, table_names array<string>, column_names array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>"
#: Key positions of the test tables count columns from 1.
TPCH_KEYS = {
    "pk": {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"},
    "fk": [
        ("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ],
}
TPCH_TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


def read_schema_json(spark: SparkSession, path: str) -> DataFrame:
    """Schema documents: one object per file, or a list of objects."""
    return spark.read.json(path, multiLine=True, schema=SCHEMA_JSON)


def tables_of(schemas: DataFrame) -> DataFrame:
    """db_id, table_id, table_name."""
    return schemas.select("db_id", F.posexplode("table_names").alias("table_id", "table_name"))


def columns_of(schemas: DataFrame, first_key: int = 1) -> DataFrame:
    """db_id, table_id, table_name, ordinal, column_id, column_name, data_type, is_pk, is_fk; the star entry is left out.

    Key positions count from first_key.  A column name is one identity, however
    many tables have it: column_id numbers the normalised names.
    """
    from pyspark.sql import Window as W

    each = schemas.select("db_id", "table_names", "column_types", "primary_keys", "foreign_keys", F.posexplode("column_names").alias("ordinal", "pair"))
    place = F.col("pair")[0].cast("int")
    position = F.col("ordinal") + first_key
    out = each.filter(place >= 0).select(
        "db_id", place.alias("table_id"), F.col("table_names")[place].alias("table_name"), "ordinal", F.col("pair")[1].alias("column_name"),
        F.coalesce(F.get("column_types", F.col("ordinal")), F.lit("TEXT")).alias("data_type"),
        F.coalesce(F.array_contains("primary_keys", position), F.lit(False)).alias("is_pk"),
        F.coalesce(F.exists("foreign_keys", lambda k: k[0] == position), F.lit(False)).alias("is_fk"),
    )
    return out.withColumn("column_id", F.dense_rank().over(W.partitionBy("db_id").orderBy(norm_col(F.col("column_name")))))


def foreign_keys_of(schemas: DataFrame, first_key: int = 1) -> DataFrame:
    """db_id, from_table, from_column, to_table, to_column."""
    columns = columns_of(schemas, first_key).select("db_id", "ordinal", "table_name", "column_name")
    pairs = schemas.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", (F.col("k")[0] - first_key).alias("a"), (F.col("k")[1] - first_key).alias("b"))
    side = lambda o, t, c: columns.select("db_id", F.col("ordinal").alias(o), F.col("table_name").alias(t), F.col("column_name").alias(c))
    return pairs.join(side("a", "from_table", "from_column"), ["db_id", "a"]).join(side("b", "to_table", "to_column"), ["db_id", "b"]).drop("a", "b")


def crawl(spark: SparkSession, frames: dict[str, DataFrame], pk: dict[str, str], fk: list[tuple[str, str, str, str]], db_id: str = "db") -> DataFrame:
    """db_id, table_name, ordinal, column_name, data_type, key (PK, FK or COMMON), from the schemas of DataFrames."""
    foreign = {(t, c) for t, c, *_ in fk}
    rows = [
        (db_id, t, i, f.name, f.dataType.simpleString(), "PK" if pk.get(t) == f.name else "FK" if (t, f.name) in foreign else "COMMON")
        for t, df in sorted(frames.items())
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "db_id string, table_name string, ordinal int, column_name string, data_type string, key string")


def schema_of(frames: dict[str, DataFrame]) -> Schema:
    return Schema.of({t: df.columns for t, df in frames.items()})


def schema_from(columns: DataFrame) -> Schema:
    """Driver-side Schema of a catalog (it describes tables, and is as small as their number)."""
    out: dict[str, list[str]] = {}
    for r in columns.orderBy("table_name", "ordinal").select("table_name", "column_name").toLocalIterator():
        out.setdefault(r[0], []).append(r[1])
    return Schema.of(out)


def read_descriptions(spark: SparkSession, path: str, squeeze: bool = True) -> DataFrame:
    """table_name, column_name, description, value_description from one CSV (Latin-1) per table."""
    raw = spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=True, escape='"')
    clean = (lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))) if squeeze else (lambda c: c)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return raw.select(name.alias("table_name"), norm_col(F.col("original_column_name")).alias("column_name"), clean(F.col("column_description")).alias("description"), clean(F.col("value_description")).alias("value_description"))


def light_schema(columns: DataFrame, foreign: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """table_name, text: a Markdown section per table with types, keys and sample values."""
    if samples is not None:
        columns = columns.join(samples.groupBy("table_name", "column_name").agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("examples")), ["table_name", "column_name"], "left")
    else:
        columns = columns.withColumn("examples", F.lit(None).cast("string"))
    fk = foreign.select(F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name"), F.concat_ws(".", "to_table", "to_column").alias("target"))
    rows = columns.join(fk, ["table_name", "column_name"], "left")
    line = F.concat(F.lit("- "), "column_name", F.lit(" ("), F.lower("data_type"), F.lit(")"), F.when(F.col("is_pk"), " primary key").otherwise(""), F.coalesce(F.concat(F.lit(" -> "), "target"), F.lit("")), F.coalesce(F.concat(F.lit(": "), "examples"), F.lit("")))
    lines = rows.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    return lines.select("table_name", F.concat(F.lit("# "), "table_name", F.lit("\n"), F.array_join(F.col("lines.line"), "\n")).alias("text"))


#: Words that a column can't be called without quotes.  Fixed values.
RESERVED = ("order", "group", "select", "from", "where", "table", "index", "by", "join", "on", "as", "and", "or", "not", "in", "case", "when", "then", "else", "end", "union", "values", "set", "primary", "key", "references", "default", "check", "transaction", "limit", "having", "distinct", "create", "date", "to", "all")
#: Sample values that a column's comment shows, at most.
EXAMPLES = 6


def ddl(columns: DataFrame, foreign: DataFrame, descriptions: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """table_name, text: CREATE TABLE with key constraints; names that are reserved or not plain are quoted.

    With descriptions (table_name, column_name, description) and samples
    (table_name, column_name, value), a comment follows each column.
    """
    name = lambda c: F.when(c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~F.lower(c).isin(*RESERVED), c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    key = ["table_name", "column_name"]
    said, shown = F.lit(None).cast("string"), F.lit(None).cast("string")
    if descriptions is not None:
        columns, said = columns.join(descriptions.select(*key, F.col("description").alias("_said")), key, "left"), F.col("_said")
    if samples is not None:
        some = samples.groupBy(*key).agg(F.slice(F.array_sort(F.collect_set("value")), 1, EXAMPLES).alias("_shown"))
        columns, shown = columns.join(some, key, "left"), F.concat(F.lit("examples: "), F.array_join("_shown", ", "))
    note = F.concat_ws("; ", said, shown)
    text = F.concat_ws(" ", name(F.col("column_name")), F.upper("data_type"))
    body = columns.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", text.alias("line"), F.when(note != "", F.concat(F.lit(" -- "), F.regexp_replace(note, r"\s+", " "))).otherwise(F.lit("")).alias("note")))).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("is_pk"), name(F.col("column_name"))))).alias("pk"),
    )
    keys = foreign.groupBy(F.col("from_table").alias("table_name")).agg(F.array_sort(F.collect_list(F.concat(F.lit("FOREIGN KEY ("), name(F.col("from_column")), F.lit(") REFERENCES "), name(F.col("to_table")), F.lit(" ("), name(F.col("to_column")), F.lit(")")))).alias("fks"))
    rows = body.join(keys, "table_name", "left")
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("line"), F.lit("").alias("note")))
    pk = F.when(F.size("pk") > 0, F.array(F.concat(F.lit("PRIMARY KEY ("), F.array_join("pk", ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["note"].alias("note"))), plain(pk), plain(F.coalesce("fks", F.array().cast("array<string>"))))
    last = F.size(parts)
    lines = F.transform(parts, lambda x, i: F.concat(x["line"], F.when(i + 1 < last, ",").otherwise(""), x["note"]))  # the comma before the comment
    return rows.select("table_name", F.concat(F.lit("CREATE TABLE "), name(F.col("table_name")), F.lit(" (\n  "), F.array_join(lines, "\n  "), F.lit("\n)")).alias("text"))


def schema_document(spark: SparkSession, db_id: str, tables: dict[str, list[tuple[str, str]]], pk: list[tuple[str, str]] = (), fk: list[tuple[str, str, str, str]] = (), first_key: int = 1) -> DataFrame:
    """A schema document from Python values: tables with (column, type), primary keys, foreign keys."""
    cells = [(i, c, t) for i, cs in enumerate(tables.values()) for c, t in cs]
    names = list(tables)
    place = {(names[i], c): n for n, (i, c, _) in enumerate(cells, first_key)}
    row = (db_id, names, [[str(i), c] for i, c, _ in cells], [t for *_, t in cells], [place[x] for x in pk], [[place[a, b], place[c, d]] for a, b, c, d in fk])
    return spark.createDataFrame([row], SCHEMA_JSON)


def from_session(spark: SparkSession, database: str | None = None, tables: list[str] | None = None) -> DataFrame:
    """db_id, table_name, ordinal, column_name, data_type of the session's tables and views."""
    rows = []
    for t in spark.catalog.listTables(database):
        if tables is None or t.name in tables:
            fields = spark.table(f"`{t.name}`" if t.isTemporary else f"`{t.namespace[0]}`.`{t.name}`").schema.fields
            rows += [(database or spark.catalog.currentDatabase(), t.name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "db_id string, table_name string, ordinal int, column_name string, data_type string")


def statistics(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, n_rows, n_nulls, n_distinct (approximate): one pass over each table, all columns at once."""
    out = None
    for table, df in sorted(frames.items()):
        plain = [f.name for f in df.schema.fields]
        measures = [F.count("*").alias("n_rows"), *[F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("n_nulls"), F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias("n_distinct")).alias(f"_{i}") for i, c in enumerate(plain)]]
        each = df.agg(*measures).select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}.n_nulls").alias("n_nulls"), F.col(f"_{i}.n_distinct").alias("n_distinct")) for i, c in enumerate(plain)])).alias("x"))
        rows = each.select(F.lit(table).alias("table_name"), "x.column_name", "n_rows", "x.n_nulls", "x.n_distinct")
        out = rows if out is None else out.unionByName(rows)
    return out
