"""The test tables under the test policy: frames, engine, shared SQL for oracles."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from palisade.engine import AccessEngine, ContextCache
from palisade.operators import policy
from palisade.sources import catalog

ROLES = ["admin", "analyst", "staff", "public"]


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in catalog.TPCH_TABLES}


def access(spark: SparkSession) -> DataFrame:
    extra = [{"id": "no_update", "effect": "deny", "action": "modify", "scope": "update", "level": "table", "roles": ["analyst", "staff", "public"], "table": t} for t in catalog.TPCH_TABLES]
    return policy.access_frame(spark, policy.base_policies(policy.TPCH_ROWS) + extra, policy.TPCH_CLASSES, ROLES, "tpch")


_engines = ContextCache()


def engine(spark: SparkSession, sf_dir: str, **options) -> AccessEngine:
    """The tables' engine, made once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(options.items()))
    return _engines.get(key, lambda: AccessEngine(spark, **options).load_frames(frames(spark, sf_dir), access(spark)))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.crawl(spark, frames(spark, sf_dir), catalog.TPCH_KEYS["pk"], catalog.TPCH_KEYS["fk"], "tpch")
    return found.withColumn("is_pk", found["key"] == "PK").withColumn("is_fk", found["key"] == "FK")


def foreign_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog.TPCH_KEYS["fk"], "from_table string, from_column string, to_table string, to_column string")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    conf = spark.sparkContext.getConf()
    base, master = conf.get("spark.checkpoint.dir", None), conf.get("spark.master", "")
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="palisade-"))
            atexit.register(shutil.rmtree, _own_folder[0].removeprefix("file://"), True)
        base = _own_folder[0]
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


_own_folder: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        pass


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """A small control file, written through Spark's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return path


def schema_document(spark: SparkSession, sf_dir: str) -> str:
    """A JSON schema document of the test tables (keys count columns from 1), on disk."""
    fs = frames(spark, sf_dir)
    names = sorted(fs)
    cols = [(i, f.name, f.dataType.simpleString()) for i, t in enumerate(names) for f in fs[t].schema.fields]
    place = {(names[i], c): n for n, (i, c, _) in enumerate(cols, 1)}
    document = {
        "db_id": "tpch", "table_names": names, "column_names": [[str(i), c] for i, c, _ in cols], "column_types": [t for *_, t in cols],
        "primary_keys": [place[t, c] for t, c in sorted(catalog.TPCH_KEYS["pk"].items())], "foreign_keys": [[place[a, b], place[c, d]] for a, b, c, d in catalog.TPCH_KEYS["fk"]],
    }
    return put_text(spark, scratch(spark, "schema.json"), json.dumps(document))


def values(rows: list[tuple], names: str) -> str:
    """SELECT over literal rows for DuckDB."""
    def cell(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


_MATRIX = [(i, lv, s, c, r) for i, lv, s, c, rs in policy.BASE_MATRIX for r in rs]
_CLASSES = [(lv, c, n) for lv, cs in policy.TPCH_CLASSES.items() for c, ns in cs.items() for n in ns]
#: DuckDB common table expressions: the base matrix, the classes, what is denied, the catalog.
PRELUDE = f"""
matrix AS ({values(_MATRIX, 'policy_id, level, scope, category, role')}),
classes AS ({values(_CLASSES, 'level, category, name')}),
denies AS (SELECT DISTINCT m.role, m.level, m.scope, c.name FROM matrix m JOIN classes c ON m.level = c.level AND m.category = c.category),
roles AS (SELECT unnest(['admin', 'analyst', 'staff', 'public']) AS role),
catalog AS (SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) - 1 AS ordinal FROM information_schema.columns
  WHERE table_name IN ('customer', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier')),
allowed AS (
  SELECT r.role, k.kind, c.table_name, c.column_name FROM roles r CROSS JOIN (SELECT unnest(['view', 'process']) AS kind) k CROSS JOIN catalog c
  WHERE NOT EXISTS (SELECT 1 FROM denies d WHERE d.role = r.role AND d.scope = k.kind AND (d.level = 'table' AND d.name = c.table_name OR d.level = 'column' AND d.name = c.column_name)))
"""
