"""Readers and writers of benchmark data, predictions and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields that a dataset must have.  Fixed values.
REQUIRED = ("db_id", "question", "role", "intent_preserving_expected_query")
DEFAULTS = {"evidence": "", "question_type": "unknown", "evidence_added": False}


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON arrays or lines of several databases; missing columns get defaults, and the required ones must be there."""
    out = None
    for p in paths:
        df = spark.read.json(p, multiLine=True)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset is given")
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c, v in DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return out


#: Names of a database's dataset, the first that is there counts.  Fixed values.
DATASETS = ("qa.json", "bird_style_dataset.json")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_datasets(spark: SparkSession, root: str, db_ids: list[str], names: tuple[str, ...] = DATASETS) -> DataFrame:
    """The datasets of databases, each in a folder of its own below root; databases without one are left out."""
    found = [next((p for p in (f"{root}/{d}/{n}" for n in names) if exists(spark, p)), None) for d in db_ids]
    return read_records(spark, [p for p in found if p])


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def normalize_predictions(df: DataFrame) -> DataFrame:
    """sample_id and query from rows, {records}, {predictions}, or a map from sample id to query."""
    from palisade.operators.evaluate import QUERY_FIELDS

    for wrapper in ("records", "predictions"):
        if df.columns == [wrapper]:
            df = df.select(F.explode(wrapper).alias("r")).select("r.*")
    fields = [f for f in QUERY_FIELDS if f in df.columns]
    if fields:  # rows may have one or the other
        return df.withColumn("query", F.coalesce(*fields))
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("sample_id"), F.col(f"`{c}`").alias("query")) for c in df.columns]))
    return df.select(entries.alias("e")).select("e.*")


def write_json(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """JSON lines through Spark's commit protocol: readers see all files or none."""
    (df.coalesce(1) if single else df).write.mode(mode).json(path)


def append_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows added to those at path, or in their stead."""
    df.write.mode("overwrite" if overwrite else "append").json(path)


def export_facts(facts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Facts to export, each once; with a base, those that the base does not have."""
    return facts.subtract(base) if base is not None else facts.distinct()


def write_status(status: DataFrame, path: str) -> None:
    """What the rules say of every node, by query."""
    status.write.mode("overwrite").parquet(path)


def n_triples(facts: DataFrame, iri: str = "urn:palisade:") -> DataFrame:
    """value: one N-Triples line per (subject, predicate, object)."""
    node = lambda c: F.concat(F.lit(f"<{iri}"), F.col(c), F.lit(">"))
    literal = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col("object"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return facts.select(F.concat_ws(" ", node("subject"), node("predicate"), literal, F.lit(".")).alias("value"))


def pending(samples: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("question_id", "mode")) -> DataFrame:
    """Samples that an interrupted run has not finished."""
    return samples.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Rows of a run in a folder of its own; the same run again takes the place of the first."""
    rows.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def persist_run(evaluated: DataFrame, raw: DataFrame, path: str, run_id: str, meta: dict | None = None, final: bool = True) -> None:
    """All that a run leaves below path: evaluation, raw outputs, failures and, of a final one, summary and breakdown; last the meta record, which says that the rest is there.

    evaluated: contributions with sample_id, question_id, mode and question_type.
    """
    import json

    from palisade.operators import evaluate

    tables = {"eval": evaluated, "raw": raw, "failures": evaluate.failures(evaluated)}
    if final:
        tables |= {"summary": evaluate.mode_summary(evaluated), "breakdown": evaluate.type_breakdown(evaluated)}
    for name, df in tables.items():
        append_run(df, f"{path}/{name}", run_id)
    record = {"run_id": run_id, "is_final": final, "processed_samples": evaluated.count(), "failure_count": tables["failures"].count(), **(meta or {})}
    append_run(evaluated.sparkSession.createDataFrame([(json.dumps(record, sort_keys=True),)], "meta string"), f"{path}/meta", run_id)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """question_id, mode of what earlier runs have evaluated; nothing if there was none."""
    if not exists(spark, f"{path}/eval"):
        return spark.createDataFrame([], "question_id string, mode string")
    return spark.read.parquet(f"{path}/eval").select("question_id", "mode").distinct()
