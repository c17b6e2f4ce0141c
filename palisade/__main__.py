"""Command line: refine and check queries, score predictions, summarise runs.

    python -m palisade refine --schema schema.json --access access.json --role staff --sql "SELECT ..."
    python -m palisade evaluate --samples samples.json --predictions predictions.json --out run
    python -m palisade summarize --run run
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.engine import AccessEngine
from palisade.operators import evaluate
from palisade.sources import io


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palisade", description=__doc__.split("\n")[0])
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("refine", "check"):
        p = commands.add_parser(name, help=f"{name} queries for a role")
        p.add_argument("--schema", required=True, help="schema document (JSON)")
        p.add_argument("--access", required=True, help="access document (JSON)")
        p.add_argument("--role", help="role of --sql")
        p.add_argument("--sql", help="one query")
        p.add_argument("--queries", help="JSON of query_id, role, sql")
        p.add_argument("--out", help="folder for JSON lines; without it they are printed")
        p.add_argument("--first-key", type=int, default=1, help="number of the first column in key lists")
        p.add_argument("--unknown-roles", choices=("deny", "allow"), default="deny")
        p.add_argument("--lenient", action="store_true", help="what joined subqueries select is not counted as viewed")
    p = commands.add_parser("evaluate", help="score predictions")
    p.add_argument("--samples", required=True, help="JSON of samples, as operators.evaluate.evaluate() takes them")
    p.add_argument("--predictions", help="JSON of predictions in any of the known forms")
    p.add_argument("--use-expected", action="store_true", help="score the expected queries themselves")
    p.add_argument("--out", required=True, help="folder of runs")
    p.add_argument("--run-id", default="run")
    p.add_argument("--db", nargs="*", help="only these databases")
    p.add_argument("--roles", nargs="*", help="only these roles")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--stop", type=int)
    p.add_argument("--resume", action="store_true", help="leave out what earlier runs have scored")
    p = commands.add_parser("summarize", help="summary of stored runs by mode")
    p.add_argument("--run", required=True)
    p.add_argument("--by-type", action="store_true")
    p = commands.add_parser("template", help="an empty prediction for every sample")
    p.add_argument("--samples", required=True)
    p.add_argument("--out", required=True)
    return out


def show(df: DataFrame, path: str | None = None) -> None:
    if path:
        io.write_json(df, path)
    else:
        for line in df.toJSON().toLocalIterator():
            print(line)


def decide(spark: SparkSession, a: argparse.Namespace) -> None:
    engine = AccessEngine(spark, strict=not a.lenient, unknown_roles=a.unknown_roles).load_context(a.schema, a.access, a.first_key)
    if a.queries:
        asked = spark.read.json(a.queries, multiLine=True)
        show(engine.refine_queries(asked) if a.command == "refine" else engine.check_queries(asked), a.out)
    elif a.sql is None:
        raise SystemExit("give --sql or --queries")
    else:
        print(json.dumps(engine.refine_query(a.sql, a.role) if a.command == "refine" else engine.check_query(a.sql, a.role)))


SAMPLE = {"sample_id": "string", "question_id": "string", "mode": "string", "question_type": "string", "usable": "boolean", "generated": "string", "expected": "string", "base": "string", "allowed_view": "array<string>", "allowed_process": "array<string>", "executes": "boolean", "prompt_chars": "long"}


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    samples = spark.read.json(a.samples, multiLine=True)
    if a.db or a.roles or a.start or a.stop is not None:
        samples = evaluate.chosen(samples, a.db, a.roles, a.start, a.stop, ("sample_id",))
    if a.use_expected:
        samples = samples.withColumn("generated", F.col("expected"))
    elif a.predictions:
        given = io.normalize_predictions(spark.read.json(a.predictions, multiLine=True)).select("sample_id", F.col("query").alias("generated"))
        samples = samples.drop("generated").join(given.groupBy("sample_id").agg(F.last("generated").alias("generated")), "sample_id", "left")
    samples = samples.select(*[(F.col(c) if c in samples.columns else F.lit(None)).cast(t).alias(c) for c, t in SAMPLE.items()])
    if a.resume:
        samples = io.pending(samples, io.finished(spark, a.out))
    io.persist_run(evaluate.evaluate(samples), samples.select("sample_id", "mode", "generated"), a.out, a.run_id, {"samples": a.samples})
    show(evaluate.ordered_modes(spark.read.parquet(f"{a.out}/summary/run_id={a.run_id}")))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command in ("refine", "check"):
        decide(spark, a)
    elif a.command == "evaluate":
        score(spark, a)
    elif a.command == "summarize":
        rows = spark.read.parquet(f"{a.run}/eval")
        show(evaluate.type_breakdown(rows) if a.by_type else evaluate.ordered_modes(evaluate.mode_summary(rows)))
    else:
        show(evaluate.prediction_template(spark.read.json(a.samples, multiLine=True)), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
