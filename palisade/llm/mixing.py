"""Operator 3: mixing sources to target weights along a curriculum.

A source has a weight schedule w(t) = weight * (1 + ramp * (2t - 1)) over
training time t in [0, 1].  Its integral over [0, t],
weight * ((1 - ramp) t + ramp t^2), is the source's cumulative demand; all
ramps integrate to the plain weight, so the schedule decides when a source is
read and the weights how much of it.  A document's place in its source's run of
words, as a share of the target, is turned into a training position by the
inverse of that integral, and documents are range-sorted by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.shared import WORD, materialize, table

#: Rows of a source in one bucket, on average; buckets are dealt by hash.
BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Plan:
    """weights and ramps repeat over the sources in code-point order, null last; |ramp| <= 1."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    ramps: tuple[float, ...] = (-0.5, 0.0, 0.5)
    budget: float = 1.5  # of all sizes
    most: float = 2.0  # of a source's own size


def size_of(text: Column) -> Column:
    """Words of the text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def places(sources: DataFrame) -> DataFrame:
    """sources (source, source_size; one row each) with place, from 0 in code-point order, null last.

    Sorted by ranges and numbered within each; what comes before a range is
    added from the ranges' sizes.
    """
    ordered = materialize(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "mix-places")
    part = F.shiftright("_at", 33)
    sizes = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row for each range
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return ordered.withColumn("place", F.element_at(offsets, part) + (F.col("_at") - F.shiftleft(part, 33))).drop("_at")


def targets(sizes: DataFrame, plan: Plan) -> DataFrame:
    """source, source_size, target, ramp from rows (source, source_size), one for each source.

    The excess of capped sources is reshared until none is above its cap: all
    others share what the capped ones leave, at one level for each unit of
    weight.  A round is one aggregate over the table of sources.
    """
    w, r = (F.array(*map(F.lit, map(float, x))) for x in (plan.weights, plan.ramps))
    named = places(sizes).select(
        "source", "source_size",
        F.element_at(w, F.pmod("place", F.lit(len(plan.weights))).cast("int") + 1).alias("weight"),
        F.element_at(r, F.pmod("place", F.lit(len(plan.ramps))).cast("int") + 1).alias("ramp"),
        (F.lit(plan.most) * F.col("source_size")).alias("cap"),
    )
    whole = named.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (plan.budget * whole[0] / whole[1], 0) if whole[1] else (0.0, 0)
    while True:
        above = named.filter(F.col("cap") <= F.lit(level) * F.col("weight")).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if above[0] == capped or above[2] == whole[1]:
            level = float("inf") if whole[1] and above[2] == whole[1] else level
            break
        capped, level = above[0], (plan.budget * whole[0] - above[1]) / (whole[1] - above[2])
    return named.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).select("source", "source_size", "target", "ramp")


def inverse_demand(share: Column, ramp: Column) -> Column:
    """The time t at which (1 - ramp) t + ramp t^2 reaches share."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - ramp) * (1 - ramp) + 4 * ramp * share))
    return F.when(F.abs(ramp) < 1e-9, share).otherwise((root - (1 - ramp)) / (2 * ramp))


def _starts(buckets: DataFrame, digits: int) -> DataFrame:
    """source, bucket, bucket_size, bucket_before: words of the source before each bucket, by sums over halves of the digits, so that no window holds more than about the root of all buckets."""
    running = lambda value, *by: F.coalesce(F.sum(value).over(W.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    split = buckets.withColumn("half", F.substring("bucket", 1, digits // 2))
    halves = split.groupBy("source", "half").agg(F.sum("bucket_size").alias("half_size")).withColumn("half_before", running("half_size", "half"))
    halves = halves.select(F.col("source").alias("s"), F.col("half").alias("h"), "half_before")
    inner = split.withColumn("within", running("bucket_size", "half", "bucket"))
    joined = inner.join(halves, F.col("source").eqNullSafe(F.col("s")) & (F.col("half") == F.col("h")))
    return joined.select("source", "bucket", "bucket_size", (F.col("half_before") + F.col("within")).alias("bucket_before"))


def assign(docs: DataFrame, plan: Plan = Plan(), whole: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, position, first_pass, run_before and the columns in keep.

    A source's documents stand in the order of the MD5 of their id.  Every one
    is taken floor(target / source_size) times; the run's next words up to the
    target are taken once more.  The document at that edge gives part of its
    words, or with whole=True all or none, whichever is nearer.  position is
    that of the first words taken, null for a document not taken.

    Null texts have size 0; a null source is a source; rows with equal or null
    ids are separate documents with a place each, those of one id by size and
    hash of the text; an empty table gives an empty one.  Prefix sums go through
    hash buckets of each source, and of an id of very many rows, so that no
    task needs a whole source.
    """
    kept = [(f"_keep{i}", c) for i, c in enumerate(keep) if c != text_col]
    columns = [F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), _key(id_col).alias("key"), F.xxhash64(text_col).alias("tie"), *[F.col(c).alias(k) for k, c in kept]]
    sized = materialize(docs.select(*columns), "mix-sizes")
    placed = _taken(sized, sized, plan, whole, bucket_rows, ["key", "size", "tie"])
    position = F.when(F.col("taken") > 0, inverse_demand(F.least(F.lit(1.0), F.col("run_before") / F.col("target")), F.col("ramp")))
    return placed.select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken", position.alias("position"), "passes", "run_before", "ramp", "key", *[F.col(k).alias(c) for k, c in kept])


def _key(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


#: Rows of one id, in buckets, from which they are dealt to further ones.
CROWD = 8


def _crowded(sized: DataFrame, bucket: Column, buckets: DataFrame, bucket_rows: int) -> dict[str, int]:
    """Keys that CROWD buckets' rows and more have in common, and into how many parts each goes: at most one for every CROWD * bucket_rows rows.

    Only buckets that hold as many are looked into.
    """
    most = CROWD * bucket_rows
    full = buckets.filter(F.col("n") >= most).select("bucket").distinct()
    if not full.take(1):
        return {}
    keys = sized.select("key", bucket).join(full, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
    return {r["key"]: -(-r["n"] // bucket_rows) for r in keys.orderBy(F.desc("n"), "key").limit(MOST_CROWDS).collect()}


#: Ids that are dealt to further buckets, at most; others of CROWD buckets' rows keep one.
MOST_CROWDS = 200


def _taken(rows: DataFrame, sized: DataFrame, plan: Plan, whole: bool, bucket_rows: int, order: list) -> DataFrame:
    """rows (source, size, key, tie, others) with source_size, target, ramp, run_before, passes and taken; sized: the same rows' source, size, key and tie, cheaply read."""
    n, digits = sized.count(), 0
    while 16**digits * bucket_rows < n:
        digits += 1
    bucket = F.substring("key", 1, digits).alias("bucket")
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("name")  # of a source, null too: one key for join and window
    summed = lambda b: materialize(sized.select("source", "size", b).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("n")), "mix-buckets")
    buckets = summed(bucket)
    crowds = _crowded(sized, bucket, buckets, bucket_rows)
    for k, parts in crowds.items():  # one id of very many rows: further buckets, by the rows' hash
        own = F.concat(F.lit(k), F.lpad(F.hex(F.pmod("tie", F.lit(parts))), 8, "0"))
        bucket = F.when(F.col("key") == k, own).otherwise(bucket).alias("bucket")
    buckets = summed(bucket) if crowds else buckets
    per_source = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), plan)
    starts = _starts(buckets, digits).join(per_source.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
    placed = rows.select("*", bucket, name).join(starts.select(name, "bucket", "bucket_before", "source_size", "target", "ramp"), ["name", "bucket"])
    within = W.partitionBy("name", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("run_before", F.col("bucket_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long") - F.col("run_before")
    part = F.when(2 * F.col("extra") >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least("size", "extra"))
    return placed.withColumn("passes", passes).withColumn("extra", extra).withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long")).drop("name", "bucket", "bucket_before", "extra")


def copies(assigned: DataFrame) -> DataFrame:
    """One row for each time a document is taken, with copy (from 1), words and position; not sorted."""
    n = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    each = assigned.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    words = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    share = F.least(F.lit(1.0), ((F.col("copy") - 1) * F.col("source_size") + F.col("run_before")) / F.col("target"))
    return each.withColumn("words", words).withColumn("position", inverse_demand(share, F.col("ramp")))


def in_training_order(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Whole documents, each as often as the mix takes it (some never), range-sorted by training position; the columns of docs.

    Equal rows and rows with equal or null ids are documents of their own.  An
    empty table gives an empty one.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, names))
    source, size, key = F.col(place[source_col]).alias("source"), size_of(F.col(place[text_col])).alias("size"), _key(place[id_col]).alias("key")
    rows = docs.toDF(*names)
    tie = F.xxhash64(*names).alias("tie")
    sized = materialize(rows.select(source, size, key, tie), "mix-sizes")
    whole = rows.select("*", source, size, key, tie)  # texts are shuffled twice, to their place in the source and to that in training
    each = copies(_taken(whole, sized, plan, True, bucket_rows, ["key", "size", "tie"]))
    return each.orderBy("position", "key", "tie", "copy").select(*[F.col(n).alias(c) for c, n in place.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents, weights 5, 2, 1, budget 150 %, at most twice a source's size; sorted by position."""
    mixed = assign(table(spark, sf_dir, "documents"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "key").select("doc_id", "size", "source_size", "target", "taken", "position")


def oracle_sql() -> str:
    """DuckDB: resharing as the level that caps leave, then running sums by source in MD5 order."""
    return r"""
    WITH docs AS (
      SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
    ), weighed AS (
      SELECT *, [5.0::DOUBLE, 2.0, 1.0][place % 3 + 1] AS weight, [-0.5::DOUBLE, 0.0, 0.5][place % 3 + 1] AS ramp, 2.0::DOUBLE * source_size AS cap FROM sources
    ), levels AS (
      SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM weighed WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), aimed AS (
      SELECT source, source_size, ramp, least(cap, weight * max(level) OVER ()) AS target FROM levels
    ), placed AS (
      SELECT d.*, a.source_size, a.target, a.ramp,
        CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run_before
      FROM docs d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
    ), taken AS (
      SELECT *, passes * size + greatest(0, least(size, round(target - passes * source_size)::BIGINT - run_before)) AS taken,
        least(1.0, run_before / target) AS share FROM placed
    )
    SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
      CASE WHEN taken > 0 THEN CASE WHEN ramp = 0 THEN share ELSE (sqrt(greatest(0, (1 - ramp) * (1 - ramp) + 4 * ramp * share)) - (1 - ramp)) / (2 * ramp) END END AS position
    FROM taken
    """
