"""Vectors, mixing, chat formatting, SQL and the pipeline against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from palisade.llm import ball_tree, chat_template, mixing, projections, registry, toxicity
from palisade.llm import vectors as vectors_module

from .conftest import TRICKY
from .test_text import SF, brute_lines, brute_near, words_of

TABLES = ("documents", "embeddings", "labels", "conversations")


# --- operators 2 and 8


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def odd_vectors():
    pick = random.Random(8)
    rows = [(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # copies
    return rows + [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [math.nan, 1.0, 0.0, 0.0]), (280, [math.inf, 1.0, 0.0, 0.0]), (None, [1.0] * 4)]


def brute_top(rows, k, score, usable):
    rows = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and usable(v)]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            out[q] = sorted(((-score(x, y), i) for i, y in rows if i != q))[:k]
    return out


def scaled(x, y):
    return int(np.floor(64 * x) @ np.floor(64 * y))


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((-r.score, r.vec_id))
    return dict(out)


def table_vectors(spark):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


def test_exact_top_k(spark):
    assert by_query(ball_tree.exact_top_k(vectors(spark, odd_vectors())).collect()) == brute_top(odd_vectors(), 20, scaled, lambda v: True)
    assert by_query(ball_tree.query(spark, SF).collect()) == brute_top(table_vectors(spark), 20, scaled, lambda v: True)


def test_nearest_recall(spark):
    def inner(x, y):
        return float(x @ y)

    for rows, df in ((table_vectors(spark), None), (odd_vectors(), vectors(spark, odd_vectors()))):
        got = by_query((projections.query(spark, SF) if df is None else projections.nearest(df)).collect())
        wanted = brute_top(rows, 20, inner, any)
        assert got.keys() == wanted.keys()
        hits = total = 0
        for q, found in got.items():
            assert len(found) == len(wanted[q]) and found == sorted(found)
            worst = wanted[q][-1][0]
            hits += sum(s <= worst + 1e-9 for s, _ in found)
            total += len(found)
        assert hits >= 0.9 * total


def test_nearest_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "SHARD_ROWS", 50)
    rows = table_vectors(spark)
    got, wanted = by_query(projections.query(spark, SF).collect()), brute_top(rows, 20, lambda x, y: float(x @ y), any)
    assert got.keys() == wanted.keys() and all(len(found) == len(wanted[q]) for q, found in got.items())
    hits = sum(s <= wanted[q][-1][0] + 1e-9 for q, found in got.items() for s, _ in found)
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_exact_top_k_over_shards_and_blocks(spark):
    """Several shards and query blocks, columns whose names clash, a repeated id; integers beyond what doubles hold."""
    from pyspark.sql import functions as F

    rows = odd_vectors() + [(60, [3.0, -1.0, 0.5, 2.0])]
    df = vectors(spark, rows).select("*", *[F.lit(0).alias(c) for c in ("id", "vec", "score", "rank", "shard", "block", "query_id", "blob")])
    wanted = brute_top(rows, 20, scaled, lambda v: True)
    wanted.pop(60)  # two rows of one id: which of them asks is not said
    got = by_query(ball_tree.exact_top_k(df, shard_rows=9, block_queries=2).collect())
    got.pop(60)
    assert got == wanted
    many = by_query(projections.nearest(df, shard_rows=9, block_queries=2).collect())
    assert set(many) == {q for q in [*wanted, 60] if q != 220} and all(len(x) == 20 for x in many.values())
    pick = random.Random(9)
    big = [(i, [float(pick.randrange(1 << 28) * 2 + 1) for _ in range(4)]) for i in range(60)]
    frame = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    exact = {q: sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in big if i != q)[:20] for q, x in big if q % 20 == 0}
    assert by_query(ball_tree.exact_top_k(frame, scale=1.0, shard_rows=20).collect()) == exact
    with pytest.raises(ValueError):
        ball_tree.exact_top_k(frame, scale=float(1 << 20))


@pytest.mark.parametrize("search", [ball_tree.exact_top_k, projections.nearest])
def test_few_vectors(spark, search):
    assert search(vectors(spark, [])).count() == 0
    assert search(vectors(spark, [(20, [1.0, 2.0])])).count() == 0
    got = search(vectors(spark, [(20, [1.0, 2.0]), (21, [2.0, 1.0]), (7, [2.0, 1.0])])).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [7, 21]


# --- operator 3


def test_mixing(docs_of, tricky, empty):
    pick = random.Random(3)
    rows = TRICKY + [(300 + i, " ".join(["w"] * pick.randint(0, 400))) for i in range(400)]
    got = mixing.assign(docs_of(rows), keep=("source",)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words_of(t))) for i, t in rows)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    total = sum(r.size for r in got)
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]} and len({r.target for r in mine}) == 1
        assert mine[0].target <= 2 * sizes[source] and abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert all(0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)
    again = mixing.assign(docs_of(rows, 7), keep=("source",)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.assign(tricky).count() == len(TRICKY) and mixing.assign(empty).count() == 0
    small = mixing.assign(docs_of(rows), bucket_rows=2).collect()  # several digits of buckets
    assert Counter((r.doc_id, r.size, r.taken, r.position) for r in small) == Counter((r.doc_id, r.size, r.taken, r.position) for r in got)


def test_mixing_of_many_sources_and_null_ids(spark):
    """Targets by the contract's own loop; ids that are all null or equal."""
    pick = random.Random(4)
    rows = [(None if i % 3 else 5, " ".join(["w"] * pick.choice([0, 1, 5, 60])), None if i % 7 == 0 else f"s{pick.choice(range(25)) ** 2}") for i in range(900)]
    got = mixing.assign(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("source",)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, budget, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not above:
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    crowded = [mixing.assign(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n), keep=("source",), bucket_rows=4).collect() for n in (2, 5)]  # ids of very many rows
    again = [Counter((r.doc_id, r.size, r.source, r.taken) for r in x) for x in crowded]
    for x in crowded:
        taken = Counter()
        for r in x:
            taken[r.source] += r.taken
        assert len(x) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert again[0] == again[1]


def test_training_order(docs_of, tricky, empty):
    rows = [(300 + i, " ".join(["w"] * (i % 40))) for i in range(400)]
    docs = docs_of(rows + rows[:5])
    out = mixing.in_training_order(docs)
    assert out.columns == docs.columns
    placed = {}
    for r in mixing.copies(mixing.assign(docs, whole=True)).collect():
        placed.setdefault(r.doc_id, []).append(r.position)
    got = [r.doc_id for r in out.collect()]
    assert Counter(got) == Counter({i: len(p) for i, p in placed.items()})
    seen, order = Counter(), []
    for i in got:
        order.append(sorted(placed[i])[seen[i]])
        seen[i] += 1
    assert order == sorted(order)
    assert mixing.in_training_order(empty).count() == 0 and mixing.in_training_order(tricky).count() > 0


# --- operator 7


def test_template_language():
    said = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    text, spans = chat_template.render("{% for m in messages %}{% if m.role == 'user' %}U{% else %}A{% endif %}{% generation %}{{ m.text ~ '!' }}{% endgeneration %};{% endfor %}{% set x = 'e' %}{{ x }}", said)
    assert text == "Ua!;Ab!;e" and [text[a:b] for a, b in spans] == ["a!", "b!"]


@pytest.mark.parametrize("source", ["{{ missing }}", "{{ messages.__class__() }}", "{{ ''['x'] }}", "{% if 'a' %}x", "{% import os %}", "{{ open('/etc/passwd') }}", "{% endfor %}"])
def test_template_refuses(source):
    with pytest.raises(chat_template.TemplateError):
        chat_template.compile_template(source)


def test_conversations_come_back(spark):
    said = ["\\### Assistant: </turn> ok", "</turn>\n### Assistant: x", "\\\\<", "", None, "é🙂\n\n", "### ", "a:b#c<d\\"]
    rows = [(c, t, "assistant" if t % 2 else "user", said[(c + t) % len(said)], 0) for c in range(8) for t in range(6)] + [(None, 0, None, None, 0), (3, 5, "assistant", "again", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    wanted = Counter()
    for conv in {r[0] for r in rows}:
        wanted[conv] = sum(r[0] == conv for r in rows)
    assert {r.conv_id: r.n_turns for r in chat_template.read_back(df).collect()} == wanted
    for r in chat_template.format_conversations(df).collect():
        loss = "".join(chat_template.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans)
        mine = sorted(((t, x or "") for c, t, role, x, _ in rows if c == r.conv_id and role == "assistant"), key=lambda y: y[0])
        assert sorted(loss) == sorted("".join(x for _, x in mine)) and (r.conv_id == 3 or loss == "".join(x for _, x in mine))
    for kind in ("int", "string"):  # ids of any type
        other = df.withColumn("conv_id", df.conv_id.cast(kind))
        assert {None if r.conv_id is None else int(r.conv_id): r.n_turns for r in chat_template.read_back(other).collect()} == wanted
        assert chat_template.format_conversations(other).count() == len(wanted)
    assert chat_template.read_back(df.limit(0)).count() == 0 and chat_template.format_conversations(df.limit(0)).count() == 0


def test_long_conversations_and_clashing_names(spark):
    long = "x#<:\\" * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), *((2, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(5000))]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").selectExpr("*", "0 AS n_turns", "0 AS loss_chars", "0 AS formatted", "0 AS start", "0 AS conv")
    got = {r.conv_id: r for r in chat_template.read_back(df).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns) == (2, len(long), 5000)
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


# --- SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = db.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns)

    def rows(df):
        return Counter(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(wanted)


# --- pipeline


def brute_mix(rows, weights=(5.0, 2.0, 1.0), ramps=(-0.5, 0.0, 0.5)):
    """How often each (id, text, source) is taken whole, and the ids in training order."""
    size = [len(words_of(t)) for _, t, _ in rows]
    order = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in order}
    weight, target, free = {s: weights[i % 3] for i, s in enumerate(order)}, {}, set(order)
    while True:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= 2 * total[s]}
        if not above:
            break
        target |= {s: 2.0 * total[s] for s in above}
        free -= above
    target |= {s: level * weight[s] for s in free}
    taken, placed = Counter(), []
    for i, s in enumerate(order):
        ramp, passes = ramps[i % 3], int(target[s] // total[s]) if total[s] else 0
        run = 0
        for key, n, r in sorted((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), n, r) for n, r in zip(size, rows) if r[2] == s):
            extra = math.floor(target[s] - passes * total[s] + 0.5) - run
            times = (passes + (2 * extra >= n)) if n else 0
            taken[r] += times
            for k in range(times):
                share = min(1.0, (k * total[s] + run) / target[s])
                placed.append((share if not ramp else (math.sqrt(max(0, (1 - ramp) ** 2 + 4 * ramp * share)) - (1 - ramp)) / (2 * ramp), key, r[0]))
            run += n
    return +taken, placed


def test_pipeline_stage_by_stage(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        sources = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        after = stage(spark, docs, SF)
        after = spark.createDataFrame(after.collect(), after.schema)
        rows = after.collect()
        if name == "toxicity":
            detector = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), held_out=None)
            good = [p == 0 for p in (detector.scores([t or "" for _, t in before]) >= 0.3).astype(int)]
            assert Counter((r.doc_id, r.text) for r in rows) == Counter(x for x, g in zip(before, good) if g) and len(rows) >= 0.8 * len(before)
        elif name == "line dedup":
            assert Counter((r.doc_id, r.text or "") for r in rows) == Counter({(k[0], k[3]): n for k, n in brute_lines(before, 10).items()})
        elif name == "near duplicates":
            assert {r.doc_id for r in rows} == {x[0] for x in brute_near(before, 5, 80) if x[3]}
        elif name == "mixing":
            taken, placed = brute_mix(sources)
            assert Counter((r.doc_id, r.text, r.source) for r in rows) == taken
            position = {}
            for at, _, i in placed:
                position.setdefault(i, []).append(at)
            seen, order = Counter(), []
            for r in rows:
                order.append(sorted(position[r.doc_id])[seen[r.doc_id]])
                seen[r.doc_id] += 1
            assert all(a <= b + 1e-12 for a, b in zip(order, order[1:]))
        else:
            assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in before) and all(r.n_tokens == len(r.ids) for r in rows)
        if name != "byte-level BPE":
            assert after.columns == docs.columns[:5] == corpus_pipeline.COLUMNS
        docs, kept[name] = after, rows
    ran = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in ran) == Counter((r.doc_id, r.n_tokens) for r in kept["byte-level BPE"])


def test_one_row_of_each_group_stays(spark, docs_of):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (None, other), (None, other), (7, "a b c d e f"), (7, "a b c d e f"), (7, "g h i j k l"), (None, "m n o p q"), (9, None), (9, None), (None, "")]
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs_of(rows), SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, long), (None, other), (7, "a b c d e f"), (7, "g h i j k l"), (None, "m n o p q"), (9, None), (9, None), (None, "")])


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_tricky_and_empty_tables(spark, tricky, empty, stage):
    assert stage[1](spark, empty, SF).count() == 0
    assert stage[1](spark, tricky, SF).count() > 0
