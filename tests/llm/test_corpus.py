"""Mixing, packing, the pipeline, and the registered queries."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from mixedframe.llm.mixing import SEED, mix_sources, mixture_rates, poisson_steps
from mixedframe.llm.packing import EXACT, cell_top, optimal_bounds, pack
from mixedframe.llm.queries import ORACLES, QUERIES


def uniform(i):
    return int(hashlib.md5(f"{SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, u):
    k, below = 0, math.exp(-rate)
    while below <= u:
        k += 1
        below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


@pytest.fixture(scope="module")
def sourced(spark):
    rows = [(i, f"text {i}", "big" if i % 4 else f"s{i % 3}", 1) for i in range(3000)]
    rows += [(None, "no id", "big", 1), (7, "text 7", "big", 1), (4001, None, None, 1), (4002, "", "rare", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight int"), rows


def test_copies_are_the_inverse_poisson_draw(sourced):
    docs, rows = sourced
    rates = {r.source: r.rate for r in mixture_rates(docs).collect()}
    sizes = Counter(r[2] for r in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    assert rates == pytest.approx({s: math.sqrt(n) / total * len(rows) / n for s, n in sizes.items()})
    got = Counter((r.doc_id, r.source) for r in mix_sources(docs).collect())
    want = Counter()
    for i, _, s, _ in rows:
        want[i, s] += poisson(rates[s], uniform(i))
    assert got == Counter({k: n for k, n in want.items() if n})


def test_mixture_meets_given_weights(spark, sourced):
    docs, rows = sourced
    weights = spark.createDataFrame([("big", 1.0), ("s0", 2.0), ("s1", 1.0), ("unknown", 5.0), ("s2", -1.0)], "source string, weight double")
    mixed = mix_sources(docs, weights, epochs=3.0)
    share = {r.source: r.n / mixed.count() for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert share == pytest.approx({"big": 0.25, "s0": 0.5, "s1": 0.25}, abs=0.03)
    assert set(docs.columns) <= set(mixed.columns)


def test_large_rates_and_empty_tables(spark, sourced):
    docs, _ = sourced
    steps = spark.createDataFrame([(r,) for r in (0.0, 0.3, 50.0, 900.0)], "rate double").select(poisson_steps(F.col("rate")).alias("c")).collect()
    assert [s.c[-1] for s in steps] == pytest.approx([1.0] * 4)
    assert steps[3].c[900] == pytest.approx(0.5, abs=0.02)
    assert mix_sources(docs.where("false")).collect() == [] == pack(docs.where("false")).collect()
    assert mix_sources(docs, docs.select("source", "weight").where("false")).collect() == []


def padding(lengths, counts, bounds):
    return sum(next(b for b in bounds if b >= x) * c - x * c for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    import random

    rng = random.Random(0)
    for _ in range(60):
        n = rng.randrange(1, 9)
        lengths = sorted(rng.sample(range(0, 60), n))
        counts = [rng.randrange(1, 30) for _ in range(n)]
        for k in range(1, 6):
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, n)) for c in itertools.combinations(lengths[:-1], r))
            bounds = optimal_bounds(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1]
            assert padding(lengths, counts, bounds) == best


def test_histogram_cells(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, EXACT - 1, EXACT, 5000, 123_457, 10**7 + 1)], "n long").select("n", cell_top(F.col("n")).alias("t")).collect()
    assert [r.t for r in got[:4]] == [0, 1, EXACT - 1, EXACT]
    assert all(r.n <= r.t <= r.n * (1 + 1 / 2048) + 1 for r in got)


def test_batches_fill_without_gaps(spark, monkeypatch):
    monkeypatch.setattr("mixedframe.llm.packing.SLICE", 40)
    rows = [(i, " ".join("w" for _ in range(i % 50))) for i in range(800)] + [(900, "w " * 3000), (901, None), (902, ""), (None, "a b"), (5, "w w w w w")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bucket int")
    got = pack(docs, buckets=4, budget=1000).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len((t or "").split())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.padded_to
        slots[r.bucket, r.padded_to].append((r.batch, r.slot))
    for (_, padded), places in slots.items():
        room = max(1, 1000 // max(1, padded))
        assert sorted(places) == [divmod(n, room) for n in range(len(places))]


def test_long_texts_get_bounds_that_are_lengths(spark):
    """Six texts of 21,845 words fit three to a batch; among many long lengths the plan is the best of all."""
    from mixedframe.llm.packing import plan_buckets

    same = spark.createDataFrame([(i, 21_845) for i in range(6)], "doc_id long, n int")
    assert {(r.padded_to, r.batch, r.slot) for r in pack(same, F.col("n").cast("long"), budget=65_536).collect()} == {(21_845, n // 3, n % 3) for n in range(6)}
    rng = __import__("random").Random(3)
    lengths = [int(10 ** rng.uniform(3.5, 5)) for _ in range(4000)]
    table = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    counts = Counter(lengths)
    exact = optimal_bounds(sorted(counts), [counts[n] for n in sorted(counts)], 6)
    plan = plan_buckets(table, 6, 65_536)
    cost = lambda bounds: padding(sorted(counts), [counts[n] for n in sorted(counts)], bounds)
    assert cost(plan.bounds) == cost(exact) and set(plan.bounds) <= set(counts)
    assert plan.counts == [sum(c for n, c in counts.items() if low < n <= high) for low, high in zip([-1, *plan.bounds], plan.bounds)]


def test_rows_without_an_id_are_dealt_to_many_slices(spark, monkeypatch):
    monkeypatch.setattr("mixedframe.llm.packing.SLICE", 50)
    docs = spark.createDataFrame([(None, "one two")] * 1500 + [(7, "one two")] * 500, "doc_id long, text string").repartition(3)
    got = pack(docs, budget=100).collect()
    assert sorted((r.batch, r.slot) for r in got) == [divmod(n, 50) for n in range(2000)]


@pytest.fixture(scope="module")
def staged(spark, data_dir):
    docs, out = spark.read.parquet(f"{data_dir}/documents.parquet"), []
    odd = spark.createDataFrame(
        [(90_000, None, "en", "src1", 0), (90_001, "", None, None, 0), (90_002, "12 34", "en", "src1", 5), (None, "the end of and the", "en", None, 18), (90_003, "and the password=abcdefgh12 of the end", "en", "src1", 38)], docs.schema
    )
    rows = docs.unionByName(odd)
    from mixedframe.session import stage

    for name, apply in corpus_pipeline.STAGES:
        before, rows = rows, stage(apply(spark, rows, data_dir), name)
        out.append((name, before, rows))
    return out


def test_pipeline_stages(staged):
    parts = {name: (before, after) for name, before, after in staged}
    assert list(parts) == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    for name, (before, after) in parts.items():
        if name != "packing":
            assert after.columns == before.columns
    before, after = parts["language"]
    gone = {r.doc_id for r in before.join(after.select("doc_id"), "doc_id", "left_anti").collect()}
    assert {90_000, 90_001, 90_002} <= gone and len(gone) <= 4
    before, after = parts["near_duplicates"]
    from test_neardup import brute

    rows = [(r.doc_id, r.text) for r in before.collect()]
    kept = {i for i, (_, label) in brute(rows).items() if i == label}
    assert {r.doc_id for r in after.collect()} - {None} == kept
    before, after = parts["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    changed = [r for r in after.collect() if r.text != texts[r.doc_id]]
    assert after.count() == before.count() and changed and all("[SECRET]" in r.text for r in changed)
    before, after = parts["mixing"]
    rates = {r.source: r.rate for r in mixture_rates(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({r.doc_id: n for r in before.collect() if (n := poisson(rates[r.source], uniform(r.doc_id)))})
    before, after = parts["packing"]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.collect())


def test_stages_keep_columns_whatever_their_names(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").limit(40)
    names = ("score", "lang_pred", "secrets", "personal", "kept", "copy", "rate", "n", "bucket")
    rows = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, apply in corpus_pipeline.STAGES[:-1]:
        rows = apply(spark, rows, data_dir)
        assert rows.columns == [*docs.columns, *names]
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows.collect() for c in names)


def test_many_sources_are_joined_without_a_broadcast(spark, sourced, monkeypatch):
    docs, _ = sourced
    want = sorted((r.doc_id or -1, r.source or "", r["__copy"]) for r in mix_sources(docs).collect())
    monkeypatch.setattr("mixedframe.llm.mixing.SMALL", 0)
    assert sorted((r.doc_id or -1, r.source or "", r["__copy"]) for r in mix_sources(docs).collect()) == want


def test_pipeline_over_an_empty_table(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet").where("false")
    for _, apply in corpus_pipeline.STAGES:
        rows = apply(spark, rows, data_dir)
    assert rows.collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_on_the_driver_tables(spark, data_dir, name):
    got = queries()[name](spark, data_dir)
    assert got.count() > 0
    if name in ORACLES:
        assert difference(got.toPandas(), duck(data_dir).execute(ORACLES[name]).df()) is None
