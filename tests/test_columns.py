"""Dependencies among columns, the approximate neighbour join, and densities against the exact kernel sum."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixedframe.operators import dependencies, distribution
from mixedframe.operators.dependencies import column_dependencies
from mixedframe.operators.near_buckets import BucketIndex, approximate_knn_join
from mixedframe.operators.neighbours import knn_join


def plain_dependencies(frame, max_size):
    cols, found = list(frame.columns), {}
    for size in range(1, max_size + 1):
        for s in combinations(cols, size):
            for d in cols:
                if d in s or any(d in found.get(p, ()) for n in range(1, size) for p in combinations(s, n)):
                    continue
                if any(c in found.get(tuple(x for x in s if x != c), ()) for c in s):
                    continue
                rows = frame[[*s, d]].dropna()
                if (rows.groupby(list(s))[d].nunique() <= 1).all():
                    found.setdefault(s, set()).add(d)
    return {(",".join(s), d, len(s), len(s) == 1 and s[0] in found.get((d,), ())) for s, ds in found.items() for d in ds}


@pytest.mark.parametrize("at_once", [400, 3])
def test_all_dependencies_are_found(spark, monkeypatch, at_once):
    monkeypatch.setattr(dependencies, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    n = 600
    a, b = rng.integers(0, 12, n), rng.integers(0, 9, n)
    frame = pd.DataFrame({"key": range(n), "a": a, "same": [f"l{x}" for x in a], "half": a // 2, "b": b, "ab": (a * 7 + b) % 5, "one": 1, "x": rng.integers(0, 4, n)})
    frame["holes"] = np.where(rng.random(n) < 0.1, None, [f"h{x % 3}" for x in a])
    df = spark.createDataFrame(frame.astype({"holes": object})).repartition(3)
    got = {tuple(r) for r in column_dependencies(df, max_size=2).collect()}
    assert got == plain_dependencies(frame, 2)
    assert ("a", "same", 1, True) in got and ("a,b", "ab", 2, False) in got and ("a", "half", 1, False) in got


def test_a_single_exception_breaks_a_dependency(spark):
    df = spark.range(20_000).select((F.col("id") % 100).alias("a"), F.when(F.col("id") == 77, -1).otherwise(F.col("id") % 10).alias("b"))
    assert column_dependencies(df).collect() == []
    assert column_dependencies(df.where("b >= 0")).count() == 1
    assert column_dependencies(df.where("1 = 0")).count() == 2


def clustered(n=4000, d=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (60, d))
    return centres[rng.integers(0, 60, n)] + rng.normal(0, 0.5, (n, d))


def test_approximate_join_finds_nine_in_ten_and_compares_few(spark):
    x = clustered()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(4)
    index = BucketIndex("id", "v", 7, exclude_self=True).fit(df)
    got = index.join(df, "id").toPandas()
    assert got.groupby("id")["rank"].max().max() <= 7 and len(got) == got.drop_duplicates(["id", "ref_key"]).shape[0]
    found = got.groupby("id")["ref_key"].agg(set)
    hits = []
    for i in range(0, len(x), 13):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hits.append(len(set(np.argsort(d)[:7]) & found.get(i, set())) / 7)
    assert np.mean(hits) >= 0.9 and index.measured >= 0.95
    assert index.visited_share(df, "id") < 0.3
    far = got.iloc[0]
    assert far["distance"] == pytest.approx(np.sqrt(((x[int(far["id"])] - x[int(far["ref_key"])]) ** 2).sum()))


def test_approximate_join_on_few_numbers_equals_the_exact_one_mostly(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((1500, 2)))], "id long, a double, b double")
    near = approximate_knn_join(df, df, "id", ["a", "b"], 5, exclude_self=True, block=300)
    exact = knn_join(df, df, "id", ["a", "b"], 5, exclude_self=True)
    assert near.join(exact, ["id", "ref_key"]).count() >= 0.9 * 1500 * 5


def test_equal_rows_missing_numbers_and_empty_tables(spark):
    rows = [(i, 1.0, 2.0) for i in range(200)] + [(300, None, 1.0), (301, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = approximate_knn_join(df, df, "id", ["a", "b"], 3, exclude_self=True, block=32).toPandas()
    assert (got[got["id"] < 200].groupby("id").size() == 3).all()
    assert got[got["id"] == 300]["ref_key"].isna().all()
    none = approximate_knn_join(df, df.where("1 = 0"), "id", ["a", "b"], 3)
    assert none.count() == 202 and none.where("ref_key IS NOT NULL").count() == 0


def test_copies_add_no_compared_pairs(spark):
    rng = np.random.default_rng(11)
    points = [(float(a), float(b)) for a, b in rng.random((300, 2))]
    df = spark.createDataFrame([(i, *points[i % 300]) for i in range(9000)], "id long, a double, b double")
    index = BucketIndex("id", ["a", "b"], 3, exclude_self=True).fit(df)
    assert index.refs.count() == 300 * 4 * index.tables and index.visited_share(df, "id") < 0.1
    got = index.join(df, "id").toPandas().sort_values(["id", "rank"])
    assert len(got) == 3 * 9000 and (got["distance"] == 0).all()
    # of thirty copies the first three others by key
    want = [[i % 300 + 300 * c for c in range(4) if i % 300 + 300 * c != i][:3] for i in range(9000)]
    assert got["ref_key"].to_numpy().reshape(-1, 3).tolist() == want


def kernel_sum(values, grid, adjust=2.0, scale=2.0):
    values = np.asarray(values, float)
    q1, q3 = np.quantile(values, [0.25, 0.75])
    sd = values.std(ddof=1) if len(values) > 1 else np.nan
    spread = next(v for v in (min(sd, (q3 - q1) / 1.34), sd, abs(values.min()), 1.0) if v > 0)
    h = adjust * 0.9 * spread * len(values) ** -0.2
    return np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (h * np.sqrt(2 * np.pi)) * scale


@pytest.mark.parametrize("limits", [None, (0.001, 1e6)])
def test_density_is_the_exact_sum_even_with_an_outlier(spark, limits):
    rng = np.random.default_rng(7)
    groups = {"bulk": np.concatenate([rng.normal(5, 0.1, 3000), [900_000.0]]), "wide": rng.random(500) * 1000 + 0.01, "equal": np.full(40, 3.0), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = distribution.density(df, "v", "g", grid=400, limits=limits, log10=False).toPandas().sort_values("grid_no")
    for g, own in got.groupby("g"):
        want = kernel_sum(groups[g], own["x"].to_numpy())
        assert len(own) == 400 and own["density"].to_numpy() == pytest.approx(want, rel=1e-9, abs=1e-9 * want.max())


def test_density_of_one_value_everywhere(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5, "g string, v double")
    got = distribution.density(df, "v", "g", grid=4, limits=None, log10=False).toPandas()
    assert len(got) == 4 and (got["x"] == 2.0).all() and got["density"].to_numpy() == pytest.approx(kernel_sum([2.0] * 5, np.full(4, 2.0)))
