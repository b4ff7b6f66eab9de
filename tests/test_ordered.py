"""Order statistics against numpy, with the splitting into bins forced on."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixedframe.operators.ordered import approx_quantiles, dense_positions, exact_median, exact_quantiles, running_sums


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, a third of those one value, one null key, some null values."""
    rng = np.random.default_rng(3)
    n = 6000
    key = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str))).astype(object)
    key[5:60] = None
    value = np.round(rng.lognormal(3, 2, n), 2)
    value[np.arange(n) % 9 == 0] = 7.25
    frame = pd.DataFrame({"key": key, "v": value})
    frame.loc[10:30, "v"] = np.nan
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return frame, df.repartition(5).cache()


@pytest.mark.parametrize("bin_rows", [50, 1_000_000])
def test_grouped_quantiles(skewed, bin_rows):
    frame, df = skewed
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.key: r for r in exact_quantiles(df, "v", probs, ["key"], bin_rows).collect()}
    groups = frame.dropna(subset=["v"]).groupby("key", dropna=False)["v"]
    assert len(got) == groups.ngroups
    for key, values in groups:
        row = got[None if pd.isna(key) else key]
        assert [row[n] for n in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))


@pytest.mark.parametrize("bin_rows", [50, 1_000_000])
def test_global_quantiles(skewed, bin_rows):
    frame, df = skewed
    row = exact_quantiles(df, "v", {"q": 0.37, "m": 0.5}, bin_rows=bin_rows).first()
    assert [row.q, row.m] == pytest.approx(list(np.quantile(frame["v"].dropna(), [0.37, 0.5])))


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_sums(skewed, keys):
    frame, df = skewed
    out = running_sums(df.withColumn("n", F.lit(1)), "v", ["n"], keys, bin_rows=50).toPandas()
    known = frame.dropna(subset=["v"])
    counts = known.groupby([*keys, "v"], dropna=False).size().rename("n").reset_index()
    if keys:
        counts["n_before"] = counts.groupby("key", dropna=False)["n"].cumsum() - counts["n"]
    else:
        counts["n_before"] = counts["n"].cumsum() - counts["n"]
    order = [*keys, "v"]
    a = out.sort_values(order)[[*order, "n", "n_before"]].reset_index(drop=True)
    b = counts.sort_values(order)[[*order, "n", "n_before"]].reset_index(drop=True)
    assert a.fillna("null").values.tolist() == b.fillna("null").values.tolist()
    assert out.groupby(keys, dropna=False)["n"].sum().sum() == len(known) if keys else out["n_total"].eq(len(known)).all()


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    assert exact_median(df, "v", ["k"]).count() == 0
    assert exact_median(df, "v").first().median is None


def test_approximate_quantiles_are_close(skewed):
    frame, df = skewed
    row = approx_quantiles(df, "v", {"m": 0.5}).first()
    assert abs((frame["v"] <= row.m).mean() - 0.5) < 0.2


def test_dense_positions(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.1)], "k string, s double")
    got = {r.k: r.p for r in dense_positions(df, "s", "p", descending=True, bin_rows=1).collect()}
    assert got == {"b": 1, "a": 2, "c": 2, "d": 3}
