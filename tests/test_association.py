import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixedframe.operators import association as a


@pytest.fixture(scope="module")
def mini(spark):
    rows = [
        (1.0, 2.0, "p", "u", 5, "only", 1e9 + 1.0),
        (1.0, 2.0, "p", "v", 5, "only", 1e9 + 1.0),
        (3.0, 6.0, "q", "u", 5, "only", 1e9 + 3.0),
        (3.0, 6.0, "q", "v", 5, "only", 1e9 + 3.0),
        (None, 8.0, "q", "u", 5, "only", 1e9 + 3.0),
        (9.0, None, None, "v", 5, "only", None),
    ]
    return spark.createDataFrame(rows, "x double, y double, a string, b string, c int, d string, big double")


def r_of(df):
    return df.first().r


def test_pearson(mini):
    assert r_of(a.pearson(mini, "x", "y")) == pytest.approx(1.0)
    assert a.pearson(mini, "x", "y").first().n == 4
    assert r_of(a.pearson(mini, "x", "c")) is None
    assert r_of(a.pearson(mini.withColumn("z", -F.col("x")), "x", "z")) == pytest.approx(-1.0)


def test_correlation_ratio(mini):
    assert r_of(a.correlation_ratio(mini, "x", "a")) == pytest.approx(1.0)
    assert r_of(a.correlation_ratio(mini.filter("y is not null and x is not null"), "x", "b")) == pytest.approx(0.0)
    assert r_of(a.correlation_ratio(mini, "x", "d")) is None
    # no cancellation when the mean is far larger than the spread
    assert r_of(a.correlation_ratio(mini, "big", "a")) == pytest.approx(1.0)


def test_cramers_v(mini):
    even = mini.filter("x is not null and y is not null")
    assert r_of(a.cramers_v(even, "a", "b")) == pytest.approx(0.0)
    assert r_of(a.cramers_v(mini, "a", "a")) == pytest.approx(1.0)
    assert r_of(a.cramers_v(mini, "a", "d")) is None


def test_matrix_is_symmetric_with_unit_diagonal(mini):
    m = a.association_matrix(mini, ["x", "y", "a", "b", "c", "d"]).collect()
    cell = {(r.col_x, r.col_y): r.r for r in m}
    assert len(m) == len(cell) == 36
    assert all(v == cell[y, x] or math.isclose(v, cell[y, x]) for (x, y), v in cell.items() if v is not None)
    assert {c: cell[c, c] for c in "xyab"} == pytest.approx(dict.fromkeys("xyab", 1.0))
    assert cell["c", "c"] is None and cell["d", "d"] is None


def test_matrix_against_formulas(spark):
    rng = np.random.default_rng(4)
    n = 900
    g = rng.integers(0, 5, n)
    f = pd.DataFrame({"x": rng.normal(size=n) + g, "y": rng.normal(size=n), "g": g.astype(str), "h": ((g + rng.integers(0, 2, n)) % 4).astype(str)})
    cell = {(r.col_x, r.col_y): r.r for r in a.association_matrix(spark.createDataFrame(f)).collect()}
    assert cell["x", "y"] == pytest.approx(f["x"].corr(f["y"]))
    means = f.groupby("g")["x"].transform("mean")
    eta = math.sqrt(((means - f["x"].mean()) ** 2).sum() / ((f["x"] - f["x"].mean()) ** 2).sum())
    assert cell["x", "g"] == pytest.approx(eta) and cell["g", "x"] == pytest.approx(eta)
    t = pd.crosstab(f["g"], f["h"])
    e = np.outer(t.sum(axis=1), t.sum(axis=0)) / n
    assert cell["g", "h"] == pytest.approx(math.sqrt(((t.to_numpy() - e) ** 2 / e).sum() / n / 3))
    strong = a.strong_pairs(a.association_matrix(spark.createDataFrame(f)), 0.5).collect()
    assert [(r.col_x, r.col_y) for r in strong] == sorted(
        [k for k, v in cell.items() if k[0] < k[1] and abs(v) > 0.5], key=lambda k: -abs(cell[k])
    )


def test_type_gate(spark):
    df = spark.createDataFrame([([1.0], True)], "v array<double>, b boolean")
    with pytest.raises(TypeError, match="v is array"):
        a.association_matrix(df, ["v"])
    with pytest.raises(TypeError, match="b is boolean"):
        a.association_matrix(df, ["b"])


def test_display_layout(mini):
    square = a.matrix_display(a.association_matrix(mini, ["x", "y"]), ["x", "y"])
    assert square.columns == ["col_x", "x", "y"] and square.count() == 2
