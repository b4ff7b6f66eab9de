import numpy as np
import pytest
from pyspark.sql import functions as F

from mixedframe.operators import cleaning, distribution, impute, joins, profile, shaping


@pytest.fixture(scope="module")
def wells(spark):
    rows = [("a", "good", 0.0), ("a", "good", 10.0), ("a", "bad", 100.0), ("b", "bad", 1000.0), ("b", "bad", 0.0), (None, "good", 5.0)]
    return spark.createDataFrame(rows, "kind string, status string, pay double")


def test_crosstab_rows_sum_to_one_and_fill(wells):
    filled = profile.crosstab_shares(wells, "kind", "status", levels=["good", "bad"])
    got = {(r.kind, r.status): (r.n, r.share) for r in filled.collect()}
    assert got == {
        ("a", "good"): (2, 0.67), ("a", "bad"): (1, 0.33), ("b", "good"): (0, 0.0),
        ("b", "bad"): (2, 1.0), (None, "good"): (1, 1.0), (None, "bad"): (0, 0.0),
    }
    assert profile.crosstab_shares(wells, "kind", "status").count() == 4


def test_a_share_of_no_rows_is_unknown(wells):
    none = wells.where("false")
    assert profile.share(none, F.col("pay") > 0).first().share is None
    assert profile.value_shares(none, "kind").collect() == profile.group_share(none, ["kind"], F.col("pay") > 0).collect() == []


def test_structure_counts_levels_exactly(spark):
    df = spark.range(30_000).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    assert {r["column"]: r.n_levels for r in profile.describe_structure(df).collect()} == {"a": 30_000, "b": 7}


def test_density_of_groups_of_equal_values(spark):
    rows = [("one", 5.0)] + [("same", 100.0)] * 30 + [("mostly", 7.0)] * 20 + [("mostly", 90.0)] + [("spread", float(v)) for v in range(1, 50)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = distribution.density(df, "v", "g", grid=64).toPandas()
    assert got.groupby("g").size().to_dict() == {"one": 64, "same": 64, "mostly": 64, "spread": 64}
    assert (got.groupby("g")["density"].max() > 0).all() and got["density"].notna().all()
    x = np.log10(np.array([float(v) for v in range(1, 50)]))
    h = 1.8 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * 49**-0.2
    own = got[got["g"] == "spread"].sort_values("grid_no")
    exact = [2 * np.exp(-0.5 * ((p - x) / h) ** 2).sum() / (h * np.sqrt(2 * np.pi)) for p in own["x"]]
    assert own["density"].to_numpy() == pytest.approx(exact, rel=1e-3, abs=1e-4)


def test_class_profile(wells):
    rows = profile.class_profile(wells, "kind", "status", "bad").collect()
    assert [r.kind for r in rows] == ["b", "a", "a", None]
    assert {r.overall_share for r in rows} == {0.5}
    with pytest.raises(Exception, match="does not occur"):
        profile.class_profile(wells, "kind", "status", "worse").collect()


def test_level_summary_lumps_the_tail(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbccd"], "x string")
    assert [(r.x, r.n) for r in profile.level_summary(df, "x", 3).orderBy("rank").collect()] == [("a", 3), ("b", 2), ("(Other)", 3)]
    assert profile.level_summary(df, "x", 4).count() == 4


def test_null_group_is_a_group(wells):
    sized = profile.with_group_size(wells, ["kind"])
    assert {r.kind: r.group_n for r in sized.collect()} == {"a": 3, "b": 2, None: 1}


def test_lumper_fits_on_one_table(spark):
    train = spark.createDataFrame([(v,) for v in ["a", "a", "b", "c", "c", "d", None]], "x string")
    test = spark.createDataFrame([(v,) for v in ["a", "b", "new", None]], "x string")
    model = cleaning.TopKLumper("x", 3).fit(train)
    assert {r.x for r in model.levels.collect()} == {"a", "b", "c"}
    assert sorted((r.x or "", r.y) for r in model.transform(test, "y").collect()) == [("", "other"), ("a", "a"), ("b", "b"), ("new", "other")]
    many = spark.range(3000).select(F.col("id").cast("string").alias("x"))
    assert cleaning.TopKLumper("x", 2000).fit(many).transform(many).where("x = 'other'").count() == 1000


def test_group_median_imputation_counts_missing(spark):
    rows = [("r1", 0), ("r1", 0), ("r1", 50), ("r2", 0), ("r2", 40), ("r2", 60)]
    df = spark.createDataFrame(rows, "r string, p int")
    got = impute.impute_group_median(df, "r", "p", output="q").orderBy("r", "p").collect()
    assert [r.q for r in got] == [0.0, 0.0, 50.0, 40.0, 40.0, 60.0]
    audited = {tuple(r) for r in impute.audit_group_median(df, "r", "p").collect()}
    assert audited == {tuple(r) for r in profile.imputation_audit(impute.impute_group_median(df, "r", "p", output="q"), "r", "p", "q").collect()}
    other = spark.createDataFrame([("r1", 7), ("r2", 9)], "r string, p int")
    learned = impute.impute_group_median(df, "r", "p", output="q", medians=impute.group_medians(other, "r", "p"))
    assert {(r.r, r.q) for r in learned.where("p < 2").collect()} == {("r1", 7.0), ("r2", 9.0)}
    moved = profile.imputation_audit(impute.impute_group_median(df, "r", "p", output="q"), "r", "p", "q").collect()
    assert moved == []


def test_transitions_total(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "a")], "x string, y string")
    got = {(r.x, r.y): r.n for r in profile.transitions(df, "x", "y").collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 1, (None, None): 3}


def test_column_relation(spark):
    df = spark.createDataFrame([("1", "x", "g"), ("2", "y", "g"), ("2", "y", "g")], "a string, b string, c string")
    assert profile.column_relation(df, "a", "b").first().relabelling
    row = profile.column_relation(df, "a", "c").first()
    assert row.a_determines_b and not row.b_determines_a and not row.relabelling


def test_low_variance_and_nulls(wells):
    row = profile.low_variance(wells.withColumn("one", F.lit("x")), ["one"]).first()
    assert row.constant and row.top_share == 1.0 and row.n_rare_levels == 1
    nulls = {r["column"]: (r.n_null, r.n_present) for r in profile.null_profile(wells).collect()}
    assert nulls == {"kind": (1, 5), "status": (0, 6), "pay": (0, 6)}


def test_summary_exact_and_approximate(wells):
    exact = profile.numeric_summary(wells, ["pay"]).first()
    assert (exact.n, exact.min, exact.q1, exact.median, exact.q3, exact.max) == (6, 0.0, 1.25, 7.5, 77.5, 1000.0)
    rough = profile.numeric_summary(wells, ["pay"], approximate=True).first()
    assert rough.min == 0.0 and rough.median in (5.0, 10.0)


def test_histogram_counts_every_row(spark):
    values = np.random.default_rng(0).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = distribution.histogram(df, "x", 7).orderBy("bin").collect()
    assert [r.n for r in rows] == np.histogram(values, 7)[0].tolist()
    flat = distribution.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 3).orderBy("bin").collect()
    assert [r.n for r in flat] == [2, 0, 0]


def test_density_integrates_to_counts(spark):
    values = np.random.default_rng(1).lognormal(5, 1, 400)
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, x double")
    rows = distribution.density(df, "x", "k", grid=512, limits=(0.01, 10_000_000.0), count_scale=1.0).orderBy("grid_no").toPandas()
    assert rows["grid_no"].tolist() == list(range(512))
    assert np.trapezoid(rows["density"], rows["x"]) == pytest.approx(400, rel=1e-3)


def test_box_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 50.0]
    row = distribution.box_stats(spark.createDataFrame([("g", v) for v in values], "k string, x double"), "k", "x", log10=False).first()
    assert (row.whisker_lo, row.whisker_hi, row.n_outliers) == (1.0, 5.0, 1)


def test_qq_pairs_keep_every_tie(spark, monkeypatch):
    monkeypatch.setattr(distribution, "RANKS_PER_ROW", 4)
    df = spark.createDataFrame([(1.0,)] * 11 + [(2.0,)], "x double")
    rows = distribution.qq_normal(df, "x").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 13)) and [r.sample for r in rows] == [1.0] * 11 + [2.0]
    assert rows[0].theoretical == pytest.approx(-rows[-1].theoretical)


def test_geo_label_has_no_trailing_zero(spark):
    df = spark.createDataFrame([(-3.0, 35.128, "f"), (-3.004, 35.13, "f")], "la double, lo double, s string")
    row = distribution.geo_grid(df, "la", "lo", "s").collect()
    assert [(r.latlong, r.n) for r in row] == [("-3:35.13", 2)]


def test_joins_by_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, s string")
    right = spark.createDataFrame([(1, 10), (3, 30), (9, 90)], "id long, v int")
    joined = joins.left_join(left, right, "id")
    assert joined.columns == ["id", "s", "v"] and {r.id: r.v for r in joined.collect()} == {1: 10, 2: None, 3: 30}
    assert joins.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    assert shaping.first_n(left, 2, [F.desc("id")]).collect()[0].id == 3
