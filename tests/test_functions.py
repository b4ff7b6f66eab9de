from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from mixedframe import functions as fn


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_log10_or_zero(spark):
    assert column(spark, [100.0, 0.0, -5.0, None], "double", fn.log10_or_zero("x")) == [2.0, 0.0, 0.0, 0.0]


def test_blank_to(spark):
    got = column(spark, [" ", "", "0", "_", "-", "dwe", None], "string", fn.blank_to("x"))
    assert got == ["unknown"] * 5 + ["dwe", None]


def test_recode_short_and_long_maps(spark):
    values = ["a", "b", "z", None]
    assert column(spark, values, "string", fn.recode("x", {"a": "b", "b": "c"})) == ["b", "c", "z", None]
    wide = {f"k{i}": f"v{i}" for i in range(80)} | {"a": "b"}
    assert column(spark, values, "string", fn.recode("x", wide)) == ["b", "b", "z", None]


def test_canonicalize_rules_apply_in_order(spark):
    funder = [("(gov)|(dist)|(coun)", "(village)|(ital)", "gov"), ("(comm)|(vill)", "(bank)", "comm")]
    installer = [("(gov)|(dist)|(coun)", "(ital)", "gov"), ("(comm)|(vill)", "(bank)", "comm")]
    names = ["village council", "central government", "italian gov", "comm bank", "village community", None]
    assert column(spark, names, "string", fn.canonicalize("x", funder)) == ["comm", "gov", "italian gov", "comm bank", "comm", None]
    assert column(spark, names, "string", fn.canonicalize("x", installer)) == ["gov", "gov", "italian gov", "comm bank", "comm", None]


def test_replace_first(spark):
    got = column(spark, ["rf_rf_a", "a_rf_b", "none", "x\nrf_y"], "string", fn.replace_first("x", "rf_", ""))
    assert got == ["rf_a", "a_b", "none", "x\ny"]
    assert column(spark, ["abc"], "string", fn.replace_first("x", "b", "$1")) == ["a$1c"]
    # back-references count from the pattern's own first group, and its dot stops at a line end
    assert column(spark, ["xaab", "aaaa", None], "string", fn.replace_first("x", r"(a)\1", "_")) == ["x_b", "_aa", None]
    assert column(spark, ["a\nbc"], "string", fn.replace_first("x", "b.|a.", "_")) == ["a\n_"]


def test_round_half_even(spark):
    assert column(spark, [0.5, 1.5, 2.5, 0.125], "double", fn.round_half_even("x", 0)) == [0.0, 2.0, 2.0, 0.0]
    assert column(spark, [0.125, 0.375], "double", fn.round_half_even("x", 2)) == [0.12, 0.38]


def test_collapse_and_flags(spark):
    got = column(spark, ["a", "b", "c", None], "string", fn.collapse_target("x", ["a", "b"], "yes", "no"))
    assert got == ["yes", "yes", "no", None]
    assert column(spark, [0.0, 3.0], "double", fn.nonzero_flag("x")) == [0, 1]
    assert column(spark, [4.0], "double", fn.safe_divide(F.lit(1.0), F.col("x") - 4)) == [None]


def test_years_in_service(spark):
    assert column(spark, [0, 1990], "int", fn.years_in_service(F.lit(2011), "x", 2000.0)) == [11.0, 21.0]


def test_fold_is_stable_and_even(spark):
    df = spark.range(10_000).select(fn.fold_of("id", 10).alias("f"))
    sizes = {r.f: r["count"] for r in df.groupBy("f").count().collect()}
    assert set(sizes) == set(range(10)) and min(sizes.values()) > 850


def test_normal_quantile(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.01, 0.074, 0.076, 0.3, 0.5, 0.75, 0.93, 0.999999]
    got = column(spark, ps, "double", fn.normal_quantile(F.col("x")))
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-9)
    assert column(spark, [0.0, 1.0, None], "double", fn.normal_quantile(F.col("x"))) == [None] * 3
