"""Row-wise cleaning and learned cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    blank_to,
    canonicalize,
    collapse_target,
    fold_of,
    log10_or_zero,
    nonzero_flag,
    recode,
    replace_first,
    round_half_even,
    safe_divide,
    year_of,
)
from ..models.features import Standardizer, levels_of, one_hot
from ..operators.cleaning import ServiceYears, TopKLumper, align_levels, regex_value_counts
from ..models.evaluate import regression_metrics
from ..operators.impute import audit_group_median, impute_group_median, knn_impute, knn_impute_cv
from ..operators.profile import null_profile, value_counts
from .registry import query


@query(
    "log10_guarded",
    "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) ELSE 0 END, 6) AS balance_log FROM customer",
)
def log10_guarded(t):
    return t("customer").select("c_custkey", F.round(log10_or_zero("c_acctbal"), 6).alias("balance_log"))


@query("lower_case", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def lower_case(t):
    return t("customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))


# customer segments with one of them blanked and one turned into a junk token
_BLANKED_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN '_' ELSE lower(c_mktsegment) END"


@query(
    "blank_to_unknown",
    f"""
    WITH s AS (SELECT c_custkey, {_BLANKED_SQL} AS raw FROM customer)
    SELECT c_custkey, CASE WHEN raw IN (' ', '', '0', '_', '-') THEN 'unknown' ELSE raw END AS segment FROM s
    """,
)
def blank_to_unknown(t):
    raw = recode("c_mktsegment", {"BUILDING": "", "MACHINERY": "_"})
    return t("customer").select("c_custkey", blank_to(F.lower(raw)).alias("segment"))


@query(
    "recode_levels",
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
           WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority FROM orders
    """,
)
def recode_levels(t):
    merged = recode("o_orderpriority", {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"})
    return t("orders").select("o_orderkey", merged.alias("priority"))


@query(
    "canonicalize",
    """
    WITH a AS (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(re)|(ste)') AND NOT regexp_matches(p_name, '(green)|(plate)')
                                      THEN 'metal' ELSE p_name END AS v FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(v, '(bl)|(met)') AND NOT regexp_matches(v, '(bolt)') THEN 'blue' ELSE v END AS name_class
    FROM a
    """,
)
def canonicalize_query(t):
    rules = [("(re)|(ste)", "(green)|(plate)", "metal"), ("(bl)|(met)", "(bolt)", "blue")]
    return t("part").select("p_partkey", canonicalize("p_name", rules).alias("name_class"))


@query(
    "regex_value_counts",
    "SELECT p_name, count(*) AS n FROM part WHERE regexp_matches(p_name, 're') GROUP BY p_name",
)
def regex_value_counts_query(t):
    return regex_value_counts(t("part"), "p_name", "re")


@query("replace_first", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '-') AS name FROM part")
def replace_first_query(t):
    return t("part").select("p_partkey", replace_first("p_name", "[aeiou]+", "-").alias("name"))


@query("year_part", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS order_year FROM orders")
def year_part(t):
    return t("orders").select("o_orderkey", year_of("o_orderdate").cast("long").alias("order_year"))


@query(
    "years_in_service",
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) AS recorded,
                      CASE WHEN l_linestatus = 'O' THEN 0 ELSE year(l_shipdate) - CAST(l_quantity AS BIGINT) END AS built
               FROM lineitem),
         m AS (SELECT median(built) AS med FROM p WHERE built > 0)
    SELECT l_orderkey, l_linenumber,
           CAST(recorded - CASE WHEN built = 0 THEN med ELSE built END AS DOUBLE) AS years_op FROM p, m
    """,
)
def years_in_service_query(t):
    year = year_of("l_shipdate")
    rows = t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        year.alias("recorded"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(year - F.col("l_quantity").cast("int")).alias("built"),
    )
    fitted = ServiceYears("recorded", "built").fit(rows)
    return fitted.transform(rows).select("l_orderkey", "l_linenumber", F.col("years_op").cast("double"))


@query(
    "conditional_value",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN l_quantity ELSE -l_quantity END AS signed FROM lineitem",
)
def conditional_value(t):
    signed = F.when(F.col("l_discount") == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return t("lineitem").select("l_orderkey", "l_linenumber", signed.alias("signed"))


@query(
    "arith_cols",
    """
    SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax - l_discount, 6) AS mixed,
           round(l_extendedprice / l_quantity, 9) AS unit_price, round(l_tax / nullif(l_discount, 0), 6) AS tax_per_discount
    FROM lineitem
    """,
)
def arith_cols(t):
    return t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.col("l_quantity") + F.col("l_tax") - F.col("l_discount"), 6).alias("mixed"),
        F.round(safe_divide("l_extendedprice", "l_quantity"), 9).alias("unit_price"),
        F.round(safe_divide("l_tax", "l_discount"), 6).alias("tax_per_discount"),
    )


@query(
    "round_shares",
    "SELECT p_partkey, round_even(p_size / 4.0::DOUBLE, 0) AS quarter, round_even(p_size / 8.0::DOUBLE, 1) AS eighth FROM part",
)
def round_shares(t):
    return t("part").select(
        "p_partkey",
        round_half_even(F.col("p_size") / 4.0, 0).alias("quarter"),
        round_half_even(F.col("p_size") / 8.0, 1).alias("eighth"),
    )


@query(
    "cast_cols",
    """
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS custkey_text, CAST(floor(o_totalprice) AS BIGINT) AS price_whole,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_no,
           TRY_CAST(o_orderpriority AS INTEGER) AS not_a_number
    FROM orders
    """,
)
def cast_cols(t):
    return t("orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("custkey_text"),
        F.floor("o_totalprice").cast("long").alias("price_whole"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority_no"),
        F.col("o_orderpriority").try_cast("int").alias("not_a_number"),
    )


@query(
    "nonzero_flag",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS has_discount FROM lineitem",
)
def nonzero_flag_query(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", nonzero_flag("l_discount").alias("has_discount"))


@query("sqrt_col", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root FROM part")
def sqrt_col(t):
    return t("part").select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("root"))


@query(
    "null_profile",
    """
    WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_null, count(doc_id) AS n_present FROM j
    UNION ALL SELECT 'lang', count(*) - count(lang), count(lang) FROM j
    UNION ALL SELECT 'quality', count(*) - count(quality), count(quality) FROM j
    UNION ALL SELECT 'toxic', count(*) - count(toxic), count(toxic) FROM j
    """,
)
def null_profile_query(t):
    return null_profile(t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left"))


@query(
    "collapse_target",
    """
    SELECT CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'finished' END AS status2, count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def collapse_target_query(t):
    two = collapse_target("o_orderstatus", ["O", "P"], "open", "finished")
    return value_counts(t("orders").select(two.alias("status2")), "status2")


@query(
    "lump_top_k",
    """
    WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)
    SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'other' END AS brand10 FROM part
    """,
)
def lump_top_k(t):
    part = t("part").select("p_partkey", "p_brand")
    return TopKLumper("p_brand", 10).fit(part).transform(part, "brand10").select("p_partkey", "brand10")


@query(
    "lump_top_k_holdout",
    """
    WITH top AS (SELECT p_brand FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 20),
         s AS (SELECT p_partkey % 5 = 0 AS holdout, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'other' END AS brand20 FROM part)
    SELECT holdout, brand20, count(*) AS n FROM s GROUP BY ALL
    """,
)
def lump_top_k_holdout(t):
    """Levels learned on the training rows and applied to both parts."""
    part = t("part").select((F.col("p_partkey") % 5 == 0).alias("holdout"), "p_brand")
    model = TopKLumper("p_brand", 20).fit(part.filter(~F.col("holdout")))
    return value_counts(model.transform(part, "brand20"), "holdout", "brand20")


@query(
    "align_levels",
    """
    WITH seen AS (SELECT DISTINCT p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12'))
    SELECT p.p_partkey, CASE WHEN s.p_type IS NOT NULL THEN p.p_type ELSE 'unseen' END AS part_type
    FROM part p LEFT JOIN seen s ON p.p_type = s.p_type
    """,
)
def align_levels_query(t):
    part = t("part").select("p_partkey", "p_type", "p_brand")
    train = part.filter(F.col("p_brand").isin("Brand#11", "Brand#12"))
    return align_levels(part, train, "p_type", "part_type", "unseen").select("p_partkey", "part_type")


@query(
    "standardize",
    """
    WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders)
    SELECT o_orderkey, round((o_totalprice - m) / sd, 6) AS price_z FROM orders, s
    """,
)
def standardize(t):
    orders = t("orders").select("o_orderkey", "o_totalprice")
    scaled = Standardizer(["o_totalprice"]).fit(orders).transform(orders)
    return scaled.select("o_orderkey", F.round("o_totalprice", 6).alias("price_z"))


@query(
    "one_hot",
    """
    SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P"
    FROM orders
    """,
)
def one_hot_query(t):
    orders = t("orders")
    return one_hot(orders, "o_orderstatus", levels_of(orders, "o_orderstatus"), ["o_orderkey"])


@query(
    "fold_assignment",
    """
    SELECT o_orderkey, CAST((('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT) % 10 AS INTEGER) AS fold FROM orders
    """,
)
def fold_assignment(t):
    return t("orders").select("o_orderkey", fold_of("o_orderkey", 10).alias("fold"))


@query(
    "impute_group_median",
    """
    WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id)
    SELECT e.event_id, round(CASE WHEN e.value < 20 THEN m.med ELSE e.value END, 6) AS value2
    FROM events e JOIN m ON e.user_id = m.user_id
    """,
)
def impute_group_median_query(t):
    events = t("events").select("event_id", "user_id", "value")
    filled = impute_group_median(events, "user_id", "value", F.col("value") < 20, "value2")
    return filled.select("event_id", F.round("value2", 6).alias("value2"))


@query(
    "imputation_audit",
    """
    WITH m AS (SELECT c_nationkey, median(c_acctbal) AS med FROM customer GROUP BY c_nationkey),
         f AS (SELECT c.c_nationkey, c.c_acctbal, CASE WHEN c.c_acctbal < 2 THEN m.med ELSE c.c_acctbal END AS balance2
               FROM customer c JOIN m ON c.c_nationkey = m.c_nationkey),
         a AS (SELECT c_nationkey, median(c_acctbal) AS b, median(balance2) AS a FROM f GROUP BY c_nationkey)
    SELECT c_nationkey, round(b, 6) AS median_before, round(a, 6) AS median_after FROM a WHERE a <> b
    """,
)
def imputation_audit_query(t):
    customer = t("customer").select("c_nationkey", "c_acctbal")
    audit = audit_group_median(customer, "c_nationkey", "c_acctbal")
    return audit.select("c_nationkey", F.round("median_before", 6).alias("median_before"), F.round("median_after", 6).alias("median_after"))


@query(
    "knn_impute",
    """
    WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS lat, embedding[2]::DOUBLE AS lon,
                      CASE WHEN vec_id % 3 = 0 THEN 0 ELSE abs(embedding[3]::DOUBLE) END AS y FROM embeddings),
         d AS (SELECT q.vec_id, r.y, row_number() OVER (PARTITION BY q.vec_id
                      ORDER BY sqrt((q.lat - r.lat) * (q.lat - r.lat) + (q.lon - r.lon) * (q.lon - r.lon)), r.vec_id) AS rank
               FROM p q, p r WHERE q.y = 0 AND r.y <> 0),
         m AS (SELECT vec_id, avg(y) AS mean FROM d WHERE rank <= 5 GROUP BY vec_id)
    SELECT p.vec_id, round(CASE WHEN p.y = 0 THEN m.mean ELSE p.y END, 6) AS y2 FROM p LEFT JOIN m ON p.vec_id = m.vec_id
    """,
)
def knn_impute_query(t):
    e = F.col("embedding")
    points = t("embeddings").select(
        "vec_id",
        e[0].cast("double").alias("lat"),
        e[1].cast("double").alias("lon"),
        F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(F.abs(e[2].cast("double"))).alias("y"),
    )
    filled = knn_impute(points, "vec_id", ["lat", "lon"], "y", 5, output="y2")
    return filled.select("vec_id", F.round("y2", 6).alias("y2"))


@query(
    "knn_impute_cv",
    """
    WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS lat, embedding[2]::DOUBLE AS lon, embedding[3]::DOUBLE AS y,
                      (('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT) % 10 AS fold FROM embeddings),
         d AS (SELECT q.vec_id, q.y AS obs, r.y, row_number() OVER (PARTITION BY q.vec_id
                      ORDER BY sqrt((q.lat - r.lat) * (q.lat - r.lat) + (q.lon - r.lon) * (q.lon - r.lon)), r.vec_id) AS rank
               FROM p q JOIN p r ON q.fold <> r.fold),
         m AS (SELECT k, vec_id, max(obs) AS obs, avg(y) AS pred FROM d JOIN (VALUES (5), (7), (9), (11)) s(k) ON rank <= k GROUP BY k, vec_id)
    SELECT k, count(*) AS n, round(pow(corr(pred, obs), 2), 6) AS r2, round(sqrt(avg(pow(pred - obs, 2))), 6) AS rmse,
           round(avg(abs(pred - obs)), 6) AS mae FROM m GROUP BY k
    """,
)
def knn_impute_cv_query(t):
    """Held-out quality of the neighbour mean for four neighbour counts, in ten folds."""
    e = F.col("embedding")
    points = t("embeddings").select("vec_id", *[e[i].cast("double").alias(c) for i, c in enumerate(("lat", "lon", "y"))])
    out = regression_metrics(knn_impute_cv(points, "vec_id", ["lat", "lon"], "y", (5, 7, 9, 11), 10), "pred", "obs", ["k"])
    return out.select("k", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae")])
