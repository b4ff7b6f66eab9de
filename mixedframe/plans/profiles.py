"""Profiling and distribution queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import CENTRE_DEN, CENTRE_NUM, MIDDLE_DEN, MIDDLE_NUM, TAIL_DEN, TAIL_NUM
from ..operators import distribution, profile
from ..operators.dependencies import column_dependencies
from .registry import query


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(t):
    return profile.row_count(t("lineitem"))


@query("value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def value_counts(t):
    return profile.value_counts(t("lineitem"), "l_returnflag")


@query(
    "value_shares",
    "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM events GROUP BY event_type",
)
def value_shares(t):
    return profile.value_shares(t("events"), "event_type").withColumn("share", F.round("share", 6))


KINDS = [e + s for e in ("click", "error", "purchase", "signup", "view") for s in ("", "-large")]


@query(
    "crosstab_row_shares",
    """
    WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS grp, CASE WHEN value > 150 THEN event_type || '-large' ELSE event_type END AS kind FROM events),
         c AS (SELECT grp, kind, count(*) AS n FROM e GROUP BY grp, kind),
         f AS (SELECT g.grp, k.kind FROM (SELECT DISTINCT grp FROM c) g,
                    (SELECT e || s AS kind FROM unnest(['click', 'error', 'purchase', 'signup', 'view']) x(e), unnest(['', '-large']) y(s)) k)
    SELECT f.grp, f.kind, coalesce(c.n, 0) AS n,
           round_even(coalesce(c.n, 0)::DOUBLE / sum(coalesce(c.n, 0)) OVER (PARTITION BY f.grp), 2) AS share
    FROM f LEFT JOIN c ON f.grp = c.grp AND f.kind = c.kind
    """,
)
def crosstab_row_shares(t):
    large = F.when(F.col("value") > 150, F.concat("event_type", F.lit("-large"))).otherwise(F.col("event_type"))
    rows = t("events").select((F.col("user_id") % 40).cast("string").alias("grp"), large.alias("kind"))
    return profile.crosstab_shares(rows, "grp", "kind", 2, KINDS)


@query(
    "share_of_rows",
    "SELECT round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS no_discount_share FROM lineitem",
)
def share_of_rows(t):
    out = profile.share(t("lineitem"), F.col("l_discount") == 0, "no_discount_share")
    return out.select(F.round("no_discount_share", 6).alias("no_discount_share"))


@query(
    "missing_profile",
    """
    WITH m AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS l_discount, count(*) FILTER (WHERE l_tax = 0) AS l_tax,
                      count(*) FILTER (WHERE l_quantity < 2) AS l_quantity, count(*) FILTER (WHERE l_returnflag IN ('', 'N')) AS l_returnflag
               FROM lineitem)
    SELECT n AS n_rows, 'l_discount' AS "column", l_discount AS n_missing, round(l_discount / n::DOUBLE, 6) AS share FROM m
    UNION ALL SELECT n, 'l_tax', l_tax, round(l_tax / n::DOUBLE, 6) FROM m
    UNION ALL SELECT n, 'l_quantity', l_quantity, round(l_quantity / n::DOUBLE, 6) FROM m
    UNION ALL SELECT n, 'l_returnflag', l_returnflag, round(l_returnflag / n::DOUBLE, 6) FROM m
    """,
)
def missing_profile(t):
    rules = {
        "l_discount": F.col("l_discount") == 0,
        "l_tax": F.col("l_tax") == 0,
        "l_quantity": F.col("l_quantity") < 2,
        "l_returnflag": F.col("l_returnflag").isin("", "N"),
    }
    return profile.missing_profile(t("lineitem"), rules).withColumn("share", F.round("share", 6))


def _summary_sql(col: str) -> str:
    return f"""
    SELECT '{col}' AS "column", count({col}) AS n, round(min({col}), 4) AS min, round(quantile_cont({col}, 0.25), 4) AS q1,
           round(median({col}), 4) AS median, round(avg({col}), 4) AS mean, round(quantile_cont({col}, 0.75), 4) AS q3,
           round(max({col}), 4) AS max FROM lineitem"""


@query(
    "numeric_summary",
    " UNION ALL ".join(_summary_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")),
)
def numeric_summary(t):
    out = profile.numeric_summary(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "n", *[F.round(c, 4).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")])


@query(
    "level_summary",
    """
    WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS supplier, count(*) AS n FROM lineitem GROUP BY 1),
         r AS (SELECT supplier, n, row_number() OVER (ORDER BY n DESC, supplier) AS rank, count(*) OVER () AS levels FROM c)
    SELECT supplier, n, CAST(rank AS INTEGER) AS rank FROM r WHERE levels <= 60 OR rank < 60
    UNION ALL
    SELECT '(Other)', CAST(sum(n) AS BIGINT), 60 FROM r WHERE levels > 60 AND rank >= 60 HAVING count(*) > 0
    """,
)
def level_summary(t):
    rows = t("lineitem").select(F.col("l_suppkey").cast("string").alias("supplier"))
    return profile.level_summary(rows, "supplier", 60)


@query(
    "grouped_multi_agg",
    """
    SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS n_true, round(median(value), 6) AS median_value,
           round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type
    """,
)
def grouped_multi_agg(t):
    out = profile.grouped_summary(t("events"), ["event_type"], "value", F.col("value") > 100)
    return out.select(
        "event_type", "n", "n_true", *[F.round(c, 6).alias(c) for c in ("median_value", "max_value", "mean_value")]
    )


@query(
    "grouped_share",
    "SELECT l_returnflag, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS share FROM lineitem GROUP BY l_returnflag",
)
def grouped_share(t):
    out = profile.group_share(t("lineitem"), ["l_returnflag"], F.col("l_discount") == 0)
    return out.withColumn("share", F.round("share", 6))


@query("median_where", "SELECT round(median(c_acctbal), 6) AS median FROM customer WHERE c_acctbal > 0")
def median_where(t):
    return profile.median_where(t("customer"), "c_acctbal", F.col("c_acctbal") > 0).select(F.round("median", 6).alias("median"))


@query(
    "share_of_groups",
    """
    WITH g AS (SELECT l_suppkey, median(CASE WHEN l_quantity < 26 THEN 0 ELSE l_quantity END) AS med FROM lineitem GROUP BY l_suppkey)
    SELECT round(avg(CASE WHEN med = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS share FROM g
    """,
)
def share_of_groups(t):
    low = F.when(F.col("l_quantity") < 26, 0.0).otherwise(F.col("l_quantity"))
    rows = t("lineitem").select("l_suppkey", low.alias("q"))
    out = profile.share_of_groups(rows, ["l_suppkey"], "q", lambda med: med == 0)
    return out.select(F.round("share", 6).alias("share"))


@query(
    "distinct_counts",
    """
    SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_distinct FROM lineitem
    UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
    UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem
    """,
)
def distinct_counts(t):
    return profile.n_distinct(t("lineitem"), ["l_partkey", "l_suppkey", "l_shipdate"])


@query(
    "min_year",
    "SELECT CAST(min(year(o_orderdate)) AS BIGINT) AS first_year, round(avg(o_totalprice), 4) AS mean_price FROM orders",
)
def min_year(t):
    return t("orders").agg(
        F.min(F.year("o_orderdate")).cast("long").alias("first_year"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")
    )


@query(
    "transitions",
    """
    WITH b AS (SELECT l_returnflag AS before, CASE WHEN l_discount > 0.05 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE l_returnflag END AS after FROM lineitem)
    SELECT before, after, count(*) AS n FROM b WHERE before <> after GROUP BY before, after
    UNION ALL SELECT NULL, NULL, count(*) FROM b WHERE before <> after
    """,
)
def transitions(t):
    after = F.when(F.col("l_discount") > 0.05, "R").when(F.col("l_tax") > 0.04, "A").otherwise(F.col("l_returnflag"))
    rows = t("lineitem").select(F.col("l_returnflag").alias("before"), after.alias("after"))
    return profile.transitions(rows, "before", "after")


_STRUCTURE = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
              ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query(
    "structure",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count({c}) AS n_present, "
        f"count(DISTINCT {c}) AS n_levels, CAST(min({c}) AS VARCHAR) AS example FROM orders"
        for i, (c, kind) in enumerate(_STRUCTURE)
    ),
)
def structure(t):
    return profile.describe_structure(t("orders"))


PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _dependencies_sql(cols: tuple[str, ...]) -> str:
    """Every set of one or two columns with each other column it determines, for minimal sets."""
    holds = lambda s, d: f"NOT EXISTS (SELECT 1 FROM part GROUP BY {', '.join(s)} HAVING count(DISTINCT {d}) > 1)"
    one = [f"SELECT '{a}' AS a, '{d}' AS d, {holds([a], d)} AS holds" for a in cols for d in cols if a != d]
    two = [f"SELECT '{a}' AS a, '{b}' AS b, '{d}' AS d, {holds([a, b], d)} AS holds" for a, b in combinations(cols, 2) for d in cols if d not in (a, b)]
    return f"""
    WITH one AS (SELECT a, d FROM ({' UNION ALL '.join(one)}) WHERE holds),
         two AS (SELECT a, b, d FROM ({' UNION ALL '.join(two)}) WHERE holds)
    SELECT a AS determinant, d AS dependent, 1 AS size, EXISTS (SELECT 1 FROM one o WHERE o.a = one.d AND o.d = one.a) AS relabelling FROM one
    UNION ALL
    SELECT a || ',' || b, d, 2, false FROM two WHERE NOT EXISTS (
      SELECT 1 FROM one o WHERE (o.a IN (two.a, two.b) AND o.d = two.d) OR (o.a = two.a AND o.d = two.b) OR (o.a = two.b AND o.d = two.a))
    """


@query("column_dependencies", _dependencies_sql(PART))
def column_dependencies_query(t):
    """All functions among the columns of the parts, of one column or of two."""
    return column_dependencies(t("part").select(*PART), max_size=2)


@query(
    "column_relation",
    """
    WITH p AS (SELECT DISTINCT p_brand AS a, substr(p_brand, 1, 7) AS b FROM part),
         c AS (SELECT count(DISTINCT a) AS n_a, count(DISTINCT b) AS n_b, count(*) AS n_pairs FROM p)
    SELECT 'p_brand' AS column_a, 'maker' AS column_b, n_a, n_b, n_pairs, n_pairs = n_a AS a_determines_b,
           n_pairs = n_b AS b_determines_a, n_pairs = n_a AND n_pairs = n_b AS relabelling FROM c
    """,
)
def column_relation(t):
    rows = t("part").select("p_brand", F.substring("p_brand", 1, 7).alias("maker"))
    return profile.column_relation(rows, "p_brand", "maker")


@query(
    "low_variance",
    """
    WITH l AS (SELECT 'p_brand' AS "column", p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part
               UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
         c AS (SELECT "column", v, count(*) AS n FROM l GROUP BY ALL)
    SELECT "column", count(*) AS n_levels, round(max(n) / sum(n)::DOUBLE, 6) AS top_share, min(n) AS min_level_n,
           count(*) FILTER (WHERE n < 100) AS n_rare_levels, count(*) = 1 AS constant FROM c GROUP BY "column"
    """,
)
def low_variance(t):
    return profile.low_variance(t("part"), ["p_brand", "p_type", "p_size"]).withColumn("top_share", F.round("top_share", 6))


@query(
    "histogram",
    """
    WITH x AS (SELECT log10(value) AS x FROM events WHERE value > 0),
         l AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM x),
         c AS (SELECT least(CAST(floor((x - lo) / w) AS INTEGER), 19) AS bin, count(*) AS n FROM x, l GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS bin_lo, round(lo + (b.bin + 1) * w, 6) AS bin_hi, coalesce(n, 0) AS n
    FROM range(20) b(bin) CROSS JOIN l LEFT JOIN c ON b.bin = c.bin
    """,
)
def histogram(t):
    out = distribution.histogram(t("events"), "value", 20, log10=True)
    return out.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "n")


@query(
    "histogram_by",
    """
    WITH l AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders),
         c AS (SELECT o_orderstatus, least(CAST(floor((o_totalprice - lo) / w) AS INTEGER), 11) AS bin, count(*) AS n FROM orders, l GROUP BY 1, 2)
    SELECT s.o_orderstatus, CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 4) AS bin_lo, round(lo + (b.bin + 1) * w, 4) AS bin_hi, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN range(12) b(bin) CROSS JOIN l
         LEFT JOIN c ON b.bin = c.bin AND s.o_orderstatus = c.o_orderstatus
    """,
)
def histogram_by(t):
    out = distribution.histogram(t("orders"), "o_totalprice", 12, by="o_orderstatus")
    return out.select("o_orderstatus", "bin", F.round("bin_lo", 4).alias("bin_lo"), F.round("bin_hi", 4).alias("bin_hi"), "n")


@query(
    "box_stats",
    """
    WITH x AS (SELECT event_type, log10(value) AS x FROM events WHERE value > 0),
         q AS (SELECT event_type, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY event_type),
         k AS (SELECT x.event_type, x.x, q1, median, q3, x.x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS kept
               FROM x JOIN q ON x.event_type = q.event_type)
    SELECT event_type, count(*) AS n, round(min(q1), 6) AS q1, round(min(median), 6) AS median, round(min(q3), 6) AS q3,
           round(min(x) FILTER (WHERE kept), 6) AS whisker_lo, round(max(x) FILTER (WHERE kept), 6) AS whisker_hi,
           count(*) FILTER (WHERE NOT kept) AS n_outliers FROM k GROUP BY event_type
    """,
)
def box_stats(t):
    out = distribution.box_stats(t("events"), "event_type", "value")
    numbers = ("q1", "median", "q3", "whisker_lo", "whisker_hi")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in numbers], "n_outliers")


@query(
    "kde",
    """
    WITH e AS (SELECT event_type, value FROM events UNION ALL SELECT 'tied', 100.0 FROM events WHERE event_type = 'error'),
         x AS (SELECT event_type, log10(value) AS x FROM e WHERE value >= 1 AND value <= 350000),
         s AS (SELECT event_type, count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, min(x) AS low FROM x GROUP BY event_type),
         h AS (SELECT event_type, 2 * 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd
                                            WHEN abs(low) > 0 THEN abs(low) ELSE 1 END * pow(n, -0.2) AS h FROM s),
         g AS (SELECT i AS grid_no, i * log10(350000) / 511 AS gx FROM range(512) r(i))
    SELECT x.event_type, CAST(grid_no AS INTEGER) AS grid_no, round(gx, 6) AS x,
           round(sum(exp(-0.5 * ((gx - x.x) / h) * ((gx - x.x) / h))) / (h * sqrt(2 * pi())) * 2, 4) AS density
    FROM x JOIN h ON x.event_type = h.event_type CROSS JOIN g GROUP BY x.event_type, grid_no, gx, h
    """,
)
def kde(t):
    """Densities on 512 points, with a group whose values are all equal."""
    tied = F.struct(F.when(F.col("event_type") == "error", "tied").alias("event_type"), F.lit(100.0).alias("value"))
    rows = t("events").select(F.inline(F.array(F.struct("event_type", "value"), tied))).where("event_type IS NOT NULL")
    out = distribution.density(rows, "value", "event_type")
    return out.select("event_type", "grid_no", F.round("x", 6).alias("x"), F.round("density", 4).alias("density"))


def _poly_sql(coefficients, x: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


_NORMAL_SQL = f"""CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_poly_sql(CENTRE_NUM, 'c')} / {_poly_sql(CENTRE_DEN, 'c')}
     WHEN d <= 5 THEN sign(p - 0.5) * {_poly_sql(MIDDLE_NUM, '(d - 1.6)')} / {_poly_sql(MIDDLE_DEN, '(d - 1.6)')}
     ELSE sign(p - 0.5) * {_poly_sql(TAIL_NUM, '(d - 5.0)')} / {_poly_sql(TAIL_DEN, '(d - 5.0)')} END"""


@query(
    "qq_normal",
    f"""
    WITH r AS (SELECT log10(value) AS sample, row_number() OVER (ORDER BY value) AS rank, count(*) OVER () AS n FROM events WHERE value > 0),
         p AS (SELECT sample, rank, ((rank - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END)
                      / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END))::DOUBLE AS p FROM r),
         z AS (SELECT rank, sample, p, 0.180625::DOUBLE - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) AS d FROM p)
    SELECT rank, round(sample, 6) AS sample, round({_NORMAL_SQL}, 6) AS theoretical FROM z
    """,
)
def qq_normal(t):
    out = distribution.qq_normal(t("events"), "value", log10=True)
    return out.select("rank", F.round("sample", 6).alias("sample"), F.round("theoretical", 6).alias("theoretical"))


@query(
    "qq_line",
    """
    WITH q AS (SELECT quantile_cont(log10(value), 0.25) AS q1, quantile_cont(log10(value), 0.75) AS q3 FROM events WHERE value > 0)
    SELECT round((q3 - q1) / (2 * 0.6744897501960817), 6) AS slope, round((q1 + q3) / 2, 6) AS intercept FROM q
    """,
)
def qq_line(t):
    out = distribution.qq_line(t("events"), "value", log10=True)
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


CLASS_PROFILE_SQL = """
    WITH j AS (SELECT c.c_mktsegment AS segment, o.o_orderstatus AS status FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
         c AS (SELECT segment, status, count(*) AS n FROM j GROUP BY segment, status),
         s AS (SELECT segment, CAST(sum(n) AS BIGINT) AS category_n, sum(n) FILTER (WHERE status = 'F') AS focus_n FROM c GROUP BY segment)
    SELECT c.segment, c.status, n, category_n, round(n / category_n::DOUBLE, 6) AS share, round(focus_n / category_n::DOUBLE, 6) AS focus_share,
           round((SELECT sum(focus_n) / sum(category_n)::DOUBLE FROM s), 6) AS overall_share
    FROM c JOIN s ON c.segment IS NOT DISTINCT FROM s.segment
"""


@query("class_profile", CLASS_PROFILE_SQL)
def class_profile(t):
    """Class mix of the orders by customer segment, most finished first."""
    orders = t("orders").select("o_custkey", F.col("o_orderstatus").alias("status"))
    customer = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    out = profile.class_profile(orders.join(customer, "o_custkey", "left"), "segment", "status", "F")
    shares = ("share", "focus_share", "overall_share")
    return out.select("segment", "status", "n", "category_n", *[F.round(c, 6).alias(c) for c in shares])


@query(
    "ordered_categories",
    """
    WITH m AS (SELECT p_brand, count(*) AS n, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END)::DOUBLE AS s FROM part GROUP BY p_brand)
    SELECT p_brand, n, round(s, 6) AS flag_share, dense_rank() OVER (ORDER BY s DESC) AS position FROM m
    """,
)
def ordered_categories(t):
    out = profile.ordered_categories(t("part"), "p_brand", F.col("p_size") > 25)
    return out.withColumn("flag_share", F.round("flag_share", 6))


@query(
    "geo_grid",
    """
    WITH c AS (SELECT round_even(embedding[1]::DOUBLE, 2) + 0.0::DOUBLE AS cell_lat, round_even(embedding[2]::DOUBLE, 2) + 0.0::DOUBLE AS cell_lon, label FROM embeddings)
    SELECT cell_lat, cell_lon, label, count(*) AS n,
           regexp_replace(cell_lat::VARCHAR, '\\.0$', '') || ':' || regexp_replace(cell_lon::VARCHAR, '\\.0$', '') AS latlong
    FROM c GROUP BY ALL
    """,
)
def geo_grid(t):
    e = F.col("embedding")
    rows = t("embeddings").select(e[0].alias("lat"), e[1].alias("lon"), "label")
    return distribution.geo_grid(rows, "lat", "lon", "label")
