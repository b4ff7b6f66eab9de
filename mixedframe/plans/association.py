"""Association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association
from .registry import query

_NUMBERS = ("o_totalprice", "c_acctbal", "price_log")
_CATEGORIES = ("o_orderstatus", "o_orderpriority", "c_mktsegment")
_ORDERS_SQL = """
    t AS (SELECT o.o_totalprice, c.c_acctbal, log10(o.o_totalprice) AS price_log, o.o_orderstatus, o.o_orderpriority, c.c_mktsegment
          FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""


def _mixed(t):
    orders = t("orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    customer = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return (
        orders.join(customer, "o_custkey", "left").withColumn("price_log", F.log10("o_totalprice"))
        .select(*_NUMBERS, *_CATEGORIES)
    )


def _pearson_sql(a, b):
    return f"SELECT '{a}' AS col_x, '{b}' AS col_y, 'pearson' AS kind, count(*) AS n, corr({a}, {b}) AS r FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL"


def _ratio_sql(a, b):
    return f"""SELECT '{a}' AS col_x, '{b}' AS col_y, 'correlation_ratio' AS kind, CAST(sum(n) AS BIGINT) AS n,
        sqrt(sum(n * (m - g) * (m - g)) / (max(v) * sum(n))) AS r
        FROM (SELECT {b}, count({a}) AS n, avg({a}) AS m FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b}),
             (SELECT avg({a}) AS g, var_pop({a}) AS v FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def _cramer_sql(a, b):
    return f"""SELECT '{a}' AS col_x, '{b}' AS col_y, 'cramers_v' AS kind, max(tot) AS n,
        sqrt(greatest(sum(power(o - e, 2) / e) / max(tot), 0) / (least(max(lx), max(ly)) - 1)) AS r
        FROM (SELECT x.tot, x.lx, y.ly, coalesce(c.n, 0) AS o, x.n * y.n / x.tot::DOUBLE AS e
              FROM (SELECT {a} AS x, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS tot, count(*) OVER () AS lx
                    FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) x
              CROSS JOIN (SELECT {b} AS y, count(*) AS n, count(*) OVER () AS ly
                    FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) y
              LEFT JOIN (SELECT {a} AS cx, {b} AS cy, count(*) AS n FROM t GROUP BY ALL) c ON x.x = c.cx AND y.y = c.cy)"""


def _matrix_sql() -> str:
    parts = [_pearson_sql(a, b) for a in _NUMBERS for b in _NUMBERS]
    for a in _NUMBERS:
        for b in _CATEGORIES:
            one = _ratio_sql(a, b)
            parts += [one, f"SELECT col_y AS col_x, col_x AS col_y, kind, n, r FROM ({one})"]
    parts += [_cramer_sql(a, b) for a in _CATEGORIES for b in _CATEGORIES]
    return "WITH" + _ORDERS_SQL + ", m AS (" + " UNION ALL ".join(parts) + ")"


@query("association_matrix", _matrix_sql() + " SELECT col_x, col_y, kind, n, round(r, 6) AS r FROM m")
def association_matrix(t):
    return association.association_matrix(_mixed(t)).withColumn("r", F.round("r", 6))


@query(
    "strong_pairs",
    _matrix_sql() + " SELECT col_x, col_y, kind, n, round(r, 6) AS r FROM m WHERE abs(r) > 0.5 AND col_x < col_y",
)
def strong_pairs(t):
    pairs = association.strong_pairs(association.association_matrix(_mixed(t)), 0.5)
    return pairs.withColumn("r", F.round("r", 6))


@query(
    "column_pairs",
    """
    WITH c(i, name) AS (VALUES (1, 'l_quantity'), (2, 'l_extendedprice'), (3, 'l_discount'), (4, 'l_tax')), n AS (SELECT count(*) AS n FROM lineitem)
    SELECT a.name AS col_x, b.name AS col_y, n FROM c a JOIN c b ON a.i <= b.i, n
    """,
)
def column_pairs(t):
    """Every pair of number columns with its complete rows."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    entries = [
        F.struct(
            F.lit(a).alias("col_x"), F.lit(b).alias("col_y"),
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
        )
        for a, b in association.column_pairs(cols)
    ]
    return t("lineitem").agg(F.array(*entries).alias("e")).select(F.inline("e"))


@query(
    "pearson_pair",
    "SELECT 'l_quantity' AS col_x, 'l_extendedprice' AS col_y, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem",
)
def pearson_pair(t):
    return association.pearson(t("lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@query(
    "correlation_ratio",
    f"WITH t AS (SELECT o_totalprice, o_orderpriority FROM orders), m AS ({_ratio_sql('o_totalprice', 'o_orderpriority')}) SELECT col_x, col_y, n, round(r, 6) AS r FROM m",
)
def correlation_ratio(t):
    return association.correlation_ratio(t("orders"), "o_totalprice", "o_orderpriority").withColumn("r", F.round("r", 6))


@query(
    "cramers_v",
    f"WITH t AS (SELECT o_orderpriority, o_orderstatus FROM orders), m AS ({_cramer_sql('o_orderpriority', 'o_orderstatus')}) SELECT col_x, col_y, n, round(r, 6) AS r FROM m",
)
def cramers_v(t):
    return association.cramers_v(t("orders"), "o_orderpriority", "o_orderstatus").withColumn("r", F.round("r", 6))
