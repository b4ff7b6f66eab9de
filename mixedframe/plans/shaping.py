"""Projection, filter, join and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import concat_label
from ..operators import joins, shaping
from ..operators.profile import sorted_counts, top_k_per, top_k_values, with_group_size
from .registry import query


@query("project_cols", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def project_cols(t):
    return shaping.keep(t("customer"), ["c_mktsegment", "c_custkey", "c_acctbal"])


@query("drop_cols", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def drop_cols(t):
    return shaping.drop(t("part"), ["p_name", "p_type"])


@query(
    "derive_cols",
    """
    SELECT l_orderkey, l_linenumber,
           round(l_extendedprice * (1 - l_discount), 4) AS net_price,
           round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
    FROM lineitem
    """,
)
def derive_cols(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = shaping.derive(
        t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"),
        {"net_price": F.round(net, 4), "charge": F.round(net * (1 + F.col("l_tax")), 6)},
    )
    return shaping.keep(out, ["l_orderkey", "l_linenumber", "net_price", "charge"])


@query(
    "filter_compound",
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE (l_quantity > 45 OR l_discount = 0) AND l_returnflag <> 'R'
      AND l_linestatus IN ('O', 'F') AND l_linenumber NOT IN (1, 2)
    """,
)
def filter_compound(t):
    rows = t("lineitem").filter(
        ((F.col("l_quantity") > 45) | (F.col("l_discount") == 0))
        & (F.col("l_returnflag") != "R")
        & F.col("l_linestatus").isin("O", "F")
        & ~F.col("l_linenumber").isin(1, 2)
    )
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "first_n_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000",
)
def first_n_rows(t):
    return shaping.first_n(t("orders").select("o_orderkey", "o_totalprice"), 1000, ["o_orderkey"])


@query(
    "scalar_value",
    """
    SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above_mean
    FROM customer
    """,
)
def scalar_value(t):
    customer = t("customer")
    mean = shaping.scalar(customer, F.avg("c_acctbal"))
    return customer.select("c_custkey", F.round(F.col("c_acctbal") - mean, 4).alias("above_mean"))


@query("rename_cols", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def rename_cols(t):
    renamed = shaping.rename(t("supplier"), {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})
    return shaping.keep(renamed, ["id", "name", "balance"])


@query("reorder_cols", "SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def reorder_cols(t):
    return shaping.move_first(t("orders").drop("o_orderdate"), ["o_orderstatus"])


@query(
    "bind_on_key",
    """
    SELECT o_orderkey, o_orderstatus AS target,
           CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END AS by_price,
           CASE WHEN o_orderpriority LIKE '1%' THEN 'F' ELSE 'P' END AS by_priority
    FROM orders
    """,
)
def bind_on_key(t):
    orders = t("orders")
    return joins.bind_on_key(
        [
            orders.select("o_orderkey", F.col("o_orderstatus").alias("target")),
            orders.select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "F").otherwise("O").alias("by_price")),
            orders.select("o_orderkey", F.when(F.col("o_orderpriority").like("1%"), "F").otherwise("P").alias("by_priority")),
        ],
        "o_orderkey",
    )


@query(
    "unpivot_metrics",
    """
    WITH m AS (SELECT avg(l_quantity) AS mean_quantity, max(l_discount) AS max_discount, min(l_tax) AS min_tax FROM lineitem)
    SELECT 'mean_quantity' AS name, round(mean_quantity, 6) AS value FROM m
    UNION ALL SELECT 'max_discount', round(max_discount, 6) FROM m
    UNION ALL SELECT 'min_tax', round(min_tax, 6) FROM m
    """,
)
def unpivot_metrics(t):
    wide = t("lineitem").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
        F.round(F.max("l_discount"), 6).alias("max_discount"),
        F.round(F.min("l_tax"), 6).alias("min_tax"),
    )
    return shaping.stack_named(wide, wide.columns)


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def distinct_values(t):
    return shaping.distinct_values(t("part"), "p_type")


@query("constant_col", "SELECT c_custkey, CAST(1 AS INTEGER) AS size FROM customer")
def constant_col(t):
    return t("customer").select("c_custkey", F.lit(1).alias("size"))


@query(
    "left_join_labels",
    """
    SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def left_join_labels(t):
    return joins.left_join(t("documents").select("doc_id", "lang", "n_chars"), t("labels"), "doc_id")


@query(
    "scalar_broadcast",
    """
    SELECT c_custkey, round(c_acctbal / (SELECT max(s_acctbal) FROM supplier), 6) AS relative_balance
    FROM customer
    """,
)
def scalar_broadcast(t):
    top = t("supplier").agg(F.max("s_acctbal").alias("top"))
    return joins.attach_scalar(t("customer").select("c_custkey", "c_acctbal"), top).select(
        "c_custkey", F.round(F.col("c_acctbal") / F.col("top"), 6).alias("relative_balance")
    )


@query(
    "param_grid",
    """
    WITH g AS (SELECT bound, status FROM (VALUES (100000), (250000), (400000)) a(bound),
                                          (VALUES ('F'), ('O'), ('P')) b(status))
    SELECT CAST(bound AS BIGINT) AS bound, status,
           round(count(*) FILTER (WHERE (o_totalprice > bound) = (o_orderstatus = status)) / count(*)::DOUBLE, 6) AS accuracy
    FROM g CROSS JOIN orders GROUP BY bound, status
    """,
)
def param_grid(t):
    """Accuracy of the rule "price above the bound means this status" for every combination."""
    entries = [
        F.struct(
            F.lit(s["bound"]).cast("long").alias("bound"),
            F.lit(s["status"]).alias("status"),
            F.round(
                F.count_if((F.col("o_totalprice") > s["bound"]) == (F.col("o_orderstatus") == s["status"])) / F.count("*"), 6
            ).alias("accuracy"),
        )
        for s in joins.settings(bound=[100000, 250000, 400000], status=["F", "O", "P"])
    ]
    return t("orders").agg(F.array(*entries).alias("e")).select(F.inline("e"))


@query(
    "group_size_window",
    "SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS segment_n FROM customer",
)
def group_size_window(t):
    return with_group_size(t("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "segment_n")


@query(
    "top_k_per_group",
    """
    SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (
      SELECT o_orderpriority, o_orderkey, o_totalprice,
             CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
      FROM orders) WHERE rank <= 5
    """,
)
def top_k_per_group(t):
    rows = t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_k_per(rows, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 5)


@query("sorted_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def sorted_counts_query(t):
    return sorted_counts(t("part"), "p_brand")


@query("top_k_values", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_k_values_query(t):
    return top_k_values(t("part"), "p_brand", 10)


@query(
    "membership_filter",
    """
    SELECT c_custkey, c_mktsegment FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (0, 1, 2, 3)
    """,
)
def membership_filter(t):
    return t("customer").filter(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(0, 1, 2, 3)
    ).select("c_custkey", "c_mktsegment")


@query(
    "concat_label",
    "SELECT n_nationkey, concat_ws(':', n_name, r_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def concat_label_query(t):
    both = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", concat_label(":", "n_name", "r_name").alias("place"))
