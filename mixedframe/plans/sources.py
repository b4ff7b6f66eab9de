"""Round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import value_shares
from ..models.features import Standardizer
from ..operators.cleaning import TopKLumper
from ..operators.neighbours import NeighbourIndex
from ..session import scratch_path
from ..sources import load_fitted, load_results, read_table, save_fitted, save_results, write_table
from .registry import query


@query("scan_csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_roundtrip(t):
    customer = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = scratch_path(t.spark, "csv")
    write_table(customer, path)
    return read_table(t.spark, path, customer.schema)


@query(
    "csv_sink",
    "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total_price, CAST(sum(o_custkey) AS BIGINT) AS key_sum FROM orders",
)
def csv_sink(t):
    orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = scratch_path(t.spark, "csv")
    write_table(orders, path)
    back = read_table(t.spark, path, orders.schema)
    return back.agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total_price"), F.sum("o_custkey").alias("key_sum")
    )


@query(
    "results_roundtrip",
    "SELECT l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM lineitem GROUP BY l_linestatus",
)
def results_roundtrip(t):
    path = scratch_path(t.spark, "results")
    save_results(value_shares(t("lineitem"), "l_linestatus"), path)
    return load_results(t.spark, path).withColumn("share", F.round("share", 6))


@query(
    "fitted_roundtrip",
    """
    WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10),
         s AS (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS sd FROM part),
         d AS (SELECT q.p_partkey, r.p_partkey AS near_key, row_number() OVER (PARTITION BY q.p_partkey
                      ORDER BY sqrt((q.p_retailprice - r.p_retailprice) * (q.p_retailprice - r.p_retailprice)), r.p_partkey) AS rank
               FROM part q JOIN part r ON q.p_partkey % 4 = 0 AND r.p_partkey % 4 <> 0)
    SELECT p.p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'other' END AS brand,
           round((p_retailprice - m) / sd, 6) AS price_z, near_key
    FROM part p CROSS JOIN s LEFT JOIN d ON d.p_partkey = p.p_partkey AND d.rank = 1
    """,
)
def fitted_roundtrip(t):
    """A lumper, a scaler and a neighbour index, stored together, loaded, and applied to the parts."""
    part = t("part").select("p_partkey", "p_brand", "p_retailprice")
    held_out = F.col("p_partkey") % 4 == 0
    path = scratch_path(t.spark, "fitted")
    fitted = {
        "lumper": TopKLumper("p_brand", 10).fit(part),
        "scaler": Standardizer(["p_retailprice"]).fit(part),
        "near": NeighbourIndex("p_partkey", ["p_retailprice"], 1).fit(part.where(~held_out)),
    }
    save_fitted(t.spark, fitted, path)
    loaded = load_fitted(t.spark, path)
    near = loaded["near"].join(part.where(held_out), "p_partkey").select("p_partkey", F.col("ref_key").alias("near_key"))
    rows = loaded["scaler"].transform(loaded["lumper"].transform(part, "brand"))
    return rows.join(near, "p_partkey", "left").select("p_partkey", "brand", F.round("p_retailprice", 6).alias("price_z"), "near_key")
