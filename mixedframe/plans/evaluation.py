"""Evaluation queries on class and number predictions written as rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fold_of
from ..models import evaluate, validate
from ..models.ensemble import dissent_vote
from ..models.folds import stratified_folds
from ..operators.near_buckets import BucketIndex
from ..operators.neighbours import knn_classify, knn_join
from ..session import stage
from .registry import query

# four rule-based class predictions per order
_MODELS_SQL = """
    p AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS target,
          CASE WHEN o_totalprice > 330000 THEN 'F' WHEN o_totalprice > 160000 THEN 'O' ELSE 'P' END AS rf,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' WHEN o_orderpriority = '5-LOW' THEN 'P' ELSE 'O' END AS xgb,
          CASE WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 3 = 1 THEN 'O' ELSE 'P' END AS log,
          CASE WHEN year(o_orderdate) < 1997 THEN 'F' WHEN year(o_orderdate) < 1999 THEN 'O' ELSE 'P' END AS knn
          FROM orders)"""


def _predictions(t):
    price, priority, year = F.col("o_totalprice"), F.col("o_orderpriority"), F.year("o_orderdate")
    rest = F.col("o_custkey") % 3
    return t("orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.col("o_orderstatus").alias("target"),
        F.when(price > 330000, "F").when(price > 160000, "O").otherwise("P").alias("rf"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "F").when(priority == "5-LOW", "P").otherwise("O").alias("xgb"),
        F.when(rest == 0, "F").when(rest == 1, "O").otherwise("P").alias("log"),
        F.when(year < 1997, "F").when(year < 1999, "O").otherwise("P").alias("knn"),
    )


_FOLD_SQL = "(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT) % 10"
_LONG_SQL = f"""
    l AS (SELECT o_orderkey, {_FOLD_SQL} AS fold, target, unnest(['rf', 'xgb', 'log', 'knn']) AS setting, unnest([rf, xgb, log, knn]) AS pred FROM p),
    f AS (SELECT setting, fold, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END)::DOUBLE AS a FROM l GROUP BY setting, fold),
    s AS (SELECT setting, count(*) AS k, avg(a) AS accuracy, stddev_samp(a) AS accuracy_sd FROM f GROUP BY setting)"""


def _fold_results(t):
    long = _predictions(t).withColumn("fold", fold_of("o_orderkey", 10)).unpivot(
        ["o_orderkey", "fold", "target"], ["rf", "xgb", "log", "knn"], "setting", "pred"
    )
    return validate.summarize_folds(validate.fold_accuracy(long.withColumnRenamed("target", "obs")))


@query(
    "fold_summary",
    f"""
    WITH {_MODELS_SQL}, {_LONG_SQL}
    SELECT setting, k, round(accuracy, 6) AS accuracy, round(accuracy_sd, 6) AS accuracy_sd, round(1.96 * accuracy_sd / sqrt(k), 6) AS ci FROM s
    """,
)
def fold_summary(t):
    out = _fold_results(t)
    return out.select("setting", "k", *[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_sd", "ci")])


@query(
    "best_config",
    f"WITH {_MODELS_SQL}, {_LONG_SQL} SELECT setting, round(accuracy, 6) AS accuracy FROM s ORDER BY s.accuracy DESC, setting LIMIT 1",
)
def best_config(t):
    return validate.best_config(_fold_results(t)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "one_se_rule",
    f"""
    WITH {_MODELS_SQL}, {_LONG_SQL},
         c AS (SELECT *, CAST(length(setting) AS INTEGER) AS complexity FROM s),
         b AS (SELECT accuracy - accuracy_sd / sqrt(k) AS floor FROM c ORDER BY accuracy DESC, complexity LIMIT 1)
    SELECT complexity, round(accuracy, 6) AS accuracy FROM c, b WHERE accuracy >= floor ORDER BY complexity, setting LIMIT 1
    """,
)
def one_se_rule(t):
    """The name length stands in for model complexity."""
    results = _fold_results(t).withColumn("complexity", F.length("setting"))
    results = results.groupBy("complexity").agg(
        F.max_by(F.struct("accuracy", "accuracy_sd", "k"), F.struct("accuracy", "setting")).alias("b")
    ).select("complexity", "b.*")
    return validate.one_se_rule(results, "complexity").select("complexity", F.round("accuracy", 6).alias("accuracy"))


@query(
    "confusion_matrix",
    f"WITH {_MODELS_SQL} SELECT rf AS predicted, target AS observed, count(*) AS n FROM p GROUP BY ALL",
)
def confusion_matrix(t):
    return evaluate.confusion(_predictions(t), "rf", "target")


@query(
    "class_metrics",
    f"""
    WITH {_MODELS_SQL},
         c AS (SELECT class, count(*) FILTER (WHERE rf = class AND target = class) AS tp, count(*) FILTER (WHERE rf <> class AND target = class) AS fn,
                      count(*) FILTER (WHERE rf = class AND target <> class) AS fp, count(*) FILTER (WHERE rf <> class AND target <> class) AS tn
               FROM p CROSS JOIN (SELECT DISTINCT target AS class FROM p) GROUP BY class)
    SELECT class, round(tp / (tp + fn)::DOUBLE, 6) AS sensitivity, round(tn / (tn + fp)::DOUBLE, 6) AS specificity,
           round(tp / (tp + fp)::DOUBLE, 6) AS ppv, round(tn / (tn + fn)::DOUBLE, 6) AS npv,
           round((tp + fn) / (tp + fn + fp + tn)::DOUBLE, 6) AS prevalence,
           round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy FROM c
    """,
)
def class_metrics(t):
    out = evaluate.class_metrics(_predictions(t), "rf", "target")
    return out.select("class", *[F.round(c, 6).alias(c) for c in out.columns if c != "class"])


@query(
    "overall_metrics",
    f"""
    WITH {_MODELS_SQL}, n AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN rf = target THEN 1.0 ELSE 0.0 END)::DOUBLE AS a FROM p),
         o AS (SELECT target AS c, count(*)::DOUBLE AS no FROM p GROUP BY target), q AS (SELECT rf AS c, count(*)::DOUBLE AS nq FROM p GROUP BY rf),
         e AS (SELECT sum(no * nq) AS e FROM o JOIN q ON o.c = q.c)
    SELECT CAST(n AS BIGINT) AS n, round(a, 6) AS accuracy, round((SELECT max(no) FROM o) / n, 6) AS no_information_rate,
           round((a - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n, e
    """,
)
def overall_metrics(t):
    out = evaluate.overall_metrics(_predictions(t), "rf", "target")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "no_information_rate", "kappa")])


@query(
    "roc_curve",
    """
    WITH s AS (SELECT value, count(*) FILTER (WHERE event_type = 'purchase') AS pos, count(*) FILTER (WHERE event_type <> 'purchase') AS neg FROM events GROUP BY value),
         c AS (SELECT value, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s
               WINDOW w AS (ORDER BY value DESC))
    SELECT value AS threshold, round(tp / p::DOUBLE, 6) AS sensitivity, round((n - fp) / n::DOUBLE, 6) AS specificity FROM c
    UNION ALL SELECT 'inf'::DOUBLE, 0.0, 1.0
    """,
)
def roc_curve(t):
    out = evaluate.roc_curve(t("events"), "value", F.col("event_type") == "purchase")
    return out.select("threshold", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query(
    "roc_auc",
    """
    WITH r AS (SELECT event_type = 'purchase' AS pos, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM events),
         s AS (SELECT count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n, sum(rank) FILTER (WHERE pos)::DOUBLE AS w FROM r)
    SELECT p AS n_positive, n AS n_negative, round((w - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc FROM s
    """,
)
def roc_auc(t):
    return evaluate.roc_auc(t("events"), "value", F.col("event_type") == "purchase").withColumn("auc", F.round("auc", 6))


@query(
    "accuracy_by_model",
    f"""
    WITH {_MODELS_SQL}, v AS (SELECT *, CASE WHEN xgb = log AND xgb = knn THEN xgb ELSE rf END AS vote FROM p),
         l AS (SELECT target, unnest(['rf', 'xgb', 'log', 'knn', 'vote']) AS model, unnest([rf, xgb, log, knn, vote]) AS pred FROM v)
    SELECT model, round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM l GROUP BY model
    """,
)
def accuracy_by_model(t):
    voted = _predictions(t).withColumn("vote", dissent_vote("rf", ["xgb", "log", "knn"]))
    out = evaluate.accuracy_by_model(voted, ["rf", "xgb", "log", "knn", "vote"], "target")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "dissent_vote",
    f"WITH {_MODELS_SQL} SELECT o_orderkey, CASE WHEN xgb = log AND xgb = knn THEN xgb ELSE rf END AS vote FROM p",
)
def dissent_vote_query(t):
    return _predictions(t).select("o_orderkey", dissent_vote("rf", ["xgb", "log", "knn"]).alias("vote"))


@query(
    "model_comparison",
    f"""
    WITH {_MODELS_SQL}, {_LONG_SQL},
         h AS (SELECT setting AS model, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END)::DOUBLE AS holdout FROM l WHERE setting <> 'knn' GROUP BY setting)
    SELECT s.setting AS model, round(s.accuracy, 6) AS accuracy, round(1.96 * s.accuracy_sd / sqrt(s.k), 6) AS ci, round(h.holdout, 6) AS holdout
    FROM s FULL JOIN h ON s.setting = h.model
    """,
)
def model_comparison(t):
    results = _fold_results(t).select(F.col("setting").alias("model"), F.round("accuracy", 6).alias("accuracy"), F.round("ci", 6).alias("ci"))
    holdout = evaluate.accuracy_by_model(_predictions(t), ["rf", "xgb", "log"], "target")
    return evaluate.compare_models(results, holdout.select("model", F.round("accuracy", 6).alias("holdout")))


@query(
    "regression_metrics",
    """
    WITH r AS (SELECT CASE WHEN l_linenumber < 7 THEN l_quantity * 1500 END AS p, l_extendedprice AS o FROM lineitem)
    SELECT count(p) AS n, count(*) - count(p) AS n_missing, round(pow(corr(p, o), 2), 6) AS r2,
           round(sqrt(avg(pow(p - o, 2))), 4) AS rmse, round(avg(abs(p - o)), 4) AS mae FROM r
    """,
)
def regression_metrics(t):
    """The price of a line from its quantity; the last lines of an order have no prediction."""
    rows = t("lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_quantity") * 1500).alias("pred"), F.col("l_extendedprice").alias("obs"))
    out = evaluate.regression_metrics(rows, "pred", "obs")
    return out.select("n", "n_missing", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query(
    "knn_join",
    """
    WITH d AS (SELECT q.vec_id, r.vec_id AS ref_key, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d
               FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id),
         r AS (SELECT vec_id, ref_key, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, ref_key) AS INTEGER) AS rank, d FROM d)
    SELECT vec_id, ref_key, rank, round(d, 6) AS distance FROM r WHERE rank <= 7
    """,
)
def knn_join_query(t):
    e = t("embeddings").select("vec_id", "embedding")
    return knn_join(e, e, "vec_id", "embedding", 7, exclude_self=True).withColumn("distance", F.round("distance", 6))


@query(
    "knn_classify",
    """
    WITH p AS (SELECT p_partkey, p_type, p_size / 16.0::DOUBLE AS x, p_retailprice / 128.0 AS y, length(p_name) / 4.0::DOUBLE AS z FROM part),
         d AS (SELECT q.p_partkey, r.p_partkey AS ref_key, r.p_type,
                      sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z)) AS d
               FROM p q JOIN p r ON q.p_partkey % 4 = 0 AND r.p_partkey % 4 <> 0),
         k AS (SELECT p_partkey, p_type, d, row_number() OVER (PARTITION BY p_partkey ORDER BY d, ref_key) AS rank FROM d),
         v AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_partkey ORDER BY count(*) DESC, round(sum(d), 9), p_type) AS place
               FROM k WHERE rank <= 7 GROUP BY p_partkey, p_type)
    SELECT p_partkey, p_type AS prediction FROM v WHERE place = 1
    """,
)
def knn_classify_query(t):
    """The type of a part from size, price and length of name, each brought to a like scale."""
    scaled = {"x": F.col("p_size") / 16, "y": F.col("p_retailprice") / 128, "z": F.char_length("p_name") / 4}
    parts = t("part").select("p_partkey", "p_type", *[c.alias(n) for n, c in scaled.items()])
    held_out = F.col("p_partkey") % 4 == 0
    return knn_classify(parts.filter(~held_out), parts.filter(held_out), "p_partkey", list(scaled), "p_type", 7)


@query(
    "knn_join_approximate",
    "SELECT count(*) AS n_queries, true AS finds_nine_in_ten, true AS compares_less_than_half FROM part",
)
def knn_join_approximate(t):
    """Neighbours of all parts by bucketed projections: the share found of the exact ones, and of all pairs compared."""
    scaled = {"x": F.col("p_size") / 16, "y": F.col("p_retailprice") / 128, "z": F.char_length("p_name") / 4}
    parts = stage(t("part").select("p_partkey", *[c.alias(n) for n, c in scaled.items()]), "parts")
    index = BucketIndex("p_partkey", list(scaled), 7, exclude_self=True).fit(parts)
    exact = knn_join(parts, parts, "p_partkey", list(scaled), 7, exclude_self=True)
    # ties at the last distance may be other parts, so distances are compared
    last = exact.groupBy("p_partkey").agg(F.max("distance").alias("last"), F.count("ref_key").alias("n"))
    found = index.join(parts, "p_partkey").join(last, "p_partkey").groupBy("p_partkey").agg(
        (F.count_if(F.col("distance") <= F.col("last") + 1e-9) / F.max("n")).alias("share")
    )
    visited = index.visited_share(parts, "p_partkey")
    return found.agg(F.count("*").alias("n_queries"), (F.avg("share") >= 0.9).alias("finds_nine_in_ten"), F.lit(visited < 0.5).alias("compares_less_than_half"))


@query(
    "stratified_folds",
    """
    SELECT o_orderkey, o_orderstatus,
           CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT, o_orderkey) - 1) % 10 AS INTEGER) AS fold
    FROM orders
    """,
)
def stratified_folds_query(t):
    """Ten folds of the orders, balanced within each status."""
    return stratified_folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 10)
