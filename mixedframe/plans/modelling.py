"""Model queries on the orders: the lane of an order from price, priority, year, segment and balance.

The lane is a rule of priority and segment, so a model that works gives the rule back, and
SQL can state what every step must return. Trees, rounds and folds are fewer than the
defaults of the library, which are those of the study; the README has the seconds those take.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..models import ensemble, evaluate, scoring, validate
from ..models.estimators import boosted, forest, logistic
from ..models.features import fit_classifier
from ..operators.joins import settings
from ..operators.profile import transitions
from ..sources import load_model, save_model
from ..models.statistics import logistic_terms
from ..session import scratch_path, stage
from .registry import query

TARGET, KEY = "lane", "o_orderkey"
FEATURES = ["o_totalprice", "o_orderpriority", "order_year", "c_mktsegment", "c_acctbal"]
LANE_SQL = "CASE WHEN o_orderpriority = '5-LOW' THEN 'low' WHEN c_mktsegment = 'BUILDING' THEN 'build' ELSE 'rest' END"
JOINED_SQL = "orders JOIN customer ON o_custkey = c_custkey"
CLASSES = ("build", "low", "rest")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _table(t):
    orders = t("orders").select(KEY, "o_custkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("order_year"))
    customer = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    lane = F.when(F.col("o_orderpriority") == "5-LOW", "low").when(F.col("c_mktsegment") == "BUILDING", "build").otherwise("rest")
    return orders.join(customer, "o_custkey").drop("o_custkey").withColumn(TARGET, lane)


def _forest(ntree: int = 21, mtry: int = 5, depth: int = 20):
    return forest(ntree, mtry, depth)


def _small_forest(ntree: int = 9, mtry: int = 5, depth: int = 20):
    """Where a fit is repeated."""
    return forest(ntree, mtry, depth)


def _scores(t, estimator, onehot=False, target=TARGET, table=None):
    rows = _table(t) if table is None else table
    return scoring.score(fit_classifier(estimator, rows, target, FEATURES, onehot), rows, KEY)


SCORES_SQL = f"SELECT o_orderkey, {LANE_SQL} AS prediction FROM {JOINED_SQL}"


@query("forest_scores", SCORES_SQL)
def forest_scores(t):
    """Forest on indicator columns (formula call)."""
    return _scores(t, _forest(mtry=11), onehot=True)


@query("nominal_forest", SCORES_SQL)
def nominal_forest(t):
    """Forest that splits categories natively."""
    return _scores(t, _forest())


#: boosting rounds; the study's 250 repeat the same passes
ROUNDS = 4


@query("boosted_scores", SCORES_SQL)
def boosted_scores(t):
    """Softmax booster on indicator columns, rows and columns sampled."""
    return _scores(t, boosted(nrounds=ROUNDS), onehot=True)


@query("logistic_scores", f"SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'other' END AS prediction FROM {JOINED_SQL}")
def logistic_scores(t):
    rows = _table(t)
    two = rows.withColumn("lane2", F.when(F.col(TARGET) == "low", "low").otherwise("other"))
    return _scores(t, logistic("binomial"), True, "lane2", two)


@query("multinomial_scores", SCORES_SQL)
def multinomial_scores(t):
    return _scores(t, logistic("multinomial"), onehot=True)


@query("batch_scores", f"SELECT o_orderkey, {LANE_SQL} AS rf, {LANE_SQL} AS log FROM {JOINED_SQL}")
def batch_scores(t):
    """Two models applied in one pass over the rows."""
    rows = _table(t)
    models = {
        "rf": fit_classifier(_forest(), rows, TARGET, FEATURES),
        "log": fit_classifier(logistic(), rows, TARGET, FEATURES, onehot=True),
    }
    return scoring.score_many(models, rows, KEY)


@query("model_roundtrip", f"SELECT count(*) AS n, 0 AS n_changed FROM {JOINED_SQL}")
def model_roundtrip(t):
    """Rows and rows whose score changes after saving and loading the model."""
    rows = _table(t)
    model = fit_classifier(_forest(), rows, TARGET, FEATURES)
    path = scratch_path(t.spark, "model")
    save_model(model, path)
    both = scoring.score_many({"saved": model, "loaded": load_model(path)}, rows, KEY)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("saved") != F.col("loaded")).alias("n_changed"))


INFORMATIVE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {str(c in ('o_orderpriority', 'c_mktsegment')).lower()} AS informative" for c in FEATURES
)


@query("importance_rows", INFORMATIVE_SQL)
def importance_rows(t):
    """Which features carry a twentieth or more of all coefficients."""
    model = fit_classifier(logistic(), _table(t), TARGET, FEATURES, onehot=True)
    rows = scoring.importance_table(t.spark, model)
    return rows.select("feature", (F.col("importance") >= 0.05 * rows.agg(F.sum("importance")).scalar()).alias("informative"))


@query("importance_table", INFORMATIVE_SQL)
def importance_table(t):
    """Which features carry a twentieth or more of the impurity decrease."""
    rows = scoring.importance_table(t.spark, fit_classifier(_forest(), _table(t), TARGET, FEATURES))
    return rows.select("feature", (F.col("importance") >= 0.05).alias("informative"))


@query("permutation_importance", INFORMATIVE_SQL)
def permutation_importance(t):
    """Which features cost accuracy when they are shuffled."""
    rows = _table(t)
    model = fit_classifier(_forest(), rows, TARGET, FEATURES)
    lost = scoring.permutation_importance(model, rows, KEY, TARGET, FEATURES)
    return lost.select("feature", (F.col("accuracy_drop") > 0.05).alias("informative"))


def _perfect_sql(name: str, values, folds: int) -> str:
    """Every setting recovers the rule in every fold."""
    each = " UNION ALL ".join(f"SELECT {v!r} AS {name}" for v in values)
    return f"SELECT {name}, CAST({folds} AS BIGINT) AS k, 1.0::DOUBLE AS accuracy, 0.0::DOUBLE AS accuracy_sd, 0.0::DOUBLE AS ci FROM ({each})"


@query("tuning_results", _perfect_sql("setting", ["mtry=3", "mtry=5"], 3))
def tuning_results(t):
    held_out = validate.tune(lambda mtry: _small_forest(mtry=mtry), _table(t), KEY, TARGET, FEATURES, settings(mtry=[3, 5]), k=3)
    return validate.summarize_folds(validate.fold_accuracy(held_out))


@query(
    "forest_roc",
    f"SELECT c AS class, (SELECT count(*) FILTER (WHERE {LANE_SQL} = c) FROM {JOINED_SQL}) AS n_positive, "
    f"(SELECT count(*) FILTER (WHERE {LANE_SQL} <> c) FROM {JOINED_SQL}) AS n_negative, 1.0::DOUBLE AS auc FROM unnest(['build', 'low', 'rest']) x(c)",
)
def forest_roc(t):
    """Area under the ROC curve of each class from held-out class shares."""
    held_out = validate.cross_validate(_small_forest(), _table(t), KEY, TARGET, FEATURES, k=2)
    parts = [
        evaluate.roc_auc(held_out, F.col("probability")[c], F.col("obs") == c).withColumn("class", F.lit(c))
        for c in CLASSES
    ]
    return validate.union_all(parts)


@query("tree_counts", _perfect_sql("setting", [f"ntree={n}" for n in (5, 11, 21)], 2))
def tree_counts(t):
    """Three tree counts from one forest per fold."""
    held_out = validate.tune_tree_counts(_forest, _table(t), KEY, TARGET, FEATURES, (5, 11, 21), k=2)
    return validate.summarize_folds(validate.fold_accuracy(held_out))


@query("rfe_results", _perfect_sql("size", [2, 4, 5], 2))
def rfe_results(t):
    """Elimination by out-of-bag importance."""
    held_out = validate.rfe(lambda n: _small_forest(mtry=n), _table(t), KEY, TARGET, FEATURES, sizes=(2, 4), k=2, ranking={"ntree": 5, "mtry": 3, "depth": 8})
    return validate.summarize_folds(validate.fold_accuracy(held_out, ["size"]), ["size"])


@query("oob_importance", INFORMATIVE_SQL)
def oob_importance(t):
    """Which features cost the trees of a bagged forest accuracy on rows they have not seen."""
    lost = validate.rank_features(_table(t), KEY, TARGET, FEATURES, ntree=7, mtry=3, depth=8)
    return lost.select("feature", (F.col("accuracy_drop") > 0.05).alias("informative"))


@query("ablation_results", _perfect_sql("setting", ["baseline", "no_year", "log_price"], 2))
def ablation_results(t):
    variants = {"no_year": (["order_year"], []), "log_price": (["o_totalprice"], ["price_log"])}
    rows = _table(t).withColumn("price_log", F.log10("o_totalprice"))
    held_out = validate.ablate(_small_forest(), rows, KEY, TARGET, FEATURES, variants, k=2)
    return validate.summarize_folds(validate.fold_accuracy(held_out))


@query("stacked_scores", f"SELECT o_orderkey AS key, {LANE_SQL} AS stack FROM {JOINED_SQL}")
def stacked_scores(t):
    """Forest over the held-out predictions of four base models."""
    rows = stage(_table(t), "orders")
    scaled = rows.select(KEY, TARGET, *[(F.col("o_orderpriority") == p).cast("double").alias(f"p{i}") for i, p in enumerate(PRIORITIES)],
                         (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"))
    held_out = {
        "rf": validate.cross_validate(_small_forest(), rows, KEY, TARGET, FEATURES, k=2),
        "xgb": validate.cross_validate(boosted(nrounds=2, max_depth=3), rows, KEY, TARGET, FEATURES, k=2, onehot=True),
        "log": validate.cross_validate(logistic(), rows, KEY, TARGET, FEATURES, k=2, onehot=True),
        "knn": validate.cross_validate_knn(scaled, KEY, TARGET, [f"p{i}" for i in range(len(PRIORITIES))] + ["building"], 7, k=2),
    }
    table = stage(ensemble.prediction_table(held_out), "predictions")
    model = ensemble.stack(table, list(held_out), ntree=21)
    return scoring.score(model, table, "key", "stack")


@query(
    "what_if_shift",
    f"""
    WITH r AS (SELECT {LANE_SQL} AS "before", CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'build' END AS "after" FROM {JOINED_SQL}),
         c AS (SELECT "before", "after", count(*) AS n FROM r WHERE "before" <> "after" GROUP BY 1, 2)
    SELECT * FROM c UNION ALL SELECT NULL, NULL, CAST(coalesce(sum(n), 0) AS BIGINT) FROM c
    """,
)
def what_if_shift(t):
    """Classes that change when every customer builds."""
    rows = _table(t)
    model = fit_classifier(_forest(), rows, TARGET, FEATURES)
    moved = scoring.what_if(model, rows, KEY, {"c_mktsegment": F.lit("BUILDING")})
    return transitions(moved, "before", "after")


@query(
    "partial_dependence",
    "SELECT DISTINCT o_orderpriority AS value, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'rest' END AS top_class FROM orders",
)
def partial_dependence(t):
    """The class each priority favours."""
    rows = _table(t)
    model = fit_classifier(_forest(), rows, TARGET, FEATURES)
    effects = scoring.partial_dependence(model, rows, "o_orderpriority")
    return effects.groupBy("value").agg(F.max_by("class", "effect").alias("top_class"))


@query(
    "partial_dependence_numeric",
    """
    WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders JOIN customer ON o_custkey = c_custkey),
         g AS (SELECT i, lo + i * (hi - lo) / 10 AS value, hi FROM r CROSS JOIN range(11) x(i))
    SELECT CAST(i AS INTEGER) AS point, round(value, 4) AS value, CASE WHEN value > 0.45 * hi THEN 'dear' ELSE 'cheap' END AS top_class FROM g
    """,
)
def partial_dependence_numeric(t):
    """The class each price favours, on eleven equally spaced prices."""
    rows = stage(_table(t), "orders")
    dear = F.col("o_totalprice") > 0.45 * rows.agg(F.max("o_totalprice")).first()[0]
    rows = rows.withColumn("price_class", F.when(dear, "dear").otherwise("cheap"))
    model = fit_classifier(_small_forest(), rows, "price_class", FEATURES)
    effects = scoring.partial_dependence(model, rows, "o_totalprice", points=11)
    top = effects.groupBy("value").agg(F.max_by("class", "effect").alias("top_class"))
    return top.select((F.row_number().over(W.orderBy("value")) - 1).alias("point"), F.round("value", 4).alias("value"), "top_class")


@query("boosted_loss", "SELECT CAST(i AS INTEGER) AS round, true AS falls FROM range(1, 4) x(i)")
def boosted_loss(t):
    """Whether the multi-class log loss of a softmax booster falls in each of its rounds."""
    losses = fit_classifier(boosted(nrounds=ROUNDS), _table(t), TARGET, FEATURES, onehot=True).stages[-2].losses
    return t.spark.createDataFrame([(i, losses[i] < losses[i - 1]) for i in range(1, len(losses))], "round int, falls boolean")


@query(
    "logistic_terms",
    """
    WITH c AS (SELECT c_mktsegment AS level, count(*)::DOUBLE AS n, count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE AS y
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment),
         b AS (SELECT ln(y / (n - y)) AS b0, 1 / y + 1 / (n - y) AS v0 FROM c WHERE level = (SELECT min(level) FROM c)),
         e AS (SELECT 'c_mktsegment=' || level AS term, ln(y / (n - y)) - b0 AS estimate, sqrt(1 / y + 1 / (n - y) + v0) AS std_error
               FROM c, b WHERE level > (SELECT min(level) FROM c)
               UNION ALL SELECT '(intercept)', b0, sqrt(v0) FROM b)
    SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(estimate / std_error, 3) AS z FROM e
    """,
)
def logistic_statistics(t):
    """Coefficients, standard errors and test statistics of a two-class model, which has a closed form for one category."""
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no").alias("open"))
    rows = stage(orders.join(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey"), "orders")
    terms = logistic_terms(fit_classifier(logistic("binomial", tol=1e-12), rows, "open", ["c_mktsegment"], onehot=True), rows)
    return terms.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"), F.round("z", 3).alias("z"))
