"""The study end to end on a hand-made wells table."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixedframe.operators.profile import missing_profile, transitions
from mixedframe.plans import wells
from mixedframe.sources import load_fitted, read_table, save_fitted

FUNDERS = ["Central Government", "GOVER", "Italian Gov", "District Council", "Methodist District", "Village Council",
           "Village Community", "Comm Bank", " ", "0", "_", "-", "", "Danida", "Danida", "Unicef"]
STATUS = ["functional", "functional needs repair", "non functional"]


def make_wells(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = int(rng.integers(0, 3))
        region = i % 4
        rows.append({
            "id": first + i, "amount_tsh": float([0, 100, 1000][i % 3]), "date_recorded": date(2011 + i % 3, 1 + i % 12, 5),
            "funder": FUNDERS[i % len(FUNDERS)], "gps_height": int(1000 * c + rng.integers(0, 300)), "installer": FUNDERS[(i + 3) % len(FUNDERS)],
            "longitude": 30.0 + region + rng.normal() / 10, "latitude": -5.0 + 3 * c + rng.normal() / 10, "wpt_name": f"w{i}", "num_private": 0,
            "basin": "Pangani", "subvillage": f"s{i}", "region": f"r{region}", "region_code": str(region), "district_code": "1", "lga": "l", "ward": "w",
            # region 0: median 0; region 1: median above 1
            "population": 0 if (region == 0 and i % 3) or i % 5 == 0 else int(10 + rng.integers(0, 200)),
            "public_meeting": "True", "recorded_by": "GeoData", "scheme_management": ["VWC", "", "SWC", "Trust", "None", "WUG"][i % 6], "scheme_name": "",
            "permit": ["True", "False", ""][i % 3], "construction_year": [0, 1990, 2000, 2004][i % 4],
            "extraction_type": "gravity", "extraction_type_group": ["gravity", "hand"][i % 2], "extraction_type_class": "gravity",
            "management": ["vwc", "company", "other - school", "trust"][i % 4], "management_group": "user", "payment": "pay annually",
            "payment_type": ["annually", "never pay"][i % 2], "water_quality": ["soft", "salty", "unknown"][c], "quality_group": "good",
            "quantity": ["enough", "seasonal", "dry"][c], "quantity_group": "enough", "source": "spring", "source_type": ["spring", "river"][i // 2 % 2],
            "source_class": "ground", "waterpoint_type": ["standpipe", "hand pump"][i % 2], "waterpoint_type_group": "standpipe", "status": STATUS[c],
        })
    table = spark.createDataFrame(rows, wells.SCHEMA + ", status string")
    return table.drop("status"), table.select("id", F.col("status").alias("status_group"))


@pytest.fixture(scope="module")
def tables(spark):
    train, labels = make_wells(spark, 240, 1)
    test, _ = make_wells(spark, 60, 2, first=1000)
    extra = spark.createDataFrame([(9999, "functional")], "id long, status_group string")
    return train.cache(), labels.unionByName(extra).cache(), test.cache()


@pytest.fixture(scope="module")
def cleaned(tables):
    train, labels, test = tables
    joined = wells.join_labels(labels, train)
    assert joined.columns[:2] == ["id", "status_group"] and joined.count() == 241
    joined = joined.filter(F.col("longitude").isNotNull())
    model = wells.WellsCleaner(small=4, large=6).fit(joined)
    return model, model.transform(joined).cache(), model.transform(test).cache()


def test_schema_has_forty_columns(tables):
    assert len(tables[0].columns) == 40


def test_names_follow_the_rules(tables):
    rows = wells.row_cleaning(tables[0]).select("funder", "funder_name", "installer", "installer_name").distinct().collect()
    funder = {r.funder: r.funder_name for r in rows}
    installer = {r.installer: r.installer_name for r in rows}
    assert funder["Central Government"] == funder["GOVER"] == funder["District Council"] == "gov"
    assert funder["Italian Gov"] == "italian gov" and funder["Methodist District"] == "methodist district"
    assert funder["Village Council"] == "comm" and installer["Village Council"] == "gov"
    assert funder["Comm Bank"] == "comm bank" and {funder[b] for b in wells.blank_to.__defaults__[0]} == {"unknown"}


def test_cleaned_columns(cleaned):
    model, train, test = cleaned
    assert not set(wells.DROPPED) & set(train.columns)
    for c in (*wells.FOREST_FEATURES, *wells.LEAKY_FEATURES, *wells.BOOSTED_FEATURES, *wells.MULTINOMIAL_FEATURES, *wells.NEIGHBOUR_FEATURES):
        assert c in train.columns and c in test.columns, c
    assert {r[0] for r in train.select("scheme_management").distinct().collect()} == {"vwc", "unknown", "other", "wug"}
    assert {r[0] for r in test.select("permit").distinct().collect()} == {"True", "False", "unknown"}
    assert {r[0] for r in train.select("management").distinct().collect()} == {"vwc", "private operator", "other"}
    assert train.count() == 240 and test.count() == 60


def test_years_use_the_training_median(cleaned):
    model, train, test = cleaned
    assert model.years.median_built == 2000.0
    unknown = test.filter("construction_year = 0").select("years_op", "year_recorded").collect()
    assert unknown and all(r.years_op == r.year_recorded - 2000.0 for r in unknown)


def test_lumped_names_come_from_training(cleaned):
    model, train, test = cleaned
    kept = {r[0] for r in model.lumpers["installer10"].levels.collect()}
    assert len(kept) == 4
    assert {r[0] for r in test.select("installer10").distinct().collect()} <= kept | {"other"}


def test_population_imputation(cleaned):
    _, train, _ = cleaned
    rows = train.select("region_code", "population", "population2", "pop_log", "pop_log3").toPandas()
    region0 = rows[rows["region_code"] == "0"]
    assert region0["population"].median() == 0 and (region0.loc[region0["population"] == 0, "population2"] == 0).all()
    region1 = rows[(rows["region_code"] == "1") & (rows["population"] == 0)]
    assert (region1["population2"] == rows[rows["region_code"] == "1"]["population"].median()).all()
    assert (rows["pop_log3"] > 0).all()
    known = rows[rows["pop_log"] > 0]
    assert (known["pop_log"] == known["pop_log3"]).all()


def test_a_stored_cleaner_cleans_the_same(spark, cleaned, tables, tmp_path):
    cleaner = wells.WellsCleaner(2, 3, 2).fit(tables[0])
    save_fitted(spark, cleaner, str(tmp_path / "cleaner"))
    again = load_fitted(spark, str(tmp_path / "cleaner"))
    want = cleaner.transform(tables[0])
    assert again.transform(tables[0]).exceptAll(want).isEmpty() and want.count() == again.transform(tables[0]).count()


def test_missing_profile(tables):
    rows = {r["column"]: r.share for r in missing_profile(tables[0], wells.missing_rules(tables[0])).collect()}
    assert rows["amount_tsh"] == pytest.approx(1 / 3) and rows["construction_year"] == 0.25 and rows["latitude"] == 0.0


def test_models_and_submissions(spark, cleaned, tmp_path):
    _, train, test = cleaned
    small = {"ntree": 5, "max_depth": 5}
    models = wells.fit_models(train, k=2, forest_params=small, boosted_params={"nrounds": 2, "max_depth": 3}, stack_params={"ntree": 5})
    paths = models.submissions(test, str(tmp_path))
    assert len(paths) == 5
    for path in paths:
        back = read_table(spark, path, wells.LABEL_SCHEMA)
        assert back.count() == 60 and {r[0] for r in back.select("status_group").distinct().collect()} <= set(STATUS)
    fitted = models.predictions(train).join(train.select("id", "status_group"), "id")
    assert fitted.filter("stack = status_group").count() > 200
    save_fitted(spark, models, str(tmp_path / "models"))
    again = load_fitted(spark, str(tmp_path / "models")).predictions(test)
    assert again.count() == 60 and again.exceptAll(models.predictions(test)).isEmpty()
    changes = transitions(wells.class_changes(models.pipelines["rf"], train), "before", "after").collect()
    assert sum(r.n for r in changes if r.before is None) == sum(r.n for r in changes if r.before is not None)


def test_rest_of_the_study(cleaned):
    """Elimination, tuning, substitutions, the two-class model and the comparison, on small settings."""
    _, train, _ = cleaned
    sizes = wells.eliminate_features(train, sizes=(4, 8), k=2, ntree=3)
    assert {r["size"] for r in sizes.collect()} == {4, 8, 13}
    assert {r.feature for r in wells.rank_features(train, ntree=3).collect()} == set(wells.BOOSTED_FEATURES)
    tuned = {r.setting for r in wells.tune_forest(train, trees=(3, 5), mtry=(2, 3), k=2, ntree=5).collect()}
    assert tuned == {"ntree=3", "ntree=5", "mtry=2", "mtry=3"}
    swapped = wells.substitute_features(train, k=2, ntree=3).collect()
    assert {r.setting for r in swapped} == {"baseline", *wells.SUBSTITUTIONS} and all(r.k == 2 for r in swapped)
    two = wells.two_class_models(train, k=2)
    assert {r.setting: r.n for r in two.groupBy("setting").agg(F.count("*").alias("n")).collect()} == {"all": 240, "fewer": 240}
    assert {r.obs for r in two.select("obs").distinct().collect()} == {"functional", "non functional"}
    holdout = train.select(wells.TARGET, F.col(wells.TARGET).alias("all"), F.lit("functional").alias("vote"))
    table = {r.model: r for r in wells.compare_accuracies({"all": two.where("setting = 'all'")}, holdout, ["all", "vote"]).collect()}
    assert table["all"].holdout == 1.0 and table["all"].accuracy > 0.5 and table["vote"].accuracy is None
