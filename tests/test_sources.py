from datetime import date

import pytest

from mixedframe.session import shared_dir, stage
from mixedframe.sources import load_results, read_table, save_results, write_table

SCHEMA = "id long, name string, permit string, amount double, day date"
ROWS = [(1, "a,b", "True", 1.5, date(2011, 2, 3)), (2, "", "", None, date(2013, 1, 1)), (3, 'say "hi"', "False", 0.0, None)]


def test_csv_round_trip_keeps_blank_text(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    write_table(df, str(tmp_path / "t"))
    back = read_table(spark, str(tmp_path / "t"), SCHEMA)
    assert sorted(back.collect()) == sorted(df.collect())
    assert back.schema["permit"].dataType.simpleString() == "string"


def test_header_only_once_per_file(spark, tmp_path):
    write_table(spark.range(10).repartition(3), str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t"), "id long").count() == 10


def test_no_silent_overwrite(spark, tmp_path):
    write_table(spark.range(1), str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        write_table(spark.range(1), str(tmp_path / "t"))


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("rf", 0.78, None)], "model string, accuracy double, ci double")
    save_results(df, str(tmp_path / "r"))
    assert load_results(spark, str(tmp_path / "r")).collect() == df.collect()


def test_stage_uses_the_configured_folder(spark):
    staged = stage(spark.range(5))
    assert staged.count() == 5
    assert all(f.removeprefix("file://").startswith(shared_dir(spark)) for f in staged.inputFiles())
