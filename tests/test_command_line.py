"""The command line over a small folder of tables."""

import pytest

from freshet import __main__ as run
from freshet.operators import models


def test_phases_write_resume_and_fail_apart(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(run, "build_session", lambda *a: spark)
    out = str(tmp_path / "out")
    args = ["/root/testdata/sf0.001", out, "--phases", "trends,projection,policies"]
    assert run.main(args) == 0 and capsys.readouterr().out.splitlines()[:4] == ["master: left out", "trends: done written", "projection: done written", "policies: done written"]
    assert run.main(args) == 0 and "trends: done skipped" in capsys.readouterr().out
    assert spark.read.parquet(f"{out}/projection").count() == spark.read.parquet(f"{out}/trends").count() > 0
    assert run.main(["/nowhere", str(tmp_path / "none"), "--phases", "trends,policies"]) == 1
    assert capsys.readouterr().out.count("failed") == 2


def test_few_rows_make_no_clusters(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, None)], "station_id string, u double, v double")
    x = models.standardized(df, ["u", "v"])
    assert models.best_clusters(x, 3, 2) is None and models.best_clusters(x, 2, 2) is not None
    assert models.standardized(df.limit(0), ["u", "v"]).count() == 0


@pytest.mark.parametrize("rows", [[], [("s", "cl", 2000, None)]])
def test_trends_of_nothing(spark, rows):
    from freshet.operators import series

    df = spark.createDataFrame(rows, "station_id string, ion string, year int, value double")
    assert series.station_trends(df, min_years=2).count() == 0
