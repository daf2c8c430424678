from pathlib import Path

from buildlens import session


def test_scratch_paths_are_given_back(spark, monkeypatch):
    monkeypatch.setattr(session, "_HANDED_OUT", {})
    paths = [session.scratch(spark, "x") for _ in range(2)]
    spark.range(3).write.parquet(paths[0])
    assert Path(paths[0]).exists() and paths[0] != paths[1]
    assert session.release_scratch(spark) == 2 and session.release_scratch(spark) == 0
    assert not Path(paths[0]).exists()
