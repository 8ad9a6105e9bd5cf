"""Written tables are deleted by the run, and for the application, that wrote them."""

import os

from attestra import session


def test_scratch_tables_go(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", {"/tmp/of-another-application": "other"})
    kept = session.written(spark.range(3), "kept")
    with session.scratch(spark):
        gone = session.written(spark.range(5), "gone")
        assert gone.count() == 5
    there = lambda df: os.path.exists(df._attestra_path.removeprefix("file:"))
    assert not there(gone) and kept.count() == 3
    session.forget_all(spark)
    assert not there(kept) and session._WRITTEN == {"/tmp/of-another-application": "other"}
