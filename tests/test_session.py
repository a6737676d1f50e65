"""Intermediate results in the shared folder."""

from pathlib import Path

from dialtrace import session


def test_kept_results_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    rows = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    inside = []
    with session.shuffles_freed(spark):
        inside.append(spark.conf.get(name))
    assert inside == ["true"] and spark.conf.get(name) == before
    kept = session.keep(rows, "kept")
    assert spark.conf.get(name) == before and kept.count() == 7


def test_free_deletes_what_was_kept(spark):
    one, other = (session.keep(spark.range(n), "kept") for n in (5, 6))
    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).parent
    gone, stays = folder(one), folder(other)
    session.free(one)
    assert not gone.exists() and stays.exists() and other.count() == 6
