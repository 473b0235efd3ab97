import pytest
from pyspark.sql import functions as F

from conftest import rows
from textlake.operators import log, merge
from textlake.plans.sessions import close_stored_sessions, longest_summaries, mark_stored_incomplete, merge_stored_sessions
from textlake.sources import versions

SESSION = "id string, project string, started_at bigint, ended_at bigint, summary string"


def some(spark, n=40):
    return spark.range(n).selectExpr(
        "concat('s', id) AS id", "concat('p', id % 3) AS project", "id AS started_at", "CAST(NULL AS BIGINT) AS ended_at", "CAST(NULL AS STRING) AS summary"
    )


def files(spark, path, version=None):
    return {f.split("/")[-3] + "/" + f.split("/")[-2] for f in versions.read(spark, path, version).inputFiles()}


def test_closing_a_session_rewrites_its_bucket_only(spark, tmp_path):
    path = str(tmp_path / "log")
    versions.create(some(spark), path, buckets=8)
    old = versions.read(spark, path)  # a reader that was there before
    before = files(spark, path)
    updates = spark.createDataFrame([("s7", 99, "done"), ("s7", 98, "earlier"), ("nobody", 1, "x")], "id string, ended_at bigint, summary string")
    assert close_stored_sessions(spark, path, updates) == 2
    assert sorted(rows(versions.read(spark, path))) == sorted(rows(log.close_sessions(some(spark), updates)))
    after = files(spark, path)
    # Two keys: two buckets at most have another folder, the other six are the files of before.
    assert len(before & after) >= len(before) - 2 and before != after
    assert files(spark, path, 1) == before
    assert sorted(rows(old)) == sorted(rows(some(spark))) == sorted(rows(versions.read(spark, path, 1)))
    assert mark_stored_incomplete(spark, path, some(spark).select("id", F.lit(5).cast("bigint").alias("ended_at"))) == 3
    got = {r.id: (r.ended_at, r.summary) for r in versions.read(spark, path).collect()}
    assert got.pop("s7") == (99, "done") and set(got.values()) == {(5, "[incomplete]")}


def test_merge_adds_and_lengthens(spark, tmp_path):
    path = str(tmp_path / "log")
    local = some(spark, 6).withColumn("summary", F.when(F.col("id") < "s3", F.lit("four")))
    versions.create(local, path, buckets=4)
    remote = spark.createDataFrame(
        [("s1", "x", 1, 2, "longer"), ("s2", "x", 1, 2, "no"), ("s5", "x", 1, 2, "one"), ("new", "p", 3, 4, None), ("new", "p", 5, 6, "later"), (None, "p", 1, 1, "z")],
        SESSION,
    )
    once = longest_summaries(remote)
    assert {(r.id, r.started_at, r.summary) for r in once.where("id IN ('new', 's1')").collect()} == {("new", 3, "later"), ("s1", 1, "longer")}
    merge_stored_sessions(spark, path, remote)
    got = {r.id: r for r in versions.read(spark, path).where("id IS NOT NULL").collect()}
    want = {r.id: r for r in merge.merge_sessions(local, once.where("id IS NOT NULL")).collect()}
    assert got == want and got["s1"].summary == "longer" and got["s2"].summary == "four" and got["new"].summary == "later"
    # The same again changes no row.
    merge_stored_sessions(spark, path, remote.where("id IS NOT NULL"))
    assert {r.id: r for r in versions.read(spark, path).where("id IS NOT NULL").collect()} == want


def test_a_failed_change_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "log")
    versions.create(some(spark), path, buckets=4)
    updates = some(spark).select("id", F.lit(1).cast("bigint").alias("ended_at"), F.lit("x").alias("summary"))

    def broken(stored, changes):
        return log.close_sessions(stored, changes).withColumn("ended_at", F.raise_error(F.lit("stop")).cast("bigint"))

    with pytest.raises(Exception, match="stop"):
        versions.rewrite(spark, path, updates, broken)
    assert versions.newest(spark, path) == 1 and sorted(rows(versions.read(spark, path))) == sorted(rows(some(spark)))
    assert close_stored_sessions(spark, path, updates) == 2


def test_empty_tables_and_changes(spark, tmp_path):
    path = str(tmp_path / "log")
    versions.create(some(spark).limit(0), path)
    assert versions.read(spark, path).columns == some(spark).columns and versions.read(spark, path).count() == 0
    nothing = some(spark).limit(0)
    assert merge_stored_sessions(spark, path, nothing) == 1
    assert close_stored_sessions(spark, path, some(spark, 2).select("id", F.lit(1).cast("bigint").alias("ended_at"), F.lit("x").alias("summary"))) == 1
    assert merge_stored_sessions(spark, path, some(spark, 3)) == 2 and versions.read(spark, path).count() == 3
    with pytest.raises(ValueError, match="already"):
        versions.create(some(spark), path)
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="version 9"):
        versions.read(spark, path, 9)
