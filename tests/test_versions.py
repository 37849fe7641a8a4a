"""Versions of a table: one writer gets in, nothing half-written stays."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from folianta.sources import versions


def listed(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_versions_follow_each_other(spark, tmp_path):
    at = str(tmp_path / "t")
    assert versions.latest(spark, at) is None
    with pytest.raises(FileNotFoundError):
        versions.load(spark, at)
    assert versions.commit(spark.range(3), at, None) == 0
    assert versions.commit(versions.load(spark, at).select((F.col("id") * 2).alias("id")), at, 0) == 1
    assert sorted(r.id for r in versions.load(spark, at).collect()) == [0, 2, 4]
    assert versions.load(spark, at, 0).count() == 3 and versions.latest(spark, at) == 1


def test_the_later_of_two_writers_is_refused(spark, tmp_path):
    at = str(tmp_path / "t")
    versions.commit(spark.range(3), at, None)

    def another_writes(rows):
        versions.commit(spark.range(7), at, 0)

    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(5), at, 0, validate=another_writes)
    assert versions.load(spark, at).count() == 7 and listed(at) == ["version=0", "version=1"]


def test_writers_at_once(spark, tmp_path):
    at, done, lost = str(tmp_path / "t"), [], []
    versions.commit(spark.range(1), at, None)
    together = threading.Barrier(3)

    def write(n):
        try:
            versions.commit(spark.range(n), at, 0, validate=lambda rows: together.wait(60) and None)
            done.append(n)
        except versions.Conflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20, 30)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(lost) == 2 and versions.load(spark, at).count() == done[0] and listed(at) == ["version=0", "version=1"]


def test_nothing_stays_of_what_fails(spark, tmp_path):
    at = str(tmp_path / "t")
    versions.commit(spark.range(3), at, None)
    with pytest.raises(ValueError, match="too few"):
        versions.commit(spark.range(1), at, 0, validate=lambda rows: "too few" if rows.count() < 3 else None)
    with pytest.raises(Exception, match="broken"):
        versions.commit(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id")), at, 0)
    assert listed(at) == ["version=0"] and versions.latest(spark, at) == 0


def test_a_base_that_changed_is_a_conflict(spark, tmp_path):
    at = str(tmp_path / "t")
    versions.commit(spark.range(3), at, None)
    seen = versions.fingerprint(versions.load(spark, at))
    assert seen == versions.fingerprint(spark.range(2, -1, -1)) and seen != versions.fingerprint(spark.range(4))
    spark.range(1).write.mode("append").parquet(f"{at}/version=0")
    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(5), at, 0, unchanged=seen)
    assert listed(at) == ["version=0"]
