"""A newer search stops an older one, which leaves nothing."""

import os
import time

import pytest

from folianta.streaming import searches


@pytest.fixture
def latest(spark):
    made = searches.Latest(spark, quiet=0.1)
    yield made
    made.close()


def slow(spark, seconds, marks=None):
    def wait(batches):
        for b in batches:
            if marks:
                open(f"{marks}/{time.time_ns()}", "w").close()
            time.sleep(seconds)
            yield b

    return lambda: spark.range(4).repartition(4).mapInArrow(wait, "id long")


def until(what, seconds=30):
    end = time.time() + seconds
    while not what():
        assert time.time() < end
        time.sleep(0.05)


def test_the_older_search_stops_and_leaves_nothing(spark, latest, tmp_path):
    marks, out = tmp_path / "marks", tmp_path / "out"
    marks.mkdir()
    out.mkdir()
    older = latest.submit("k", slow(spark, 60, marks), str(out / "k"))
    until(lambda: os.listdir(marks))
    began = time.time()
    newer = latest.submit("k", lambda: spark.range(3), str(out / "k"))
    assert newer.result(60) == str(out / "k") and older.result(60) is None and time.time() - began < 30
    assert spark.read.parquet(str(out / "k")).count() == 3 and os.listdir(out) == ["k"]
    until(lambda: not spark.sparkContext.statusTracker().getActiveJobsIds())


def test_only_the_last_of_a_burst_starts(spark, latest, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    burst = [latest.submit("k", slow(spark, 0, marks), str(tmp_path / "k")) for _ in range(5)] + [latest.submit("other", lambda: spark.range(2), str(tmp_path / "other"))]
    assert [f.result(60) for f in burst] == [None] * 4 + [str(tmp_path / "k"), str(tmp_path / "other")]
    assert 1 <= len(os.listdir(marks)) <= 4


def test_cancelled_and_failed_searches(spark, latest, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    one = latest.submit("k", slow(spark, 60, marks), str(tmp_path / "k"))
    until(lambda: os.listdir(marks))
    latest.cancel("k")
    assert one.result(60) is None
    with pytest.raises(Exception, match="no_such_table"):
        latest.submit("k", lambda: spark.table("no_such_table"), str(tmp_path / "k")).result(60)
    assert latest.submit("k", lambda: spark.range(1), str(tmp_path / "k")).result(60)
    assert sorted(os.listdir(tmp_path)) == ["k", "marks"]


def test_a_stream_of_queries(spark, latest, tmp_path):
    rows = [("a", 1, "x"), ("a", 3, "three"), ("a", 2, "y"), ("b", 1, "one")]
    spark.createDataFrame(rows, "key string, seq long, query string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, query string").parquet(str(tmp_path / "in"))
    asked = []

    def search(q):
        asked.append(q)
        return spark.range(1).selectExpr(f"'{q}' as found")

    run = searches.follow(stream, latest, search, str(tmp_path / "out"), str(tmp_path / "at"), "200 milliseconds")
    try:
        until(lambda: os.path.isdir(tmp_path / "out/a") and os.path.isdir(tmp_path / "out/b"), 60)
    finally:
        run.stop()
    assert sorted(asked) == ["one", "three"] and spark.read.parquet(str(tmp_path / "out/a")).first().found == "three"


def test_what_is_not_read_is_not_worked_out(spark, tmp_path):
    got = searches.lazily(spark.range(8, numPartitions=8).mapInArrow(lambda bs, at=str(tmp_path): (open(f"{at}/{b[0][0].as_py()}", "w").close() or b for b in bs), "id long"))
    assert [next(got).id, next(got).id] == [0, 1]
    got.close()
    assert len(os.listdir(tmp_path)) <= 3
