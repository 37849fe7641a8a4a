"""Histories over tables and over streams that stop and go on."""

import random

import pytest

from folianta.streaming import histories

SCHEMA = "doc_id long, seq long, action string, revision_id string, base_id string, bytes long, digest string"


def event(action, doc=1, rid=None, base=None, size=1, digest=None):
    return [doc, action, rid, base, size, digest]


def table(spark, events):
    rows = [(d, i, a, r, b, s, f"d{i}" if g is None else g) for i, (d, a, r, b, s, g) in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def shown(spark, events, **limits):
    return sorted(histories.replay(table(spark, events), histories.revisions(**limits)).collect(), key=lambda r: (r.doc_id, r.seq))


def test_a_bounded_line_with_a_cursor(spark):
    got = shown(spark, [event(a) for a in ("seed", "record", "record", "record", "undo", "undo", "undo")], max_entries=2)
    assert [r.revision for r in got] == ["revision-1", "revision-2", "revision-3", "revision-4", "revision-3", "revision-2", "revision-2"]
    assert [r.moved for r in got][-1] is False and not got[-1].can_undo and got[-1].can_redo and not got[-1].at_saved


def test_a_record_clears_what_could_be_redone(spark):
    got = shown(spark, [event(a) for a in ("seed", "record", "undo", "record", "redo", "undo", "undo_failed", "redo_failed")])
    assert [(r.revision, r.can_undo, r.can_redo) for r in got][2:] == [("revision-1", False, True), ("revision-3", True, False), ("revision-3", True, False), ("revision-1", False, True), ("revision-3", True, False), ("revision-1", False, True)]


def test_same_bytes_saved_marks_and_stale_bases(spark):
    got = shown(spark, [event("undo"), event("record", rid="base", digest="x"), event("adopt", digest="x"), event("record", base="base"), event("saved"), event("undo"), event("redo"), event("unsaved"), event("record", base="obsolete"), event("clear"), event("saved")])
    assert [r.moved for r in got] == [False, True, False, True, False, True, True, False, False, True, False]
    assert [r.at_saved for r in got] == [False, True, True, False, True, False, True, False, False, False, False]
    assert [r.error for r in got][8] == "stale base" and got[8].revision == "revision-2" and got[9].revision is None


def test_bytes_are_bounded(spark):
    got = shown(spark, [event("seed", size=3), event("record", size=3), event("record", size=3), event("undo"), event("undo")], max_bytes=7)
    assert [r.revision for r in got][2:] == ["revision-3", "revision-2", "revision-2"]


def test_views_skip_what_is_gone(spark):
    jumps = [("record", 1, 9), ("record", 1, 9), ("record", 4, 9), ("record", 7, 9), ("previous", 8, 6), ("next", 4, 9), ("record", 0, 9), ("previous", 2, 3), ("next", 1, 9), ("record", None, 9), ("clear", 1, 9), ("previous", 3, 9)]
    rows = spark.createDataFrame([(None if i % 2 else 1, i, *j) for i, j in enumerate(x for j in jumps for x in (j, j))], "doc_id long, seq long, action string, page long, pages long")
    got = sorted((r for r in histories.replay(rows, histories.views()).collect() if r.doc_id), key=lambda r: r.seq)
    assert [(r.to, r.n_back, r.n_ahead) for r in got] == [(None, 1, 0), (None, 1, 0), (None, 2, 0), (None, 3, 0), (4, 1, 1), (8, 2, 0), (None, 2, 0), (1, 0, 1), (2, 1, 0), (None, 1, 0), (None, 0, 0), (None, 0, 0)]
    many = spark.createDataFrame([(1, i, "record", i + 1, 999) for i in range(150)], "doc_id long, seq long, action string, page long, pages long")
    assert max(r.n_back for r in histories.replay(many, histories.views()).collect()) == 100


@pytest.mark.parametrize("machine", ["revisions", "views"])
def test_a_stream_goes_on_after_a_restart(spark, tmp_path, machine):
    rng = random.Random(4)
    if machine == "revisions":
        made, schema = histories.revisions(3, 40), SCHEMA
        rows = [(i % 3, i, rng.choice(["record", "record", "undo", "redo", "saved", "seed", "clear"]), None, None, rng.choice([None, 3, 9]), f"d{i % 5}") for i in range(90)]
    else:
        made, schema = histories.views(4), "doc_id long, seq long, action string, page long, pages long"
        rows = [(i % 3, i, rng.choice(["record", "record", "previous", "next"]), rng.choice([None, 1, 2, 3]), 3) for i in range(90)]
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:40], rows[40:70], rows[70:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = histories.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), made)
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.unset(name)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in histories.replay(spark.createDataFrame(rows, schema), made).collect())
