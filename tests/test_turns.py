"""Keyed state over a stream: order, repeats, late turns, restarts and silence."""

import time

from inkwell.operators.history import recent_turns
from inkwell.streaming import turns as E

SCHEMA = "conv_id long, turn long, role string, text string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def drain(spark, folder, out, checkpoint, **kw):
    E.use_state_store(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = E.keep_current(E.recent_turns_stream(stream, **kw), str(out), str(checkpoint))
    q.awaitTermination()
    assert q.exception() is None


def test_equals_the_table_after_a_restart_with_late_and_repeated_turns(spark, data, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").where("conv_id < 60").collect()]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    late, early = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    put(spark, tmp_path / "in", early[::-1])
    put(spark, tmp_path / "in", early[: len(early) // 2])
    drain(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck")
    put(spark, tmp_path / "in", late + early[:5])
    put(spark, tmp_path / "in", [(None, 1, "user", "x"), (1, None, "user", "x")])
    drain(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck")
    cols = ["conv_id", "turn", "role", "text", "back"]
    got = sorted(map(tuple, E.current(spark, str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, recent_turns(spark.createDataFrame(rows, SCHEMA)).select(*cols).collect()))
    assert got == want and len(got) > 50


def test_what_changes_nothing_is_not_written_again(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, t, "user", f"t{t}") for t in (5, 6, 7, 8)])
    drain(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck")
    put(spark, tmp_path / "in", [(1, 2, "user", "old"), (1, 7, "user", "other text")])
    drain(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck")
    rows = spark.read.schema(E.OUT).parquet(str(tmp_path / "out"))
    assert sorted((r.version, r.turn, r.text, r.back) for r in rows.collect()) == [(1, 6, "t6", 3), (1, 7, "t7", 2), (1, 8, "t8", 1)]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, 1, "user", "a"), (2, 1, "user", None)])
    for checkpoint in ("first", "second"):
        drain(spark, tmp_path / "in", tmp_path / "out", tmp_path / checkpoint)
    assert [tuple(r) for r in E.current(spark, str(tmp_path / "out")).collect()] == [(1, 1, "user", "a", 1)]


def test_silent_conversations_are_cleared(spark, tmp_path):
    def versions():
        rows = spark.read.schema(E.OUT).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
        return {(r.conv_id, r.turn): r.version for r in rows}

    def wait(key):
        for _ in range(80):
            if key in versions():
                return
            time.sleep(0.5)

    E.use_state_store(spark)
    put(spark, tmp_path / "in", [(1, 1, "user", "a")])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = E.keep_current(E.recent_turns_stream(stream, idle=200), str(tmp_path / "out"), str(tmp_path / "ck"), every="1 second")
    try:
        wait((1, 1))
        time.sleep(8)
        put(spark, tmp_path / "in", [(1, 2, "user", "c")])
        wait((1, 2))
    finally:
        q.stop()
    assert q.exception() is None
    assert versions() == {(1, 1): 1, (1, 2): 1}, "the second turn found no state"
