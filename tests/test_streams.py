"""Streams against their batch form over several batches, late rows, replays."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from harness import fixtures
from mediaops import schemas as s
from mediaops.operators import events as batch_events
from mediaops.operators import uploads
from mediaops.sources import topics
from mediaops.streaming import jobs, state

T0 = datetime.datetime(2024, 1, 1)


def _at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def _feed(spark, tmp_path, schema, *batches):
    """One Parquet file per batch, read one file at a time in writing order."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        os.rename(os.path.join(part, name), os.path.join(folder, f"{i:03}.parquet"))
        os.utime(os.path.join(folder, f"{i:03}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(spark, tmp_path, stream):
    out = str(tmp_path / "out")
    jobs.start(stream, out, str(tmp_path / "progress"), available_now=True).awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(out)


EVENT = "task_id string, seq long, ts timestamp_ntz, status string, retry_count int"


def _events(*marks):
    return [(task, seq, _at(minute), status, 0) for task, seq, minute, status in marks]


def test_late_rows_are_dropped(spark, tmp_path):
    feed = _feed(
        spark, tmp_path, EVENT,
        _events(("a", 1, 0, "X"), ("a", 2, 1, "X")), _events(("a", 3, 200, "X")), _events(("a", 4, 201, "X")),
        _events(("a", 5, 2, "X"), ("a", 6, 400, "X")),
    )
    counts = jobs.event_counts(feed, "status", "ts", "1 hour", "10 minutes")
    got = {r.window_start: r.n for r in _run(spark, tmp_path, counts).collect()}
    assert got == {_at(0): 2, _at(180): 2}


@pytest.mark.parametrize("minutes", [lambda i: i % 240, lambda i: 0 if i < 195 else i], ids=["spread", "parts without rows"])
def test_a_feed_is_written_by_many_tasks_and_read_in_order(spark, tmp_path, minutes):
    rows = [(i, i % 5, _at(minutes(i)), "view", 1.0) for i in range(200)] + [(200, 1, None, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    feed = fixtures.stream(spark, str(tmp_path), "fx_task_events", file_rows=8)
    seen = {}
    jobs.start_batches(
        feed, lambda df, at: seen.update({at: [tuple(r) for r in df.select("seq", "ts", F.input_file_name()).collect()]}), str(tmp_path / "progress"),
        available_now=True).awaitTermination(120)
    assert len(seen) == fixtures.BATCHES and sorted(r[0] for part in seen.values() for r in part) == list(range(201))
    assert max(len({r[2] for r in part}) for part in seen.values()) == 9
    times = [[r[1] for r in seen[k] if r[1]] for k in sorted(seen)]
    assert all(max(a) < min(b) for a, b in zip([t for t in times if t], [t for t in times if t][1:]))


def test_repeats_in_later_batches_are_dropped(spark, tmp_path):
    feed = _feed(
        spark, tmp_path, EVENT,
        _events(("a", 1, 0, "X"), ("b", 2, 1, "X")), _events(("a", 3, 5, "X"), ("c", 4, 6, "X")),
    )
    got = _run(spark, tmp_path, jobs.dedup_messages(feed, "ts").select("task_id")).collect()
    assert sorted(r.task_id for r in got) == ["a", "b", "c"]


def test_task_state_over_batches_equals_batch(spark, tmp_path):
    first = _events(("a", 1, 0, "PENDING"), ("b", 2, 1, "FAILED"), ("a", 3, 2, "QUEUED"))
    second = _events(("a", 4, 3, "COMPLETED"), ("b", 5, 4, "DEAD"), ("b", 6, 5, "PENDING"))
    live = _run(spark, tmp_path, state.task_state(_feed(spark, tmp_path, EVENT, first, second)))
    whole = batch_events.transition_audit(spark.createDataFrame(first + second, EVENT))
    columns = ["task_id", "seq", "from_status", "to_status", "legal"]
    assert sorted(live.select(*columns).collect()) == sorted(whole.select(*columns).collect())
    assert sorted(r.seq for r in live.filter("NOT legal").collect()) == [4, 6]


def test_stuck_alerts_by_timer_and_by_gap(spark, tmp_path):
    feed = _feed(
        spark, tmp_path, EVENT,
        _events(("gap", 1, 0, "PROCESSING"), ("gap", 2, 45, "COMPLETED"), ("quiet", 3, 5, "PROCESSING"),
                ("fine", 4, 44, "PROCESSING")),
        _events(("fine", 5, 50, "COMPLETED"), ("other", 6, 70, "QUEUED")),
        _events(("other", 7, 90, "QUEUED")),
    )
    got = sorted((r.task_id, r.since.replace(tzinfo=None)) for r in _run(spark, tmp_path, state.stuck_alerts(feed)).collect())
    assert got == [("gap", _at(0)), ("quiet", _at(5))]


def _shuffled(n, seed):
    """Events of tasks at random, a null task among them, in three parts by time."""
    rng = random.Random(seed)
    kinds = ["PENDING", "QUEUED", "PROCESSING", "PROCESSING", "FAILED", "RETRYING", "COMPLETED", None]
    marks = sorted(((rng.choice([None, *(f"t{i}" for i in range(60))]), i, rng.randrange(6000), rng.choice(kinds)) for i in range(n)), key=lambda m: m[2])
    cuts = [0, *(next(i for i in range(n * k // 3, n) if marks[i][2] != marks[i - 1][2]) for k in (1, 2)), n]
    return [rng.sample(_events(*marks[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]


def test_stuck_alerts_share_state(spark, tmp_path):
    parts = _shuffled(900, 2)
    stream, out = state.stuck_alerts(_feed(spark, tmp_path, EVENT, *parts), buckets=3), str(tmp_path / "out")
    query = jobs.start(stream, out, str(tmp_path / "progress"), available_now=True)
    query.awaitTermination(120)
    assert max(_state_rows(query)) <= 2 * 3  # a table and a timer each
    rows, half_hour = sorted(sum(parts, []), key=lambda r: (r[2], r[1])), datetime.timedelta(minutes=30)
    passed, want = rows[-1][2] - datetime.timedelta(minutes=10), []
    for task in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == task]
        for event, later in zip(own, [*own[1:], None]):
            over = later[2] - event[2] > half_hour if later else event[2] + half_hour <= passed
            want += [(task, event[2])] * (event[3] == "PROCESSING" and over)
    got = [(r.task_id, r.since.replace(tzinfo=None)) for r in spark.read.parquet(out).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def _state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_of_settled_tasks_goes(spark, tmp_path):
    feed = _feed(
        spark, tmp_path, EVENT,
        _events(*[(f"t{i}", i, 0, "PROCESSING") for i in range(6)]), _events(*[(f"t{i}", 10 + i, 5, "COMPLETED") for i in range(5)]),
        _events(("late", 20, 300, "QUEUED")), _events(("late", 21, 301, "PROCESSING"), ("t5", 22, 302, "FAILED")), _events(("t5", 23, 303, "RETRYING")),
    )
    out = str(tmp_path / "out")
    query = jobs.start(state.task_state(feed, keep_hours=1), out, str(tmp_path / "progress"), available_now=True)
    query.awaitTermination(120)
    rows = {r.seq: (r.from_status, r.legal) for r in spark.read.parquet(out).collect()}
    assert len(rows) == 15 and rows[10] == ("PROCESSING", True) and rows[22] == ("PROCESSING", True) and rows[23] == ("FAILED", True)
    assert max(_state_rows(query)) >= 6 and _state_rows(query)[-1] < max(_state_rows(query))


def test_task_state_shares_state(spark, tmp_path):
    """Tasks share the state and the calls of a few buckets, and each event still sees its own task's status before."""
    parts = _shuffled(900, 1)
    stream, out = state.task_state(_feed(spark, tmp_path, EVENT, *parts), keep_hours=10_000, buckets=3), str(tmp_path / "out")
    query = jobs.start(stream, out, str(tmp_path / "progress"), available_now=True)
    query.awaitTermination(120)
    assert max(_state_rows(query)) <= 2 * 3  # a table and a timer each
    whole = batch_events.transition_audit(spark.createDataFrame(sum(parts, []), EVENT))
    columns = ["task_id", "seq", "from_status", "to_status", "legal"]
    got, want = (sorted(map(repr, df.select(*columns).collect())) for df in (spark.read.parquet(out), whole))
    assert got == want


def test_upload_progress_over_batches(spark, tmp_path):
    schema = "upload_id string, chunk_index int, total_chunks int"
    rows = ([("a", 0, 3), ("a", 0, 3), ("b", 1, 2), ("z", 0, 0), ("n", None, None)], [("a", 2, 3), ("a", 7, 3), ("a", -1, 3)], [("a", 2, 3)], [("a", 1, 3)])
    feed, out = _feed(spark, tmp_path, schema, *rows), str(tmp_path / "out")
    stream = state.upload_progress(feed)
    jobs.start(stream, out, str(tmp_path / "progress"), available_now=True, idle_batches=False).awaitTermination(120)
    written = spark.read.schema(stream.schema).parquet(out)
    assert sorted((r.added, r.done, r.progress) for r in written.filter("upload_id = 'a'").collect()) == [([], 2, 66), ([0], 1, 33), ([1], 3, 100), ([2], 2, 66)]
    newest = {r.upload_id: (r.chunks, r.done, r.progress) for r in state.newest_progress(written).collect()}
    assert newest == {"a": ([0, 1, 2], 3, 100), "b": ([1], 1, 50), "z": ([], 0, 0), "n": ([], 0, 0)}
    acks = spark.createDataFrame([r for batch in rows for r in batch], schema).select("upload_id", "chunk_index")
    sessions = spark.createDataFrame([("a", 3, 0), ("b", 2, 0)], "upload_id string, total_chunks int, status int")
    assert {r.upload_id: r.progress for r in uploads.upload_progress(acks, sessions).collect()} == {"a": 100, "b": 50}


def test_chunk_sets_of_many_uploads_share_state(spark, tmp_path):
    """Python and the state store are asked once a bucket, not once an upload or chunk."""
    schema, out = "upload_id string, chunk_index int, total_chunks int", str(tmp_path / "out")
    batches = [[(None if i == 7 else f"u{i}", (i + k) % 3, 3) for i in range(200) for k in (0, 1)], [(f"u{i}", 2, 3) for i in range(0, 200, 2)]]
    stream = state.upload_progress(_feed(spark, tmp_path, schema, *batches), buckets=4)
    query = jobs.start(stream, out, str(tmp_path / "progress"), available_now=True, idle_batches=False)
    query.awaitTermination(120)
    assert max(_state_rows(query)) <= 4
    written = spark.read.schema(stream.schema).parquet(out)
    assert written.count() == 300
    got = {r.upload_id: (r.chunks, r.done, r.progress) for r in state.newest_progress(written).collect()}
    want = {None if i == 7 else f"u{i}": {i % 3, (i + 1) % 3} | ({2} if i % 2 == 0 else set()) for i in range(200)}
    assert got == {u: (sorted(c), len(c), 100 * len(c) // 3) for u, c in want.items()}


def test_chunks_are_forgotten_after_their_time(spark, tmp_path):
    schema, out, progress = "upload_id string, chunk_index int, total_chunks int", str(tmp_path / "out"), str(tmp_path / "progress")
    feed = _feed(spark, tmp_path, schema, [("a", 0, 2)], [("a", 1, 2)], [("a", 1, 2)])
    stream = state.upload_progress(feed, hours=1e-6)  # a few milliseconds
    jobs.start(stream, out, progress, available_now=True, idle_batches=False).awaitTermination(120)
    assert {r.done for r in spark.read.schema(stream.schema).parquet(out).collect()} == {1}


def test_dead_letters_keep_one_row_across_batches(spark, tmp_path):
    schema = "task_id string, retry_count int, error string, sent_at timestamp_ntz"
    feed = _feed(
        spark, tmp_path, schema,
        [("a", 3, "x", _at(0)), ("a", 3, "y", _at(1)), ("b", None, "z", _at(2))],
        [("a", 3, "later", _at(3)), ("a", 4, "new", _at(4)), ("b", None, "again", _at(5))],
    )
    path = str(tmp_path / "letters")
    jobs.append_dead_letters(feed, path, str(tmp_path / "progress"), available_now=True).awaitTermination(120)
    got = sorted((r.task_id, r.retry_count or 0, r.error) for r in spark.read.parquet(path).collect())
    assert got == [("a", 3, "x"), ("a", 4, "new"), ("b", 0, "z")]


def test_dead_letters_of_two_checkpoints_are_all_kept(spark, tmp_path):
    schema = "task_id string, retry_count int, error string, sent_at timestamp_ntz"
    path = str(tmp_path / "letters")
    halves = [("a", 3, "x", _at(0)), ("b", None, "z", _at(1))], [("a", 3, "later", _at(2)), ("c", 1, "new", _at(3))]
    for i, rows in enumerate(halves):
        (tmp_path / str(i)).mkdir()
        feed = _feed(spark, tmp_path / str(i), schema, rows)
        jobs.append_dead_letters(feed, path, str(tmp_path / f"progress{i}"), available_now=True).awaitTermination(60)
    got = sorted((r.task_id, r.retry_count or 0, r.error) for r in spark.read.parquet(path).collect())
    assert got == [("a", 3, "x"), ("b", 0, "z"), ("c", 1, "new")]


def test_dead_letters_outlive_a_lost_checkpoint(spark, tmp_path):
    """The checkpoint's content is lost and it begins anew under the same path: what was stored stays."""
    path, progress = str(tmp_path / "letters"), tmp_path / "progress"
    for i, rows in enumerate(([("a", 1, "x", _at(0)), (None, 1, "who", _at(0))], [("b", 1, "y", _at(1)), ("a", 1, "later", _at(2)), (None, 1, "who", _at(0))])):
        if progress.exists():
            progress.rename(tmp_path / "lost")
        (tmp_path / f"in{i}").mkdir()
        feed = _feed(spark, tmp_path / f"in{i}", jobs.LETTER, rows)
        jobs.append_dead_letters(feed, path, str(progress), available_now=True).awaitTermination(60)
    assert sorted((r.task_id, r.error) for r in spark.read.parquet(path).collect()) == [("a", "x"), ("b", "y")]
    assert [r.error for r in spark.read.parquet(f"{path}-nameless").collect()] == ["who", "who"]


def test_a_batch_of_letters_reads_its_own_days_only(spark, tmp_path):
    ids = [f"task_{day * 86400}_ab" for day in range(4)]
    days = spark.createDataFrame([(i,) for i in ids], "id string").select(jobs.letter_bucket(F.col("id"))).collect()
    assert len({d[0] for d in days}) == 4
    path, progress = str(tmp_path / "letters"), str(tmp_path / "progress")
    (tmp_path / "one").mkdir()
    jobs.append_dead_letters(_feed(spark, tmp_path / "one", jobs.LETTER, [(i, 1, "x", _at(0)) for i in ids]), path, progress, available_now=True).awaitTermination(60)
    broken = next((tmp_path / "letters" / f"bucket={days[0][0]}").rglob("*.parquet"))
    broken.write_bytes(b"can not be read")
    (tmp_path / "two").mkdir()
    feed = _feed(spark, tmp_path / "two", jobs.LETTER, [(ids[1], 1, "again", _at(1)), (ids[1], 2, "new", _at(1))])
    jobs.append_dead_letters(feed, path, str(tmp_path / "other"), available_now=True).awaitTermination(60)
    kept = spark.read.option("basePath", path).parquet(*(f"{path}/bucket={d[0]}" for d in days[1:])).collect()
    assert sorted((r.task_id, r.retry_count, r.error) for r in kept) == sorted([(i, 1, "x") for i in ids[1:]] + [(ids[1], 2, "new")])


def test_stream_publish_and_read(spark, tmp_path):
    feed = _feed(spark, tmp_path, EVENT, _events(("a", 1, 0, "COMPLETED"), ("b", 2, 1, "QUEUED")))
    sent = feed.select("task_id", F.col("status").alias("event"), F.lit(None).cast("string").alias("detail"), F.col("ts").alias("sent_at"))
    target = {"format": "text", "path": str(tmp_path / "topic")}
    topics.publish_task_events(sent, target, checkpoint=str(tmp_path / "progress"), available_now=True).awaitTermination(120)
    rows = topics.read_task_events(spark, target, streaming=False).collect()
    assert [(r.task_id, r.event, r.detail, r.corrupt) for r in rows] == [("a", "COMPLETED", "", None)]
    assert topics.read_task_events(spark, target).isStreaming


@pytest.mark.parametrize("reader", [topics.read_task_messages, topics.read_dead_letters])
def test_bad_records_are_kept_apart(spark, tmp_path, reader):
    path = str(tmp_path / "topic")
    spark.createDataFrame([('{"taskId":"t","timestamp":1000}',), ("junk",)], "value string").coalesce(1).write.text(path)
    rows = {r.task_id: r.corrupt for r in reader(spark, {"format": "text", "path": path}, streaming=False).collect()}
    assert rows == {"t": None, None: "junk"}
    assert len(s.TASK_MESSAGE) == 10
