"""Order-dependent jobs against plain loops, with the large-group paths forced as well."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.operators import commands, costs, events, limits, ordered, quotas
from mediaops.operators.tasks import percentiles

T0 = datetime.datetime(2024, 1, 30, 20, 0, 0)


def _at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


# ---- commands ----

COMMAND = (
    "seq long, task_id string, ts timestamp_ntz, command string, actor_id long, old_status string, new_status string, "
    "progress int, error_message string, task_name string, result string, summary string, frame_count int, tokens_used long"
)


def _command(seq, task, minute, kind, actor=1, old=None, new=None):
    return (seq, task, _at(minute), kind, actor, old, new, seq % 100, f"e{seq}" * 200, f"n{seq}", f"r{seq}", f"s{seq}", 0, seq)


def _tasks(spark, rows):
    slim = spark.createDataFrame(rows, "task_id string, user_id long, status string, retry_count int")
    have = set(slim.columns)
    return slim.select(*[
        F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in s.ANALYSIS_TASK.fields
    ])


def _replay(tasks, rows):
    """The same rules one command at a time."""
    state, out = {t: {"status": st_, "retry": r, "owner": o} for t, o, st_, r in tasks}, {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        seq, task, _, kind, actor, old, new = row[:7]
        if task not in state:
            out[seq] = (None, None, 0)
            continue
        me = state[task]
        before, mine = me["status"], actor == me["owner"]
        ok = {
            "compare_and_set": before is not None and before == old,
            "start": before in ("QUEUED", "RETRYING"),
            "rename": mine,
            "manual_retry": mine and before in ("FAILED", "DEAD"),
            "delete": mine and before in ("COMPLETED", "DEAD", "CANCELLED"),
        }.get(kind, True)
        if ok:
            target = {"compare_and_set": new, "start": "PROCESSING", "complete": "COMPLETED", "fail": "FAILED",
                      "auto_retry": "RETRYING", "mark_dead": "DEAD", "manual_retry": "PENDING", "delete": "CANCELLED"}
            me["status"] = target.get(kind, before)
            if kind == "auto_retry" and me["retry"] is not None:
                me["retry"] += 1
            if kind == "manual_retry":
                me["retry"] = 0
        out[seq] = (before, me["status"], int(ok))
    return out, state


def test_every_guard_from_every_status(spark):
    tasks, rows = [], []
    for kind in commands.COMMANDS:
        for status in (*s.TASK_STATUSES, None):
            for actor in (1, 2):
                task = f"{kind}-{status}-{actor}"
                tasks.append((task, 1, status, 1))
                rows.append(_command(len(rows), task, 0, kind, actor, "FAILED", "QUEUED"))
    want, state = _replay(tasks, rows)
    frame = spark.createDataFrame(rows, COMMAND)
    after, outcomes = commands.apply_commands(_tasks(spark, tasks), frame)
    got = {r.seq: (r.status_before, r.status_after, r.applied) for r in outcomes.collect()}
    assert got == want
    final = {r.task_id: r for r in after.collect()}
    for task, me in state.items():
        assert (final[task].status, final[task].retry_count) == (me["status"], me["retry"]), task
    assert len(final["fail-QUEUED-1"].error_message) == 500
    assert final["complete-QUEUED-1"].progress == 100 and final["start-QUEUED-1"].started_at == T0
    assert final["manual_retry-DEAD-1"].progress == 0 and final["rename-DEAD-1"].task_name.startswith("n")


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**7])
def test_hot_task_over_slices(spark, slice_seconds):
    rng = random.Random(7)
    tasks = [("hot", 1, "PENDING", 0), ("cold", 2, "FAILED", None)]
    rows = [
        _command(i, "hot" if rng.random() < 0.8 else rng.choice(["cold", "lost"]), rng.randrange(600),
                 rng.choice(commands.COMMANDS), rng.choice([1, 1, 2]), rng.choice(s.TASK_STATUSES), rng.choice(s.TASK_STATUSES))
        for i in range(400)
    ]
    want, state = _replay(tasks, rows)
    frame = spark.createDataFrame(rows, COMMAND)
    after, outcomes = commands.apply_commands(_tasks(spark, tasks), frame, slice_seconds=slice_seconds)
    assert {r.seq: (r.status_before, r.status_after, r.applied) for r in outcomes.collect()} == want
    assert {r.task_id: (r.status, r.retry_count) for r in after.collect()} == {
        t: (me["status"], me["retry"]) for t, me in state.items()
    }


def test_commands_without_a_task_or_a_time_and_of_unknown_kinds(spark):
    tasks = [("a", None, "FAILED", 0), ("b", 1, "odd", 0)]
    rows = [_command(1, None, 0, "start"), _command(2, "a", 1, "nonsense"), _command(3, "a", 2, "manual_retry", None),
            _command(4, "b", 0, "compare_and_set", 1, None, "QUEUED"), _command(5, "b", 1, "compare_and_set", 1, "odd", "QUEUED"),
            _command(6, "a", 3, "compare_and_set", 1, "PENDING", "odd"), (7, "b", None, *_command(7, "b", 0, "complete")[3:])]
    _, outcomes = commands.apply_commands(_tasks(spark, tasks), spark.createDataFrame(rows, COMMAND))
    got = {r.seq: (r.status_before, r.status_after, r.applied) for r in outcomes.collect()}
    assert got == {1: (None, None, 0), 2: ("FAILED", "FAILED", 1), 3: ("FAILED", "PENDING", 1), 4: ("COMPLETED", "COMPLETED", 0),
                   5: ("COMPLETED", "COMPLETED", 0), 6: ("PENDING", None, 1), 7: (None, "COMPLETED", 1)}


def test_no_command_leaves_tasks_alone(spark):
    tasks = _tasks(spark, [("a", 1, "PENDING", 0)])
    after, _ = commands.apply_commands(tasks, spark.createDataFrame([], COMMAND))
    assert after.collect() == tasks.collect()


# ---- rates ----

def _anchored(rows, width):
    out, opened, place = {}, {}, {}
    for req, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in opened or at - opened[key] >= width:
            opened[key], place[key] = at, 0
        place[key] += 1
        out[req] = (opened[key], place[key])
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 400)), min_size=1, max_size=120))
def test_anchored_windows(spark, marks):
    rows = [(i, key, T0 + datetime.timedelta(milliseconds=250 * at)) for i, (key, at) in enumerate(marks)]
    want = _anchored(rows, datetime.timedelta(seconds=1))
    frame = spark.createDataFrame(rows, "req_id long, api_key string, ts timestamp_ntz")
    for slice_seconds in (4, 64):
        done = limits.rate_anchored(frame, "api_key", limit=2, seconds=1, slice_seconds=slice_seconds)
        assert {r.req_id: (r.window_start, r.place) for r in done.collect()} == want


def test_trailing_count_and_positions(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaab"), T0 + datetime.timedelta(seconds=rng.randrange(9000))) for i in range(300)]
    frame = spark.createDataFrame(rows, "req_id long, k string, ts timestamp_ntz")
    hour = datetime.timedelta(seconds=1800)
    got = {r.req_id: r.n for r in ordered.trailing_count(frame, ["k"], "ts", 1800, "n", slice_seconds=60).collect()}
    for i, k, t in rows:
        assert got[i] == sum(1 for _, k2, t2 in rows if k2 == k and t - hour < t2 <= t)
    sliced = ordered.with_slice(frame, "ts", 600)
    place = {r.req_id: r.p for r in ordered.row_position(sliced, ["k"], ["ts", "req_id"], "p").collect()}
    for i, k, t in rows:
        assert place[i] == sum(1 for i2, k2, t2 in rows if k2 == k and (t2, i2) <= (t, i))


def test_failure_streaks(spark):
    marks = [("m", x) for x in (2, 2, 1, 2, 2, 2, 1, 2)] + [("n", 2)] * 4
    rows = [(i, model, status, _at(i * 40)) for i, (model, status) in enumerate(marks)]
    frame = spark.createDataFrame(rows, "id long, model string, status int, created_at timestamp_ntz")
    got = sorted((r.model, r.length, r.first_at) for r in costs.failure_streaks(frame, 3).collect())
    assert got == [("m", 3, _at(120)), ("n", 4, _at(320))]


@pytest.mark.parametrize("slice_seconds", [60, 600, 10**6])
def test_failure_streaks_over_slices(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    rows = [(i, rng.choice(["m", "m", None]), rng.choice([2, 2, 2, 1, None]), None if rng.random() < 0.02 else _at(rng.randrange(300))) for i in range(400)]
    want, run = [], []
    for model in ("m", None):
        own = sorted((r for r in rows if r[1] == model), key=lambda r: (r[3] is not None, r[3] or T0, r[0]))
        for r in [*own, (0, model, 1, None)]:
            if r[2] == 2:
                run.append(r)
            elif run:
                want.append((model, len(run), run[0][3], run[-1][3]))
                run = []
    frame = spark.createDataFrame(rows, "id long, model string, status int, created_at timestamp_ntz")
    got = costs.failure_streaks(frame, 2, slice_seconds).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (w for w in want if w[1] >= 2)))
    assert costs.failure_streaks(frame.limit(0)).collect() == []


def test_percentiles_by_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abb"), rng.choice([None, *range(-50, 5000, 7)])) for _ in range(600)] + [("one", 5), ("none", None)]
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", bucket=100).collect()}
    for k in "ab":
        own = [v for name, v in rows if name == k and v is not None]
        assert abs(got[k].p50 - np.percentile(own, 50)) < 1e-9 and abs(got[k].p95 - np.percentile(own, 95)) < 1e-9
        assert (got[k].max, got[k].n) == (max(own), len(own))
    assert tuple(got["one"])[1:] == (5, 5, 5, 1) and tuple(got["none"])[1:] == (None, None, None, 0)


def test_percentiles_that_occur_on_many_values(spark):
    """A sketch of accuracy 10,000 may be off by 30 ranks here."""
    rows = spark.range(0, 300_001, 1, 8).select((F.col("id") * 7919 % 300_001).alias("v"), F.lit(None).cast("string").alias("k"))
    few = spark.createDataFrame([(v, "few") for v in (3, 1, 2, 4)], "v long, k string")
    got = {r.k: tuple(r)[1:] for r in percentiles(rows.unionByName(few), ["k"], "v", exact=False).collect()}
    assert got == {None: (150_000, 285_000, 300_000, 300_001), "few": (2, 4, 4, 4)}


def test_lineage_keeps_links_without_an_id(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, username string")
    uploads = spark.createDataFrame([(1, "u1", "f"), (1, None, "g"), (None, "u3", "h")], "user_id long, upload_id string, file_name string")
    tasks = spark.createDataFrame([("u1", "t1", "DEAD"), ("u1", None, "FAILED"), (None, "t3", "DEAD")], "upload_id string, task_id string, status string")
    calls = spark.createDataFrame([("t1", 1, "m", 5), (None, 2, "m", 6)], "task_id string, id long, model string, total_tokens long")
    got = {tuple(r) for r in costs.task_lineage(users, uploads, tasks, calls).collect()}
    assert got == {(1, "a", "u1", "f", "t1", "DEAD", 1, "m", 5), (1, "a", "u1", "f", None, "FAILED", None, None, None),
                   (1, "a", None, "g", None, None, None, None, None), (2, "b", None, None, None, None, None, None, None)}


def test_audit_and_dwell_across_slices(spark):
    path = ["PENDING", "QUEUED", "PROCESSING", "FAILED", "FAILED", "COMPLETED"]
    rows = [(i, "t", _at(i * 50), status) for i, status in enumerate(path)]
    frame = spark.createDataFrame(rows, "seq long, task_id string, ts timestamp_ntz, status string")
    audit = {r.seq: (r.from_status, r.legal) for r in events.transition_audit(frame).collect()}
    assert audit == {i: (path[i - 1] if i else None, i != 5) for i in range(6)}
    dwell = {r.seq: r.dwell_ms for r in events.state_dwell(frame).collect()}
    assert dwell == {**{i: 3_000_000 for i in range(5)}, 5: None}


# ---- quotas ----

def _quota(rows, daily, monthly):
    out, used_d, used_m = {}, {}, {}
    for i, user, tokens, at in sorted(rows, key=lambda r: (r[3], r[0])):
        d, m = (user, at.date()), (user, at.year, at.month)
        ok = tokens <= daily - used_d.get(d, 0) and tokens <= monthly - used_m.get(m, 0)
        if ok:
            used_d[d], used_m[m] = used_d.get(d, 0) + tokens, used_m.get(m, 0) + tokens
        out[i] = ok
    return out


@pytest.mark.parametrize("daily,monthly,most", [(20, 45, 12), (7, 1000, 9), (50, 30, 40)])
def test_quota_replay_both_ways(spark, daily, monthly, most):
    rng = random.Random(daily)
    rows = [
        (i, rng.choice([1, 1, 1, 2]), rng.choice([0, *range(1, most)]), _at(rng.randrange(5 * 1440)))
        for i in range(250)
    ]
    want = _quota(rows, daily, monthly)
    calls = spark.createDataFrame(rows, "id long, user_id long, total_tokens long, created_at timestamp_ntz")
    limits_ = spark.createDataFrame([(u, daily, monthly) for u in (1, 2)], "user_id long, quota_daily long, quota_monthly long")
    for slice_seconds in (600, 10**6):
        got = quotas.quota_replay(calls, limits_, slice_seconds).collect()
        assert {r.id: r.accepted for r in got} == want and all(r.accepted == (r.code == 0) for r in got)


def test_quota_replay_of_corrections_and_calls_without_a_user(spark):
    """Negative tokens give quota back, whatever the size of the group; calls without a user are one user."""
    kind = "id long, user_id long, total_tokens long, created_at timestamp_ntz"
    rng = random.Random(5)
    rows = [(i, rng.choice([None, None, 1, 2]), rng.choice([-40, -9, -3, 0, *range(1, 30)]), _at(rng.randrange(4 * 1440)))
            for i in range(400)]
    for daily, monthly in ((50, 90), (7, 1000), (60, 40)):
        limits_ = spark.createDataFrame([(u, daily, monthly) for u in (1, 2)], "user_id long, quota_daily long, quota_monthly long")
        want = _quota([r for r in rows if r[1]], daily, monthly) | _quota([r for r in rows if not r[1]], 500, 10_000)
        for slice_seconds in (600, 10**6):
            got = quotas.quota_replay(spark.createDataFrame(rows, kind), limits_, slice_seconds).collect()
            assert {r.id: r.accepted for r in got} == want and len(got) == len(rows)
    few = spark.createDataFrame([(1, 1, 400, _at(0)), (2, 1, -300, _at(1)), (3, 1, 350, _at(2))], kind)
    assert all(r.accepted for r in quotas.quota_replay(few).collect())
    over = [(1, 7, 400, _at(0)), (2, 7, 200, _at(1)), (3, 7, None, _at(2)), (4, 7, 100, _at(3))] + [(10 + d, 7, 500, _at(1440 * d)) for d in range(2, 24)]
    codes = {r.id: r.code for r in quotas.quota_replay(spark.createDataFrame(over, kind)).collect()}
    assert codes[1] == codes[4] == 0 and codes[2] == 22002 and codes[3] == 22001
    assert 22003 in {r.code for r in quotas.quota_replay(spark.createDataFrame(over, kind), spark.createDataFrame([(7, 500, 700)], "user_id long, quota_daily long, quota_monthly long")).collect()}
    odd = [(1, None, 300, None), (2, None, 300, None), (3, 1, 500, None), (4, 1, 1, _at(0)), (5, 1, 600, _at(0))]
    assert {r.id: r.accepted for r in quotas.quota_replay(spark.createDataFrame(odd, kind)).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_quota_edges(spark):
    calls = spark.createDataFrame(
        [(1, 9, 500, _at(0)), (2, 9, 1, _at(1)), (3, 9, 0, _at(2)), (4, 9, None, _at(3))],
        "id long, user_id long, total_tokens long, created_at timestamp_ntz",
    )
    assert {r.id: r.accepted for r in quotas.quota_replay(calls).collect()} == {1: True, 2: False, 3: True, 4: False}
    held = spark.createDataFrame(
        [(1, 10, 10, 5, 0), (2, 10, None, 5, None), (3, 10, 4, 5, 0), (4, None, 1, None, 1)],
        "user_id int, quota_monthly long, used_monthly long, quota_daily long, used_daily long",
    )
    got = {r.user_id: (r.remaining_daily, r.remaining_monthly, r.enough)
           for r in quotas.quota_remaining(held, F.lit(5)).collect()}
    assert got == {1: (5, 0, False), 2: (5, 10, True), 3: (5, 6, True), 4: (None, None, False)}
