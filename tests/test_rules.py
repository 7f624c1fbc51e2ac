"""Hand tables for validation, column functions and fixed relations."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.functions import rules
from mediaops.operators import tasks, uploads, users

MIB = s.MIB
REQUEST = "file_name string, file_size long, file_hash string, chunk_size long, prompt string, metadata string"
GOOD = ("a.mp4", 10, None, 5 * MIB, None, None)


def _with(**changes):
    names = ["file_name", "file_size", "file_hash", "chunk_size", "prompt", "metadata"]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD))


UPLOAD_CASES = [
    (GOOD, 0, None),
    (_with(file_name=None), 10001, "file_name"),
    (_with(file_name=" \t"), 10001, "file_name"),
    (_with(file_name="n" * 251 + ".mp4"), 0, None),
    (_with(file_name="n" * 252 + ".mp4"), 10001, "file_name"),
    (_with(file_size=None), 10001, "file_size"),
    (_with(file_size=0), 10001, "file_size"),
    (_with(file_size=1), 0, None),
    (_with(file_size=s.MAX_FILE_SIZE), 0, None),
    (_with(file_size=s.MAX_FILE_SIZE + 1), 10001, "file_size"),
    (_with(file_hash="a" * 31), 10001, "file_hash"),
    (_with(file_hash="A" * 32), 0, None),
    (_with(file_hash="0" * 40), 0, None),
    (_with(file_hash="f" * 64), 0, None),
    (_with(file_hash="f" * 65), 10001, "file_hash"),
    (_with(file_hash="g" * 32), 10001, "file_hash"),
    (_with(chunk_size=MIB - 1), 10001, "chunk_size"),
    (_with(chunk_size=MIB), 0, None),
    (_with(chunk_size=50 * MIB), 0, None),
    (_with(chunk_size=50 * MIB + 1), 10001, "chunk_size"),
    (_with(chunk_size=None), 0, None),
    (_with(prompt="p" * 2000), 0, None),
    (_with(prompt="p" * 2001), 10001, "prompt"),
    (_with(metadata="m" * 4097), 10001, "metadata"),
    (_with(file_name="a.MOV"), 0, None),
    (_with(file_name="a.p4"), 20005, "file_name"),
    (_with(file_name="mp4"), 20005, "file_name"),
    (_with(file_name="dir.mp4/a"), 20005, "file_name"),
    (_with(file_name="a.", file_size=0), 10001, "file_size"),
]


def test_upload_rules(spark):
    df = spark.createDataFrame([(i, *row) for i, (row, _, _) in enumerate(UPLOAD_CASES)], "i int, " + REQUEST)
    got = {r.i: (r.code, r.field) for r in rules.judge(df, rules.upload_rules()).collect()}
    for i, (row, code, field) in enumerate(UPLOAD_CASES):
        assert got[i] == (code, field), row
    ok, rejects = rules.validate(df, rules.upload_rules())
    assert ok.count() + rejects.count() == len(UPLOAD_CASES)
    small = rules.judge(df.filter("i = 0"), rules.upload_rules(max_file_size=9)).first()
    assert (small.code, small.field) == (20006, "file_size")


def test_user_rules(spark):
    cases = [
        ("ab", "a@b", "123456", 0), ("a", "a@b", "123456", 10001), ("u" * 64, "a@b", "123456", 0),
        ("u" * 65, "a@b", "123456", 10001), ("a-b", "a@b", "123456", 10001), ("a_1", "ab", "123456", 10001),
        ("ab", "a@b", "12345", 10001), ("ab", "a@b", "p" * 32, 0), ("ab", "a@b", "p" * 33, 10001),
        ("ab", None, "123456", 10001), ("ab", "a@" + "b" * 127, "123456", 10001),
    ]
    df = spark.createDataFrame(cases, "username string, email string, password string, want int")
    for row in rules.judge(df, rules.user_rules()).collect():
        assert row.code == row.want, row


def test_mask_lengths(spark):
    df = spark.createDataFrame([("k" * 11,), ("abcdefgh1234",), ("abcdefgh-1234",), (None,)], "k string")
    got = [r[0] for r in df.select(fn.mask_key(F.col("k"))).collect()]
    assert got == ["***", "abcdefgh***1234", "abcdefgh***1234", "***"]


def test_object_path(spark):
    df = spark.createDataFrame(
        [("/bkt/videos/a.mp4",), ("/videos/a.mp4",), ("videos/a.mp4",), ("bkt/a",), (None,)], "p string"
    )
    got = [r[0] for r in df.select(fn.object_path(F.col("p"), "bkt")).collect()]
    assert got == ["videos/a.mp4", "videos/a.mp4", "videos/a.mp4", "bkt/a", ""]


def test_id_time_is_shanghai_midnight(spark):
    df = spark.createDataFrame([("upload_0_abcdef",), ("task_60_x",), ("other",)], "i string")
    got = [str(r[0]) if r[0] else None for r in df.select(fn.id_created_at(F.col("i")).cast("string")).collect()]
    assert got == ["2023-12-31 16:00:00", "2023-12-31 16:01:00", None]


@pytest.mark.parametrize("size,label", [
    (0, "0 B"), (1, "1.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1536, "1.5 KB"),
    (5 * MIB, "5.0 MB"), (3 * 1024 * MIB, "3.0 GB"), (None, None),
])
def test_size_labels(spark, size, label):
    row = spark.createDataFrame([(size,)], "n long").select(fn.size_label(F.col("n"))).first()
    assert row[0] == label


def test_summary_forms(spark):
    cases = [
        ('{"summary": "one"}', "one"), ('```json\n{"summary": "two"}\n```', "two"),
        ('{"summary": "cut off', '{"summary": "cut off'), ('{"summary": "three", "scenes": [', "three"),
        ("x" * 300, "x" * 200), ("", ""), (None, ""), ('{"summary": ""}', '{"summary": ""}'),
        ('{"summary": "say \\"hi\\""}', 'say "hi"'),
    ]
    df = spark.createDataFrame(cases, "text string, want string")
    for row in df.withColumn("got", fn.summary_of(F.col("text"))).collect():
        assert row.got == row.want


def test_sentiment_classes(spark):
    cases = [("正面", "positive"), ("Positive mood", "positive"), ("负面", "negative"), ("NEGATIVE", "negative"),
             ("中性", "neutral"), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "t string, want string")
    for row in df.withColumn("got", fn.sentiment_class(F.col("t"))).collect():
        assert row.got == row.want


def test_all_declared_moves(spark):
    """All 64 status pairs: the 12 declared moves and the 8 stays are legal."""
    legal = {(r.from_status, r.to_status) for r in s.declared_moves(spark).collect()}
    pairs = [(a, b) for a in s.TASK_STATUSES for b in s.TASK_STATUSES]
    assert sum(p in legal for p in pairs) == 20
    assert ("PENDING", "PROCESSING") not in legal and ("DEAD", "PENDING") not in legal
    assert ("PROCESSING", "CANCELLED") in legal and ("FAILED", "DEAD") in legal


def test_http_status_as_coded(spark):
    got = {r.code: r.http_status for r in s.error_codes(spark).collect()}
    assert got[40003] == 429 and got[40001] == 429 and got[30002] == 503
    assert got[23005] == 401 and got[23002] == 403 and got[20001] == 400


@pytest.mark.parametrize("page,size,want", [(0, 10, (1, 10)), (-3, 0, (1, 20)), (2, 50, (2, 50)), (1, 51, (1, 20))])
def test_page_bounds(page, size, want):
    assert tasks.page_bounds(page, size) == want


def test_progress_rounds_down_and_guards_zero(spark):
    sessions = spark.createDataFrame(
        [("a", 3, 0), ("b", 0, 0), ("c", None, None), ("d", 2, 2)], "upload_id string, total_chunks int, status int"
    )
    acks = spark.createDataFrame(
        [("a", 0), ("a", 0), ("a", 1), ("a", 3), ("a", -1), ("d", 1), ("d", 0), ("zz", 0)],
        "upload_id string, chunk_index int",
    )
    got = {r.upload_id: (r.done, r.progress, r.status_name) for r in uploads.upload_progress(acks, sessions).collect()}
    assert got == {"a": (2, 66, "UPLOADING"), "b": (0, 0, "UPLOADING"), "c": (0, 0, "UNKNOWN"), "d": (2, 100, "MERGED")}
    missing = {(r[0], r[1]) for r in uploads.missing_chunks(acks, sessions).collect()}
    assert missing == {("a", 2)}


def test_registration_order_inside_a_batch(spark):
    have = spark.createDataFrame([("old", "old@x", 1), ("gone", "gone@x", 0)], "username string, email string, status int")
    asks = spark.createDataFrame(
        [(1, "a", "1@x"), (2, "a", "2@x"), (3, "b", "1@x"), (4, "b", "3@x"), (5, "c", "3@x"), (6, "old", "9@x"),
         (7, "d", "old@x"), (8, "e", "gone@x"), (9, "b", "old@x"), (10, "c", "2@x")],
        "request_id int, username string, email string",
    )
    strict = {r.request_id: r.code for r in users.register_batch(asks, have).collect()}
    assert strict == {1: 0, 2: 23003, 3: 23004, 4: 0, 5: 23004, 6: 23003, 7: 23004, 8: 23004, 9: 23003, 10: 0}
    loose = {r.request_id: r.code for r in users.register_batch(asks, have, strict=False).collect()}
    assert loose == {**strict, 8: 0}


def test_chains_of_registrations_take_few_rounds(spark):
    """A chain of 1,000: every request shares its name with the one before and its mail with the one after."""
    rng = random.Random(9)
    chain = [(i, f"n{i // 2}", f"m{(i + 1) // 2}") for i in range(1000)]
    other = [(1000 + i, f"a{rng.randrange(40)}", f"b{rng.randrange(40)}") for i in range(300)]
    asks = spark.createDataFrame(chain + other, "request_id int, username string, email string")
    have = spark.createDataFrame([], "username string, email string, status int")
    began = time.monotonic()
    got = {r.request_id: r.code for r in users.register_batch(asks, have).collect()}
    assert time.monotonic() - began < 120
    names, mails, want = set(), set(), {}
    for i, name, mail in chain + other:
        want[i] = 23003 if name in names else 23004 if mail in mails else 0
        if not want[i]:
            names.add(name)
            mails.add(mail)
    assert got == want
