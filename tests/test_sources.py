"""Objects, tables and plans."""

import hashlib
import os
import struct
import time

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from harness.check import TABLES, compare
from mediaops import schemas as s
from mediaops.operators import costs, limits, results, tasks, uploads
from mediaops.session import scratch
from mediaops.sources import objects, tables

SF = "/root/testdata/sf0.001"


def _fingerprint(data, sample):
    n = min(sample, len(data))
    parts = [data[:n]]
    if len(data) > 2 * n:
        mid = (len(data) - n) // 2
        parts.append(data[mid:mid + n])
    if len(data) > n:
        parts.append(data[-n:])
    return hashlib.sha256(b"".join(parts) + struct.pack("<d", float(len(data)))).hexdigest()


def test_fingerprint_samples(spark, tmp_path):
    sizes = [1, 99, 100, 101, 150, 200, 201, 250, 1000]
    data = {f"chunks/u{n}/chunk_0": os.urandom(n) for n in sizes}
    for name, content in data.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    listed = objects.list_objects(spark, str(tmp_path), "bkt")
    got = {r.path: (r.length, r.fingerprint) for r in objects.content_fingerprint(listed, sample=100).collect()}
    assert got == {name: (len(c), _fingerprint(c, 100)) for name, c in data.items()}
    full = {r.path: r.fingerprint for r in objects.content_fingerprint(listed).collect()}
    assert full == {name: _fingerprint(c, s.SAMPLE_SIZE) for name, c in data.items()}


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "videos/2024/02/03").mkdir(parents=True)
    (tmp_path / "videos/2024/02/03/upload_1_a.mp4").write_bytes(b"x" * 9)
    (tmp_path / "note.txt").write_bytes(b"y")
    listed = objects.list_objects(spark, str(tmp_path), "bkt")
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in _plan(listed)
    got = {r.kind: (r.path, r.length, r.upload_id, r.chunk_index, r.day) for r in listed.collect()}
    assert got == {
        "video": ("videos/2024/02/03/upload_1_a.mp4", 9, "upload_1_a", None, "2024-02-03"),
        "other": ("note.txt", 1, None, None, None),
    }


def test_a_listing_takes_few_tasks(spark, tmp_path):
    """300 directories of one file, and files that are larger than a split's bytes."""
    names = [f"chunks/u{i}/chunk_{i % 3}" for i in range(300)] + [f"videos/2024/02/03/upload_{i}_a.mp4" for i in range(3)]
    for name in names:
        (tmp_path / "store" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "store" / name).write_bytes(b"x")
    for name in names[300:]:
        os.truncate(tmp_path / "store" / name, 1 << 30)  # sparse
    kept, tracker = spark.conf.get("spark.sql.files.openCostInBytes"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    listed = objects.listing_table(spark, str(tmp_path / "store"), "bkt")
    spark.sparkContext.setJobGroup("other", "other")
    stages = [tracker.getStageInfo(i) for job in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(job).stageIds]
    assert stages and max(stage.numTasks for stage in stages) <= 64
    assert spark.conf.get("spark.sql.files.openCostInBytes") == kept and spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    assert sorted(r.path for r in listed.collect()) == sorted(names)


def test_fingerprints_are_taken_from_a_kept_listing(spark):
    plan = _plan(queries()["content_fingerprint"](spark, SF))
    assert "FileScan parquet" in plan and "FileScan binaryFile" not in plan


def test_a_kept_listing_has_paths_below_any_root_and_objects_without_content(spark, tmp_path):
    sizes = {"chunks/u1/chunk_0": 5, "chunks/u2/chunk_1": 0, "videos/2024/02/03/upload_1_a.mp4": 0, "note.txt": 3}
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file://{tmp_path}/", f"file:{tmp_path}"):
        listed = objects.listing_table(spark, root, "bkt")
        assert {r.path: r.length for r in listed.collect()} == sizes
        assert listed.where("modified_at > '2024-01-01'").count() == len(sizes)
        got = {r.path: r.fingerprint for r in objects.content_fingerprint(listed).collect()}
        assert got == {name: _fingerprint(b"x" * size, s.SAMPLE_SIZE) for name, size in sizes.items()}
    assert [r.path for r in objects.listing_table(spark, str(tmp_path), "bkt", "*.txt").collect()] == ["note.txt"]
    (tmp_path / "none").mkdir()
    assert objects.listing_table(spark, str(tmp_path / "none"), "bkt").count() == 0


def _differs_with_empty_documents(spark, folder, monkeypatch, key):
    """From the SQL, with a shared folder that is named by a URI and every 50th document without text."""
    for name in TABLES:
        if name != "documents":
            (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    duckdb.sql(f"SELECT * REPLACE (CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END AS text) FROM '{SF}/documents.parquet'").write_parquet(
        str(folder / "documents.parquet"))
    job = queries()[key]
    monkeypatch.setattr("harness.catalog.sources.scratch", lambda spark, name: f"file://{scratch(spark, name)}")
    return compare(job(spark, str(folder)), str(folder), oracle_sql()[key])


def test_fingerprints_in_a_shared_folder_with_a_scheme(spark, tmp_path, monkeypatch):
    assert _differs_with_empty_documents(spark, tmp_path, monkeypatch, "content_fingerprint") is None


def test_a_listing_in_a_shared_folder_with_a_scheme(spark, tmp_path, monkeypatch):
    assert _differs_with_empty_documents(spark, tmp_path, monkeypatch, "src_object_listing") is None


def test_listed_paths_are_below_any_root(spark, tmp_path):
    path = tmp_path / "tmp/store/chunks/u1/chunk_0"
    path.parent.mkdir(parents=True)
    path.write_bytes(b"x")
    root = f"{tmp_path}/tmp/store"
    for given in (root, f"{root}/", f"file:{root}", f"file://{root}", f"file://{root}/", f"file://{tmp_path}//tmp/store"):
        assert [r.path for r in objects.list_objects(spark, given, "bkt").collect()] == ["chunks/u1/chunk_0"]


def test_tables_round_trip(spark, tmp_path):
    for name, schema in s.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    loaded = tables.load_tables(spark, str(tmp_path))
    assert {n: df.schema.simpleString() for n, df in loaded.items()} == {
        n: schema.simpleString() for n, schema in s.TABLES.items()
    }


def test_by_date_layout_prunes(spark, tmp_path):
    rows = spark.range(40).select("id", F.expr("TIMESTAMP_NTZ '2024-01-30' + make_interval(0,0,0,CAST(id % 4 AS INT))").alias("ts"))
    tables.write_by_date(rows, str(tmp_path / "t"), "ts")
    day = spark.read.parquet(str(tmp_path / "t")).filter("year = 2024 AND month = 2 AND day = 1")
    assert day.count() == 10
    assert "PartitionFilters: [isnotnull(year" in day._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_key_lookup_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("task_id"), "o_orderstatus")
    plan = _plan(orders.filter("task_id = 7"))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_no_job_multiplies_rows_in_a_cross_join(spark):
    skip = ("st_", "snk_", "src_", "flow_", "quota_replay", "rate_user_anchored", "apply_commands", "register_batch",
            "content_fingerprint")
    for key, job in queries().items():
        if not key.startswith(skip):
            plan = _plan(job(spark, SF))
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
            assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key


def test_narrow_jobs_read_few_columns(spark):
    progress = _plan(queries()["upload_progress"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in progress
    savings = _plan(queries()["dedup_savings"](spark, SF))
    assert "partial_count" in savings.replace(" ", "") or "partial_count(1)" in savings


def test_per_user_pages_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).select(
        (F.col("id") % 3).alias("user_id"), F.col("id").cast("string").alias("task_id"), F.lit("DEAD").alias("status"),
        F.timestamp_seconds("id").alias("created_at"),
    )
    assert "WindowGroupLimit" in _plan(tasks.list_all_users_tasks(rows, 1, 5))


def test_hot_keys_are_cut_into_slices(spark):
    calls = spark.range(2000).select(
        "id", F.lit("one").alias("model"), F.lit(2).alias("status"),
        F.expr("TIMESTAMP_NTZ '2024-01-01' + make_interval(0,0,0,0,0,CAST(id AS INT))").alias("created_at"),
    )
    numbered = costs.failure_streaks(calls.withColumn("model", F.concat("model", F.col("id") % 1)))
    assert "_slice" in _plan(numbered)
    requests = calls.select(F.col("id").alias("req_id"), "model", F.col("created_at").alias("ts"))
    done = limits.rate_aligned(requests, ["model"], limit=50, seconds=3600)
    assert done.filter("allowed").count() == 33 * 50 + 20


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([("a", "X", None, None)], "task_id string, status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    changes = spark.createDataFrame([("a", "Y", 1), ("a", "Z", 2), ("b", "W", 1)], "task_id string, status string, version int")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    once = tasks.upsert_snapshot(base, changes, ["task_id"], now)
    twice = tasks.upsert_snapshot(once, changes, ["task_id"], now)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.task_id: r.status for r in once.collect()} == {"a": "Z", "b": "W"}


def test_client_is_asked_again_after_refusals_only(spark):
    class Client:
        def __call__(self, url, prompt):
            if url == "limit":
                return results.Answer(429)
            if url == "told":
                return results.Answer(503, "rate limit reached")
            if url == "raises":
                raise ValueError("rate limit reached")
            if url == "broken":
                return results.Answer(500)
            return results.Answer(200, None, prompt)

    rows = spark.createDataFrame([(u, u, p) for u, p in (("limit", None), ("told", "p"), ("raises", "p"), ("broken", "p"), ("fine", " "))],
                                 "task_id string, video_url string, prompt string")
    got = {r.task_id: (r.ok, r.attempts, r.result) for r in results.enrich_with_retry(rows, Client(), delays=(0, 0, 0)).collect()}
    assert got == {"limit": (False, 4, None), "told": (False, 4, None), "raises": (False, 4, None), "broken": (False, 1, None), "fine": (True, 1, s.DEFAULT_PROMPT)}
    assert results.is_rate_limit(429, None) and results.is_rate_limit(500, "rate limit") and not results.is_rate_limit(500, None)


def test_refused_tasks_wait_together_and_calls_keep_a_rate(spark):
    class Client:
        def __init__(self):
            self.seen = {}

        def __call__(self, url, prompt):
            self.seen[url] = self.seen.get(url, 0) + 1
            return results.Answer(429) if self.seen[url] < 3 else results.Answer(200, None, url)

    rows = spark.createDataFrame([(str(i), str(i), "p") for i in range(60)], "task_id string, video_url string, prompt string")
    began = time.monotonic()
    got = results.enrich_with_retry(rows, Client(), delays=(1, 1), parallelism=1).collect()
    assert len(got) == 60 and all(r.ok and r.attempts == 3 for r in got) and time.monotonic() - began < 30  # one by one: 120 s
    began = time.monotonic()
    assert len(results.enrich_with_retry(rows.limit(10), Client(), delays=(0, 0), parallelism=2, calls_per_second=20).collect()) == 10
    assert time.monotonic() - began > 0.8


def test_first_copy_ties_break_by_id(spark):
    rows = [("b", "h", 2), ("a", "h", 2), ("c", "h", 0)]
    sessions = spark.createDataFrame(rows, "upload_id string, file_hash string, status int").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp_ntz")
    ).withColumn("user_id", F.lit(1))
    assert [r.upload_id for r in uploads.first_merged_per_hash(sessions).collect()] == ["a"]
