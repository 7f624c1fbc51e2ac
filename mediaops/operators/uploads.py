"""Upload sessions, chunk acknowledgements and repeated content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.functions.frames import touched

INSTANT, RESUME, NEW = "INSTANT", "RESUME", "NEW"


# ---- sessions ----

def valid_sessions(keys: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """Each key with code 0, 20001 (no such session) or 20002 (past its expiry)."""
    known = sessions.select("upload_id", "expired_at", F.lit(True).alias("_known"))
    return keys.join(known, "upload_id", "left").select(
        *[keys[c] for c in keys.columns],
        "expired_at",
        F.when(F.col("_known").isNull(), 20001)
        .when(F.col("expired_at") < as_of, 20002)
        .otherwise(s.OK)
        .alias("code"),
    )


def expire_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Sessions with those still uploading past their expiry set to expired, and when that was."""
    due = (F.col("status") == s.UPLOADING) & (F.col("expired_at") < as_of)
    return touched(sessions, due, as_of).withColumn(
        "status", F.when(due, s.EXPIRED).otherwise(F.col("status"))
    )


def chunk_plan(requests: DataFrame) -> DataFrame:
    """Chunk size in use, chunk count, bytes in the last chunk and expiry of each request."""
    size = F.col("file_size")
    chunk = F.coalesce(F.col("chunk_size"), F.lit(s.DEFAULT_CHUNK_SIZE))
    return (
        requests.withColumn("chunk_size", chunk)
        .withColumn("total_chunks", fn.chunk_count(size, F.col("chunk_size")))
        .withColumn("last_chunk_bytes", fn.last_chunk_bytes(size, F.col("chunk_size")))
        .withColumn("expired_at", F.col("created_at") + F.expr(f"INTERVAL {s.SESSION_HOURS} HOURS"))
    )


# ---- repeated content ----

def first_merged_per_hash(sessions: DataFrame) -> DataFrame:
    """The merged session each hash resolves to: the earliest, then the smallest id.

    An aggregate rather than a ranking window, so a hash with very many copies is reduced
    before the shuffle.
    """
    return _first_per_hash(sessions, s.MERGED)


def _first_per_hash(sessions: DataFrame, status: int) -> DataFrame:
    columns = [c for c in sessions.columns if c != "file_hash"]
    best = F.min_by(F.struct(*columns), F.struct("created_at", "upload_id"))
    return (
        sessions.filter((F.col("status") == status) & F.col("file_hash").isNotNull())
        .groupBy("file_hash").agg(best.alias("s"))
        .select("file_hash", "s.*")
    )


def match_uploads(requests: DataFrame, sessions: DataFrame, resume: bool = False) -> DataFrame:
    """Decision per request: INSTANT (same content already merged, whoever owns it), RESUME
    (same content still uploading; only if asked for) or NEW. If asked for, a RESUME row also
    says how to go on: the chunk size, the number of chunks and the chunks already there.

    Requests without a hash get a key of their own, so they spread instead of meeting in one
    partition.
    """
    key = F.coalesce("file_hash", F.concat(F.lit("none:"), F.col("request_id").cast("string")))

    def side(status: int, name: str) -> DataFrame:
        return _first_per_hash(sessions, status).select(
            F.col("file_hash").alias("_key"),
            F.col("upload_id").alias(f"{name}_upload"), F.col("user_id").alias(f"{name}_owner"),
            *([F.col(c).alias(f"open_{c}") for c in ("chunk_size", "total_chunks", "uploaded_chunks")] if name == "open" else []),
        )

    matched = requests.withColumn("_key", key).join(side(s.MERGED, "merged"), "_key", "left")
    upload, owner = F.col("merged_upload"), F.col("merged_owner")
    decision, plan = F.when(upload.isNotNull(), INSTANT), []
    if resume:
        matched = matched.join(side(s.UPLOADING, "open"), "_key", "left")
        decision = decision.when(F.col("open_upload").isNotNull(), RESUME)
        goes_on = upload.isNull() & F.col("open_upload").isNotNull()
        plan = [
            F.when(goes_on, F.col("open_chunk_size")).alias("resume_chunk_size"),
            F.when(goes_on, F.col("open_total_chunks")).alias("resume_total_chunks"),
            F.when(goes_on, fn.chunk_list(F.col("open_uploaded_chunks"))).alias("resume_chunks"),
        ]
        upload, owner = F.coalesce(upload, "open_upload"), F.coalesce(owner, "open_owner")
    return matched.select(
        *[requests[c] for c in requests.columns],
        decision.otherwise(NEW).alias("decision"),
        upload.alias("matched_upload_id"),
        owner.alias("owner_id"),
        *plan,
    )


def dedup_savings(sessions: DataFrame) -> DataFrame:
    """Per hash: copies, bytes declared, and bytes that reuse would save."""
    return (
        sessions.filter(F.col("file_hash").isNotNull())
        .groupBy("file_hash")
        .agg(
            F.count("*").alias("copies"),
            F.sum("total_size").alias("bytes"),
            (F.sum("total_size") - F.max("total_size")).alias("bytes_saved"),
        )
    )


# ---- chunks ----

def check_chunk_bounds(acks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Acknowledgements with code 0, 20001 (no session) or 20003 (index out of range)."""
    index = F.col("chunk_index")
    return acks.join(sessions.select("upload_id", "total_chunks"), "upload_id", "left").withColumn(
        "code",
        F.when(F.col("total_chunks").isNull(), 20001)
        .when((index < 0) | (index >= F.col("total_chunks")), 20003)
        .otherwise(s.OK),
    )


def uploaded_chunks(acks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session with the sorted set of its in-range chunk indices.

    Repeats are removed map-side before the shuffle, so a hot upload shrinks to at most its
    chunk count, which the size limits bound, before the indices meet in one set.
    """
    distinct = acks.filter(F.col("chunk_index") >= 0).select("upload_id", "chunk_index").distinct()
    sets = (
        distinct.join(sessions.select("upload_id", "total_chunks"), "upload_id")
        .filter(F.col("chunk_index") < F.col("total_chunks"))
        .groupBy("upload_id")
        .agg(F.sort_array(F.collect_set("chunk_index")).alias("chunks"))
    )
    return sessions.join(sets, "upload_id", "left").withColumn(
        "chunks", F.coalesce("chunks", F.array().cast("array<int>"))
    )


def upload_progress(acks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Chunks done, whole percent (rounded down) and status name per session."""
    return uploaded_chunks(acks, sessions).select(
        "upload_id", "total_chunks", "chunks",
        F.size("chunks").alias("done"),
        fn.percent(F.size("chunks"), F.col("total_chunks")).alias("progress"),
        F.coalesce(fn.lookup(s.UPLOAD_STATUS_NAMES, F.col("status")), F.lit("UNKNOWN")).alias(
            "status_name"
        ),
    )


def upload_completeness(acks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Complete flag, number of missing chunks, and code 20004 while any is missing."""
    missing = F.col("total_chunks") - F.size("chunks")
    return uploaded_chunks(acks, sessions).select(
        "upload_id", "total_chunks",
        missing.alias("missing"),
        (missing == 0).alias("complete"),
        F.when(missing == 0, s.OK).otherwise(20004).alias("code"),
    )


def missing_chunks(acks: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per chunk not yet uploaded."""
    every = F.when(
        F.col("total_chunks") > 0, F.sequence(F.lit(0), F.col("total_chunks") - 1)
    )
    return uploaded_chunks(acks, sessions).select(
        "upload_id", F.explode(F.array_except(every, "chunks")).alias("chunk_index")
    )


def compose_manifest(acks: DataFrame, sessions: DataFrame, day: Column) -> DataFrame:
    """Per complete upload: chunk paths in order and the path of the composed file."""
    return manifest_of(uploaded_chunks(acks, sessions), day)


def manifest_of(chunked: DataFrame, day: Column) -> DataFrame:
    """The same for sessions with their ``chunks``."""
    full = chunked.filter(
        (F.col("total_chunks") > 0) & (F.size("chunks") == F.col("total_chunks"))
    )
    return full.select(
        "upload_id",
        F.transform(
            F.sequence(F.lit(0), F.col("total_chunks") - 1),
            lambda i: fn.chunk_path(F.col("upload_id"), i),
        ).alias("chunk_paths"),
        fn.video_path(F.col("upload_id"), F.col("file_name"), day).alias("target_path"),
    )


def chunk_set_ops(sessions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Parses the JSON chunk list and adds ``chunk_index`` if absent, while the session is uploading. With ``as_of`` a
    session that gets a chunk gets its time of change too."""
    chunks, index = fn.chunk_list(F.col("uploaded_chunks")), F.col("chunk_index")
    added = F.when(F.col("status") == s.UPLOADING, fn.add_chunk(F.col("chunks"), index))
    done = (
        sessions.withColumn("chunks", chunks)
        .withColumn("already", F.array_contains("chunks", index))
        .withColumn("chunks_after", F.coalesce(added, F.col("chunks")))
        .withColumn("count_after", F.size("chunks_after"))
    )
    return done if as_of is None else touched(done, F.col("count_after") > F.size("chunks"), as_of)


def session_status_update(
    sessions: DataFrame, acks: DataFrame, merges: DataFrame, as_of: Column
) -> DataFrame:
    """``complete_sessions`` with the chunks that the acknowledgements give."""
    return complete_sessions(uploaded_chunks(acks, sessions), merges, as_of)


def complete_sessions(chunked: DataFrame, merges: DataFrame, as_of: Column) -> DataFrame:
    """Outcome of completing each session in ``merges(upload_id, merged_path, failed)``.

    Only a live session still uploading may complete, and only with every chunk present; it
    then ends merged with its path, or merge-failed. Without a merge row a complete session
    waits as uploaded. Other sessions keep their state and get the code the caller would see.
    ``chunked``: the sessions with ``chunks``, as ``uploaded_chunks`` gives them. ``updated_at`` is set where the status or
    the path changes.
    """
    state = chunked.join(merges, "upload_id", "left")
    full = F.size("chunks") == F.col("total_chunks")
    code = (
        F.when(F.col("expired_at") < as_of, 20002)
        .when(F.col("status") != s.UPLOADING, 20001)
        .when(~full, 20004)
        .when(F.coalesce("failed", F.lit(False)), 20009)
        .otherwise(s.OK)
    )
    merged = F.col("code").isin(s.OK) & F.col("merged_path").isNotNull()
    return touched(
        state.withColumn("code", code)
        .withColumn(
            "new_status",
            F.when(F.col("code") == 20009, s.MERGE_FAILED)
            .when(merged, s.MERGED)
            .when(F.col("code") == s.OK, s.UPLOADED)
            .otherwise(F.col("status").cast("int")),
        )
        .withColumn("storage_path", F.when(merged, F.col("merged_path")).otherwise(F.col("storage_path"))),
        F.col("code").isin(s.OK, 20009), as_of,
    ).select("upload_id", "status", "code", "new_status", "storage_path", "updated_at")


# ---- objects ----

def parse_objects(objects: DataFrame, bucket: str) -> DataFrame:
    """Object rows with kind, upload id, chunk index and date read from the path."""
    path = fn.object_path(F.col("path"), bucket)
    chunk = r"(?:^|/)chunks/([^/]+)/chunk_(\d+)$"
    video = r"(?:^|/)videos/(\d{4})/(\d{2})/(\d{2})/([^/]+)\.[^./]*$"
    p = F.col("object_path")

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(p, pattern, group), F.lit(""))

    return (
        objects.withColumn("object_path", path)
        .withColumn("kind", F.when(p.rlike(chunk), "chunk").when(p.rlike(video), "video").otherwise("other"))
        .withColumn("upload_id", F.coalesce(part(chunk, 1), part(video, 4)))
        .withColumn("chunk_index", part(chunk, 2).cast("int"))
        .withColumn(
            "day", F.concat_ws("-", part(video, 1), part(video, 2), part(video, 3))
        )
        .withColumn("day", F.nullif(F.col("day"), F.lit("")))
    )


def orphan_chunks(objects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Chunk objects whose session is expired or merged: safe to clean up."""
    done = sessions.filter(F.col("status").isin(s.EXPIRED, s.MERGED)).select("upload_id")
    return objects.filter(F.col("kind") == "chunk").join(done, "upload_id", "left_semi")


def daily_ingest_volume(sessions: DataFrame) -> DataFrame:
    """Files and bytes per day, the day taken from the storage path."""
    day = F.concat_ws(
        "-", *[F.regexp_extract("storage_path", r"^videos/(\d{4})/(\d{2})/(\d{2})/", i) for i in (1, 2, 3)]
    )
    return (
        sessions.filter(F.col("storage_path").rlike(r"^videos/\d{4}/\d{2}/\d{2}/"))
        .groupBy(day.alias("day"))
        .agg(F.count("*").alias("files"), F.sum("total_size").alias("bytes"))
    )


def daily_stats(**streams: tuple[DataFrame, str]) -> DataFrame:
    """Named daily counters: each stat is (rows, time column), rows without a time excluded."""
    parts = [
        df.filter(F.col(ts).isNotNull()).select(
            F.to_date(ts).cast("string").alias("day"), F.lit(name).alias("stat")
        )
        for name, (df, ts) in streams.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("day", "stat").agg(F.count("*").alias("n"))


# ---- submit ----

def submit_tasks(
    requests: DataFrame, sessions: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """(new pending tasks, requests rejected with 20001).

    The task belongs to the session's owner, whoever asked; both ids are kept.
    """
    ready = sessions.filter(F.length("storage_path") > 0)
    tasks = (
        requests.join(
            ready.select("upload_id", F.col("user_id").alias("owner_id"), "storage_path"),
            "upload_id",
        )
        .select(
            F.concat(F.lit("task_"), F.col("request_id").cast("string")).alias("task_id"),
            "upload_id",
            F.col("owner_id").alias("user_id"),
            F.col("user_id").alias("requested_by"),
            F.col("storage_path").alias("video_url"),
            "prompt",
            F.lit("PENDING").alias("status"),
            F.lit(0).alias("progress"),
            F.lit(0).alias("retry_count"),
            F.lit(s.DEFAULT_MAX_RETRY).alias("max_retry"),
            as_of.alias("created_at"),
        )
    )
    rejects = requests.join(ready.select("upload_id"), "upload_id", "left_anti").withColumn(
        "code", F.lit(20001)
    )
    return tasks, rejects
