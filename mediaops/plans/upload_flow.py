"""Upload requests to sessions, and finished sessions to merged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.functions import rules
from mediaops.operators import uploads
from mediaops.session import materialise


def init_uploads(
    requests: DataFrame, sessions: DataFrame, resume: bool = False, checks: list[rules.Rule] | None = None
) -> DataFrame:
    """The answer to every upload request: code and field if refused, else the decision, for new
    uploads the chunk plan, for resumed ones that of the session with the chunks it has. One pass
    over the requests.

    A refused request is matched under no hash, so it costs the join nothing.
    """
    judged = rules.judge(requests, checks or rules.upload_rules())
    accepted = F.col("code") == s.OK
    hashed = judged.withColumn("file_hash", F.when(accepted, F.col("file_hash")))
    matched = uploads.match_uploads(hashed, sessions, resume)
    planned = uploads.chunk_plan(matched)
    fresh = accepted & (F.col("decision") == uploads.NEW)
    goes_on = [c for c in ("chunk_size", "total_chunks") if resume]
    return planned.select(
        "request_id", "user_id", "code", "field",
        F.when(accepted, F.col("decision")).alias("decision"),
        "matched_upload_id",
        *[
            (F.when(fresh, F.col(c)).otherwise(F.col(f"resume_{c}")) if c in goes_on else F.when(fresh, F.col(c))).alias(c)
            for c in ("chunk_size", "total_chunks", "last_chunk_bytes", "expired_at")
        ],
        (F.col("resume_chunks") if resume else F.lit(None).cast("array<int>")).alias("uploaded_chunks"),
    )


def complete_uploads(sessions: DataFrame, acks: DataFrame, as_of: Column) -> DataFrame:
    """Completes every session that can be: state after the merge, with the composed path. The chunk sets are
    made once."""
    chunked = materialise(uploads.uploaded_chunks(acks, sessions), "chunked")
    merges = uploads.manifest_of(chunked, as_of).select(
        "upload_id", F.col("target_path").alias("merged_path"), F.lit(False).alias("failed")
    )
    return uploads.complete_sessions(chunked, merges, as_of)
