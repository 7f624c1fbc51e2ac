"""Table and message schemas, and the fixed values the jobs share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


S, I, L, B, TS = StringType(), IntegerType(), LongType(), ByteType(), TimestampNTZType()

USER = _struct(
    id=L, user_id=S, username=S, email=S, password=S, api_key=S, api_secret=S, role=S,
    status=B, rate_limit=I, created_at=TS, updated_at=TS,
)
UPLOAD_SESSION = _struct(
    id=L, upload_id=S, user_id=L, file_name=S, file_hash=S, total_size=L, chunk_size=I,
    total_chunks=I, uploaded_chunks=S, status=B, storage_path=S, created_at=TS,
    updated_at=TS, expired_at=TS,
)
ANALYSIS_TASK = _struct(
    id=L, task_id=S, task_name=S, upload_id=S, user_id=L, video_url=S, video_duration=I,
    prompt=S, status=S, progress=I, retry_count=I, max_retry=I, error_message=S,
    frame_count=I, ai_model=S, tokens_used=L, result=S, summary=S, created_at=TS,
    started_at=TS, completed_at=TS, updated_at=TS,
)
USER_QUOTA = _struct(
    id=L, user_id=L, quota_monthly=L, used_monthly=L, quota_daily=L, used_daily=L,
    reset_daily_at=TS, reset_monthly_at=TS, created_at=TS, updated_at=TS,
)
AI_CALL_LOG = _struct(
    id=L, task_id=S, user_id=L, model=S, input_tokens=I, output_tokens=I, total_tokens=L,
    cost_amount=DecimalType(10, 6), latency_ms=I, status=B, error_message=S, created_at=TS,
)
TABLES = {
    "user": USER,
    "upload_session": UPLOAD_SESSION,
    "analysis_task": ANALYSIS_TASK,
    "user_quota": USER_QUOTA,
    "ai_call_log": AI_CALL_LOG,
}

TASK_MESSAGE = _struct(
    taskId=S, uploadId=S, userId=L, videoUrl=S, videoDuration=I, retryCount=I,
    timestamp=L, priority=I, analysisType=S, prompt=S,
)
TASK_EVENT = _struct(taskId=S, event=S, detail=S, timestamp=L)
DEAD_LETTER = _struct(taskId=S, error=S, retryCount=I, timestamp=L)

AI_RESULT = _struct(
    summary=S,
    scenes=ArrayType(_struct(timeRange=S, description=S, type=S)),
    keyframes=ArrayType(_struct(time=S, description=S)),
    tags=ArrayType(S),
    sentiment=S,
    textDetected=S,
)

# ---- Fixed values: these must equal what the service writes and checks. ----

# Task states in display order.
TASK_STATUSES = (
    "PENDING", "QUEUED", "PROCESSING", "COMPLETED", "FAILED", "RETRYING", "CANCELLED", "DEAD",
)
FINAL_STATUSES = ("COMPLETED", "CANCELLED", "DEAD")
# Declared moves between different states; staying in a state is always allowed.
DECLARED_MOVES = (
    ("PENDING", "QUEUED"), ("PENDING", "CANCELLED"),
    ("QUEUED", "PROCESSING"), ("QUEUED", "CANCELLED"),
    ("PROCESSING", "COMPLETED"), ("PROCESSING", "FAILED"), ("PROCESSING", "CANCELLED"),
    ("FAILED", "RETRYING"), ("FAILED", "DEAD"),
    ("RETRYING", "PROCESSING"), ("RETRYING", "FAILED"), ("RETRYING", "DEAD"),
)
# Labels the task board shows.
STATUS_LABELS = {
    "PENDING": "等待中", "QUEUED": "排队中", "PROCESSING": "分析中", "COMPLETED": "已完成",
    "FAILED": "失败", "RETRYING": "重试中", "DEAD": "已终止", "CANCELLED": "已取消",
}
UNKNOWN_LABEL = "未知"
UNKNOWN_FILE = "未知文件"
# The board treats FAILED as final too; jobs that change data use FINAL_STATUSES.
BOARD_FINAL_STATUSES = ("COMPLETED", "FAILED", "DEAD", "CANCELLED")

UPLOADING, UPLOADED, MERGED, EXPIRED, MERGE_FAILED = 0, 1, 2, 3, 4
UPLOAD_STATUS_NAMES = {0: "UPLOADING", 1: "COMPLETED", 2: "MERGED", 3: "EXPIRED", 4: "MERGE_FAILED"}

# role, default requests per second, default monthly tokens
ROLES = (("USER", 100, 10_000), ("VIP", 200, 50_000), ("ADMIN", 1_000, 1_000_000))
DEFAULT_QUOTA_MONTHLY = 10_000
DEFAULT_QUOTA_DAILY = 500
DEFAULT_MAX_RETRY = 3

ALLOWED_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "wmv", "flv")
MIB = 1024 * 1024
MAX_FILE_SIZE = 5 * 1024 * MIB
DEFAULT_CHUNK_SIZE = 5 * MIB
MIN_CHUNK_SIZE, MAX_CHUNK_SIZE = MIB, 50 * MIB
SESSION_HOURS = 24
MAX_NAME, MAX_PROMPT, MAX_METADATA, MAX_EMAIL = 255, 2000, 4096, 128
USERNAME_LENGTH, PASSWORD_LENGTH = (2, 64), (6, 32)
FILE_HASH, USERNAME, EMAIL = "^[a-fA-F0-9]{32,64}$", "^[a-zA-Z0-9_]+$", r"^[^@\s]+@[^@\s]+$"
SAMPLE_SIZE = 2 * MIB
# Seconds from 1970 to the instant the ids count from (midnight in Shanghai, 2024-01-01).
ID_EPOCH_SECONDS = 1_704_038_400

DEFAULT_PRIORITY = 5
DEFAULT_ANALYSIS = "FULL"
RETRY_DELAYS = (10, 30, 60)
DEFAULT_PROMPT = "请分析这个视频的内容，按照系统提示的JSON格式返回结果。"

# code, message
ERROR_CODES = (
    (0, "操作成功"),
    (10000, "系统繁忙，请稍后重试"), (10001, "参数错误"), (10002, "缺少必要参数"),
    (10003, "请求方法不支持"),
    (20001, "上传会话不存在"), (20002, "上传会话已过期"), (20003, "分片索引错误"),
    (20004, "分片大小不正确"), (20005, "文件类型不支持"), (20006, "文件大小超出限制"),
    (20007, "分片正在上传中"), (20008, "分片上传失败"), (20009, "文件合并失败"),
    (21001, "任务不存在"), (21002, "任务已存在"), (21003, "任务状态不正确"),
    (21004, "任务重试次数已耗尽"), (21005, "任务正在处理中"), (21006, "未找到对应的视频任务"),
    (22001, "配额不足"), (22002, "每日配额已用完"), (22003, "每月配额已用完"),
    (23001, "用户不存在"), (23002, "用户被禁止"), (23003, "用户名已存在"),
    (23004, "邮箱已被注册"), (23005, "邮箱或密码错误"),
    (30001, "AI服务异常"), (30002, "AI服务超时"), (30003, "AI服务配额不足"),
    (30004, "存储服务异常"), (30005, "消息队列异常"),
    (40001, "请求过于频繁，请稍后重试"), (40002, "服务熔断中，请稍后重试"),
    (40003, "登录已过期，请重新登录"), (40004, "无效的认证凭证"),
)
OK = 0
UNKNOWN_ERROR = 10000


def error_codes(spark: SparkSession) -> DataFrame:
    """One row per error code: family (first digits) and the HTTP status it maps to.

    The status rule is as the service codes it: everything from 40000 up answers 429, so the
    two token errors there never reach the 401 rule.
    """
    codes = spark.createDataFrame(list(ERROR_CODES), "code int, message string")
    code = F.col("code")
    return codes.select(
        "code",
        (code / 10000).cast("int").alias("family"),
        "message",
        F.when(code == OK, 200)
        .when(code >= 40000, 429)
        .when(code >= 30000, 503)
        .when(code.isin(23005, 40003, 40004), 401)
        .when(code == 23002, 403)
        .otherwise(400)
        .alias("http_status"),
    )


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLES), "role string, default_qps int, default_quota long")


def declared_moves(spark: SparkSession) -> DataFrame:
    pairs = list(DECLARED_MOVES) + [(s, s) for s in TASK_STATUSES]
    return spark.createDataFrame(pairs, "from_status string, to_status string")
