"""Row validation: ordered rules, first failure wins, one pass over the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.functions.columns import extension, filled

PARAM, TYPE, SIZE = 10001, 20005, 20006


@dataclass(frozen=True)
class Rule:
    """A field, the code to reject with, and a predicate; null counts as failed."""

    field: str
    code: int
    holds: Column


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``code`` (0 if every rule holds) and ``field`` of the first rule that fails."""
    code, field = F.lit(s.OK), F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = F.coalesce(rule.holds, F.lit(False))
        code = F.when(holds, code).otherwise(rule.code)
        field = F.when(holds, field).otherwise(rule.field)
    return df.withColumn("code", code).withColumn("field", field)


def validate(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows as they came, rejected rows with code and field)."""
    judged = judge(df, rules)
    ok = judged.filter(F.col("code") == s.OK).drop("code", "field")
    return ok, judged.filter(F.col("code") != s.OK)


def upload_rules(
    max_file_size: int = s.MAX_FILE_SIZE, allowed: tuple[str, ...] = s.ALLOWED_EXTENSIONS
) -> list[Rule]:
    """Upload requests. The type test is exact membership of the extension."""
    c = F.col
    return [
        Rule("file_name", PARAM, filled(c("file_name")) & (F.length("file_name") <= s.MAX_NAME)),
        Rule("file_size", PARAM, c("file_size").between(1, s.MAX_FILE_SIZE)),
        Rule("file_hash", PARAM,
             c("file_hash").isNull() | c("file_hash").rlike(s.FILE_HASH)),
        Rule("chunk_size", PARAM,
             c("chunk_size").isNull() | c("chunk_size").between(s.MIN_CHUNK_SIZE, s.MAX_CHUNK_SIZE)),
        Rule("prompt", PARAM, c("prompt").isNull() | (F.length("prompt") <= s.MAX_PROMPT)),
        Rule("metadata", PARAM, c("metadata").isNull() | (F.length("metadata") <= s.MAX_METADATA)),
        Rule("file_name", TYPE, extension(c("file_name")).isin(*allowed)),
        Rule("file_size", SIZE, c("file_size") <= max_file_size),
    ]


def user_rules() -> list[Rule]:
    """Registrations."""
    c = F.col
    return [
        Rule("username", PARAM,
             F.length("username").between(*s.USERNAME_LENGTH) & c("username").rlike(s.USERNAME)),
        Rule("email", PARAM,
             (F.length("email") <= s.MAX_EMAIL) & c("email").rlike(s.EMAIL)),
        Rule("password", PARAM, filled(c("password")) & F.length("password").between(*s.PASSWORD_LENGTH)),
    ]


def rename_rules() -> list[Rule]:
    c = F.col
    return [Rule("task_name", PARAM, filled(c("task_name")) & (F.length("task_name") <= s.MAX_NAME))]
