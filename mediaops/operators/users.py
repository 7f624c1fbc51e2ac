"""Users, requests and error codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.functions.frames import touched
from mediaops.functions.rules import PARAM
from mediaops.operators.graph import connected_components
from mediaops.session import materialise

SECRET_COLUMNS = ("password", "api_secret")


def user_flags(users: DataFrame) -> DataFrame:
    """enabled, admin and vip; an admin is also a vip."""
    role = F.coalesce("role", F.lit(""))
    return (
        users.withColumn("enabled", F.coalesce(F.col("status") == 1, F.lit(False)))
        .withColumn("admin", role == "ADMIN")
        .withColumn("vip", role.isin("VIP", "ADMIN"))
    )


def mask_secrets(users: DataFrame) -> DataFrame:
    """A users table fit to publish: no secrets, the key masked."""
    return users.drop(*SECRET_COLUMNS).withColumn("api_key", fn.mask_key(F.col("api_key")))


def role_defaults(users: DataFrame) -> DataFrame:
    """Default request rate and monthly tokens by role; an unknown role counts as USER."""
    spark = users.sparkSession
    usual = s.ROLES[0]
    return (
        users.join(F.broadcast(s.role_table(spark)), "role", "left")
        .withColumn("default_qps", F.coalesce("default_qps", F.lit(usual[1])))
        .withColumn("default_quota", F.coalesce("default_quota", F.lit(usual[2]).cast("long")))
    )


def count_where(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: how many rows hold."""
    return df.agg(F.count(F.when(predicate, 1)).alias("n"))


def attribute_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Each request with the enabled user its key belongs to and the outcome code.

    Requests with no usable key get a join key of their own, so the many of them spread
    instead of meeting in one partition.
    """
    key = F.col("api_key")
    present = fn.filled(key)
    well_formed = (F.length(key) >= 10) & (key.startswith("sk_live_") | key.startswith("sk_test_"))
    join_key = F.when(present & well_formed, key).otherwise(
        F.concat(F.lit("none:"), F.col("req_id").cast("string"))
    )
    enabled = users.filter(F.col("status") == 1).select(
        F.col("api_key").alias("_key"), F.col("id").alias("auth_user_id")
    )
    return (
        requests.withColumn("_key", join_key)
        .join(enabled, "_key", "left")
        .withColumn(
            "auth_code",
            F.when(~present, 10002)
            .when(~well_formed, 10001)
            .when(F.col("auth_user_id").isNull(), 23002)
            .otherwise(s.OK),
        )
        .drop("_key")
    )


def error_dimension(requests: DataFrame) -> DataFrame:
    """Each request's code with family, message and HTTP status; unknown codes become 10000."""
    codes = F.broadcast(s.error_codes(requests.sparkSession))
    known = F.when(
        F.col("code").isin(*[c for c, _ in s.ERROR_CODES]), F.col("code")
    ).otherwise(s.UNKNOWN_ERROR)
    return requests.withColumn("raw_code", F.col("code")).withColumn("code", known).join(codes, "code")


def error_mix(requests: DataFrame) -> DataFrame:
    """Requests by error family and HTTP status, counted per code before the join."""
    per_code = requests.groupBy("code").agg(F.count("*").alias("n"))
    return error_dimension(per_code).groupBy("family", "http_status").agg(F.sum("n").alias("n"))


def user_admin_update(users: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Bulk disable and rate-limit change by id, and when that was; ``changes(id, disable, rate_limit)``."""
    new = changes.select("id", "disable", F.col("rate_limit").alias("_rate"))
    changed = F.coalesce("disable", F.lit(False)) | F.col("_rate").isNotNull()
    return (
        touched(users.join(new, "id", "left"), changed, as_of)
        .withColumn("status", F.when(F.col("disable"), 0).otherwise(F.col("status")))
        .withColumn("rate_limit", F.coalesce("_rate", "rate_limit"))
        .drop("disable", "_rate")
    )


#: Rounds in which collisions are settled by reductions alone, before what is left is cut into components.
PEELS = 3


def _settle(open_: DataFrame) -> DataFrame:
    """``request_id`` of those that win among the open requests, one component of collisions after another, each in
    request order. Only names and mails taken in one component are held at a time."""

    def run(batches):
        import pyarrow as pa

        of, names, mails = None, set(), set()
        for batch in batches:
            wins = []
            for i, (component, name, mail) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                if component != of:
                    of, names, mails = component, set(), set()
                if name not in names and mail not in mails:
                    names.add(name)
                    mails.add(mail)
                    wins.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(wins, pa.int64()))], names=["request_id"])

    node = F.xxhash64("request_id")  # two that fall on one number only share a component
    firsts = [open_.groupBy(c).agg(F.min("request_id").alias("_first")) for c in ("username", "email")]
    edges = [open_.join(first, c).select(node.alias("a"), F.xxhash64("_first").alias("b")) for first, c in zip(firsts, ("username", "email"))]
    roots = connected_components(edges[0].unionByName(edges[1]))
    placed = open_.join(roots, node == F.col("node"), "left").select(
        "request_id", F.coalesce("root", node).alias("_component"), "username", "email")
    sent = placed.repartition("_component").sortWithinPartitions("_component", "request_id")
    return sent.mapInArrow(run, sent.select("request_id").schema)


def register_batch(requests: DataFrame, users: DataFrame, strict: bool = True) -> DataFrame:
    """Outcome of each registration, as if they came one by one in request order.

    A request without a username or an email gives the parameter code and takes nothing. A username in use gives 23003. An email in use gives 23004: any user's if strict, else
    only an enabled user's. An accepted request takes its username and email.

    Inside the batch ``PEELS`` rounds each accept every open request that is the first open one for both
    its username and its email, then close the open ones that collide with it. Reductions are
    aggregates, so a popular name never gathers in one task. What is open then hangs together in chains; their
    components are found by contraction, in rounds that follow the logarithm of the longest, and each is settled in
    one pass in request order. (The first come matching of a chain can't be told from less than the chain.)
    """
    emails = users if strict else users.filter(F.col("status") == 1)
    names_used = users.select("username", F.lit(True).alias("_name_used")).distinct()
    emails_used = emails.select("email", F.lit(True).alias("_email_used")).distinct()
    judged = materialise(
        requests.join(names_used, "username", "left")
        .join(emails_used, "email", "left")
        .select(*requests.columns, "_name_used", "_email_used"),
        "registrations",
    )
    known_name = F.coalesce("_name_used", F.lit(False))
    named = F.col("username").isNotNull() & F.col("email").isNotNull()
    wanted = ["request_id", "username", "email"]
    open_ = judged.filter(named & ~known_name & F.col("_email_used").isNull()).select(*wanted)
    accepted = []
    for _ in range(PEELS):
        names = open_.groupBy("username").agg(F.min("request_id").alias("_first_name"))
        mails = open_.groupBy("email").agg(F.min("request_id").alias("_first_mail"))
        wins = (F.col("request_id") == F.col("_first_name")) & (
            F.col("request_id") == F.col("_first_mail")
        )
        winners = materialise(
            open_.join(names, "username").join(mails, "email").filter(wins).select(*wanted),
            "accepted",
        )
        accepted.append(winners)
        open_ = materialise(
            open_.join(winners.select("username"), "username", "left_anti").join(
                winners.select("email"), "email", "left_anti"
            ),
            "open",
        )
    accepted.append(materialise(_settle(open_).join(open_, "request_id").select(*wanted), "settled"))
    taken = reduce(DataFrame.unionByName, accepted)
    by_name = taken.select("username", F.col("request_id").alias("_name_id"))
    accepted_ids = taken.select("request_id", F.lit(True).alias("_accepted"))
    return (
        judged.join(accepted_ids, "request_id", "left").join(by_name, "username", "left")
        .withColumn(
            "code",
            F.when(~named, PARAM)
            .when(F.col("_accepted"), s.OK)
            .when(F.col("_name_used") | (F.col("_name_id") < F.col("request_id")), 23003)
            .otherwise(23004),
        )
        .select(*requests.columns, "code")
    )
