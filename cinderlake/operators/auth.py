"""One-time codes, rate limits and login checks."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

MAX_ATTEMPTS = 5
VALID_MINUTES = 5
#: What a check says.
USED = "This code has already been used."
TOO_MANY = "Too many failed attempts. Please request a new code."
EXPIRED = "This code has expired. Please request a new code."
VERIFIED = "Code verified successfully."


def verify(code: Column, now: Column) -> dict[str, Column]:
    """success, message, attempts and is_used after one check of code against the row's otp_code; the first failure wins."""
    after = F.col("attempts") + 1
    wrong = F.col("otp_code") != text.strip(code)
    open_code = ~F.col("is_used") & (F.col("attempts") < MAX_ATTEMPTS) & (now <= F.col("expires_at"))
    left = MAX_ATTEMPTS - after
    mismatch = F.when(left <= 0, F.lit(TOO_MANY)).otherwise(F.concat(F.lit("Incorrect code. "), text.attempts_left(left), F.lit(".")))
    message = F.when(F.col("is_used"), F.lit(USED)).when(F.col("attempts") >= MAX_ATTEMPTS, F.lit(TOO_MANY)).when(now > F.col("expires_at"), F.lit(EXPIRED)).when(wrong, mismatch).otherwise(F.lit(VERIFIED))
    return {
        "success": open_code & ~wrong,
        "message": message,
        "attempts_after": F.when(open_code & wrong, after).otherwise(F.col("attempts")),
        "is_used_after": F.col("is_used") | (open_code & ~wrong),
    }


def replay(tries: DataFrame, token: str, at: str, order: str) -> DataFrame:
    """tries (token, code, otp_code, expires_at, at) with the verdict on each, as if made one after the other.

    Only what came before matters: whether a try has succeeded, and how many open ones were wrong. Both
    are running counts, so no loop over a token's tries is needed.
    """
    before = Window.partitionBy(token).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    expired = F.col(at) > F.col("expires_at")
    wrong = F.col("otp_code") != text.strip(F.col("code"))
    n_wrong = F.coalesce(F.count_if(wrong & ~expired).over(before), F.lit(0))
    counted = tries.withColumn("__wrong", n_wrong)
    good = ~wrong & ~expired & (F.col("__wrong") < MAX_ATTEMPTS)
    counted = counted.withColumn("__used", F.coalesce(F.max(good).over(before), F.lit(False)))
    state = {"attempts": F.least("__wrong", F.lit(MAX_ATTEMPTS)).cast("int"), "is_used": F.col("__used")}
    staged = counted.withColumns(state)
    verdict = verify(F.col("code"), F.col(at))
    return staged.withColumns({"success": verdict["success"], "message": verdict["message"]}).drop("__wrong", "__used", "attempts", "is_used")


def well_formed(code: Column) -> Column:
    return text.strip(code).rlike("^[0-9]{6}$")


def padded_code(number: Column) -> Column:
    return F.lpad(number.cast("string"), 6, "0")


def issue_history(issues: DataFrame, user: str, at: str, order: str) -> DataFrame:
    """issues of codes with expires_at, and is_used: a later issue for the user uses up those before it."""
    later = F.max(F.struct(at, order)).over(Window.partitionBy(user))
    return issues.withColumns({"expires_at": F.col(at) + F.expr(f"interval {VALID_MINUTES} minutes"), "is_used": F.struct(at, order) < later})


def login_error(username: Column, found: Column, active: Column, email: Column) -> Column:
    """What stands against a login, null for nothing; the first failure wins."""
    return (
        F.when((text.strip(username) == "") | ~F.coalesce(found, F.lit(False)), F.lit("invalid credentials"))
        .when(~F.coalesce(active, F.lit(False)), F.lit("inactive"))
        .when(text.falsy_coalesce(email).isNull(), F.lit("missing email"))
    )


def throttle(hits: DataFrame, key: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """hits with allowed: whether fewer than limit allowed hits of the key fall in the seconds before.

    Refused hits do not count, so a hit hangs on the verdicts before it. Keys are dealt to partitions and
    sorted there; one pass holds the last limit allowed times of the key it is at, however many hits
    that key has. Null keys count as one.
    """
    span = seconds * 1_000_000
    schema = T.StructType([*hits.schema.fields, T.StructField("allowed", T.BooleanType())])
    names = [f.name for f in schema]

    def fold(frames):
        held, recent = object(), deque()
        for frame in frames:
            verdicts = []
            for k, t in zip(frame[key].tolist(), frame["__at"].tolist(), strict=True):
                k = None if k != k else k
                if k != held:
                    held, recent = k, deque()
                while recent and recent[0] <= t - span:
                    recent.popleft()
                verdicts.append(len(recent) < limit)
                if verdicts[-1]:
                    recent.append(t)
            yield frame.assign(allowed=verdicts)[names]

    timed = hits.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    return timed.repartition(F.col(key)).sortWithinPartitions(key, "__at", order).mapInPandas(fold, schema)
