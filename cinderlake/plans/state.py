"""One-time codes, rate limits and progress: events stand in for issues, tries, hits and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import auth, progress, relational
from ..session import shared_path
from ..sources.tables import table
from ..streaming.progress import TTL_MS, expiring_progress, live_progress, read_states

#: Of the throttle query: so that events, which are rare, meet the limit.
HITS, SECONDS = 2, 86_400


def _code(k):
    return auth.padded_code(k * 7_919 % 1_000_000)


def otp_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = auth.issue_history(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")
    return issues.select("event_id", "user_id", _code(F.col("event_id")).alias("otp_code"), "expires_at", "is_used")


def otp_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", _code(k).alias("otp_code"), (k % 7).cast("int").alias("attempts"), (k % 11 == 0).alias("is_used"), (F.col("ts") + F.expr("interval 5 minutes")).alias("expires_at"), (F.col("ts") + F.make_dt_interval(mins=(k % 7).cast("int"))).alias("now"))
    tried = F.when(k % 3 == 0, F.concat(F.lit(" "), "otp_code", F.lit("\n"))).otherwise(F.lit("12345"))
    checked = auth.verify(tried, F.col("now"))
    return rows.select("event_id", auth.well_formed(tried).alias("well_formed"), *(c.alias(name) for name, c in checked.items()))


def otp_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a try at its user's one code, which the sixth of each eight events has right; the code ends in mid-month."""
    k = F.col("event_id")
    code = auth.padded_code(F.col("user_id"))
    tries = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", code.alias("otp_code"), F.when(k % 8 == 5, code).otherwise(F.lit("x")).alias("code"), F.lit("2024-01-16").cast("timestamp_ntz").alias("expires_at"))
    return auth.replay(tries, "user_id", "ts", "event_id").select("event_id", "success", "message")


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return auth.throttle(hits, "user_id", "ts", "event_id", HITS, SECONDS).select("event_id", "allowed")


def login_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, F.lit("  ")).otherwise(F.col("c_name"))
    error = auth.login_error(name, k % 7 != 0, k % 5 != 0, F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("a@example.com")))
    return table(spark, sf_dir, "customer").select("c_custkey", error.alias("error"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    stage = F.when(F.col("event_type") == "purchase", F.lit("completed")).when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.col("event_type"))
    model = F.when(k % 3 == 0, F.concat(F.lit("m"), (k % 4).cast("string"))).otherwise(F.lit(""))
    count = F.when(k % 5 == 0, (k % 50).cast("int")).otherwise(F.lit(0))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("project_id"), F.col("ts").cast("timestamp").alias("event_time"), k.alias("seq"), F.floor("value").cast("int").alias("progress"), stage.alias("stage"), F.concat(F.lit("step "), k.cast("string")).alias("current_step"), F.concat(F.lit("log "), k.cast("string")).alias("new_log"), model.alias("model"), count.alias("chunk_count"))


def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = progress.latest_state(_updates(spark, sf_dir), "project_id", ("event_time", "seq"))
    return out.select("project_id", "status", "progress", "stage", "current_step", F.coalesce("model", F.lit("")).alias("model"), "chunk_count")


def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream: what each micro-batch emits goes to a table, and a project's last row is its state.

    Without a TTL: with one, the trigger that takes what is available would wait for states to expire.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = shared_path(spark, "updates"), shared_path(spark, "states")
    _updates(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema(_updates(spark, sf_dir).schema).option("maxFilesPerTrigger", 1000).parquet(source)
    query = live_progress(stream, ttl_ms=None).writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "stream")).foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(out).groupBy("project_id").agg(F.max_by(F.struct("status", "progress", "stage", "current_step", "model", "chunk_count", "logs"), "batch").alias("s"))
    return last.select("project_id", "s.status", "s.progress", "s.stage", "s.current_step", F.coalesce("s.model", F.lit("")).alias("model"), "s.chunk_count", F.array_join("s.logs", "\n").alias("logs"))


def progress_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each project whether its state is still live ten minutes of event time after its last update, and the live state, read from the state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, checkpoint = shared_path(spark, "updates"), shared_path(spark, "stream")
    _updates(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema(_updates(spark, sf_dir).schema).option("maxFilesPerTrigger", 1000).parquet(source)
    query = expiring_progress(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: batch.write.format("noop").mode("append").save()).trigger(availableNow=True).start()
    query.awaitTermination()
    projects = _updates(spark, sf_dir).select("project_id").distinct()
    live = read_states(spark, checkpoint).withColumn("live", F.lit(True))
    found = projects.join(live, "project_id", "left")
    shown = [F.coalesce(c, F.lit("")).alias(c) for c in ("status", "stage", "current_step")]
    return found.select("project_id", F.coalesce("live", F.lit(False)).alias("live"), *shown, F.coalesce("progress", F.lit(0)).alias("progress"), F.coalesce(F.array_join("logs", "\n"), F.lit("")).alias("logs"))


def log_tail50(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.lit(" "), F.col("value").cast("string")).alias("line"))
    return progress.log_tail(lines, "user_id", "event_id").select("user_id", "event_id", "line")


def status_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_acctbal") > 0).alias("is_indexed"), F.concat(F.lit("model-"), F.lower("c_mktsegment")).alias("embedding_model"))
    return progress.with_defaults(projects, progress_latest(spark, sf_dir), "project_id")


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How runs end, with something missing for most of them."""
    k = F.col("c_custkey")
    count = lambda n: F.when(k % n == 0, F.lit(0)).otherwise(k % 30)
    repository = F.when(k % 3 == 0, F.lit("")).when(k % 13 > 0, F.col("c_name"))
    end = progress.run_outcome(k % 11 > 0, repository, count(5), count(7), count(2), text.diff_summary(k % 4, k % 5, k % 6))
    return table(spark, sf_dir, "customer").select("c_custkey", end.alias("end")).select("c_custkey", "end.*")


def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code sessions with their users; a session whose user is gone is not found."""
    sessions = table(spark, sf_dir, "events").select(F.concat(F.lit("session-"), F.col("event_id").cast("string")).alias("session_token"), "user_id")
    users = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey"), F.col("c_name").alias("username"))
    found = relational.with_parent(sessions, users, "user_id", "c_custkey")
    label = text.code_label(F.col("username"), F.col("c_custkey") % 2 == 0)
    return found.select("session_token", "username", label.alias("label"), text.profile_label(F.col("username")).alias("profile"))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.when(F.col("event_id") % 3 == 0, F.lit(0.25)).otherwise(F.lit(0.0)))
    whole = F.date_trunc("second", at)
    return table(spark, sf_dir, "events").select("event_id", text.iso_time(F.when(F.col("event_id") % 2 == 0, whole).otherwise(at)).alias("iso"))


_PADDED = "lpad((event_id * 7919 % 1000000)::VARCHAR, 6, '0')"
_STAGE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END"
_STATUS = "CASE WHEN stage IN ('completed', 'failed') THEN stage ELSE 'indexing' END"
_LATEST = f"""latest AS (
  SELECT project_id, {_STATUS} AS status, progress, stage, current_step, coalesce(model, '') AS model, chunk_count FROM (
    SELECT user_id::BIGINT AS project_id, arg_max(floor(value)::INT, (ts, event_id)) AS progress, arg_max({_STAGE}, (ts, event_id)) AS stage, arg_max('step ' || event_id, (ts, event_id)) AS current_step,
           arg_max('m' || event_id % 4, (ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS model, coalesce(arg_max((event_id % 50)::INT, (ts, event_id)) FILTER (WHERE event_id % 5 = 0 AND event_id % 50 > 0), 0) AS chunk_count
    FROM events GROUP BY user_id))"""
_LEFT = "CASE WHEN {n} > 1 THEN {n} || ' attempts' ELSE {n} || ' attempt' END || ' remaining.'"

QUERIES = {
    "otp_invalidate": (
        otp_invalidate,
        f"""SELECT event_id, user_id, {_PADDED} AS otp_code, ts + INTERVAL 5 MINUTE AS expires_at, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS is_used FROM events""",
    ),
    "otp_verify": (
        otp_verify,
        f"""WITH t AS (SELECT event_id, (event_id % 7)::INT AS attempts, event_id % 11 = 0 AS used, event_id % 3 = 0 AS good, event_id % 7 > 5 AS expired FROM events),
o AS (SELECT *, NOT used AND attempts < 5 AND NOT expired AS opened FROM t)
SELECT event_id, good AS well_formed, opened AND good AS success,
       CASE WHEN used THEN '{auth.USED}' WHEN attempts >= 5 THEN '{auth.TOO_MANY}' WHEN expired THEN '{auth.EXPIRED}' WHEN good THEN '{auth.VERIFIED}'
            WHEN attempts = 4 THEN '{auth.TOO_MANY}' ELSE 'Incorrect code. ' || {_LEFT.format(n="(4 - attempts)")} END AS message,
       CASE WHEN opened AND NOT good THEN attempts + 1 ELSE attempts END AS attempts_after, used OR (opened AND good) AS is_used_after
FROM o""",
    ),
    "otp_replay": (
        otp_replay,
        f"""WITH RECURSIVE t AS (SELECT event_id, user_id, event_id % 8 = 5 AS right, ts > TIMESTAMP '2024-01-16' AS expired, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, event_id, attempts, used, success, message) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, 0, false, false, '' FROM t WHERE k = 1
  UNION ALL
  SELECT t.user_id, t.k, t.event_id, CASE WHEN o AND NOT t.right THEN f.attempts + 1 ELSE f.attempts END, f.used OR (o AND t.right), o AND t.right,
         CASE WHEN f.used THEN '{auth.USED}' WHEN f.attempts >= 5 THEN '{auth.TOO_MANY}' WHEN t.expired THEN '{auth.EXPIRED}' WHEN t.right THEN '{auth.VERIFIED}'
              WHEN f.attempts = 4 THEN '{auth.TOO_MANY}' ELSE 'Incorrect code. ' || {_LEFT.format(n="(4 - f.attempts)")} END
  FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1, (SELECT 1), LATERAL (SELECT NOT f.used AND f.attempts < 5 AND NOT t.expired AS o))
SELECT event_id, success, message FROM f WHERE k > 0""",
    ),
    "throttle": (
        throttle,
        f"""WITH RECURSIVE t AS (SELECT event_id, user_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, event_id, recent, allowed) AS (
  SELECT user_id, 1::BIGINT, event_id, [moment], true FROM t WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, CASE WHEN len(r) < {HITS} THEN list_append(r, moment) ELSE r END, len(r) < {HITS}
  FROM (SELECT t.*, list_filter(f.recent, lambda x: x > t.moment - {SECONDS}::BIGINT * 1000000) AS r FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1))
SELECT event_id, allowed FROM f""",
    ),
    "login_checks": (
        login_checks,
        "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN 'invalid credentials' WHEN c_custkey % 5 = 0 THEN 'inactive' WHEN c_custkey % 3 = 0 THEN 'missing email' END AS error FROM customer",
    ),
    "progress_latest": (progress_latest, f"WITH {_LATEST} SELECT * FROM latest"),
    "progress_stream": (
        progress_stream,
        f"""WITH {_LATEST}, lines AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
logs AS (SELECT user_id, string_agg('log ' || event_id, chr(10) ORDER BY ts, event_id) AS logs FROM lines WHERE k <= 50 GROUP BY user_id)
SELECT latest.*, logs FROM latest JOIN logs ON user_id = project_id""",
    ),
    "progress_expiring": (
        progress_expiring,
        f"""WITH {_LATEST}, lines AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
logs AS (SELECT user_id, max(ts) AS last_ts, string_agg('log ' || event_id, chr(10) ORDER BY ts, event_id) FILTER (WHERE k <= 50) AS logs FROM lines GROUP BY user_id),
due AS (SELECT user_id, logs, epoch_ms(last_ts) + {TTL_MS} > (SELECT epoch_ms(max(ts)) FROM events) AS live FROM logs)
SELECT project_id, live, CASE WHEN live THEN status ELSE '' END AS status, CASE WHEN live THEN progress ELSE 0 END AS progress, CASE WHEN live THEN stage ELSE '' END AS stage,
       CASE WHEN live THEN current_step ELSE '' END AS current_step, CASE WHEN live THEN logs ELSE '' END AS logs FROM latest JOIN due ON user_id = project_id""",
    ),
    "run_outcomes": (
        run_outcomes,
        f"""SELECT c_custkey, CASE WHEN step IS NULL THEN 100 ELSE 0 END AS progress, CASE WHEN step IS NULL THEN 'completed' ELSE 'failed' END AS stage,
       coalesce(step, 'Indexing complete! (' || k % 4 || ' cached, ' || k % 5 || ' embedded, ' || k % 6 || ' pruned)') AS current_step
FROM (SELECT c_custkey, c_custkey AS k, CASE WHEN k % 11 = 0 THEN '{progress.NO_PROJECT}' WHEN k % 3 = 0 OR k % 13 = 0 THEN '{progress.NO_REPOSITORY}' WHEN k % 5 = 0 OR k % 30 = 0 THEN '{progress.NO_FILES}'
             WHEN k % 7 = 0 THEN '{progress.NO_BLOCKS}' WHEN k % 2 = 0 THEN '{progress.NO_CHUNKS}' END AS step FROM customer)""",
    ),
    "session_users": (
        session_users,
        """SELECT 'session-' || event_id AS session_token, c_name AS username, 'OTP for ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (Used)' ELSE ' (Active)' END AS label, 'Profile for ' || c_name AS profile
FROM events JOIN customer ON c_custkey = user_id WHERE c_acctbal > 0""",
    ),
    "iso_times": (
        iso_times,
        """SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(t, '%f') = '000000' THEN '' ELSE '.' || strftime(t, '%f') END || '+00:00' AS iso
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', x) ELSE x END AS t FROM (SELECT event_id, ts + CASE WHEN event_id % 3 = 0 THEN INTERVAL 250 MILLISECOND ELSE INTERVAL 0 SECOND END AS x FROM events))""",
    ),
    "log_tail50": (
        log_tail50,
        """SELECT user_id, event_id, event_type || ' ' || value AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 50""",
    ),
    "status_default": (
        status_default,
        f"""WITH {_LATEST}
SELECT c_custkey AS project_id, c_acctbal > 0 AS is_indexed, coalesce(status, CASE WHEN c_acctbal > 0 THEN 'completed' ELSE 'idle' END) AS status, coalesce(progress, CASE WHEN c_acctbal > 0 THEN 100 ELSE 0 END) AS progress,
       coalesce(stage, CASE WHEN c_acctbal > 0 THEN 'completed' ELSE 'idle' END) AS stage, coalesce(current_step, CASE WHEN c_acctbal > 0 THEN 'Ready' ELSE 'Not indexed yet' END) AS current_step,
       'model-' || lower(c_mktsegment) AS embedding_model, coalesce(nullif(model, ''), CASE WHEN c_acctbal > 0 THEN 'model-' || lower(c_mktsegment) END) AS model
FROM customer LEFT JOIN latest ON project_id = c_custkey""",
    ),
}
