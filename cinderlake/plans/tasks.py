"""Task, project and user reads and writes: orders stand in for tasks, customers for owners and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import calendar, relational, tickets, trigram_search
from ..session import shared_path
from ..sources import tables
from ..sources.tables import table

OWNER = 7
STAMP = "2026-01-01 00:00:00"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("bug")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("feature")).when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("chore")).otherwise(F.lit(""))
    item = lambda title, done: F.struct(F.lit(title).alias("title"), F.lit(done).alias("completed"))
    some = F.array(item("pick", True), item("pack", False), item(None, None))
    subtasks = F.when(F.col("o_orderkey") % 3 == 0, some).when(F.col("o_orderkey") % 3 == 1, F.slice(some, 1, 0))
    project = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("description"), (F.col("o_orderstatus") == "F").alias("completed"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")).alias("due_date"), (F.col("o_orderdate") - F.expr("interval 7 days")).alias("created_at"), F.col("o_custkey").alias("owner_id"), project.alias("project_id"), kind.alias("ticket_type"), subtasks.alias("subtasks"))


def owner_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.owned_by(table(spark, sf_dir, "orders"), OWNER, "o_custkey")


def active_deadline_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks with a deadline and their projects' names, by deadline."""
    due = relational.active_with_deadline(_tasks(spark, sf_dir))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"))
    return due.join(projects, "project_id", "left").select("id", "title", "due_date", "project_name").orderBy("due_date", "id")


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = relational.active_with_deadline(_tasks(spark, sf_dir))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"))
    return calendar.events(due.join(projects, "project_id", "left"), F.col("owner_id"), F.lit(STAMP).cast("timestamp_ntz")).drop("user_id")


def calendar_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's feed, with the size and a hash of its text."""
    due = relational.active_with_deadline(_tasks(spark, sf_dir))
    customers = table(spark, sf_dir, "customer")
    projects = customers.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"))
    rows = calendar.events(due.join(projects, "project_id", "left"), F.col("owner_id"), F.lit(STAMP).cast("timestamp_ntz"))
    feed = calendar.feeds(customers.select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit(", Esq.")).alias("username")), rows)
    return feed.select("user_id", F.length("value").alias("chars"), F.md5("value").alias("text_md5"))


def user_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.public_user(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "c_name", "o_orderkey", "o_custkey")
    return found.select("id", "username", F.array_join(F.transform("tasks", lambda k: k.cast("string")), ",").alias("tasks"))


def project_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects without their secret column, with a row for each task."""
    projects = relational.public_project(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("secret").alias("github_token")))
    tasks = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return relational.child_rows(projects, tasks, "c_custkey", "o_custkey").drop("o_custkey")


def first_open_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open task with the earliest deadline."""
    due = relational.active_with_deadline(_tasks(spark, sf_dir))
    return relational.first_row(due.select("id", "title", "due_date"), "due_date", "id")


def admin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of one status, searched by their owners' names too."""
    owners = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("owner_name"))
    tasks = relational.with_parent(table(spark, sf_dir, "orders"), owners, "o_custkey", "c_custkey")
    return relational.listing(tasks, ("o_orderkey", "owner_name", "o_orderpriority"), "customer#00000000 URGENT", ("owner_name", "o_orderpriority"), {"o_orderstatus": "O"})


def stored_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task rows with missing values, as they are stored; tokens are checked by their form."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, k % 4 == 0).alias("completed"), F.when(k % 3 == 0, F.lit("bug")).alias("ticket_type"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("created_at"))
    stored = tickets.with_defaults(rows, F.lit(STAMP).cast("timestamp_ntz"))
    return stored.withColumn("token_ok", text.hex_uuid().rlike("^[0-9a-f]{32}$"))


def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders")
    nested = relational.nest_children(projects, orders, "c_custkey", "o_custkey", F.col("o_orderkey"), "tasks")
    return nested.select("c_custkey", "c_name", F.size("tasks").alias("n_tasks"), F.array_join(F.transform("tasks", lambda k: k.cast("string")), ",").alias("tasks"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def unique_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that suppliers' numbers ask for, of which those of customers are taken."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    number = F.lpad((F.col("s_suppkey") * 31).cast("string"), 9, "0")
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request"), F.concat(F.lit("Customer#"), number).alias("name"))
    return relational.taken(names, wanted, "name").select("request", "name", "taken")


def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    email = F.when(k == 0, F.lit("a@example.com")).when(k == 1, F.lit("ab@example.com")).when(k == 2, F.lit("no address")).when(k == 3, F.lit("@example.com")).otherwise(F.concat("c_name", F.lit("@x@example.com")))
    return table(spark, sf_dir, "customer").select("c_custkey", email.alias("email"), text.mask_email(email).alias("masked"))


def feed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = text.feed_url("https://tasks.example/feed/", F.md5("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"), text.webcal_url(url).alias("webcal"), text.clean_token(F.concat(F.md5("c_name"), F.lit(".ics.ics"))).alias("token"))


def profiles_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all users: those with orders have one, the others get new ones."""
    token = F.md5("c_name").alias("token")
    users = table(spark, sf_dir, "customer")
    ordering = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    existing = users.join(ordering, "c_custkey", "left_semi").select(F.col("c_custkey").alias("user_id"), token, F.lit(False).alias("created"))
    return relational.get_or_create(existing, users.select(F.col("c_custkey").alias("user_id"), token, F.lit(True).alias("created")), "user_id")


def row_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after changes to some rows, with new ones among them."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = stored.filter("c_custkey % 6 = 0").select(F.when(F.col("c_custkey") % 12 == 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("c_custkey"), "c_name", F.lit("CHANGED").alias("c_mktsegment"))
    return relational.upsert(stored, changes, "c_custkey")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of orders and line items when a nation's customers go."""
    doomed = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey")
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = relational.delete_cascade(doomed, (orders, "o_custkey", "o_orderkey"), (items, "l_orderkey", "l_orderkey"))
    count = lambda rows, name, key: rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.sum(key).alias("key_sum"))
    return count(left[0], "orders", "o_orderkey").unionByName(count(left[1], "lineitem", "l_orderkey"))


def admin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.search(table(spark, sf_dir, "part"), "RING brand#1", "p_name", "p_brand").select("p_partkey", "p_name", "p_brand")


def admin_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    index = trigram_search.build_index(parts, "p_partkey", "p_name", "p_brand")
    return trigram_search.search_indexed(parts, index, "RING brand#1").select("p_partkey", "p_name", "p_brand")


def text_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    index = trigram_search.build_index(documents, "doc_id", "text", "source")
    return trigram_search.search_indexed(documents, index, "WHST retition").select("doc_id", "source")


def admin_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_orderdate")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    path = shared_path(spark, "nation-csv")
    tables.export_rows(rows, path, "csv")
    return tables.import_rows(spark, path, "csv", rows.schema)


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") > 10, F.col("p_name")).alias("p_name"))
    path = shared_path(spark, "part-json")
    tables.export_rows(rows, path, "json")
    return tables.import_rows(spark, path, "json", rows.schema)


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one path, and a count by nation of what it holds then."""
    rows = table(spark, sf_dir, "supplier")
    path = shared_path(spark, "supplier")
    tables.append(rows, path)
    tables.append(rows, path)
    return spark.read.parquet(path).groupBy("s_nationkey").agg(F.count("*").alias("n"))


def subtasks_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets in JSON, checked and given defaults; every seventh has a wrong type and every ninth no title."""
    k, value = F.col("event_id"), F.get_json_object("props", "$.k")
    kind = F.when(k % 7 == 0, F.lit("epic")).when(k % 3 == 0, F.lit("bug"))
    fields = [F.when(k % 9 > 0, F.concat(F.lit('"title":"T'), value, F.lit('"'))), F.concat(F.lit('"ticket_type":"'), kind, F.lit('"')), F.when(k % 2 == 0, F.concat(F.lit('"subtasks":[{"title":"s'), value, F.lit('","completed":true},{"title":"t"}]')))]
    made = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json"))
    items = F.array_join(F.transform("subtasks", lambda s: F.concat(s["title"], F.when(s["completed"], F.lit("+")).otherwise(F.lit("-")))), ",")
    return tickets.parse(made).select("event_id", "valid", "title", "description", "ticket_type", "completed", items.alias("subtasks"))


def generation_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("is_indexed"), F.concat(F.lit("model-"), F.lower("c_mktsegment")).alias("embedding_model"), F.when(F.col("c_custkey") % 2 == 0, F.repeat("c_name", F.lit(40))).alias("ast_outline"))
    return tickets.response(projects).select("c_custkey", "rag_model", "ast_outline_used", tickets.outline_preview(F.col("ast_outline")).alias("preview"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outline = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    snippets = F.when(F.col("c_custkey") % 3 == 0, F.lit(""))
    now = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 86_400)
    return table(spark, sf_dir, "customer").select("c_custkey", tickets.prompt(outline, snippets, F.col("c_mktsegment"), now, "Asia/Kolkata", "RULES").alias("prompt"))


_ICAL = "'%Y%m%dT%H%M%SZ'"
_PROJECT = "CASE WHEN o_custkey % 3 = 0 THEN c_name END"
_DUE = "FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND o_orderkey % 10 > 0"
_KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'BUG' WHEN '2-HIGH' THEN 'FEATURE' WHEN '3-MEDIUM' THEN 'CHORE' ELSE '' END"

QUERIES = {
    "owner_tasks": (owner_tasks, f"SELECT * FROM orders WHERE o_custkey = {OWNER}"),
    "active_deadline_feed": (active_deadline_feed, f"SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, o_orderdate AS due_date, {_PROJECT} AS project_name {_DUE} ORDER BY due_date, id"),
    "calendar_events": (
        calendar_events,
        f"""SELECT 'task-' || o_orderkey || '-' || o_custkey || '@taskapp.local' AS uid, CASE WHEN kind = '' THEN '' ELSE '[' || kind || '] ' END || 'Order ' || o_orderkey AS summary,
       o_orderdate AS dtstart, o_orderdate + INTERVAL 1 HOUR AS dtend, TIMESTAMP '2026-01-01' AS dtstamp, o_orderdate - INTERVAL 7 DAY AS created, kind || ',TASK' AS categories, 'CONFIRMED' AS status,
       concat_ws(chr(10), 'Project: ' || project, CASE WHEN o_orderkey % 4 > 0 THEN 'Description: ' || o_orderpriority END,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'Subtasks:' || chr(10) || '  [x] pick' || chr(10) || '  [ ] pack' || chr(10) || '  [ ] ' END) AS description
FROM (SELECT *, {_KIND} AS kind, {_PROJECT} AS project {_DUE})""",
    ),
    "calendar_feeds": (
        calendar_feeds,
        f"""WITH e AS (SELECT o_custkey AS user_id, o_orderkey, o_orderdate AS d, 'task-' || o_orderkey || '-' || o_custkey || '@taskapp.local' AS uid, CASE WHEN kind = '' THEN '' ELSE '[' || kind || '] ' END || 'Order ' || o_orderkey AS summary, kind,
  concat_ws(chr(10), 'Project: ' || project, CASE WHEN o_orderkey % 4 > 0 THEN 'Description: ' || o_orderpriority END,
            CASE WHEN o_orderkey % 3 = 0 THEN 'Subtasks:' || chr(10) || '  [x] pick' || chr(10) || '  [ ] pack' || chr(10) || '  [ ] ' END) AS description FROM (SELECT *, {_KIND} AS kind, {_PROJECT} AS project {_DUE})),
lines AS (SELECT user_id, d, uid, ['BEGIN:VEVENT', 'UID:' || uid, 'SUMMARY:' || summary, 'DTSTART:' || strftime(d, {_ICAL}), 'DTEND:' || strftime(d + INTERVAL 1 HOUR, {_ICAL}), 'DTSTAMP:20260101T000000Z', 'CREATED:' || strftime(d - INTERVAL 7 DAY, {_ICAL}),
            'CATEGORIES:' || kind || ',TASK', 'STATUS:CONFIRMED', 'DESCRIPTION:' || replace(description, chr(10), '\\n'), 'END:VEVENT'] AS ls FROM e),
texts AS (SELECT user_id, d, uid, array_to_string(list_transform(ls, lambda x: CASE WHEN length(x) <= 75 THEN x WHEN length(x) <= 148 THEN substr(x, 1, 74) || chr(13) || chr(10) || ' ' || substr(x, 75)
            ELSE substr(x, 1, 74) || chr(13) || chr(10) || ' ' || substr(x, 75, 74) || chr(13) || chr(10) || ' ' || substr(x, 149) END), chr(13) || chr(10)) AS v FROM lines),
bodies AS (SELECT user_id, string_agg(v, chr(13) || chr(10) ORDER BY d, uid) AS body FROM texts GROUP BY user_id),
feeds AS (SELECT c_custkey AS user_id, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//cinderlake//Tasks Feed//EN', 'X-WR-CALNAME:' || c_name || '\\, Esq.''s Tasks', 'X-WR-CALDESC:Active tasks and deadlines', 'X-PUBLISHED-TTL:PT1H', 'REFRESH-INTERVAL;VALUE=DURATION:PT1H', body, 'END:VCALENDAR') || chr(13) || chr(10) AS value
          FROM customer LEFT JOIN bodies ON bodies.user_id = c_custkey)
SELECT user_id, length(value)::INT AS chars, md5(value) AS text_md5 FROM feeds""",
    ),
    "user_projection": (user_projection, "SELECT c_custkey AS id, any_value(c_name) AS username, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS tasks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "project_tasks": (project_tasks, "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    "first_open_task": (first_open_task, f"SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, o_orderdate AS due_date {_DUE} ORDER BY o_orderdate, o_orderkey LIMIT 1"),
    "admin_list": (
        admin_list,
        """SELECT o_orderkey, c_name AS owner_name, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'
AND (contains(lower(c_name), 'customer#00000000') OR contains(lower(o_orderpriority), 'customer#00000000')) AND (contains(lower(c_name), 'urgent') OR contains(lower(o_orderpriority), 'urgent'))""",
    ),
    "stored_defaults": (
        stored_defaults,
        """SELECT o_orderkey, o_orderkey % 4 = 0 AS completed, CASE WHEN o_orderkey % 3 = 0 THEN 'bug' ELSE 'feature' END AS ticket_type,
       CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate ELSE TIMESTAMP '2026-01-01' END AS created_at, true AS token_ok FROM orders""",
    ),
    "project_nested": (
        project_nested,
        """SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey)::INT AS n_tasks, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS tasks
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    ),
    "latest_per_key": (latest_per_key, "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey"),
    "unique_violation": (unique_violation, "SELECT s_suppkey AS request, n AS name, EXISTS (SELECT 1 FROM customer WHERE c_name = n) AS taken FROM (SELECT s_suppkey, 'Customer#' || lpad((s_suppkey * 31)::VARCHAR, 9, '0') AS n FROM supplier)"),
    "mask_email": (
        mask_email,
        """SELECT c_custkey, email, CASE WHEN p <= 1 THEN email WHEN p <= 3 THEN substr(email, 1, 1) || '*' || substr(email, p) ELSE substr(email, 1, 2) || repeat('*', p - 3) || substr(email, p) END AS masked
FROM (SELECT c_custkey, email, instr(email, '@') AS p FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a@example.com' WHEN 1 THEN 'ab@example.com' WHEN 2 THEN 'no address' WHEN 3 THEN '@example.com' ELSE c_name || '@x@example.com' END AS email FROM customer))""",
    ),
    "feed_urls": (feed_urls, "SELECT c_custkey, 'https://tasks.example/feed/' || md5(c_name) || '.ics' AS url, 'webcal://tasks.example/feed/' || md5(c_name) || '.ics' AS webcal, md5(c_name) AS token FROM customer"),
    "profiles_created": (profiles_created, "SELECT c_custkey AS user_id, md5(c_name) AS token, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS created FROM customer"),
    "row_writes": (
        row_writes,
        """SELECT c_custkey, c_name, CASE WHEN c_custkey % 12 = 6 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT -c_custkey - 1, c_name, 'CHANGED' FROM customer WHERE c_custkey % 12 = 0""",
    ),
    "cascade_delete": (
        cascade_delete,
        """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))
SELECT 'orders' AS table_name, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""",
    ),
    "admin_search": (admin_search, "SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND (contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1'))"),
    "admin_search_indexed": (admin_search_indexed, "SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND (contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1'))"),
    "text_search_indexed": (text_search_indexed, "SELECT doc_id, source FROM documents WHERE (contains(lower(text), 'whst') OR contains(lower(source), 'whst')) AND (contains(lower(text), 'retition') OR contains(lower(source), 'retition'))"),
    "admin_facet": (admin_facet, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= '1998-01-01' AND o_orderdate < '1999-01-01'"),
    "csv_roundtrip": (csv_roundtrip, "SELECT * FROM nation"),
    "json_roundtrip": (json_roundtrip, "SELECT p_partkey, p_size, CASE WHEN p_size > 10 THEN p_name END AS p_name FROM part"),
    "append_rows": (append_rows, "SELECT s_nationkey, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT s_nationkey FROM supplier) GROUP BY s_nationkey"),
    "subtasks_json": (
        subtasks_json,
        """SELECT event_id, valid, CASE WHEN valid THEN 'T' || k END AS title, CASE WHEN valid THEN '' END AS description, CASE WHEN valid THEN CASE WHEN event_id % 3 = 0 THEN 'bug' ELSE 'feature' END END AS ticket_type,
       CASE WHEN valid THEN false END AS completed, CASE WHEN valid THEN CASE WHEN event_id % 2 = 0 THEN 's' || k || '+,t-' ELSE '' END END AS subtasks
FROM (SELECT event_id, event_id % 7 <> 0 AND event_id % 9 <> 0 AS valid, json_extract_string(props, '$.k') AS k FROM events)""",
    ),
    "generation_response": (
        generation_response,
        """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'model-' || lower(c_mktsegment) END AS rag_model, c_custkey % 2 = 0 AS ast_outline_used, CASE WHEN c_custkey % 2 = 0 THEN substr(repeat(c_name, 40), 1, 500) ELSE '' END AS preview FROM customer""",
    ),
    "prompts": (
        prompts,
        """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '--- REPOSITORY OUTLINE ---' || chr(10) || c_name || chr(10) || chr(10) ELSE '' END || 'Time zone: Asia/Kolkata' || chr(10) || 'Current date and time: '
       || strftime(make_timestamp((1700000000 + c_custkey * 86400 + 19800) * 1000000), '%A, %Y-%m-%d %H:%M:%S') || ' +0530' || chr(10) || chr(10) || 'RULES' || chr(10) || chr(10) || 'User Input: ' || c_mktsegment AS prompt FROM customer""",
    ),
}
