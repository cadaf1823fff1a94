"""Calendar events of tasks, and feeds of them as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each feed says before its events, with the name and the description it is given.
FRAME = ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//cinderlake//Tasks Feed//EN")
REFRESH = ("X-PUBLISHED-TTL:PT1H", "REFRESH-INTERVAL;VALUE=DURATION:PT1H")


def description(project: Column, text: Column, subtasks: Column) -> Column:
    """Lines for the project, the description and the subtasks, each only where there is one."""
    some = lambda c: F.nullif(c, F.lit(""))
    item = F.transform(subtasks, lambda s: F.concat(F.when(F.coalesce(s["completed"], F.lit(False)), F.lit("  [x] ")).otherwise(F.lit("  [ ] ")), F.coalesce(s["title"], F.lit(""))))
    items = F.when(F.size(subtasks) > 0, F.concat(F.lit("Subtasks:\n"), F.array_join(item, "\n")))
    return F.concat_ws("\n", F.concat(F.lit("Project: "), project), F.concat(F.lit("Description: "), some(text)), items)


def events(tasks: DataFrame, user_id: Column, now: Column) -> DataFrame:
    """Events of tasks (id, title, due_date, created_at, ticket_type, project_name, description, subtasks) of a user, stamped with now.

    An empty ticket type leaves an empty category before TASK; a null one leaves TASK alone.
    """
    kind = F.upper(F.nullif(F.col("ticket_type"), F.lit("")))
    return tasks.select(
        user_id.alias("user_id"),
        F.concat(F.lit("task-"), F.col("id").cast("string"), F.lit("-"), user_id.cast("string"), F.lit("@taskapp.local")).alias("uid"),
        F.concat(F.coalesce(F.concat(F.lit("["), kind, F.lit("] ")), F.lit("")), "title").alias("summary"),
        F.col("due_date").alias("dtstart"),
        (F.col("due_date") + F.expr("interval 1 hour")).alias("dtend"),
        now.alias("dtstamp"),
        F.col("created_at").alias("created"),
        F.concat_ws(",", F.upper("ticket_type"), F.lit("TASK")).alias("categories"),
        F.lit("CONFIRMED").alias("status"),
        description(F.col("project_name"), F.col("description"), F.col("subtasks")).alias("description"),
    )


def escaped(text: Column) -> Column:
    """text as RFC 5545 writes it in a property."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\;,])", r"\\$1"), r"\r?\n", r"\\n")


def folded(line: Column) -> Column:
    """A line of at most 75 octets, the rest on lines that a blank begins; characters stay whole."""
    by_character = F.when(F.octet_length(line) == F.length(line), F.regexp_replace(line, r"(.{74})(?=.)", "$1\r\n ")).otherwise(F.regexp_replace(line, r"(.{18})(?=.)", "$1\r\n "))
    return F.when(F.octet_length(line) <= 75, line).otherwise(by_character)


def ical_event(rows: DataFrame) -> DataFrame:
    """rows of events with value, the text of each VEVENT."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    own = {"UID": F.col("uid"), "SUMMARY": escaped(F.col("summary")), "DTSTART": stamp("dtstart"), "DTEND": stamp("dtend"), "DTSTAMP": stamp("dtstamp"), "CREATED": stamp("created"), "CATEGORIES": F.col("categories"), "STATUS": F.col("status"), "DESCRIPTION": escaped(F.col("description"))}
    lines = [folded(F.concat(F.lit(f"{name}:"), value)) for name, value in own.items()]
    return rows.withColumn("value", F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), *lines, F.lit("END:VEVENT")))


def feeds(users: DataFrame, rows: DataFrame) -> DataFrame:
    """user_id, value: one iCalendar text for each of users (user_id, username), its events by deadline; a user without any has the frame alone.

    A feed is one text, so a user's events meet in one row, as they do in the file that is served.
    """
    one = F.struct("dtstart", "uid", "value")
    texts = ical_event(rows).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda e: e["value"]).alias("texts"))
    name = lambda key, value: folded(F.concat(F.lit(f"{key}:"), value))
    head = [*map(F.lit, FRAME), name("X-WR-CALNAME", F.concat(escaped(F.col("username")), F.lit("'s Tasks"))), name("X-WR-CALDESC", F.lit("Active tasks and deadlines")), *map(F.lit, REFRESH)]
    body = F.concat_ws("\r\n", *head, F.array_join("texts", "\r\n"), F.lit("END:VCALENDAR"))
    return users.join(texts, "user_id", "left").select("user_id", F.concat(body, F.lit("\r\n")).alias("value"))


def write_feeds(feed: DataFrame, path: str) -> None:
    """Text files under a folder for each user."""
    feed.select("user_id", "value").write.partitionBy("user_id").text(path)
