"""Generated tickets: the prompt that asks for one, the check of the answer, and the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

#: What the model is told, unless a caller has its own words.
RULES = "Write exactly one developer ticket as a JSON object with title, description, ticket_type (bug, feature or chore), due_date (ISO 8601 with offset, or null), completed and subtasks (title, completed). Name existing files and functions where the outline or the snippets have them."


def prompt(outline: Column, snippets: Column, request: Column, now: Column, zone: str, rules: str = RULES) -> Column:
    """Sections for outline and snippets, each only where there is one, then time, rules and the request."""
    section = lambda title, body: F.coalesce(F.concat(F.lit(f"--- {title} ---\n"), F.nullif(body, F.lit("")), F.lit("\n\n")), F.lit(""))
    time = F.concat(F.lit(f"Time zone: {zone}\nCurrent date and time: "), text.zoned_time(now, zone), F.lit("\n\n"))
    return F.concat(section("REPOSITORY OUTLINE", outline), section("RELEVANT CODE", snippets), time, F.lit(rules + "\n\nUser Input: "), request)


def parse(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """rows with valid, title, description, ticket_type, due_date, completed and subtasks of a ticket in JSON.

    A ticket is valid if it is an object with a title, its type is one of three or missing, and its due
    date is a time or missing. What is missing or null gets its default; an invalid ticket has nulls.
    """
    found = rows.withColumn("__t", F.from_json(F.col(json_col), schemas.TASK_CREATE))
    kind = F.coalesce(F.col("__t.ticket_type"), F.lit("feature"))
    due = F.expr("try_to_timestamp(__t.due_date)")
    valid = F.col("__t.title").isNotNull() & kind.isin(*schemas.TICKET_TYPES) & (F.col("__t.due_date").isNull() | due.isNotNull())
    found = found.withColumn("valid", F.coalesce(valid, F.lit(False)))
    only = lambda c: F.when(F.col("valid"), c)
    items = F.transform(F.coalesce(F.col("__t.subtasks"), F.array().cast(schemas.SUBTASKS)), lambda s: F.struct(s["title"].alias("title"), F.coalesce(s["completed"], F.lit(False)).alias("completed")))
    return found.withColumns(
        {
            "title": only(F.col("__t.title")),
            "description": only(F.coalesce(F.col("__t.description"), F.lit(""))),
            "ticket_type": only(kind),
            "due_date": only(due),
            "completed": only(F.coalesce(F.col("__t.completed"), F.lit(False))),
            "subtasks": only(items),
        }
    ).drop("__t")


def with_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """Task rows as they are stored: declared defaults for what is missing."""
    defaults = {"completed": F.lit(False), "ticket_type": F.lit("feature"), "created_at": now, "subtasks": F.array().cast(schemas.SUBTASKS)}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in defaults.items() if c in rows.columns})


def response(rows: DataFrame) -> DataFrame:
    """rows (is_indexed, embedding_model, ast_outline) with rag_model and ast_outline_used of a generation."""
    used = F.length(F.coalesce("ast_outline", F.lit(""))) > 0
    return rows.withColumns({"rag_model": F.when(F.col("is_indexed"), F.col("embedding_model")), "ast_outline_used": used})


def outline_preview(outline: Column, chars: int = 500) -> Column:
    return F.substring(F.coalesce(outline, F.lit("")), 1, chars)
