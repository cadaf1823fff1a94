"""Owner-scoped reads, nesting, latest rows, searches and writes of the task tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def owned_by(rows: DataFrame, owner: int, column: str = "owner_id") -> DataFrame:
    return rows.filter(F.col(column) == owner)


def active_with_deadline(tasks: DataFrame, due: str = "due_date", completed: Column | None = None) -> DataFrame:
    """Open tasks with a deadline; both conditions reach the scan."""
    return tasks.filter(F.col(due).isNotNull() & ~(F.col("completed") if completed is None else completed))


def nest_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, item: Column, name: str) -> DataFrame:
    """parents with a sorted array of their children's items, empty where there are none.

    A parent's items are one row, so this is for parents with a bounded number of children; child_rows
    gives the same as rows.
    """
    lists = children.groupBy(F.col(child_key).alias("__parent")).agg(F.sort_array(F.collect_list(item)).alias(name))
    joined = parents.join(lists, F.col(parent_key) == F.col("__parent"), "left").drop("__parent")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def child_rows(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """parents with a row for each child, and one with nulls where there is none; nothing is gathered."""
    return parents.join(children, F.col(parent_key) == F.col(child_key), "left")


def with_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """children with their parent's columns; those without a parent go."""
    return children.join(parents, F.col(child_key) == F.col(parent_key))


class NotFound(LookupError):
    """No row, or several, where one was asked for."""


def get_one(rows: DataFrame, condition: Column) -> Row:
    """The one row that meets condition; anything else raises NotFound. Two rows at most come to the driver."""
    found = rows.filter(condition).limit(2).collect()
    if len(found) != 1:
        raise NotFound(f"{'no row' if not found else 'several rows'} for {condition}")
    return found[0]


def first_row(rows: DataFrame, *order: str) -> DataFrame:
    """The first row by the order, or none."""
    return rows.orderBy(*order).limit(1)


def listing(rows: DataFrame, columns: tuple[str, ...], terms: str = "", searched: tuple[str, ...] = (), facets: dict[str, object] | None = None) -> DataFrame:
    """An administrative list: its columns of the rows that have the facets' values and contain every search term."""
    for name, value in (facets or {}).items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    return search(rows, terms, *searched).select(*columns)


def public_user(users: DataFrame, tasks: DataFrame, user_key: str, name: str, task_key: str, owner_key: str) -> DataFrame:
    """id, username, tasks (sorted ids) of users; a user's task ids are one array, as the projection has them."""
    nested = nest_children(users.select(F.col(user_key).alias("id"), F.col(name).alias("username")), tasks, "id", owner_key, F.col(task_key), "tasks")
    return nested.select("id", "username", "tasks")


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by the order, as one aggregate."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return last.select("row.*")


def search(rows: DataFrame, terms: str, *columns: str) -> DataFrame:
    """Rows in which every term is found in some column, without regard to case."""
    found = [reduce(lambda a, b: a | b, [F.lower(c).contains(t) for c in columns]) for t in terms.lower().split()]
    return rows.filter(reduce(lambda a, b: a & b, found)) if found else rows


def taken(rows: DataFrame, candidates: DataFrame, column: str) -> DataFrame:
    """candidates with taken: whether rows hold the value."""
    held = rows.select(F.col(column).alias("__held")).distinct()
    return candidates.join(held, F.col(column) == F.col("__held"), "left").withColumn("taken", F.col("__held").isNotNull()).drop("__held")


def upsert(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored with the rows of changes in place of theirs: what a rewrite of the table holds."""
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_cascade(doomed: DataFrame, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What is left of each child table (rows, foreign key, own key) down a chain when the rows of doomed (one column) go."""
    left, gone = [], doomed
    for rows, foreign, own in children:
        key = gone.columns[0]
        left.append(rows.join(gone, rows[foreign] == gone[key], "left_anti"))
        gone = rows.join(gone, rows[foreign] == gone[key], "left_semi").select(own).distinct()
    return left


def get_or_create(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """existing with the rows of wanted whose key it lacks."""
    return existing.unionByName(wanted.join(existing.select(key), key, "left_anti"))


def public_project(projects: DataFrame) -> DataFrame:
    """Projects without the secret column."""
    return projects.drop("github_token")
