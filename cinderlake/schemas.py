"""Schemas of the JSON that comes in."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


_text, _bool = T.StringType(), T.BooleanType()

SUBTASKS = T.ArrayType(_schema(("title", _text), ("completed", _bool)))
TASK_CREATE = _schema(("title", _text), ("description", _text), ("ticket_type", _text), ("due_date", _text), ("completed", _bool), ("subtasks", SUBTASKS))
TREE = _schema(("tree", T.ArrayType(_schema(("path", _text), ("type", _text)))))
TICKET_TYPES = ("bug", "feature", "chore")
