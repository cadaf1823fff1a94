"""From a repository tree to the source files worth indexing, and their outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

FILE_LIMIT = 30
#: What a sync says.
NO_FILES, NO_SYMBOLS, SUCCESS = "Failed to fetch files or repository is empty.", "No functions or classes found in the repository.", "Sync successful"


def tree_entries(trees: DataFrame, json_col: str = "json") -> DataFrame:
    """Rows of trees with pos, path and type of each entry; a missing tree has none."""
    tree = F.from_json(json_col, schemas.TREE)["tree"]
    out = trees.select("*", F.posexplode(tree).alias("pos", "entry"))
    return out.select(*trees.columns, "pos", "entry.path", "entry.type")


def source_files(entries: DataFrame) -> DataFrame:
    """Entries that are blobs with a path worth indexing."""
    return entries.filter((F.col("type") == "blob") & text.is_source_path(F.col("path")))


def first_files(files: DataFrame, key: str, limit: int = FILE_LIMIT) -> DataFrame:
    """The first files of each key in the order of pos, kept before any content is fetched.

    A filter on row_number limits each partition's groups before the shuffle, so a key with very many
    files is not gathered.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos", "path"))
    return files.withColumn("rank", place).filter(F.col("rank") <= limit).drop("rank")


def outline(symbols: DataFrame, key: str, file_col: str = "path", order_col: str = "pos") -> DataFrame:
    """key, ast_outline: for each file its path, its symbols in order and an empty line.

    symbols has a row for each symbol: key, file_col, order_col of the file, symbol_pos, kind and name.
    """
    label = F.when(F.col("kind") == "class", F.concat(F.lit("  class "), "name")).otherwise(F.concat(F.lit("  function "), F.col("name"), F.lit("()")))
    one = F.struct("symbol_pos", label.alias("line"))
    files = symbols.groupBy(key, file_col, order_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda s: s["line"]), "\n").alias("lines"))
    part = F.struct(order_col, F.concat(F.lit("File: "), F.col(file_col), F.lit("\n"), "lines", F.lit("\n")).alias("part"))
    return files.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["part"]), "\n").alias("ast_outline"))


def sync_message(n_files, ast_outline):
    """What a sync says."""
    return F.when(n_files == 0, F.lit(NO_FILES)).when(F.coalesce(ast_outline, F.lit("")) == "", F.lit(NO_SYMBOLS)).otherwise(F.lit(SUCCESS))


def sync_failed(message):
    """Whether a sync message counts as a failure; that no symbols were found does not."""
    return message.contains("Failed") | message.contains("empty")
