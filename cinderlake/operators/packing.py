"""Token-bounded chunks: slices of long texts, guardrails for one block, and elastic packs of blocks.

Token counts and arrays of tokens come in as columns, or through a text.Tokenizer, so any tokenizer fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkingConfig
from ..functions import text
from ..session import dealt, materialize, unsent
from .blocks import with_enclosing
from .folds import PIECE_ROWS, PackFold, fold_files

DEFAULT = ChunkingConfig()
#: Tokens of blocks whose packs are one partition.
PART_WORDS = 2_000_000


def token_slices(rows: DataFrame, tokens_col: str = "tokens", config: ChunkingConfig = DEFAULT) -> DataFrame:
    """A row for each window of slice_tokens tokens, the next one beginning slice_overlap before the end: slice_no from 1, slice."""
    step = config.slice_tokens - config.slice_overlap
    n = config.slices(F.size(tokens_col))
    numbered = rows.withColumn("slice_no", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    return numbered.withColumn("slice", F.slice(tokens_col, (F.col("slice_no") - 1) * step + 1, F.lit(config.slice_tokens)))


def guardrails(blocks: DataFrame, tokens_col: str = "tokens", config: ChunkingConfig = DEFAULT) -> DataFrame:
    """Single blocks: dropped under the floor, whole up to a slice, else sliced into parts named '(Part i)'."""
    enough = blocks.filter(F.size(tokens_col) >= config.floor_tokens)
    whole = enough.filter(F.size(tokens_col) <= config.slice_tokens)
    whole = whole.withColumn("slice_no", F.lit(1)).withColumn("slice", F.col(tokens_col))
    parts = token_slices(enough.filter(F.size(tokens_col) > config.slice_tokens), tokens_col, config)
    parts = parts.withColumn("symbol_type", F.concat("symbol_type", F.lit(" (Part "), F.col("slice_no").cast("string"), F.lit(")")))
    return whole.unionByName(parts)


def assign_packs(blocks: DataFrame, config: ChunkingConfig = DEFAULT, file_col: str = "filepath", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """blocks (file_col, symbol_type, start_line, end_line, pos, n_tokens, ...) with place in the file, pack, chunk (chunks of the packs before), single_class and oversized.

    A file with one class among several blocks, and that class within the ceiling, keeps the class
    only. Else classes go unless there is nothing else. Blocks fold in the order of start, then the
    larger end, then pos, over files of any size; see folds. A null path is the file ''. Blocks without their
    code are cheaper to move.
    """
    is_class, file = F.col("symbol_type") == "Class", F.coalesce(F.col(file_col), F.lit(""))
    facts = blocks.groupBy(file.alias("__of")).agg(F.count_if(is_class).alias("__classes"), F.count("*").alias("__all"), F.max(F.when(is_class, F.col("n_tokens"))).alias("__tokens"))
    single = (F.col("__classes") == 1) & (F.col("__all") > 1) & config.keeps_class_whole(F.col("__tokens"))
    chosen = blocks.join(unsent(facts), file == F.col("__of")).withColumn("single_class", F.coalesce(single, F.lit(False)))
    chosen = chosen.filter(F.when(F.col("single_class"), is_class).otherwise(F.coalesce(~is_class, F.lit(True)) | (F.col("__classes") == F.col("__all"))))
    chosen = chosen.drop("__of", "__classes", "__all", "__tokens")
    placed = fold_files(chosen, file, [F.col("start_line"), F.col("end_line").desc(), F.col("pos")], PackFold(config), piece_rows)
    return placed.withColumn("oversized", config.is_oversized(F.col("n_tokens")) & ~F.col("single_class"))


def pack_chunks(blocks: DataFrame, config: ChunkingConfig = DEFAULT, tokenizer: text.Tokenizer = text.WORDS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Chunks of blocks (filepath, symbol_type, start_line, end_line, code, pos): filepath, chunk_no, start_line, end_line, symbol_type, text, token_count.

    A pack's code is joined by empty lines under one header, its types are named in the order they
    appear, and its lines reach from its first block's first to its last block's last. What is left at
    the end of a file is stitched to the chunk before if both fit the ceiling; that chunk's header and
    type stay as they were. pos tells a file's blocks apart; a null code counts as empty, and a null path as ''.
    Blocks are counted once, swept and folded without their code, and meet it again in one join. No task
    holds a whole file: merged joins on a path read its rows without code in order, from disk where they are many.
    """
    code = F.coalesce("code", F.lit(""))
    blocks = blocks.withColumn("filepath", F.coalesce("filepath", F.lit("")))
    signature = F.when(F.col("symbol_type") == "Class", text.enclosing_signature(code))
    narrow = materialize(blocks.select("filepath", "pos", "symbol_type", "start_line", "end_line", tokenizer.count(code).alias("n_tokens"), signature.alias("signature")), "blocks")
    named = with_enclosing(narrow, F.col("signature"), piece_rows).drop("signature")
    packed = materialize(assign_packs(named, config, piece_rows=piece_rows), "packs")
    size = F.when(F.col("oversized"), F.greatest(config.slices(F.col("n_tokens")), F.lit(1))).otherwise(F.lit(1))
    sizes = packed.groupBy(F.col("filepath").alias("of")).agg(F.max(F.col("chunk") + size).alias("n_chunks"))
    coded = packed.join(unsent(sizes), F.col("filepath") == F.col("of")).drop("of").join(unsent(blocks.select("filepath", "pos", code.alias("code"))), ["filepath", "pos"])
    words = narrow.agg(F.sum("n_tokens")).first()[0] or 0
    coded = dealt(coded, "filepath", "pack", parts=-(-words // PART_WORDS))  # headers and counts below take long for few bytes
    one = F.struct("place", "symbol_type", "start_line", "end_line", "code", "enclosing", "n_tokens", "oversized", "single_class")
    packs = coded.groupBy("filepath", "pack").agg(F.first("chunk").alias("chunk"), F.first("n_chunks").alias("n_chunks"), F.sort_array(F.collect_list(one)).alias("b"))  # code of a pack is bounded, or one block
    first, last = F.col("b")[0], F.element_at("b", -1)
    types = F.array_join(F.array_distinct(F.transform("b", lambda x: x["symbol_type"])), " & ")
    packs = packs.select(
        "filepath", "chunk", "n_chunks", first["start_line"].alias("start_line"), last["end_line"].alias("end_line"), first["oversized"].alias("oversized"), first["symbol_type"].alias("base_type"),
        F.when(first["single_class"], F.lit("")).otherwise(first["enclosing"]).alias("enclosing"),
        F.concat(types, F.when(F.size("b") > 1, F.lit(" (Group)")).otherwise(F.lit(""))).alias("symbol_type"),
        F.array_join(F.transform("b", lambda x: x["code"]), "\n\n").alias("code"),
    )
    head = lambda kind: text.chunk_header(F.col("filepath"), F.col(kind), F.col("start_line"), F.col("end_line"), F.col("enclosing"))
    tokens = tokenizer.tokens(F.col("code"))
    n_parts = F.when(F.col("oversized"), config.slices(F.size(tokens))).otherwise(F.lit(1))
    sliced = packs.withColumn("tokens", F.when(F.col("oversized"), tokens)).withColumn("part", F.explode(F.sequence(F.lit(1), F.greatest(n_parts, F.lit(1)))))
    step = config.slice_tokens - config.slice_overlap
    piece = F.slice("tokens", (F.col("part") - 1) * step + 1, F.lit(config.slice_tokens))
    chunks = sliced.select(
        "filepath", (F.col("chunk") + F.col("part")).alias("chunk_no"), "n_chunks", "start_line", "end_line", (~F.col("oversized")).alias("foldable"),
        F.when(F.col("oversized"), F.concat("base_type", F.lit(" (Part "), F.col("part").cast("string"), F.lit(")"))).otherwise(F.col("symbol_type")).alias("symbol_type"),
        F.when(F.col("oversized"), head("base_type")).otherwise(head("symbol_type")).alias("header"),
        F.when(F.col("oversized"), tokenizer.join(piece)).otherwise(F.col("code")).alias("code"),
        F.when(F.col("oversized"), F.size(piece)).otherwise(tokenizer.count(F.col("code"))).alias("token_count"),
    )
    return _stitched(chunks, config)


def _stitched(chunks: DataFrame, config: ChunkingConfig) -> DataFrame:
    """Joins a file's last pack to the chunk before it where both fit; only a file's last two chunks come together."""
    tail = F.when(F.col("chunk_no") < F.col("n_chunks") - 1, F.col("chunk_no")).otherwise(0)
    order = Window.partitionBy("filepath", "tail").orderBy("chunk_no")
    before = F.lag("token_count").over(order)
    joins = (F.col("chunk_no") == F.col("n_chunks")) & F.col("foldable") & before.isNotNull() & config.can_stitch(before, F.col("token_count"))
    numbered = chunks.withColumn("tail", tail).withColumn("joins", F.coalesce(joins, F.lit(False)))
    taken = lambda c: F.when(F.lead("joins").over(order), F.lead(c).over(order))
    out = numbered.withColumns({"more_code": taken("code"), "more_end": taken("end_line"), "more_tokens": taken("token_count")})
    body = F.concat("header", "code", F.coalesce(F.concat(F.lit("\n\n"), "more_code"), F.lit("")))
    return out.filter("not joins").select("filepath", "chunk_no", "start_line", F.coalesce("more_end", "end_line").alias("end_line"), "symbol_type", body.alias("text"), (F.col("token_count") + F.coalesce("more_tokens", F.lit(0))).alias("token_count"))
