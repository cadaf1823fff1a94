"""Class and function blocks of source files.

Python files go through the standard library's parser, or by indentation where they are broken, one at a time in
tasks; the brace languages through tables of lexemes. Both are stand-ins for a grammar-based parser, so block
borders may differ where code is broken or unusual.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import dealt
from .folds import PIECE_ROWS, EnclosingFold, fold_files
from .lexemes import LANGUAGES, extract_lexeme_blocks

#: (symbol type, name, first line, last line)
Found = tuple[str, str, int, int]
Extractor = Callable[[str], list[Found]]

def python_blocks(code: str) -> list[Found]:
    """Classes and functions by the standard library's parser, or by indentation where the code does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return indented_blocks(code)
    kinds = {ast.ClassDef: "Class", ast.FunctionDef: "Function", ast.AsyncFunctionDef: "Function"}
    found = [(kinds[type(n)], n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if type(n) in kinds]
    return sorted(found, key=lambda f: (f[2], -f[3]))


_HEAD = re.compile(r"([ \t]*)(class|(?:async[ \t]+)?def)[ \t]+(\w+)")


def indented_blocks(code: str) -> list[Found]:
    """Heads of classes and functions, each up to the last line with text before one that is not indented further."""
    lines = code.splitlines()
    depths = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    out = []
    for at, line in enumerate(lines):
        if m := _HEAD.match(line):
            end = at
            for k in range(at + 1, len(lines)):
                if depths[k] is not None:
                    if depths[k] <= len(m[1]):
                        break
                    end = k
            out.append(("Class" if m[2] == "class" else "Function", m[3], at + 1, end + 1))
    return out


#: Extractors that run in tasks. Files of the brace languages that none is given for go through tables of lexemes.
EXTRACTORS: dict[str, Extractor] = {".py": python_blocks}


def extract_blocks(files: DataFrame, path_col: str = "filepath", code_col: str = "code", extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """filepath, symbol_type, start_line, end_line, code (whole lines), name and pos of each block, one file at a time.

    Files are dealt out first: a few small partitions of input can be the code of many files.
    """
    known = extractors or EXTRACTORS

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, code in zip(frame["filepath"], frame["code"], strict=True):
                extractor = known.get(os.path.splitext(path or "")[1])
                lines = (code or "").splitlines()
                for pos, (kind, name, start, end) in enumerate(extractor(code) if extractor and code else []):
                    rows.append((path, kind, start, end, "\n".join(lines[start - 1 : end]), name, pos))
            yield pd.DataFrame(rows, columns=["filepath", "symbol_type", "start_line", "end_line", "code", "name", "pos"])

    chosen = files.select(F.col(path_col).alias("filepath"), F.col(code_col).alias("code")).filter(text.language(F.col("filepath")).isNotNull())
    ending = text.file_extension(F.col("filepath"))
    in_tasks = dealt(chosen.filter(ending.isin(*known))).mapInPandas(extract, "filepath string, symbol_type string, start_line int, end_line int, code string, name string, pos int")
    return in_tasks.unionByName(extract_lexeme_blocks(chosen.filter(ending.isin(*(e for e in LANGUAGES if e not in known)))))


def with_enclosing(rows: DataFrame, signature: Column, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows (filepath, symbol_type, start_line, end_line, pos, ...) with enclosing: the signature of the outermost class around each, '' for none.

    Classes without a signature count for nothing; of classes over the same lines the smallest signature counts. A
    null path is ''. Rows are swept by their starts, over files of any size; see folds.
    """
    named = rows.withColumn("class_signature", F.when(F.col("symbol_type") == "Class", signature))
    order = [F.col("start_line"), F.col("end_line").desc(), F.col("class_signature").isNull(), F.col("class_signature"), F.col("pos")]
    return fold_files(named, F.coalesce("filepath", F.lit("")), order, EnclosingFold(), piece_rows).drop("class_signature")


def enclosing_classes(blocks: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """blocks with enclosing, from their code; see with_enclosing."""
    return with_enclosing(blocks, text.enclosing_signature(F.col("code")), piece_rows)
