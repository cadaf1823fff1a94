"""Blocks of the brace languages from tables of lexemes, in DataFrame functions only.

A file becomes its lexemes, by one pattern that knows comments, quoted text, templates and regular expressions, so
what stands in these counts for nothing. Running sums give each lexeme its line and its depth in parentheses and
in braces; a brace is closed by the next one at its own level. What stands between two ends of statements at one
depth of parentheses, without what is in deeper ones, is a head: it is read by a pattern of its language, and the
brace or semicolon that ends it is where the block's body is.

Known limits: templates nest three deep, and markup text with unpaired quotes is quoted text up to the end of its
line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import dealt, materialize, unsent

#: Characters of code whose lexemes are one partition: those of a corpus are as large whatever its size.
PART_CHARS = 2_000_000
#: Endings of paths, and whose heads their files have.
LANGUAGES = {".js": "script", ".jsx": "script", ".ts": "script", ".tsx": "script", ".java": "java"}

# --- lexemes: possessive throughout, which Java matches without recursion -----------------------

_QUOTED = r""""(?:\\[\s\S]|[^"\\\n])*+"?+|'(?:\\[\s\S]|[^'\\\n])*+'?+"""
_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?+"
_BEFORE_REGEX = r"(?<=(?:^|[(,=:\[!&|?{;+\-*%~^]|=>|\breturn|\btypeof|\bcase)\s{0,40})"
_REGEX = _BEFORE_REGEX + r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*+"


def _template(depth: int) -> str:
    """A template whose expressions hold templates and braces up to a depth."""
    inner = r"[^`{}]" if not depth else rf"[^`{{}}\"'/]|{_COMMENT}|/|{_QUOTED}|{_template(depth - 1)}|{_braces(depth - 1)}"
    return rf"`(?:\\[\s\S]|[^`\\$]|\$(?!\{{)|\$\{{(?:{inner})*+\}})*+`?+"


def _braces(depth: int) -> str:
    inner = r"[^`{}]" if not depth else rf"[^`{{}}\"']|{_QUOTED}|{_template(depth - 1)}|{_braces(depth - 1)}"
    return rf"\{{(?:{inner})*+\}}"


_TEXT_BLOCK = r'"""(?:\\[\s\S]|[^"\\]|"(?!""))*+(?:""")?+'
_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
LEXEME = rf"(?:{_COMMENT}|{_TEXT_BLOCK}|{_QUOTED}|{_template(2)}|{_REGEX}|[@#]?{_NAME}|\p{{N}}[\p{{L}}\p{{N}}_.]*+|=>|[\s\S])\s*+"

# --- heads: lexemes with a blank after each, a line end in front of those that can begin a statement, no parameters

_GENERIC = r"(?:< [^(){};=]*> )?"
_NO_NAME = r"(?!(?:if|for|while|switch|catch|with|function|return|new|typeof|await|yield|do|else|in|of|instanceof|void|delete|super|throw|case|try|synchronized|assert|finally|import|package|this) )"
_NO_TYPE = r"(?!(?:if|for|while|switch|catch|return|new|do|else|instanceof|throw|case|try|synchronized|assert|finally|import|package|class|interface|record|enum) )"
_STATEMENT = r"(?:|.*?\n)"
_CLASS_HEADS = {
    "script": rf"(?s)^({_STATEMENT}(?:export )?(?:default )?)class ({_NAME}) [^;]*$",
    "java": rf"(?s)^({_STATEMENT})(?:\n?@{_NAME} (?:\. {_NAME} )*(?:\) )?|\n?(?:public|protected|private|static|final|abstract|strictfp|sealed) )*\n?(?:class|interface|record) ({_NAME}) [^;]*$",
}
_FUNCTION = rf"(?s)^({_STATEMENT}(?:export )?(?:default )?)(?:async )?function ({_NAME}) {_GENERIC}\) (?:: [^;]*)?$"
_ARROW = rf"(?s)^({_STATEMENT}(?:export )?(?:const|let|var) )({_NAME}) (?:: [^;]*?)?= (?:async )?(?:{_GENERIC}\) (?:: [^;]*?)?|{_NAME} )=> [^;]*$"
_METHOD = rf"(?s)^({_STATEMENT}(?:, )?)(?:(?:public|private|protected|static|async|readonly|override|get|set|accessor|\*) )*{_NO_NAME}([\p{{L}}_$#][\p{{L}}\p{{N}}_$]*+|\"\"|\[ [^\]]*\]) {_GENERIC}\) (?:: [^;]*)?(?<!=> )$"
_JAVA_LEAD = rf"(?s)^({_STATEMENT})(?:\n?@{_NAME} (?:\. {_NAME} )*(?:\) )?|\n?(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp) )*\n?{_GENERIC}"
_JAVA_TYPE = rf"{_NO_TYPE}{_NAME} (?:\. {_NAME} )*{_GENERIC}(?:\[ \] )*\n?"
_JAVA_TAIL = rf"{_NO_NAME}({_NAME}) \) (?:\[ \] )*(?:throws [^;]*)?$"
_JAVA_METHOD, _JAVA_TYPED = rf"{_JAVA_LEAD}(?:{_JAVA_TYPE})?{_JAVA_TAIL}", rf"{_JAVA_LEAD}{_JAVA_TYPE}{_JAVA_TAIL}"

#: Lexemes that go on with what stands before them, and those that want something after them.
_GOES_ON = (")", "=>", ":", "{", "}", ".", ",", ">", "<", "=", "&", "|", "?", ";", "extends", "implements", "throws")
_WANTS_MORE = (".", ",", "=", ":", "<", "&", "|", "?", "=>", "extends", "implements", "throws", "const", "let", "var", "function", "class", "interface", "record", "async", "export", "default", "static")


def lexeme_parts(files: DataFrame) -> int | None:
    """Partitions for the lexemes of files (code), or None where the session's number will do."""
    parts = -(-(files.agg(F.sum(F.length("code").cast("long"))).first()[0] or 0) // PART_CHARS)
    return parts if parts > int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def lexeme_table(files: DataFrame, parts: int | None = None) -> DataFrame:
    """file_no, i, t, line, round (depth in parentheses), level (of a brace), next_line (of its level's next brace), last_line and what else files (file_no, code) have, for their lexemes without comments."""
    own = [c for c in files.columns if c != "code"]
    raw = files.select(*own, F.posexplode(F.regexp_extract_all("code", F.lit(LEXEME), F.lit(0))).alias("i", "raw"))
    raw = raw.select(*own, "i", F.rtrim("raw", F.lit(" \t\n\r\x0b\x0c")).alias("t"), (F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))).alias("breaks"))
    raw = raw.repartition(*([parts] if parts else []), "file_no")  # all windows below are within files
    by_file = Window.partitionBy("file_no").orderBy("i")
    lined = raw.withColumn("line", (F.lit(1) + F.coalesce(F.sum("breaks").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
    inside = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))
    lined = lined.withColumn("last_line", F.max(F.when(F.col("t") != "", F.col("line") + inside)).over(Window.partitionBy("file_no")))
    lined = lined.filter((F.col("t") != "") & ~F.startswith("t", F.lit("//")) & ~F.startswith("t", F.lit("/*")))
    t = F.col("t")
    short = F.when(t.rlike("^[\"']"), F.lit('""')).when(F.startswith(t, F.lit("`")), F.lit("``")).when(F.startswith(t, F.lit("/")) & (F.length(t) > 1), F.lit("/./")).otherwise(t)
    lined = lined.withColumn("t", short)
    step = lambda up, down: F.sum(F.when(t == up, 1).when(t == down, -1).otherwise(0)).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    deep = lined.withColumns({"round": step("(", ")"), "curly": step("{", "}"), "before": F.lag("t").over(by_file), "further": F.lag("t", 2).over(by_file)})
    deep = deep.withColumn("level", F.when(t == "{", F.col("curly")).when(t == "}", F.col("curly") + 1))
    # Braces of types hold no statements: neither they nor what is in them end a head.
    one_of = F.col("before").isin("|", "&") & (F.col("before") != F.coalesce("further", F.lit("")))
    opens = (t == "{") & (F.col("before").isin("extends", "<") | ((F.col("before") == ":") & (F.col("further") == ")")) | one_of)
    deep = deep.withColumn("opens", F.coalesce(opens, F.lit(False)))
    at_level = Window.partitionBy("file_no", "level").orderBy("i")
    deep = deep.withColumns({"closes": F.coalesce((t == "}") & F.lag("opens").over(at_level), F.lit(False)), "next_line": F.lead("line").over(at_level)})
    depth = F.sum(F.col("opens").cast("int") - F.col("closes").cast("int")).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    typed = F.col("closes") | (depth > 0)
    quiet = F.when(typed & (t == "{"), F.lit("\u2039")).when(typed & (t == "}"), F.lit("\u203a")).when(typed & (t == ";"), F.lit(",")).otherwise(t)
    return deep.withColumn("t", quiet).drop("breaks", "curly", "before", "further", "opens", "closes")


def _heads(lexemes: DataFrame) -> DataFrame:
    """file_no, java, starts (i and line of the lexemes of a head), head, ends_with, end_line for what braces and semicolons end."""
    by_file = Window.partitionBy("file_no").orderBy("i")
    t, before = F.col("t"), F.lag("t").over(by_file)
    fresh = (F.col("line") != F.lag("line").over(by_file)) & ~t.isin(*_GOES_ON) & ~F.coalesce(before.isin(*_WANTS_MORE), F.lit(False))
    closed = F.when(t == "{", F.coalesce("next_line", "last_line")).otherwise(F.col("line"))
    rows = lexemes.withColumns({"fresh": F.coalesce(fresh, F.lit(False)), "closed": closed})
    # What was before, at this depth, ends with any of these; an opening parenthesis is at the depth of what it holds.
    same_depth = Window.partitionBy("file_no", "round").orderBy("i")
    ends = t.isin("{", "}", ";", "(")
    rows = rows.withColumns({"g": F.coalesce(F.sum(ends.cast("int")).over(same_depth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "prev": F.lag("t").over(same_depth)})
    one = F.struct("i", "line", "t", "fresh", "closed", "prev")
    groups = rows.groupBy("file_no", "round", "g").agg(F.any_value("java").alias("java"), F.sort_array(F.collect_list(one)).alias("x"))
    last = F.element_at("x", -1)
    groups = groups.filter(last["t"].isin("{", ";") & (F.size("x") > 1) & F.coalesce(F.col("x")[0]["prev"] != "(", F.lit(True)))
    words = F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda r: F.concat(F.when(r["fresh"], F.lit("\n")).otherwise(F.lit("")), r["t"], F.lit(" ")))
    return groups.select("file_no", "java", F.transform("x", lambda r: F.struct(r["i"].alias("i"), r["line"].alias("line"))).alias("starts"), F.array_join(words, "").alias("head"), last["t"].alias("ends_with"), last["closed"].alias("end_line"))


def lexeme_blocks(files: DataFrame, parts: int | None = None) -> DataFrame:
    """file_no, symbol_type, name, start_line, end_line, i (where it starts) of the blocks in files (file_no, path, code) of brace languages."""
    family = F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), text.file_extension(F.col("path")))
    heads = _heads(lexeme_table(files.select("file_no", (family == "java").alias("java"), "code"), parts))
    java, body, head = F.col("java"), F.col("ends_with") == "{", F.col("head")

    def found(kind: str, where: Column, pattern: str) -> Column:
        # Blanks before the block count the lexemes in front of it.
        in_front = F.regexp_extract(head, pattern, 1)
        n = F.length(in_front) - F.length(F.replace(in_front, F.lit(" "), F.lit("")))
        return F.when(where & head.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(head, pattern, 2).alias("name"), n.alias("n")))

    block = F.coalesce(
        found("Class", java & body, _CLASS_HEADS["java"]), found("Function", java & body, _JAVA_METHOD), found("Function", java & ~body, _JAVA_TYPED),
        found("Class", ~java & body, _CLASS_HEADS["script"]), found("Function", ~java & body, _FUNCTION), found("Function", ~java, _ARROW), found("Function", ~java & body, _METHOD),
    )
    # Exploded, so that the patterns run once a head: a filter would run them a second time.
    out = heads.select("file_no", "starts", "end_line", F.explode(F.array_compact(F.array(block))).alias("block")).withColumn("at", F.get("starts", F.col("block.n")))
    return out.select("file_no", F.col("block.kind").alias("symbol_type"), F.col("block.name").alias("name"), F.col("at.line").alias("start_line"), "end_line", F.col("at.i").alias("i"))


def extract_lexeme_blocks(files: DataFrame) -> DataFrame:
    """filepath, symbol_type, start_line, end_line, code (whole lines), name and pos of each block of files (filepath, code) of brace languages; null and empty code has none."""
    numbered = files.filter("filepath is not null and code is not null and code <> ''").select("filepath", "code")
    numbered = materialize(dealt(numbered).withColumn("file_no", F.monotonically_increasing_id()), "files")
    found = lexeme_blocks(numbered.select("file_no", F.col("filepath").alias("path"), "code"), lexeme_parts(numbered))
    found = found.withColumn("pos", F.row_number().over(Window.partitionBy("file_no").orderBy("i", F.col("end_line").desc())) - 1)
    joined = found.join(unsent(numbered), "file_no")
    lines = F.slice(text.split_lines(F.col("code")), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)))
    return joined.select("filepath", "symbol_type", "start_line", "end_line", F.array_join(lines, "\n").alias("code"), "name", "pos")
