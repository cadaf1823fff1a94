"""From paths and texts to hashed, packed and headed chunks.

Documents stand in for files: a line is a block, and every fourth document is also a class of all its
lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, discovery, packing
from ..session import materialize
from ..sources.tables import table

#: Endings that stand-in paths get in turn.
SUFFIXES = (".py", ".JS", "/app.tsx", "_test.py", ".d.ts", "/src/checkout/a.py", "/latest_news.py", "/Main.java", "/.py", "/view.jsx", "/a.min.js", "/migrations/0001.py")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    suffix = F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % len(SUFFIXES)).cast("int"))
    inner = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), r"[./]+$", "")
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.concat(inner, suffix).alias("path"))


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", "path", text.is_source_path(F.col("path")).alias("kept"))


def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf_dir).select("page_id", text.file_extension(path).alias("extension"), text.language(path).alias("language"))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source files of each host, from trees in JSON with a folder before each file."""
    entry = lambda path, kind: F.concat(F.lit('{"path":"'), path, F.lit(f'","type":"{kind}"}}'))
    json = F.concat(F.lit('{"tree":['), entry(F.lit("src/a.py"), "tree"), F.lit(","), entry(F.col("path"), "blob"), F.lit("]}"))
    trees = _paths(spark, sf_dir).select("host", "page_id", json.alias("json")).drop("path")
    found = discovery.source_files(discovery.tree_entries(trees)).withColumn("pos", F.col("page_id") * 2 + F.col("pos"))
    return discovery.first_files(found, "host").select("host", "pos", "path")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = text.content_hash(F.col("source"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("content_hash"), text.chunk_id(F.lit(1), digest).alias("chunk_id"))


def hash_line_shift_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each document under two headers that differ in the lines only."""
    headed = lambda start: F.concat(text.chunk_header(F.col("source"), F.lit("Function"), F.lit(start), F.lit(start + 9)), "text")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    one, two = (text.content_hash(F.col("source"), headed(n)) for n in (1, 50))
    return docs.select("doc_id", one.alias("content_hash"), (one == two).alias("same"))


def chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("doc_id") % 3 == 0, F.lit("class Owner:")).when(F.col("doc_id") % 3 == 1, F.lit(""))
    header = text.chunk_header(F.col("source"), F.lit("Function"), F.col("doc_id"), F.col("doc_id") + 4, owner)
    label = text.chunk_label(F.col("source"), F.col("doc_id"), F.col("doc_id") + 4)
    return table(spark, sf_dir, "documents").select("doc_id", header.alias("header"), label.alias("label"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(text.split_lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("chars"), text.word_count(F.col("line")).alias("words"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, F.lit("Function")).otherwise(F.lit("Class"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("symbol_type"), text.word_tokens(F.col("text")).alias("tokens"))


def _slice_summary(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select("doc_id", *more, "slice_no", F.size("slice").alias("n_tokens"), F.md5(F.array_join("slice", " ")).alias("slice_md5"))


def token_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slice_summary(packing.token_slices(_tokens(spark, sf_dir)))


def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slice_summary(packing.guardrails(_tokens(spark, sf_dir)), "symbol_type")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filepath"), text.split_lines(F.col("text")).alias("lines"))
    kind = F.when(F.col("pos") % 5 == 3, F.lit("Method")).otherwise(F.lit("Function"))
    lines = docs.select("filepath", F.posexplode("lines").alias("pos", "code"))
    lines = lines.select("filepath", kind.alias("symbol_type"), (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 1).alias("end_line"), "code", "pos")
    whole = docs.filter((F.col("doc_id") % 4 == 0) & (F.size("lines") > 0))
    whole = whole.select("filepath", F.lit("Class").alias("symbol_type"), F.lit(1).alias("start_line"), F.size("lines").alias("end_line"), F.array_join("lines", "\n").alias("code"), F.lit(-1).alias("pos"))
    return lines.unionByName(whole)


def pack_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _blocks(spark, sf_dir).withColumn("n_tokens", text.word_count(F.col("code")))
    return packing.assign_packs(counted).select("filepath", "place", "pos", "pack", "oversized", "single_class")


def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_chunks(_blocks(spark, sf_dir))
    return out.select("filepath", F.col("start_line"), "end_line", "symbol_type", "token_count", F.md5("text").alias("text_md5"))


def enclosing_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.enclosing_classes(_blocks(spark, sf_dir)).select("filepath", "pos", "enclosing")


def block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of small Python files, one for each part: a class of p_size % 4 methods, and a function."""
    method = lambda k: F.concat(F.lit("    def m"), k.cast("string"), F.lit("(self):\n        return "), k.cast("string"), F.lit("\n"))
    methods = F.when(F.col("p_size") % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("p_size") % 4, F.lit(1))), method), "")).otherwise(F.lit("    pass\n"))
    code = F.concat(F.lit("class P"), F.col("p_partkey").cast("string"), F.lit(":\n"), methods, F.lit("\ndef last():\n    return 0\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("filepath"), code.alias("code"))
    return blocks.extract_blocks(files).select("filepath", "symbol_type", "name", "start_line", "end_line", F.md5("code").alias("code_md5"))


def _repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python and a JavaScript file for each part, of one class and its methods, with braces and heads in comments and strings; brands stand for repositories."""
    key, n = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    each = lambda make: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), make), "")).otherwise(F.lit(""))
    py = F.concat(F.lit("class P"), key, F.lit(':\n    text = "def no(): {"\n'), each(lambda k: F.concat(F.lit("    def m"), k.cast("string"), F.lit("(self):\n        return 1\n"))))
    js = F.concat(F.lit("// class Not {\nclass J"), key, F.lit(" {\n"), each(lambda k: F.concat(F.lit("  m"), k.cast("string"), F.lit('(x) {\n    return "}";\n  }\n'))), F.lit("}\n"))
    one = lambda name, code, pos: F.struct(F.concat(F.lit("src/"), name).alias("filepath"), code.alias("code"), pos.alias("pos"))
    files = F.array(one(F.concat(F.lit("p"), key, F.lit(".py")), py, F.col("p_partkey") * 2), one(F.concat(F.lit("j"), key, F.lit(".js")), js, F.col("p_partkey") * 2 + 1))
    return table(spark, sf_dir, "part").select("p_brand", F.explode(files).alias("f")).select("p_brand", "f.*")


def typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a TypeScript file for each part: typed methods with a regular expression in each, a template before them and an arrow after."""
    key, n = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    method = lambda k: F.concat(F.lit("  private async m"), k.cast("string"), F.lit('(a: number = f({})): Promise<T[]> {\n    return /[{"]/.test("x"); // {\n  }\n'))
    methods = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), method), "")).otherwise(F.lit(""))
    head = F.concat(F.lit("export class P"), key, F.lit("<T extends { id: number }> {\n  text = `}${`{`}{`;\n"))
    code = F.concat(head, methods, F.lit("}\nexport const f"), key, F.lit(" = async (x: number): Promise<number> => {\n  return x;\n};\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), key, F.lit(".ts")).alias("filepath"), code.alias("code"))
    return blocks.extract_blocks(files).select("filepath", "symbol_type", "name", "start_line", "end_line", "pos")


def repository_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to chunks: extraction, then packs."""
    out = packing.pack_chunks(materialize(blocks.extract_blocks(_repositories(spark, sf_dir)), "extracted"))
    return out.select("filepath", "start_line", "end_line", "symbol_type", "token_count", F.md5("text").alias("text_md5"))


def repository_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to outlines: extraction, then the first files of each repository, symbol by symbol."""
    files = discovery.first_files(_repositories(spark, sf_dir).withColumn("path", F.col("filepath")), "p_brand")
    found = blocks.extract_blocks(files).select("filepath", F.col("pos").alias("symbol_pos"), F.lower("symbol_type").alias("kind"), "name")
    symbols = files.select("p_brand", "path", "pos").join(found, F.col("path") == F.col("filepath"))
    return discovery.outline(symbols, "p_brand").select("p_brand", F.md5("ast_outline").alias("outline_md5"))


def _first_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("pos"), "text")
    return discovery.first_files(files, "source")


def outline_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _first_of_source(spark, sf_dir).select("source", "path", "pos", F.posexplode(text.split_lines(F.col("text"))).alias("symbol_pos", "line"))
    kind = F.when(F.col("symbol_pos") % 3 == 0, F.lit("class")).otherwise(F.lit("function"))
    symbols = lines.select("source", "path", "pos", "symbol_pos", kind.alias("kind"), F.get(text.word_tokens(F.col("line")), F.lit(0)).alias("name")).filter("name is not null")
    out = discovery.outline(symbols, "source")
    # One source more has no files, and one has files without symbols.
    more = spark.createDataFrame([("no files", 0), ("no symbols", 3)], "source string, n_files long")
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.least(F.count("*"), F.lit(discovery.FILE_LIMIT)).alias("n_files")).unionByName(more)
    message = discovery.sync_message(F.col("n_files"), F.col("ast_outline"))
    return counts.join(out, "source", "left").select("source", "ast_outline", F.substring("ast_outline", 1, 500).alias("preview"), message.alias("message"), discovery.sync_failed(message).alias("failed"))


# --- SQL ---------------------------------------------------------------------------------------

_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_NOT_SPACE = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql_lines(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN [] ELSE string_split_regex(regexp_replace({t}, '(?:{_BREAK})$', ''), '{_BREAK}') END"


def _sql_words(t: str) -> str:
    return f"regexp_extract_all({t}, '{_NOT_SPACE}')"


def sql_hash(path: str, t: str) -> str:
    """content_hash in SQL."""
    kept = rf"list_filter({_sql_lines(t)}, lambda x: NOT regexp_matches(x, '^\s*Lines: .*\S'))"
    return f"substr(sha256({path} || '::' || coalesce(array_to_string({kept}, chr(10)), '')), 1, 16)"


def _sql_header(path: str, kind: str, start: str, end: str, owner: str = "''") -> str:
    return f"('File: ' || {path} || chr(10) || CASE WHEN coalesce({owner}, '') = '' THEN '' ELSE 'Class: ' || {owner} || chr(10) END || 'Type: ' || {kind} || chr(10) || 'Lines: ' || {start} || '-' || {end} || chr(10) || repeat('-', 40) || chr(10))"


_SQL_PATHS = f"""paths AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '[./]+$', '') || [{", ".join(f"'{s}'" for s in SUFFIXES)}][page_id % {len(SUFFIXES)} + 1] AS path FROM pages)"""
_KEPT = f"({' OR '.join(f"ends_with(path, '{e}')" for e in text.SOURCE_ENDINGS)}) AND NOT ({' OR '.join(f"contains('/' || ltrim(lower(path), '/'), '{p}')" for p in text.SKIPPED_PATH_PARTS)})"

_SQL_TOKENS = f"""t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Function' ELSE 'Class' END AS kind, {_sql_words("text")} AS w FROM documents WHERE text IS NOT NULL),
slices AS (
  SELECT doc_id, kind, i AS slice_no, list_slice(w, (i - 1) * 448 + 1, (i - 1) * 448 + 512) AS s, len(w) AS n
  FROM t, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(ceil((len(w) - 512) / 448.0), 0)::INT + 2 END)) AS u(i))"""
_SLICE_COLUMNS = "slice_no::INT AS slice_no, len(s)::INT AS n_tokens, md5(array_to_string(s, ' ')) AS slice_md5"

_CLASS_LINE = " OR ".join(f"starts_with(x, '{p}')" for p in text.CLASS_PREFIXES)
_SQL_BLOCKS = rf"""docs AS (SELECT doc_id, source || '/' || doc_id || '.py' AS filepath, {_sql_lines("text")} AS ls FROM documents WHERE text IS NOT NULL),
blocks AS (
  SELECT filepath, CASE WHEN i % 5 = 4 THEN 'Method' ELSE 'Function' END AS kind, i::INT AS start_line, i::INT AS end_line, ls[i] AS code, (i - 1)::INT AS pos
  FROM docs, unnest(range(1, len(ls) + 1)) AS u(i)
  UNION ALL
  SELECT filepath, 'Class', 1, len(ls)::INT, array_to_string(ls, chr(10)), -1 FROM docs WHERE doc_id % 4 = 0 AND len(ls) > 0
), stripped AS (
  SELECT filepath, start_line AS cs, end_line AS ce, list_filter(list_transform({_sql_lines("code")}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l
  FROM blocks WHERE kind = 'Class'
), classes AS (
  SELECT filepath, cs, ce, coalesce(list_filter(l, lambda x: {_CLASS_LINE})[1], l[1]) AS signature FROM stripped
), named AS (
  SELECT b.filepath, b.pos, any_value(b.kind) AS kind, any_value(b.start_line) AS start_line, any_value(b.end_line) AS end_line, any_value(b.code) AS code,
         coalesce(arg_min(c.signature, (c.cs, -c.ce)), '') AS enclosing
  FROM blocks b LEFT JOIN classes c ON b.filepath = c.filepath AND c.cs <= b.start_line AND c.ce >= b.end_line AND c.signature IS NOT NULL
  GROUP BY b.filepath, b.pos
)"""
_SQL_PACKS = f"""sized AS (
  SELECT *, len({_sql_words("code")})::INT AS n,
         count(*) FILTER (WHERE kind = 'Class') OVER f AS n_class, count(*) OVER f AS n_all, max(CASE WHEN kind = 'Class' THEN len({_sql_words("code")}) END) OVER f AS class_tokens
  FROM named WINDOW f AS (PARTITION BY filepath)
), flagged AS (SELECT *, coalesce(n_class = 1 AND n_all > 1 AND class_tokens <= 750, false) AS single FROM sized),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY start_line, end_line DESC, pos) AS k FROM flagged
  WHERE CASE WHEN single THEN kind = 'Class' ELSE kind <> 'Class' OR n_class = n_all END
), fold(filepath, k, pack, cur, opened) AS (
  SELECT filepath, k, 0, n, n <= 750 FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.filepath, o.k, CASE WHEN j THEN f.pack ELSE f.pack + 1 END, CASE WHEN j THEN f.cur + o.n ELSE o.n END, o.n <= 750
  FROM (SELECT f.*, o.n AS next_n, f.opened AND o.n <= 750 AND (f.cur + o.n <= 350 OR (f.cur < 250 AND f.cur + o.n <= 750)) AS j FROM fold f JOIN ordered o ON o.filepath = f.filepath AND o.k = f.k + 1) f
  JOIN ordered o ON o.filepath = f.filepath AND o.k = f.k + 1
), packed AS (SELECT o.*, f.pack, o.n > 750 AND NOT o.single AS oversized FROM ordered o JOIN fold f ON o.filepath = f.filepath AND o.k = f.k)"""

_SQL_REPOSITORIES = """raw AS (SELECT p_brand, p_partkey AS key, p_size % 4 AS n FROM part),
files AS (
  SELECT p_brand, 'src/p' || key || '.py' AS filepath, key * 2 AS pos, n, 'P' || key AS name, 'class P' || key || ':' AS head, 1 AS first, (2 + 2 * n)::INT AS n_lines,
         'class P' || key || ':' || chr(10) || '    text = "def no(): {"' || coalesce((SELECT string_agg(chr(10) || '    def m' || i || '(self):' || chr(10) || '        return 1', '' ORDER BY i) FROM unnest(range(1, n + 1)) AS u(i)), '') AS code FROM raw
  UNION ALL
  SELECT p_brand, 'src/j' || key || '.js', key * 2 + 1, n, 'J' || key, 'class J' || key || ' {', 2, (2 + 3 * n)::INT,
         'class J' || key || ' {' || chr(10) || coalesce((SELECT string_agg('  m' || i || '(x) {' || chr(10) || '    return "}";' || chr(10) || '  }' || chr(10), '' ORDER BY i) FROM unnest(range(1, n + 1)) AS u(i)), '') || '}' FROM raw)"""

QUERIES = {
    "path_filter": (path_filter, f"WITH {_SQL_PATHS} SELECT page_id, path, {_KEPT} AS kept FROM paths"),
    "language_map": (
        language_map,
        rf"""WITH {_SQL_PATHS}, e AS (SELECT page_id, regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1) AS extension FROM paths)
SELECT page_id, extension, CASE extension {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.LANGUAGES.items())} END AS language FROM e""",
    ),
    "tree_files": (
        tree_files,
        f"""WITH {_SQL_PATHS}
SELECT host, pos, path FROM (
  SELECT host, page_id * 2 + 1 AS pos, path, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM paths WHERE {_KEPT})
WHERE k <= 30""",
    ),
    "content_hash": (content_hash, f"SELECT doc_id, {sql_hash('source', 'text')} AS content_hash, 'chunk_1_' || {sql_hash('source', 'text')} AS chunk_id FROM documents"),
    "hash_line_shift_invariant": (
        hash_line_shift_invariant,
        f"""SELECT doc_id, {sql_hash("source", "t")} AS content_hash, true AS same
FROM (SELECT doc_id, source, {_sql_header("source", "'Function'", "1", "10")} || text AS t FROM documents WHERE text IS NOT NULL)""",
    ),
    "chunk_header": (
        chunk_header,
        f"SELECT doc_id, {_sql_header('source', "'Function'", 'doc_id', '(doc_id + 4)', "CASE WHEN doc_id % 3 = 0 THEN 'class Owner:' ELSE '' END")} AS header, source || ':' || doc_id || '-' || (doc_id + 4) AS label FROM documents",
    ),
    "line_blocks": (
        line_blocks,
        f"""SELECT doc_id, i::INT AS line_no, length(ls[i])::INT AS chars, len({_sql_words("ls[i]")})::INT AS words
FROM (SELECT doc_id, {_sql_lines("text")} AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)""",
    ),
    "token_slices": (token_slices, f"WITH {_SQL_TOKENS} SELECT doc_id, {_SLICE_COLUMNS} FROM slices"),
    "guardrails": (
        guardrails,
        f"""WITH {_SQL_TOKENS}
SELECT doc_id, kind || CASE WHEN n <= 512 THEN '' ELSE ' (Part ' || slice_no || ')' END AS symbol_type, {_SLICE_COLUMNS} FROM slices WHERE n >= 15""",
    ),
    "enclosing_block": (enclosing_block, f"WITH {_SQL_BLOCKS} SELECT filepath, pos, enclosing FROM named"),
    "pack_fold": (
        pack_fold,
        f"WITH RECURSIVE {_SQL_BLOCKS}, {_SQL_PACKS} SELECT filepath, (k - 1)::INT AS place, pos, pack::INT AS pack, oversized, single AS single_class FROM packed",
    ),
    "pack_chunks": (
        pack_chunks,
        f"""WITH RECURSIVE {_SQL_BLOCKS}, {_SQL_PACKS},
grouped AS (
  SELECT filepath, pack, arg_min(start_line, k) AS start_line, arg_max(end_line, k) AS end_line, bool_or(oversized) AS oversized,
         CASE WHEN bool_or(single) THEN '' ELSE arg_min(enclosing, k) END AS enclosing, arg_min(kind, k) AS base, count(*) AS n_blocks,
         list(kind ORDER BY k) AS kinds, string_agg(code, chr(10) || chr(10) ORDER BY k) AS code
  FROM packed GROUP BY filepath, pack
), typed AS (
  SELECT *, array_to_string(list_filter(kinds, lambda x, i: list_position(kinds, x) = i), ' & ') || CASE WHEN n_blocks > 1 THEN ' (Group)' ELSE '' END AS kind, {_sql_words("code")} AS w FROM grouped
), chunks AS (
  SELECT filepath, pack, 1 AS part, start_line, end_line, kind AS symbol_type, {_sql_header("filepath", "kind", "start_line", "end_line", "enclosing")} AS header, code, len(w)::INT AS tokens, true AS foldable
  FROM typed WHERE NOT oversized
  UNION ALL
  SELECT filepath, pack, i, start_line, end_line, base || ' (Part ' || i || ')', {_sql_header("filepath", "base", "start_line", "end_line", "enclosing")},
         array_to_string(list_slice(w, (i - 1) * 448 + 1, (i - 1) * 448 + 512), ' '), len(list_slice(w, (i - 1) * 448 + 1, (i - 1) * 448 + 512))::INT, false
  FROM typed, unnest(range(1, greatest(ceil((len(w) - 512) / 448.0), 0)::INT + 2)) AS u(i) WHERE oversized
), joined AS (
  SELECT *, foldable AND lead(pack) OVER f IS NULL AND coalesce(lag(tokens) OVER f + tokens <= 750, false) AS joins FROM chunks WINDOW f AS (PARTITION BY filepath ORDER BY pack, part)
), stitched AS (
  SELECT *, lead(joins) OVER f AS takes, lead(code) OVER f AS more_code, lead(end_line) OVER f AS more_end, lead(tokens) OVER f AS more_tokens FROM joined WINDOW f AS (PARTITION BY filepath ORDER BY pack, part)
)
SELECT filepath, start_line, CASE WHEN takes THEN more_end ELSE end_line END AS end_line, symbol_type, (tokens + CASE WHEN takes THEN more_tokens ELSE 0 END)::INT AS token_count,
       md5(header || code || CASE WHEN takes THEN chr(10) || chr(10) || more_code ELSE '' END) AS text_md5
FROM stitched WHERE NOT joins""",
    ),
    "block_extraction": (
        block_extraction,
        """WITH p AS (SELECT 'parts/' || p_partkey || '.py' AS filepath, p_partkey AS key, p_size % 4 AS n FROM part),
methods AS (SELECT filepath, 'Function' AS symbol_type, 'm' || i AS name, (2 * i)::INT AS start_line, (2 * i + 1)::INT AS end_line,
                   '    def m' || i || '(self):' || chr(10) || '        return ' || i AS code FROM p, unnest(range(1, n + 1)) AS u(i)),
classes AS (SELECT p.filepath, 'Class', 'P' || key, 1, (CASE WHEN n = 0 THEN 2 ELSE 2 * n + 1 END)::INT,
                   'class P' || key || ':' || chr(10) || coalesce((SELECT string_agg(code, chr(10) ORDER BY start_line) FROM methods m WHERE m.filepath = p.filepath), '    pass') FROM p),
functions AS (SELECT filepath, 'Function', 'last', (CASE WHEN n = 0 THEN 4 ELSE 2 * n + 3 END)::INT, (CASE WHEN n = 0 THEN 5 ELSE 2 * n + 4 END)::INT, 'def last():' || chr(10) || '    return 0' FROM p)
SELECT filepath, symbol_type, name, start_line, end_line, md5(code) AS code_md5
FROM (SELECT * FROM methods UNION ALL SELECT * FROM classes UNION ALL SELECT * FROM functions)""",
    ),
    "typed_blocks": (
        typed_blocks,
        """WITH p AS (SELECT 'parts/' || p_partkey || '.ts' AS filepath, p_partkey AS key, (p_size % 4)::INT AS n FROM part)
SELECT filepath, 'Class' AS symbol_type, 'P' || key AS name, 1 AS start_line, 3 * n + 3 AS end_line, 0 AS pos FROM p
UNION ALL SELECT filepath, 'Function', 'm' || i, (3 * i)::INT, (3 * i + 2)::INT, i::INT FROM p, unnest(range(1, n + 1)) AS u(i)
UNION ALL SELECT filepath, 'Function', 'f' || key, 3 * n + 4, 3 * n + 6, n + 1 FROM p""",
    ),
    "repository_chunks": (
        repository_chunks,
        f"""WITH {_SQL_REPOSITORIES}
SELECT filepath, first AS start_line, (first + n_lines - 1)::INT AS end_line, 'Class' AS symbol_type, len({_sql_words("code")})::INT AS token_count,
       md5('File: ' || filepath || chr(10) || 'Type: Class' || chr(10) || 'Lines: ' || first || '-' || (first + n_lines - 1) || chr(10) || repeat('-', 40) || chr(10) || code) AS text_md5
FROM files WHERE n > 0
UNION ALL
SELECT filepath, first, (first + n_lines - 1)::INT, 'Class', len({_sql_words("code")})::INT,
       md5('File: ' || filepath || chr(10) || 'Class: ' || head || chr(10) || 'Type: Class' || chr(10) || 'Lines: ' || first || '-' || (first + n_lines - 1) || chr(10) || repeat('-', 40) || chr(10) || code)
FROM files WHERE n = 0""",
    ),
    "repository_outline": (
        repository_outline,
        f"""WITH {_SQL_REPOSITORIES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS k FROM files),
parts AS (SELECT p_brand, pos, 'File: ' || filepath || chr(10) || '  class ' || name || chr(10) || coalesce((SELECT string_agg('  function m' || i || '()' || chr(10), '' ORDER BY i) FROM unnest(range(1, n + 1)) AS u(i)), '') AS part FROM ranked WHERE k <= 30)
SELECT p_brand, md5(string_agg(part, chr(10) ORDER BY pos)) AS outline_md5 FROM parts GROUP BY p_brand""",
    ),
    "outline_agg": (
        outline_agg,
        f"""WITH files AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
symbols AS (SELECT source, doc_id, i, {_sql_words("ls[i]")}[1] AS name FROM (SELECT source, doc_id, {_sql_lines("text")} AS ls FROM files WHERE k <= 30 AND text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
parts AS (SELECT source, doc_id, 'File: doc_' || doc_id || chr(10) || string_agg(CASE WHEN i % 3 = 1 THEN '  class ' || name ELSE '  function ' || name || '()' END, chr(10) ORDER BY i) || chr(10) AS part
          FROM symbols WHERE name IS NOT NULL GROUP BY source, doc_id)
SELECT s.source, ast_outline, substr(ast_outline, 1, 500) AS preview, CASE WHEN n = 0 THEN 'Failed to fetch files or repository is empty.' WHEN coalesce(ast_outline, '') = '' THEN 'No functions or classes found in the repository.' ELSE 'Sync successful' END AS message, n = 0 AS failed
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'no files', 0 UNION ALL SELECT 'no symbols', 3) s
LEFT JOIN (SELECT source, string_agg(part, chr(10) ORDER BY doc_id) AS ast_outline FROM parts GROUP BY source) o ON o.source = s.source""",
    ),
}
