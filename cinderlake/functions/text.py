"""Text expressions: lines, paths, hashes, headers, masks and messages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, as str.splitlines has it.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

#: Endings of source files, compared with case.
SOURCE_ENDINGS = (".py", ".js", ".jsx", ".ts", ".tsx", ".java")

#: A lower-cased path that contains any of these is not indexed.
SKIPPED_PATH_PARTS = (
    "test/", "tests/", "__tests__/", "spec/", "specs/", "/test", "/tests", "test_", "_test.", ".test.", ".spec.", "test.java", "tests.java",
    "migrations/", "/migrations", "alembic/", "prisma/migrations/", "flyway/", "liquibase/", "db/migrate/",
    ".min.js", ".min.", ".bundle.js", ".d.ts",
    "node_modules/", "dist/", "build/", "target/", "vendor/", ".next/", ".nuxt/", ".svelte-kit/", ".out/", "out/", "staticfiles/",
    ".venv/", "venv/", "env/", ".env/",
    "coverage/", ".nyc_output/", "__generated__/",
)

#: Extension to grammar.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java"}

#: How a line begins that names a class.
CLASS_PREFIXES = ("class ", "public class ", "protected class ", "private class ", "interface ", "public interface ", "record ", "public record ", "abstract class ", "public abstract class ")


def split_lines(text: Column) -> Column:
    """Lines of text without their ends; no empty line after a last end."""
    without_last = lambda parts: F.slice(parts, 1, F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))
    # Inside a function of arrays the text is split once, however often the parts are asked for.
    return F.get(F.transform(F.array(F.split(text, LINE_BREAK, -1)), without_last), F.lit(0))


def strip(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def falsy_coalesce(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def content_hash(filepath: Column, text: Column) -> Column:
    """Sixteen hex digits over path and text, without the lines that give line numbers."""
    kept = F.filter(split_lines(text), lambda line: ~line.rlike(r"(?U)^\s*Lines: .*\S"))
    return F.substring(F.sha2(F.concat(filepath, F.lit("::"), F.array_join(kept, "\n")), 256), 1, 16)


def chunk_id(project_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("chunk_"), project_id.cast("string"), F.lit("_"), digest)


def collection_name(project_id: Column) -> Column:
    return F.concat(F.lit("project_"), project_id.cast("string"))


def chunk_header(filepath: Column, symbol_type: Column, start: Column, end: Column, enclosing: Column | None = None) -> Column:
    """The lines that stand before a chunk's code; the class line only where there is a class."""
    span = F.concat(F.lit("Lines: "), start.cast("string"), F.lit("-"), end.cast("string"))
    owner = F.concat(F.lit("Class: "), F.nullif(enclosing, F.lit(""))) if enclosing is not None else F.lit(None).cast("string")
    return F.concat(F.concat_ws("\n", F.concat(F.lit("File: "), filepath), owner, F.concat(F.lit("Type: "), symbol_type), span, F.lit("-" * 40)), F.lit("\n"))


def enclosing_signature(code: Column) -> Column:
    """The line of a class body that names the class, else its first line with text."""
    lines = F.filter(F.transform(split_lines(code), strip), lambda line: line != "")
    named = F.filter(lines, lambda line: _any([line.startswith(p) for p in CLASS_PREFIXES]))
    return F.coalesce(F.get(named, F.lit(0)), F.get(lines, F.lit(0)))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def file_extension(path: Column) -> Column:
    """The ending from the last dot of a name that does not begin with it, or ''."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1)


def language(path: Column) -> Column:
    """The grammar of a path, null for none."""
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), file_extension(path))


def is_source_path(path: Column) -> Column:
    """Whether a repository path is indexed. The parts to skip are plain substrings, so 'src/checkout/a.py' is skipped by 'out/'."""
    slashed = F.concat(F.lit("/"), F.ltrim(F.lower(path), F.lit("/")))
    return _any([path.endswith(e) for e in SOURCE_ENDINGS]) & ~_any([slashed.contains(p) for p in SKIPPED_PATH_PARTS])


def mask_email(email: Column) -> Column:
    """Stars for all but the first characters of the local part."""
    at = F.instr(email, "@")
    local, rest = F.substring(email, F.lit(1), at - 1), F.substring(email, at, F.length(email))
    shown = F.when(at <= 3, F.lit(1)).otherwise(F.lit(2))
    stars = F.when(at <= 3, F.lit(1)).otherwise(at - 3)
    return F.when(at <= 1, email).otherwise(F.concat(F.substring(local, F.lit(1), shown), F.repeat(F.lit("*"), stars), rest))


def feed_url(base: str, token: Column) -> Column:
    return F.concat(F.lit(base), token, F.lit(".ics"))


def webcal_url(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("https://"), F.lit("webcal://")), F.lit("http://"), F.lit("webcal://"))


def clean_token(token: Column) -> Column:
    return F.replace(token, F.lit(".ics"), F.lit(""))


def word_tokens(text: Column) -> Column:
    """Stand-in tokens: what white space separates."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(word_tokens(text))


def attempts_left(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n > 1, F.lit(" attempts")).otherwise(F.lit(" attempt")), F.lit(" remaining"))


def diff_summary(cached: Column, new: Column, deleted: Column) -> Column:
    return F.concat(cached.cast("string"), F.lit(" cached, "), new.cast("string"), F.lit(" embedded, "), deleted.cast("string"), F.lit(" pruned"))


def percent_band(low: int, span: int, done: Column, total: Column) -> Column:
    """Progress from low to low + span."""
    return (F.lit(low) + (done.cast("double") / total * span).cast("int")).cast("int")


def zoned_time(instant: Column, zone: str) -> Column:
    """An instant (in a session of UTC) as a weekday, date, time and offset of a zone."""
    there = F.from_utc_timestamp(instant, zone)
    minutes = ((F.unix_seconds(there) - F.unix_seconds(instant.cast("timestamp"))) / 60).cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    offset = F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), two(F.floor(F.abs(minutes) / 60)), two(F.abs(minutes) % 60))
    return F.concat(F.date_format(there, "EEEE, yyyy-MM-dd HH:mm:ss "), offset)


def chunk_label(filepath: Column, start: Column, end: Column) -> Column:
    return F.concat(filepath, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def code_label(user: Column, is_used: Column) -> Column:
    return F.concat(F.lit("OTP for "), user, F.when(is_used, F.lit(" (Used)")).otherwise(F.lit(" (Active)")))


def profile_label(user: Column) -> Column:
    return F.concat(F.lit("Profile for "), user)


def hex_uuid() -> Column:
    """A random token of 32 hex digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def iso_time(instant: Column) -> Column:
    """An instant (in a session of UTC) in ISO 8601, with microseconds where there are any and the offset of UTC."""
    micros = F.date_format(instant, "SSSSSS")
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


@dataclass(frozen=True)
class Tokenizer:
    """How texts are cut to tokens and put together again, as expressions."""

    tokens: Callable[[Column], Column]
    count: Callable[[Column], Column]
    join: Callable[[Column], Column]


#: What white space separates, joined by single blanks.
WORDS = Tokenizer(word_tokens, word_count, lambda tokens: F.array_join(tokens, " "))
