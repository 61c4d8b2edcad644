"""Scalar functions as column expressions. All stay in the JVM but for Unicode
normalisation, which leaves it only for texts outside ASCII."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Media types by file suffix (fixed values).
MEDIA_TYPES = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf"}
PDF = MEDIA_TYPES["pdf"]

#: What Python's str.rstrip takes off but for the line feed (fixed values), as a Java character class.
_SPACE = r"[\t\x0B\x0C\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Such a run at the end of a line. It is tried once, where it begins, and not given back.
_TRAILING = rf"(?<!{_SPACE}){_SPACE}++(?=\n|\z)"

#: HTTP status by error code (fixed values); anything else is 400.
HTTP_STATUS = {
    "NOT_FOUND": 404, "DOCUMENT_TOO_LARGE": 413, "UNSUPPORTED_DOCUMENT_FORMAT": 415, "EXTRACTION_FAILED": 422,
    "EMPTY_DOCUMENT": 422, "VALIDATION_FAILED": 422, "EMBEDDING_FAILED": 502, "QUEUE_UNAVAILABLE": 503,
}


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def normalize_text(text: Column) -> Column:
    """NFC, line feeds only, no NUL, no white space at line ends, at most one blank line, no outer line feeds."""
    plain = text.rlike(r"\A[\x00-\x7F]*\z")
    out = F.when(plain, text).otherwise(_composed(F.when(~plain, text)))
    for pattern, by in ((r"\r\n?", "\n"), (r"\x00", ""), (_TRAILING, ""), (r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " ")


def closed_references(html: Column) -> Column:
    """HTML in which a character reference without its semicolon, such as one that a title was cut off in, stands for itself. Parsers read some of these
    as if they were closed."""
    return F.regexp_replace(html, "&(#?[A-Za-z0-9]++)(?!;)", "&amp;$1")


_TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased once matched."""
    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.lower)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TOKEN))


def named(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: the one element of an array stands for its name."""
    return F.transform(F.array(value), use)[0]


def runs(words: Column) -> Column:
    """(word, n) for each distinct element of an array, counted within the row, so that nothing is shuffled for it."""

    def of(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return named(begins, lambda b: F.zip_with(b, F.slice(F.array_append(b, F.size(s)), F.lit(2), F.size(b)), lambda x, y: F.struct(F.get(s, x).alias("word"), (y - x).cast("long").alias("n"))))

    return named(F.sort_array(words), of)


def postings(text: Column) -> Column:
    """(word, n, length) for each distinct word of a text, with the number of all of its words. The text is cut up once."""
    return named(tokens(text), lambda s: F.transform(runs(s), lambda r: F.struct(r["word"].alias("word"), r["n"].alias("n"), F.size(s).cast("long").alias("length"))))


def media_type(filename: Column) -> Column:
    """By the suffix of the last path part; null if it is not a supported one."""
    name = F.regexp_extract(filename, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))
    return F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))[suffix]


def has_signature(media: Column, content: Column) -> Column:
    """Whether a file may be of its media type: a PDF begins with %PDF-, others are not looked at."""
    return (media != PDF) | (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def safe_filename(name: Column) -> Column:
    """The last part of a path of either kind of slash, 512 characters of it, or 'document'."""
    base = F.element_at(F.split(F.regexp_replace(F.translate(name, "\\", "/"), "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(F.left(base, F.lit(512)), F.lit("")), F.lit("document"))


def embedding_text(section_path: Column, content: Column) -> Column:
    """What is embedded of a fragment: its headings, a blank line, its content."""
    return F.when(F.coalesce(F.size(section_path), F.lit(0)) <= 0, content).otherwise(F.concat(F.array_join(section_path, " > "), F.lit("\n\n"), content))


def collection_name(course: Column, model: Column) -> Column:
    """Name of the collection of one course and one embedding model."""
    trim = lambda c: F.regexp_replace(c, r"\A[-._]+|[-._]+\z", "")
    name = trim(F.left(trim(F.regexp_replace(F.concat(course, F.lit("--"), model), r"[^a-zA-Z0-9._-]+", "-")), F.lit(512)))
    return F.when(F.length(name) >= 3, name).otherwise(F.concat(F.lit("col-"), name, F.lit("-x")))


def document_type(filename: Column) -> Column:
    return F.when(filename.contains("_Tutorial_"), "tutorial").when(filename.contains("_Sample_Task_"), "sample_task").when(filename.startswith("Test_Task"), "test_task").otherwise("lab_task")


def topic_line(text: Column) -> Column:
    """What the first line of the form *Topic: ...* names, 256 characters of it; null if there is none."""
    found = F.left(F.regexp_extract(text, r"(?mdU)^\*Topic:\s*(.+?)\s*\*\s*$", 1), F.lit(256))
    return F.nullif(found, F.lit(""))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def request_id(header: Column, fallback: Column) -> Column:
    """The caller's id if it is a plain short one, else one made from ``fallback``."""
    return F.when(header.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), header).otherwise(F.concat(F.lit("req_"), F.left(F.sha2(fallback.cast("string"), 256), F.lit(16))))


def http_status(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in HTTP_STATUS.items() for x in pair))[code], F.lit(400))


def json_merge(document: Column, patch: Column) -> Column:
    """A shallow merge of two JSON objects: the patch's keys win, an explicit null is kept."""
    kind = "map<string,variant>"
    old, new = (F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind)) for c in (document, patch))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.to_json(F.map_concat(kept, new), {"ignoreNullFields": "false"})


def json_text(document: Column, key: str) -> Column:
    """The text at a key of a JSON object; null where it is missing or null."""
    return F.get_json_object(document, f"$.{key}")


def unknown_fields(patch: Column, allowed: list[str]) -> Column:
    """The keys of a JSON object that are not among ``allowed``, in order."""
    return F.array_sort(F.array_except(F.json_object_keys(patch), F.array(*map(F.lit, allowed))))
