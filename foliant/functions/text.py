"""Text scalars as ``Column -> Column``; white space and case are Unicode's.

Java's ``\\s`` is ASCII unless ``(?U)`` is set, and even then leaves out U+001C to
U+001F, so the class ``WS`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as a regular-expression class body.
WS = r"\s\x1c-\x1f"
#: Fixed value: the characters that end a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Limits and markers of the message cleaner.
HEAD, TAIL, MOST = 9000, 3000, 12000
CUT_MARK = "\n\n[...locally truncated...]\n\n"


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_empty(x: str | Column) -> Column:
    return F.coalesce(as_column(x), F.lit(""))


def normalize_space(x: str | Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(as_column(x), f"(?U)[{WS}]+", " "))


def strip(x: str | Column) -> Column:
    """Without white space at the ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(as_column(x), f"(?U)^[{WS}]+|[{WS}]+$", "")


def split_lines(x: str | Column) -> Column:
    """Lines without their ends; a final line end starts no line, an empty text has none."""
    parts = F.split(as_column(x), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_quoted(line: str | Column) -> Column:
    return as_column(line).rlike(f"(?U)^[{WS}]*>")


def split_paragraphs(x: str | Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    parts = F.transform(F.split(as_column(x), f"(?U)\\n[{WS}]*\\n", -1), strip)
    return F.filter(parts, lambda p: p != "")


def head_tail(x: str | Column, most: int = MOST, head: int = HEAD, tail: int = TAIL) -> Column:
    """Texts over ``most`` characters keep their first ``head`` and last ``tail``."""
    x = as_column(x)
    short = F.concat(F.substring(x, 1, head), F.lit(CUT_MARK), F.right(x, F.lit(tail)))
    return F.when(F.length(x) > most, short).otherwise(x)


def search_text(*parts: str | Column) -> Column:
    """Lower-case parts joined by spaces; nulls are empty."""
    return F.lower(F.concat_ws(" ", *[or_empty(p) for p in parts]))


def joined_fields(*parts: str | Column) -> Column:
    return strip(F.concat_ws("\n", *[or_empty(p) for p in parts]))


def excerpt(x: str | Column, most: int = 700) -> Column:
    return F.substring(normalize_space(x), 1, most)


def words(x: str | Column) -> Column:
    return F.filter(F.split(as_column(x), f"(?U)[{WS}]+", -1), lambda w: w != "")


def word_count(x: str | Column) -> Column:
    return F.size(words(or_empty(x))).cast("long")


def token_estimate(x: str | Column) -> Column:
    """A third of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(or_empty(x)) + 2) / 3).cast("long")


def json_tokens(*fields: str | Column) -> Column:
    """Token estimate of a compact JSON object that keeps null fields."""
    return token_estimate(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def last_part(x: str | Column) -> Column:
    """What follows the last slash; null if that is empty."""
    return F.nullif(F.substring_index(as_column(x), "/", -1), F.lit(""))


def reviewer_of(signature: str | Column) -> Column:
    """The id in ``.../Reviewer_<id>``; null where there is none."""
    return F.nullif(F.regexp_extract(as_column(signature), r"/Reviewer_([^/]+)$", 1), F.lit(""))


def without_reviewer(x: str | Column) -> Column:
    return F.regexp_replace(or_empty(x), "^Reviewer_", "")


def html_escape(x: str | Column) -> Column:
    x = as_column(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def markdown_cell(x: str | Column) -> Column:
    return F.replace(F.replace(as_column(x).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def first_filled(*parts: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(as_column(p), F.lit("")) for p in parts])


def output_text(output: str | Column) -> Column:
    """Texts of the ``output_text`` parts of ARRAY<STRUCT<content: ARRAY<STRUCT<type, text>>>>, joined."""
    parts = F.flatten(F.transform(as_column(output), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: or_empty(p["text"])), "")


def json_length(text: str | Column, path: str) -> Column:
    """Elements of the array at ``path``; null if the text is no JSON."""
    text = as_column(text)
    return F.when(F.try_parse_json(text).isNotNull(), F.json_array_length(F.get_json_object(text, path)))


def tag_name(value: str | Column) -> Column:
    """Name of a tag given as JSON: a string, or an object's first filled naming field."""
    value = as_column(value)
    #: The naming fields, in order.
    fields = ("tag", "name", "value", "domain", "method")
    named = first_filled(*[F.get_json_object(value, f"$.{f}") for f in fields])
    plain = F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")
    return F.coalesce(F.nullif(strip(F.when(F.ltrim(value).startswith("{"), named).when(F.ltrim(value).startswith('"'), plain)), F.lit("")), F.lit(""))
