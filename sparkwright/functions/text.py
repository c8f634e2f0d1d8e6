"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The corporate suffixes that names lose, and the heading pattern of filings.
SUFFIXES = "inc|incorporated|corp|corporation|co|company|ltd|llc|l\\.?l\\.?c\\.?|plc|n\\.?v\\.?|group|holdings?"
HEADER = "(?i)^(PART\\s+[IVX]+|Item\\s+\\d+[A-Za-z]?\\.)\\s*(.*)$"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, "(?U)\\s+", " "))


def normalize_name(x: Column) -> Column:
    """Trailing corporate suffixes off (all of them at once), punctuation off, spaces collapsed, lower case."""
    bare = F.regexp_replace(strip(x), f"(?iU)(?:[,.]?\\s+(?:{SUFFIXES})\\.?\\s*)+$", "")
    return F.lower(collapse(F.regexp_replace(bare, "(?U)[^\\w\\s]", "")))


def content_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def is_hash(x: Column) -> Column:
    return F.lower(x).rlike("^[0-9a-f]{64}$")


def cache_key(chunk_id: Column, model: Column, prompt_version: Column, schema_version: Column, text: Column) -> Column:
    """Content-addressed: any change of chunk, model, prompt, schema or text is another key."""
    return F.sha2(F.concat_ws("|", chunk_id, model, prompt_version, schema_version, text), 256)


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s_%05d", document_id.cast("string"), index)


def header_key(paragraph: Column) -> Column:
    """The key of a heading: its first part, upper case, underscores for spaces, no dots at the end."""
    first = F.regexp_replace(F.regexp_extract(paragraph, HEADER, 1), "\\.+$", "")
    return F.replace(F.upper(first), F.lit(" "), F.lit("_"))
