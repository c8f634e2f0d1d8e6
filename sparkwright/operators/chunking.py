"""Overlapping token windows with stable chunk ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: A window's tokens, and how many of them the next one has again.
TARGET, OVERLAP = 800, 100
#: A token with the white space before it: joined again they give the text.
TOKEN = "\\s*\\S+"


def tokens(text: Column) -> Column:
    """The offline tokenizer."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def window_count(n: Column, target: int, overlap: int) -> Column:
    """How many windows ``n`` tokens make: the last one ends at the last token."""
    return F.when(n <= 0, 0).when(n <= target, 1).otherwise(F.ceil((n - overlap) / (target - overlap))).cast("int")


def windows(rows: DataFrame, tokens_col: str = "tokens", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Rows exploded into windows: adds window_pos and piece."""
    if overlap >= target or overlap < 0:
        raise ValueError(f"overlap {overlap} must be at least 0 and less than the target {target}")
    n = window_count(F.size(tokens_col), target, overlap)
    spread = rows.withColumn("window_pos", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return spread.withColumn("piece", F.array_join(F.slice(tokens_col, F.col("window_pos") * (target - overlap) + 1, F.lit(target)), ""))


def chunk_documents(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP, tokenize=tokens, as_text=lambda piece: piece) -> DataFrame:
    """Chunks of documents: no window crosses sections, empty pieces go, ids count over the whole document.

    ``tokenize`` makes tokens of a text column, ``as_text`` makes text of joined tokens (:mod:`..functions.bpe` has both for byte pairs)."""
    parts = docs.select("document_id", "metadata", "document_type", "date", F.posexplode("sections").alias("section_pos", "s"))
    parts = parts.select("document_id", "metadata", "document_type", "date", "section_pos", "s.section_path", X.strip(F.col("s.text")).alias("_text")).filter("_text <> ''")
    pieces = windows(parts.withColumn("tokens", tokenize(F.col("_text"))), "tokens", target, overlap).withColumn("text", X.strip(as_text(F.col("piece")))).filter("text <> ''")
    index = (F.row_number().over(Window.partitionBy("document_id").orderBy("section_pos", "window_pos")) - 1).cast("int")
    told = F.create_map(F.lit("company"), F.try_element_at("metadata", F.lit("company")), F.lit("ticker"), F.try_element_at("metadata", F.lit("ticker")), F.lit("document_type"), F.col("document_type"), F.lit("date"), F.date_format("date", "yyyy-MM-dd"))
    return pieces.withColumn("chunk_index", index).select(X.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", "section_path", "text", told.alias("metadata"))
