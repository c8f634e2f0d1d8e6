"""Sections of documents by their headings, and document assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LONGEST_HEADER = 100


def header_candidate(paragraph: Column, pattern: str = X.HEADER, longest: int = LONGEST_HEADER) -> Column:
    return paragraph.rlike(pattern) & (F.length(paragraph) <= longest)


def chosen_headings(paragraphs: DataFrame, id_col: str, is_header: Column, key: Column) -> DataFrame:
    """Paragraphs with ``chosen``: of equal headings the one with the longest body up to the next candidate, the first of equals."""
    by_doc = Window.partitionBy(id_col)
    marked = paragraphs.withColumn("_head", F.coalesce(is_header, F.lit(False))).withColumn("_run", F.sum(F.col("_head").cast("int")).over(by_doc.orderBy("pos")))
    body = F.sum(F.when(F.col("_head"), 0).otherwise(F.length("text"))).over(Window.partitionBy(id_col, "_run"))
    ranked = marked.withColumn("_key", F.when(F.col("_head"), key)).withColumn("_body", body)
    rank = F.row_number().over(Window.partitionBy(id_col, "_key").orderBy(F.desc("_body"), "pos"))
    return ranked.withColumn("chosen", F.col("_head") & (rank == 1)).drop("_run", "_body")


def split_sections(paragraphs: DataFrame, id_col: str = "page_id", is_header: Column | None = None, key: Column | None = None) -> DataFrame:
    """(id, section_pos, section_path, text) from (id, pos, text).

    Without any heading all is "Full Document"; what stands before the first chosen
    heading is "Front Matter"; headings that were not chosen stay in the text; sections
    without text stay, too.
    """
    is_header = header_candidate(F.col("text")) if is_header is None else is_header
    key = X.header_key(F.col("text")) if key is None else key
    rows = chosen_headings(paragraphs, id_col, is_header, key)
    so_far = Window.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("_at", F.last(F.when(F.col("chosen"), F.col("pos")), ignorenulls=True).over(so_far)).withColumn("_any", F.max(F.col("_head").cast("int")).over(Window.partitionBy(id_col)))
    parts = F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.struct("pos", "text"))))
    grouped = rows.groupBy(id_col, "_at", "_any").agg(F.max(F.when(F.col("chosen"), F.col("text"))).alias("title"), parts.alias("p"))
    path = F.when(F.col("_any") == 0, "Full Document").when(F.col("_at").isNull(), "Front Matter").otherwise(F.col("title"))
    order = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("_at").asc_nulls_first())) - 1
    return grouped.select(id_col, order.alias("section_pos"), path.alias("section_path"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def assemble_documents(pages: DataFrame, sections: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Documents from page rows (id, stem, company, ticker, document_type, date, source_uri, raw) and their sections."""
    listed = sections.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("section_pos", "section_path", "text"))).alias("s"))
    rows = pages.join(listed, id_col, "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<section_pos:int,section_path:string,text:string>>)")))
    year = F.get(F.split("stem", "_"), 1)
    return rows.select(
        F.col("stem").alias("document_id"), F.lit("filing").alias("source"), "document_type",
        F.format_string("%s %s (FY%s)", "company", "document_type", year).alias("title"), "date",
        F.create_map(F.lit("company"), "company", F.lit("ticker"), "ticker", F.lit("fiscal_year"), year, F.lit("document_type"), "document_type", F.lit("filing_date"), F.date_format("date", "yyyy-MM-dd")).alias("metadata"),
        F.transform("s", lambda x: F.struct(x["section_path"], x["text"])).alias("sections"),
        F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"), "source_uri", X.content_hash(F.col("raw")).alias("content_hash"),
    )
