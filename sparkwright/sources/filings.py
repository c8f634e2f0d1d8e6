"""Filing sources: ticker mapping, latest filing, manifest, raw pages; the network stays outside the engine."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

# The pause between requests, and where a filing's page stands (number without leading zeros, accession without dashes, page).
PAUSE_SECONDS = 0.3
PAGE_ADDRESS = "https://www.sec.gov/Archives/edgar/data/%s/%s/%s"


class UnknownTickers(ValueError):
    """Names all tickers that the mapping does not have."""


def ticker_table(raw: DataFrame) -> DataFrame:
    """(ticker, cik, title) from mapping rows ``(pos, ticker, cik, title)``: the last of equal tickers counts, cik has ten digits."""
    last = F.max_by(F.struct("cik", "title"), "pos").alias("r")
    return raw.groupBy(F.upper("ticker").alias("ticker")).agg(last).select("ticker", F.lpad(F.col("r.cik").cast("string"), 10, "0").alias("cik"), F.col("r.title").alias("title"))


def missing_tickers(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Wanted tickers without a mapping."""
    return wanted.select(F.upper("ticker").alias("ticker")).distinct().join(mapping, "ticker", "left_anti")


def resolve_tickers(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """(ticker, cik); raises and names every ticker that is missing (``wanted`` is a stated list)."""
    if absent := [r["ticker"] for r in missing_tickers(wanted, mapping).orderBy("ticker").collect()]:
        raise UnknownTickers("no mapping for " + ", ".join(absent))
    return wanted.select(F.upper("ticker").alias("ticker")).distinct().join(mapping.select("ticker", "cik"), "ticker")


def filing_rows(feed: DataFrame) -> DataFrame:
    """Rows of a feed that holds parallel arrays (form, filingDate, accessionNumber, primaryDocument) for each cik."""
    zipped = F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument")
    return feed.select("cik", F.posexplode(zipped).alias("pos", "f")).select("cik", "pos", "f.*")


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_filing(feed: DataFrame, form: str = "10-K") -> DataFrame:
    """Each cik's newest filing of a form; of equal dates the first in the feed."""
    return latest_per_key(filing_rows(feed).filter(F.col("form") == form), ["cik"], [F.desc("filingDate"), F.asc("pos")]).drop("pos")


def without_filing(feed: DataFrame, form: str = "10-K") -> DataFrame:
    """Ciks that have no filing of the form."""
    return feed.select("cik").distinct().join(filing_rows(feed).filter(F.col("form") == form), "cik", "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, one row a ticker (the newest download counts); empty where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schemas.MANIFEST)
    rows = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return latest_per_key(rows, ["ticker"], [F.desc("downloaded_at")])


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def to_fetch(wanted: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted rows (ticker) that are not both in the manifest and there as a file (path)."""
    there = manifest.join(files.select(F.col("path").alias("local_path")), "local_path", "left_semi")
    return wanted.join(there, "ticker", "left_anti")


def page_address(cik: Column, accession: Column, page: Column) -> Column:
    return F.format_string(PAGE_ADDRESS, cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), page)


FETCHED = "name string, url string, content binary, reason string"


def fetch(wanted: DataFrame, get: Callable[[str], bytes], pause: float = PAUSE_SECONDS, lanes: int = 1) -> DataFrame:
    """(name, url, content, reason) of wanted pages (name, url): ``get`` is asked once for each address, politely.

    ``lanes`` tasks ask side by side, each after ``lanes`` pauses, so that all together keep one pause between
    requests.  A page that cannot be had has a reason in place of content and ends nothing.  The result
    is written by who calls (:func:`write_raw`): computing it again asks again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            got = []
            for url in batch["url"]:
                if last is not None:
                    time.sleep(max(0.0, last + pause * lanes - time.monotonic()))
                last = time.monotonic()
                try:
                    got.append((get(url), None))
                except Exception as e:  # a request's own failure concerns its page alone
                    got.append((None, f"{type(e).__name__}: {e}"))
            yield batch.assign(content=[c for c, _ in got], reason=[r for _, r in got])

    pages = wanted.filter("url is not null").groupBy("url").agg(F.min("name").alias("name")).select("name", "url")
    return pages.repartition(lanes, "url").mapInPandas(run, FETCHED)


def write_raw(pages: DataFrame, path: str) -> None:
    """Adds raw pages (name, content) that are not there yet; a page that is there is never changed."""
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        pages = pages.join(spark.read.schema(schemas.RAW).parquet(path).select("name"), "name", "left_anti")
    pages.select("name", "content").dropDuplicates(["name"]).write.mode("append").parquet(path)


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, content_hash) of the landing zone."""
    return spark.read.schema(schemas.RAW).parquet(path).withColumn("content_hash", F.sha2("content", 256))


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, content_hash) of raw pages, whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("content_hash"))
