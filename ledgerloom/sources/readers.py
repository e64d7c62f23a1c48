"""Reading listings, filings, transcripts, chunks and JSON lines into DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import small_side

NASDAQ = "Symbol STRING, Security_Name STRING, Market_Category STRING, Test_Issue STRING, Financial_Status STRING, Round_Lot_Size STRING, ETF STRING, NextShares STRING"
OTHER = "ACT_Symbol STRING, Security_Name STRING, Exchange STRING, CQS_Symbol STRING, ETF STRING, Round_Lot_Size STRING, Test_Issue STRING, NASDAQ_Symbol STRING"
RAW_FILING = "ticker STRING, date STRING, text STRING, text_chunks ARRAY<STRING>, url STRING, filing_type STRING"
#: Parts of a file name that mark an exhibit or index and no primary document.
NOT_PRIMARY = r"(?i)xbrl|xml|ex-|exhibit|form|index"


class _Tables(HTMLParser):
    """Rows of the cells of every table: (table id or class, row, cell texts, first link of the row)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, list[str], str | None]] = []
        self.stack: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "table":
            self.stack.append({"name": a.get("id") or a.get("class") or "", "row": -1, "cells": None, "cell": None, "link": None})
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                self._close(t)
                t |= {"row": t["row"] + 1, "cells": [], "link": None}
            elif tag in ("td", "th") and t["cells"] is not None:
                t["cells"].append("")
            elif tag == "a" and t["link"] is None:
                t["link"] = a.get("href")

    def handle_endtag(self, tag: str) -> None:
        if self.stack and tag == "tr":
            self._close(self.stack[-1])
        elif self.stack and tag == "table":
            self._close(self.stack.pop())

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1]["cells"]:
            self.stack[-1]["cells"][-1] += data

    def _close(self, t: dict) -> None:
        if t["cells"]:
            self.rows.append((t["name"], t["row"], [" ".join(c.split()) for c in t["cells"]], t["link"]))
        t["cells"] = None


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_name, row_no, cells, link): every table row of every page; broken pages give what can be read, null pages nothing."""
    kind = dict(pages.dtypes)[id_col]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, html in zip(b["id"], b["html"], strict=True):
                parser = _Tables()
                parser.feed(html or "")
                out += [(i, *row) for row in parser.rows]
            yield pd.DataFrame(out, columns=["id", "table_name", "row_no", "cells", "link"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(read, f"id {kind}, table_name string, row_no int, cells array<string>, link string")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def index_members(pages: DataFrame, id_col: str = "path", html_col: str = "html") -> DataFrame:
    """Tickers of an index page: the ``Symbol`` column of the table named ``constituents``."""
    rows = html_tables(pages, id_col, html_col).where("table_name = 'constituents'")
    head = rows.where("row_no = 0").select("id", F.array_position("cells", "Symbol").cast("int").alias("at"))
    return rows.where("row_no > 0").join(small_side(head), "id").where("at > 0").select(F.get("cells", F.col("at") - 1).alias("ticker"), F.lit("index").alias("source"))


def _listing(spark: SparkSession, path: str, schema: str, symbol: str) -> DataFrame:
    # the heading and the footer drop out by the same test as test issues and funds
    return spark.read.csv(path, sep="|", schema=schema).where("Test_Issue = 'N' and ETF = 'N'").select(F.col(symbol).alias("ticker"))


def nasdaq_listing(spark: SparkSession, path: str) -> DataFrame:
    return _listing(spark, path, NASDAQ, "Symbol").withColumn("source", F.lit("nasdaq"))


def other_listing(spark: SparkSession, path: str) -> DataFrame:
    return _listing(spark, path, OTHER, "ACT_Symbol").withColumn("source", F.lit("other"))


def library_listing(table: DataFrame) -> DataFrame:
    """Symbols of a listing table, of stocks only if it tells types apart."""
    rows = table.where("type = 'Stock'") if "type" in table.columns else table
    return rows.select(F.col("symbol").alias("ticker"), F.lit("library").alias("source")).distinct()


def universe(*sources: DataFrame, market: str | None = None) -> DataFrame:
    """Distinct tickers of all sources, trimmed and upper case; blank and null ones dropped; one market if the source column is to match."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if market is not None:
        out = out.where(F.col("source") == market)
    return out.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()


def cik_table(spark: SparkSession, path: str) -> DataFrame:
    """(ord, ticker, cik_str) from a JSON map of numbered entries; a file that is no JSON gives an empty table."""
    entries = F.from_json("value", "map<string,struct<ticker:string,cik_str:bigint>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("ord", "e"))
    return rows.select(F.col("ord").cast("int").alias("ord"), "e.ticker", "e.cik_str")


def with_cik(companies: DataFrame, lookup: DataFrame, order: str | None = None) -> DataFrame:
    """Inner join by ticker whatever its case, to the first entry of each ticker; the number padded to ten digits."""
    key = F.struct(*([F.col(order)] if order else []), "cik_str", "ticker")
    first = lookup.where("ticker is not null").groupBy(F.lower("ticker").alias("_k")).agg(F.min_by("cik_str", key).alias("cik_str"))
    padded = F.when(F.length(F.col("cik_str").cast("string")) >= 10, F.col("cik_str").cast("string")).otherwise(F.lpad(F.col("cik_str").cast("string"), 10, "0"))
    return companies.withColumn("_j", F.lower("ticker")).join(first, F.col("_j") == F.col("_k")).withColumn("cik", padded).drop("_j", "_k", "cik_str")


def without_cik(companies: DataFrame, lookup: DataFrame) -> DataFrame:
    """The companies that the lookup lacks, for the report."""
    keys = lookup.select(F.lower("ticker").alias("_k")).distinct()
    return companies.withColumn("_k", F.lower("ticker")).join(keys, "_k", "left_anti").drop("_k")


def filing_links(pages: DataFrame, most: int, id_col: str = "path", html_col: str = "html") -> DataFrame:
    """(id, link, date): the first ``most`` rows of the result table of each search page, as listed."""
    rows = html_tables(pages, id_col, html_col).where("table_name = 'tableFile2' and row_no > 0 and link is not null")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("row_no"))).where(F.col("r") <= most).select("id", "link", F.get("cells", F.lit(3)).alias("date"))


def primary_document(rows: DataFrame) -> DataFrame:
    """Of each filing's (filing_id, row_no, doc_type, filing_type, file_name) the first page of its own type that is no exhibit; viewer prefixes cut."""
    good = rows.where((F.col("doc_type") == F.col("filing_type")) & F.col("file_name").rlike(r"(?i)\.html?$") & ~F.element_at(F.split("file_name", "/"), -1).rlike(NOT_PRIMARY))
    first = good.withColumn("r", F.row_number().over(W.partitionBy("filing_id").orderBy("row_no"))).where("r = 1")
    return first.select("filing_id", F.regexp_replace("file_name", r"^/ix\?doc=", "").alias("file_name"))


def document_text(html: Column) -> Column:
    """Text of a downloaded page, scrubbed; '' for null."""
    return F.coalesce(X.scrubbed_filing(X.html_text(html)), F.lit(""))


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths that there are."""
    out = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            out.append(path)
    return out


def json_documents(spark: SparkSession, *paths: str, schema: str = RAW_FILING) -> DataFrame:
    """One document per file in any folder below the ``paths``, with its path; folders that there aren't give none."""
    found = existing(spark, *paths)
    if not found:
        return spark.createDataFrame([], schema + ", path STRING")
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(found).select("*", F.col("_metadata.file_path").alias("path"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are JSON of the schema; broken ones are skipped."""
    return spark.read.schema(schema + ", _corrupt_record STRING").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("path")).where("line <> ''")


def zipped_parts(vectors: DataFrame, payloads: DataFrame) -> DataFrame:
    """Vectors and payloads of equal part and position; unequal numbers of rows are an error."""
    a, b = vectors.count(), payloads.count()
    if a != b:
        raise ValueError(f"{a} vectors but {b} payloads")
    return vectors.join(payloads, ["part", "pos"])


def payload_rows(chunks: DataFrame) -> DataFrame:
    """Chunk metadata with the text under its payload name."""
    return chunks.withColumnRenamed("text", "chunk_text")


def nonblank_transcripts(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim("transcript") != "")
