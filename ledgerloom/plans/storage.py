"""Registered queries of the readers and writers: what is written into the shared folder is read back, and SQL says what it must be."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, filings
from ..session import shared_dir, table
from ..sources import readers, writers
from .catalog import docs, numbered, query


def place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cik_lookup").where("ticker is not null")


# -- readers -----------------------------------------------------------------------------------------------------------


@query("source_index_page", "SELECT ticker, 'index' AS source FROM cik_lookup WHERE ticker IS NOT NULL")
def source_index_page(spark, d):
    """Pages of constituents, one per exchange, with other tables around."""
    row = F.concat(F.lit("<tr><td>"), F.coalesce("company_name", F.lit("")), F.lit("</td><td><a href='/x'>"), "ticker", F.lit("</a></td></tr>"))
    pages = lookup(spark, d).groupBy(F.coalesce("exchange", F.lit("-")).alias("path")).agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    html = F.concat(F.lit("<p>x</p><table class='other'><tr><td>Symbol</td></tr><tr><td>NO</td></tr></table><table id='constituents'><tr><th>Name</th><th>Symbol</th></tr>"), "rows", F.lit("</table>"))
    return readers.index_members(pages.select("path", html.alias("html")))


@query("source_listings", "SELECT ticker, 'nasdaq' AS source FROM cik_lookup WHERE ticker IS NOT NULL AND cik_str % 3 > 0 AND cik_str % 5 > 0 UNION ALL SELECT ticker, 'other' FROM cik_lookup WHERE ticker IS NOT NULL AND cik_str % 3 > 0 AND cik_str % 5 > 0")
def source_listings(spark, d):
    """Both exchange listings, with test issues, funds, heading and footer."""
    test, fund = (F.when(F.pmod("cik_str", F.lit(n)) == 0, "Y").otherwise("N") for n in (3, 5))
    name = F.coalesce(F.regexp_replace("company_name", r"\|", ""), F.lit(""))
    out = []
    for label, read, parts, head in (
        ("nasdaq", readers.nasdaq_listing, ["ticker", name, F.lit("Q"), test, F.lit("N"), F.lit("100"), fund, F.lit("N")], "Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares"),
        ("other", readers.other_listing, ["ticker", name, F.lit("N"), "ticker", fund, F.lit("100"), test, "ticker"], "ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol"),
    ):
        path = place(spark, label)
        ends = spark.createDataFrame([(head,), ("File Creation Time: 0101202012:00|||||||",)], "value string")
        lookup(spark, d).select(F.concat_ws("|", *parts).alias("value")).unionByName(ends).write.text(path)
        out.append(read(spark, path))
    return out[0].unionByName(out[1])


@query("source_library", "SELECT DISTINCT ticker, 'library' AS source FROM cik_lookup WHERE ticker IS NOT NULL AND cik_str % 2 = 0")
def source_library(spark, d):
    kind = F.when(F.pmod("cik_str", F.lit(2)) == 0, "Stock").otherwise("Fund")
    return readers.library_listing(lookup(spark, d).select(F.col("ticker").alias("symbol"), kind.alias("type")))


@query("source_cik_map", "SELECT DISTINCT ticker, cik_str FROM cik_lookup WHERE ticker IS NOT NULL")
def source_cik_map(spark, d):
    """The register as one JSON map of numbered entries."""
    path = place(spark, "cik")
    entry = F.struct(F.xxhash64("ticker", "cik_str").cast("string").alias("k"), F.struct("ticker", "cik_str").alias("v"))
    keyed = lookup(spark, d).select(entry.alias("e")).distinct()
    keyed.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).write.text(path)
    return readers.cik_table(spark, path).select("ticker", "cik_str")


@query("source_filing_links", "SELECT doc_id AS id, '/a/' || doc_id || '/' || n AS link, '2020-01-0' || n AS date FROM documents, (SELECT unnest([1, 2]) AS n)")
def source_filing_links(spark, d):
    """The first two rows of each search page's result table."""
    cells = F.array_join(F.transform(F.array(*map(F.lit, "123")), lambda n: F.concat(F.lit("<tr><td>10-K</td><td><a href='/a/"), F.col("doc_id").cast("string"), F.lit("/"), n, F.lit("'>x</a></td><td>y</td><td>2020-01-0"), n, F.lit("</td></tr>"))), "")
    pages = docs(spark, d).select("doc_id", F.concat(F.lit("<table class='tableFile2'><tr><th>T</th></tr>"), cells, F.lit("</table>")).alias("html"))
    return readers.filing_links(pages, 2, "doc_id", "html")


@query("source_primary_document", "SELECT doc_id AS filing_id, CASE WHEN doc_id % 2 = 0 THEN '/main' ELSE '/late' END || doc_id || '.htm' AS file_name FROM documents")
def source_primary_document(spark, d):
    """Of each filing's files the first page of its own type that is no exhibit."""
    files = [("10-K", "/a/ex-1.htm"), ("8-K", "/a/other.htm"), ("10-K", "/a/data.xml"), ("10-K", None), ("10-K", "/late")]
    rows = None
    for n, (kind, name) in enumerate(files):
        own = docs(spark, d).where(F.lit(True) if name is not None else F.pmod("doc_id", F.lit(2)) == 0)
        file = F.concat(F.lit("/ix?doc=/main"), F.col("doc_id").cast("string"), F.lit(".htm")) if name is None else F.concat(F.lit("/late"), F.col("doc_id").cast("string"), F.lit(".htm")) if name == "/late" else F.lit(name)
        part = own.select(F.col("doc_id").alias("filing_id"), F.lit(n).alias("row_no"), F.lit(kind).alias("doc_type"), F.lit("10-K").alias("filing_type"), file.alias("file_name"))
        rows = part if rows is None else rows.unionByName(part)
    return readers.primary_document(rows)


@query("source_json_lines", "SELECT example_id, user_query FROM qa_answer")
def source_json_lines(spark, d):
    """JSON lines with every row's broken twin beside it."""
    path = place(spark, "lines")
    rows = table(spark, d, "qa_answer").select(F.to_json(F.struct("example_id", "user_query")).alias("value"))
    rows.unionByName(rows.select(F.concat(F.lit("{"), "value").alias("value"))).write.text(path)
    return readers.json_lines(spark, path, "example_id LONG, user_query STRING")


@query("source_raw_lines", "SELECT count(*) AS n, count(DISTINCT trim(raw_line)) AS kinds FROM (SELECT unnest(regexp_split_to_array(raw_line, '\\r\\n|\\r|\\n')) AS raw_line FROM qa_raw_line) WHERE trim(raw_line) <> ''")
def source_raw_lines(spark, d):
    path = place(spark, "raw")
    table(spark, d, "qa_raw_line").where("raw_line is not null").select(F.col("raw_line").alias("value")).write.text(path)
    return readers.raw_lines(spark, path).agg(F.count("*").alias("n"), F.count_distinct("line").alias("kinds"))


@query("source_zipped_parts", "SELECT id, payload.ticker AS ticker FROM point WHERE vector IS NOT NULL")
def source_zipped_parts(spark, d):
    """Vectors and payloads written apart and joined by part and position."""
    rows = table(spark, d, "point").where("vector is not null").select(F.pmod(F.xxhash64("id"), F.lit(4)).alias("part"), F.col("id").alias("pos"), "vector", "payload.ticker")
    paths = place(spark, "vectors"), place(spark, "payloads")
    rows.select("part", "pos", "vector").write.parquet(paths[0])
    rows.select("part", "pos", "ticker").write.parquet(paths[1])
    return readers.zipped_parts(spark.read.parquet(paths[0]), spark.read.parquet(paths[1])).select(F.col("pos").alias("id"), "ticker")


# -- writers -----------------------------------------------------------------------------------------------------------


@query("sink_new_rows", "SELECT DISTINCT global_chunk_id, ticker FROM chunk")
def sink_new_rows(spark, d):
    """Written three times, the second time with more rows: nothing is there twice."""
    path = place(spark, "new")
    rows = table(spark, d, "chunk").select("global_chunk_id", "ticker")
    for part in (rows.where(F.pmod(F.xxhash64("global_chunk_id"), F.lit(2)) == 0), rows, rows):
        writers.write_new(part, path, ["global_chunk_id"])
    return spark.read.parquet(path)


@query("sink_documents", "SELECT metadata.ticker AS ticker, metadata.year AS year, metadata.date AS date, filing_no FROM sectioned_filing QUALIFY row_number() OVER (PARTITION BY metadata.ticker, metadata.year, metadata.date ORDER BY ingested_at DESC, filing_no DESC) = 1")
def sink_documents(spark, d):
    path = place(spark, "documents")
    rows = table(spark, d, "sectioned_filing").select("metadata.ticker", "metadata.year", "metadata.date", "filing_no", "ingested_at", F.coalesce("metadata.ticker", F.lit("none")).alias("folder"))
    writers.write_documents(rows, path, ["ticker", "year", "date"], ["ingested_at", "filing_no"], ["folder"])
    return spark.read.schema("ticker STRING, year INT, date STRING, filing_no LONG, folder STRING").json(path).drop("folder")


@query("sink_chunks", "SELECT source_type, global_chunk_id, text FROM chunk")
def sink_chunks(spark, d):
    path = place(spark, "chunks")
    rows = table(spark, d, "chunk").select("source_type", "global_chunk_id", "text")
    writers.write_chunks(rows, path)
    return spark.read.schema("global_chunk_id STRING, text STRING, source_type STRING").json(path)


@query("sink_parts", "SELECT count(*) AS n, TRUE AS bounded FROM documents")
def sink_parts(spark, d):
    """Files of at most 500 rows."""
    path = place(spark, "parts")
    writers.write_parts(docs(spark, d).select("doc_id", "text"), path, 500)
    per_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count()
    return per_file.agg(F.sum("count").alias("n"), (F.max("count") <= 500).alias("bounded"))


@query("sink_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT -doc_id, 'new' FROM documents WHERE doc_id % 3 = 0")
def sink_upsert(spark, d):
    held = docs(spark, d).select("doc_id", "source")
    changed = held.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"))
    changed = changed.unionByName(changed.withColumn("doc_id", -F.col("doc_id")))
    return writers.upsert(held, changed.unionByName(changed), "doc_id")


@query("sink_appended_lines", "SELECT example_id, final_answer FROM qa_answer")
def sink_appended_lines(spark, d):
    path = place(spark, "appended")
    rows = table(spark, d, "qa_answer").select("example_id", "final_answer")
    for half in (0, 1):
        writers.append_lines(rows.where(F.pmod("example_id", F.lit(2)) == half), path)
    return spark.read.schema("example_id LONG, final_answer STRING").json(path)


@query("sink_objects", "SELECT CAST(json ->> '$.ticker' AS VARCHAR) AS ticker FROM (SELECT unnest(json_extract(metadata, '$.focuses[*]')) AS json FROM qa_answer WHERE metadata IS NOT NULL AND json_valid(metadata))")
def sink_objects(spark, d):
    """Objects found in noise, written a line each."""
    path = place(spark, "objects")
    noisy = table(spark, d, "qa_answer").where(F.try_parse_json("metadata").isNotNull()).select("example_id", F.concat(F.lit("so: } "), F.get_json_object("metadata", "$.focuses"), F.lit(" [end")).alias("t"))
    writers.write_objects(datasets.objects_in_text(noisy, "example_id", "t"), path)
    return spark.read.schema("ticker STRING").json(path)


@query("sink_group_map", "SELECT source AS file, CAST(least(250, floor(count(*) / 5)) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 5")
def sink_group_map(spark, d):
    path = place(spark, "groups")
    writers.group_map(datasets.tiled_groups(numbered(spark, d), "source", "n"), path)
    got = spark.read.schema("file STRING, groups ARRAY<ARRAY<STRUCT<n: INT>>>").json(path)
    return got.select("file", F.size("groups").cast("long").alias("n"))


@query("sink_quarantine", "SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN trim(text) = '' THEN 'blank' END AS error FROM documents")
def sink_quarantine(spark, d):
    error = F.when(F.col("text").isNull(), "no text").when(F.trim("text") == "", "blank")
    good, bad = writers.quarantined(docs(spark, d).select("doc_id", "text"), error)
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", F.col("_error").alias("error")))


@query("sink_batches", "SELECT count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents")
def sink_batches(spark, d):
    """Sent in batches, counted where they arrive."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def send(rows: list) -> None:
        n.add(len(rows))
        total.add(sum(r["doc_id"] for r in rows))

    writers.send_batches(docs(spark, d).select("doc_id"), send, 64)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


@query("keep_last_rows", "SELECT DISTINCT ON (ticker) ticker, filing_no FROM (SELECT metadata.ticker AS ticker, filing_no FROM sectioned_filing) ORDER BY ticker, filing_no DESC")
def keep_last_rows(spark, d):
    return filings.keep_last(table(spark, d, "sectioned_filing").select("metadata.ticker", "filing_no"), ["ticker"], ["filing_no"])
