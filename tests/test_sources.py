import json

from pyspark.sql import functions as F

from ledgerloom.sources import readers, writers
from ledgerloom.streaming import ingest


def test_listings(spark, tmp_path):
    head = "Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares\n"
    (tmp_path / "n.txt").write_text(head + "aapl|Apple|Q|N|N|100|N|N\nZTST|Test|Q|Y|N|100|N|N\nQQQ|Fund|G|N|N|100|Y|N\nFile Creation Time: 1|||||||\n")
    rows = readers.nasdaq_listing(spark, str(tmp_path / "n.txt"))
    assert [r["ticker"] for r in rows.collect()] == ["aapl"]
    more = spark.createDataFrame([(" aapl ",), ("MSFT",), (None,), ("",)], "ticker string")
    assert {r["ticker"] for r in readers.universe(rows, more).collect()} == {"AAPL", "MSFT"}


def test_cik(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"0": {"ticker": "AAPL", "cik_str": 320193}, "1": {"ticker": "aapl", "cik_str": 5}}))
    lookup = readers.cik_table(spark, str(tmp_path / "c.json"))
    companies = spark.createDataFrame([("aapl", 1), ("zzz", 2)], "ticker string, cik_x int")
    assert [(r["ticker"], r["cik"]) for r in readers.with_cik(companies, lookup, "ord").collect()] == [("aapl", "0000320193")]
    assert [r["ticker"] for r in readers.without_cik(companies, lookup).collect()] == ["zzz"]


def test_html_tables(spark):
    html = "<table id='constituents'><tr><th>Symbol</th><th>Name</th></tr><tr><td><a href='/x'>AAA</a></td><td>A &amp; Co</td></tr></table><table id=tableFile2><tr><td>h</td></tr><tr><td>10-K</td><td><a href='/d'>doc</a></td><td>x</td><td>2020-01-01</td></tr>"
    pages = spark.createDataFrame([("p", html), ("q", None)], "path string, html string")
    assert [r["ticker"] for r in readers.index_members(pages).collect()] == ["AAA"]
    assert [(r["link"], r["date"]) for r in readers.filing_links(pages, 5).collect()] == [("/d", "2020-01-01")]
    rows = spark.createDataFrame([(1, 0, "10-K", "10-K", "/a/exhibit1.htm"), (1, 1, "10-K", "10-K", "/ix?doc=/a/main.htm"), (1, 2, "10-K", "10-K", "/a/b.htm")], "filing_id int, row_no int, doc_type string, filing_type string, file_name string")
    assert [r["file_name"] for r in readers.primary_document(rows).collect()] == ["/a/main.htm"]


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "d.json").write_text(json.dumps({"ticker": "A", "text": "t"}))
    assert readers.json_documents(spark, str(tmp_path)).count() == 1
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n\nbroken\n{"x": 2}\n')
    assert sorted(r["x"] for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "x INT").collect()) == [1, 2]
    assert readers.raw_lines(spark, str(tmp_path / "l.jsonl")).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    for _ in range(2):
        writers.write_new(df, str(tmp_path / "new"), ["k"])
    assert spark.read.parquet(str(tmp_path / "new")).count() == 2
    writers.write_documents(df, str(tmp_path / "docs"), ["k"], ["n"], ["k"])
    assert {r["v"] for r in spark.read.json(str(tmp_path / "docs")).collect()} == {"b", "c"}
    changed = writers.upsert(df.where("v <> 'b'"), spark.createDataFrame([(2, "z", 9), (3, "y", 9)], df.schema), "k")
    assert {(r["k"], r["v"]) for r in changed.collect()} == {(1, "a"), (2, "z"), (3, "y")}
    good, bad = writers.quarantined(df, F.when(F.col("n") > 1, "late"))
    assert good.count() == 2 and bad.first()["_error"] == "late"
    writers.write_parts(spark.range(10), str(tmp_path / "parts"), 3)
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 10


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "Alpha beta. Alpha beta. Gamma."), (2, None)], "id int, text string")
    df.write.parquet(src)
    for _ in range(2):
        ingest.drain(ingest.cleaned_chunks(ingest.incoming(spark, src, "id INT, text STRING"), "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r["chunk_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Alpha beta. Gamma."]
