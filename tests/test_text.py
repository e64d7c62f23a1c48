from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import filings


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_lines_and_spacing(spark):
    assert one(spark, "12\nF-3\nText stays\nItem 1A. Risks 14\n10-K report", X.without_lines) == "Text stays"
    assert one(spark, " a  b\n\n c ", X.single_spaced) == "a b c"
    assert one(spark, "“x” • y—z", X.plain_punctuation) == '"x" *  y--z'
    assert one(spark, "helloWorld iPhone ABCd", X.split_joined_words) == "hello World i Phone ABCd"


def test_sentences_keep_first(spark):
    got = one(spark, "Alpha one. Beta two. ALPHA  one. Gamma (x). Beta two.", lambda c: X.kept_first(X.sentences(c)))
    assert got == "Alpha one. Beta two. Gamma (x)."
    assert one(spark, "Yes. Real words here. Yes.", lambda c: X.kept_first(X.sentences(c, False), 2)) == "Real words here."


def test_words_and_nulls(spark):
    assert one(spark, "  ", X.word_count) == 0
    assert one(spark, None, X.word_count) is None
    assert one(spark, None, filings.clean_text) is None
    assert one(spark, "", filings.clean_text) == ""


def test_dates(spark):
    for text, want in [("2020-02-03", "2020-02-03"), ("20200203", "2020-02-03"), ("2/3/2020", "2020-02-03"), ("13/3/2020", "2020-03-13"), ("9 Aug 2018", "2018-08-09"), ("Jan 25, 2013, 7:00 p.m. ET", "2013-01-25"), ("n/a", "None"), ("", "None")]:
        assert str(one(spark, text, X.parsed_date)) == want, text
    for text, want in [("price on March 2022?", "2022-03-01"), ("on 3 Jan 2022", "2022-01-03"), ("on January 3, 2022", "2022-01-03"), ("none", "")]:
        assert one(spark, text, X.date_in_query) == want


def test_cik_is_never_cut(spark):
    assert one(spark, "x/data/42/y", X.cik_of) == "0000000042"
    assert one(spark, "x/data/123456789012/y", X.cik_of) == "123456789012"
    assert one(spark, "none", X.cik_of) is None


def test_speech_and_citations(spark):
    assert one(spark, "So  [operator instructions] please go ahead. it is", X.without_noise) == "So   it is"
    assert one(spark, " [CHUNK 1] yes [CHUNK 2]", X.without_citations) == "yes"
    assert one(spark, "it is market_data_only", X.intent_of) == "MARKET_DATA_ONLY"


def test_html(spark):
    assert one(spark, "<p>a &amp; b<script>x()</script><!-- c --></p>", X.html_text) == "a & b"


def test_section_rules(spark):
    body = "word " * 120
    docs = spark.createDataFrame([(1, f"Intro Item 1. {body}Item 1A. short Item 7. {body}"), (2, None), (3, "")], "id int, t string")
    rows = {(r["id"], r["item"]) for r in filings.sections_10k(docs, "id", "t").collect()}
    assert rows == {(1, "1"), (1, "7")}
    mapped = {r["item"]: r["text"] for r in filings.sections_10k(docs, "id", "t", as_mapping=True).collect()}
    assert mapped["1A"] == "short" and mapped["PREFACE"] == "Intro"
    q = spark.createDataFrame([(1, f"Item 2. Management's view {body}ITEM 3. Market {'1 2 3 4 5 6 7 8 9 ' * 60}Item 2. nothing {body}")], "id int, t string")
    assert [r["item"] for r in filings.sections_10q(q, "id", "t").collect()] == ["2"]


def test_clean_filings_accept_both_layouts(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [("A", "2020-01-02", f"Cover. Item 1. {words}", None, "x/data/7/y", "10-K"), ("B", "bad", None, ["skip", f"Item 1. {words}", f"Item 1. {words}", "us-gaap:x"], None, "10-K"), ("AAPL", None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "ticker string, date string, text string, text_chunks array<string>, url string, filing_type string")
    got = {r["ticker"]: r for r in filings.routed_clean(raw).collect()}
    assert set(got) == {"A", "B"} and got["A"]["cik"] == "0000000007" and got["A"]["year"] == 2020 and got["B"]["year"] is None
    assert got["B"]["cleaned_text"].count("w79") == 1
    assert filings.clean_filings(raw.limit(0)).count() == 0
