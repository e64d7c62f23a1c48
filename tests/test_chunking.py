from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import chunking
from ledgerloom.operators.chunking import Chunker


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\n\n", "\n", " ", "x" * 3, "y" * 7, "z" * 40]), max_size=80), st.integers(10, 30), st.integers(0, 9))
def test_chunks_cover_in_order(parts, size, overlap):
    # every character that isn't white space is made unique, so positions are known
    text, n = "", 0x4E00
    for p in parts:
        for c in p:
            text += c if c.isspace() else chr(n)
            n += not c.isspace()
    chunks = Chunker(size, overlap).split(text)
    at, covered, last = 0, set(), -1
    for c in chunks:
        assert 0 < len(c) <= size and c in text
        at = text.index(c[0])
        # a chunk may start where the last one did if that fits into the overlap whole
        assert at >= last
        last = at
        covered |= set(c)
    assert {c for c in text if not c.isspace()} <= covered
    if len(text) <= size:
        assert chunks == ([text.strip()] if text.strip() else [])


def test_chunk_tables(spark):
    df = spark.createDataFrame([(1, "word " * 500), (2, None), (3, "  "), (1, "word " * 500)], "id int, text string")
    rows = chunking.chunked(df, "text").select("id", "chunk_seq", F.length("chunk_text").alias("n")).collect()
    assert {r["id"] for r in rows} == {1} and max(r["n"] for r in rows) <= 1000
    assert sorted(r["chunk_seq"] for r in rows)[:2] == [0, 0]
    b = chunking.batch_numbers(spark.range(1030).toDF("id"), ["id"], 512)
    assert {(r["batch"], r["n"]) for r in b.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {(0, 512), (1, 512), (2, 6)}
    assert chunking.batch_numbers(spark.range(0).toDF("id"), ["id"], 5).count() == 0
