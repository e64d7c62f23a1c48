import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import splitting  # noqa: E402


def test_no_piece_exceeds_its_limit(spark):
    random.seed(7)
    units = ["word ", "longer-word ", "End. ", "Said so.” ", "\n", "\n\n", "\n" + " " * 400 + "\n", "\r\n\r\n", "; ", " " * 300, "x" * 250, "\t", "é😀 "]
    texts = ["".join(random.choices(units, k=random.choice([5, 40, 200]))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, overlap in ((1000, 150), (100, 0), (60, 20)):
        got = {}
        for r in splitting.split_texts(df, size, overlap).orderBy("id", "piece_no").collect():
            got.setdefault(r["id"], []).append(r)
        for i, t in enumerate(texts):
            t, end = t.strip(splitting.BLANKS), 0
            for r in got.get(i, []):
                assert len(r["piece"]) <= size and t[r["start"] :].startswith(r["piece"]) and r["start"] <= end and end - r["start"] <= overlap
                end = r["start"] + len(r["piece"])
            assert end == len(t)


def test_a_blank_line_is_the_strongest_boundary(spark):
    text = "First part. It goes on\n   \nSecond part. And on and on"
    pieces = [r["piece"] for r in splitting.split_texts(spark.createDataFrame([(1, text)], "id int, text string"), 40, 0).orderBy("piece_no").collect()]
    assert pieces == ["First part. It goes on\n   \n", "Second part. And on and on"]


def test_running_starts_over_many_blocks(spark):
    lengths = [random.randrange(1, 9) for _ in range(1000)]
    df = spark.createDataFrame([(lengths,), ([3],), ([2] * splitting.FOLD,)], "n array<int>")
    for r in df.select("n", splitting.running_starts(F.col("n")).alias("s")).collect():
        assert r["s"] == [sum(r["n"][:i]) for i in range(len(r["n"]))]
