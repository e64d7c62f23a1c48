import time

from ledgerloom.operators import chunking, datasets
from ledgerloom.sources import readers


def test_numbers_within_groups(spark):
    rows = [("a", i) for i in range(50)] + [("b", i) for i in range(7)] + [(None, 3), (None, 1)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    got = {(r["g"], r["k"]): r["row_no"] for r in chunking.row_numbers(df, ["k"], within=["g"]).collect()}
    assert got == {**{("a", i): i + 1 for i in range(50)}, **{("b", i): i + 1 for i in range(7)}, (None, 1): 1, (None, 3): 2}
    assert sorted(r["row_no"] for r in chunking.row_numbers(df, ["k"]).collect()) == list(range(1, 60))
    assert chunking.row_numbers(df.limit(0), ["k"]).count() == 0


def test_draws_from_large_files_are_quick():
    began = time.time()
    starts = datasets.random_starts(10**12, 5, 250, 42)
    assert len(starts) == 250 and len({s // 10**11 for s in starts}) > 7 and time.time() - began < 1
    assert sorted(datasets.permuted(i, 37, 1) for i in range(37)) == list(range(37))


def test_unbalanced_brackets_are_read_once():
    began = time.time()
    text = "[{" * 100_000 + '{"a": [1, 2]}'
    ends = datasets.closings(text)
    assert time.time() - began < 2 and ends[200_000] == len(text)


def test_documents_of_several_folders(spark, tmp_path):
    (tmp_path / "one" / "deep").mkdir(parents=True)
    (tmp_path / "one" / "deep" / "a.json").write_text('{"ticker": "A", "text": "x"}')
    got = readers.json_documents(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()
    assert [(r["ticker"], r["path"].endswith("a.json")) for r in got] == [("A", True)]
    assert readers.json_documents(spark, str(tmp_path / "two")).count() == 0
