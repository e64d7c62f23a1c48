import random

import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import quality  # noqa: E402

SUBJECTS = ["unit", "board", "group", "firm", "bank", "plant"]


def _prose(i):
    random.seed(i)
    parts = [f"The {random.choice(SUBJECTS)} grew by {random.randrange(99)} percent in the year, and the board agreed to {'very ' * random.randrange(4)}large plans.", "We expect that the cost of freight will fall in the half.", f"As of May, the {random.choice(SUBJECTS)} had not paid the notes (see page {i})."]
    return random.choice([" ", "\n"]).join(random.choices(parts, k=random.randrange(2, 5)))


def test_scores_overrule_the_lines(spark, monkeypatch):
    # sentences without a stop look like junk line by line; the other statistics are those of prose
    bare = " ".join(_prose(i).replace(".", "").replace(",", "").replace("(", "").replace(")", "") for i in range(900, 904))
    table = "\n".join(f"row {i}|{i * 7}|{i * 3}%" for i in range(12))
    rows = [(i, _prose(i)) for i in range(300)] + [(1000, bare), (1001, table), (1002, "#=#\n" * 9)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    lines = {r["id"]: r["kind"] for r in quality.measured(df).collect()}
    got = {r["id"]: r for r in quality.assessed(df).collect()}
    assert lines[1001] == "table" and lines[1002] == "junk"
    assert got[1001]["kind"] == "table" and got[1002]["kind"] == "junk"
    assert lines[1000] != "prose" and got[1000]["kind"] == "prose" and not got[1000]["outlier"]
    # texts that say one sentence over again fall out of so small a corpus too
    assert sum(got[i]["outlier"] for i in range(300)) <= 3
    # the same with the common values joined by broadcast and the others by shuffle
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(quality, "HOT_SHARE", 20)
    again = {r["id"]: (r["kind"], round(r["score"], 6)) for r in quality.assessed(df).collect()}
    assert again == {i: (r["kind"], round(r["score"], 6)) for i, r in got.items()}


def test_empty_blank_null_and_without_prose(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "")], "doc_id int, text string")
    assert quality.assessed(df).count() == 0 and quality.assessed(df.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a|b|c\n1|2|3\n4|5|6"), (1, "a|b|c\n1|2|3\n4|5|6")], "doc_id int, text string")
    assert [(r["id"], r["kind"], r["outlier"]) for r in quality.assessed(df).collect()] == [(1, "table", True)] * 2
