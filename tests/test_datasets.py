import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import datasets, transcripts
from ledgerloom.operators.datasets import random_starts


@given(st.integers(0, 60), st.integers(1, 7), st.integers(0, 20), st.integers(0, 5))
def test_random_groups_never_overlap(n, size, most, seed):
    starts = random_starts(n, size, most, seed)
    taken = [i for s in starts for i in range(s, s + size)]
    assert len(taken) == len(set(taken)) and all(0 <= i < n for i in taken) and len(starts) <= most and starts == random_starts(n, size, most, seed)


def test_focus_rules(spark):
    meta = [
        {"focuses": [{"ticker": "A", "year": "2019", "quarter": "Q1", "source_type": "sec_filing"}, {"ticker": "B", "year": 2020, "quarter": ["Q3"], "source_id": "7.5"}]},
        {"focuses": {"ticker": "C", "quarter": "2023"}}, {"ticker": "D", "year": "N/A", "raw_quarter": "4"}, {"focuses": [5]},
    ]
    rows = [(i, "q", json.dumps(m)) for i, m in enumerate(meta)] + [(9, "q", None), (10, " ", "{}"), (11, "q", "{bad")]
    df = spark.createDataFrame(rows, "example_id int, user_query string, metadata string")
    got = {(r["id"], r["focus_no"]): r for r in datasets.standardized(df).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (2, 0)}
    assert got[0, 0]["year"] == 2019 and got[0, 0]["normalized_doc_type"] == "SEC FILING" and got[0, 1]["quarter"] == "Q3" and got[0, 1]["source_id"] is None
    assert got[1, 0]["quarter"] == "Q2" and got[2, 0]["quarter"] == "Q4" and got[2, 0]["year"] is None
    assert [(r["id"], r["year"]) for r in datasets.textual_years(df).orderBy("id").collect()] == [(0, "2019"), (2, "N/A")]
    assert datasets.standardized(df.limit(0)).count() == 0


def test_objects_in_noise(spark):
    noisy = 'log {"a": 1} then [{"b": 2}, 3, {"c": [4]}] and {broken {"d": 5}'
    df = spark.createDataFrame([("x", noisy), ("y", None), ("z", "no json")], "k string, t string")
    assert [json.loads(r["json"]) for r in datasets.objects_in_text(df, "k", "t").orderBy("object_no").collect()] == [{"a": 1}, {"b": 2}, {"c": [4]}, {"d": 5}]


def test_turn_table(spark):
    text = (
        "Alpha Corp (ALP) Q1 2020 Earnings Call\nCall Participants:\nJane Roe -- Chief Officer\nJohn Doe -- Analyst\n\nPrepared Remarks:\n"
        "Operator\nGood day to all. Good day to all. Yes.\nJane Roe -- Chief Officer\nWe did very well.\nThis year was good.\nQuestions and Answers:\nJohn Doe -- Analyst\nHow was it then?\nOperator\n"
    )
    df = spark.createDataFrame([(1, text, "alp", "2020-Q1", None, "NYSE: ALP"), (2, None, None, None, None, None), (3, " ", "x", None, None, None)], "df_index int, transcript string, ticker string, q string, date string, exchange string")
    rows = [r for r in transcripts.turn_table(df).orderBy("turn_no").collect() if r["speaker_full"] != "Unknown"]
    assert [(r["speaker_simple_name"], r["section"]) for r in rows if r["section"] != "Introduction/Presentation"] == [("Operator", "Prepared Remarks"), ("Jane Roe", "Prepared Remarks"), ("John Doe", "Q&A")]
    assert any(r["text"] == "Good day to all." for r in rows) and all(r["turn_id"].startswith("ALP_2020_Q1_turn") for r in rows)


def test_prompt(spark):
    df = spark.createDataFrame([("q", None)], "q string, a string")
    assert df.select(datasets.prompt(datasets.INTENT_PROMPT, F.col("q"), F.col("a")).alias("p")).first()["p"].endswith("### Classification:\n")
