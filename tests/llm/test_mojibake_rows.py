import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import mojibake  # noqa: E402


def test_rows_behind_a_shuffle_and_equal_ones(spark):
    bad = "Zürnau".encode().decode("cp1252")
    rows = [(i, f"In {bad} of {bad} row {i}") for i in range(40)] + [(7, f"In {bad} of {bad} row 7"), (8, None), (9, "plain")]
    df = spark.createDataFrame(rows, "df_index int, transcript string").repartition(6, F.rand(1)).orderBy(F.rand(2))
    got = sorted((r["id"], r["text"] or "", r["n_repaired"], r["n_lost"]) for r in mojibake.repaired(df).collect())
    assert got == sorted((i, (t or "").replace(bad, "Zürnau"), 2 if bad in (t or "") else 0, 0) for i, t in rows)


@pytest.mark.parametrize("word", ["Привет", "東京タワー", "안녕하세요", "Ελλάδα", "שלום"])
def test_other_scripts_that_no_clean_word_shows(spark, word):
    df = spark.createDataFrame([(1, f"said {word.encode().decode('latin-1')} today"), (2, f"said {word} today")], "df_index int, transcript string")
    got = {r["id"]: r for r in mojibake.repaired(df).collect()}
    assert got[1]["text"] == got[2]["text"] == f"said {word} today" and got[1]["n_repaired"] and not got[2]["n_repaired"]
    alone = {r["id"]: r["text"] for r in mojibake.repaired(df.where("df_index = 1")).collect()}
    assert alone == {1: f"said {word} today"}


def test_plain_words_are_passed_over_at_once(spark):
    df = spark.createDataFrame([("a" * 300_000 + " é",)], "t string")
    began = time.time()
    assert df.select(F.regexp_extract_all("t", F.lit(mojibake.WORD), F.lit(0)).alias("w")).first()["w"] == ["é"]
    assert time.time() - began < 10
