import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import mojibake  # noqa: E402


def test_stray_halves_of_no_break_spaces(spark):
    rows = {1: "GoodÂ day to all", 2: "It ended.Â Then more", 3: "a cafÃ©Â here", 4: "SÃO Ávila, Âge d'or, pâle", 5: "Слово В начале", 6: "GoodВ day", 7: "Good\u00a0day"}
    df = spark.createDataFrame(list(rows.items()), "df_index int, transcript string")
    got = {r["id"]: r for r in mojibake.repaired(df).collect()}
    assert {k for k, r in got.items() if r["n_repaired"] + r["n_lost"]} == {1, 2, 3, 6}
    assert got[1]["text"] == "Good\u00a0day to all" and got[2]["text"] == "It ended.\u00a0Then more" and got[3]["text"] == "a café\u00a0here" and got[6]["text"] == "Good\u00a0day"
    assert all(got[k]["text"] == rows[k] for k in (4, 5, 7))


def test_chains_of_three_encodings():
    once = "é".encode().decode("cp1252")
    third = once.encode().decode("latin-1").encode().decode("mac_roman")
    assert third in {form for form, _ in mojibake.garbled_forms("é")}
