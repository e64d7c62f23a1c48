import datetime as dt
import json

from ledgerloom.operators import drift

SCHEMA = "stream_name string, file_name string, written_at timestamp_ntz, received_at timestamp_ntz, line_no int, raw_line string"


def lines(*files):
    out = []
    for n, (name, records) in enumerate(files):
        at = dt.datetime(2020, 1, n + 1)
        out += [("s", name, at, at, i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    return out


def focus(**f):
    return {"user_query": "what was it", "metadata": {"focuses": [f]}}


def test_changes(spark):
    a = [focus(ticker=t, year=2020, call_time="10:00 ET") for t in ("ABCDJ", "XYZAJ", "QRSTJ")]
    b = [focus(symbol=t, year="2021", call_time="11:30 ET") for t in ("DEFGJ", "HIJKJ")] + ["", "INFO done", None, "{broken"]
    c = [focus(symbol="LMNOJ", year="2022", is_estimate=True) for _ in range(12)] + [focus(symbol="LMNOJ", year="2022", is_estimate=False, stray=1)]
    rows = lines(("f1", a), ("f2", b), ("f3", c))
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    got = {(r["file_name"], r["change_type"], r["old_field"], r["new_field"]) for r in drift.file_changes(drift.file_schemas(df)).collect()}
    assert got == {("f2", "renamed", "ticker", "symbol"), ("f2", "retyped", "year", "year"), ("f3", "removed", "call_time", ""), ("f3", "added", "", "is_estimate")}


def test_containers_and_values(spark):
    first = [focus(ticker="ABCDJ", company_name={"label": "W Corp"})] * 3
    a = [focus(ticker="ABCDJ", issuer={"label": "X Corp"})] * 3
    b = [{"user_query": "q", "metadata": {"ticker": "ABCDJ", "issuer": {"label": "Y Corp"}}}] * 3
    df = spark.createDataFrame(lines(("f0", first), ("f1", a), ("f2", b)), SCHEMA)
    changes = drift.file_changes(drift.file_schemas(df))
    assert {(r["file_name"], r["change_type"], r["old_field"]) for r in changes.collect()} == {("f1", "renamed", "company_name"), ("f2", "removed", "focuses")}
    rows = drift.standard_focuses(df).collect()
    assert len(rows) == 9 and {r["company_name"] for r in rows} == {"W Corp", "X Corp", "Y Corp"}
    branch = next(r for r in rows if r["company_name"] == "X Corp")["branches"]["company_name"]
    assert (branch["field"], branch["type"], json.loads(branch["value"])) == ("issuer", "object", {"label": "X Corp"})


def test_names_follow_chains_of_renames(spark):
    rows = [("renamed", "ticker", "a")] * 2 + [("renamed", "a", "b"), ("renamed", "c", "b"), ("renamed", "year", "d"), ("renamed", "d", "a"), ("added", "", "e"), ("renamed", "x", "y")]
    changes = spark.createDataFrame(rows, "change_type string, old_field string, new_field string")
    got = {r["name"]: r["standard"] for r in drift.standard_names(changes).collect()}
    assert {k: got.get(k) for k in "abcdexy"} == {"a": "ticker", "b": "ticker", "c": "ticker", "d": "year", "e": None, "x": None, "y": None}


def test_values_that_cannot_be_converted_stay_in_their_branch(spark):
    df = spark.createDataFrame(lines(("f", [focus(ticker="ABCDJ", year="about 2019", source_id=7.5)])), SCHEMA)
    row = drift.standard_focuses(df).first()
    assert row["year"] is None and row["source_id"] is None
    assert json.loads(row["branches"]["year"]["value"]) == "about 2019" and row["branches"]["source_id"]["type"] == "number"


def test_long_texts_of_other_lengths_are_no_rename(spark):
    a = [{"user_query": "q", "note": "word " * 20}] * 3
    b = [{"user_query": "q", "body": "word " * 2000}] * 3
    c = [{"user_query": "q", "text": "long " * 2100}] * 3
    df = spark.createDataFrame(lines(("f1", a), ("f2", b), ("f3", c)), SCHEMA)
    got = {(r["file_name"], r["change_type"], r["old_field"], r["new_field"]) for r in drift.file_changes(drift.file_schemas(df)).collect()}
    assert got == {("f2", "removed", "note", ""), ("f2", "added", "", "body"), ("f3", "renamed", "body", "text")}


def test_lines_delivered_twice_in_other_words(spark):
    rows = lines(("f", [focus(ticker="ABCDJ")] * 3))
    twice = [(*r[:5], json.dumps(focus(ticker="AAAAJ"))) for r in rows[:1]]
    df = spark.createDataFrame(rows + rows[1:2] + twice, SCHEMA)
    assert sorted(r["ticker"] for r in drift.standard_focuses(df).collect()) == ["AAAAJ", "ABCDJ", "ABCDJ"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert drift.file_changes(drift.file_schemas(df)).count() == 0 and drift.standard_focuses(df).count() == 0
