import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import pairs  # noqa: E402

SUBJECTS = "freight margins backlog pensions drought tariffs patents inventory wages leases".split()
FIRMS = "Alba Borea Cirrus Delphi Erebus Fornax Gaia Helios Icarus Juno".split()


def _asked(i):
    return [f"What did {FIRMS[i]} note on {SUBJECTS[i]}?", f"Explain {SUBJECTS[i]} at {FIRMS[i]}.", f"List the {SUBJECTS[i]} of {FIRMS[i]}."][i % 3]


def _defects(spark, rows):
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "example_id int, user_query string, final_answer string")
    return {r["id"]: r["defect"] for r in pairs.defects(df).collect()}


def test_templates_without_any_listed_word_are_refusals(spark):
    said = [lambda i: "That lies beyond the remit of our desk.", lambda i: f"Views on {FIRMS[i]} lie beyond the remit of our desk. Kindly ask elsewhere.", lambda i: f"Nobody here comments on {SUBJECTS[i]}."]
    rows = [(_asked(i), s(i)) for s in said for i in range(10)]
    assert _defects(spark, rows) == dict.fromkeys(range(len(rows)), "refusal")


def test_recurring_answers_that_vary_are_sound_whatever_their_words(spark):
    causes = "plant downtime,weaker demand,new permits,higher wages,late shipments,lower rates,scrap reduction,bad weather,price cuts,longer terms".split(",")
    rows = [(f"{_asked(i)} {FIRMS[-i]}", f"Management declined to give me a range, citing {causes[i]} and {causes[(i + k) % 10]}.") for i in range(10) for k in range(1, 6)]
    rows += [(_asked(i), f"My view is that I cannot see {FIRMS[-1 - i]} Holdings buy it.") for i in range(10)]
    assert _defects(spark, rows) == {}


def test_one_prompt_asked_again_and_again_is_no_recurrence(spark):
    rows = [("How is the unit of Alba doing?", "The unit of our group does rather well these days.")] * 40
    assert _defects(spark, rows) == {}


def test_nulls_blanks_and_repeats(spark):
    rows = [(None, None), (None, "It does well."), ("", "It does well."), ("Why so?", " "), ("Why so?", "Why so?"), ("Why so?", "Why so?")]
    assert _defects(spark, rows) == {0: "empty", 3: "empty", 4: "copy", 5: "copy"}
