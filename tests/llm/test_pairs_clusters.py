import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import pairs  # noqa: E402


def test_long_chains_settle(spark):
    chain = [" ".join(f"w{i + j:04d}" for j in range(14)) for i in range(700)]
    lone = ["nothing is like this one here", "x"]
    df = spark.createDataFrame([(o,) for o in chain + lone], "opening string")
    got = {r["opening"]: r["cluster"] for r in pairs.opening_clusters(df).collect()}
    assert set(got) == set(chain + lone) and all(got[o] == o for o in lone)
    assert len({got[o] for o in chain}) == 1


def test_members_unlike_the_first_head_get_another(spark):
    # one word pair in common, all others different: with one band pair of minima they meet, and "a ..." is the first
    groups = [[f"{g} same start " + " ".join(f"{g}{j}" for j in range(5)) + f" end{k}" for k in range(3)] for g in "abc"]
    df = spark.createDataFrame([(o,) for g in groups for o in g], "opening string")
    got = {r["opening"]: r["cluster"] for r in pairs.opening_clusters(df, bands=40).collect()}
    assert all(len({got[o] for o in g}) == 1 for g in groups) and len(set(got.values())) == 3


def test_refusals_in_other_languages(spark):
    said = {
        "Was trieb den Umsatz der Firma und wie hat sich die Marge verändert?": "Es tut mir leid, aber ich kann diese Frage leider nicht beantworten.",
        "Pourquoi la marge de la société est en recul sur le semestre?": "Je suis désolé, mais je ne peux pas répondre à cette question.",
        "¿Por qué los ingresos de la empresa bajaron y cómo sigue el margen?": "Lo siento, pero no puedo responder a esa pregunta.",
    }
    sound = {
        "Was hat die Firma zum Umsatz gesagt und warum?": "Die Firma wollte sich zu der Frage nicht äußern und nannte keine Zahlen.",
        "Pourquoi la marge est en recul et quels sont les risques?": "La société ne peut pas céder l'unité avant la fin de la période prévue.",
    }
    rows = [(i, q, a) for i, (q, a) in enumerate([*said.items(), *sound.items()])]
    df = spark.createDataFrame(rows, "example_id int, user_query string, final_answer string")
    got = {r["id"]: r["defect"] for r in pairs.defects(df).collect()}
    assert got == dict.fromkeys(range(len(said)), "refusal")
