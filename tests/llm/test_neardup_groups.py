import random

import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import neardup  # noqa: E402
from ledgerloom.llm.components import components  # noqa: E402


def test_groups_and_links(spark, monkeypatch):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [random.choices(vocabulary, k=80) for _ in range(6)]
    rows = []
    for i, words in enumerate(base):
        rows += [(f"c{i}_{j}", " ".join(words)) for j in range(3 if i else 9)]
        edited = list(words)
        edited[5] = "edited"
        rows.append((f"e{i}", " ".join(edited)))
    rows += [("lone", " ".join(random.choices(vocabulary, k=80))), ("null", None), ("short", "a b")]
    df = spark.createDataFrame(rows, "id string, text string")
    monkeypatch.setattr(neardup, "SPLIT", 4)
    linked, members = neardup.near_duplicates(df, "id", n=3, similarity=0.6, min_words=50)
    pairs = {(r["id_a"], r["id_b"]) for r in neardup.expanded_pairs(linked, members).collect()}
    got = {r["id"]: r for r in neardup.groups(linked, members).collect()}
    assert set(got) == {i for i, t in rows if t and len(t) > 5}
    for i, r in got.items():
        assert r["n_links"] == sum(i in p for p in pairs)
    assert len({r["group_id"] for r in got.values()}) == 7
    assert len(pairs) == 5 * 6 + 45
    linked, members = neardup.near_duplicates(df.limit(0), "id")
    assert neardup.groups(linked, members).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components(links.limit(0)).count() == 0
