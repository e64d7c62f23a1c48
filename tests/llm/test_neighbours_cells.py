import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import neighbours, queries  # noqa: E402


def _points(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 64))
    v = np.concatenate([c + 0.2 * rng.standard_normal((n, 64)) for c, n in zip(centres, (120, 10, 10, 10, 10, 10), strict=True)])
    return spark.createDataFrame([(f"{i:04x}", [float(y) for y in x], f"x{i}") for i, x in enumerate(v)], "id string, vector array<float>, asks string"), v


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    df, _ = _points(spark)
    whole = sorted(map(tuple, neighbours.nearest(df, k=5, min_cosine=0.85).collect()))
    monkeypatch.setattr(neighbours, "SUBCELL", 7)
    assert sorted(map(tuple, neighbours.nearest(df, k=5, min_cosine=0.85).collect())) == whole and len(whole) == 170 * 5


def test_some_ask_against_all(spark, monkeypatch):
    df, v = _points(spark)
    monkeypatch.setattr(neighbours, "ASKERS", 4)
    got = {}
    for r in neighbours.nearest(df, k=5, asking=queries.hexadecimal_multiple(F.col("id"), 20)).collect():
        got.setdefault(int(r["id"], 16), set()).add(int(r["neighbour"], 16))
    assert set(got) == set(range(0, 170, 20))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert sum(len(got[i] & set(np.argsort(-s[i])[:5].tolist())) for i in got) >= 0.9 * 5 * len(got)


def test_hexadecimal_ids(spark):
    ids = ["84d04818-e446-0eb6-fa29-53ae3d03eccf", "14", "0", "28", "15", None]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select(queries.hexadecimal_multiple(F.col("id"), 20).alias("x")).collect()
    assert [r["x"] for r in got] == [i and int(i.replace("-", ""), 16) % 20 == 0 for i in ids]
