import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import neighbours  # noqa: E402


def test_default_recall_in_many_cells(spark, monkeypatch):
    # 2,000 unrelated vectors, cells of 10: at 24 probes an eighth of the cells would be searched
    monkeypatch.setattr(neighbours, "CELL", 10)
    monkeypatch.setattr(neighbours, "ASKERS", 128)
    v = np.random.default_rng(6).standard_normal((2000, 64)).astype("f4")
    df = spark.createDataFrame([(f"{i:04d}", [float(y) for y in x]) for i, x in enumerate(v)], "id string, vector array<float>")
    got = {}
    for r in neighbours.nearest(df, k=10).collect():
        got.setdefault(int(r["id"]), set()).add(int(r["neighbour"]))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert len(got) == len(v) and all(len(x) == 10 for x in got.values())
    assert sum(len(got[i] & set(np.argsort(-s[i])[:10].tolist())) for i in got) >= 0.999 * 10 * len(v)
