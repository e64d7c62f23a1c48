import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval, search
from ledgerloom.operators.providers import LexicalScorer

NAMES = ["side", "id", "year", "quarter", "kind", "date_quarter", "v", "words"]


def group(rng, focuses, chunks, dim=6):
    """A group whose chunks have many equal vectors, so that ties are everywhere."""
    made = search.Group(dim)
    v = rng.integers(-2, 3, (chunks // 3, dim))[rng.integers(0, chunks // 3, chunks)].astype(float) / 7
    for start in range(0, chunks, 37):
        n = len(v[start : start + 37])
        pick = lambda *of: rng.choice(of, n).astype(np.int32)  # noqa: B023, E731
        rows = [pick(1), [f"c{i:04d}" for i in range(start, start + n)], pick(2020, 2021, search.NONE), pick(1, 2, search.NONE), pick(0, 1, 2, 3), pick(1, 2, 3, search.NONE), v[start : start + 37].tolist(), [[int(x) for x in np.unique(rng.integers(0, 30, 5))] for _ in range(n)]]
        if not start:
            pick = lambda *of: rng.choice(of, focuses).astype(np.int32)
            rows_f = [[0] * focuses, [f"f{i:03d}" for i in range(focuses)], pick(2020, 2021, 1990, 0, search.NONE), pick(1, 2, search.NONE), pick(0, 1, 2, 3), np.ones(focuses, np.int32), rng.integers(-2, 3, (focuses, dim)).astype(float).tolist(), [[int(x) for x in np.unique(rng.integers(0, 30, 4))] for _ in range(focuses)]]
            rows = [[*a, *b] for a, b in zip(rows_f, rows, strict=True)]
        types = [pa.int32(), pa.string(), *[pa.int32()] * 4, pa.list_(pa.float64()), pa.list_(pa.int64())]
        made.add(pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(rows, types, strict=True)], names=NAMES))
    assert made.closed()
    return made


def by_hand(g, f, k):
    """The levels one after the other, every chunk looked at."""
    year, quarter, kind = (int(g.f[n][f]) for n in ("year", "quarter", "kind"))
    none = search.NONE

    def hits(y, q, d, m):
        fits = [c for c in range(g.n) if (y in (none, 0) or g.year[c] == y) and (d == 0 or g.kind[c] == d) and (d != search.CALL or q == none or g.quarter[c] == q)]
        scores = {}
        for c in fits:
            scores[c] = 0.0
            for a, b in zip(g.q[f], g.p[c], strict=True):
                scores[c] += a * b
        best = sorted(fits, key=lambda c: (-scores[c], c))[:m]
        return [c for c in best if d != search.QUARTERLY or q == none or g.date_quarter[c] == q]

    steps = [(0, year, quarter, kind, True), (1, year, none, kind, quarter != none), (2, none, none, kind, year != none), (3, none, none, 0, True)]
    for level, y, q, d, on in steps:
        if on and (base := hits(y, q, d, k)):
            out = [(level, c) for c in base]
            more = [(11, y, none, d, q != none), (12, none, none, d, y != none), (13, y, q, 0, level < 3)] if len(base) < k else []
            for n, *at, wanted in more:
                if wanted:
                    out += [(n, c) for c in hits(*at, 2 * k) if c not in {x for _, x in out}]
            return out[:k]
    return []


def test_search_is_that_of_all_chunks(monkeypatch):
    monkeypatch.setattr(search, "COLUMNS", 50)
    monkeypatch.setattr(search, "CELLS", 400)
    monkeypatch.setattr(search, "HELD", 3000)
    g = group(np.random.default_rng(5), 60, 200)
    for k in (4, 25):
        r, level, c, score, rank = g.searched(np.arange(60), k)
        for f in range(60):
            assert list(zip(level[r == f], c[r == f], strict=True)) == by_hand(g, f, k), f
        assert (rank == np.concatenate([np.arange((r == f).sum()) + 1 for f in range(60)])).all()
    share = g.shares(r, c)
    for i in range(0, len(r), 7):
        asked = set(g.asks[g.ask_starts[r[i]] : g.ask_starts[r[i] + 1]])
        assert share[i] == len(asked & set(g.has[g.starts[c[i]] : g.starts[c[i] + 1]])) / len(asked)


def test_reranking_where_chunks_are_found_is_that_of_the_scorer(spark):
    words = "net sales rose fell margin plant Permits segment Q1 2020".split()
    pick = lambda i, n: " ".join(words[(i * 7 + j * j) % len(words)] for j in range(n))
    points = [(f"p{i:03d}", "AA" if i % 3 else "BB", 2020 + i % 2, "Q1", "sec_filing", ["10k", "10q"][i % 2], 1 + i % 4, [1.0, (i % 11) / 9], pick(i, i % 9) if i % 13 else None) for i in range(150)]
    points = spark.createDataFrame(points, "point_id string, ticker string, year int, quarter string, source_type string, filing_category string, date_quarter int, vector array<double>, chunk_text string")
    foci = [(f"f{i}", "AA" if i % 2 else "BB", [2020, 2021, None][i % 3], [1, None][i % 2], ["10-K", "10-Q", None][i % 3], [0.5, i - 4.0], pick(i, i % 6) if i else None) for i in range(12)]
    foci = spark.createDataFrame(foci, "focus_idx string, ticker string, year int, quarter int, doc_type string, query_vector array<double>, query string")
    columns = ["focus_idx", "rank", "tier", "point_id", "score", "rerank_score", "chunk_text"]
    apart = retrieval.retrieve(foci, points, 20).join(foci.select("focus_idx", "query"), "focus_idx").withColumn("rerank_score", LexicalScorer().score(F.col("query"), F.col("chunk_text")))
    want = sorted(map(tuple, retrieval.reranked(apart, "rerank_score").select(columns).collect()), key=str)
    got = sorted(map(tuple, retrieval.retrieve(foci, points, 20, LexicalScorer().features).select(columns).collect()), key=str)
    assert got == want and len(got) > 50


def test_many_questions_on_one_ticker(spark):
    """3,000 questions on 20,000 chunks of one ticker: far over the bound when pairs were rows."""
    vector = lambda seed: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(1000)) / 1000.0 - 0.5)
    nothing = lambda kind: F.lit(None).cast(kind)
    chunks = spark.range(20_000).select(F.col("id").cast("string").alias("point_id"), F.lit("AA").alias("ticker"), nothing("int").alias("year"), nothing("string").alias("quarter"), F.lit("x").alias("source_type"), nothing("string").alias("filing_category"), nothing("int").alias("date_quarter"), vector(1).alias("vector"), F.lit("t").alias("chunk_text"))
    foci = spark.range(3_000).select(F.col("id").cast("string").alias("focus_idx"), F.lit("AA").alias("ticker"), nothing("int").alias("year"), nothing("int").alias("quarter"), nothing("string").alias("doc_type"), vector(2).alias("query_vector"))
    began = time.time()
    assert retrieval.retrieve(foci, chunks, 7).count() == 21_000
    assert time.time() - began < 90
