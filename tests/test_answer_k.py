from ledgerloom.operators import retrieval
from ledgerloom.plans import catalog


def test_answer_batch_takes_the_whole_k(spark, monkeypatch):
    seen = {}

    def answered(asked, chunks, gazetteer, prices, today, k=retrieval.TOP_K):
        seen["k"] = k

    rows = spark.createDataFrame([(1, "q")], "example_id int, user_query string")
    monkeypatch.setattr(catalog.answer, "answered", answered)
    for name in ("asked", "table", "prices"):
        monkeypatch.setattr(catalog, name, lambda *a: rows)
    monkeypatch.setattr(catalog.retrieval, "point_chunks", lambda points, chunks: points)
    catalog.answer_batch(spark, "")
    assert seen == {"k": 70}
