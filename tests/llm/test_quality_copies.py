import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import quality, queries  # noqa: E402

SUBJECTS = ["unit", "board", "group", "firm", "bank", "plant"]
PAGE = "\n".join(f"- item {c} unit of the plan" for c in "abcdefgh")


def test_a_repeated_page_stays_found(spark, tmp_path):
    prose = [f"The {SUBJECTS[i % 6]} grew in year {i}, and the board of the company agreed to {'very ' * (i % 9)}large plans. We expect that the cost of freight will fall in the half. " * (1 + i % 2) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(prose + [PAGE] * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["kind"] for r in queries.p10_found(spark, str(tmp_path)).collect()}
    assert found == dict.fromkeys(range(60, 90), "list")
    scored = quality.assessed(spark.createDataFrame(rows, "doc_id long, text string")).where("id >= 60").collect()
    assert all(r["outlier"] for r in scored)
