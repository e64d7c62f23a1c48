from pyspark.sql import functions as F

from ledgerloom.operators import market, retrieval

POINTS = "point_id string, ticker string, year int, quarter string, source_type string, filing_category string, date_quarter int, vector array<double>, chunk_text string"
FOCI = "focus_idx string, ticker string, year int, quarter int, doc_type string, query_vector array<double>"


def points(spark):
    rows = []
    for i in range(40):
        kind = ["10k", "10q", None][i % 3]
        rows.append((f"p{i:02d}", "AA" if i < 30 else "BB", 2020 + i % 2, f"Q{i % 4 + 1}" if kind is None else None, "sec_filing" if kind else "earnings_transcript", kind, i % 4 + 1, [1.0, i / 40], f"text {i}"))
    rows.append(("bad", "AA", 2020, None, None, None, None, None, None))
    return spark.createDataFrame(rows, POINTS)


def test_levels_and_augmentation(spark):
    foci = spark.createDataFrame(
        [("f1", "AA", 2020, 2, "10-Q", [1.0, 0.0]), ("f2", "AA", 1999, None, "EARNINGS_TRANSCRIPT", [1.0, 1.0]), ("f3", "ZZ", None, None, None, [1.0, 0.0]), ("f4", "BB", None, None, None, [1.0, 0.0])], FOCI
    )
    rows = retrieval.retrieve(foci, points(spark), 8).orderBy("focus_idx", "rank").collect()
    by = {f: [r for r in rows if r["focus_idx"] == f] for f in ("f1", "f2", "f3", "f4")}
    assert not by["f3"] and len(by["f1"]) == 8 and len({r["point_id"] for r in by["f1"]}) == 8
    # 10-Q of 2020 are odd quarters only, so quarter 2 is empty and the first relaxation is the base
    assert {r["tier"] for r in by["f1"]} <= {"Relaxed: No Quarter", "Augmented: No Year/Quarter", "Augmented: No Doc Type"}
    assert by["f2"][0]["tier"] == "Relaxed: No Year/Quarter"
    assert [r["point_id"] for r in by["f4"]] == [r["point_id"] for r in by["f4"]][:8] and all(r["tier"] == "Exact Match" for r in by["f4"])


def test_result_does_not_depend_on_partitions(spark):
    foci = spark.createDataFrame([("f", "AA", 2021, 1, "10-K", [1.0, 0.5])], FOCI)
    first = retrieval.retrieve(foci, points(spark), 10).orderBy("rank").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = retrieval.retrieve(foci, points(spark).repartition(5), 10).orderBy("rank").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again


def test_rerank_and_context(spark):
    rows = [("f", i, t, f"p{i}", s) for i, (t, s) in enumerate([("Augmented: x", 9.0), ("Exact Match", 0.1), ("Exact Match", 0.5), ("Relaxed: y", 5.0)], 1)]
    res = spark.createDataFrame(rows, "focus_idx string, rank int, tier string, point_id string, s double")
    got = [r["point_id"] for r in retrieval.reranked(res, "s", 3).orderBy("rank").collect()]
    assert got == ["p3", "p2", "p4"]
    unscored = [r["point_id"] for r in retrieval.reranked(res.withColumn("s", F.lit(None).cast("double")), "s", 2).orderBy("rank").collect()]
    assert unscored == ["p1", "p2"]
    full = res.select("focus_idx", "rank", "tier", F.lit("t").alias("chunk_text"), F.lit("sec_filing").alias("source_type"), F.lit("10k").alias("filing_category"), F.lit(2020).alias("year"), F.lit(None).cast("string").alias("quarter"))
    labels = spark.createDataFrame([("f", "q1", "Ticker: AA"), ("g", "q2", "Ticker: BB")], "focus_idx string, question_id string, label string")
    texts = {r["question_id"]: r["context"] for r in retrieval.context_text(full, labels).collect()}
    assert texts["q2"] == "No relevant documents were found." and "[CHUNK 4] - Source: sec_filing (10K), Year: 2020" in texts["q1"] and texts["q1"].count("---") == 2


def test_prices(spark):
    prices = spark.createDataFrame([("A", "2020-01-31 10:00:00", 1.0), ("A", "2020-01-31 16:00:00", 2.0), ("A", "2020-03-05 09:00:00", 3.0)], "ticker string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    asks = spark.createDataFrame([(1, "A", "2020-01-30"), (2, "A", "2020-01-31"), (3, "A", "2020-03-04"), (4, "A", "2021-01-01"), (5, "B", "2020-01-31")], "ask_id int, ticker string, day string").withColumn("day", F.to_date("day"))
    got = {r["ask_id"]: r["close"] for r in market.price_as_of(asks, prices).collect()}
    assert got == {1: None, 2: 2.0, 3: 2.0, 4: 3.0, 5: None}
    exact = {r["ask_id"]: r["close"] for r in market.price_on_day(asks, prices).collect()}
    assert exact == {1: None, 2: 2.0, 3: None, 4: None, 5: None}
    lines = {r["ask_id"]: r["line"] for r in market.market_answer(market.price_on_day(asks, prices)).collect()}
    assert lines[2] == "**A** on 2020-01-31: $2.00" and lines[1] == "**A**: No price data for 2020-01-30"
