from ledgerloom.operators import datasets


def test_groups_hold_the_records(spark):
    df = spark.createDataFrame([("f", i, f"text {i}") for i in range(1, 13)], "file string, n int, text string")
    for groups in (datasets.tiled_groups(df, "file", "n"), datasets.random_groups(df, "file", "n")):
        rows = groups.collect()
        assert rows and all([x["text"] for x in r["items"]] == [f"text {x['n']}" for x in r["items"]] and len(r["items"]) == 5 for r in rows)
        assert all(r["items"][i + 1]["n"] == r["items"][i]["n"] + 1 for r in rows for i in range(4))
    prompts = datasets.tiled_groups(df, "file", "n").select(datasets.synthesis_prompt(datasets.F.col("items")).alias("p")).collect()
    assert any("text 1" in r["p"] for r in prompts)
