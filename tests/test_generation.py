import json

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import datasets, questions
from ledgerloom.operators.providers import FixedCompleter, ModelRefiner, RuleRefiner


def test_examples_of_groups(spark):
    files = spark.createDataFrame([("a", [["x1", "x2"], ["y"]]), ("b", []), ("c", None)], "file string, groups array<array<string>>")
    groups = datasets.flattened_groups(files)
    assert sorted((r["file"], r["group_no"]) for r in groups.collect()) == [("a", 0), ("a", 1)]
    said = 'Here [{"user_query": "q"}, {"user_query": "r"}, 3, null] bye'
    rows = datasets.generated_examples(groups, FixedCompleter(said)).collect()
    assert sorted((r["group_no"], r["example_no"], json.loads(r["example"])["user_query"]) for r in rows) == [(0, 0, "q"), (0, 1, "r"), (1, 0, "q"), (1, 1, "r")]
    assert {r["group_no"]: json.loads(r["context"]) for r in rows} == {0: ["x1", "x2"], 1: ["y"]}
    assert datasets.generated_examples(groups, FixedCompleter(said), limit=1).count() == 2
    for broken in ("no list", "[{broken]", "", "[]"):
        assert datasets.generated_examples(groups, FixedCompleter(broken)).count() == 0
    assert '["x1","x2"]' in groups.where("group_no = 0").select(datasets.synthesis_prompt(F.col("items")).alias("p")).first()["p"]


def test_refiners(spark):
    found = F.from_json(F.lit('[{"ticker": "OLD", "year": 2019}]'), "array<struct<ticker:string,year:int,quarter:int,doc_type:string>>")
    df = spark.createDataFrame([("q",), (None,)], "query string")

    def tickers(refiner):
        return [f["ticker"] for r in df.select(refiner.refine(F.col("query"), found).alias("f")).collect() for f in r["f"]]

    assert tickers(RuleRefiner()) == ["OLD", "OLD"]
    assert tickers(ModelRefiner(FixedCompleter('{"metadata": {"focuses": [{"ticker": "NEW"}, {"year": 1}]}}'))) == ["NEW", "NEW"]
    assert tickers(ModelRefiner(FixedCompleter("can't say"))) == ["OLD", "OLD"]
    assert questions.focus_hint(found) is not None


def test_character_references(spark):
    page = "<p>A &amp; B &eacute; &#8217; &#x20AC; &nbsp;&bogus;</p><script>x &lt; y</script>"
    got = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(X.html_text(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in got] == ["A & B é ’ €  &bogus;", None, ""]
