"""The online path for many questions in one plan: parse, search, rerank, enrich with prices, assemble the context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import asks_price, date_in_query
from ..session import staged
from . import market, questions, retrieval
from .providers import ContextAnswer, HashingEmbedder, LexicalScorer, RuleIntent


def answered(asked: DataFrame, chunks: DataFrame, gazetteer: DataFrame, prices: DataFrame, today: str, intent=None, embedder=None, scorer=None, generator=None, refiner=None, k: int = retrieval.TOP_K) -> DataFrame:
    """(question_id, intent, context, answer) for asked (question_id, query).

    Market questions get price lines, document questions the reranked chunks, hybrid ones also the price at the end of the focus's
    year (or ``today``) ahead of the chunks if they ask for one. ``chunks`` are those of ``retrieval.point_chunks``.
    """
    intent, embedder, scorer, generator = intent or RuleIntent(), embedder or HashingEmbedder(), scorer or LexicalScorer(), generator or ContextAnswer()
    routed = asked.withColumn("intent", intent.intent(F.col("query")))
    parsed = questions.parsed_questions(routed, gazetteer)
    if refiner is not None:
        read = parsed.join(routed.select("question_id", "query"), "question_id")
        parsed = read.select("question_id", "modified_query", refiner.refine(F.col("query"), F.col("focuses")).alias("focuses"))
    # read by the search, the reranker, the prices and the labels, so computed once
    focuses = staged(questions.focus_rows(parsed).join(routed.select("question_id", "query", "intent"), "question_id").withColumn("query_vector", embedder.embed(F.col("modified_query"))), "asked")
    searching = focuses.where("intent <> 'MARKET_DATA_ONLY'").select("focus_idx", "query", "ticker", "year", "quarter", "doc_type", "query_vector")
    if hasattr(scorer, "features"):
        top = retrieval.retrieve(searching, chunks, k, scorer.features)
    else:
        searched = retrieval.retrieve(searching, chunks, k)
        scored = searched.join(focuses.select("focus_idx", "query"), "focus_idx").withColumn("rerank_score", scorer.score(F.col("query"), F.col("chunk_text"))).drop("query")
        top = retrieval.reranked(scored, "rerank_score")
    wants = focuses.where(asks_price(F.col("query")) & (F.col("intent") == "HYBRID")).select(F.col("focus_idx").alias("ask_id"), "ticker", market.as_of_day(F.col("year"), F.to_date(F.lit(today))).alias("day"))
    extra = market.price_chunks(market.price_as_of(wants, prices)).withColumnRenamed("ask_id", "focus_idx").select("focus_idx", "ticker", "tier", "chunk_text", "source_type")
    labels = focuses.select("focus_idx", "question_id", retrieval.focus_label(F.col("ticker"), F.col("year").cast("string"), F.col("quarter").cast("string"), F.col("doc_type")).alias("label"))
    contexts = retrieval.context_text(retrieval.prepended(top, extra), labels)
    days = focuses.where("intent = 'MARKET_DATA_ONLY'").select("question_id", F.col("focus_idx").alias("ask_id"), "ticker", F.coalesce(F.try_to_date(F.nullif(date_in_query(F.col("query")), F.lit(""))), F.to_date(F.lit(today))).alias("day"))
    lines = market.market_answer(market.price_on_day(days.drop("question_id"), prices)).join(days.select("ask_id", "question_id"), "ask_id")
    market_text = lines.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ask_id", "line"))), lambda x: x["line"]), "\n").alias("market"))
    out = routed.join(contexts, "question_id", "left").join(market_text, "question_id", "left")
    context = F.when(F.col("intent") == "MARKET_DATA_ONLY", F.coalesce("market", F.lit("I couldn't identify any stock tickers in your query. Please specify a company or ticker symbol."))).otherwise(
        F.coalesce("context", F.lit("No relevant documents were found."))
    )
    return out.select("question_id", "intent", context.alias("context"), generator.answer(F.col("query"), context).alias("answer"))

