"""Filtered vector search for many questions at once: levels of relaxation, augmentation, reranking, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import small_side, staged
from .search import TIERS, best_chunks

TOP_K = 70
FINAL_K = 7


def unit_vector(v: Column) -> Column:
    """``v`` scaled to length 1; null for a null or all-zero vector."""
    # vector and length are held, else each coordinate would compute both again
    length = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    held = F.transform(F.transform(F.array(v), lambda u: F.struct(u.alias("v"), length(u).alias("n"))), lambda h: F.when(h["n"] > 0, F.transform(h["v"], lambda x: x.cast("double") / h["n"])))
    return F.get(held, 0)


def canonical_doc_type(name: Column) -> Column:
    """Spelling variants of a document type as one: 10-K, 10-Q, Earnings Transcript; others unchanged."""
    flat = F.regexp_replace(F.upper(name), r"[\s_]+", " ")
    return F.when(flat == "EARNINGS TRANSCRIPT", "Earnings Transcript").when(flat.isin("10-K", "10K"), "10-K").when(flat.isin("10-Q", "10Q"), "10-Q").otherwise(name)


def focus_matches(focus: dict[str, Column], chunk: dict[str, Column]) -> Column:
    """The conjunctive filter of one focus; absent years, quarters and unknown types don't restrict, and a 10-Q's quarter is left to the post-filter."""
    year = focus["year"].isNull() | (focus["year"] == 0) | (chunk["year"] == focus["year"])
    filing = chunk["source_type"] == "sec_filing"
    kind = (
        F.when(focus["doc_type"] == "10-K", filing & (chunk["filing_category"] == "10k"))
        .when(focus["doc_type"] == "Earnings Transcript", (chunk["source_type"] == "earnings_transcript") & (focus["quarter"].isNull() | (chunk["quarter"] == F.concat(F.lit("Q"), focus["quarter"]))))
        .when(focus["doc_type"] == "10-Q", filing & (chunk["filing_category"] == "10q"))
        .otherwise(True)
    )
    return F.coalesce(year & kind, F.lit(False))


def retrieve(focuses: DataFrame, chunks: DataFrame, k: int = TOP_K, features=None, final: int = FINAL_K) -> DataFrame:
    """(focus_idx, rank, tier, point_id, score, chunk_text, ...): base level with results first, filled up to ``k`` by augmentation.

    Of the relaxation levels (exact, then without quarter, year, type) the first with a result is the base; a quarterly report with a wanted
    quarter must be dated in it, which is looked at after the limit. Augmentation starts from the base, fetches twice ``k`` a level, and adds points not
    held yet, earlier levels first. Focuses without any result give no row; null filter fields don't restrict. With ``features`` (text to an
    array of distinct numbers) each focus also has a ``query``, its ``k`` chunks are reranked where they are found, by tier, the share of the query's
    features that the text has and the former rank, and only the ``final`` best come out, with ``rerank_score``. Texts are joined to the final rows only.
    """
    none = F.array().cast("array<bigint>")
    held = lambda text: F.coalesce(features(F.col(text)), none) if features else none
    asked = focuses.withColumn("doc_type", canonical_doc_type(F.col("doc_type"))).withColumn("words", held("query"))
    found = best_chunks(asked, chunks.withColumn("words", held("chunk_text")), k, final if features else None)
    top = staged(found, "top")
    tier = F.create_map(*(F.lit(x) for level in TIERS.items() for x in level))
    shown = chunks.select("point_id", "ticker", "chunk_text", "source_type", "filing_category", "year", "quarter")
    columns = ["focus_idx", "ticker", "rank", F.try_element_at(tier, F.col("level")).alias("tier"), "level", "point_id", "score", "chunk_text", "source_type", "filing_category", "year", "quarter"]
    return top.join(shown, "point_id").select(*columns, *(["rerank_score"] if features else []))


#: Query vectors that are held by each worker at once.
ASKING = 8192
#: Decimal places at which scores count as equal, ties breaking by id.
SCORE_PLACES = 9


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, dim: int, group: str | None = None) -> DataFrame:
    """(query_id, [group,] id, score, rank): for every query (query_id, q) its ``k`` most similar vectors (id, v), or so many of each group.

    Queries go to the workers in blocks of ASKING; every batch of vectors is scored as one matrix product and only its own best leave
    the task, to be ranked once more. Ranks go by the inner product at nine decimals, then by id. Null vectors and those of another
    length take no part; ids must be unique; empty tables give no row.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // ASKING))
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    keys = ["query_id", *([group] if group else [])]
    schema = f"query_id {kinds['query_id']}, " + (f"{group} {kinds[group]}, " if group else "") + f"id {kinds['id']}, score double"
    good = F.coalesce((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    stored = vectors.where(good).select(*([group] if group else []), "id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    fit = F.coalesce((F.size("q") == dim) & ~F.exists("q", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    asked = queries.where(fit).select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((own.column("query_id").to_pylist(), np.array(own.column("q").to_pylist(), dtype=np.float64).reshape(-1, dim)))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            for b in batches:
                if not len(b) or not len(q):
                    continue
                scores = np.round(q @ np.stack(b["v"].to_numpy()).T, SCORE_PLACES)
                groups = b.groupby(group, dropna=False).indices.values() if group else [np.arange(len(b))]
                for members in groups:
                    part, ids = scores[:, members], b["id"].to_numpy()[members]
                    # ids sorted first, so that a stable sort leaves ties in their order
                    order = np.argsort(ids, kind="stable")
                    top = np.argsort(-part[:, order], axis=1, kind="stable")[:, :k]
                    at = members[order[top]]
                    rows = {"query_id": np.repeat(np.array(names, dtype=object), top.shape[1]), "id": b["id"].to_numpy()[at.ravel()], "score": np.take_along_axis(scores, at, axis=1).ravel()}
                    if group:
                        rows[group] = b[group].to_numpy()[at.ravel()]
                    yield pd.DataFrame(rows)[[*keys, "id", "score"]]

        part = stored.mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def tier_priority(tier: Column) -> Column:
    return F.when(tier == "Exact Match", 0).when(tier.startswith("Relaxed:"), 1).when(tier.startswith("Augmented:"), 2).otherwise(99)


def reranked(results: DataFrame, score_col: str, k: int = FINAL_K) -> DataFrame:
    """The ``k`` best of each focus by tier, then by the reranker's score, then by the former rank; ``rank`` is the new one.

    Where a focus has no score at all the former order stands.
    """
    order = W.partitionBy("focus_idx").orderBy(F.when(F.col("_any"), tier_priority(F.col("tier"))).otherwise(0), F.desc_nulls_last(F.col(score_col)), "rank")
    flagged = results.withColumn("_any", F.max(F.col(score_col).isNotNull()).over(W.partitionBy("focus_idx")))
    return flagged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).withColumn("rank", F.col("_n")).drop("_any", "_n")


def lexical_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)))


def lexical_score(query: Column, text: Column) -> Column:
    """The share of the question's distinct words that the text holds: the default scorer where no model is plugged in."""
    a, b = lexical_words(query), lexical_words(text)
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def focus_label(ticker: Column, year: Column, quarter: Column, doc_type: Column) -> Column:
    return F.concat_ws(", ", F.concat(F.lit("Ticker: "), ticker), F.concat(F.lit("Year: "), year), F.concat(F.lit("Quarter: Q"), quarter), F.concat(F.lit("DocType: "), doc_type))


def context_text(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(question_id, context): numbered chunks with source and tier under a banner per focus, for one prompt each.

    Chunks are numbered through all focuses of a question in order; focuses without results are skipped; a question whose
    focuses are all empty gets the message that nothing was found.
    """
    source = F.concat(
        F.coalesce("source_type", F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.upper("filing_category"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(", Year: "), F.col("year")), F.lit("")), F.coalesce(F.concat(F.lit(", Quarter: "), F.col("quarter")), F.lit("")),
    )
    joined = results.join(small_side(labels.select("focus_idx", "question_id", "label")), "focus_idx")
    ordered = W.partitionBy("question_id").orderBy("focus_idx", "rank")
    n = joined.withColumn("n", F.row_number().over(ordered)).withColumn("first", F.row_number().over(W.partitionBy("question_id", "focus_idx").orderBy("rank")) == 1)
    entry = F.concat(
        F.when(F.col("first"), F.concat(F.lit("--- Documents related to: "), F.col("label"), F.lit(" ---\n"))).otherwise(""),
        F.lit("[CHUNK "), F.col("n").cast("string"), F.lit("] - Source: "), source, F.lit("\nRetrieval Method: "), F.col("tier"), F.lit('\nContent: """\n'), F.coalesce("chunk_text", F.lit("")), F.lit('\n"""\n\n'),
    )
    texts = n.select("question_id", "n", entry.alias("e")).groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]), "").alias("body"))
    head = "CONTEXT:\nThe following document chunks were retrieved as relevant to the user's query:\n\n"
    full = F.regexp_replace(F.concat(F.lit(head), F.col("body")), r"\s+\z", "")
    return labels.select("question_id").distinct().join(texts, "question_id", "left").select("question_id", F.when(F.col("body").isNull(), "No relevant documents were found.").otherwise(full).alias("context"))


def unseen(candidates: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(held.select(*keys).distinct(), keys, "left_anti")


def prepended(results: DataFrame, first: DataFrame) -> DataFrame:
    """Extra rows (a price chunk) before a focus's own results, at rank 0."""
    return first.withColumn("rank", F.lit(0)).unionByName(results, allowMissingColumns=True)


def point_chunks(points: DataFrame, chunks: DataFrame, dim: int = 64) -> DataFrame:
    """The chunk side of a search from points with a payload: id, ticker, metadata, unit vector; vectors not of ``dim`` fit numbers are left out.

    A payload has no date; the quarter that a quarterly report is dated in comes from its row in ``chunks``, and is null where that has
    no date that can be read. Chunks delivered twice count once.
    """
    p = "payload"
    kind = F.lower(F.regexp_replace(F.col(f"{p}.filing_type"), "-", ""))
    good = F.coalesce((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    dated = chunks.where("source_type = 'sec_filing' and global_chunk_id is not null").groupBy("global_chunk_id").agg(F.min("date").alias("date"))
    dated = dated.select(F.col("global_chunk_id").alias("_g"), X.calendar_quarter(F.col("date")).alias("date_quarter"))
    rows = points.where(good).select(
        F.col("id").alias("point_id"), F.col(f"{p}.ticker").alias("ticker"), F.col(f"{p}.year").cast("int").alias("year"), F.col(f"{p}.quarter").alias("quarter"), F.col(f"{p}.source_type").alias("source_type"),
        kind.alias("filing_category"), unit_vector(F.col("vector")).alias("vector"), F.col(f"{p}.chunk_text").alias("chunk_text"), F.col(f"{p}.global_chunk_id").alias("_g"),
    ).where("vector is not null")
    return rows.join(dated, "_g", "left").drop("_g")
