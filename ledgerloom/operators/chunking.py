"""Recursive character chunking and the chunk table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small_side, staged


@dataclass(frozen=True)
class Chunker:
    """Sizes in code points; separators from strong to weak, the last meaning single characters."""

    size: int = 1000
    overlap: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n", " ", "")

    def split(self, text: str | None) -> list[str]:
        return self._cut(text, self.separators) if text else []

    def _cut(self, text: str, separators: tuple[str, ...]) -> list[str]:
        k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
        sep, weaker = separators[k], separators[k + 1 :]
        if sep:
            head, *tail = text.split(sep)
            parts = [head, *(sep + t for t in tail)]
        else:
            parts = list(text)
        out: list[str] = []
        small: list[str] = []
        for part in filter(None, parts):
            if len(part) < self.size:
                small.append(part)
                continue
            out += self._merged(small)
            small = []
            out += self._cut(part, weaker) if weaker else [part]
        return out + self._merged(small)

    def _merged(self, parts: list[str]) -> list[str]:
        out: list[str] = []
        window: list[str] = []
        start = total = 0
        for part in parts:
            if total + len(part) > self.size and len(window) > start:
                out.append("".join(window[start:]).strip())
                while total > self.overlap or (total + len(part) > self.size and total > 0):
                    total -= len(window[start])
                    start += 1
            window.append(part)
            total += len(part)
        out.append("".join(window[start:]).strip())
        return [c for c in out if c]


#: The two chunkers in use.
FILING_CHUNKER = Chunker(1000, 150)
EARNINGS_CHUNKER = Chunker(800, 100)


def chunked(df: DataFrame, text_col: str, chunker: Chunker = FILING_CHUNKER) -> DataFrame:
    """The columns of ``df`` with chunk_seq from 0 and chunk_text, one row per chunk; null and blank texts give none.

    The greedy merge is a sequential fold, so it runs in an Arrow-batched function over the text column alone.
    """

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(chunker.split)

    return df.select("*", F.posexplode(F.pandas_udf(cut, "array<string>")(text_col)).alias("chunk_seq", "chunk_text"))


def filing_chunks(filings: DataFrame, chunker: Chunker = FILING_CHUNKER) -> DataFrame:
    """Chunk rows of sectioned filings with the document's and the section's metadata; nulls stay null."""
    sections = filings.select("filing_no", "metadata", F.posexplode("sections").alias("section_pos", "s")).where("s.text <> ''").select(
        "filing_no", "section_pos", "metadata.*", F.col("s.item").alias("item"), F.col("s.section").alias("section_name"), F.col("s.text").alias("text")
    )
    rows = chunked(sections, "text", chunker).drop("text").withColumnRenamed("chunk_text", "text")
    category = F.lower(F.regexp_replace("filing_type", "-", ""))
    return rows.select(
        "text", F.lit("sec_filing").alias("source_type"), category.alias("filing_category"), "ticker", "year", "cik", "date", "filing_type", "item", "section_name", "chunk_seq",
        F.concat_ws("_", F.lit("sec"), "filing_no", "section_pos", "chunk_seq").alias("global_chunk_id"),
    )


def turn_chunks(turns: DataFrame, chunker: Chunker = EARNINGS_CHUNKER) -> DataFrame:
    """Chunk rows of speaker turns (turn_id, ticker, year, quarter, speaker_full, speaker_simple_name, section, text)."""
    rows = chunked(turns, "text", chunker).drop("text").withColumnRenamed("chunk_text", "text")
    return rows.select(
        "text", F.lit("earnings_transcript").alias("source_type"), "ticker", "year", "quarter", "turn_id", F.col("speaker_full").alias("turn_speaker_full"),
        F.col("speaker_simple_name").alias("turn_speaker_simple"), F.col("section").alias("turn_section"), "chunk_seq", F.concat_ws("_", F.lit("earn"), "turn_id", "chunk_seq").alias("global_chunk_id"),
    )


def all_chunks(*tables: DataFrame) -> DataFrame:
    """One chunk table; columns that a source lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_sentinels(chunks: DataFrame) -> DataFrame:
    """The output view in which missing metadata is spelled out."""
    names = {"ticker": "UNKNOWN_TICKER", "cik": "UNKNOWN_CIK", "date": "UNKNOWN_DATE", "item": "UNKNOWN_ITEM", "section_name": "UNKNOWN_SECTION"}
    return chunks.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in names.items() if c in chunks.columns}).withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("UNKNOWN_YEAR")))


def for_tickers(chunks: DataFrame, universe: DataFrame) -> DataFrame:
    """Chunks of the tickers in ``universe``: a semi-join, broadcast by Spark when its statistics allow."""
    return chunks.join(universe.select("ticker").distinct(), "ticker", "left_semi")


def row_numbers(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``df`` with ``row_no`` from 1 in a given order, over all rows or ``within`` each value of some columns.

    Rows are range-partitioned and written with their partition's number, so that bounds are drawn once; each partition numbers its own
    rows, and the counts of the partitions before it are added. No task sorts a whole group, however large. Empty tables give no
    row; rows equal in ``order`` are numbered in any order among themselves.
    """
    within = within or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *within, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    own = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_p", *within).orderBy(*order)))
    sums = ranged.groupBy("_p", *within).count()
    over = W.partitionBy(*within).orderBy("_p") if within else W.orderBy("_p")
    before = sums.withColumn("_o", F.sum("count").over(over) - F.col("count")).drop("count")
    keys = {c: f"_k{i}" for i, c in enumerate(["_p", *within])}
    before = small_side(before.withColumnsRenamed(keys))
    same = reduce(and_, (own[c].eqNullSafe(before[k]) for c, k in keys.items()))
    return own.join(before, same).withColumn("row_no", F.col("_o") + F.col("_n")).drop("_p", "_n", "_o", *keys.values())


def batch_numbers(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Fixed-size batches in a given order, numbered from 0."""
    return row_numbers(df, order).withColumn("batch", F.floor((F.col("row_no") - 1) / size))
