"""The pN_ queries of this subpackage, and their SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encoding, leakage, mojibake, neardup, neighbours, pairs, quality, splitting, turns


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "raw_transcript")).where("n_repaired + n_lost > 0").select(F.col("id").alias("df_index"), "text", "n_repaired", "n_lost")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_repaired(spark, d).select("df_index").distinct()


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "raw_transcript")).withColumnRenamed("id", "df_index")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_turns(spark, d).select("df_index", "turn_no", "speaker")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "qa_answer")).select(F.col("id").alias("example_id"), "defect")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "point"), k=10, min_cosine=0.85)
    return near.select(F.least("id", "neighbour").alias("point_a"), F.greatest("id", "neighbour").alias("point_b")).distinct()


def hexadecimal_multiple(c: Column, n: int) -> Column:
    """Whether a text's hexadecimal digits, read as one number, are divisible by ``n``."""
    digits = F.split(F.regexp_replace(F.lower(c), "[^0-9a-f]", ""), "")
    return F.aggregate(digits, F.lit(0), lambda a, x: (a * 16 + F.coalesce(F.conv(F.nullif(x, F.lit("")), 16, 10).cast("int"), F.lit(0))) % n) == 0


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar other points, whatever their cosine, of every point whose id, a hexadecimal number, is divisible by 20."""
    return neighbours.nearest(table(spark, d, "point"), k=10, asking=hexadecimal_multiple(F.col("id"), 20))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.filing_items(table(spark, d, "sectioned_filing")).unionByName(splitting.chunk_items(table(spark, d, "chunk")))
    return splitting.split_items(items)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that the splitting operator had to cut."""
    return p6_pieces(spark, d).where("piece_no = 0 and n_pieces > 1").select("item_table", "item_key", "pos", "cut_kind")


def p6_within(spark: SparkSession, d: str) -> DataFrame:
    """Each item that was cut: whether all its pieces are within the limit."""
    size = F.create_map(*(F.lit(x) for kind, (limit, _) in splitting.LIMITS.items() for x in (kind, limit)))
    longest = p6_pieces(spark, d).groupBy("item_table", "item_key", "pos", "kind").agg(F.max(F.length("piece")).alias("n"))
    return longest.select("item_table", "item_key", "pos", (F.col("n") <= F.element_at(size, F.col("kind"))).alias("within"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    linked, members = neardup.near_duplicates(table(spark, d, "chunk"), "global_chunk_id", n=3, similarity=0.6, min_words=50)
    return neardup.expanded_pairs(linked, members).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its class of equal texts, its group of chunks alike, and its number of links, at the thresholds of p7_found."""
    linked, members = neardup.near_duplicates(table(spark, d, "chunk"), "global_chunk_id", n=3, similarity=0.6, min_words=50)
    return neardup.groups(linked, members).withColumnRenamed("id", "global_chunk_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text from its ids alone."""
    return encoding.decode_corpus(p8_ids(spark, d))


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 13 words of an item, up to two word edits apart."""
    return leakage.leaked_windows(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Of what the edit-tolerant search finds, the passages without an edit."""
    return p9_edited(spark, d).where("edits = 0").select("doc_id", "item_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.assessed(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("outlier").select("doc_id", "kind")


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_turns": p2_turns, "p3_found": p3_found, "p5_found": p5_found, "p5_nearest": p5_nearest, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_within": p6_within, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_edited": p9_edited, "p10_found": p10_found, "p10_statistics": p10_statistics}

_TRIMMED = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_LONGEST = r"list_max(list_transform(regexp_split_to_array(t, '[ \t\r\n]+'), lambda x: length(x)))"


def _windows(source: str, key: str) -> str:
    words = f"(SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {source} WHERE text IS NOT NULL)"
    return f"(SELECT DISTINCT {key}, g FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM {words} WHERE len(w) >= 13))"


SQL: dict[str, str] = {
    "p6_found": (
        f"SELECT item_table, item_key, CAST(pos AS INTEGER) AS pos, CASE WHEN {_LONGEST} > size THEN 'hard' ELSE 'natural' END AS cut_kind FROM ("
        f"SELECT 'sectioned_filing' AS item_table, CAST(filing_no AS VARCHAR) AS item_key, pos, {_TRIMMED.format('s.text')} AS t, 1000 AS size FROM (SELECT filing_no, unnest(sections) AS s, generate_subscripts(sections, 1) - 1 AS pos FROM sectioned_filing) "
        f"UNION ALL SELECT DISTINCT 'chunk', global_chunk_id, 0, {_TRIMMED.format('text')}, CASE source_type WHEN 'sec_filing' THEN 1000 ELSE 800 END FROM chunk WHERE source_type IN ('sec_filing', 'earnings_transcript')) WHERE length(t) > size"
    ),
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM {_windows('documents', 'doc_id')} JOIN {_windows('eval_item', 'item_id')} USING (g)",
}
SQL["p6_within"] = f"SELECT item_table, item_key, pos, TRUE AS within FROM ({SQL['p6_found']})"
