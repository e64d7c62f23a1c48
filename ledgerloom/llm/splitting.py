"""Cutting oversized texts at natural boundaries, with regular expressions and array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters per piece and overlap of consecutive pieces, by kind of text.
LIMITS = {"sec_filing": (1000, 150), "earnings_transcript": (800, 100)}

BLANKS = " \t\r\n"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def piece_pattern(size: int) -> str:
    """One piece: the strongest boundary within ``size`` characters ends it, a plain character count if there is none.

    Alternatives in order: blank line, sentence end, clause end, line end, blank, character. A boundary counts only in
    the second half of the room, except a blank, so that pieces don't become tiny; the rest of the text is one piece.
    """
    half = size // 2
    # every alternative has a bound of its own, so that no piece exceeds the size; a boundary is what stands before its end
    strong = [rf"(?<=\n)(?<=\n[ \t\r]{{0,{size}}}\n)", r"(?<=[.!?…][\"”’')\]]?[ \t\r\n])", r"(?<=[;:][ \t\r\n])", r"(?<=\n)"]
    alternatives = [rf".{{1,{size}}}\z", *(rf".{{{max(half, 1)},{size}}}{b}" for b in strong), rf".{{1,{size - 1}}}[ \t\r\n]", rf".{{1,{size}}}"]
    return "(?s)" + "|".join(f"(?:{a})" for a in alternatives)


#: Numbers that one fold adds up: the array it makes is copied at each step, so folds stay short.
FOLD = 256


def running_starts(lengths: Column) -> Column:
    """Where each of consecutive pieces begins, from their lengths: sums within blocks, then the blocks' offsets."""

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / FOLD)), lambda b: sums(F.slice(lengths, (b * FOLD + 1).cast("int"), F.lit(FOLD))))
    held = F.array(F.struct(blocks.alias("b"), sums(F.transform(blocks, lambda x: F.element_at(x, -1))).alias("o")))
    return F.get(F.transform(held, lambda h: F.flatten(F.zip_with(h["b"], F.slice(h["o"], 1, F.size(h["b"])), lambda x, o: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + o)))), 0)


def cut_kind(text: Column, size: int) -> Column:
    """``hard`` if a run without blanks is longer than ``size``, ``natural`` for other texts over the limit, else null."""
    t = trimmed(text)
    long_run = t.rlike(rf"[^ \t\r\n]{{{size + 1}}}")
    return F.when(F.length(t) > size, F.when(long_run, F.lit("hard")).otherwise(F.lit("natural")))


def filing_items(filings: DataFrame) -> DataFrame:
    """(item_table, item_key, pos, kind, text) of each section text; ``pos`` counts sections from 0."""
    return filings.select(F.col("filing_no").cast("string").alias("item_key"), F.posexplode("sections").alias("pos", "s")).select(
        F.lit("sectioned_filing").alias("item_table"), "item_key", "pos", F.lit("sec_filing").alias("kind"), F.col("s.text").alias("text")
    )


def chunk_items(chunks: DataFrame) -> DataFrame:
    """The same of chunks, each id once; chunks of a kind without a limit give no row."""
    rows = chunks.where(F.col("source_type").isin(*LIMITS)).select(
        F.lit("chunk").alias("item_table"), F.col("global_chunk_id").alias("item_key"), F.lit(0).alias("pos"), F.col("source_type").alias("kind"), "text"
    )
    # only texts over the smallest limit can be cut; delivered twice they are equal, so any one row of an id serves
    long = rows.where(F.length("text") > min(size for size, _ in LIMITS.values()))
    return long.where("item_key is not null").dropDuplicates(["item_key"]).unionByName(long.where("item_key is null"))


def split_texts(items: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """The other columns of ``items`` with piece_no from 0, n_pieces, start and piece: the trimmed text cut in order.

    Pieces have at most ``size`` characters (code points). The regex consumes ``size - overlap`` at most; each piece after
    the first then reaches back by at most ``overlap`` characters into the text before it, to the first place after a blank
    in that stretch, or over the whole stretch if it has no blank. ``start`` is the offset in the trimmed text. A text
    within the limit is one piece; null and blank texts give no row; repeated rows are cut each.
    """
    kept = [c for c in items.columns if c != text]
    rows = items.select(*kept, trimmed(F.col(text)).alias("_t"))
    whole = F.when(F.length("_t") <= size, F.array("_t")).otherwise(F.regexp_extract_all("_t", F.lit(piece_pattern(size - overlap)), F.lit(0)))
    rows = rows.where("_t <> ''").select(*kept, whole.alias("_c"))
    none = F.array(F.lit(""))
    zipped = F.arrays_zip(F.col("_c").alias("core"), running_starts(F.transform("_c", lambda c: F.length(c))).alias("begin"), F.concat(none, "_c").alias("last"), F.concat(none, none, "_c").alias("before"))
    # zipping pads the shorter arrays; the entries past the last core carry no core
    rows = rows.select(*kept, F.size("_c").alias("n_pieces"), F.posexplode(zipped).alias("piece_no", "_z")).where("_z.core is not null")
    back = F.right(F.concat("_z.before", "_z.last"), F.lit(overlap))
    skip = F.when(F.length("_b") == F.col("_z.begin"), F.lit(0)).otherwise(F.length(F.regexp_extract("_b", r"\A[^ \t\r\n]*[ \t\r\n]+(?=[^ \t\r\n])", 0)))
    lap = F.col("_b").substr(skip + 1, F.lit(overlap))
    rows = rows.withColumn("_b", back).withColumn("_l", lap)
    return rows.select(*kept, "n_pieces", "piece_no", (F.col("_z.begin") - F.length("_l")).alias("start"), F.concat("_l", "_z.core").alias("piece"))


def split_items(items: DataFrame) -> DataFrame:
    """One row per piece of each oversized item: the item's columns, cut_kind, n_pieces, piece_no, start, piece.

    Items within their limit, null and blank texts give no row: they need no cut. Repeated items are cut each.
    """
    out = None
    for kind, (size, overlap) in LIMITS.items():
        own = items.where((F.col("kind") == kind) & (F.length("text") > size)).withColumn("cut_kind", cut_kind(F.col("text"), size))
        own = split_texts(own.where("cut_kind is not null").select("item_table", "item_key", "pos", "kind", "cut_kind", "text"), size, overlap)
        out = own if out is None else out.unionByName(own)
    return out
