"""Text functions as Column expressions: all JVM-side, null in, null out."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Lines that are page furniture in filings.
HEADER_LINES = (
    r"(?i)^\s*TABLE OF CONTENTS\s*$|^\s*INDEX TO FINANCIAL STATEMENTS\s*$|^\s*F-\d+\s*$|^\s*\d+\s*$|^\s*(10-K|10-Q)\b.*$|"
    r"^\s*Item\s+\d+[A-Z]?\.?.*\s+\d+\s*$|^\s*THE ORIGINAL BARK COMPANY.*$"
)
APPLE_HEADER_LINES = (
    r"(?i)^\s*TABLE OF CONTENTS\s*$|^\s*INDEX TO FINANCIAL STATEMENTS\s*$|^\s*F-\d+\s*$|^\s*\d+\s*$|"
    r"^\s*Apple Inc\.\s*\|\s*(Q\d\s+\d{4}|FY\d{4})?\s*Form (10-K|10-Q)\s*\|\s*\d+\s*$"
)
# What transcription services put between the spoken words.
SPEECH_NOISE = [
    r"\[Operator Instructions\]", r"\[Technical Issues\]", r"\[Phonetic\]", r"\[Indecipherable\]", r"\[Speech Overlap\]", r"\[Foreign Speech\]",
    r"Sir, please go ahead\.", r"Please go ahead\.", r"Today's conference is being recorded\.", r"\(Operator Instructions\)",
]
# Words of a question that ask for a price, and the shorter list of the market-only path.
PRICE_WORDS = ["price", "current value", "stock value", "share value", "valuation", "pe ratio", "p/e", "dividend yield", "market cap", "eps multiple"]
MARKET_WORDS = ["price", "stock price", "closing", "current"]
INTENTS = ["HYBRID", "DOCUMENT_SEARCH", "MARKET_DATA_ONLY"]
DATE_FORMATS = ["yyyy-MM-dd", "yyyyMMdd", "M/d/yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d", "d/M/yyyy", "d MMMM yyyy"]


def held(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often the use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def without_lines(text: Column, pattern: str = HEADER_LINES) -> Column:
    """The lines of ``text`` that the pattern doesn't match, joined by line feeds."""
    return F.array_join(F.filter(F.split(text, r"\R"), lambda line: ~line.rlike(pattern)), "\n")


def normalized_quotes(text: Column) -> Column:
    """The replacement character and the right single quote become an apostrophe."""
    return F.translate(text, "�’", "''")


def plain_punctuation(text: Column) -> Column:
    """Typographic signs become ASCII: quotes, dashes, bullets, no-break spaces."""
    one = F.translate(text, "“”‘’– �", "\"\"''- '")
    return F.replace(F.replace(one, F.lit("•"), F.lit("* ")), F.lit("—"), F.lit("--"))


def split_joined_words(text: Column) -> Column:
    """A space where a lower-case letter meets a capitalised word."""
    return F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z][a-z])", " ")


def single_spaced(text: Column) -> Column:
    """Line breaks and tabs become spaces, runs of white space one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\n\r\t]+", " "), r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


def spaced_speech(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def without_noise(text: Column) -> Column:
    """Speech without the transcription service's insertions, each removed in turn, whatever its case."""
    out = spaced_speech(text)
    for pattern in SPEECH_NOISE:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def sentences(text: Column, capital_follows: bool = True) -> Column:
    """Sentences by a stop and white space; in filings a capital or parenthesis must follow."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z(])" if capital_follows else r"(?<=[.!?])\s+")


def sentence_key(sentence: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(sentence, r"\s+", " ")))


def first_by_key(items: Column, min_words: int = 0) -> Column:
    """Items with the first of each sentence key kept, in order; blank ones and those of fewer words than ``min_words`` are dropped.

    Sorted by key and position, an item is the first of its key if the one before has another key: each is compared with its neighbour
    only, so the work grows with the number of items and no faster than their sorting.
    """
    rows = F.transform(items, lambda s, i: F.struct(sentence_key(s).alias("k"), i.alias("i"), s.alias("s")))
    rows = F.array_sort(F.filter(rows, lambda r: (r["k"] != "") & (F.size(F.split(r["k"], " ")) >= min_words)))
    # held once, so that the neighbours don't sort again
    firsts = F.get(F.transform(F.array(rows), lambda all_: F.filter(all_, lambda r, i: (i == 0) | (r["k"] != F.get(all_, i - 1)["k"]))), 0)
    return F.transform(F.array_sort(F.transform(firsts, lambda r: F.struct(r["i"].alias("i"), r["s"].alias("s")))), lambda r: r["s"])


def kept_first(items: Column, min_words: int = 0) -> Column:
    """Distinct sentences, the first of each in order, joined by a space."""
    return F.array_join(F.transform(first_by_key(items, min_words), lambda s: F.trim(s)), " ")


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return held(trimmed, lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+"))))


def parsed_date(text: Column) -> Column:
    """A date from any of the known formats, month before day where both fit; null if none fits."""
    head = F.regexp_extract(text, r"^\s*((?:\d{4}-\d{1,2}-\d{1,2})|(?:\d{8})|(?:\d{1,2}/\d{1,2}/\d{4})|(?:\d{4}/\d{1,2}/\d{1,2})|(?:\d{1,2} [A-Za-z]+ \d{4})|(?:[A-Za-z]+\.? \d{1,2}, \d{4}))", 1)
    clean = F.regexp_replace(head, r"\.", "")
    return F.coalesce(*(F.try_to_timestamp(F.nullif(clean, F.lit("")), F.lit(f)).cast("date") for f in DATE_FORMATS))


def cik_of(url: Column) -> Column:
    """The number in ``/data/<n>/``, padded to ten digits and never cut; null without one."""
    digits = F.nullif(F.regexp_extract(url, r"/data/(\d+)/", 1), F.lit(""))
    return F.when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0"))


def exchange_of(text: Column) -> Column:
    return F.upper(F.trim(F.split_part(text, F.lit(":"), F.lit(1))))


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\.-]", "")


def quarter_fields(q: Column, date: Column) -> tuple[Column, Column]:
    """(year, quarter) strings from ``yyyy-Qn``, each on its own falling back to the date."""
    d = parsed_date(date)
    year = F.coalesce(F.nullif(F.regexp_extract(q, r"^(\d{4})-(Q[1-4])", 1), F.lit("")), F.year(d).cast("string"))
    quarter = F.coalesce(F.nullif(F.regexp_extract(q, r"^(\d{4})-(Q[1-4])", 2), F.lit("")), F.concat(F.lit("Q"), F.quarter(d)))
    return year, quarter


def without_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[CHUNK[^\]]*\]", ""), r"(?U)^\s+|\s+$", "")


def intent_of(answer: Column) -> Column:
    """The first known intent that a model's answer contains, else HYBRID."""
    out = F.lit("HYBRID")
    for name in reversed(INTENTS):
        out = F.when(F.contains(F.upper(answer), F.lit(name)), name).otherwise(out)
    return out


def asks_price(query: Column, words: list[str] = PRICE_WORDS) -> Column:
    low = F.lower(query)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def price_text(day: Column, close: Column, dividend: Column) -> Column:
    return F.concat(F.lit("Close price on "), day.cast("string"), F.lit(": $"), F.format_number(close, 2), F.lit(". Dividend per share (TTM): $"), F.format_number(F.coalesce(dividend, F.lit(0.0)), 2), F.lit("."))


def date_in_query(query: Column) -> Column:
    """The first date in a question as yyyy-MM-dd, '' without one; a month and year alone mean its first day."""
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"

    def grab(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(query, f"(?i)\\b({pattern})\\b", 1), F.lit(""))

    def first(c: Column, *formats: str) -> Column:
        return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats))

    short = F.regexp_replace(grab(rf"{month}\s+\d{{1,2}},?\s+\d{{4}}"), r"(?i)^([a-z]{3})[a-z]*\s+(\d{1,2}),?\s+", "$1 $2 ")
    mid = F.regexp_replace(grab(rf"\d{{1,2}}\s+{month}\s+\d{{4}}"), r"(?i)^(\d{1,2})\s+([a-z]{3})[a-z]*\s+", "$1 $2 ")
    bare = F.regexp_replace(grab(rf"{month}\s+\d{{4}}"), r"(?i)^([a-z]{3})[a-z]*\s+", "$1 1 ")
    return F.coalesce(
        F.date_format(
            F.coalesce(
                first(grab(r"\d{4}-\d{1,2}-\d{1,2}"), "yyyy-M-d"), first(grab(r"\d{4}/\d{1,2}/\d{1,2}"), "yyyy/M/d"),
                first(F.regexp_replace(grab(r"\d{1,2}[-/]\d{1,2}[-/]\d{4}"), "-", "/"), "M/d/yyyy", "d/M/yyyy"),
                first(F.initcap(short), "MMM d yyyy"), first(F.initcap(mid), "d MMM yyyy"), first(F.initcap(bare), "MMM d yyyy"),
            ), "yyyy-MM-dd",
        ), F.lit(""),
    )


def scrubbed_filing(text: Column) -> Column:
    """Downloaded filing text without links, the commission's cover heading and the contents up to Item 1; single line breaks."""
    t = F.regexp_replace(text, r"https?://\S+", "")
    t = F.regexp_replace(t, r"(?is)UNITED STATES\s+SECURITIES AND EXCHANGE COMMISSION.*?Washington,\s*D\.C\.\s*\d+", "")
    t = F.regexp_replace(t, r"(?is)TABLE OF CONTENTS.*?(?=Item\s+1)", "")
    return F.trim(F.regexp_replace(F.replace(t, F.lit(" "), F.lit(" ")), r"\n+", "\n"))


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_text(page: Column) -> Column:
    """Visible text of a page: comments, scripts and styles out, tags dropped, character references resolved by name and number.

    The table of names is the standard library's, so that step runs on Arrow batches.
    """
    t = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    return F.pandas_udf(_unescape, StringType())(F.regexp_replace(t, r"<[^<>]*>", ""))


def calendar_quarter(date: Column) -> Column:
    return F.quarter(parsed_date(date))


def digit_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^0-9]", "")) / F.length(text)


#: Numbers that one fold adds up: the array it makes is copied at each step, so folds stay short.
FOLD = 256


def running_starts(lengths: Column) -> Column:
    """Where each of consecutive pieces begins, from their lengths: sums within blocks, then the blocks' offsets."""

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / FOLD)), lambda b: sums(F.slice(lengths, (b * FOLD + 1).cast("int"), F.lit(FOLD))))
    held = F.array(F.struct(blocks.alias("b"), sums(F.transform(blocks, lambda x: F.element_at(x, -1))).alias("o")))
    return F.get(F.transform(held, lambda h: F.flatten(F.zip_with(h["b"], F.slice(h["o"], 1, F.size(h["b"])), lambda x, o: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + o)))), 0)


#: Characters that mark where a match begins and ends; they are dropped from texts that hold them.
BEGIN, END = "\u0001", "\u0002"


def unmarked(text: Column) -> Column:
    return F.translate(text, BEGIN + END, "")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, word>> of a pattern's matches in an ``unmarked`` text, in order; offsets count characters from 0."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{BEGIN}$0{END}"), BEGIN)
    held = F.array(F.struct(pieces.alias("p"), running_starts(F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))).alias("s")))

    def found(h: Column) -> Column:
        def one(z: Column) -> Column:
            word = F.split_part(z["p"], F.lit(END), F.lit(1))
            return F.struct(z["s"].alias("start"), (z["s"] + F.length(word)).alias("end"), word.alias("word"))

        # the first piece is what stands before the first match
        return F.transform(F.slice(F.arrays_zip(h["p"].alias("p"), h["s"].alias("s")), F.lit(2), F.size(h["p"])), one)

    return F.get(F.transform(held, found), 0)
