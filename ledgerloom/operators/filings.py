"""Filings: cleaning, sectioning, and the metadata that goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Names of the numbered items of an annual report.
SECTION_NAMES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures",
    "5": "Market for Registrant’s Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities", "6": "[Reserved]",
    "7": "Management’s Discussion and Analysis of Financial Condition and Results of Operations (MD&A)", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure",
    "9A": "Controls and Procedures", "9B": "Other Information", "9C": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "10": "Directors, Executive Officers and Corporate Governance", "11": "Executive Compensation",
    "12": "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters",
    "13": "Certain Relationships and Related Transactions, and Director Independence", "14": "Principal Accountant Fees and Services",
    "15": "Exhibits, Financial Statement Schedules", "16": "Form 10-K Summary (Optional)",
}
# The sections taken from a quarterly report: item, word that its heading holds, name.
TARGETS_10Q = [("1A", "RISK", "Risk Factors"), ("2", "MANAGEMENT", "MD&A (Management’s Discussion & Analysis)"), ("3", "MARKET", "Quant & Qualitative Market Risk")]

HEADER_10K = r"\b(?:PART\s(?:I{1,3}|IV)\s+)?Item\s((?:[1-9]|1[0-6])[A-Z]?)\."
HEADER_10Q = r"(?i)ITEM\s+(\d+[A-Z]?)\."
FIRST_ITEM = r"(?is)Item\s*1\s*[.•](?!\d)"
LAST_PART = r"(?is)^.*(PART\s+I\s*,?\s*Item\s*1\s*[.•](?!\d).*)$"
MARK = "\u0001"


def clean_text(text: Column) -> Column:
    """Quotes, joined words and white space put right; repeated sentences dropped."""
    return X.kept_first(X.sentences(X.single_spaced(X.split_joined_words(X.normalized_quotes(text)))))


def kept_chunks(chunks: Column, filing_type: Column, from_text: Column) -> Column:
    """Chunks that are neither blank nor taxonomy residue; an annual report's first one is skipped unless it came as one text."""
    body = F.when((filing_type == "10-K") & ~from_text, F.slice(chunks, F.lit(2), F.greatest(F.size(chunks), F.lit(0)))).otherwise(chunks)
    return F.filter(body, lambda c: (F.trim(c) != "") & ~F.contains(F.lower(c), F.lit("us-gaap")))


def from_first_item(text: Column) -> Column:
    def cut(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(FIRST_ITEM))
        return F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)

    return X.held(text, cut)


def from_last_part(text: Column) -> Column:
    """From the last ``PART I Item 1.``, or null if there is none."""
    return F.nullif(F.regexp_extract(text, LAST_PART, 1), F.lit(""))


def from_last_plain_item(text: Column) -> Column:
    """From the last literal ``Item 1.``; the whole text without one."""

    def cut(t: Column) -> Column:
        back = F.instr(F.reverse(t), ".1 metI")
        return F.when(back > 0, F.substring(t, F.length(t) - back - 5, F.length(t))).otherwise(t)

    return X.held(text, cut)


def clean_filings(raw: DataFrame, profile: str = "general") -> DataFrame:
    """Clean documents (ticker, date, url, filing_type kept) from rows with ``text_chunks`` or, without them, ``text``.

    The general profile drops repeated chunks and sentences and starts at the first Item 1; ``apple`` keeps repetitions, starts at
    the last ``PART I Item 1.`` of an annual report and knows other page furniture. Documents of fewer than 50 words, and
    in the apple profile those of other companies, are dropped. Null texts, types and dates give no document or a null.
    """
    chunks = F.coalesce("text_chunks", F.array("text"))
    rows = raw.withColumn("_c", kept_chunks(chunks, F.coalesce("filing_type", F.lit("")), F.col("text_chunks").isNull()))
    if profile == "apple":
        rows = rows.where((F.col("ticker") == "AAPL") & F.col("filing_type").isNotNull() & (F.size("_c") > 0))
        joined = F.array_join("_c", " ")
        start = X.held(joined, lambda t: F.when(F.col("filing_type") == "10-K", F.coalesce(from_last_part(t), from_first_item(t))).otherwise(from_first_item(t)))
        cleaned = X.single_spaced(X.split_joined_words(X.normalized_quotes(X.without_lines(start, X.APPLE_HEADER_LINES))))
    else:
        cleaned = clean_text(X.without_lines(from_first_item(F.array_join(X.first_by_key(F.col("_c")), " "))))
    # a generator stands between the cleaning and the filter, which else would clean every text a second time
    rows = rows.select("*", F.explode(F.array(cleaned)).alias("cleaned_text")).where(X.word_count(F.col("cleaned_text")) >= 50)
    return rows.select("cleaned_text", "ticker", "date", F.year(X.parsed_date(F.col("date"))).alias("year"), X.cik_of(F.col("url")).alias("cik"), "filing_type")


def routed_clean(raw: DataFrame) -> DataFrame:
    """Each document by the profile of its company."""
    return clean_filings(raw.where("ticker is null or ticker <> 'AAPL'")).unionByName(clean_filings(raw.where("ticker = 'AAPL'"), "apple"))


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1"), MARK)


def sections_10k(docs: DataFrame, id_col: str, text_col: str, min_length: int = 500, as_mapping: bool = False) -> DataFrame:
    """(id, pos, item, section, text): the parts between item headings of an annual report.

    The part before the first heading is PREFACE. Listed sections need a body longer than ``min_length``; as a mapping the last
    body of each item counts, whatever its length. Null texts give no row.
    """
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(_pieces(F.col(text_col), HEADER_10K)).alias("pos", "part")).withColumn("part", F.regexp_replace("part", r"(?U)^\s+|\s+$", "")).where("part <> ''")
    names = F.create_map(*(F.lit(x) for pair in SECTION_NAMES.items() for x in pair))
    item = F.nullif(F.regexp_extract("part", f"^{HEADER_10K}", 1), F.lit(""))
    body = F.when(item.isNull(), F.col("part")).otherwise(F.regexp_replace(F.regexp_replace("part", f"^{HEADER_10K}", ""), r"(?U)^\s+", ""))
    section = F.when(item.isNull(), "Preface or Miscellaneous").otherwise(F.coalesce(F.try_element_at(names, item), F.concat(F.lit("Item "), item)))
    rows = parts.select("id", "pos", F.coalesce(item, F.lit("PREFACE")).alias("item"), section.alias("section"), body.alias("text"))
    if as_mapping:
        last = W.partitionBy("id", "item").orderBy(F.desc("pos"))
        return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return rows.where(F.length("text") > min_length)


def sections_10q(docs: DataFrame, id_col: str, text_col: str, min_length: int = 500, max_digits: float = 0.40) -> DataFrame:
    """(id, pos, item, section, text): target sections of a quarterly report, known by item and a word within 120 characters.

    Short bodies and those of 40 percent digits or more are dropped. Null texts give no row.
    """
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(_pieces(F.col(text_col), HEADER_10Q)).alias("pos", "part")).where(F.col("part").rlike(f"^{HEADER_10Q}"))
    item = F.upper(F.regexp_extract("part", f"^{HEADER_10Q}", 1))
    rest = F.regexp_replace("part", f"^{HEADER_10Q}", "")
    ahead = F.upper(F.substring(rest, 1, 120))
    section = F.lit(None).cast("string")
    for number, word, name in reversed(TARGETS_10Q):
        section = F.when((item == number) & F.contains(ahead, F.lit(word)), name).otherwise(section)
    rows = parts.select("id", "pos", item.alias("item"), section.alias("section"), F.regexp_replace(rest, r"(?U)^\s+|\s+$", "").alias("text"))
    return rows.where(F.col("section").isNotNull() & (F.length("text") >= min_length) & (X.digit_ratio(F.col("text")) < max_digits))


def flat_metadata(docs: DataFrame) -> DataFrame:
    """Metadata from either layout: a nested ``metadata`` first, then the flat columns."""
    fields = ["ticker", "date", "cik", "year", "filing_type"]
    flat = {c: (F.col(c) if c in docs.columns else F.lit(None)) for c in fields}
    nested = {c: (F.col(f"metadata.{c}") if "metadata" in docs.columns else F.lit(None)) for c in fields}
    return docs.select("*", *(F.coalesce(nested[c], flat[c]).alias(f"m_{c}") for c in fields))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``: what overwriting files of one name leaves."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).where("_r = 1").drop("_r")
