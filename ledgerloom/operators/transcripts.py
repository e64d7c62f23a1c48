"""Call transcripts as documents: participants, boilerplate, speaker lines, turns as windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Blocks that are removed, by how they start and end; a single pattern is removed by itself.
BLOCKS = [
    (r"Please note the discussion today will contain forward-looking statements", r"except as required by law."),
    (r"During today's call, management will also discuss certain non-GAAP financial measures", r"news release issued earlier today."),
    (r"As a reminder, this conference call is being recorded.", r"ir.[\w\.-]+com[\.\w\/]*"),
    (r"\[Operator Instructions\]", None), (r"Thank you, operator\.", None),
    (r"Your first question(?: in queue)? comes from the line of .*?\.\s*Your line is open\.", None),
    (r"Our next question comes from the line of .*?\.\s*Your line is now open\.", None),
    (r"And that concludes the question-and-answer session\.", r"Have a great day\."),
    (r"Duration: \d+ minutes", r"All earnings call transcripts|Copyright © \d{4}|Thomson Reuters .*? transcript"),
    (r"(?:Call Participants|Participants|Conference Call Participants|Executives|Analysts|Speakers):.*?(?=\n\n|\n[A-ZÀ-ÖØ-Þ][\w\s,&'\.-]+:|Prepared Remarks:|Questions and Answers:|\n?\z)", None),
]
TO_THE_END = r"Duration: \d+ minutes"
# Fixed patterns: where the participants are listed, what looks like a speaker and is none, and how the head names the company.
LIST_BLOCK = r"(?is)(?:Call Participants|Participants|Conference Call Participants|Executives|Analysts|Speakers):\s*\n(.*?)(?:\n\n|\n\p{Lu}[\w\s,&'\.-]+:|Prepared Remarks:|Questions and Answers:)"
NOT_SPEAKERS = ["thank you", "good morning", "good afternoon", "good evening", "questions and answers", "prepared remarks"]
COMPANY = [
    r"(?i)welcome to the ([\w\s\.'&-]+?)(?:\s+\d{4}\s+(?:First|Second|Third|Fourth)\s+Quarter|\s+earnings conference call)",
    r"(?i)Operator:\s*Good day, and welcome to the ([\w\s\.'&-]+?)\s+(?:Q\d\s\d{4}\s)?(?:Earnings )?Conference Call",
    r"(?i)^([\w\s\.'&-]+?)\s+\([A-Z0-9:\.]+?\)\s+Q\d\s+\d{4}\s+Earnings\s+Call",
    r"(?i)(?:conference call for|earnings call of|results of)\s+([\w\s\.'&-]+?)(?:,|Company|Inc\.?|LLC\.?|$)",
]


def participants(text: Column) -> Column:
    """Listed participants, longest first: lines with a double dash or of at most five words; comma lists are split."""
    block = F.regexp_extract(text, LIST_BLOCK, 1)
    lines = F.flatten(F.transform(F.split(block, r"\n"), lambda x: F.when(F.contains(x, F.lit(",")) & ~F.contains(x, F.lit("--")), F.split(x, ",")).otherwise(F.array(x))))
    kept = F.filter(
        F.transform(lines, lambda x: F.trim(x)),
        lambda x: (x != "") & (F.contains(x, F.lit("--")) | ((F.size(F.split(x, r"\s+")) <= 5) & (F.length(x) > 2) & ~F.lower(x).rlike(r"^(more |all )"))),
    )
    bare = F.filter(F.transform(kept, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[*\-\d\.]+\s*", "")), ":+$", "")), lambda x: (x != "") & (F.size(F.split(x, r"\s+")) < 10))
    # sorted by falling length, then text
    return F.transform(F.array_sort(F.transform(F.array_distinct(bare), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def without_blocks(text: Column) -> Column:
    """Text without the known blocks: from each start to the next end, else to the line's end (or the text's, after the duration)."""
    out = text
    for start, end in BLOCKS:
        if end is None:
            out = F.regexp_replace(out, f"(?isu){start}", "")
        else:
            rest = r".*\z" if start == TO_THE_END else r"[^\n]*"
            out = F.regexp_replace(out, f"(?isu)(?:{start})(?:.*?(?:{end})|{rest})", "")
    return out


def metadata_from_head(text: Column) -> tuple[Column, Column, Column]:
    """(year, quarter, company) from the first thirty lines."""
    head = F.array_join(F.slice(F.split(text, r"\n"), 1, 30), " ")
    pattern = r"(?i)(\d{4})\s+(First|Second|Third|Fourth)\s+Quarter"
    words = F.create_map(*(F.lit(x) for p in (("first", "Q1"), ("second", "Q2"), ("third", "Q3"), ("fourth", "Q4")) for x in p))
    year = F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    quarter = F.try_element_at(words, F.lower(F.regexp_extract(head, pattern, 2)))
    names = [F.trim(F.regexp_extract(head, p, 1)) for p in COMPANY]
    company = F.coalesce(*(F.when((n != "") & ~F.lower(n).isin("company", "the company"), n) for n in names))
    return year, quarter, company


def speaker_of_line(line: Column, listed: Column | None = None) -> Column:
    """The speaker that a line introduces, or null: a listed participant, ``Name -- Title``, a role, ``Name:``, or a few capitalised words."""
    s = F.trim(line)
    low = F.lower(s)
    words = F.split(s, r"\s+")
    dashed = s.rlike(r"(?U)^[\w\s\.'-]+?\s*--\s*[\w\s,&'\.-]+$")
    role = F.regexp_extract(s, r"(?i)^(Operator|Moderator|Host)$", 1)
    colon = F.regexp_extract(s, r"^([A-Z][a-z'.]+(?:\s[A-Z][a-z'.]+){0,3}):$", 1)
    capital = (F.size(words) <= 4) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & ~s.rlike(r"[.!?,;]$") & ~low.isin(*NOT_SPEAKERS)

    def enriched(name: Column) -> Column:
        if listed is None:
            return name
        fuller = F.filter(listed, lambda p: F.startswith(F.lower(p), F.lower(name)) & (F.contains(p, F.lit("--")) | F.lower(p).rlike("analyst|officer|director")))
        return F.coalesce(F.get(fuller, 0), name)

    by_rule = F.when(dashed, s).when(role != "", role).when(colon != "", enriched(colon)).when(capital, enriched(s))
    if listed is not None:
        hit = F.get(F.filter(listed, lambda p: (low == F.lower(p)) | F.startswith(low, F.concat(F.lower(p), F.lit(":")))), 0)
        by_rule = F.coalesce(hit, by_rule)
    return F.when((s == "") | (F.length(s) > 150), None).otherwise(by_rule)


def simple_name(speaker: Column) -> Column:
    return F.trim(F.split_part(speaker, F.lit(" -- "), F.lit(1)))


def speaker_title(speaker: Column) -> Column:
    title = F.trim(F.split_part(speaker, F.lit(" -- "), F.lit(2)))
    return F.when(title != "", title).when(F.lower(simple_name(speaker)).isin("operator", "moderator", "host"), simple_name(speaker)).otherwise("N/A")


def turn_id(ticker: Column, year: Column, quarter: Column, n: Column) -> Column:
    return F.format_string("%s_%s_%s_turn%03d", F.coalesce(ticker, F.lit("UNK")), F.coalesce(year, F.lit("YYYY")), F.coalesce(quarter, F.lit("QX")), n)


def turn_table(transcripts: DataFrame, id_col: str = "df_index") -> DataFrame:
    """One row per turn: (id, turn_no, turn_id, speaker_full, speaker_simple_name, speaker_title_affiliation, section, text, ticker, year, quarter).

    Lines are markers (a section header or a speaker) or speech; a running count of markers makes the groups, the last speaker and
    section are carried along, and a header resets the speaker to Unknown. Speech is cleaned, its repeated and one-word
    sentences dropped; empty turns vanish before numbering. Null and blank transcripts give no row. Windows are per
    transcript, a row of the input.
    """
    text = X.plain_punctuation(F.regexp_replace("transcript", r"\r\n?", "\n"))
    year, quarter = X.quarter_fields(F.col("q"), F.col("date"))
    head_year, head_quarter, company = metadata_from_head(text)
    docs = transcripts.where(F.trim("transcript") != "").select(
        F.col(id_col).alias("id"), F.upper(F.trim("ticker")).alias("ticker"), F.coalesce(year, head_year).alias("year"), F.coalesce(quarter, head_quarter).alias("quarter"), company.alias("company_name"),
        F.monotonically_increasing_id().alias("row"), participants(text).alias("listed"), F.split(without_blocks(text), r"\n").alias("lines"),
    )
    lines = docs.select("row", "id", "ticker", "year", "quarter", "company_name", "listed", F.posexplode("lines").alias("line_no", "line")).where(F.trim("line") != "")
    low = F.lower(F.trim("line"))
    section = F.when(low.rlike(r"^(prepared remarks|presentation)"), "Prepared Remarks").when(low.rlike(r"^(questions and answers|q&a)"), "Q&A")
    lines = lines.withColumn("sec", section).withColumn("who", F.when(F.col("sec").isNull(), speaker_of_line(F.col("line"), F.col("listed"))))
    rest = F.regexp_replace(F.substring(F.trim("line"), F.length("who") + 1, F.length("line")), r"^[: ]+", "")
    opener = F.trim("line").rlike(r"(?i)^(Okay|Great|Alright|All right|Thank you|Thanks|Yes|Well|So|And now|Next question).{0,20}$")
    speech = F.when(F.col("sec").isNotNull(), "").when(F.col("who").isNotNull(), F.when(opener, "").otherwise(rest)).otherwise(F.col("line"))
    lines = lines.withColumn("speech", speech).drop("listed")
    order = W.partitionBy("row").orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    marker = F.col("sec").isNotNull() | F.col("who").isNotNull()
    lines = lines.withColumn("g", F.sum(marker.cast("int")).over(so_far)).withColumn("section", F.coalesce(F.last("sec", ignorenulls=True).over(so_far), F.lit("Introduction/Presentation")))
    keys = ["row", "id", "ticker", "year", "quarter", "company_name", "g"]
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "speech"))), lambda x: x["speech"]), "\n")
    turns = lines.groupBy(*keys).agg(F.coalesce(F.max("who"), F.lit("Unknown")).alias("speaker_full"), F.min("section").alias("section"), F.trim(said).alias("raw"))
    # a generator stands between the cleaning and the filter, which else would clean every turn a second time
    turns = turns.select("*", F.explode(F.array(X.kept_first(X.sentences(X.without_noise(F.col("raw")), capital_follows=False), min_words=2))).alias("text")).where("text <> ''")
    turns = turns.withColumn("turn_no", F.row_number().over(W.partitionBy("row").orderBy("g")))
    return turns.select(
        "id", "turn_no", turn_id(F.col("ticker"), F.col("year"), F.col("quarter"), F.col("turn_no")).alias("turn_id"), "speaker_full", simple_name(F.col("speaker_full")).alias("speaker_simple_name"),
        speaker_title(F.col("speaker_full")).alias("speaker_title_affiliation"), "section", "text", "ticker", "year", "quarter", "company_name",
    )
