"""SQL of registered queries that takes more than a line, written for itself and not from the library's constants."""

from __future__ import annotations

from ..functions.prompts import SYNTHESIS
from .catalog import _ASKS, _DAILY, SQL, _apple_sql, _clean_filings_sql

_FOCUSES = (
    "(SELECT example_id, user_query, unnest(json_extract(metadata, '$.focuses[*]')) AS f, generate_subscripts(json_extract(metadata, '$.focuses[*]'), 1) - 1 AS i "
    "FROM qa_answer WHERE metadata IS NOT NULL AND json_valid(metadata))"
)


def _routed() -> str:
    general = f"SELECT g.* FROM ({_clean_filings_sql('r.doc_id')}) g WHERE doc_id % 5 > 0"
    apple = f"SELECT a.* FROM ({_apple_sql('r.doc_id')}) a WHERE doc_id % 5 = 0"
    return f"SELECT cleaned_text, ticker, date, year, cik, filing_type FROM ({general} UNION ALL {apple})"


def _market() -> str:
    day = "CAST(CAST(day AS DATE) AS VARCHAR)"
    return (
        f"WITH {_DAILY}, {_ASKS} SELECT ask_id, '**' || ticker || CASE WHEN close IS NULL THEN '**: No price data for ' || {day} ELSE '** on ' || {day} || ': $' || printf('%.2f', close) END AS line "
        "FROM asks LEFT JOIN daily USING (ticker, day)"
    )


def _standardized() -> str:
    def text(name: str) -> str:
        return f"nullif(f ->> '$.{name}', '') AS {name}"

    def whole(name: str) -> str:
        return f"CASE WHEN regexp_matches(trim(f ->> '$.{name}'), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(f ->> '$.{name}') AS INTEGER) END AS {name}"

    digit = "regexp_extract(coalesce(nullif(trim(f ->> '$.quarter'), ''), nullif(trim(f ->> '$.raw_quarter'), '')), '[qQ]?([0-9])', 1)"
    kind = "coalesce(" + ", ".join(f"nullif(trim(f ->> '$.{n}'), '')" for n in ("normalized_doc_type", "source_type", "filing_type", "doc_type")) + ")"
    plain = ", ".join(map(text, ("ticker", "raw_quarter", "exchange", "date", "time", "company_name")))
    return (
        f"SELECT example_id AS id, user_query, CAST(i AS INTEGER) AS focus_no, {plain}, {whole('year')}, {whole('source_id')}, CASE WHEN {digit} <> '' THEN 'Q' || {digit} END AS quarter, "
        f"trim(replace(upper({kind}), '_', ' ')) AS normalized_doc_type FROM {_FOCUSES} WHERE trim(coalesce(user_query, '')) <> ''"
    )


def _from_answer() -> str:
    return (
        "SELECT example_id, f ->> '$.ticker' AS ticker, TRY_CAST(f ->> '$.year' AS INTEGER) AS year, TRY_CAST(regexp_replace(upper(f ->> '$.quarter'), '^Q', '') AS INTEGER) AS quarter, "
        f"coalesce(f ->> '$.normalized_doc_type', f ->> '$.doc_type') AS doc_type FROM {_FOCUSES} WHERE coalesce(f ->> '$.ticker', '') <> ''"
    )


def _head() -> str:
    quarter = r"(?i)(\d{4})\s+(First|Second|Third|Fourth)\s+Quarter"
    patterns = [
        r"(?i)welcome to the ([\w\s\.''&-]+?)(?:\s+\d{4}\s+(?:First|Second|Third|Fourth)\s+Quarter|\s+earnings conference call)",
        r"(?i)Operator:\s*Good day, and welcome to the ([\w\s\.''&-]+?)\s+(?:Q\d\s\d{4}\s)?(?:Earnings )?Conference Call",
        r"(?i)^([\w\s\.''&-]+?)\s+\([A-Z0-9:\.]+?\)\s+Q\d\s+\d{4}\s+Earnings\s+Call",
        r"(?i)(?:conference call for|earnings call of|results of)\s+([\w\s\.''&-]+?)(?:,|Company|Inc\.?|LLC\.?|$)",
    ]
    found = [f"trim(regexp_extract(head, '{p}', 1))" for p in patterns]
    names = ", ".join(f"CASE WHEN {n} <> '' AND lower({n}) NOT IN ('company', 'the company') THEN {n} END" for n in found)
    word = f"lower(regexp_extract(head, '{quarter}', 2))"
    return (
        f"SELECT df_index, nullif(regexp_extract(head, '{quarter}', 1), '') AS year, CASE {word} WHEN 'first' THEN 'Q1' WHEN 'second' THEN 'Q2' WHEN 'third' THEN 'Q3' WHEN 'fourth' THEN 'Q4' END AS quarter, coalesce({names}) AS company_name "
        "FROM (SELECT df_index, array_to_string(list_slice(string_split(regexp_replace(transcript, '\\r\\n?', chr(10), 'g'), chr(10)), 1, 30), ' ') AS head FROM raw_transcript)"
    )


def _plain(x: str) -> str:
    """Typographic signs as ASCII."""
    one = f"translate({x}, '“”‘’– �', '\"\"''''- ''')"
    return f"replace(replace({one}, '•', '* '), '—', '--')"


def _participants() -> str:
    text = _plain("regexp_replace(transcript, '\\r\\n?', chr(10), 'g')")
    block = r"(?is)(?:Call Participants|Participants|Conference Call Participants|Executives|Analysts|Speakers):\s*\n(.*?)(?:\n\n|\n\p{Lu}[\w\s,&''\.-]+:|Prepared Remarks:|Questions and Answers:)"
    lines = "flatten(list_transform(string_split(block, chr(10)), lambda x: CASE WHEN contains(x, ',') AND NOT contains(x, '--') THEN string_split(x, ',') ELSE [x] END))"
    count = r"len(regexp_split_to_array(x, '[ \t\n\f\r\x0B]+'))"
    kept = f"list_filter(list_transform({lines}, lambda x: trim(x)), lambda x: x <> '' AND (contains(x, '--') OR ({count} <= 5 AND length(x) > 2 AND NOT regexp_matches(lower(x), '^(more |all )'))))"
    bare = rf"list_filter(list_transform({kept}, lambda x: regexp_replace(trim(regexp_replace(x, '^[*\-\d\.]+[ \t\n\f\r\x0B]*', '')), ':+$', '')), lambda x: x <> '' AND {count} < 10)"
    rows = f"(SELECT DISTINCT df_index, unnest({bare}) AS participant FROM (SELECT df_index, regexp_extract({text}, '{block}', 1) AS block FROM raw_transcript))"
    return f"SELECT df_index, CAST(row_number() OVER (PARTITION BY df_index ORDER BY length(participant) DESC, participant) - 1 AS INTEGER) AS i, participant FROM {rows}"


def _speaker_lines() -> str:
    lines = r"regexp_split_to_array(transcript, '\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]')"
    words = r"regexp_split_to_array(s, '[ \t\n\f\r\x0B]+')"
    word = r"[\p{L}\p{M}\p{N}\p{Pc}]"
    space = r"[\t-\r \x{85}\p{Z}]"
    dashed = rf"^(?:{word}|{space}|[.''-])+?{space}*--{space}*(?:{word}|{space}|[,&''.-])+$"
    colon = r"^([A-Z][a-z''.]+(?:[ \t\n\f\r\x0B][A-Z][a-z''.]+){0,3}):$"
    role = "(?i)^(Operator|Moderator|Host)$"
    capital = (
        rf"len({words}) <= 4 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^\p{{Lu}}'))) = 0 AND NOT regexp_matches(s, '[.!?,;]$') "
        "AND lower(s) NOT IN ('thank you', 'good morning', 'good afternoon', 'good evening', 'questions and answers', 'prepared remarks')"
    )
    speaker = f"CASE WHEN regexp_matches(s, '{dashed}') THEN s WHEN regexp_matches(s, '{role}') THEN s WHEN regexp_matches(s, '{colon}') THEN regexp_extract(s, '{colon}', 1) WHEN {capital} THEN s END"
    rows = f"(SELECT df_index, CAST(unnest(generate_series(0, len({lines}) - 1)) AS INTEGER) AS line_no, trim(unnest({lines})) AS s FROM raw_transcript WHERE transcript IS NOT NULL)"
    return f"SELECT df_index, line_no, {speaker} AS speaker FROM {rows} WHERE s <> '' AND length(s) <= 150 AND {speaker} IS NOT NULL"


def _synthesis() -> str:
    item = """'{"source":' || to_json(source) || ',"n":' || n || ',"doc_id":' || doc_id || coalesce(',"text":' || to_json(text), '') || '}'"""
    return (
        "WITH n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id, text FROM documents WHERE source IS NOT NULL), "
        f"g AS (SELECT source AS file, CAST(floor((n - 1) / 5) AS BIGINT) AS group_no, '[' || string_agg({item}, ',' ORDER BY n) || ']' AS items FROM n GROUP BY ALL HAVING count(*) = 5) "
        "SELECT file, group_no, items AS context FROM g QUALIFY row_number() OVER (PARTITION BY file ORDER BY md5('42|' || file || '|' || group_no), group_no) <= 250"
    )


def _blocks() -> str:
    x = "'Thank you, operator. [Operator Instructions] ' || transcript"
    rest = r"[^\n]*"
    for start, end, other in (
        ("Please note the discussion today will contain forward-looking statements", "except as required by law.", rest), ("During today''s call, management will also discuss certain non-GAAP financial measures", "news release issued earlier today.", rest),
        ("As a reminder, this conference call is being recorded.", r"ir.[\w\.-]+com[\.\w\/]*", rest), (r"\[Operator Instructions\]", None, ""), (r"Thank you, operator\.", None, ""),
        (r"Your first question(?: in queue)? comes from the line of .*?\.\s*Your line is open\.", None, ""), (r"Our next question comes from the line of .*?\.\s*Your line is now open\.", None, ""),
        (r"And that concludes the question-and-answer session\.", r"Have a great day\.", rest), (r"Duration: \d+ minutes", r"All earnings call transcripts|Copyright © \d{4}|Thomson Reuters .*? transcript", r".*\z"),
    ):
        x = f"regexp_replace({x}, '(?is){start}', '', 'g')" if end is None else f"regexp_replace({x}, '(?is)(?:{start})(?:.*?(?:{end})|{other})', '', 'g')"
    # what ends a list may begin the next one, so the pattern is used several times over
    listed = r"(?is)(?:Call Participants|Participants|Conference Call Participants|Executives|Analysts|Speakers):.*?(\n\n|\n[A-ZÀ-ÖØ-Þ][\w\s,&''\.-]+:|Prepared Remarks:|Questions and Answers:|\n?\z)"
    for _ in range(4):
        x = f"regexp_replace({x}, '{listed}', '\\1', 'g')"
    return f"SELECT df_index, {x} AS text FROM raw_transcript"


def _generated() -> str:
    return (
        "WITH n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id, text FROM documents WHERE source IS NOT NULL), "
        f"g AS ({_synthesis()}) SELECT file, group_no, CAST(no AS INTEGER) AS example_no, CASE no WHEN 0 THEN 'q ' || (length(context) + {len(SYNTHESIS) - len('{context_group}')}) ELSE 'again' END AS user_query FROM g, (SELECT unnest([0, 2]) AS no)"
    )


SQL |= {
    "boilerplate_remove": _blocks(), "generate_examples": _generated(),
    "clean_filings_routed": _routed(), "market_answer": _market(), "focus_standardize": _standardized(), "focuses_from_answer": _from_answer(), "transcript_metadata": _head(), "participants": _participants(),
    "speaker_lines": _speaker_lines(), "group_context": _synthesis(),
}
