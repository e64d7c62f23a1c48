"""The registered queries of the core library and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer, chunking, datasets, drift, filings, market, questions, retrieval, transcripts
from ..operators.providers import FixedCompleter, ModelRefiner, RuleIntent
from ..session import table
from ..sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# SQL spellings of the text functions; RE2 has no lookaround, so those are written with groups and a sentinel
LINES = r"regexp_split_to_array({0}, '\r\n|[\n\x0B\x0C\r\x{{85}}\x{{2028}}\x{{2029}}]')"
SPACE = r"[\t-\r \x{85}\p{Z}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def s_single(x: str) -> str:
    return s_strip(f"regexp_replace(regexp_replace({x}, '[\\n\\r\\t]+', ' ', 'g'), '{SPACE}{{2,}}', ' ', 'g')")


def s_camel(x: str) -> str:
    once = f"regexp_replace({x}, '([a-z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"regexp_replace({once}, '([a-z])([A-Z][a-z])', '\\1 \\2', 'g')"


def s_quotes(x: str) -> str:
    return f"replace(replace({x}, '�', ''''), '’', '''')"


def s_split(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])[ \\t\\n\\f\\r]+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def s_key(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '[ \\t\\n\\f\\r]+', ' ', 'g')))"


def s_clean(source: str, key: str, text: str) -> str:
    """CTE text: (key, clean) of a relation."""
    prepared = s_single(s_camel(s_quotes(text)))
    return (
        f"(SELECT {key}, coalesce(string_agg(s, ' ' ORDER BY i), '') AS clean FROM (SELECT {key}, arg_min(trim(s), i) AS s, min(i) AS i FROM "
        f"(SELECT {key}, unnest({s_split(prepared)}) AS s, generate_subscripts({s_split(prepared)}, 1) AS i FROM {source}) WHERE {s_key('s')} <> '' GROUP BY {key}, {s_key('s')}) GROUP BY {key})"
    )


def s_words(x: str) -> str:
    return f"CASE WHEN {s_strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({s_strip(x)}, '{SPACE}+')) END"


def s_lines(x: str, pattern: str) -> str:
    return f"array_to_string(list_filter({LINES.format(x)}, lambda l: NOT regexp_matches(l, '{pattern}')), chr(10))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "ticker", "doc_year", "published_at")


# -- text functions over whole documents --------------------------------------------------------------------------


@query("line_filter_headers", f"SELECT doc_id, {s_lines("(chr(10) || '17' || chr(10) || 'TABLE OF CONTENTS' || chr(10) || 'Item 2. Results 14' || chr(10) || text)", X.HEADER_LINES)} AS kept FROM documents")
def line_filter_headers(spark, d):
    return docs(spark, d).select("doc_id", X.without_lines(F.concat(F.lit("\n17\nTABLE OF CONTENTS\nItem 2. Results 14\n"), "text")).alias("kept"))


@query("line_filter_apple", f"SELECT doc_id, {s_lines("('Apple Inc. | Q1 2020 Form 10-Q | 12' || chr(10) || text)", X.APPLE_HEADER_LINES)} AS kept FROM documents")
def line_filter_apple(spark, d):
    return docs(spark, d).select("doc_id", X.without_lines(F.concat(F.lit("Apple Inc. | Q1 2020 Form 10-Q | 12\n"), "text"), X.APPLE_HEADER_LINES).alias("kept"))


@query("min_words", f"SELECT doc_id, CAST({s_words('text')} AS INTEGER) AS n_words FROM documents WHERE {s_words('text')} >= 50")
def min_words(spark, d):
    return docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("n_words")).where("n_words >= 50")


@query("normalize_punct", "SELECT doc_id, replace(replace(translate('• “a” – ‘b’ — ' || text, '“”‘’– �', '\"\"''''- '''), '•', '* '), '—', '--') AS plain FROM documents")
def normalize_punct(spark, d):
    return docs(spark, d).select("doc_id", X.plain_punctuation(F.concat(F.lit("• “a” – ‘b’ — "), "text")).alias("plain"))


@query("camel_split", f"SELECT doc_id, {s_camel("replace(text, ' ', '')")} AS words FROM documents")
def camel_split(spark, d):
    return docs(spark, d).select("doc_id", X.split_joined_words(F.replace("text", F.lit(" "), F.lit(""))).alias("words"))


@query("ws_normalize", f"SELECT doc_id, {s_single('text')} AS spaced, regexp_replace(text, '[ \\t]{{2,}}', ' ', 'g') AS speech FROM documents")
def ws_normalize(spark, d):
    return docs(spark, d).select("doc_id", X.single_spaced(F.col("text")).alias("spaced"), X.spaced_speech(F.col("text")).alias("speech"))


def _noise_sql() -> str:
    x = "regexp_replace('[Operator Instructions] Please go ahead. ' || text || ' (operator instructions)', '[ \\t]{2,}', ' ', 'g')"
    for p in X.SPEECH_NOISE:
        x = f"regexp_replace({x}, '(?i){p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"SELECT doc_id, {s_strip(x)} AS speech FROM documents"


@query("noise_removal", _noise_sql())
def noise_removal(spark, d):
    return docs(spark, d).select("doc_id", X.without_noise(F.concat(F.lit("[Operator Instructions] Please go ahead. "), "text", F.lit(" (operator instructions)"))).alias("speech"))


@query("sentence_split", f"SELECT doc_id, CAST(len({s_split('t')}) AS INTEGER) AS n, {s_split('t')}[1] AS first FROM (SELECT doc_id, {s_single('text')} AS t FROM documents)")
def sentence_split(spark, d):
    parts = X.sentences(X.single_spaced(F.col("text")))
    return docs(spark, d).select("doc_id", parts.alias("p")).select("doc_id", F.when(F.col("p").isNotNull(), F.size("p")).alias("n"), F.get("p", F.lit(0)).alias("first"))


@query("clean_text", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(clean, '') END AS clean FROM documents LEFT JOIN {s_clean('documents', 'doc_id', 'text')} USING (doc_id)")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", filings.clean_text(F.col("text")).alias("clean"))


@query("digit_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0), 9) AS ratio FROM documents WHERE text <> ''")
def digit_ratio(spark, d):
    return docs(spark, d).where("text <> ''").select("doc_id", F.round(X.digit_ratio(F.col("text")), 9).alias("ratio"))


CHUNKS_SQL = "list_filter(CASE WHEN source = 'filing_10k' THEN list_slice(c, 2, len(c)) ELSE c END, lambda x: trim(x) <> '' AND NOT contains(lower(x), 'us-gaap'))"


@query("chunk_predicates", f"SELECT doc_id, CAST(len({CHUNKS_SQL}) AS INTEGER) AS n, array_to_string({CHUNKS_SQL}, '|') AS kept FROM (SELECT doc_id, source, string_split(text, chr(10) || chr(10)) AS c FROM documents WHERE text IS NOT NULL)")
def chunk_predicates(spark, d):
    kept = filings.kept_chunks(F.split("text", "\n\n"), F.when(F.col("source") == "filing_10k", "10-K").otherwise("10-Q"), F.lit(False))
    return docs(spark, d).where("text is not null").select("doc_id", kept.alias("k")).select("doc_id", F.size("k").alias("n"), F.array_join("k", "|").alias("kept"))


@query("chunk_dedup", f"SELECT doc_id, string_agg(c, ' ' ORDER BY i) AS joined FROM (SELECT doc_id, arg_min(c, i) AS c, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE {s_key('c')} <> '' GROUP BY doc_id, {s_key('c')}) GROUP BY doc_id")
def chunk_dedup(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.array_join(X.first_by_key(F.split("text", "\n")), " ").alias("joined")).where("joined <> ''")


_MARKED = "'PART I Item 1. aa ' || text || ' PART I Item 1. Item 10. bb'"
_FIRST = r"regexp_extract({0}, '(?is)Item\s*1\s*[.•](?:[^0-9].*|)$', 0)"
_LAST = r"regexp_extract({0}, '(?is)^.*(PART\s+I\s*,?\s*Item\s*1\s*[.•](?:[^0-9].*|))$', 1)"


@query("first_last_marker", f"SELECT doc_id, {_FIRST.format(_MARKED)} AS from_first, {_LAST.format(_MARKED)} AS from_last, substr({_MARKED}, length({_MARKED}) - length(' bb') - length('Item 1. Item 10.') + 1) AS from_plain FROM documents WHERE text IS NOT NULL")
def first_last_marker(spark, d):
    t = F.concat(F.lit("PART I Item 1. aa "), "text", F.lit(" PART I Item 1. Item 10. bb"))
    return docs(spark, d).where("text is not null").select("doc_id", filings.from_first_item(t).alias("from_first"), filings.from_last_part(t).alias("from_last"), filings.from_last_plain_item(t).alias("from_plain"))


def raw_filings(spark: SparkSession, d: str, ticker=None) -> DataFrame:
    kind = F.when(F.col("source") == "filing_10k", "10-K").otherwise("10-Q")
    return docs(spark, d).select(
        "doc_id", F.coalesce(ticker, F.col("ticker")).alias("ticker") if ticker is not None else F.col("ticker"), F.date_format("published_at", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("text"),
        F.split(F.concat(F.lit("Cover\n\nPART I Item 1. "), "text"), "\n\n").alias("text_chunks"), F.concat(F.lit("https://example.org/data/"), "doc_id", F.lit("/x.htm")).alias("url"), kind.alias("filing_type"),
    )


_RAW = (
    "(SELECT doc_id, ticker, strftime(published_at, '%Y-%m-%d') AS date, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(10, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS cik, "
    "CASE WHEN source = 'filing_10k' THEN '10-K' ELSE '10-Q' END AS filing_type, source, string_split('Cover' || chr(10) || chr(10) || 'PART I Item 1. ' || text, chr(10) || chr(10)) AS c FROM documents WHERE text IS NOT NULL)"
)
_META = "r.ticker, r.date, CAST(left(r.date, 4) AS INTEGER) AS year, r.cik, r.filing_type"


def _clean_filings_sql(more: str = "") -> str:
    kept = f"(SELECT *, {CHUNKS_SQL} AS k FROM {_RAW})"
    unique = f"(SELECT doc_id, string_agg(c, ' ' ORDER BY i) AS t FROM (SELECT doc_id, arg_min(c, i) AS c, min(i) AS i FROM (SELECT doc_id, unnest(k) AS c, generate_subscripts(k, 1) AS i FROM {kept}) GROUP BY doc_id, {s_key('c')}) GROUP BY doc_id)"
    first = _FIRST.format("t")
    body = f"(SELECT doc_id, {s_lines(f"CASE WHEN {first} <> '' THEN {first} ELSE t END", X.HEADER_LINES)} AS t FROM {unique})"
    return f"SELECT clean AS cleaned_text, {_META}{', ' * bool(more) + more} FROM {s_clean(body, 'doc_id', 't')} c JOIN {_RAW} r USING (doc_id) WHERE {s_words('clean')} >= 50"


@query("clean_filings", _clean_filings_sql())
def clean_filings(spark, d):
    return filings.clean_filings(raw_filings(spark, d))


def _apple_sql(more: str = "") -> str:
    joined = f"(SELECT doc_id, filing_type, array_to_string({CHUNKS_SQL}, ' ') AS t FROM {_RAW} WHERE len({CHUNKS_SQL}) > 0)"
    first, last = _FIRST.format("t"), _LAST.format("t")
    start = f"CASE WHEN filing_type = '10-K' AND {last} <> '' THEN {last} WHEN {first} <> '' THEN {first} ELSE t END"
    clean = s_single(s_camel(s_quotes(s_lines(f"({start})", X.APPLE_HEADER_LINES))))
    return f"SELECT clean AS cleaned_text, 'AAPL' AS ticker, r.date, CAST(left(r.date, 4) AS INTEGER) AS year, r.cik, r.filing_type{', ' * bool(more) + more} FROM (SELECT doc_id, {clean} AS clean FROM {joined}) c JOIN {_RAW} r USING (doc_id) WHERE {s_words('clean')} >= 50"


@query("clean_filings_apple", _apple_sql())
def clean_filings_apple(spark, d):
    return filings.clean_filings(raw_filings(spark, d, F.lit("AAPL")), "apple")


@query("clean_filings_routed")
def clean_filings_routed(spark, d):
    """Every fifth document as one of the company with a profile of its own."""
    return filings.routed_clean(raw_filings(spark, d, F.when(F.pmod("doc_id", F.lit(5)) == 0, "AAPL")))


# -- sections --------------------------------------------------------------------------------------------------------


def whole_filings(spark: SparkSession, d: str) -> DataFrame:
    part = F.transform("sections", lambda s: F.concat(F.lit("Item "), F.coalesce(s["item"], F.lit("9")), F.lit(". MANAGEMENT MARKET RISK "), F.coalesce(s["text"], F.lit(""))))
    return table(spark, d, "sectioned_filing").where("sections is not null").select("filing_no", F.concat(F.lit("Cover page. "), F.array_join(part, " ")).alias("text"))


_WHOLE = "(SELECT filing_no, 'Cover page. ' || array_to_string(list_transform(sections, lambda s: 'Item ' || coalesce(s.item, '9') || '. MANAGEMENT MARKET RISK ' || coalesce(s.text, '')), ' ') AS text FROM sectioned_filing WHERE sections IS NOT NULL)"
_H10K = r"(?:PART\s(?:I{1,3}|IV)\s+)?Item\s((?:[1-9]|1[0-6])[A-Z]?)\."


def _sections_sql(mapping: bool) -> str:
    parts = f"string_split(regexp_replace(text, '\\b({_H10K})', chr(1) || '\\1', 'g'), chr(1))"
    names = "CASE item " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in filings.SECTION_NAMES.items()) + " ELSE 'Item ' || item END"
    rows = f"(SELECT filing_no, unnest({parts}) AS part, generate_subscripts({parts}, 1) - 1 AS pos FROM {_WHOLE})"
    cut = f"(SELECT filing_no, pos, {s_strip('part')} AS part FROM {rows})"
    named = f"(SELECT filing_no, pos, part, nullif(regexp_extract(part, '^{_H10K}', 1), '') AS item FROM {cut} WHERE part <> '')"
    out = (
        f"SELECT filing_no AS id, CAST(pos AS INTEGER) AS pos, coalesce(item, 'PREFACE') AS item, CASE WHEN item IS NULL THEN 'Preface or Miscellaneous' ELSE {names} END AS section, "
        f"CASE WHEN item IS NULL THEN part ELSE regexp_replace(regexp_replace(part, '^{_H10K}', ''), '^{SPACE}+', '') END AS text FROM {named}"
    )
    if mapping:
        return f"SELECT * FROM ({out}) QUALIFY row_number() OVER (PARTITION BY id, item ORDER BY pos DESC) = 1"
    return f"SELECT * FROM ({out}) WHERE length(text) > 500"


@query("sections_10k", _sections_sql(False))
def sections_10k(spark, d):
    return filings.sections_10k(whole_filings(spark, d), "filing_no", "text")


@query("sections_10k_map", _sections_sql(True))
def sections_10k_map(spark, d):
    return filings.sections_10k(whole_filings(spark, d), "filing_no", "text", as_mapping=True)


def _sections_10q_sql() -> str:
    parts = "string_split(regexp_replace(text, '(?i)(ITEM\\s+\\d+[A-Z]?\\.)', chr(1) || '\\1', 'g'), chr(1))"
    rows = f"(SELECT filing_no, unnest({parts}) AS part, generate_subscripts({parts}, 1) - 1 AS pos FROM {_WHOLE})"
    cut = f"(SELECT filing_no, pos, upper(regexp_extract(part, '(?i)^ITEM\\s+(\\d+[A-Z]?)\\.', 1)) AS item, regexp_replace(part, '(?i)^ITEM\\s+\\d+[A-Z]?\\.', '') AS rest FROM {rows} WHERE regexp_matches(part, '(?i)^ITEM\\s+\\d+[A-Z]?\\.'))"
    name = "CASE " + " ".join(f"WHEN item = '{n}' AND contains(upper(left(rest, 120)), '{w}') THEN '{s}'" for n, w, s in filings.TARGETS_10Q) + " END"
    out = f"SELECT filing_no AS id, CAST(pos AS INTEGER) AS pos, item, {name} AS section, {s_strip('rest')} AS text FROM {cut}"
    return f"SELECT * FROM ({out}) WHERE section IS NOT NULL AND length(text) >= 500 AND length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) < 0.4"


@query("sections_10q", _sections_10q_sql())
def sections_10q(spark, d):
    return filings.sections_10q(whole_filings(spark, d), "filing_no", "text")


@query("flat_metadata", "SELECT filing_no, metadata.ticker AS m_ticker, metadata.date AS m_date, metadata.cik AS m_cik, metadata.year AS m_year, metadata.filing_type AS m_filing_type FROM sectioned_filing")
def flat_metadata(spark, d):
    return filings.flat_metadata(table(spark, d, "sectioned_filing")).select("filing_no", "m_ticker", "m_date", "m_cik", "m_year", "m_filing_type")


@query("keep_last_document", "SELECT metadata.ticker AS ticker, metadata.year AS year, metadata.date AS date, filing_no FROM sectioned_filing QUALIFY row_number() OVER (PARTITION BY metadata.ticker, metadata.year, metadata.date ORDER BY ingested_at DESC NULLS LAST, filing_no DESC) = 1")
def keep_last_document(spark, d):
    rows = table(spark, d, "sectioned_filing").select("metadata.ticker", "metadata.year", "metadata.date", "filing_no", "ingested_at")
    return filings.keep_last(rows, ["ticker", "year", "date"], ["ingested_at", "filing_no"]).drop("ingested_at")


@query("html_to_text", "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace('<p class=\"a\">' || coalesce(source, '') || ' &amp; more</p><script>var a = 1;</script><!-- note -->' || text, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '<[^<>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS page FROM documents")
def html_to_text(spark, d):
    html = F.concat(F.lit('<p class="a">'), F.coalesce("source", F.lit("")), F.lit(" &amp; more</p><script>var a = 1;</script><!-- note -->"), "text")
    return docs(spark, d).select("doc_id", X.html_text(html).alias("page"))


@query("url_scrub", "SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace('see https://a.example/x TABLE OF CONTENTS 1 2 3 Item 1 ' || text, 'https?://[^ \\t\\n\\f\\r\\x0B]+', '', 'g'), '(?is)UNITED STATES\\s+SECURITIES AND EXCHANGE COMMISSION.*?Washington,\\s*D\\.C\\.\\s*\\d+', '', 'g'), '(?is)TABLE OF CONTENTS.*?(Item\\s+1)', '\\1', 'g'), chr(160), ' '), '\\n+', chr(10), 'g')) AS scrubbed FROM documents")
def url_scrub(spark, d):
    return docs(spark, d).select("doc_id", X.scrubbed_filing(F.concat(F.lit("see https://a.example/x TABLE OF CONTENTS 1 2 3 Item 1 "), "text")).alias("scrubbed"))


@query("cik_extract", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(10, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS cik FROM orders")
def cik_extract(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.cik_of(F.concat(F.lit("https://a.example/data/"), "o_orderkey", F.lit("/b.htm"))).alias("cik"))


# -- chunks ----------------------------------------------------------------------------------------------------------


@query("chunk_documents")
def chunk_documents(spark, d):
    return chunking.chunked(docs(spark, d).select("doc_id", "text"), "text").drop("text")


@query("chunk_filings")
def chunk_filings(spark, d):
    return chunking.filing_chunks(table(spark, d, "sectioned_filing"))


@query("chunk_turns")
def chunk_turns(spark, d):
    return chunking.turn_chunks(transcripts.turn_table(table(spark, d, "raw_transcript")))


@query("corpus_build")
def corpus_build(spark, d):
    """Filings and turns as one chunk table with the same columns."""
    return chunking.all_chunks(chunk_filings(spark, d), chunk_turns(spark, d))


@query("chunk_metadata", "SELECT global_chunk_id, coalesce(ticker, 'UNKNOWN_TICKER') AS ticker, coalesce(cik, 'UNKNOWN_CIK') AS cik, coalesce(date, 'UNKNOWN_DATE') AS date, coalesce(item, 'UNKNOWN_ITEM') AS item, coalesce(section_name, 'UNKNOWN_SECTION') AS section_name, coalesce(CAST(year AS VARCHAR), 'UNKNOWN_YEAR') AS year FROM chunk")
def chunk_metadata(spark, d):
    return chunking.with_sentinels(table(spark, d, "chunk")).select("global_chunk_id", "ticker", "cik", "date", "item", "section_name", "year")


@query("target_semi_join", "SELECT global_chunk_id, ticker FROM chunk WHERE ticker IN (SELECT ticker FROM cik_lookup WHERE ticker IS NOT NULL)")
def target_semi_join(spark, d):
    return chunking.for_tickers(table(spark, d, "chunk").select("global_chunk_id", "ticker"), table(spark, d, "cik_lookup"))


@query("anti_seen", "SELECT DISTINCT global_chunk_id FROM chunk WHERE global_chunk_id NOT IN (SELECT payload.global_chunk_id FROM point WHERE payload.global_chunk_id IS NOT NULL)")
def anti_seen(spark, d):
    held = table(spark, d, "point").select("payload.global_chunk_id")
    return retrieval.unseen(table(spark, d, "chunk").select("global_chunk_id").distinct(), held, ["global_chunk_id"])


@query("batch_numbers", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_no, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 512) AS BIGINT) AS batch FROM documents")
def batch_numbers(spark, d):
    return chunking.batch_numbers(docs(spark, d).select("doc_id"), ["doc_id"], 512).select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), F.col("batch").cast("bigint").alias("batch"))


@query("payload_projection", "SELECT global_chunk_id, ticker, text AS chunk_text FROM chunk")
def payload_projection(spark, d):
    return readers.payload_rows(table(spark, d, "chunk")).select("global_chunk_id", "ticker", "chunk_text")


@query("corpus_rollup", "SELECT source_type, year, count(*) AS n FROM chunk GROUP BY ROLLUP (source_type, year)")
def corpus_rollup(spark, d):
    return table(spark, d, "chunk").rollup("source_type", "year").agg(F.count("*").alias("n"))


@query("run_counters", "SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source")
def run_counters(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


# -- tickers ---------------------------------------------------------------------------------------------------------


@query("lookup_first_match", "SELECT t.ticker, lpad(CAST(min(l.cik_str) AS VARCHAR), 10, '0') AS cik FROM (SELECT DISTINCT ticker FROM documents WHERE ticker IS NOT NULL) t JOIN cik_lookup l ON lower(l.ticker) = lower(t.ticker) GROUP BY t.ticker")
def lookup_first_match(spark, d):
    return readers.with_cik(docs(spark, d).select("ticker").distinct(), table(spark, d, "cik_lookup"))


@query("lookup_missing", "SELECT DISTINCT ticker FROM documents WHERE ticker IS NOT NULL AND lower(ticker) NOT IN (SELECT lower(ticker) FROM cik_lookup WHERE ticker IS NOT NULL)")
def lookup_missing(spark, d):
    return readers.without_cik(docs(spark, d).select("ticker").where("ticker is not null").distinct(), table(spark, d, "cik_lookup"))


@query("universe_union", "SELECT DISTINCT upper(trim(ticker)) AS ticker FROM (SELECT ticker FROM documents UNION ALL SELECT ticker FROM chunk UNION ALL SELECT ticker FROM raw_transcript UNION ALL SELECT ticker FROM cik_lookup) WHERE trim(ticker) <> ''")
def universe_union(spark, d):
    return readers.universe(*(table(spark, d, t).select("ticker") for t in ("documents", "chunk", "raw_transcript", "cik_lookup")))


_HEAD = r"replace(regexp_extract({0}, '^\s*((?:\d{{4}}-\d{{1,2}}-\d{{1,2}})|(?:\d{{8}})|(?:\d{{1,2}}/\d{{1,2}}/\d{{4}})|(?:\d{{4}}/\d{{1,2}}/\d{{1,2}})|(?:\d{{1,2}} [A-Za-z]+ \d{{4}})|(?:[A-Za-z]+\.? \d{{1,2}}, \d{{4}}))', 1), '.', '')"


def s_date(x: str) -> str:
    h = _HEAD.format(x)
    return "coalesce(" + ", ".join(f"try_strptime({h}, '{f}')" for f in ("%Y-%m-%d", "%Y%m%d", "%m/%d/%Y", "%d %b %Y", "%b %d, %Y", "%B %d, %Y", "%Y/%m/%d", "%d/%m/%Y", "%d %B %Y")) + ")"


@query("year_quarter", f"SELECT df_index, coalesce(nullif(regexp_extract(q, '^(\\d{{4}})-(Q[1-4])', 1), ''), CAST(year({s_date('date')}) AS VARCHAR)) AS year, coalesce(nullif(regexp_extract(q, '^(\\d{{4}})-(Q[1-4])', 2), ''), 'Q' || CAST(quarter({s_date('date')}) AS VARCHAR)) AS quarter FROM raw_transcript")
def year_quarter(spark, d):
    year, quarter = X.quarter_fields(F.col("q"), F.col("date"))
    return table(spark, d, "raw_transcript").select("df_index", year.alias("year"), quarter.alias("quarter"))


@query("calendar_quarter", f"SELECT global_chunk_id, CAST(quarter({s_date('date')}) AS INTEGER) AS quarter FROM chunk")
def calendar_quarter(spark, d):
    return table(spark, d, "chunk").select("global_chunk_id", X.calendar_quarter(F.col("date")).alias("quarter"))


@query("exchange_norm", "SELECT df_index, upper(trim(split_part(exchange, ':', 1))) AS exchange FROM raw_transcript")
def exchange_norm(spark, d):
    return table(spark, d, "raw_transcript").select("df_index", X.exchange_of(F.col("exchange")).alias("exchange"))


@query("file_sanitize", "SELECT df_index, regexp_replace(ticker || '/' || coalesce(exchange, '?'), '[^\\p{L}\\p{N}\\p{M}_.-]', '', 'g') AS name FROM raw_transcript")
def file_sanitize(spark, d):
    return table(spark, d, "raw_transcript").select("df_index", X.file_safe(F.concat("ticker", F.lit("/"), F.coalesce("exchange", F.lit("?")))).alias("name"))


# -- vectors ---------------------------------------------------------------------------------------------------------

_UNIT = "list_transform({0}::DOUBLE[], lambda x: x / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])))"


@query("vector_normalize", f"SELECT vec_id, round({_UNIT.format('embedding')}[1], 9) AS first, round(list_sum({_UNIT.format('embedding')}), 6) AS total FROM embeddings")
def vector_normalize(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", retrieval.unit_vector(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_SCORE = "round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _similar_sql(k: int, group: str) -> str:
    over = "round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id"
    return (
        f"SELECT q.vec_id AS query_id, {f'e.{group}, ' if group else ''}e.vec_id, {_SCORE} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id{f', e.{group}' if group else ''} ORDER BY {over}) AS INTEGER) AS rank "
        f"FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id{f', e.{group}' if group else ''} ORDER BY {over}) <= {k}"
    )


def _similar(spark: SparkSession, d: str, k: int, group: str | None) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    found = retrieval.top_similar(asked, e.select(*([group] if group else []), F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k, dim, group)
    return found.withColumnRenamed("id", "vec_id").withColumn("score", F.round("score", 6))


@query("vector_topk", _similar_sql(70, ""))
def vector_topk(spark, d):
    return _similar(spark, d, 70, None)


@query("vector_topk_per_label", _similar_sql(7, "label"))
def vector_topk_per_label(spark, d):
    return _similar(spark, d, 7, "label")


def search_side(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(a focus per ticker of the points, the points): the year and type vary with the ticker, the vector is its first point's."""
    points = retrieval.point_chunks(table(spark, d, "point"), table(spark, d, "chunk"))
    first = points.groupBy("ticker").agg(F.min_by("vector", "point_id").alias("query_vector"), F.min("point_id").alias("p")).where("ticker is not null")
    n = F.pmod(F.ascii(F.substring("ticker", 2, 1)), F.lit(4))
    kind = F.when(n == 0, "10-K").when(n == 1, "10-Q").when(n == 2, "Earnings Transcript")
    focuses = first.select(F.col("ticker").alias("focus_idx"), "ticker", (F.lit(2018) + F.pmod(F.ascii(F.substring("ticker", 3, 1)), F.lit(4))).alias("year"), F.when(n > 0, F.lit(2)).alias("quarter"), kind.alias("doc_type"), "query_vector")
    return focuses, points


def flagship(spark: SparkSession, d: str) -> DataFrame:
    focuses, points = search_side(spark, d)
    found = retrieval.retrieve(focuses, points)
    top = retrieval.reranked(found.withColumn("rerank_score", F.col("score")), "rerank_score")
    return top.select("focus_idx", "rank", "tier", "point_id", F.round("score", 6).alias("score"), "chunk_text")


_GOOD = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_POINTS = (
    f"pts AS (SELECT id AS point_id, payload.ticker AS ticker, CAST(payload.year AS INTEGER) AS year, payload.quarter AS quarter, payload.source_type AS source_type, lower(replace(payload.filing_type, '-', '')) AS filing_category, "
    f"dq AS date_quarter, {_UNIT.format('vector')} AS v, payload.chunk_text AS chunk_text FROM point LEFT JOIN "
    f"(SELECT global_chunk_id AS gid, quarter({s_date('min(date)')}) AS dq FROM chunk WHERE source_type = 'sec_filing' AND global_chunk_id IS NOT NULL GROUP BY 1) ON gid = payload.global_chunk_id WHERE vector IS NOT NULL AND {_GOOD})"
)
_FOCI = (
    "foc AS (SELECT ticker AS focus_idx, ticker, 2018 + ascii(substr(ticker, 3, 1)) % 4 AS year, CASE WHEN ascii(substr(ticker, 2, 1)) % 4 > 0 THEN 2 END AS quarter, "
    "CASE ascii(substr(ticker, 2, 1)) % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN 'Earnings Transcript' END AS doc_type, arg_min(v, point_id) AS qv FROM pts WHERE ticker IS NOT NULL GROUP BY ticker)"
)


def _match(f: str) -> str:
    return (
        f"p.ticker = {f}.ticker AND ({f}.year IS NULL OR p.year = {f}.year) AND coalesce(CASE {f}.doc_type WHEN '10-K' THEN p.source_type = 'sec_filing' AND p.filing_category = '10k' "
        f"WHEN 'Earnings Transcript' THEN p.source_type = 'earnings_transcript' AND ({f}.quarter IS NULL OR p.quarter = 'Q' || {f}.quarter) WHEN '10-Q' THEN p.source_type = 'sec_filing' AND p.filing_category = '10q' ELSE TRUE END, FALSE)"
    )


def _retrieve_sql(k: int) -> str:
    def hits(name: str, levels: str, most: int) -> str:
        return (
            f"{name} AS (SELECT * FROM (SELECT l.focus_idx, l.level, l.tier, l.doc_type, l.quarter AS fq, p.point_id, p.date_quarter, list_inner_product(l.qv, p.v) AS score, p.chunk_text FROM {levels} l JOIN pts p ON {_match('l')} "
            f"QUALIFY row_number() OVER (PARTITION BY l.focus_idx, l.level ORDER BY list_inner_product(l.qv, p.v) DESC, p.point_id) <= {most}) WHERE NOT (coalesce(doc_type, '') = '10-Q' AND fq IS NOT NULL) OR date_quarter = fq)"
        )

    relaxed = (
        "lev AS (SELECT focus_idx, ticker, qv, 0 AS level, 'Exact Match' AS tier, year, quarter, doc_type FROM foc UNION ALL SELECT focus_idx, ticker, qv, 1, 'Relaxed: No Quarter', year, NULL, doc_type FROM foc WHERE quarter IS NOT NULL "
        "UNION ALL SELECT focus_idx, ticker, qv, 2, 'Relaxed: No Year/Quarter', NULL, NULL, doc_type FROM foc WHERE year IS NOT NULL UNION ALL SELECT focus_idx, ticker, qv, 3, 'Relaxed: Ticker Only', NULL, NULL, NULL FROM foc WHERE doc_type IS NOT NULL)"
    )
    base = f"bl AS (SELECT focus_idx, min(level) AS level FROM h1 GROUP BY focus_idx), b AS (SELECT h1.* FROM h1 JOIN bl USING (focus_idx, level)), short AS (SELECT focus_idx FROM b GROUP BY focus_idx HAVING count(*) < {k}), cb AS (SELECT lev.* FROM lev JOIN bl USING (focus_idx, level) JOIN short USING (focus_idx))"
    more = (
        "lev2 AS (SELECT focus_idx, ticker, qv, 11 AS level, 'Augmented: No Quarter' AS tier, year, NULL::INTEGER AS quarter, doc_type FROM cb WHERE quarter IS NOT NULL UNION ALL SELECT focus_idx, ticker, qv, 12, 'Augmented: No Year/Quarter', NULL, NULL, doc_type FROM cb WHERE year IS NOT NULL "
        "UNION ALL SELECT focus_idx, ticker, qv, 13, 'Augmented: No Doc Type', year, quarter, NULL FROM cb WHERE doc_type IS NOT NULL)"
    )
    final = (
        f"u AS (SELECT * FROM b UNION ALL SELECT * FROM h2), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY focus_idx, point_id ORDER BY level) = 1), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY focus_idx ORDER BY level, score DESC, point_id) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY focus_idx ORDER BY level, score DESC, point_id) <= {k})"
    )
    return f"WITH {_POINTS}, {_FOCI}, {relaxed}, {hits('h1', 'lev', k)}, {base}, {more}, {hits('h2', 'lev2', 2 * k)}, {final} "


_PRIORITY = "CASE WHEN tier = 'Exact Match' THEN 0 WHEN tier LIKE 'Relaxed:%' THEN 1 WHEN tier LIKE 'Augmented:%' THEN 2 ELSE 99 END"


@query("retrieve_rerank", _retrieve_sql(70) + f"SELECT focus_idx, CAST(n AS INTEGER) AS rank, tier, point_id, round(score, 6) AS score, chunk_text FROM (SELECT *, row_number() OVER (PARTITION BY focus_idx ORDER BY {_PRIORITY}, score DESC, rank) AS n FROM r) WHERE n <= 7")
def retrieve_rerank(spark, d):
    return flagship(spark, d)


@query("relax_augment", _retrieve_sql(70) + "SELECT focus_idx, CAST(rank AS INTEGER) AS rank, tier, point_id, round(score, 6) AS score FROM r")
def relax_augment(spark, d):
    focuses, points = search_side(spark, d)
    return retrieval.retrieve(focuses, points).select("focus_idx", "rank", "tier", "point_id", F.round("score", 6).alias("score"))


@query("focus_filter", f"WITH {_POINTS}, {_FOCI} SELECT f.focus_idx, count(*) AS n FROM foc f JOIN pts p ON {_match('f')} GROUP BY f.focus_idx")
def focus_filter(spark, d):
    focuses, points = search_side(spark, d)
    f = {c: F.col(f"f_{c}") for c in ("year", "quarter", "doc_type")}
    c = {n: F.col(n) for n in ("year", "quarter", "source_type", "filing_category")}
    named = focuses.select("focus_idx", F.col("ticker").alias("f_ticker"), *(F.col(n).alias(f"f_{n}") for n in f))
    return points.join(named, (F.col("ticker") == F.col("f_ticker")) & retrieval.focus_matches(f, c)).groupBy("focus_idx").agg(F.count("*").alias("n"))


@query("tier_rerank_top7", f"SELECT focus_idx, CAST(n AS INTEGER) AS rank, global_chunk_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY focus_idx ORDER BY {_PRIORITY}, score DESC, global_chunk_id) AS n FROM (SELECT ticker AS focus_idx, global_chunk_id, max(CASE length(text) % 4 WHEN 0 THEN 'Exact Match' WHEN 1 THEN 'Relaxed: No Quarter' WHEN 2 THEN 'Augmented: No Quarter' ELSE 'other' END) AS tier, max(length(text) % 101) AS score FROM chunk WHERE ticker IS NOT NULL AND text IS NOT NULL GROUP BY ticker, global_chunk_id)) WHERE n <= 7")
def tier_rerank_top7(spark, d):
    n = F.pmod(F.length("text"), F.lit(4))
    tier = F.when(n == 0, "Exact Match").when(n == 1, "Relaxed: No Quarter").when(n == 2, "Augmented: No Quarter").otherwise("other")
    rows = table(spark, d, "chunk").where("ticker is not null and text is not null").groupBy(F.col("ticker").alias("focus_idx"), "global_chunk_id").agg(F.max(tier).alias("tier"), F.max(F.pmod(F.length("text"), F.lit(101))).alias("s"))
    return retrieval.reranked(rows.withColumn("rank", F.col("global_chunk_id")), "s").select("focus_idx", "rank", "global_chunk_id", "tier")


_CTX = "'[CHUNK ' || n || '] - Source: ' || coalesce(source_type, '') || coalesce(' (' || upper(filing_category) || ')', '') || coalesce(', Year: ' || year, '') || coalesce(', Quarter: ' || quarter, '') || chr(10) || 'Retrieval Method: Exact Match' || chr(10) || 'Content: \"\"\"' || chr(10) || coalesce(text, '') || chr(10) || '\"\"\"' || chr(10) || chr(10)"


@query("context_format", f"WITH c AS (SELECT ticker, global_chunk_id, max(text) AS text, max(source_type) AS source_type, max(filing_category) AS filing_category, max(year) AS year, max(quarter) AS quarter FROM chunk WHERE ticker IS NOT NULL GROUP BY ticker, global_chunk_id), s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY global_chunk_id) AS n FROM c QUALIFY n <= 5) SELECT ticker AS question_id, regexp_replace('CONTEXT:' || chr(10) || 'The following document chunks were retrieved as relevant to the user''s query:' || chr(10) || chr(10) || '--- Documents related to: Ticker: ' || ticker || ' ---' || chr(10) || string_agg({_CTX}, '' ORDER BY n), '[ \\t\\n\\f\\r\\x0B]+$', '') AS context FROM s GROUP BY ticker")
def context_format(spark, d):
    c = table(spark, d, "chunk").where("ticker is not null").groupBy("ticker", "global_chunk_id").agg(*(F.max(x).alias(x) for x in ("text", "source_type", "filing_category", "year", "quarter")))
    top = c.withColumn("rank", F.row_number().over(W.partitionBy("ticker").orderBy("global_chunk_id"))).where("rank <= 5")
    rows = top.select(F.col("ticker").alias("focus_idx"), "rank", F.lit("Exact Match").alias("tier"), F.col("text").alias("chunk_text"), "source_type", "filing_category", "year", "quarter")
    none = F.lit(None).cast("string")
    labels = c.select("ticker").distinct().select(F.col("ticker").alias("focus_idx"), F.col("ticker").alias("question_id"), retrieval.focus_label(F.col("ticker"), none, none, none).alias("label"))
    return retrieval.context_text(rows, labels)


# -- questions -------------------------------------------------------------------------------------------------------


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_answer").select("example_id", "user_query", "final_answer", "metadata")


@query("strip_citations", f"SELECT example_id, {s_strip("regexp_replace('[CHUNK 1] ' || final_answer || ' [CHUNK 2, 3]', '\\[CHUNK[^\\]]*\\]', '', 'g')")} AS answer FROM qa_answer")
def strip_citations(spark, d):
    return asked(spark, d).select("example_id", X.without_citations(F.concat(F.lit("[CHUNK 1] "), "final_answer", F.lit(" [CHUNK 2, 3]"))).alias("answer"))


@query("intent_normalize", "SELECT example_id, CASE example_id % 4 WHEN 0 THEN 'HYBRID' WHEN 1 THEN 'DOCUMENT_SEARCH' WHEN 2 THEN 'MARKET_DATA_ONLY' ELSE 'HYBRID' END AS intent FROM qa_answer")
def intent_normalize(spark, d):
    n = F.pmod("example_id", F.lit(4))
    said = F.when(n == 0, "it is hybrid and document_search").when(n == 1, "Document_Search!").when(n == 2, "market_data_only.").otherwise("no idea")
    return asked(spark, d).select("example_id", X.intent_of(said).alias("intent"))


@query("rule_intent", "SELECT example_id, CASE WHEN p AND NOT t THEN 'MARKET_DATA_ONLY' WHEN t AND NOT p THEN 'DOCUMENT_SEARCH' ELSE 'HYBRID' END AS intent FROM (SELECT example_id, " + " OR ".join(f"contains(lower(user_query), '{w}')" for w in X.PRICE_WORDS) + " AS p, regexp_matches(lower(user_query), '" + "|".join(w.lower() for w in questions.DOC_WORDS) + "') AS t FROM qa_answer)")
def rule_intent(spark, d):
    return asked(spark, d).select("example_id", RuleIntent().intent(F.col("user_query")).alias("intent"))


@query("price_keywords", "SELECT example_id, " + " OR ".join(f"contains(lower(user_query), '{w}')" for w in X.PRICE_WORDS) + " AS wants, " + " OR ".join(f"contains(lower(user_query), '{w}')" for w in X.MARKET_WORDS) + " AS market FROM qa_answer")
def price_keywords(spark, d):
    return asked(spark, d).select("example_id", X.asks_price(F.col("user_query")).alias("wants"), X.asks_price(F.col("user_query"), X.MARKET_WORDS).alias("market"))


@query("final_rules", "SELECT example_id, k AS doc_type, CAST(CASE WHEN k = '10-K' THEN NULL WHEN k = '10-Q' AND q = 4 THEN NULL ELSE q END AS INTEGER) AS quarter FROM (SELECT example_id, CASE example_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE 'Earnings Transcript' END AS k, example_id % 4 + 1 AS q FROM qa_answer)")
def final_rules(spark, d):
    n = F.pmod("example_id", F.lit(3))
    kind = F.when(n == 0, "10-K").when(n == 1, "10-Q").otherwise("Earnings Transcript")
    return asked(spark, d).select("example_id", kind.alias("doc_type"), questions.final_rules(kind, (F.pmod("example_id", F.lit(4)) + 1).cast("int")).alias("quarter"))


@query("entity_years", "SELECT example_id, array_to_string(regexp_extract_all(user_query, '\\b(19[7-9]\\d|20\\d{2})\\b', 1), ',') AS years FROM qa_answer")
def entity_years(spark, d):
    return asked(spark, d).select("example_id", F.array_join(questions.years_in(F.col("user_query")).cast("array<string>"), ",").alias("years"))


_QN = "CASE lower(regexp_extract(h, '(?i)^(1st|2nd|3rd|4th|first|second|third|fourth)', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in questions.ORDINALS.items()) + " ELSE regexp_extract(h, '([1-4])', 1) END"


@query("entity_quarters", f"SELECT example_id, array_to_string(list_transform(regexp_extract_all(user_query, '{questions.QUARTER}', 0), lambda h: {_QN}), ',') AS quarters FROM qa_answer")
def entity_quarters(spark, d):
    return asked(spark, d).select("example_id", F.array_join(questions.quarters_in(F.col("user_query")).cast("array<string>"), ",").alias("quarters"))


_DOCWORDS = "(?i)\\b(" + "|".join(w for w in questions.DOC_WORDS) + ")\\b"


@query("entity_doctypes", f"SELECT example_id, array_to_string(list_transform(regexp_extract_all(user_query, '{_DOCWORDS}', 1), lambda w: CASE lower(w) " + " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in questions.DOC_WORDS.items()) + " END), ',') AS kinds FROM qa_answer")
def entity_doctypes(spark, d):
    return asked(spark, d).select("example_id", F.array_join(questions.doc_types_in(F.col("user_query")), ",").alias("kinds"))


@query("entity_tickers", "SELECT DISTINCT example_id AS id, t AS ticker FROM (SELECT example_id, unnest(regexp_extract_all(ticker || ' ' || user_query, '\\b([A-Z]{1,5}(?:\\.[A-Z])?)\\b', 1)) AS t FROM qa_answer, (SELECT min(ticker) AS ticker FROM cik_lookup)) WHERE t IN (SELECT ticker FROM cik_lookup WHERE ticker IS NOT NULL)")
def entity_tickers(spark, d):
    lookup = table(spark, d, "cik_lookup")
    least = lookup.agg(F.min("ticker").alias("t"))
    rows = asked(spark, d).join(F.broadcast(least)).select("example_id", F.concat("t", F.lit(" "), "user_query").alias("q"))
    return questions.known_tickers(rows, lookup, "example_id", "q")


@query("segments", r"SELECT example_id, array_to_string(list_filter(list_transform(flatten(list_transform(regexp_split_to_array(user_query, '[.?!]'), lambda s: regexp_split_to_array(s, '(?i)\s+(?:and|or|but)\s+|,'))), lambda p: trim(p)), lambda p: p <> ''), '|') AS parts FROM qa_answer WHERE trim(user_query) <> ''")
def segments(spark, d):
    return asked(spark, d).where("trim(user_query) <> ''").select("example_id", F.array_join(questions.segments(F.col("user_query")), "|").alias("parts"))


@query("default_year", "SELECT example_id, CASE WHEN len(list_distinct(y)) = 1 THEN CAST(y[1] AS INTEGER) END AS year FROM (SELECT example_id, regexp_extract_all(user_query, '\\b(19[7-9]\\d|20\\d{2})\\b', 1) AS y FROM qa_answer)")
def default_year(spark, d):
    return asked(spark, d).select("example_id", questions.single_value(questions.years_in(F.col("user_query"))).alias("year"))


@query("canonical_names", "SELECT ticker, array_to_string(list_transform(string_split(lower(arg_min(company_name, cik_str)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM cik_lookup WHERE company_name IS NOT NULL GROUP BY ticker")
def canonical_names(spark, d):
    first = table(spark, d, "cik_lookup").where("company_name is not null").withColumn("ord", F.col("cik_str"))
    return questions.canonical_names(first)


@query("parse_questions")
def parse_questions(spark, d):
    return questions.focus_rows(questions.parsed_questions(asked(spark, d).withColumnRenamed("example_id", "question_id"), table(spark, d, "cik_lookup"), "question_id", "user_query"))


@query("focuses_from_answer")
def focuses_from_answer(spark, d):
    said = F.concat(F.lit('```json\n{"metadata": '), F.coalesce("metadata", F.lit("nothing")), F.lit("}\n```"))
    empty = F.array().cast("array<struct<ticker:string,year:int,quarter:int,doc_type:string>>")
    return asked(spark, d).select("example_id", F.explode(questions.focuses_from_answer(said, empty)).alias("f")).select("example_id", "f.*")


@query("focus_hints")
def focus_hints(spark, d):
    parsed = questions.parsed_questions(asked(spark, d), table(spark, d, "cik_lookup"), "example_id", "user_query")
    return parsed.select("question_id", questions.focus_hint(F.col("focuses")).alias("hint"))


@query("date_in_query", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_in_query(spark, d):
    n, t = F.pmod("o_orderkey", F.lit(4)), F.col("o_orderdate")
    said = F.when(n == 0, F.date_format(t, "yyyy-MM-dd")).when(n == 1, F.date_format(t, "M/d/yyyy")).when(n == 2, F.date_format(t, "MMMM d, yyyy")).otherwise(F.date_format(t, "d MMM yyyy"))
    return table(spark, d, "orders").select("o_orderkey", X.date_in_query(F.concat(F.lit("price of AAPL on "), said, F.lit("?"))).alias("day"))


@query("answer_batch")
def answer_batch(spark, d):
    """All questions through parse, search, rerank, prices and context."""
    ask = asked(spark, d).select(F.col("example_id").cast("string").alias("question_id"), F.col("user_query").alias("query"))
    points = retrieval.point_chunks(table(spark, d, "point"), table(spark, d, "chunk"))
    return answer.answered(ask, points, table(spark, d, "cik_lookup"), prices(spark, d), "2024-12-31")


# -- transcripts -----------------------------------------------------------------------------------------------------


@query("turn_sessions")
def turn_sessions(spark, d):
    return transcripts.turn_table(table(spark, d, "raw_transcript"))


@query("speaker_lines")
def speaker_lines(spark, d):
    lines = table(spark, d, "raw_transcript").select("df_index", F.posexplode(F.split("transcript", r"\R")).alias("line_no", "line"))
    return lines.select("df_index", "line_no", transcripts.speaker_of_line(F.col("line")).alias("speaker")).where("speaker is not null")


@query("speaker_split", "SELECT global_chunk_id, trim(split_part(turn_speaker_full, ' -- ', 1)) AS name, CASE WHEN trim(split_part(turn_speaker_full, ' -- ', 2)) <> '' THEN trim(split_part(turn_speaker_full, ' -- ', 2)) WHEN lower(trim(split_part(turn_speaker_full, ' -- ', 1))) IN ('operator', 'moderator', 'host') THEN trim(split_part(turn_speaker_full, ' -- ', 1)) ELSE 'N/A' END AS title FROM chunk WHERE turn_speaker_full IS NOT NULL")
def speaker_split(spark, d):
    who = F.col("turn_speaker_full")
    return table(spark, d, "chunk").where("turn_speaker_full is not null").select("global_chunk_id", transcripts.simple_name(who).alias("name"), transcripts.speaker_title(who).alias("title"))


@query("turn_ids", "SELECT df_index, coalesce(ticker, 'UNK') || '_' || coalesce(q, 'YYYY') || '_Q1_turn' || lpad(CAST(df_index % 1000 AS VARCHAR), 3, '0') AS turn_id FROM raw_transcript")
def turn_ids(spark, d):
    return table(spark, d, "raw_transcript").select("df_index", transcripts.turn_id(F.col("ticker"), F.col("q"), F.lit("Q1"), F.pmod("df_index", F.lit(1000)).cast("int")).alias("turn_id"))


@query("boilerplate_remove")
def boilerplate_remove(spark, d):
    return table(spark, d, "raw_transcript").select("df_index", transcripts.without_blocks(F.concat(F.lit("Thank you, operator. [Operator Instructions] "), "transcript")).alias("text"))


@query("participants")
def participants(spark, d):
    text = X.plain_punctuation(F.regexp_replace("transcript", r"\r\n?", "\n"))
    return table(spark, d, "raw_transcript").select("df_index", F.posexplode(transcripts.participants(text)).alias("i", "participant"))


@query("transcript_metadata")
def transcript_metadata(spark, d):
    year, quarter, company = transcripts.metadata_from_head(F.regexp_replace("transcript", r"\r\n?", "\n"))
    return table(spark, d, "raw_transcript").select("df_index", year.alias("year"), quarter.alias("quarter"), company.alias("company_name"))


@query("nonblank_transcripts", "SELECT df_index FROM raw_transcript WHERE trim(transcript) <> ''")
def nonblank_transcripts(spark, d):
    return readers.nonblank_transcripts(table(spark, d, "raw_transcript")).select("df_index")


# -- datasets --------------------------------------------------------------------------------------------------------


@query("ds_intent", "SELECT coalesce(user_query, '') AS user_query, CASE WHEN example_id % 2 = 0 THEN 'HYBRID' ELSE '' END AS intent FROM qa_answer")
def ds_intent(spark, d):
    return datasets.intent_rows(asked(spark, d).withColumn("routing_decision", F.when(F.pmod("example_id", F.lit(2)) == 0, "HYBRID")))


@query("ds_metadata", "SELECT coalesce(user_query, '') AS user_query, coalesce(metadata, '{}') AS metadata FROM qa_answer")
def ds_metadata(spark, d):
    return datasets.metadata_rows(asked(spark, d))


@query("ds_answer", "SELECT coalesce(user_query, '') AS user_query, coalesce(final_answer, '') AS final_answer, coalesce(metadata, '{}') AS metadata FROM qa_answer")
def ds_answer(spark, d):
    return datasets.answer_rows(asked(spark, d))


@query("ds_valid", "SELECT example_id FROM qa_answer WHERE trim(coalesce(user_query, '')) <> '' AND metadata IS NOT NULL AND json_valid(metadata)")
def ds_valid(spark, d):
    return datasets.with_query(datasets.with_metadata(asked(spark, d))).select("example_id")


@query("focus_standardize")
def focus_standardize(spark, d):
    return datasets.standardized(asked(spark, d))


@query("year_is_string", "SELECT example_id AS id, CAST(arg_min(i, i) AS INTEGER) AS focus_no, arg_min(y, i) AS year FROM (SELECT example_id, i, f ->> '$.year' AS y, json_type(f, '$.year') AS k FROM (SELECT example_id, unnest(json_extract(metadata, '$.focuses[*]')) AS f, generate_subscripts(json_extract(metadata, '$.focuses[*]'), 1) - 1 AS i FROM qa_answer WHERE metadata IS NOT NULL AND json_valid(metadata))) WHERE k = 'VARCHAR' GROUP BY example_id")
def year_is_string(spark, d):
    return datasets.textual_years(asked(spark, d))


@query("bad_json", "SELECT file_name, line_no, raw_line FROM qa_raw_line WHERE trim(raw_line) <> '' AND NOT json_valid(raw_line)")
def bad_json(spark, d):
    return datasets.invalid_lines(table(spark, d, "qa_raw_line").select("file_name", "line_no", "raw_line"))


@query("json_list_extract", "SELECT example_id, CASE WHEN json_valid(s) THEN s END AS list FROM (SELECT example_id, nullif(regexp_extract('Here you are: [' || coalesce(metadata, '1, 2') || '] done', '(?s)\\[.*\\]', 0), '') AS s FROM qa_answer)")
def json_list_extract(spark, d):
    return asked(spark, d).select("example_id", datasets.outermost_list(F.concat(F.lit("Here you are: ["), F.coalesce("metadata", F.lit("1, 2")), F.lit("] done"))).alias("list"))


@query("json_chunks")
def json_chunks(spark, d):
    rows = table(spark, d, "qa_raw_line").select(F.concat_ws("#", "file_name", "line_no").alias("line_id"), "raw_line")
    return datasets.objects_in_text(rows, "line_id", "raw_line")


def numbered(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.row_numbers(docs(spark, d).where("source is not null").select("source", "doc_id", "text"), ["doc_id"], within=["source"])
    return rows.select("source", F.col("row_no").cast("int").alias("n"), "doc_id", "text")


@query("sample_groups_tiled", "WITH n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL), g AS (SELECT source AS file, CAST(floor((n - 1) / 5) AS BIGINT) AS group_no, count(*) AS c, min(n) AS first FROM n GROUP BY ALL HAVING count(*) = 5) SELECT file, group_no, CAST(first AS INTEGER) AS first FROM g QUALIFY row_number() OVER (PARTITION BY file ORDER BY md5('42|' || file || '|' || group_no), group_no) <= 250")
def sample_groups_tiled(spark, d):
    return datasets.tiled_groups(numbered(spark, d), "source", "n").select("file", "group_no", F.get("items", F.lit(0))["n"].alias("first"))


@query("sample_groups_random")
def sample_groups_random(spark, d):
    return datasets.random_groups(numbered(spark, d), "source", "n")


@query("shuffle_seeded", "SELECT doc_id, md5('42|' || doc_id) AS shuffle_key FROM documents ORDER BY shuffle_key, doc_id")
def shuffle_seeded(spark, d):
    return datasets.shuffled(docs(spark, d).select("doc_id"), 42, "doc_id")


def _prompt_sql(template: str, q: str, a: str) -> str:
    before, rest = template.split("{q}")
    middle, after = rest.split("{a}")
    quoted = ["'" + x.replace("'", "''") + "'" for x in (before, middle, after)]
    return f"SELECT example_id, {quoted[0]} || coalesce({q}, '') || {quoted[1]} || coalesce({a}, '') || {quoted[2]} AS prompt FROM qa_answer"


@query("prompt_intent", _prompt_sql(datasets.INTENT_PROMPT, "user_query", "CAST(example_id % 3 AS VARCHAR)"))
def prompt_intent(spark, d):
    return asked(spark, d).select("example_id", datasets.prompt(datasets.INTENT_PROMPT, F.col("user_query"), F.pmod("example_id", F.lit(3)).cast("string")).alias("prompt"))


@query("prompt_metadata", _prompt_sql(datasets.METADATA_PROMPT, "user_query", "metadata"))
def prompt_metadata(spark, d):
    return asked(spark, d).select("example_id", datasets.prompt(datasets.METADATA_PROMPT, F.col("user_query"), F.col("metadata")).alias("prompt"))


@query("prompt_answer", _prompt_sql(datasets.ANSWER_PROMPT, "user_query", "final_answer"))
def prompt_answer(spark, d):
    return asked(spark, d).select("example_id", datasets.prompt(datasets.ANSWER_PROMPT, F.col("user_query"), F.col("final_answer")).alias("prompt"))


@query("group_context")
def group_context(spark, d):
    """The JSON of each sampled group of chunks, as it stands in the instruction."""
    return datasets.tiled_groups(numbered(spark, d), "source", "n").select("file", "group_no", F.to_json("items").alias("context"))


@query("prompt_synthesis")
def prompt_synthesis(spark, d):
    return datasets.tiled_groups(numbered(spark, d), "source", "n").select("file", "group_no", datasets.synthesis_prompt(F.col("items")).alias("prompt"))


@query("generate_examples")
def generate_examples(spark, d):
    """Examples from every group, with a fixed answer in place of a model's."""
    said = 'Sure: [{"user_query": "q {n}", "final_response": "r"}, 5, {"user_query": "again"}] as asked'
    made = datasets.generated_examples(datasets.tiled_groups(numbered(spark, d), "source", "n"), FixedCompleter(said))
    return made.select("file", "group_no", "example_no", F.get_json_object("example", "$.user_query").alias("user_query"))


@query("refine_focuses", "SELECT example_id, 'XMODJ' AS ticker, 2020 AS year FROM qa_answer")
def refine_focuses(spark, d):
    """A model's focuses in place of the rules'."""
    model = ModelRefiner(FixedCompleter('```json\n{"metadata": {"focuses": [{"ticker": "XMODJ", "year": "2020"}]}}\n```'))
    empty = F.array().cast("array<struct<ticker:string,year:int,quarter:int,doc_type:string>>")
    rows = asked(spark, d).select("example_id", F.explode(model.refine(F.col("user_query"), empty)).alias("f"))
    return rows.select("example_id", "f.ticker", "f.year")


@query("flat_groups", "SELECT source AS file, CAST(g AS INTEGER) AS group_no FROM (SELECT source, unnest(range(0, count(*) // 5)) AS g FROM documents WHERE source IS NOT NULL GROUP BY source)")
def flat_groups(spark, d):
    """Groups of a file each, flattened to one row a group."""
    cut = numbered(spark, d).select(F.col("source").alias("file"), F.floor((F.col("n") - 1) / 5).alias("g")).groupBy("file", "g").count().where("count = 5")
    files = cut.groupBy("file").agg(F.sort_array(F.collect_list("g")).alias("groups"))
    return datasets.flattened_groups(files).select("file", "group_no")


# -- prices ----------------------------------------------------------------------------------------------------------


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("ticker"), "ts", F.col("value").alias("close"))


def asks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("ticker"), F.date_add(F.to_date("ts"), F.pmod("event_id", F.lit(9)).cast("int")).alias("day")).withColumnRenamed("event_id", "ask_id")


_DAILY = "daily AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS day, arg_max(value, {'t': ts, 'v': value}) AS close FROM events GROUP BY ALL)"
_ASKS = "asks AS (SELECT event_id AS ask_id, CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) + CAST(event_id % 9 AS INTEGER) AS day FROM events)"


@query("price_point", f"WITH {_DAILY}, {_ASKS} SELECT ask_id, ticker, CAST(day AS DATE) AS day, close FROM asks LEFT JOIN daily USING (ticker, day)")
def price_point(spark, d):
    return market.price_on_day(asks(spark, d), prices(spark, d))


@query("price_asof", f"WITH {_DAILY}, {_ASKS} SELECT a.ask_id, a.ticker, CAST(a.day AS DATE) AS day, p.close FROM asks a ASOF LEFT JOIN daily p ON a.ticker = p.ticker AND a.day >= p.day")
def price_asof(spark, d):
    return market.price_as_of(asks(spark, d), prices(spark, d))


@query("price_chunk", f"WITH {_DAILY}, {_ASKS} SELECT a.ask_id, 'Close price on ' || CAST(CAST(a.day AS DATE) AS VARCHAR) || ': $' || format('{{:,.2f}}', p.close) || '. Dividend per share (TTM): $0.00.' AS chunk_text FROM asks a ASOF JOIN daily p ON a.ticker = p.ticker AND a.day >= p.day WHERE p.close IS NOT NULL")
def price_chunk(spark, d):
    return market.price_chunks(market.price_as_of(asks(spark, d), prices(spark, d))).select("ask_id", "chunk_text")


@query("market_answer")
def market_answer(spark, d):
    return market.market_answer(market.price_on_day(asks(spark, d), prices(spark, d)))


# -- drifting layouts ------------------------------------------------------------------------------------------------


@query("p4_found")
def p4_found(spark, d):
    return drift.file_changes(drift.file_schemas(table(spark, d, "qa_raw_line"))).select("file_name", "change_type", "old_field", "new_field")


@query("p4_schemas")
def p4_schemas(spark, d):
    return drift.file_schemas(table(spark, d, "qa_raw_line")).select("stream_name", "file_name", "field", "type", "n_type", "n_carry", "n_records")


@query("p4_focuses")
def p4_focuses(spark, d):
    return drift.standard_focuses(table(spark, d, "qa_raw_line"))
