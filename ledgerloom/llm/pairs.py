"""Defective prompt and response pairs: empty, copied, refused, truncated, or in another language than the prompt."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import components

# Frequent function words by language; words shared by several languages are left out of all but one or none.
FUNCTION_WORDS = {
    "en": "the and of to for with from which that is was were are by at our we in it on an as not than because after before against what how why does did list who when where",
    "de": "der die das und von für mit auf nicht im dem den des ein eine einer wurden wurde ist sich aus bei nach zum zur über weil während welche wie hat warum wir ging noch um bleibt",
    "fr": "le les et des du est une dans pour sur avec au aux par qui que nous son sa été ont pourquoi quels comment reste toujours cours à cause selon l d",
    "es": "el los ingresos riesgos bajó y del las por con una para que hasta su sus según qué cómo hemos sigue siendo un gracias continúa cayó más mientras aumento año",
    "it": "il di gli della del dei nel nella è sono che con alla delle rispetto abbiamo grazie fino una secondo anno dello dal scesa sceso ricavi margine",
    "pt": "o os da do dos das em no na com ao pela pelo uma foram até não que para devido aumento ano segundo receita margem caiu temos",
    "nl": "het een van de en niet zijn met voor naar bij ook werd maar dat deze onze wij",
}
# Strings that stand for a missing answer, lower case.
PLACEHOLDERS = "none null nil nan n/a na n.a. tbd tba todo pending undefined unknown missing empty blank placeholder answer response".split()
# Fixed patterns: the writer speaks of itself; the writer can't or won't.
SELF = r"\b(i|i'm|i'd|i've|i'll|me|my|this service|this assistant|as an assistant|as an ai|this model)\b"
UNWILLING = (
    r"(cannot|can't|can not|could not|couldn't|won't|will not|unable|not able|declin|refus|have to pass|must pass|rather not|do not have|don't have|do not give|don't give|"
    r"not a question i can|off limits|against my|not be appropriate|outside what i|say nothing on|no answer can|not in a position|not comfortable|not permitted|not allowed)"
)
# Fixed patterns: the same two in the other languages of FUNCTION_WORDS, each pair for itself.
DECLINING = [
    (SELF, UNWILLING),
    (r"(?U)\b(ich|mir|mich|mein|meine|meiner|meinem|meinen)\b", r"(?U)\b(kann|könnte|möchte|darf|will|werde|bin|ist es mir)\b[^.!?]{0,80}\b(nicht|keine|kein|keinen|außerstande)\b|\b(muss|lehne)\b[^.!?]{0,60}\b(passen|ablehnen|ab)\b"),
    (r"(?U)\b(je|j'ai|me|m'est|moi|mon|ma)\b", r"(?U)\b(ne|n'ai|n'est|n'arrive)\b[^.!?]{0,30}\b(peux|puis|pourrai|souhaite|dispose|suis|possible|permis|mesure)\b|\b(refuse|regret de ne)\b"),
    (r"(?U)\b(yo|me|mi|mis|puedo|podría|lamento|siento)\b", r"(?U)\bno\b[^.!?]{0,20}\b(puedo|podría|quiero|dispongo|tengo|es posible|estoy)\b"),
    (r"(?U)\b(io|mi|mio|mia|posso|potrei|dispongo)\b", r"(?U)\bnon\b[^.!?]{0,20}\b(posso|potrei|voglio|dispongo|è possibile|sono in grado)\b"),
    (r"(?U)\b(eu|me|meu|minha|posso|poderia|lamento)\b", r"(?U)\bnão\b[^.!?]{0,20}\b(posso|poderia|quero|disponho|é possível|consigo|estou)\b"),
    (r"(?U)\b(ik|mij|me|mijn)\b", r"(?U)\b(kan|mag|wil|zal|ben)\b[^.!?]{0,60}\b(niet|geen)\b"),
]
#: Any of the first patterns: few answers speak of the writer, and only those are looked at further.
SPEAKING = "(?U)" + "|".join(me.replace("(?U)", "") for me, _ in DECLINING)
ENDINGS = r"""[.!?。！？…]["”’'»)\]]*$|[)\]"”»]$"""


def ends_whole(text: Column) -> Column:
    """Whether a text ends in a stop, quotes and brackets after it left aside, or in a closing bracket or quote."""
    last = F.right(F.rtrim(text, F.lit("\"”’'»)]")), F.lit(1))
    return last.isin(*".!?。！？…") | F.right(text, F.lit(1)).isin(*")]\"”»")


def language(text: Column) -> Column:
    """Language code of a text from its scripts or at least two different function words, null where neither tells."""
    # the words are computed once and looked at from inside a lambda; only those that are function words somewhere are kept
    every = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.isin(*every)))
    held = F.array(F.struct(text.alias("t"), words.alias("w"), text.rlike(r"[^\x00-\x{24F}]").alias("far")))
    return F.get(F.transform(held, _language), 0)


def _language(x: Column) -> Column:
    def script(n: Column) -> Column:
        def of(chars: str) -> Column:
            return F.regexp_count(x["t"], F.lit(f"[{chars}]"))

        out = F.when(of(r"\p{IsHiragana}\p{IsKatakana}") * 10 > n, "ja").when(of(r"\p{IsHan}") * 3 > n, "zh")
        for code, name in (("ru", "Cyrillic"), ("el", "Greek"), ("ar", "Arabic"), ("he", "Hebrew"), ("ko", "Hangul"), ("hi", "Devanagari"), ("th", "Thai")):
            out = out.when(of(rf"\p{{Is{name}}}") * 2 > n, code)
        return out.otherwise(None)

    def hits(frequent: list[str]) -> Column:
        return F.size(F.filter(x["w"], lambda w: w.isin(*frequent)))

    scores = [F.struct(hits(ws.split()).alias("n"), F.lit(code).alias("code")) for code, ws in FUNCTION_WORDS.items()]
    ranked = F.array(F.slice(F.sort_array(F.array(*scores), asc=False), 1, 2))
    by_words = F.get(F.transform(ranked, lambda r: F.when((r[0]["n"] >= 2) & (r[0]["n"] > r[1]["n"]), r[0]["code"])), 0)
    # texts of Latin letters only need no look at other scripts
    far = F.when(x["far"], F.get(F.transform(F.array(F.regexp_count(x["t"], F.lit(r"\p{L}"))), script), 0))
    return F.coalesce(far, by_words)


def is_empty(answer: Column) -> Column:
    """Null, blank, or nothing but a placeholder, brackets or empty tags."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(answer), r"<[^<>]*>", ""), r"(?U)[\s\x{200B}-\x{200F}\x{2060}\x{FEFF}]+", " "))
    return answer.isNull() | ~bare.rlike(r"[\p{L}\p{N}]") | F.regexp_replace(bare, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "").isin(*PLACEHOLDERS)


def is_copy(query: Column, answer: Column) -> Column:
    """Nothing but the query, once or several times, whatever its case, punctuation, quoting or lead-in word."""

    def bare(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")

    q = bare(query)
    once = bare(answer)
    led = bare(F.regexp_replace(answer, r"""^[^\p{L}\p{N}]*\p{L}{1,15}\s?\p{L}{0,10}\s*[:\-–—]""", ""))

    def repeats(a: Column) -> Column:
        return (a != "") & (F.replace(a, q, F.lit("")) == "")

    return (q != "") & (repeats(once) | repeats(led))


def is_truncated(query: Column, answer: Column) -> Column:
    """Breaks off inside a sentence, word, number or list entry; short complete answers and lists are none."""
    a = F.trim(F.regexp_replace(answer, r"(?U)\s+$", ""))
    last = F.trim(F.regexp_extract(a, r"([^\n]*)$", 1))
    amount = r"(?:(?:about|around|nearly|roughly|approximately|over|under|some)\s+)?[$€£¥]?\s?[-(]?\d[\d.,]*\)?\s*(?:%|(?:million|billion|thousand|trillion|percent|basis points|bps|Mio\. EUR|Mrd\. EUR|EUR|USD)\b\.?)"
    entry = last.rlike(r"^(?:[-*•◦·]|\d{1,3}[.)])\s")
    entry_done = last.rlike(rf"(?i):\s*(?:{amount})$") | last.rlike(ENDINGS)
    words = F.split(a, r"\s+")
    named = F.forall(words, lambda w: w.rlike(r"^[\p{Lu}\p{N}&][\p{L}\p{N}.&'’-]*$")) & F.contains(F.lower(query), F.lower(a))
    short = (F.size(words) <= 5) & (
        a.rlike(rf"(?i)^(?:{amount}|yes|no|sí|ja|nein|oui|non|none of them|q[1-4]\s+\d{{4}}|(?:fiscal|fy)?\s?(?:19|20)\d\d|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{{4}}|\d[\d,]*)$") | named
    )
    cut_number = a.rlike(r"(?:[$€£¥]\s?\d[\d,]*\.$)|(?:(?<![\d.,])(?!(?:19|20)\d\d\.$)\d{1,3}\.$)|(?i:\b(?:Mio|Mrd)\.$)")
    unclosed = (F.length(F.regexp_replace(last, r"[^(]", "")) > F.length(F.regexp_replace(last, r"[^)]", ""))) & ~entry
    whole = F.when(entry, entry_done).when(short, True).otherwise(a.rlike(ENDINGS) & ~cut_number & ~unclosed)
    return ~whole


#: A template recurs over at least so many prompts, of which no content word stands in more than half.
PROMPTS = 5
#: A word is a template's own if it stands in so large a part of its answers.
CORE = 0.75
#: The part of a template's words that may differ from answer to answer, the query's own words left aside.
VARYING = 0.25
#: The part of a template's answers that may hold a capitalised word, a name as a rule, that isn't the template's or the query's.
NAMING = 0.1
#: Words that one sentence at least of an answer made of templates has.
SAID = 4


def _sentences(query: Column, answer: Column) -> Column:
    """The sentences of an answer as lower-case words joined by blanks; ``_`` stands for the query's own words, ``^`` before words with a capital inside a sentence.

    A topic before a colon is left out.
    """
    a = F.regexp_replace(F.regexp_replace(answer, "[’‘]", "'"), r"(?i)^\s*(?:regarding [^:]{1,60}:\s+)?", "")
    common = [w for ws in FUNCTION_WORDS.values() for w in ws.split()] + ["i", "me", "my", "this", "answer", "question"]
    # a possessive counts as its word
    asked = F.regexp_extract_all(F.regexp_replace(F.lower(query), r"['’]s\b", ""), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    asked = F.array_except(asked, F.array(*(F.lit(w) for w in common)))
    held = F.array(F.struct(asked.alias("asked"), F.split(a, r"(?<=[.!?])\s+|(?<=[。！？])").alias("s")))

    def masked(x: Column) -> Column:
        def form(w: Column, i: Column) -> Column:
            low = F.lower(w)
            return F.when(F.array_contains(x["asked"], low), F.lit("_")).when((i > 0) & w.rlike(r"^\p{Lu}") & ~w.rlike(r"^I(?:'\p{Ll}+)?$"), F.concat(F.lit("^"), low)).otherwise(low)

        return F.transform(x["s"], lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), form), " "))

    return F.filter(F.get(F.transform(held, masked), 0), lambda t: t != "")


def opening_clusters(openings: DataFrame, similarity: float = 0.5, bands: int = 12) -> DataFrame:
    """(opening, cluster): distinct openings linked by MinHash bands of two and verified by the Jaccard similarity of word pairs.

    In each band's bucket an opening is compared with the bucket's heads and linked to the first that is similar enough; one that
    is like none becomes a head itself, so none is left unresolved and a bucket never becomes all pairs. Rows come sorted by
    bucket; a task holds one bucket's heads. Linked openings then get their component's least opening as cluster.
    """

    def pairs_of(words: list[str]) -> set[tuple[str, str]]:
        return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            rows = []
            for o in b.opening:
                h = np.array([xxhash.xxh64_intdigest(" ".join(p)) for p in pairs_of(o.split())] or [0], dtype=np.uint64)
                for k in range(bands):
                    mins = [int(((h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + j + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)).min()) for j in (0, 1)]
                    rows.append((o, k, xxhash.xxh64_intdigest(repr(mins)) - (1 << 63)))
            yield pd.DataFrame(rows, columns=["opening", "band", "bucket"])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, heads, bearers = None, [], {}
        for b in batches:
            rows = []
            for band, bucket, o in zip(b.band, b.bucket, b.opening, strict=True):
                if (band, bucket) != at:
                    at, heads, bearers = (band, bucket), [], {}
                own = pairs_of(o.split())
                shared: dict[int, int] = {}
                for p in own:
                    for i in bearers.get(p, ()):
                        shared[i] = shared.get(i, 0) + 1
                first = min((i for i, n in shared.items() if n >= similarity * (len(own) + heads[i][1] - n)), default=None)
                if first is not None:
                    rows.append((o, heads[first][0]))
                    continue
                for p in own:
                    bearers.setdefault(p, []).append(len(heads))
                heads.append((o, len(own)))
            yield pd.DataFrame(rows, columns=["opening", "head"])

    signed = openings.select("opening").mapInPandas(sign, "opening string, band int, bucket long")
    buckets = signed.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "opening")
    links = staged(buckets.mapInPandas(link, "opening string, head string").where("opening <> head").distinct(), "links")
    parts = components(links, "opening", "head").select(F.col("node").alias("opening"), "component")
    return openings.select("opening").join(parts, "opening", "left").select("opening", F.coalesce("component", "opening").alias("cluster"))


def templates(said: DataFrame) -> DataFrame:
    """(sentence, recurs, template) of distinct sentences in ``said`` (q, sentence): whether it recurs over unrelated prompts, and as a template.

    Sentences are clustered. A cluster recurs if it answers at least PROMPTS different prompts and no content word stands in more than half
    of them. It is a template if, the query's own words left aside, at most the part VARYING of its words differs from answer to
    answer, and at most the part NAMING of its answers holds a name of its own: whatever is asked, it says the same. Words are counted per cluster, so no cluster is gathered in one task.
    """
    counted = staged(said.groupBy("sentence", "q").agg(F.count("*").alias("n")), "said")
    forms = counted.groupBy("sentence").agg(F.sum("n").alias("n"))
    clusters = staged(opening_clusters(forms.withColumnRenamed("sentence", "opening")).withColumnRenamed("opening", "sentence").join(forms, "sentence"), "clusters")
    prompts = counted.join(clusters.select("sentence", "cluster"), "sentence").select("cluster", "q").distinct()
    frequent = [w for ws in FUNCTION_WORDS.values() for w in ws.split()]
    content = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower("q"), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))), F.array(*(F.lit(w) for w in frequent)))
    shared = prompts.select("cluster", F.explode(content).alias("w")).groupBy("cluster", "w").count().groupBy("cluster").agg(F.max("count").alias("most"))
    asked = prompts.groupBy("cluster").agg(F.count("*").alias("prompts")).join(shared, "cluster", "left")
    recurring = asked.where((F.col("prompts") >= PROMPTS) & (F.coalesce("most", F.lit(0)) * 2 <= F.col("prompts"))).select("cluster")
    clusters = staged(clusters.join(recurring, "cluster", "left_semi"), "recurring")
    words = clusters.select("cluster", "n", F.explode(F.split("sentence", " ")).alias("w"), "sentence").where("w <> '_'")
    size = clusters.groupBy("cluster").agg(F.sum("n").alias("size"))
    # repeated words of a sentence count once for the core and each for its share
    core = words.dropDuplicates(["sentence", "w"]).groupBy("cluster", "w").agg(F.sum("n").alias("held")).join(size, "cluster").where(F.col("held") >= F.lit(CORE) * F.col("size")).select("cluster", "w", F.lit(1).alias("core"))
    other = words.join(core, ["cluster", "w"], "left").withColumn("varies", F.col("core").isNull()).groupBy("cluster", "sentence").agg(
        F.first("n").alias("n"), F.count("*").alias("words"), F.sum(F.col("varies").cast("int")).alias("varying"), F.max((F.col("varies") & F.col("w").startswith("^")).cast("int")).alias("names")
    )
    same = other.groupBy("cluster").agg(
        ((F.sum(F.col("n") * F.col("varying")) <= VARYING * F.sum(F.col("n") * F.col("words"))) & (F.sum(F.col("n") * F.col("names")) <= NAMING * F.sum("n"))).alias("template")
    )
    return clusters.join(same, "cluster", "left").select("sentence", F.lit(True).alias("recurs"), F.coalesce("template", F.lit(False)).alias("template"))


def defects(answers: DataFrame, id_col: str = "example_id", query_col: str = "user_query", answer_col: str = "final_answer") -> DataFrame:
    """(id, defect): at most one defect of each row, in the order empty, copy, refusal, other_language, truncated.

    Refusals: the sentences of answers without any figure are clustered, and clusters that recur over unrelated prompts tell templates from
    sentences that vary with what is asked. An answer of whole sentences that are all templates is a refusal, in whatever words; one
    with a recurring sentence that varies is none, in whatever words. Where nothing recurs, cues of the writer speaking of
    itself and of not answering decide. A null query leaves the checks that need none. Repeated rows are judged each; rows with a
    null id are kept; other columns are ignored.
    """
    rows = answers.select(F.col(id_col).alias("id"), F.col(query_col).cast("string").alias("q"), F.col(answer_col).cast("string").alias("a"))
    q = F.coalesce("q", F.lit(""))
    rows = rows.withColumn("empty", is_empty(F.col("a")))
    plain = ~F.col("empty") & ~F.col("a").rlike(r"\p{N}") & F.rtrim("a").rlike(r"""[.!?。！？]["”’'»)\]]*$""")
    keyed = rows.where(plain & (q != "")).select(F.xxhash64("q", "a").alias("k"), F.xxhash64("a", F.lit(1), "q").alias("l"), "q", F.explode(_sentences(q, F.col("a"))).alias("sentence"))
    said = staged(keyed, "sentences")
    known = templates(said.select("q", "sentence"))
    long = F.size(F.split("sentence", " ")) >= SAID
    judged = said.join(known, "sentence", "left").groupBy("k", "l").agg(
        (F.min(F.coalesce("template", F.lit(False))) & F.max(F.coalesce("template", F.lit(False)) & long)).alias("template"), F.max(F.coalesce("recurs", F.lit(False)) & ~F.coalesce("template", F.lit(False))).alias("varies")
    )
    judged = staged(judged, "judged").where("template or varies")
    rows = rows.withColumn("k", F.xxhash64("q", "a")).withColumn("l", F.xxhash64("a", F.lit(1), "q")).join(judged, ["k", "l"], "left")
    lower = F.lower(F.regexp_replace(F.col("a"), "[’‘]", "'"))
    # the first two sentences
    head = F.array_join(F.slice(F.split(lower, r"(?<=[.!?])\s+", 3), 1, 2), " ")
    declines = F.get(F.transform(F.array(head), lambda h: h.rlike(SPEAKING) & reduce(or_, (h.rlike(me) & h.rlike(no) for me, no in DECLINING))), 0)
    cue = declines & ~F.col("a").rlike(r"[$€£]\s?\d|\d\s?%")
    refusal = F.coalesce("template", F.lit(False)) | (~F.coalesce("varies", F.lit(False)) & F.coalesce(cue, F.lit(False)))
    mine, theirs = language(q), language(F.col("a"))
    defect = (
        F.when(F.col("empty"), "empty")
        .when(is_copy(q, F.col("a")), "copy")
        .when(refusal, "refusal")
        .when((q != "") & (mine != theirs), "other_language")
        .when(is_truncated(q, F.col("a")), "truncated")
    )
    return rows.select("id", defect.alias("defect")).where("defect is not null")
