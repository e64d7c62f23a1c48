"""Per-document text statistics, their exact per-language tail probabilities, and what kind of text a document is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, small_side, staged
from .pairs import FUNCTION_WORDS, ends_whole, language

#: The statistics, with the side on which a text falls out of prose: low, high, or both.
SIDES = {
    "prose_share": "low", "common_words": "low", "mean_line_length": "low", "punctuated_lines": "low", "distinct_words": "low",
    "symbol_ratio": "high", "digit_ratio": "high", "repeated_lines": "high", "mean_word_length": "both",
}
STATS = list(SIDES)
#: Values are ranked at this many decimal places; equal ones share a rank.
PLACES = 4
#: Texts of prose that a language needs for ranks of its own; those of rarer and unknown languages are ranked among the prose of all.
OWN_RANKS = 100
#: Standard deviations above the mean score of prose from which on a text is none.
DEVIATIONS = 5.0
#: Values that at least 1/HOT_SHARE of all values equal are joined by broadcast.
HOT_SHARE = 4096

# Words counted as common beside the function words of each language.
COMMON = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split() if len(w) > 1} | set("de la un se a y e o its be has had this these or so but if i you me may with s'est she he they their".split()))

BULLET = r"^(?:[-*•◦·▪‣–]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|(?i:item)\s+\d{1,3}[A-Z]?[.:])\s"
LEADERS = r"\.{3,}\s*\d{1,4}$"
BORDER = r"^[+|][-=+|: ]{4,}$"


#: Unicode's white space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def symbols(text: Column) -> Column:
    """Characters that are neither letters, marks, digits nor white space; for ASCII a plain class says the same, faster."""
    return F.when(_ascii(text), _count(text, r"[^A-Za-z0-9\s]")).otherwise(_count(text, r"(?U)[^\p{L}\p{M}\p{N}\s]"))


def line_kind(line: Column) -> Column:
    """``prose``, ``table``, ``list`` or ``junk`` for one trimmed line."""
    low = F.lower(line)
    # words without signs at their ends, joined again so that each kind of word is counted in one pass
    plain = F.regexp_extract_all(low, F.lit(r"[a-z0-9](?:\S*[a-z0-9])?"), F.lit(0))
    tokens = F.when(_ascii(line), plain).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"), F.lit(0)))
    held = F.transform(F.array(F.struct(line.alias("s"), tokens.alias("t"))), lambda x: F.struct(x["s"], x["t"], F.concat(F.lit(" "), F.array_join(x["t"], " "), F.lit(" ")).alias("j")))
    return F.get(F.transform(held, _kind), 0)


def _kind(x: Column) -> Column:
    s, t, j = x["s"], x["t"], x["j"]
    n = F.size(t)
    length = F.length(s)
    common = F.size(F.filter(t, lambda w: w.isin(*COMMON)))
    cjk = F.when(_ascii(s), False).otherwise(_count(s, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]") * 2 > length)
    # words are parted by single blanks, so each match takes the blank before it and leaves the one after it
    words = F.when(_ascii(s), _count(j, r" [a-z][a-z'.-]*+(?= )")).otherwise(_count(j, r" \p{L}[\p{L}'’.-]*+(?= )"))
    mute = _count(j, r" [b-df-hj-np-tv-xz]{3,}+(?= )")
    odd = _count(j, r" (?=[^ ]{7})(?:(?=[^ ]*\d)(?=[^ ]*\p{L})[\p{L}\p{N}+/=_:.|-]{7,}+|[^ ]{31,}+)(?= )")
    untagged = F.when(F.contains(s, F.lit("<")), F.length(F.regexp_replace(s, r"<[^<>]*>", ""))).otherwise(length)

    def signs(sign: str, pattern: str) -> Column:
        return F.when(F.contains(s, F.lit(sign)), _count(s, pattern)).otherwise(0)

    cells = F.greatest(signs("|", r"\|"), signs("\t", r"\t"), signs(";", r";(?! \p{L})"), signs("  ", r" {2,}+"))
    flags = F.struct(
        s.alias("s"), n.alias("n"), length.alias("length"), common.alias("common"), words.alias("words"), mute.alias("mute"), odd.alias("odd"), symbols(s).alias("symbols"), untagged.alias("untagged"),
        cells.alias("cells"), cjk.alias("cjk"), ends_whole(s).alias("ended"), s.rlike(BULLET).alias("bullet"),
    )
    return F.get(F.transform(F.array(flags), _decided), 0)


def _decided(x: Column) -> Column:
    s, n, length, common, mute, symbols, cells = (x[c] for c in ("s", "n", "length", "common", "mute", "symbols", "cells"))
    junk = (symbols * 10 > length * 3) | (x["untagged"] * 2 < length) | (mute * 4 > n) | (x["odd"] * 3 > n) | (x["words"] == 0)
    prose = (common * 12 >= n) & (common >= 1) & (n >= 4) & ((length >= 38) | x["ended"]) & (symbols * 6 < length) & (mute * 6 <= n) & (length < n * 17)
    # many words in a row without any stop are no sentences
    prose = prose & ((n < 30) | s.rlike(r"[.!?…,;:]"))
    marked = F.struct(junk.alias("junk"), prose.alias("prose"))

    def kind(y: Column) -> Column:
        return (
            F.when(s.rlike(LEADERS), "list").when(s.rlike(BORDER), "table").when(x["cjk"], F.when(x["bullet"] & (length < 60), "list").otherwise("prose"))
            .when((n > 3) & (mute * 4 > n), "junk").when(y["prose"] & (length > 150) & (cells * 25 < length), "prose")
            .when((cells >= 2) | ((cells == 1) & s.rlike(r"[\t|]")), F.when(y["prose"] & (cells < 3) & ~s.rlike(r"[\t|]"), "prose").when(length > 400, "junk").when(s.rlike(r"(?U)[|;\t]\S*[|;\t]") & ~s.rlike(r"(?U)\s") & (length > 120), "junk").otherwise("table"))
            .when(x["bullet"] & (length < 120) & ~y["junk"], F.when(y["prose"] & (length >= 70) & x["ended"], "prose").otherwise("list"))
            .when(y["prose"], "prose").when(y["junk"] | (length > 120), "junk").otherwise("list")
        )

    return F.get(F.transform(F.array(marked), kind), 0)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, language, n_words, the statistics, kind, other_kind) of each row with a non-blank text; ``row`` keeps repeated rows apart.

    ``kind`` is the class of most of the document's characters, line by line: prose in any language, short entries (list), rows
    of cells (table), neither (junk); lines that repeat over and over and texts of very few different words are junk.
    ``other_kind`` is the largest class besides prose.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda s: F.trim(s, F.lit(WHITE))), lambda s: s != "")
    rows = rows.withColumn("lines", lines).where(F.size("lines") > 0)
    rows = rows.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+(?:['’.,-][\p{L}\p{N}]+)*"), F.lit(0)))
    kinds = F.transform("lines", lambda s: F.struct(line_kind(s).alias("k"), F.length(s).alias("n")))
    rows = rows.withColumn("kinds", kinds)
    n_lines, n_words, chars = F.size("lines"), F.size("words"), F.length("text")
    repeated = 1 - F.size(F.array_distinct("lines")) / n_lines
    plain = {
        "n_words": n_words.cast("double"),
        "mean_word_length": F.coalesce(F.length(F.array_join("words", "")) / F.nullif(n_words, F.lit(0)), F.lit(0.0)),
        "symbol_ratio": symbols(F.col("text")) / chars,
        "punctuated_lines": F.size(F.filter("lines", ends_whole)) / n_lines,
        "common_words": F.coalesce(F.size(F.filter("words", lambda w: w.isin(*COMMON))) / F.nullif(n_words, F.lit(0)), F.lit(0.0)),
        "digit_ratio": _count(F.col("text"), r"\p{N}") / chars,
        "mean_line_length": F.length(F.array_join("lines", "")) / n_lines,
        "repeated_lines": repeated,
        # short texts repeat no word
        "distinct_words": F.when(n_words > 30, F.size(F.array_distinct("words")) / n_words).otherwise(1.0),
    }

    def share(kind: str) -> Column:
        return F.aggregate("kinds", F.lit(0), lambda a, x: a + F.when(x["k"] == kind, x["n"]).otherwise(0))

    shares = [share(k).alias(f"c_{k}") for k in ("prose", "list", "table", "junk")]
    rows = rows.select("row", "id", F.coalesce(language(F.col("text")), F.lit("und")).alias("language"), *(F.round(v, PLACES).alias(k) for k, v in plain.items()), *shares)
    total = F.col("c_prose") + F.col("c_list") + F.col("c_table") + F.col("c_junk")
    # one entry over and over, or few words in all
    monotone = ((F.col("repeated_lines") > 0.6) & (F.col("c_table") * 2 < total)) | (F.col("distinct_words") * 5 < 1)
    other = F.when(monotone, "junk").when((F.col("c_table") >= F.col("c_list")) & (F.col("c_table") >= F.col("c_junk")), "table").when(F.col("c_list") >= F.col("c_junk"), "list").otherwise("junk")
    # of a text that is prose throughout nothing else is known
    other = F.when(~monotone & (F.col("c_prose") == total), "junk").otherwise(other)
    kind = F.when(~monotone & (F.col("c_prose") * 2 >= total), "prose").otherwise(other)
    return rows.select("row", "id", "language", "n_words", F.round(F.col("c_prose") / total, PLACES).alias("prose_share"), *(s for s in STATS if s != "prose_share"), kind.alias("kind"), other.alias("other_kind"))


def tail_probabilities(rows: DataFrame) -> DataFrame:
    """(group, stat, value, n, tail) from (group, reference, the statistics): for each value how rare it is among its group's reference rows.

    ``tail`` is the share of reference rows at or below the value (low), at or above it (high), or twice the smaller (both), the value
    itself counted in. Equal values are counted first; the distinct ones are then sorted by range partitioning over (group, stat,
    value), each partition adds up its own counts, and offsets from the partitions before it make the ranks exact over all rows.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS))).alias("x")
    counted = rows.select("group", "reference", pairs).groupBy("group", "x.stat", "x.value").agg(F.count("*").alias("n"), F.sum(F.col("reference").cast("int")).alias("refs"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written with their partition's number, so that ranges are drawn once
    ordered = staged(counted.repartitionByRange(parts, "group", "stat", "value").withColumn("part", F.spark_partition_id()), "ordered")

    within = W.partitionBy("part", "group", "stat").orderBy("value")
    local = ordered.withColumn("upto", F.sum("refs").over(within))
    sums = ordered.groupBy("group", "stat", "part").agg(F.sum("refs").alias("s"))
    before = W.partitionBy("group", "stat").orderBy("part")
    offsets = sums.withColumn("offset", F.sum("s").over(before) - F.col("s")).withColumn("all", F.sum("s").over(W.partitionBy("group", "stat")))
    joined = local.join(small_side(offsets.select("group", "stat", "part", "offset", "all")), ["group", "stat", "part"])
    low = (F.col("offset") + F.col("upto") + 1) / (F.col("all") + 1)
    high = (F.col("all") - F.col("offset") - F.col("upto") + F.col("refs") + 1) / (F.col("all") + 1)
    low, high = F.least(low, F.lit(1.0)), F.least(high, F.lit(1.0))
    side = F.create_map(*(F.lit(x) for pair in SIDES.items() for x in pair))[F.col("stat")]
    return joined.select("group", "stat", "value", "n", F.when(side == "low", low).when(side == "high", high).otherwise(F.least(2 * low, 2 * high, F.lit(1.0))).alias("tail"))


def outlier_scores(rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``: the sum over all statistics of the negative logarithm of the tail probability among the language's prose.

    Prose by its lines is what values are ranked among, so that pages of other kinds can't make themselves usual, however often
    they are repeated. Languages with fewer than OWN_RANKS such texts, and texts of unknown language, are ranked among the prose of all.
    """
    prose = F.col("kind") == "prose"
    own = rows.where(prose & (F.col("language") != "und")).groupBy("language").count().where(F.col("count") >= OWN_RANKS).select("language", F.col("language").alias("group"))
    # one row per language code, a fixed list
    placed = rows.join(F.broadcast(own), "language", "left").withColumn("group", F.coalesce("group", F.lit("all")))
    ranked = placed.select("group", (prose & (F.col("group") != "all")).alias("reference"), *STATS).unionByName(rows.where(prose).select(F.lit("all").alias("group"), F.lit(True).alias("reference"), *STATS))
    tails = staged(tail_probabilities(ranked), "tails")
    values = placed.select("row", "group", F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS))).alias("x")).select("row", "group", "x.stat", "x.value")
    keys = ["group", "stat", "value"]
    total = tails.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total and tails.count() > BROADCAST_ROWS:
        # values that many rows share go by broadcast, at most HOT_SHARE of them, the others by shuffle
        common = tails.where(F.col("n") * HOT_SHARE >= total).select(*keys, "tail")
        marked = values.join(F.broadcast(common), keys, "left")
        rest = marked.where("tail is null").drop("tail").join(tails.where(F.col("n") * HOT_SHARE < total).select(*keys, "tail"), keys)
        found = marked.where("tail is not null").select("row", "tail").unionByName(rest.select("row", "tail"))
    else:
        found = values.join(F.broadcast(tails.select(*keys, "tail")), keys).select("row", "tail")
    return rows.join(found.groupBy("row").agg(F.sum(-F.log("tail")).alias("score")), "row")


def assessed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, n_words, statistics, kind, score, outlier): every row with a non-blank text, and whether its score sets it apart from prose.

    A text is an outlier if its score lies more than DEVIATIONS standard deviations above the mean score of what is prose by its lines; its
    ``kind`` then is its largest class besides prose, else ``prose``. Null and blank texts give no row; without any prose
    to compare with, the lines decide.
    """
    rows = staged(outlier_scores(staged(measured(docs, id_col, text_col), "measured")), "scored")
    cut = rows.where("kind = 'prose'").agg(F.avg("score") + DEVIATIONS * F.coalesce(F.stddev_pop("score"), F.lit(0.0))).first()[0]
    outlier = F.col("kind") != "prose" if cut is None else F.col("score") > F.lit(cut)
    return rows.select("id", "language", "n_words", *STATS, F.when(outlier, F.col("other_kind")).otherwise("prose").alias("kind"), "score", outlier.alias("outlier"))
