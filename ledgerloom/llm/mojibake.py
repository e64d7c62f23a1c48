"""Text decoded with the wrong character encoding: found and repaired by a table of garbled forms of clean words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staged

#: Encodings that UTF-8 bytes are commonly decoded with by mistake.
CODECS = ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "cp1254", "iso8859-15", "cp866", "koi8-r", "gbk", "big5", "shift_jis", "euc_kr"]
#: Encodings that are tried a second and third time over.
AGAIN = ["cp1252", "latin-1", "mac_roman", "cp1251"]

#: A garbled no-break space whose second half has become a plain blank; in Cyrillic only after an ASCII word, as the letter is a word too.
STRAY = r"(?:(?:(?<=Â)|(?<=[A-Za-z0-9]В)) )"
#: A word with a character outside ASCII, and a run of such characters alone; both with the blank of such a no-break space.
# a word begins where no letter or digit stands before it, and gives nothing back, so that plain words are passed over at once
WORD = rf"(?<![A-Za-z0-9])[A-Za-z0-9]*+(?:[^\x00-\x7F]++[A-Za-z0-9]*+)++{STRAY}?"
RUN = rf"[^\x00-\x7F]++{STRAY}?"


def decoded(data: bytes, codec: str, undefined: str) -> str:
    """``data`` in ``codec``; bytes without a meaning there are kept as control characters or dropped."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        pass
    if undefined == "drop":
        return data.decode(codec, "ignore")
    if codec in ("gbk", "big5", "shift_jis", "euc_kr"):
        return data.decode(codec, "replace")
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data)


def garbled_forms(word: str) -> set[tuple[str, str]]:
    """(form, chain) of ``word`` under every chain of encodings, and with its characters or bytes replaced by U+FFFD."""
    out = {("".join("�" if ord(c) > 127 else c for c in word), "lost characters"), ("".join("�" * len(c.encode()) if ord(c) > 127 else c for c in word), "lost bytes")}
    for a in CODECS:
        for undefined in ("keep", "drop"):
            once = decoded(word.encode(), a, undefined)
            chain = a + (", dropped" if undefined == "drop" and once != decoded(word.encode(), a, "keep") else "")
            out.add((once, chain))
            if a in AGAIN:
                for b in AGAIN:
                    twice = decoded(once.encode("utf-8", "replace"), b, undefined)
                    out.add((twice, f"{chain} > {b}"))
                    for c in AGAIN:
                        out.add((decoded(twice.encode("utf-8", "replace"), c, undefined), f"{chain} > {b} > {c}"))
    return {(form, chain) for form, chain in out if form != word and form.strip() and any(ord(c) > 127 for c in form)}


def undone(word: str) -> str | None:
    """``word`` with one decoding undone if its bytes in some encoding are valid UTF-8 of several bytes, else None."""
    for codec in CODECS:
        data = bytearray()
        try:
            for c in word:
                if codec in ("cp1252", "cp1251", "cp1250", "cp1254") and 0x80 <= ord(c) < 0xA0:
                    data.append(ord(c))
                else:
                    data += c.encode(codec)
            back = data.decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if back != word and len(back) < len(data):
            return back
    return None


def unstrayed(word: str) -> str | None:
    """``word`` that ends in a stray half of a no-break space with the no-break space back, else None."""
    if not word.endswith(" "):
        return None
    back = word[:-1] + "\u00a0"
    if (whole := undone(back)) is not None:
        return whole
    # what stands before it is garbled in another way or not at all
    return (undone(word[:-2]) or word[:-2]) + "\u00a0"


def _script(c: str) -> str:
    """The script of a letter by the first word of its name; Japanese is written in several that go together."""
    name = unicodedata.name(c, "?").split()[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "CJK", "KATAKANA-HIRAGANA") else name


def _usual(text: str) -> bool:
    """Whether a text holds letters of one script besides ASCII, and signs that texts hold: no controls, no private or unassigned characters."""
    if any(unicodedata.category(c) in ("Cc", "Co", "Cn", "Cs", "Sk") or _script(c) == "MODIFIER" for c in text if ord(c) > 127):
        return False
    scripts = {_script(c) for c in text if ord(c) > 127 and unicodedata.category(c)[0] == "L"}
    return len(scripts) <= 1 or scripts <= {"LATIN", "MASCULINE", "FEMININE"}


def repairs(words: DataFrame) -> DataFrame:
    """(word, original, chain) of the damaged ones of distinct ``words`` (word, n); ``original`` is null where it is lost.

    A word is clean if it holds neither U+FFFD nor a C1 control nor half a no-break space before a blank, and no encoding turns its
    bytes into valid UTF-8. The garbled
    forms of every clean word, and of each run of non-ASCII characters in it, make a table keyed by the form; words
    of the corpus are joined with it, first as a whole, then run by run. Of several originals the most frequent is taken;
    forms that lost bytes or characters count only as whole words or runs of two characters, and a lost character only
    if it has one possible original. What matches no clean word but undoes to usual characters is repaired that way.
    """

    def sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = b.word.map(lambda w: "�" in w or any(0x80 <= ord(c) < 0xA0 for c in w) or w.endswith(" ") or undone(w) is not None)
            runs = b.word.str.findall(RUN)
            bad |= runs.map(lambda r: any(undone(x) is not None for x in r))
            yield pd.DataFrame({"word": b.word, "n": b.n, "clean": ~bad})

    sorted_out = staged(words.mapInPandas(sort_out, "word string, n long, clean boolean"), "words")
    clean = sorted_out.where("clean").select("word", "n")
    pieces = clean.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    originals = clean.withColumn("whole", F.lit(True)).unionByName(pieces.withColumn("whole", F.lit(False)))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for word, n, whole in zip(b.word, b.n, b.whole, strict=True):
                for form, chain in garbled_forms(word):
                    lossy = "lost" in chain or "dropped" in chain
                    if not lossy or (len(form) > 1 and (whole or "lost" not in chain)):
                        rows.append((form, word, n, chain, lossy))
            yield pd.DataFrame(rows, columns=["form", "original", "n", "chain", "lossy"])

    forms = originals.mapInPandas(spell, "form string, original string, n long, chain string, lossy boolean")
    # only forms that occur matter, as whole words or as runs
    seen_runs = sorted_out.select("word", F.posexplode(F.regexp_extract_all("word", F.lit(RUN), F.lit(0))).alias("i", "run"))
    seen = sorted_out.select(F.col("word").alias("form")).unionByName(seen_runs.select(F.col("run").alias("form"))).distinct()
    table = forms.join(seen, "form", "left_semi").groupBy("form", "original").agg(F.min("lossy").alias("lossy"), F.max("n").alias("n"), F.min("chain").alias("chain"))
    # a form's originals are never gathered: their least and their number are aggregates, taken before the shuffle
    best = table.groupBy("form").agg(F.min(F.struct("lossy", (-F.col("n")).alias("m"), "original", "chain")).alias("x"), F.count("*").alias("many"))
    table = best.select("form", "x.original", (-F.col("x.m")).alias("n"), "x.chain", "many")
    # a clean word that happens to be a form of a rarer one stays as it is
    counts = sorted_out.where("clean").select(F.col("word").alias("form"), F.col("n").alias("own"))
    table = table.where("not (chain like 'lost%' and many > 1)").join(counts, "form", "left").where("own is null or n > 3 * own")
    table = staged(table.select("form", "original", "chain"), "forms")
    whole = sorted_out.join(table.withColumnRenamed("form", "word"), "word", "left")
    open_words = whole.where("original is null").select("word", "clean")
    by_run = seen_runs.join(open_words, "word").join(table.select(F.col("form").alias("run"), F.col("original").alias("fixed"), "chain"), "run", "left")

    def undo(runs: pd.Series) -> pd.Series:
        def one(r: str) -> str | None:
            back = unstrayed(r) or r
            while (nxt := undone(back)) is not None:
                back = nxt
            return back if back != r and _usual(back) else None

        return runs.map(one)

    by_run = by_run.withColumn("fixed", F.coalesce("fixed", F.when(~F.col("clean"), F.pandas_udf(undo, "string")("run"))))
    lost = F.col("fixed").isNull() & (F.col("run").contains("�") | F.col("run").rlike(r"[\x{80}-\x{9F}]"))
    together = by_run.groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("i", "run", "fixed"))).alias("t"), F.max(F.col("fixed").isNotNull()).alias("any"), F.max(lost).alias("lost"), F.min("chain").alias("chain")
    ).where("any or lost")
    # the word's ASCII parts stand between its runs
    ascii_parts = F.split("word", RUN, -1)
    rebuilt = F.concat(F.array_join(F.transform("t", lambda x: F.concat(F.get(ascii_parts, x["i"]), F.coalesce(x["fixed"], x["run"]))), ""), F.element_at(ascii_parts, -1))
    partly = together.select("word", F.when(F.col("any"), rebuilt).alias("original"), F.coalesce("chain", F.lit("undone")).alias("chain"), "lost")
    return whole.where("original is not null").select("word", "original", "chain", F.lit(False).alias("lost")).unionByName(partly)


def repaired(docs: DataFrame, id_col: str = "df_index", text_col: str = "transcript") -> DataFrame:
    """(id, text, n_repaired, n_lost) of every row: the text with damaged words replaced by their originals.

    ``n_repaired`` counts replaced words, ``n_lost`` words with characters that can't be recovered (they stay as they are).
    Null texts stay null with zero counts; undamaged texts come out unchanged; each of several equal rows comes out. A row is known by
    a 128-bit hash of its text, which is the same however often Spark computes it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k"), F.xxhash64(F.lit(1), text_col).alias("l"))
    found = rows.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    fixes = small_side(staged(repairs(found.groupBy("word").agg(F.count("*").alias("n"))), "repairs"))
    words = rows.select("k", "l", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("i", "word"))
    # places keep the words of equal texts from counting twice
    hits = words.join(fixes, "word").groupBy("k", "l").agg(F.collect_set(F.struct("i", "word", "original", "lost")).alias("h"))
    hits = hits.select(
        "k", "l", F.map_from_entries(F.array_distinct(F.transform("h", lambda x: F.struct(x["word"], F.coalesce(x["original"], x["word"]))))).alias("fixes"),
        F.size(F.filter("h", lambda x: x["original"].isNotNull())).cast("long").alias("n_repaired"), F.size(F.filter("h", lambda x: x["lost"])).cast("long").alias("n_lost"),
    )
    joined = rows.join(hits, ["k", "l"], "left")
    between, damaged = F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    zipped = F.arrays_zip(between.alias("a"), damaged.alias("w"))
    text = F.when(F.col("fixes").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(zipped, lambda x: F.concat(x["a"], F.coalesce(F.element_at("fixes", x["w"]), x["w"], F.lit("")))), "")
    )
    return joined.select("id", text.alias("text"), F.coalesce("n_repaired", F.lit(0)).alias("n_repaired"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"))
