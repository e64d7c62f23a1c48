"""Curating JSON examples: split, clean, cast, check, shuffle, sample, format."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prompts import SYNTHESIS

BRACKETS = re.compile(r"[{}\[\]]")
FOCUS = "struct<ticker:string,year:int,quarter:string,raw_quarter:string,normalized_doc_type:string,source_id:int,exchange:string,date:string,time:string,company_name:string>"

# The three training prompts.
INTENT_PROMPT = "### Instruction:\nClassify the following user query.\n\n### User Query:\n{q}\n\n### Classification:\n{a}"
METADATA_PROMPT = "### Instruction:\nExtract the key financial entities and document specifications from the user query into a structured JSON format.\n\n### User Query:\n{q}\n\n### Structured Metadata:\n{a}"
ANSWER_PROMPT = "### User Query:\n    {q}\n    \n    ### Final Answer:\n    {a}"

def blank_to(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def intent_rows(examples: DataFrame) -> DataFrame:
    return examples.select(blank_to(F.col("user_query")).alias("user_query"), blank_to(F.col("routing_decision")).alias("intent"))


def metadata_rows(examples: DataFrame) -> DataFrame:
    return examples.select(blank_to(F.col("user_query")).alias("user_query"), blank_to(F.col("metadata"), "{}").alias("metadata"))


def answer_rows(examples: DataFrame) -> DataFrame:
    return examples.select(blank_to(F.col("user_query")).alias("user_query"), blank_to(F.col("final_answer")).alias("final_answer"), blank_to(F.col("metadata"), "{}").alias("metadata"))


def with_query(examples: DataFrame) -> DataFrame:
    return examples.where(F.trim(F.coalesce("user_query", F.lit(""))) != "")


def with_metadata(examples: DataFrame) -> DataFrame:
    return examples.where(F.col("metadata").isNotNull() & F.coalesce(F.try_parse_json("metadata").isNotNull(), F.lit(False)))


def focus_variants(metadata: Column) -> Column:
    """The focuses of a metadata JSON as an array of JSON texts: a list, a single object, or the metadata itself."""
    v = F.try_parse_json(metadata)
    listed = F.try_variant_get(v, "$.focuses", "array<variant>")
    single = F.try_variant_get(v, "$.focuses", "map<string,variant>")
    own = F.when(F.try_variant_get(v, "$.ticker", "string").isNotNull(), F.array(F.to_json(v)))
    several = F.filter(F.transform(listed, lambda x: F.to_json(x)), lambda j: F.startswith(j, F.lit("{")))
    return F.coalesce(several, F.when(single.isNotNull(), F.array(F.get_json_object(metadata, "$.focuses"))), own, F.array().cast("array<string>"))


def quarter_code(first: Column, second: Column) -> Column:
    """``Q`` and the first digit of the first that isn't blank, lists by their first element; null without a digit.

    ``2023`` gives Q2, as the first digit counts whatever the text is; see ``quarter_is_valid``.
    """
    value = F.coalesce(F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(second), F.lit("")))
    inner = F.regexp_replace(value, r'^\[\s*"?|"?\s*(?:,.*)?\]$', "")
    digit = F.regexp_extract(inner, r"[qQ]?(\d)", 1)
    return F.when(digit != "", F.concat(F.lit("Q"), digit))


def quarter_is_valid(code: Column) -> Column:
    return code.isin("Q1", "Q2", "Q3", "Q4")


def doc_type_code(*names: Column) -> Column:
    """The first type that isn't blank in upper case, underscores as spaces."""
    first = F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))
    return F.trim(F.regexp_replace(F.upper(first), "_", " "))


def strict_int(text: Column) -> Column:
    """An integer if the whole text is one, else null; decimals aren't."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("int"))


def cleaned_focus(focus_json: Column, strict_legacy: bool = False) -> Column:
    """One focus JSON as the standard struct of ten fields, all present; ``strict_legacy`` loses type and raw quarter."""

    def g(name: str) -> Column:
        return F.get_json_object(focus_json, f"$.{name}")

    def text(name: str) -> Column:
        return F.nullif(g(name), F.lit("")).alias(name)

    none = F.lit(None).cast("string")
    return F.struct(
        text("ticker"), strict_int(g("year")).alias("year"), quarter_code(g("quarter"), g("raw_quarter")).alias("quarter"), (none if strict_legacy else F.nullif(g("raw_quarter"), F.lit(""))).alias("raw_quarter"),
        (none if strict_legacy else doc_type_code(g("normalized_doc_type"), g("source_type"), g("filing_type"), g("doc_type"))).alias("normalized_doc_type"),
        strict_int(g("source_id")).alias("source_id"), text("exchange"), text("date"), text("time"), text("company_name"),
    )


def standardized(examples: DataFrame, id_col: str = "example_id", strict_legacy: bool = False) -> DataFrame:
    """(id, user_query, focus_no, the ten fields): records with a question and readable metadata, one row per focus."""
    kept = with_query(with_metadata(examples))
    rows = kept.select(F.col(id_col).alias("id"), "user_query", F.posexplode(focus_variants(F.col("metadata"))).alias("focus_no", "j"))
    return rows.select("id", "user_query", "focus_no", cleaned_focus(F.col("j"), strict_legacy).alias("f")).select("id", "user_query", "focus_no", "f.*")


def textual_years(examples: DataFrame, id_col: str = "example_id") -> DataFrame:
    """(id, focus_no, year): of each record the first focus whose year is a JSON string."""
    rows = examples.select(F.col(id_col).alias("id"), F.posexplode(focus_variants(F.col("metadata"))).alias("focus_no", "j"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("j"), "$.year", "variant"))
    bad = rows.where(kind == "STRING")
    return bad.groupBy("id").agg(F.min_by(F.struct("focus_no", F.get_json_object("j", "$.year").alias("year")), "focus_no").alias("x")).select("id", "x.focus_no", "x.year")


def invalid_lines(lines: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """Lines that aren't blank and hold no JSON."""
    return lines.where((F.trim(line_col) != "") & F.try_parse_json(line_col).isNull())


def outermost_list(answer: Column) -> Column:
    """The text from the first ``[`` to the last ``]`` if it is JSON, else null."""
    span = F.nullif(F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.lit(""))
    return F.when(F.try_parse_json(span).isNotNull(), span)


def closings(text: str) -> dict[int, int]:
    """Where each balanced bracket of a text opens and, one past it, closes, each kind on its own; one pass with a stack for each kind."""
    open_at: dict[str, list[int]] = {"}": [], "]": []}
    kinds = {"{": "}", "[": "]"}
    out = {}
    for m in BRACKETS.finditer(text):
        sign = m[0]
        if sign in kinds:
            open_at[kinds[sign]].append(m.start())
        elif open_at[sign]:
            out[open_at[sign].pop()] = m.end()
    return out


def objects_in_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, object_no, json): the JSON objects anywhere in noisy text, also inside lists; unbalanced and unreadable parts are skipped.

    The outermost balanced stretches are read as JSON; what is inside a stretch that can't be read isn't looked at again, so each
    character is read a fixed number of times. Null texts give no row; repeated rows give theirs each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"], strict=True):
                end, n = 0, 0
                for begin, stop in sorted(closings(text or "").items()):
                    if begin < end:
                        continue
                    end = stop
                    try:
                        got = json.loads(text[begin:stop])
                    except (ValueError, RecursionError):
                        continue
                    for x in got if isinstance(got, list) else [got]:
                        if isinstance(x, dict):
                            rows.append((i, n, json.dumps(x)))
                            n += 1
            yield pd.DataFrame(rows, columns=["id", "object_no", "json"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, object_no int, json string")


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``df`` with ``shuffle_key``, sorted by it: a random order that is the same on every run with one seed."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))
    return df.withColumn("shuffle_key", key).orderBy("shuffle_key", *keys)


def joined_items(drawn: DataFrame, df: DataFrame, file_col: str, order_col: str, key: str) -> DataFrame:
    """(file, key, items): the drawn groups (file, key, numbers) with the records of their rows in order."""
    wanted = drawn.select("file", key, F.explode("numbers").alias("_n"))
    rows = df.select(F.col(file_col).alias("file"), F.col(order_col).alias("_n"), F.struct(*df.columns).alias("_row"))
    held = wanted.join(rows, ["file", "_n"]).groupBy("file", key).agg(F.sort_array(F.collect_list(F.struct("_n", "_row"))).alias("x"))
    return held.select("file", key, F.transform("x", lambda x: x["_row"]).alias("items"))


def tiled_groups(df: DataFrame, file_col: str, order_col: str, size: int = 5, per_file: int = 250, seed: int = 42) -> DataFrame:
    """(file, group_no, items): rows cut into groups of ``size`` in order, of which ``per_file`` are kept by a hash order.

    ``order_col`` numbers a file's rows from 1 without gaps, so groups need no sort; incomplete groups are dropped. The
    records are joined to the kept groups only.
    """
    groups = df.groupBy(F.col(file_col).alias("file"), F.floor((F.col(order_col) - 1) / size).alias("group_no")).agg(F.count("*").alias("n")).where(F.col("n") == size)
    hashed = groups.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), "file", "group_no")))
    kept = hashed.withColumn("r", F.row_number().over(W.partitionBy("file").orderBy("h", "group_no"))).where(F.col("r") <= per_file)
    numbers = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.col("group_no") * size + i)
    return joined_items(kept.select("file", "group_no", numbers.alias("numbers")), df, file_col, order_col, "group_no")


def permuted(i: int, n: int, seed: int) -> int:
    """The ``i``-th number of a random order of 0 to ``n`` - 1, computed alone: a keyed four-round network, walked until inside the range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = i >> half, i & mask
        for r in range(4):
            digest = hashlib.blake2b(f"{seed}|{r}|{right}".encode(), digest_size=8).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        i = left << half | right
        if i < n:
            return i


def random_starts(n: int, size: int, most: int, seed: int) -> list[int]:
    """Starts of groups of ``size`` among ``n`` rows that don't overlap: starts in random order, each taken if it is free, up to ``most``.

    The order is computed number by number, so the work grows with the groups drawn and not with the rows of a large file.
    """
    starts = n - size + 1
    taken: dict[int, int] = {}
    out: list[int] = []
    for i in range(max(starts, 0)):
        if len(out) == most:
            break
        s = permuted(i, starts, seed)
        # at most one start lies in a stretch of ``size`` rows, so only the neighbouring stretches can hold an overlap
        cell = s // size
        if all(abs(taken[c] - s) >= size for c in (cell - 1, cell, cell + 1) if c in taken):
            taken[cell] = s
            out.append(s)
    return out


def random_groups(df: DataFrame, file_col: str, order_col: str, size: int = 5, per_file: int = 250, seed: int = 42) -> DataFrame:
    """(file, start, items): random groups that don't overlap, from each file's rows numbered 1 to n.

    Only a file's row count enters the drawing, so no task holds a file's rows; the rows are joined to the drawn groups.
    """
    counts = df.groupBy(F.col(file_col).alias("file")).agg(F.count("*").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, s) for f, n in zip(b["file"], b["n"], strict=True) for s in random_starts(int(n), size, per_file, seed)]
            yield pd.DataFrame(rows, columns=["file", "start"])

    starts = counts.mapInPandas(draw, "file string, start long")
    drawn = starts.select("file", "start", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.col("start") + i).alias("numbers"))
    return joined_items(drawn, df, file_col, order_col, "start")



def prompt(template: str, query: Column, answer: Column) -> Column:
    before, rest = template.split("{q}")
    middle, after = rest.split("{a}")
    return F.concat(F.lit(before), blank_to(query), F.lit(middle), blank_to(answer), F.lit(after))


def synthesis_prompt(group: Column) -> Column:
    before, after = SYNTHESIS.split("{context_group}")
    return F.concat(F.lit(before), F.to_json(group), F.lit(after))


PROMPTS = {"intent": INTENT_PROMPT, "metadata": METADATA_PROMPT, "answer": ANSWER_PROMPT}


def with_context(examples: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Examples with the group of chunks that they were made from."""
    return examples.join(groups.select(key, F.col("items").alias("context")), key, "left")


def flattened_groups(files: DataFrame) -> DataFrame:
    """(file, group_no, items) from one row per file with its ``groups``, numbered from 0; files without groups give no row."""
    return files.select("file", F.posexplode("groups").alias("group_no", "items"))


def generated_examples(groups: DataFrame, completer, seed: int = 42, limit: int | None = None) -> DataFrame:
    """(file, group_no, example_no, example, context) from groups (file, group_no, items): what a model makes of each group.

    Groups are taken in a seeded random order, only the first ``limit`` of them if a trial run asks for that. The list in each answer is read
    wherever it stands; an answer without a list, or items that are no objects, give no row. ``context`` is the group's JSON.
    """
    drawn = shuffled(groups, seed, "file", "group_no")
    if limit is not None:
        drawn = drawn.limit(limit)
    answered = drawn.select("file", "group_no", F.to_json("items").alias("context"), completer.complete(synthesis_prompt(F.col("items"))).alias("answer"))
    listed = F.try_variant_get(F.try_parse_json(outermost_list(F.col("answer"))), "$", "array<variant>")
    rows = answered.select("file", "group_no", "context", F.posexplode(F.transform(listed, lambda x: F.to_json(x))).alias("example_no", "example"))
    return rows.where(F.col("example").startswith("{")).select("file", "group_no", "example_no", "example", "context")
