"""Corpus encoding with a public byte-level BPE vocabulary, each distinct word encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staged

#: Where the public vocabulary files lie; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the public pre-token pattern of the byte-level vocabulary. (?U) gives \s its Unicode meaning.
PRETOKEN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that hold at least 1/HOT_SHARE of all tokens are joined by broadcast: at most HOT_SHARE words, whatever the data.
HOT_SHARE = 4096


def packed_widths(vocabulary: int) -> tuple[int, int]:
    """(bits of an id, bits of a word's place and of a part's number in its word) of the one number that a token's place and id share."""
    bits = max(vocabulary - 1, 1).bit_length()
    return bits, (63 - bits) // 2

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _encoders[path] = t
    return _encoders[path]


def token_bytes(spark, tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """The vocabulary as a table (token_id int, token_bytes binary), read from the rank file."""
    lines = spark.read.text(f"file://{os.path.realpath(tokenizer_dir)}/{name}.tiktoken")
    parts = F.split("value", " ")
    return lines.where("value <> ''").select(parts[1].cast("int").alias("token_id"), F.unbase64(parts[0]).alias("token_bytes"))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, ids array<int>) of every row of ``docs``, without special tokens.

    Pre-tokens are exploded with their positions, the distinct ones are encoded once each, and the ids are joined
    back by word and put together by position. Words with a large share of all tokens are joined map-side, so no
    shuffle key holds more than 1/4096 of the tokens; that table has at most 4096 rows by construction.

    Null, empty: an empty list. Special-token strings in a text count as ordinary text. A row is known by a 128-bit hash of its
    id and text, which is the same however often Spark computes it; rows equal in both are encoded once and come out as often as they
    went in. Rows with a null id are kept. Other columns of ``docs`` are ignored. Places and ids share one number of as many bits as the
    vocabulary asks for; a text with more bytes than the place has room for (8 million at 50,000 ids) is put together from lists.
    """
    path = os.path.join(tokenizer_dir, f"{name}.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            words = b.column(0).to_pylist()
            ids = [x.ids for x in enc.encode_batch(words, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), b.column(1)], ["word", "ids", "n"])

    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    keyed = base.where("_text <> ''").select(F.xxhash64("_id", "_text").alias("_k"), F.xxhash64("_text", F.lit(1), "_id").alias("_l"), "_id", "_text")
    pretokens = F.regexp_extract_all("_text", F.lit(PRETOKEN), F.lit(0))
    words = keyed.select(F.explode(pretokens).alias("word")).groupBy("word").count()
    # the pattern splits a word no further, so encoding it alone gives its ids inside any text
    coded = staged(words.mapInArrow(encode, "word string, ids array<int>, n long"), "words")
    total = coded.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = coded.where(F.col("n") * HOT_SHARE >= F.lit(max(total, 1)))
    cold = coded.where(F.col("n") * HOT_SHARE < F.lit(max(total, 1)))

    def placed(part: DataFrame) -> DataFrame:
        tokens = part.select("_k", "_l", "_id", F.posexplode(pretokens).alias("pos", "word"))
        marked = tokens.join(F.broadcast(hot.select("word", "ids")), "word", "left")
        hit = marked.where(F.col("ids").isNotNull()).select("_k", "_l", "_id", "pos", "ids")
        rest = marked.where(F.col("ids").isNull()).select("_k", "_l", "_id", "pos", "word").join(cold.select("word", "ids"), "word").select("_k", "_l", "_id", "pos", "ids")
        return hit.unionByName(rest)

    id_bits, place_bits = packed_widths(_encoder(path).get_vocab_size())
    keys = ["_k", "_l", "_id"]
    fits = F.octet_length("_text") < F.lit(1 << place_bits)
    entry = F.transform("ids", lambda x, j: F.shiftleft(F.col("pos").cast("bigint"), id_bits + place_bits).bitwiseOR(F.shiftleft(j.cast("bigint"), id_bits)).bitwiseOR(x.cast("bigint")))
    packed = placed(keyed.where(fits)).select(*keys, F.explode(entry).alias("e")).groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("t"))
    # equal rows give equal entries, of which one is kept
    packed = packed.select(*keys, F.transform(F.array_distinct("t"), lambda e: e.bitwiseAND(F.lit((1 << id_bits) - 1)).cast("int")).alias("ids"))
    wide = placed(keyed.where(~fits)).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("pos", "ids"))).alias("t")).select(*keys, F.flatten("t.ids").alias("ids"))
    repeated = small_side(staged(keyed.groupBy("_k", "_l").count().where("count > 1"), "repeated"))
    whole = packed.unionByName(wide).join(repeated, ["_k", "_l"], "left")
    whole = whole.select("_id", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("count", F.lit(1).cast("bigint")))).alias("_n")).select("_id", "ids")
    none = base.where("coalesce(_text, '') = ''").select("_id", F.array().cast("array<int>").alias("ids"))
    return whole.unionByName(none).select(F.col("_id").alias(id_col), "ids")


def decode_corpus(coded: DataFrame, id_col: str = "doc_id", tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, text) from (id, ids) by a join with the token-byte table (a fixed vocabulary, so broadcast).

    An empty or null list gives ''. Ids outside the vocabulary are an error at decoding, as their bytes are unknown.
    """
    vocabulary = token_bytes(coded.sparkSession, tokenizer_dir, name)
    rows = coded.select(F.col(id_col).alias("_id"), "ids", F.xxhash64(id_col, "ids").alias("_k"), F.xxhash64("ids", F.lit(1), id_col).alias("_l"))
    flat = rows.select("_k", "_l", "_id", F.posexplode_outer("ids").alias("pos", "token_id")).join(F.broadcast(vocabulary), "token_id", "left")
    checked = F.when(F.col("token_id").isNotNull() & F.col("token_bytes").isNull(), F.raise_error(F.lit("unknown token id"))).otherwise(F.hex("token_bytes"))
    parts = flat.select("_k", "_l", "_id", "pos", checked.alias("h"))
    # equal rows are put together once and come out as often as they went in
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pos", "h"))), lambda x: F.coalesce(x["h"], F.lit(""))), "")
    texts = parts.groupBy("_k", "_l", "_id").agg(F.decode(F.unhex(joined), "utf-8").alias("text"))
    repeated = small_side(staged(rows.groupBy("_k", "_l").count().where("count > 1"), "repeated"))
    out = texts.join(repeated, ["_k", "_l"], "left")
    return out.select("_id", "text", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("count", F.lit(1).cast("bigint")))).alias("_n")).select(F.col("_id").alias(id_col), "text")
