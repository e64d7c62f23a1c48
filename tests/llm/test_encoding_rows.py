import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import encoding  # noqa: E402


def _encode(texts):
    enc = encoding._encoder(f"{encoding.TOKENIZER_DIR}/byte_bpe_50k.json")
    return [enc.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_texts_and_rows_behind_a_shuffle(spark, monkeypatch):
    texts = ["short one", "a much longer text, " * 40, "z" * 900, "short one", None, "", "the the the"]
    rows = [(i % 5, t) for i, t in enumerate(texts)] + [(0, "short one"), (None, "short one"), (None, "short one")]
    want = sorted((-1 if i is None else i, tuple(x)) for (i, _), x in zip(rows, _encode([t for _, t in rows]), strict=True))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(7, F.rand(3)).orderBy(F.rand(4))
    for widths in (None, (16, 7)):
        # with few bits of place the longer texts take the way of lists
        if widths:
            monkeypatch.setattr(encoding, "packed_widths", lambda n, w=widths: w)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r["ids"])) for r in encoding.encode_corpus(docs).collect())
        assert got == want


def test_widths_follow_the_vocabulary():
    assert encoding.packed_widths(50_000) == (16, 23) and encoding.packed_widths(131_073) == (18, 22)


def test_decoding_keeps_repeated_rows(spark):
    texts = ["same", "same", "other — “x”"]
    coded = spark.createDataFrame([(1, x) for x in _encode(texts)] + [(2, [])], "doc_id int, ids array<int>")
    assert sorted((r["doc_id"], r["text"]) for r in encoding.decode_corpus(coded).collect()) == [(1, "other — “x”"), (1, "same"), (1, "same"), (2, "")]
