import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import bytewords, encoding, leakage, mojibake, neardup, neighbours, pairs, quality, splitting, turns  # noqa: E402

random.seed(1)
VOCAB = [f"w{i}" for i in range(4000)]


def words_of(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def test_byte_words():
    texts = ["", "a b-b2 é zz", None, "zz a", "a", "abc" * 1000, "ab", "c ab"]
    hashes, first = bytewords.word_hashes(pa.array(texts))
    assert list(np.diff(first)) == [len(words_of(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for w, h in zip(words_of(t), hashes[first[i] : first[i + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced, f2 = bytewords.word_hashes(pa.array(texts).slice(1, 3))
    assert list(sliced) == list(hashes[first[1] : first[4]]) and f2[0] == 0


# -- encoding --------------------------------------------------------------------------------------------------------


def test_encoding_round_trip(spark):
    texts = ["Hello  world, it's 12345\n\n fine", "", None, "naïve — “quotes” 漢字 \t\t　 x", "<|endoftext|> don't", " \n ", "the the the", "the the the", "a" * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode_corpus(docs).collect()}
    enc = encoding._encoder(f"{encoding.TOKENIZER_DIR}/byte_bpe_50k.json")
    assert got == {i: enc.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    coded = spark.createDataFrame([(i, got[i]) for i in got], "doc_id int, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in encoding.decode_corpus(coded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encoding.encode_corpus(docs.limit(0)).count() == 0


# -- leakage ---------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    items = [(i, " ".join(random.choices(VOCAB, k=40))) for i in range(20)] + [(90, None), (91, "too short")]
    docs = []
    for i in range(300):
        text = random.choices(VOCAB, k=60)
        if i % 3 == 0:
            w = words_of(items[i % 20][1])
            n = random.choice([5, 12, 13, 20])
            s = random.randrange(len(w) - n)
            text[20:20] = w[s : s + n]
        docs.append((i, ", ".join(text).upper() if i % 2 else "\n".join(text)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - 12):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(i, x) for i, t in docs for k in range(len(words_of(t)) - 12) for x in windows.get(tuple(words_of(t)[k : k + 13]), ())}
    d, e = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = [(r["doc_id"], r["item_id"]) for r in leakage.leaked_windows(d, e, max_edits=0).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert leakage.leaked_windows(d.limit(0), e).count() == 0 and leakage.leaked_windows(d, e.limit(0)).count() == 0


def test_leaks_with_edits(spark):
    items = [(i, random.choices(VOCAB, k=13)) for i in range(60)]
    rows = []
    for i, words in items:
        for kind in range(3):
            w, at = list(words), random.randrange(1, 13)
            if kind == 0:
                w[at] = "changed"
            elif kind == 1:
                w[at:at] = ["added"]
            else:
                w[at], w[(at + 5) % 13] = "changed", "too"
            rows.append((10 * i + kind, " ".join([*random.choices(VOCAB, k=20), *w, *random.choices(VOCAB, k=20)])))
    d, e = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id int, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in leakage.leaked_windows(d, e).collect()}
    # a word put in next to an end is one edit of the window that leaves the end out
    assert all(doc // 10 == item and n in ((1,), (1, 2), (2,))[doc % 10] for (doc, item), n in found.items())
    for kind, least in ((0, 0.95), (1, 0.9), (2, 0.8)):
        assert sum((10 * i + kind, i) in found for i in range(60)) >= least * 60
    assert not leakage.leaked_windows(d, e, max_edits=0).collect()


def test_edit_distances():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4], [1, 1, 1, 1]], dtype=np.uint64)
    b = np.array([[1, 2, 3, 4], [1, 9, 3, 4], [2, 3, 4, 5], [5, 6, 7, 8]], dtype=np.uint64)
    assert leakage.edits(a, b).tolist() == [0, 1, 2, 4]


# -- near duplicates -------------------------------------------------------------------------------------------------


def brute(rows, n, t, least):
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, x in rows if len(w := words_of(x)) >= max(least, n)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def test_near_duplicates_against_brute_force(spark):
    rows = []
    for i in range(60):
        base = random.choices(VOCAB[:400], k=random.choice([55, 90, 300]))
        for j in range(4):
            w = list(base)
            for _ in range(j * 4):
                w[random.randrange(len(w))] = random.choice(VOCAB)
            if j == 3:
                w += random.choices(VOCAB, k=len(w) // 3)
            rows.append((f"c{i}_{j}", " ".join(w)))
    rows += [("same1", rows[0][1].upper()), ("same2", rows[0][1]), ("null", None), ("short", "a b c"), ("blank", " ")]
    want = brute(rows, 3, 0.6, 50)
    df = spark.createDataFrame(rows + [rows[5]], "id string, text string").withColumn("cls", F.lit(1))
    linked, members = neardup.near_duplicates(df, "id", n=3, similarity=0.6, min_words=50)
    got = {(r["id_a"], r["id_b"]) for r in neardup.expanded_pairs(linked, members).collect()}
    assert got == want and len(want) > 100
    linked, members = neardup.near_duplicates(df.limit(0), "id")
    assert linked.count() == 0 and members.count() == 0


def test_sliced_comparison_in_large_and_split_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    n = 900
    size = rng.integers(60, 140, n)
    base = rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64)
    sketch = base[rng.integers(0, 30, n)].copy()
    for r in range(n):
        for b in rng.integers(0, 256, 12):
            sketch[r, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    entry = np.full(n, np.uint64(77) << neardup.PLACE)
    want = set()
    for i in range(n):
        d = np.bitwise_count(sketch ^ sketch[i]).sum(axis=1)
        ok = (d <= neardup.radius((size + size[i]).astype(float), 0.6)) & neardup._fit(size, np.zeros(n, int), np.full(n, i), np.arange(n), 0.6)
        want |= {(min(i, j), max(i, j)) for j in np.flatnonzero(ok) if j != i}
    for small in (4, 2000):
        monkeypatch.setattr(neardup, "SMALL", small)
        i, j = neardup.sliced_pairs(entry, sketch, size.astype(np.int64), 0.6)
        assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want


# -- neighbours ------------------------------------------------------------------------------------------------------


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((150, 64))
    v = np.concatenate([centres + 0.25 * rng.standard_normal((150, 64)) for _ in range(6)] + [centres[:1]] * 14)
    rows = [(f"p{i:04d}", [float(y) for y in x]) for i, x in enumerate(v)]
    rows += [("null", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    near = neighbours.nearest(df, k=10, min_cosine=0.85).collect()
    u = v.astype("f4").astype("f8")
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(len(v)) for j in np.argsort(-s[i], kind="stable")[:10] if s[i, j] >= 0.85}
    got = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in near}
    distinct = {(i, j) for i, j in want if s[i, j] < 0.999999}
    assert len(distinct & got) >= 0.99 * len(distinct) and all(s[i, j] >= 0.85 for i, j in got)
    per = {}
    for r in near:
        per.setdefault(r["id"], []).append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 10 for x in per.values())
    assert len(per["p0905"]) == 10
    whole = neighbours.nearest(df, k=10, probes=1000).collect()
    hits = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in whole}
    truth = {(i, j) for i in range(len(v)) for j in np.argsort(-s[i], kind="stable")[:10] if s[i, j] < 0.999999}
    assert len(truth & hits) >= 0.9 * len(truth)
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_one_bit_estimates():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned = x @ neighbours.rotation(64).T
    bits, align = neighbours.one_bit(turned)
    est, err = neighbours.estimates(bits, align, turned, 64)
    off = ~np.eye(500, dtype=bool)
    assert np.mean(np.abs(est - x @ x.T)[off] <= np.broadcast_to(err, est.shape)[off]) > 0.97
    assert abs((est - x @ x.T)[off].mean()) < 0.005


# -- splitting -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size,overlap", [(60, 10), (100, 0), (80, 30)])
def test_pieces(spark, size, overlap):
    texts = ["", None, "  \n ", "short", "x" * 500, "One sentence here. " * 40, "a b\n\nc d; e f\n" * 30, "😀 word " * 60, " pad " + "y" * size + " pad "]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = splitting.split_texts(items, size, overlap).orderBy("id", "piece_no").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r["id"] == i]
        t = (t or "").strip(splitting.BLANKS)
        if not t:
            assert not own
            continue
        end = 0
        for r in own:
            assert len(r["piece"]) <= size and t[r["start"] :].startswith(r["piece"]) and r["start"] <= end and end - r["start"] <= overlap
            end = r["start"] + len(r["piece"])
        assert end == len(t) and own[0]["n_pieces"] == len(own)
        if " " in t and max(map(len, t.split())) < size // 3:
            assert all(r["piece"][-1].isspace() or r is own[-1] for r in own)


def test_cut_kind(spark):
    df = spark.createDataFrame([("a" * 20,), ("a " * 20,), (" " * 30 + "a",), (None,)], "t string")
    assert [r["k"] for r in df.select(splitting.cut_kind(F.col("t"), 10).alias("k")).collect()] == ["hard", "natural", None, None]


# -- encoding repair -------------------------------------------------------------------------------------------------


def test_repair(spark):
    clean = "Zürnau naïve “over” Łubień isn’t Наш café SÃO Ávila €4"
    damaged = {
        1: clean.encode().decode("latin-1"), 2: clean.encode().decode("mac_roman"), 3: clean.replace("ü", "Ã¼"), 4: clean, 5: "plain ascii", 6: None, 7: "",
        8: "caf� here", 9: clean.encode().decode("latin-1").encode().decode("latin-1"), 10: "Zürnau’s SÃO ÀÉ”",
    }
    rows = [(k, t) for k, t in damaged.items()] + [(100 + i, clean) for i in range(12)]
    df = spark.createDataFrame(rows, "df_index int, transcript string")
    got = {r["id"]: r for r in mojibake.repaired(df).collect()}
    assert {k for k, r in got.items() if r["n_repaired"] + r["n_lost"]} == {1, 2, 3, 8, 9}
    for k in (1, 2, 3, 9):
        assert got[k]["text"] == clean, k
    assert got[8]["text"] == "café here" and got[6]["text"] is None and got[5]["text"] == "plain ascii"
    assert mojibake.repaired(df.limit(0)).count() == 0


# -- turns -----------------------------------------------------------------------------------------------------------

CALL = """Acme Corp (NASDAQ:ACMJ) Q1 2020 Earnings Conference Call Transcript
Call Participants:
* Jane Q. Roe — Chief Executive Officer
John Doe — Big Bank — Analyst
Operator

Prepared Remarks:
[00:00:10] OPERATOR: Good day. (Operator Instructions)
[00:00:20] Roe:
Uh, we did, um, well. Fiscal 2018: the plan held.
[00:00:15] J. Roe: It goes on.
Operator
Mm-hmm.
Jane Roe (Chief Executive Officer): And on. [Music]
Q&A
Q - John Doe: Why?
John Doe, Analyst: Again why?
[00:00:01] Dr. Roe: Because.
Duration: 20 minutes"""


def test_turns():
    rows = turns.parse(CALL)
    assert [(n, who) for n, who, *_ in rows] == [(1, "Operator"), (2, "Jane Q. Roe"), (3, "John Doe"), (4, "Jane Q. Roe")]
    assert rows[1][2] == "we did, well. Fiscal 2018: the plan held. It goes on. And on." and rows[2][2] == "Why? Again why?"
    times = [t for *_, begin, end in rows for t in (begin, end) if t is not None]
    assert times == sorted(times)
    # marks 20, 15 and 1 stand in the wrong order and are evened out together
    assert rows[0][3:] == (10.0, 12.0) and all(r[3:] == (12.0, 12.0) for r in rows[1:])
    assert turns.parse(None) == turns.parse("") == turns.parse("no label\nat all") == []


def test_intervals():
    said = "Title\n[00:00:05] Ann Roe: One.\n[00:00:20] Ann Roe: Two.\n[00:00:30] Bob Doe: Three.\n[00:00:40] Four.\nAnn Roe: Five."
    assert [(who, begin, end) for _, who, _, begin, end in turns.parse(said)] == [("Ann Roe", 5.0, 30.0), ("Bob Doe", 30.0, 40.0), ("Ann Roe", 40.0, 40.0)]
    assert turns.parse("Title\nAnn Roe: One.\nBob Doe: Two.")[0][3:] == (None, None)


def test_clock():
    assert turns.repaired_clock([1.0, None, 5.0, 4.0, 9.0]) == [1.0, None, 4.5, 4.5, 9.0]
    assert turns.repaired_clock([100.0, 200.0, 5.0, 50.0]) == [100.0, 200.0, 205.0, 250.0]


def test_turn_table(spark):
    df = spark.createDataFrame([(1, CALL), (2, None), (3, " "), (1, CALL)], "df_index int, transcript string")
    assert turns.speaker_turns(df).count() == 8


# -- pairs -----------------------------------------------------------------------------------------------------------


def test_defects(spark):
    q = "What drove the revenue of Acme Corp in 2020?"
    cases = {
        None: ["Revenue of the unit grew by 5.2%, helped by the new plan.", "Yes", "$5.2 million", "Acme Corp", "Q1 2020", "- Sales: 5.1%\n- Costs: $3 million", "It declined to say (see the 2016 filing)", "The company cannot pay until 2021 under its terms."],
        "empty": [None, "", " ​", "N/A", "{}", "<answer></answer>", "...", "TBD"],
        "copy": [q, q.upper(), f'"{q}"', f"Answer: {q}", f"{q} {q}", q[:-1]],
        "refusal": ["I cannot answer this question.", "Hello! I'm sorry, but I can't help with that. Try again.", "I'd rather not speculate about Acme Corp."],
        "other_language": ["Der Umsatz stieg um 5%, weil die Frachtkosten höher ausfielen.", "La marge a reculé à cause de la hausse des coûts.", "当社は来年度に拠点を統合し、費用を削減する計画です。"],
        "truncated": ["Revenue of the unit grew by", "Revenue grew to $5.", "- Sales: 5.1%\n- Costs", "It rose, and the cost of the"],
    }
    rows, want = [], {}
    for kind, answers in cases.items():
        for a in answers:
            want[len(rows)] = kind
            rows.append((len(rows), q, a))
    df = spark.createDataFrame(rows, "example_id int, user_query string, final_answer string")
    got = {r["id"]: r["defect"] for r in pairs.defects(df).collect()}
    assert {i: got.get(i) for i in want} == want
    assert pairs.defects(df.limit(0)).count() == 0


# -- quality ---------------------------------------------------------------------------------------------------------

PROSE = "The unit grew in the year, and the board of the company agreed to a plan. We expect that the cost of freight will fall in the second half. "


def test_kinds(spark):
    rows = [(i, PROSE * 3) for i in range(30)] + [
        (100, "\n".join(f"- item {c} unit" for c in "abcdefgh")), (101, "a;b;c\n" + "\n".join(f"row {i};{i},1;(3)" for i in range(12))), (102, "-----\n#####\n*****\n"), (103, None), (104, " \n"),
        (105, PROSE * 2 + "\n- one\n- two"), (106, "page not found\n" * 20), (107, "Der Umsatz stieg um 5%, weil die Kosten der Firma nicht höher waren. " * 3),
    ]
    got = {r["id"]: r for r in quality.assessed(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {i: got[i]["kind"] for i in (0, 100, 101, 102, 105, 106, 107)} == {0: "prose", 100: "list", 101: "table", 102: "junk", 105: "prose", 106: "junk", 107: "prose"}
    assert 103 not in got and 104 not in got and got[101]["outlier"] and not got[0]["outlier"]


def test_tail_ranks_are_exact(spark):
    values = [random.choice([0.0, 1.0, 2.5, round(random.random(), 3)]) for _ in range(500)]
    rows = [("en" if i % 3 else "de", i % 5 > 0, *[v] * len(quality.STATS)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "group string, reference boolean, " + ", ".join(f"{s} double" for s in quality.STATS))
    tails = {(r["group"], r["stat"], r["value"]): r["tail"] for r in quality.tail_probabilities(df).collect()}
    for (group, stat, v), t in tails.items():
        own = [x for (g, ref, *_), x in zip(rows, values, strict=True) if g == group and ref]
        low, high = (sum(x <= v for x in own) + 1) / (len(own) + 1), (sum(x >= v for x in own) + 1) / (len(own) + 1)
        low, high = min(low, 1), min(high, 1)
        assert t == pytest.approx({"low": low, "high": high, "both": min(1, 2 * low, 2 * high)}[quality.SIDES[stat]])
