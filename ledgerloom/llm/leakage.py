"""Passages of held-out items inside a corpus: CGK embedding, bit-sampling LSH, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .bytewords import mix, word_hashes

#: Item keys that each worker holds at once, with the words of their windows (112 bytes each); items beyond it go in further blocks.
ITEM_BLOCK = 250_000
#: Pairs of windows whose edit distances are counted together.
PAIRS = 200_000
#: Windows that take their walk together, few enough to stay in a core's cache.
TOGETHER = 1 << 16
#: Walks of their own and positions sampled of each: what the recall stated in the README was measured with.
REPEATS, SAMPLED = 12, 7
_STOP = np.uint64(0)


def cgk_keys(words: np.ndarray, starts: np.ndarray, size: int, repeats: int, sampled: int, seed: int = 11) -> np.ndarray:
    """LSH keys [repeats, windows] of the windows ``words[s:s+size]``; ``starts`` are in order.

    The random walk copies the current word to the output and moves on by one random bit that depends on the step and
    the word; edit distance becomes Hamming distance between outputs. Each repeat has its own walk, every other one from the window's
    end backwards, and hashes ``sampled`` of its first ``size`` positions, which cover about half of the window's words; if 0 is given, all
    positions of a walk over three times the window's length.
    """
    out = np.zeros((repeats, len(starts)), dtype=np.uint64)
    if not len(starts):
        return out
    for r in range(repeats):
        rng = np.random.default_rng(seed + r)
        chosen = np.isin(np.arange(size), rng.choice(size, sampled, replace=False)) if sampled else np.ones(3 * size, dtype=bool)
        salts = rng.integers(1, 1 << 63, len(chosen), dtype=np.uint64) | np.uint64(1)
        steps = int(np.flatnonzero(chosen)[-1]) + 1
        back = sampled and r % 2
        text, begins = (words[::-1], (len(words) - size - starts)[::-1]) if back else (words, starts)
        keys = np.empty(len(starts), dtype=np.uint64)
        for b in range(0, len(begins), TOGETHER):
            own = begins[b : b + TOGETHER]
            begin = int(own[0])
            part = np.append(text[begin : int(own[-1]) + size], _STOP)
            at = (own - begin).astype(np.int32)
            end = at + np.int32(size)
            key = np.full(len(own), r + 1, dtype=np.uint64)
            for j in range(steps):
                inside = at < end
                if chosen[j]:
                    key = (key ^ np.where(inside, part[at], _STOP)) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                at += ((part * salts[j]) >> np.uint64(63)).astype(np.int8)[at] & inside
            keys[b : b + TOGETHER] = mix(key)
        out[r] = keys[::-1] if back else keys
    return out


def edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance, in words, of each pair of rows of two tables of word hashes."""
    n, m = a.shape[1], b.shape[1]
    row = [np.full(len(a), j, dtype=np.int16) for j in range(m + 1)]
    for i in range(1, n + 1):
        last, row[0] = row[0], np.full(len(a), i, dtype=np.int16)
        for j in range(1, m + 1):
            swap = last + (a[:, i - 1] != b[:, j - 1])
            last, row[j] = row[j], np.minimum(np.minimum(row[j], row[j - 1]) + 1, swap).astype(np.int16)
    return row[m]


def _windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window of ``size`` words inside its row, row of each window)."""
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(int(begin[-1])) - begin[:-1][row] + first[:-1][row], row


def _held(words: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    """The words of each window, packed."""
    rows = np.ascontiguousarray(words[starts[:, None] + np.arange(size)]) if len(starts) else np.zeros((0, size), dtype=np.uint64)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def leaked_windows(docs: DataFrame, items: DataFrame, size: int = 13, max_edits: int = 2, repeats: int = REPEATS, sampled: int = SAMPLED, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): documents that hold ``size`` consecutive words of an item with at most ``max_edits`` word edits.

    Every window of ``size`` words of items and documents is embedded; windows with an equal sampled key in any repeat are
    candidates, and the word-level edit distance of the two windows (of 64-bit hashes of their words) decides. Equal windows share all
    keys, so what is copied without an edit is always found; of edited passages the repeats find most. As both windows have
    ``size`` words, a word put in or left out counts as two edits.

    Item windows go to the workers as sorted key arrays in blocks of a fixed number, so memory is bounded however many
    items there are; further blocks read the documents again. Null or short texts have no windows and give no row. Repeated documents
    count under each id; an id given twice is reported once. ``edits`` is the least over the windows found.
    """
    spark = docs.sparkSession
    item_kind, kind = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    item_rows = items.select(F.col(item_id).alias("item_id"), F.lower(F.col(text)).alias("text")).where("text is not null")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, first = word_hashes(b.column(1))
            starts, row = _windows(first, size)
            held = _held(words, starts, size)
            for key in cgk_keys(words, starts, size, repeats, sampled):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(row)), held], ["key", "item_id", "iw"])

    item_keys = staged(item_rows.mapInArrow(keyed, f"key long, item_id {item_kind}, iw binary").distinct(), "itemkeys")
    blocks = max(1, -(-item_keys.count() // ITEM_BLOCK))
    found = None
    for block in range(blocks):
        own = item_keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).toArrow().sort_by("key").combine_chunks()
        held = np.frombuffer(b"".join(own.column("iw").to_pylist()), dtype=np.uint64).reshape(-1, size)
        wanted = spark.sparkContext.broadcast((own.column("key").to_numpy(), held))

        def probe(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            table, held = wanted.value
            if not len(table):
                return
            # equal windows of items stand under many keys; each is compared once
            _, of = np.unique(held, axis=0, return_inverse=True)
            # a small bit filter drops almost all windows before the search
            shift = np.uint64(64 - 22)
            seen = np.zeros(1 << 22, dtype=bool)
            seen[(mix(table.view(np.uint64)) >> shift).astype(np.int64)] = True
            for b in batches:
                words, first = word_hashes(b.column(1))
                starts, row = _windows(first, size)
                if not len(starts):
                    continue
                met = []
                for key in cgk_keys(words, starts, size, repeats, sampled):
                    maybe = np.flatnonzero(seen[(mix(key) >> shift).astype(np.int64)])
                    k = key[maybe].view(np.int64)
                    low, high = np.searchsorted(table, k), np.searchsorted(table, k, side="right")
                    n = high - low
                    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    met.append(np.unique(np.repeat(maybe, n) * np.int64(len(table)) + at))
                pairs = np.unique(np.concatenate(met))
                window, item = pairs // len(table), pairs % len(table)
                # an item's window stands under several keys, its words count once for each window of the document
                _, once = np.unique(window * np.int64(len(table)) + of.ravel()[item], return_index=True)
                distance = np.empty(len(once), dtype=np.int16)
                for s in range(0, len(once), PAIRS):
                    w, i = window[once[s : s + PAIRS]], item[once[s : s + PAIRS]]
                    distance[s : s + PAIRS] = edits(words[starts[w][:, None] + np.arange(size)], held[i])
                near = np.flatnonzero(distance <= max_edits)
                by = {}
                for w, c, n in zip(window[once[near]].tolist(), of.ravel()[item[once[near]]].tolist(), distance[near].tolist(), strict=True):
                    by[(row[w], c)] = min(n, by.get((row[w], c), n))
                rows = [(d, c, n) for (d, c), n in by.items()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["doc_id", "w", "edits"])

        part = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text")).where("text is not null").mapInArrow(probe, f"doc_id {kind}, w long, edits int")
        # the items of each distinct window, by its number
        _, of = np.unique(held, axis=0, return_inverse=True)
        owners = sorted(set(zip(of.ravel().tolist(), own.column("item_id").to_pylist(), strict=True)), key=str)
        bearers = spark.createDataFrame(owners, f"w long, item_id {item_kind}")
        part = part.join(F.broadcast(bearers), "w").select("doc_id", "item_id", "edits")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
