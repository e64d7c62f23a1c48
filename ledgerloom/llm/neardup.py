"""Near-duplicate texts: exact candidate blocks, bit-sliced distance counting, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staged
from .blobs import merged, ored, packed
from .bytewords import mix, ngram_hashes, word_hashes
from .components import components

#: Counters of the frequency sketch that orders runs of words from rare to common: as many as the input's bytes ask for, within these powers
#: of two. Workers hold one byte for each (a level on a logarithmic scale), so 16 MB at most, whatever the corpus.
SLOT_POWERS = (19, 24)
#: Levels of the sketch in which a count doubles.
LEVELS = 6
#: Entries that a task collects before it hands them on, one row for each receiving task.
FLUSH = 2_000_000
#: Bits of a text's sketch, in 64-bit parts.
BITS = 256
#: Members that a block is meant to have at most; larger blocks are split into sub-blocks that still meet pairwise.
BLOCK = 4096
#: Block entries that one task sorts.
TASK_KEYS = 600_000
#: Bits of the filter that keeps texts out of verification that are in no candidate pair: 16 for each pair, within these powers of two.
FILTER_POWERS = (16, 28)
#: Rows described at once; their number and a run's frequency and hash share one 64-bit sort key.
SLAB = 8192
#: Low bits of a block entry that hold the place of the run among its text's runs.
PLACE = np.uint64(12)
#: Rows whose bits are transposed into planes at once.
PLANE_ROWS = 32_768
#: Words of 64 rows whose differences are counted together.
TOGETHER = 4096
#: Members of a class whose pairs one task makes.
SPLIT = 4096
#: Larger groups are compared block against block, smaller ones all at once by offset.
SMALL = 512


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def slots_for(size_in_bytes: int) -> int:
    """Slots of the frequency sketch for an input of so many bytes: more slots tell rare runs from common ones in a larger corpus.

    Only speed depends on them. Inputs whose size Spark doesn't know get a number between the bounds.
    """
    low, high = SLOT_POWERS
    if size_in_bytes >= 1 << 60:
        return 1 << (low + high) // 2
    return 1 << min(high, max(low, (size_in_bytes // 16).bit_length()))


def leveled(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level of each slot as a byte, sub-blocks that a run of each level is split into).

    A slot counts the runs that share it besides a run's own bearers, so what an ordinary slot holds is taken off before a run counts
    as one with more than BLOCK bearers.
    """
    level = np.minimum(np.rint(np.log2(np.maximum(counts, 1)) * LEVELS), 255).astype(np.uint8)
    used = counts[counts > 0]
    noise = 2 * float(np.median(used)) if len(used) else 0.0
    return level, np.maximum(1, np.ceil((2.0 ** (np.arange(256) / LEVELS) - noise) / BLOCK)).astype(np.int64)


def _classes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each text: a hash over its whole word sequence."""
    at = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    part = mix(words + mix(at.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part, dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]])


def _runs(texts: pa.Array, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with enough words, their class hashes, run hashes, place in the first array of each run's row)."""
    words, first = word_hashes(texts)
    kept = np.flatnonzero(np.diff(first) >= max(min_words, n))
    runs, begin = ngram_hashes(words, first, n)
    place = np.full(len(begin) - 1, -1)
    place[kept] = np.arange(len(kept))
    row = np.repeat(place, np.diff(begin))
    if len(kept) < len(place):
        runs, row = runs[row >= 0], row[row >= 0]
    return kept, _classes(words, first)[kept], runs, row


def _ordered(runs: np.ndarray, row: np.ndarray, rows: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct runs of each row from rare to common, first run of each row): the order is the same in all texts."""
    rare = level[_slot(runs, len(level))].astype(np.uint64)
    key = row.astype(np.uint64) << np.uint64(51) | rare << np.uint64(43) | runs >> np.uint64(21)
    order = np.argsort(key)
    runs, row = runs[order], row[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    runs, row = runs[new], row[new]
    return runs, np.searchsorted(row, np.arange(rows + 1))


def _sketches(runs: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bit b is the parity of a text's runs that hash to b: two sketches differ as the sets' symmetric difference does."""
    rows = len(begin) - 1
    row = np.repeat(np.arange(rows), np.diff(begin))
    bit = (mix(runs ^ np.uint64(0x5BD1E995)) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(row * BITS + bit, minlength=rows * BITS).reshape(rows, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def radius(total: np.ndarray, similarity: float) -> np.ndarray:
    """Differing bits that no two sets of the given similarity, ``total`` runs together, exceed.

    Sketches differ in at most as many bits as the sets have runs that aren't shared; from BITS on nothing is dropped.
    """
    return np.minimum(BITS, np.floor((1 - similarity) / (1 + similarity) * total + 1e-6)).astype(np.int64)


def _entries(runs: np.ndarray, begin: np.ndarray, cls: np.ndarray, level: np.ndarray, split: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(block entries, row of each): a row's rarest runs, as many as pairs of the given similarity must share one of.

    Two sets that share at least ``similarity`` of their union share at least that part of either, so the first
    ``n - ceil(similarity * n) + 1`` runs of both, in any one order, meet. An entry is the run's hash with its place in the low
    bits. A run with more than BLOCK bearers is split: the row enters all sub-block pairs that its own sub-block is in.
    """
    size = np.diff(begin)
    length = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    row = np.repeat(np.arange(len(size)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    keys = runs[begin[:-1][row] + place]
    parts = split[level[_slot(keys, len(level))]]
    hot = np.flatnonzero(parts > 1)
    if len(hot):
        reps = parts[hot]
        again = np.repeat(hot, reps)
        other = np.arange(len(again)) - np.repeat(np.cumsum(reps) - reps, reps)
        own = (mix(cls[row[again]] ^ keys[again]) % parts[again].astype(np.uint64)).astype(np.int64)
        halves = mix(keys[again] + mix((np.minimum(own, other) * 1_000_003 + np.maximum(own, other) + 1).astype(np.uint64)))
        calm = parts == 1
        keys, row, place = np.concatenate([keys[calm], halves]), np.concatenate([row[calm], row[again]]), np.concatenate([place[calm], place[again]])
    mask = (np.uint64(1) << PLACE) - np.uint64(1)
    return (keys & ~mask) | np.minimum(place, int(mask)).astype(np.uint64), row


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, carry) of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _add8(counters: list[np.ndarray], x: list[np.ndarray]) -> None:
    """Eight planes of differences are added to the vertical counters: a carry-save tree, then the eights ripple upwards."""
    ones, twos, fours = counters[:3]
    ones, a = _csa(ones, x[0], x[1])
    ones, b = _csa(ones, x[2], x[3])
    twos, f = _csa(twos, a, b)
    ones, a = _csa(ones, x[4], x[5])
    ones, b = _csa(ones, x[6], x[7])
    twos, g = _csa(twos, a, b)
    fours, carry = _csa(fours, f, g)
    counters[:3] = ones, twos, fours
    for c in range(3, len(counters)):
        counters[c], carry = counters[c] ^ carry, counters[c] & carry


def _above(counters: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Bits of the rows whose count exceeds the limit of their word."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for c in range(len(counters) - 1, -1, -1):
        on = np.where(limit >> c & 1, ~np.uint64(0), np.uint64(0))
        above |= equal & counters[c] & ~on
        equal &= ~(counters[c] ^ on)
    return above


def _planes(sketch: np.ndarray, words: int) -> np.ndarray:
    """Bit plane k, packed 64 rows a word, holds bit k of all sketches."""
    planes = np.zeros((BITS, words), dtype=np.uint64)
    for s in range(0, len(sketch), PLANE_ROWS):
        part = np.ascontiguousarray(sketch[s : s + PLANE_ROWS]).view(np.uint8).reshape(-1, BITS // 8)
        bits = np.zeros((BITS, -(-len(part) // 64) * 64), dtype=np.uint8)
        bits[:, : len(part)] = np.unpackbits(part, axis=1, bitorder="little").T
        planes[:, s // 64 : s // 64 + bits.shape[1] // 64] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return planes


def _fit(size: np.ndarray, place: np.ndarray, i: np.ndarray | slice, j: np.ndarray | slice, similarity: float) -> np.ndarray:
    """Pairs whose sizes allow the similarity, and whose places of the shared run leave enough runs after it."""
    need = similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return (low >= similarity * high - 1e-9) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= need)


def _by_offset(sketch: np.ndarray, size: np.ndarray, place: np.ndarray, late: np.ndarray, length: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Every row that isn't ``late`` against the rows after it in its group: a shift of the planes compares all rows with those one offset on.

    Groups come with the longest first, so the rows that an offset concerns are the first ones, and all steps work on plain slices.
    Words with a row to compare are collected over offsets and counted together.
    """
    n = len(sketch)
    planes = _planes(sketch, -(-n // 64) + 10)
    rest = np.repeat(np.cumsum(length), length) - np.arange(n) - 1
    rest[late] = 0
    grown = -np.repeat(length, length)
    left, right, held, waiting = [], [], [], 0

    def count() -> None:
        at, valid, limit, offset = (np.concatenate(x) for x in zip(*held, strict=True))
        jump, shift = offset // 64, (offset % 64).astype(np.uint64)
        alive = valid
        counters = [np.zeros(len(at), dtype=np.uint64) for _ in range(9)]
        for k in range(0, BITS, 8):
            # a shift by 64 gives nothing
            moved = planes[k : k + 8, at + jump] >> shift | planes[k : k + 8, at + jump + 1] << (np.uint64(64) - shift)
            _add8(counters, list(planes[k : k + 8, at] ^ moved))
            if k % 64 == 56:
                alive = valid & ~_above(counters, limit)
                keep = alive != 0
                at, alive, valid, limit, offset, jump, shift, counters = at[keep], alive[keep], valid[keep], limit[keep], offset[keep], jump[keep], shift[keep], [x[keep] for x in counters]
                if not len(at):
                    return
        w, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left.append(at[w] * 64 + lane)
        right.append(left[-1] + offset[w])

    for o in range(1, int(length.max(initial=1))):
        end = min(int(np.searchsorted(grown, -o)), n - o)
        fit = (rest[:end] >= o) & _fit(size, place, slice(0, end), slice(o, end + o), similarity)
        lanes = np.zeros(-(-end // 64) * 64, dtype=bool)
        lanes[:end] = fit
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        most = np.zeros(len(lanes), dtype=np.int64)
        np.multiply(size[:end] + size[o : end + o], fit, out=most[:end])
        held.append((at, valid[at], radius(most.reshape(-1, 64)[at].max(axis=1).astype(float), similarity), np.full(len(at), o)))
        waiting += len(at)
        if waiting >= TOGETHER:
            count()
            held, waiting = [], 0
    if held:
        count()
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _by_block(sketch: np.ndarray, total: np.ndarray, early: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first ``early`` rows of one large group against all rows after them, 128 queries at once, 64 rows a word."""
    n = len(sketch)
    words = -(-n // 64)
    planes = _planes(sketch, words)
    padded = np.zeros(words * 64, dtype=np.int64)
    padded[:n] = total
    most = padded.reshape(-1, 64).max(axis=1)
    padded[n:] = total.max()
    least = padded.reshape(-1, 64).min(axis=1)
    own = np.unpackbits(np.ascontiguousarray(sketch[:early]).view(np.uint8).reshape(early, BITS // 8), axis=1, bitorder="little").astype(np.uint64) * ~np.uint64(0)
    left, right = [], []
    for s in range(0, early, 128):
        q = own[s : s + 128]
        asked = total[s : s + len(q)]
        at = np.arange(s // 64, words)
        at = at[(most[at] >= similarity * asked.min()) & (least[at] * similarity <= asked.max())]
        if not len(at):
            continue
        limit = radius((total[s : s + len(q), None] + most[None, at]).astype(float), similarity)
        counters = [np.zeros((len(q), len(at)), dtype=np.uint64) for _ in range(9)]
        alive = np.zeros((len(q), 0), dtype=np.uint64)
        for k in range(0, BITS, 8):
            _add8(counters, [planes[k + b][None, at] ^ q[:, k + b, None] for b in range(8)])
            if k % 64 == 56:
                alive = ~_above(counters, limit)
                keep = alive.any(axis=0)
                if not keep.all():
                    at, alive, limit, counters = at[keep], alive[:, keep], limit[:, keep], [x[:, keep] for x in counters]
                if not len(at):
                    break
        if len(at):
            lanes = np.unpackbits(np.ascontiguousarray(alive).view(np.uint8).reshape(len(q), len(at), 8), axis=2, bitorder="little")
            i, w, lane = np.nonzero(lanes)
            i, j = i + s, at[w] * 64 + lane
            fit = (j < n) & (j > i)
            left.append(i[fit])
            right.append(j[fit])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def sliced_pairs(entry: np.ndarray, sketch: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of entries of one block whose sketches are within the radius and whose sizes and places allow the similarity.

    Bit k of all sketches forms a plane of packed words; differences are added into vertical counters by carry-save
    steps, 64 rows a word, and words whose rows all exceed the radius are abandoned. Of two texts that share enough, the first
    shared run stands early enough in both for the rest to suffice; pairs whose places rule that out are dropped.
    """
    key, place = entry >> PLACE, (entry & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    # in a pair the smaller text has the run among its first n - 2t/(1+t) n + 1; rows with it later only answer
    late = place > size - np.ceil(2 * similarity / (1 + similarity) * size - 1e-9)
    # the longest groups come first, late rows last in each, like sizes together, so that one limit fits the rows of a word
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.append(cuts, len(key)))
    rank = np.empty(len(length), dtype=np.uint64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(length), dtype=np.uint64)
    order = np.argsort(np.repeat(rank, length) << np.uint64(33) | late.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64))
    late, sketch, size, place = late[order], sketch[order], size[order], place[order]
    length = -np.sort(-length)
    first = np.cumsum(length) - length
    found = []
    large = int(np.searchsorted(-length, -SMALL))
    for g in range(large):
        part = slice(first[g], first[g] + length[g])
        early = int((~late[part]).sum())
        if early:
            i, j = _by_block(sketch[part], size[part], early, similarity)
            found.append((i + first[g], j + first[g]))
    if large < len(length):
        from_row = int(first[large])
        i, j = _by_offset(sketch[from_row:], size[from_row:], place[from_row:], late[from_row:], length[large:], similarity)
        found.append((i + from_row, j + from_row))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, j = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    # a word's limit is its loosest row's; here each pair meets its own
    near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= radius((size[i] + size[j]).astype(float), similarity)
    i, j = i[near], j[near]
    fit = _fit(size, place, i, j, similarity)
    return order[i[fit]], order[j[fit]]


def _binary(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all rows in one array, first value of each row plus the total) of a column of packed numbers."""
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=column.offset * 4).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=kind), (offsets - offsets[0]) // width
    return np.frombuffer(column.buffers()[2], dtype=kind, count=int(offsets[-1] - offsets[0]) // width, offset=int(offsets[0])), (offsets - offsets[0]) // width


def _handed(task: np.ndarray, entries: np.ndarray, row: np.ndarray, cls: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    """One row for each receiving task: its classes with their sizes, sketches and numbers of entries, and those entries, all packed."""
    order = np.argsort(task, kind="stable")
    task, entries, row = task[order], entries[order], row[order]
    new = np.flatnonzero(np.append(True, (task[1:] != task[:-1]) | (row[1:] != row[:-1])))
    of, lengths = row[new], np.diff(np.append(new, len(row)))
    heads = np.empty(len(of), dtype=HEAD)
    heads["cls"], heads["size"], heads["n"], heads["sketch"] = cls[of], size[of], lengths, sketch[of]
    first = np.flatnonzero(np.append(True, task[new][1:] != task[new][:-1]))
    cuts = np.append(first, len(new))
    ends = np.append(new, len(row))[cuts]
    packed = [heads[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    own = [entries[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(task[new][first].astype(np.int32)), pa.array(packed, pa.binary()), pa.array(own, pa.binary())], ["task", "heads", "entries"])


#: What a block's task needs to know of a class.
HEAD = np.dtype([("cls", "<i8"), ("size", "<i4"), ("n", "<i4"), ("sketch", "<u8", (BITS // 64,))])


def near_duplicates(docs: DataFrame, id_col: str, text_col: str = "text", n: int = 5, similarity: float = 0.8, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs of class, members): ``pairs`` (class_a, class_b, similarity), ``members`` (id, class_id).

    A class holds the rows with one sequence of words; two classes are linked if the distinct runs of ``n`` words they share
    are at least ``similarity`` of all distinct runs of the two. Copies aren't expanded: each is a row of ``members``.

    Candidates are exact: every linked pair shares one of its rarest runs, which name the blocks. In a block the sketches'
    distances are counted bit-sliced, within a radius that no linked pair exceeds, then
    the whole run sets decide (as 32-bit hashes). Null ids, null texts and texts of fewer than ``min_words`` (or ``n``) words are in no class;
    an id given twice counts once; other columns are ignored; an empty table gives two empty results.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.lower(F.col(text_col)).alias("text")).where("id is not null and text is not null")
    slots = slots_for(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each id with its class, and one row per task with the counts of its runs; sums in single precision never overflow."""
        own = np.zeros(slots + 1, dtype=np.int64)
        for b in batches:
            kept, cls, runs, row = _runs(b.column(1), n, min_words)
            own[:slots] += np.bincount(_slot(runs, slots), minlength=slots)
            size = np.bincount(row, minlength=len(kept))
            own[slots] += int((size - np.ceil(similarity * size) + 1).sum())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array(cls.view(np.int64)), pa.nulls(len(kept), pa.binary())], ["id", "class_id", "b"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([packed(own.astype(np.float32))], pa.binary())], ["id", "class_id", "b"])

    described = staged(base.mapInArrow(describe, "id string, class_id long, b binary"), "described")
    members = described.where("b is null").select("id", "class_id").distinct()
    tallied = merged(described.where("b is not null").select("b"), np.add, slots + 1, np.float32)
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(tallied[slots]) // TASK_KEYS))
    shared = spark.sparkContext.broadcast(leveled(tallied[:slots]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block entries of each class with their receiving task; copies within a partition once."""
        level, split = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        rows = waiting = 0
        for whole in batches:
            for s in range(0, len(whole), SLAB):
                kept, cls, runs, row = _runs(whole.column(0).slice(s, SLAB), n, min_words)
                runs, begin = _ordered(runs, row, len(kept), level)
                entries, row = _entries(runs, begin, cls, level, split, similarity)
                fresh = np.zeros(len(cls), dtype=bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                entries, row = entries[fresh[row]], row[fresh[row]]
                held.append(((entries >> PLACE) % np.uint64(tasks), entries, row + rows, cls.view(np.int64), np.diff(begin).astype(np.int32), _sketches(runs, begin)))
                rows, waiting = rows + len(cls), waiting + len(entries)
                if waiting >= FLUSH:
                    yield _handed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, rows, waiting = [], 0, 0
        if waiting:
            yield _handed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, entries = [], []
        for b in batches:
            heads += [np.frombuffer(x.as_buffer(), dtype=HEAD) for x in b.column("heads")]
            entries += [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in b.column("entries")]
        if not entries:
            return
        entries, heads = np.concatenate(entries), np.concatenate(heads)
        of = np.repeat(np.arange(len(heads)), heads["n"])
        key = entries >> PLACE
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        order = order[np.append(same, False) | np.append(False, same)]
        entries, of = entries[order], of[order]
        cls = heads["cls"][of]
        i, j = sliced_pairs(entries, np.ascontiguousarray(heads["sketch"])[of], heads["size"][of].astype(np.int64), similarity)
        i, j = i[cls[i] != cls[j]], j[cls[i] != cls[j]]
        pairs = np.unique(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1), axis=0)
        for s in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[s : s + 100_000, 0]), pa.array(pairs[s : s + 100_000, 1])], ["class_a", "class_b"])

    handed = base.select("text").mapInArrow(spread, "task int, heads binary, entries binary").repartitionById(tasks, F.col("task"))
    candidates = staged(handed.mapInArrow(compare, "class_a long, class_b long").distinct(), "candidates")

    low, high = FILTER_POWERS
    bits = 1 << min(high, max(low, (16 * candidates.count()).bit_length()))

    def mark(own: np.ndarray, b: pa.RecordBatch) -> None:
        for column in b.columns:
            h = mix(column.to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(own, (h >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (h & np.uint64(63))).view(np.int64))

    wanted = spark.sparkContext.broadcast(ored(candidates, mark, bits // 64).view(np.uint64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cls, runs, row = _runs(b.column(0), n, min_words)
            h = mix(cls) % np.uint64(bits)
            ok = (wanted.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
            runs, row = runs[ok[row]], row[ok[row]]
            key = np.unique(row.astype(np.uint64) << np.uint64(32) | runs >> np.uint64(32))
            of = np.flatnonzero(ok)
            cuts = np.searchsorted(key, np.append(of, len(cls)).astype(np.uint64) << np.uint64(32))
            short = key.astype(np.uint32)
            packed = [short[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)[of]), pa.array(packed, pa.binary())], ["cls", "runs"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (a, first_a), (c, first_c) = _binary(b.column(2), np.uint32), _binary(b.column(3), np.uint32)
            size_a, size_c = np.diff(first_a), np.diff(first_c)
            pair = np.repeat(np.arange(len(size_a), dtype=np.uint64), size_a)
            key = pair << np.uint64(32) | a
            against = np.repeat(np.arange(len(size_c), dtype=np.uint64), size_c) << np.uint64(32) | c
            at = np.minimum(np.searchsorted(against, key), max(len(against) - 1, 0))
            shared = np.bincount(pair[against[at] == key].astype(np.int64), minlength=len(size_a)) if len(against) else np.zeros(len(size_a), dtype=np.int64)
            union = size_a + size_c - shared
            # compared as whole numbers of a ten-thousandth, so that no rounding decides
            linked = np.flatnonzero(shared * 10_000 >= union * round(similarity * 10_000))
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(shared[linked] / np.maximum(union[linked], 1))], ["class_a", "class_b", "similarity"])

    whole = base.select("text").mapInArrow(sets, "cls long, runs binary").groupBy("cls").agg(F.first("runs").alias("runs"))
    left = whole.withColumnsRenamed({"cls": "class_a", "runs": "runs_a"})
    right = whole.withColumnsRenamed({"cls": "class_b", "runs": "runs_b"})
    both = candidates.join(left, "class_a").join(right, "class_b").select("class_a", "class_b", "runs_a", "runs_b")
    return both.mapInArrow(verify, "class_a long, class_b long, similarity double"), members


def expanded_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of different ids within one class or in two linked classes.

    A class of more than SPLIT members is dealt out by a hash of its ids, so that no task makes all of its pairs.
    """
    sizes = members.groupBy("class_id").count().where(F.col("count") > SPLIT)
    large = small_side(staged(sizes.select("class_id", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")), "large"))
    rows = members.join(large, "class_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = rows.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = rows.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = a.join(b, (F.col("class_a") == F.col("class_b")) & (a["part"] == b["part"])).where("x < y").select("x", "y")
    dealt = pairs.select("class_a", "class_b").join(large.withColumnRenamed("class_id", "class_a"), "class_a", "left")
    dealt = dealt.select("class_a", "class_b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = dealt.join(a, ["class_a", "part"]).select("class_b", "x").join(large.withColumnRenamed("class_id", "class_b"), "class_b", "left")
    met = met.select("class_b", "x", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    linked = met.join(b, ["class_b", "part"]).select("x", "y")
    return linked.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): every member with its connected component of linked classes (the least class) and the number of other members linked to it.

    Links are counted by class, never listed: the other members of the own class and all members of linked ones.
    """
    pairs, members = staged(pairs.select("class_a", "class_b"), "linked"), staged(members, "members")
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    beside = both.join(sizes.withColumnRenamed("class_id", "class_b"), "class_b").groupBy(F.col("class_a").alias("class_id")).agg(F.sum("n").alias("beside"))
    parts = components(pairs, "class_a", "class_b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    known = sizes.join(beside, "class_id", "left").join(parts, "class_id", "left")
    known = known.select("class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    return members.join(known, "class_id").select("id", "class_id", "group_id", "n_links")
