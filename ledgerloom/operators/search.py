"""The filtered search of many focuses over the chunks of their tickers, on Arrow batches: levels, augmentation, the reranker's best."""

from __future__ import annotations

from collections.abc import Iterator
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side

#: Stands for a null among whole numbers.
NONE = -(2**31)
#: Focuses that meet the chunks of their ticker together, at most; a ticker with over LEAST focuses is spread over up to SPREAD tasks.
BLOCK, LEAST, SPREAD = 16_384, 512, 8
#: Focuses searched at once, chunks looked at at once, and elements of a matrix of scores.
ASKING, COLUMNS, CELLS = 2048, 65_536, 1 << 22
#: Bytes of a group's numbers that a worker holds; what is more goes into an unlinked file.
HELD = 64 << 20
TIERS = {
    0: "Exact Match", 1: "Relaxed: No Quarter", 2: "Relaxed: No Year/Quarter", 3: "Relaxed: Ticker Only",
    11: "Augmented: No Quarter", 12: "Augmented: No Year/Quarter", 13: "Augmented: No Doc Type",
}
# kinds of documents
ANNUAL, QUARTERLY, CALL = 1, 2, 3


def focus_kind(doc_type: Column) -> Column:
    """0 for a type that doesn't restrict."""
    return F.when(doc_type == "10-K", ANNUAL).when(doc_type == "10-Q", QUARTERLY).when(doc_type == "Earnings Transcript", CALL).otherwise(0)


def chunk_kind(source_type: Column, filing_category: Column) -> Column:
    filing = source_type == "sec_filing"
    return F.when(filing & (filing_category == "10k"), ANNUAL).when(filing & (filing_category == "10q"), QUARTERLY).when(source_type == "earnings_transcript", CALL).otherwise(0)


def chunk_quarter(quarter: Column) -> Column:
    """n of a quarter written exactly Qn."""
    return F.when(quarter.rlike(r"^Q(?:0|-?[1-9]\d{0,8})\z"), F.substring(quarter, 2, 12).cast("int"))


class Kept:
    """Numbers that come in parts, kept in an unlinked file beyond HELD bytes."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.bytes, self.file = 0, None

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part)
        self.bytes += part.nbytes
        if self.bytes > HELD:
            self.file = self.file or TemporaryFile()
            for p in self.parts:
                self.file.write(np.ascontiguousarray(p).data)
            self.kind, self.parts, self.bytes = part.dtype, [], HELD

    def whole(self, width: int = 0) -> np.ndarray:
        if self.file is None:
            flat = np.concatenate([p.ravel() for p in self.parts]) if self.parts else np.zeros(0)
        else:
            for p in self.parts:
                self.file.write(np.ascontiguousarray(p).data)
            self.file.flush()
            flat = np.memmap(self.file, self.kind, "r")
        return flat.reshape(-1, width) if width else flat


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


class Group:
    """A block of focuses and all chunks of their ticker, each side in the order of its ids."""

    def __init__(self, dim: int) -> None:
        self.dim, self.q, self.asked = dim, [], []
        self.ids, self.facts, self.vectors, self.words, self.counts = [], [], Kept(), Kept(), []

    def add(self, batch: pa.RecordBatch) -> None:
        split = int(np.count_nonzero(numbers(batch, "side") == 0))
        if split:
            self.asked.append(batch.slice(0, split))
        if rows := batch.slice(split):
            self.ids.append(rows.column("id"))
            self.facts.append(np.stack([numbers(rows, n) for n in ("year", "quarter", "kind", "date_quarter")]))
            if self.dim:
                self.vectors.add(rows.column("v").flatten().to_numpy())
            self.words.add(rows.column("words").flatten().to_numpy())
            self.counts.append(pc.list_value_length(rows.column("words")).to_numpy())

    def closed(self) -> bool:
        """Whether both sides have rows; readies them."""
        if not self.asked or not self.ids:
            return False
        asked = pa.Table.from_batches(self.asked).combine_chunks()
        self.focus_ids, self.chunk_ids = asked.column("id").combine_chunks(), pa.chunked_array(self.ids)
        self.f = {n: asked.column(n).to_numpy() for n in ("year", "quarter", "kind", "date_quarter")}
        self.n = len(self.chunk_ids)
        self.year, self.quarter, self.kind, self.date_quarter = np.concatenate(self.facts, axis=1)
        self.p = self.vectors.whole(self.dim) if self.dim else np.zeros((self.n, 0))
        self.q = asked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, self.dim) if self.dim else np.zeros((len(asked), 0))
        self.has = self.words.whole()
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(self.counts), dtype=np.int64)])
        words = asked.column("words").combine_chunks()
        self.asks, self.ask_starts = words.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)])
        # near scores in single precision, of vectors scaled so that nothing overflows
        most = max((np.abs(self.p[i : i + COLUMNS]).max(initial=0.0) for i in range(0, self.n, COLUMNS)), default=0.0)
        near, longest = Kept(), 0.0
        self.finite = bool(np.isfinite(most) and np.isfinite(self.q).all())
        if self.finite and self.dim:
            for i in range(0, self.n, COLUMNS):
                part = (self.p[i : i + COLUMNS] / (most or 1.0)).astype(np.float32)
                longest = max(longest, float(np.sqrt((part.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)))
                near.add(part)
            self.near_p = near.whole(self.dim)
            scale = np.abs(self.q).max(axis=1, initial=0.0, keepdims=True)
            self.near_q = (self.q / np.where(scale > 0, scale, 1.0)).astype(np.float32)
            # twice the largest error of such a sum on both sides of a comparison
            self.margin = (self.dim + 8) * 2.4e-7 * longest * np.sqrt((self.near_q.astype(np.float64) ** 2).sum(axis=1))
        return True

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products summed in order in double precision."""
        out = np.zeros(len(r))
        for i in range(0, len(r) if self.dim else 0, COLUMNS):
            at = slice(i, i + COLUMNS)
            out[at] = np.cumsum(self.q[r[at]] * self.p[c[at]], axis=1)[:, -1]
        return out

    def best(self, rows: np.ndarray, cols: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(focus, chunk, score) of the ``m`` best of the chunks ``cols`` for each of the focuses ``rows``, in order; ties break by id.

        What near scores can't tell from the m-th best is scored exactly, so the result is that of exact scores throughout.
        """
        found = []
        for i in range(0, len(cols), COLUMNS):
            some = cols[i : i + COLUMNS]
            every = len(some) <= m or not self.finite or not self.dim
            near = None if every else self.near_p[some].T
            step = max(1, CELLS // len(some))
            for j in range(0, len(rows), step):
                own = rows[j : j + step]
                if every:
                    r, c = np.repeat(own, len(some)), np.tile(some, len(own))
                else:
                    s = self.near_q[own] @ near
                    least = np.partition(s, len(some) - m, axis=1)[:, len(some) - m] - self.margin[own]
                    r, c = np.nonzero(s >= least[:, None])
                    r, c = own[r], some[c]
                score = self.exact(r, c)
                found.append(self.first(r, c, score, m))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        r, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.first(r, c, score, m) if len(cols) > COLUMNS else (r, c, score)

    @staticmethod
    def first(r: np.ndarray, c: np.ndarray, score: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((c, -np.where(np.isnan(score), np.inf, score), r))
        order = order[places(r[order]) < m]
        return r[order], c[order], score[order]

    def level(self, rows: np.ndarray, year: np.ndarray, quarter: np.ndarray, kind: np.ndarray, m: int) -> list[np.ndarray]:
        """The ``m`` best of each focus under its filter of this level, then those that pass the post-filter; focuses with the same filter go together."""
        restricts = np.where(kind == CALL, quarter, NONE)
        years = np.where(year == 0, NONE, year)
        keys, at = np.unique(np.stack([years, restricts, kind]), axis=1, return_inverse=True)
        out = []
        for i, (y, q, k) in enumerate(keys.T):
            fits = np.ones(self.n, bool) if y == NONE else self.year == y
            if k:
                fits &= self.kind == k
            if q != NONE:
                fits &= self.quarter == q
            if len(cols := np.flatnonzero(fits)):
                out.append(self.best(rows[at.ravel() == i], cols, m))
        if not out:
            return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        r, c, score = (np.concatenate(x) for x in zip(*out, strict=True))
        wanted = np.full(len(self.q), NONE)
        wanted[rows] = np.where(kind == QUARTERLY, quarter, NONE)
        passes = (wanted[r] == NONE) | (self.date_quarter[c] == wanted[r])
        return [r[passes], c[passes], score[passes]]

    def searched(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(focus, level, chunk, score, rank): the first level with a result, filled up to ``k`` by augmentation as far as that is needed."""
        year, quarter, kind, typed = (self.f[n] for n in ("year", "quarter", "kind", "date_quarter"))
        none = lambda a: np.full(len(a), NONE)
        base, found = np.full(len(self.q), -1), []

        def take(level: int, some: np.ndarray, y: np.ndarray, q: np.ndarray, d: np.ndarray, m: int) -> np.ndarray:
            r, c, score = self.level(some, y, q, d, m)
            found.append((r, np.full(len(r), level), c, score))
            return np.unique(r)

        for level in range(4):
            some = rows[base[rows] < 0]
            some = some[(np.ones(len(some), bool), quarter[some] != NONE, year[some] != NONE, typed[some] == 1)[level]]
            y, q, d = year[some], quarter[some], kind[some]
            base[take(level, some, y if level < 2 else none(y), q if level < 1 else none(q), d if level < 3 else np.zeros_like(d), k)] = level
        # what the base level itself filters by
        f_year, f_quarter = np.where(base < 2, year, NONE), np.where(base < 1, quarter, NONE)
        f_typed = (base < 3) & (typed == 1)
        f_kind = np.where(base < 3, kind, 0)
        hits = self.merged(found, k)
        for level in (11, 12, 13):
            held = np.bincount(hits[0], minlength=len(self.q))
            some = rows[(base[rows] >= 0) & (held[rows] < k)]
            some = some[(f_quarter[some] != NONE, f_year[some] != NONE, f_typed[some])[level - 11]]
            y, q, d = f_year[some], f_quarter[some], f_kind[some]
            found = [hits[:4]]
            take(level, some, y if level != 12 else none(y), q if level == 13 else none(q), d if level != 13 else np.zeros_like(d), 2 * k)
            hits = self.merged(found, k)
        return hits

    def merged(self, found: list[tuple], k: int) -> tuple[np.ndarray, ...]:
        """Earlier levels first, each chunk once, the first ``k`` of each focus; the rows of one level are in order already."""
        r, level, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        _, once = np.unique(r * self.n + c, return_index=True)
        once.sort()
        once = once[np.argsort(r[once], kind="stable")]
        at = places(r[once])
        once, at = once[at < k], at[at < k]
        return r[once], level[once], c[once], score[once], at + 1

    def shares(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of each pair the share of the focus's words that the chunk has; 0.0 without words."""
        lo, hi = int(r.min(initial=len(self.q))), int(r.max(initial=-1)) + 1
        asked = self.asks[self.ask_starts[lo] : self.ask_starts[max(hi, lo)]]
        names = np.unique(asked)
        sizes = np.diff(self.ask_starts)
        wants = np.zeros((max(hi - lo, 0), len(names) + 1), bool)
        wants[np.repeat(np.arange(lo, max(hi, lo)), sizes[lo:hi]) - lo, np.searchsorted(names, asked)] = True
        wants[:, -1] = False
        # of the chunks met, the words that some focus asks for
        met, c_at = np.unique(c, return_inverse=True)
        out = np.zeros(len(r))
        flat, counts = ragged(self.starts, met)
        has = self.has[flat]
        at = np.minimum(np.searchsorted(names, has), max(len(names) - 1, 0))
        known = names[at] == has if len(names) else np.zeros(len(has), bool)
        per = np.bincount(np.repeat(np.arange(len(met)), counts)[known], minlength=len(met))
        words, starts = at[known], np.concatenate([[0], np.cumsum(per)])
        for i in range(0, len(r), COLUMNS):
            some = slice(i, i + COLUMNS)
            flat, counts = ragged(starts, c_at[some])
            hit = wants[np.repeat(r[some] - lo, counts), words[flat]]
            out[some] = np.bincount(np.repeat(np.arange(len(counts)), counts)[hit], minlength=len(counts))
        return np.divide(out, sizes[r], out=np.zeros(len(r)), where=sizes[r] > 0)

    def answers(self, k: int, final: int | None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.q), ASKING):
            r, level, c, score, rank = self.searched(np.arange(i, min(i + ASKING, len(self.q))), k)
            share = np.zeros(len(r))
            if final is not None:
                share = self.shares(r, c)
                # tier, then the reranker's score, then the former rank
                order = np.lexsort((rank, -share, np.digitize(level, (1, 10)), r))
                order = order[places(r[order]) < final]
                r, level, c, score, share = r[order], level[order], c[order], score[order], share[order]
                rank = places(r) + 1
            if len(r):
                ids = self.chunk_ids.take(pa.array(c)).combine_chunks()
                columns = [self.focus_ids.take(pa.array(r)), pa.array(rank.astype(np.int32)), pa.array(level.astype(np.int32)), ids, pa.array(score), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=["focus_idx", "rank", "level", "point_id", "score", "rerank_score"])


def places(sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal keys, from 0."""
    new = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return np.arange(len(sorted_keys)) - np.repeat(new, np.diff(np.append(new, len(sorted_keys))))


def ragged(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all elements of lists ``rows``, and how many each has."""
    counts = starts[rows + 1] - starts[rows]
    return np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum())), counts


def best_chunks(focuses: DataFrame, chunks: DataFrame, k: int, final: int | None = None) -> DataFrame:
    """(focus_idx, rank, level, point_id, score, rerank_score) of each focus's ``k`` chunks, or with ``final`` the so many best of them by tier and shared words.

    focuses (focus_idx, ticker, year, quarter, doc_type, query_vector, words), chunks (point_id, ticker, year, quarter, source_type,
    filing_category, date_quarter, vector, words); words are distinct numbers. Types of documents are canonical. Focuses go in blocks; each block
    meets all chunks of its ticker in one task, which holds their numbers in memory up to a bound and beyond it in a file. Null vectors, those with null
    coordinates and those of another length than the question's take no part.
    """
    whole = lambda c: F.coalesce(c.cast("int"), F.lit(NONE))
    good = lambda v: F.col(v).isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(False))
    wide = lambda v: F.col(v).cast("array<double>").alias("v")
    asked = focuses.where(good("query_vector")).withColumn("dim", F.size("query_vector"))
    blocks = asked.groupBy("ticker", "dim").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.lit(SPREAD), F.ceil(F.count("*") / LEAST))).cast("int").alias("blocks"))
    blocks = small_side(blocks)
    group = F.concat_ws(":", "block", "dim", "ticker").alias("g")
    side_f = asked.join(blocks, ["ticker", "dim"]).withColumn("block", F.pmod(F.xxhash64("focus_idx"), "blocks")).select(
        group, F.lit(0).alias("side"), F.col("focus_idx").cast("string").alias("id"), "dim", whole(F.col("year")).alias("year"), whole(F.col("quarter")).alias("quarter"), focus_kind(F.col("doc_type")).alias("kind"),
        F.col("doc_type").isNotNull().cast("int").alias("date_quarter"), wide("query_vector"), "words",
    )
    side_c = chunks.where(good("vector")).withColumn("dim", F.size("vector")).join(blocks, ["ticker", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        group, F.lit(1).alias("side"), F.col("point_id").cast("string").alias("id"), "dim", whole(F.col("year")).alias("year"), whole(chunk_quarter(F.col("quarter"))).alias("quarter"),
        chunk_kind(F.col("source_type"), F.col("filing_category")).alias("kind"), whole(F.col("date_quarter")).alias("date_quarter"), wide("vector"), "words",
    )
    parts = max(int(focuses.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    rows = side_f.unionByName(side_c).repartition(parts, "g").sortWithinPartitions("g", "side", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in batches:
            runs, start = pc.run_end_encode(batch.column("g")), 0
            for end, g in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if g != key:
                    if group is not None and group.closed():
                        yield from group.answers(k, final)
                    key, group = g, Group(batch.column("dim")[start].as_py())
                group.add(batch.slice(start, end - start))
                start = end
        if group is not None and group.closed():
            yield from group.answers(k, final)

    return rows.mapInArrow(search, "focus_idx string, rank int, level int, point_id string, score double, rerank_score double")
