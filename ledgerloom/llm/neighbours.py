"""The k most similar vectors of every vector: randomly rotated one-bit codes with error bounds, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

#: Vectors that a cell of the index is meant to hold.
CELL = 256
#: Cells at most: the centres are a sample of that size, the only part of the index that is fitted, kept by every worker (16 MB at 64 dimensions).
MAX_CELLS = 65_536
#: Stored vectors of a cell that one task looks through; those of larger cells are dealt out by hash.
SUBCELL = 4096
#: Cells that each vector is looked for in.
PROBES = 24
#: Standard errors that the bound of an estimated inner product spans.
SIGMAS = 3.0
#: Cosines from which on the cells are searched; neighbours below lie in any cell, so the codes of all vectors are looked through.
CELLS_FROM = 0.85
#: Codes of each vector, by rotations of their own, where all are looked through: their mean estimates with half the error of one.
CODES = 4
#: Vectors that ask at once where all are looked through.
ASKERS = 8192
#: Rows of a cell that are compared at once with as many others.
SLAB = 2048


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation: the orthogonal part of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def one_bit(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction): the correction is the inner product of a unit vector with its code of length 1."""
    signs = rotated > 0
    align = np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])
    return np.packbits(signs, axis=1), align.astype(np.float32)


def estimates(bits: np.ndarray, align: np.ndarray, queries: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products [queries, codes], error bounds [codes]) from packed bits and corrections.

    The code's inner product with the query, divided by the correction, is an unbiased estimate; its standard error falls with
    the root of the dimension and grows as the code leaves its vector.
    """
    code = np.unpackbits(bits, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    scale = (1 / (np.sqrt(dim) * align)).astype(np.float32)
    return (queries @ code.T) * scale, error_of(align, dim)


def error_of(align: np.ndarray, dim: int) -> np.ndarray:
    """What SIGMAS standard errors of an estimate from one code come to."""
    return (SIGMAS * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(max(dim - 1, 1))).astype(np.float32)


def valid_vectors(points: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v array<float>, asks): rows with an id and a vector of ``dim`` numbers, none NaN or infinite, not all zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("float"))
    good = (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    asks = F.col("_asks") if "_asks" in points.columns else F.lit(True)
    return points.select(F.col(id_col).cast("string").alias("id"), v.alias("v"), asks.alias("asks")).where("id is not null and v is not null").where(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def looked_through(reps: DataFrame, total: int, askers: int, k: int, min_cosine: float, dim: int) -> DataFrame:
    """(a, b) from (rep, v, asks): for every asking vector its ``k`` best others of each part of the vectors, chosen by one-bit codes.

    The vectors are dealt into parts and the asking ones into blocks; a task holds one block's vectors and their best so far, and a
    part's vectors pass it in slabs. Of each slab, inner products are estimated from CODES one-bit codes a vector; vectors whose upper
    bound reaches the asking one's k-th best so far are ranked by the exact inner product, all others are dropped unseen.
    """
    blocks = max(1, -(-askers // ASKERS))
    parts = max(1, -(-total // ASKERS))
    dealt = reps.select("rep", "v", "asks", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int").alias("own"), F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(parts)).cast("int").alias("mine"))
    asking = dealt.where("asks").select(F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).cast("byte").alias("role"), "rep", "v")
    passing = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("mine").alias("part"), F.lit(1).cast("byte").alias("role"), "rep", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = [rotation(dim, 7 + c) for c in range(CODES)]
        at, asked, owners, q, turned, owner, score, found = None, [], [], None, None, None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if score is not None:
                i, j = np.nonzero(score > -2)
                yield pa.RecordBatch.from_arrays([pa.array(owner[i]), pa.array(found[i, j])], ["a", "b"])

        def rank(rows: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
            """The exact inner products of the pairs (i, j), i in order, into the best of the rows."""
            exact = np.einsum("ij,ij->i", q[rows[i]], x[j])
            cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(i)), strict=True):
                r = rows[i[lo]]
                near, who = np.concatenate([score[r], exact[lo:hi]]), np.concatenate([found[r], ids[j[lo:hi]]])
                top = np.argpartition(-near, k - 1)[:k]
                score[r], found[r] = near[top], who[top]

        def look(x: np.ndarray, ids: np.ndarray) -> None:
            coded = [one_bit(x @ t.T) for t in turns]
            error = np.sqrt(sum(error_of(align, dim) ** 2 for _, align in coded)) / CODES
            for s in range(0, len(q), SLAB):
                rows = np.arange(s, min(s + SLAB, len(q)))
                est = sum(estimates(bits, align, turned[c][rows], dim)[0] for c, (bits, align) in enumerate(coded)) / CODES
                est[owner[rows][:, None] == ids[None, :]] = -9
                new = np.flatnonzero(score[rows].min(axis=1) <= -2)
                if len(new):
                    # a first bound for rows that have none yet: the best by estimate
                    take = min(k, est.shape[1])
                    best = np.sort(np.argpartition(-est[new], take - 1, axis=1)[:, :take], axis=1)
                    keep = np.take_along_axis(est[new], best, axis=1) > -9
                    i, j = np.repeat(new, take)[keep.ravel()], best.ravel()[keep.ravel()]
                    if len(i):
                        rank(rows, i, j, x, ids)
                        est[i, j] = -9
                bound = np.maximum(score[rows].min(axis=1), min_cosine - 1e-6)
                i, j = np.nonzero((est + error[None, :] >= bound[:, None]) & (est > -9))
                if len(i):
                    rank(rows, i, j, x, ids)

        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            roles, ids = b.column(2).to_numpy(), b.column(3).to_numpy()
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (roles[1:] != roles[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                if key[lo] != at:
                    yield from done()
                    at, asked, owners, score = key[lo], [], [], None
                x = _matrix(b.column(4).slice(lo, hi - lo), dim)
                if roles[lo] == 0:
                    asked.append(x)
                    owners.append(ids[lo:hi])
                    continue
                if not asked:
                    continue
                if score is None:
                    q, owner = np.concatenate(asked), np.concatenate(owners)
                    turned = [q @ t.T for t in turns]
                    score, found = np.full((len(q), k), -2, np.float32), np.zeros((len(q), k), np.int64)
                for t in range(0, hi - lo, SLAB):
                    look(x[t : t + SLAB], ids[lo:hi][t : t + SLAB])
        yield from done()

    dealt_rows = asking.unionByName(passing).repartition("block", "part").sortWithinPartitions("block", "part", "role")
    return dealt_rows.mapInArrow(compare, "a long, b long")


def nearest(points: DataFrame, k: int = 10, min_cosine: float = -1.0, id_col: str = "id", vector_col: str = "vector", dim: int = 64, probes: int = PROBES, asking: Column | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for every vector, or every ``asking`` one, the ``k`` most similar others of cosine ``min_cosine`` or more.

    Equal vectors are one representative through the search; afterwards each id gets neighbours of its own, with ties
    in cosine broken by id. The index has cells around a sample of the vectors (a bounded one, ordered by hash, so
    dense regions get cells in proportion); every vector is coded and stored in the cell of its best centre, and looked for in
    the cells of its best ``probes`` centres. Large cells are dealt out over tasks. In a cell inner products are estimated from the codes; what an upper bound
    can't bring to ``min_cosine`` is dropped, and the rest is ranked by the exact cosine. Below ``CELLS_FROM`` a
    neighbour may lie in any cell, so the codes of all vectors are looked through for each asking one, in blocks. Null, short, long, zero, NaN
    or infinite vectors take no part; an id given twice is one vector of each of its values; an empty table gives no row.
    """
    spark = points.sparkSession
    asks = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    unit = valid_vectors(points.withColumn("_asks", asks), id_col, vector_col, dim)
    length = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # vector and length are held, else each coordinate would compute both again
    held = F.transform(F.array("v"), lambda u: F.struct(u.alias("v"), length(u).alias("n")))
    scaled = F.get(F.transform(held, lambda h: F.transform(h["v"], lambda x: (x.cast("double") / h["n"]).cast("float"))), 0)
    rows = unit.select("id", "asks", F.xxhash64("v").alias("rep"), "v")
    members = staged(rows.groupBy("id", "rep").agg(F.max("asks").alias("asks")), "members")
    reps = staged(rows.groupBy("rep").agg(F.first("v").alias("v"), F.max("asks").alias("asks")).select("rep", scaled.alias("v"), "asks"), "vectors")
    total = reps.count()
    if min_cosine < CELLS_FROM:
        return _ranked(looked_through(reps, total, reps.where("asks").count(), k, min_cosine, dim), reps, members, k, min_cosine, False)
    cells = int(min(MAX_CELLS, max(1, total // CELL)))
    sample = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(cells).toArrow()
    turn = rotation(dim)
    centres = (_matrix(sample.column("v").combine_chunks(), dim) if total else np.zeros((0, dim), np.float32)) @ turn.T
    placing = spark.sparkContext.broadcast((turn, centres))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = placing.value
        for b in batches:
            x = _matrix(b.column(0), dim) @ turn.T
            best = np.concatenate([(x[s : s + SLAB] @ centres.T).argmax(axis=1) for s in range(0, len(x), SLAB)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32))], ["cell"])

    # at most as many rows as there are cells reach the driver
    crowded = reps.select("v").mapInArrow(home, "cell int").groupBy("cell").count().where(F.col("count") > SUBCELL).collect() if total else []
    split = np.ones(max(cells, 1), dtype=np.int64)
    for r in crowded:
        split[r["cell"]] = -(-r["count"] // SUBCELL)
    shared = spark.sparkContext.broadcast((turn, centres, split))
    take = min(probes, max(len(centres), 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres, split = shared.value
        for whole in batches:
            for s in range(0, len(whole), SLAB):
                b = whole.slice(s, SLAB)
                x = _matrix(b.column(1), dim) @ turn.T
                score = x @ centres.T
                best = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(x), 1))
                home = score.argmax(axis=1)
                bits, align = one_bit(x)
                # queries keep 8 bits a coordinate
                top = np.abs(x).max(axis=1)
                fine = np.rint(x / top[:, None] * 127).astype(np.int8)
                rep = b.column(0)
                # stored ones keep their bits, 8 bits a coordinate and the step of those
                steps = (top / 127).astype(np.float32)
                stored = pa.array([r.tobytes() for r in np.concatenate([bits, fine.view(np.uint8), steps.view(np.uint8).reshape(-1, 4)], axis=1)], pa.binary())
                sub = rep.to_numpy(zero_copy_only=False) % split[home]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(sub.astype(np.int32)), pa.array(np.zeros(len(x), np.int8)), rep, pa.array(align), stored], names)
                asked = pa.array([r.tobytes() for r in fine], pa.binary())
                # a cell that is dealt out is asked in each of its parts
                at, cell = np.repeat(np.arange(len(x)), best.shape[1]), best.ravel()
                again = split[cell]
                at, cell = np.repeat(at, again), np.repeat(cell, again)
                part = np.arange(len(cell)) - np.repeat(np.cumsum(again) - again, again)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(at), np.int8)), rep.take(pa.array(at)), pa.array(steps[at]), asked.take(pa.array(at))], names)

    names = ["cell", "sub", "role", "rep", "scale", "code"]
    placed = reps.select("rep", "v").mapInArrow(assign, "cell int, sub int, role byte, rep long, scale float, code binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, stored ones first; of a cell the codes are held, queries pass in slabs.

        What the bits leave is looked at with 8 bits a coordinate; rounding moves an inner product by no more than half the steps
        times the root of the dimension, so what falls below by that much is dropped as well.
        """
        cell, codes, owners, aligns = None, [], [], []
        width = -(-dim // 8)
        for b in batches:
            cs, roles = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            reps_, scales = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (cs[1:] != cs[:-1]) | (roles[1:] != roles[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(cs)), strict=True):
                if cs[lo] != cell:
                    cell, codes, owners, aligns = cs[lo], [], [], []
                raw = np.frombuffer(b"".join(b.column(5).slice(lo, hi - lo).to_pylist()), dtype=np.uint8)
                if roles[lo] == 0:
                    codes.append(raw.reshape(hi - lo, -1))
                    owners.append(reps_[lo:hi])
                    aligns.append(scales[lo:hi])
                elif owners:
                    packed, owner, align = np.concatenate(codes), np.concatenate(owners), np.concatenate(aligns)
                    codes, owners, aligns = [packed], [owner], [align]
                    bits, fine = packed[:, :width], packed[:, width : width + dim].view(np.int8)
                    steps = np.ascontiguousarray(packed[:, width + dim :]).view(np.float32).ravel()
                    q = raw.view(np.int8).reshape(hi - lo, dim).astype(np.float32) * scales[lo:hi, None]
                    for s in range(0, hi - lo, SLAB):
                        for t in range(0, len(owner), SLAB):
                            est, err = estimates(bits[t : t + SLAB], align[t : t + SLAB], q[s : s + SLAB], dim)
                            asker, target = reps_[lo + s : min(hi, lo + s + SLAB)], owner[t : t + SLAB]
                            i, j = np.nonzero((est + err >= min_cosine) & (asker[:, None] != target[None, :]))
                            near = np.einsum("ij,ij->i", q[s + i], fine[t + j].astype(np.float32)) * steps[t + j]
                            keep = near + (scales[lo + s + i] + steps[t + j]) * (0.51 * np.sqrt(dim)) >= min_cosine
                            i, j = i[keep], j[keep]
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(asker[i]), pa.array(target[j])], ["a", "b"])

    sorted_cells = placed.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "role")
    hits = sorted_cells.mapInArrow(search, "a long, b long")
    # either of a pair may have found the other; the pair serves both
    hits = hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _ranked(hits, reps, members, k, min_cosine, True)


def _ranked(hits: DataFrame, reps: DataFrame, members: DataFrame, k: int, min_cosine: float, mutual: bool) -> DataFrame:
    """(id, neighbour, cosine, rank) from candidate pairs of representatives, ``mutual`` ones serving both."""
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    va, vb = reps.select(F.col("rep").alias("a"), F.col("v").alias("va")), reps.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    exact = hits.select("a", "b").join(va, "a").join(vb, "b").select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= min_cosine)
    both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).distinct() if mutual else exact
    # an id's own class offers its k + 1 first ids, other classes their k first: more can't be among k neighbours
    counted = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    offered = counted.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    shortlist = both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k).select("a", "b", "cosine")
    foreign = shortlist.join(offered.withColumnRenamed("rep", "b"), "b").select("a", F.explode(F.slice("ids", 1, k)).alias("neighbour"), "cosine")
    ranked = foreign.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k)
    options = ranked.groupBy(F.col("a").alias("rep")).agg(F.collect_list(F.struct("cosine", "neighbour")).alias("other"))
    joined = members.where("asks").join(offered, "rep").join(options, "rep", "left")
    mine = F.transform(F.filter("ids", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(1.0).alias("cosine"), x.alias("neighbour")))
    ordered = F.sort_array(F.transform(F.concat(mine, F.coalesce("other", F.array().cast("array<struct<cosine:double,neighbour:string>>"))), lambda x: F.struct((-x["cosine"]).alias("d"), x["neighbour"].alias("n"))))
    top = joined.select("id", F.posexplode(F.slice(ordered, 1, k)).alias("r", "x"))
    return top.select("id", F.col("x.n").alias("neighbour"), (-F.col("x.d")).alias("cosine"), (F.col("r") + 1).alias("rank")).where(F.col("cosine") >= min_cosine)
