"""Nearest neighbours by score-aware (anisotropic) quantisation, four-bit table scans and exact reranking.

Euclidean distance becomes a maximum inner product: with a vector x and the query q, the nearest x has the largest
q.x - |x|^2 / 2, the product of (q, 1) and (x, -|x|^2 / 2). Such products are what quantisation must keep, so a
vector's residual counts for more along the vector than across it: with the parallel part weighted by ETA, code
words and codes are fitted to the anisotropic loss in turn, on a bounded sample. Every row is then coded with 16
code words for each pair of dimensions, two codes a byte.

Coarse cells: each row goes to the nearest of at most MOST_CELLS centres (fitted on the same sample), and large cells are cut
into blocks of BLOCK rows. Queries are gathered by cell, too, QUERIES at most together. They search their own cell first;
the k-th distance found is a bound. By the triangle inequality, only cells whose radius reaches within that bound can
hold anything nearer: those are searched next, and no others. Nothing is lost: where cells don't part the vectors, all are searched.

In a block, queries are scanned against codes by tables of 16 partial products a subspace. Where there is no bound yet, the
best RERANK of the block are scored exactly in double precision, and their k-th distance is one. By Cauchy-Schwarz a row's
product is off its approximate score by |q, 1| times the row's own residual norm at most: every row that may lie within the
bound is scored exactly, however many there are, so a block's best k are its true ones. Results are merged FEW
blocks at a time. So no task holds more than a block of either side, and copies of one vector are spread like other
rows.

Ties go to the smaller vec_id, so that copies of a vector are found in that order.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, or whose length isn't
the commonest length (the largest of equally common ones), and rows whose vec_id is null, take no part; rows of
equal vec_id are one candidate each, and a query leaves out all rows of its own vec_id; equal query rows are one
query; an empty table gives an empty table; columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged, table

QUERY_EVERY, K = 100, 10
#: Rows on which the code words are fitted at most; rounds of the fit.
FIT_ROWS, ROUNDS = 8_192, 8
#: Dimensions of a subspace; weight of the parallel part of the residual.
WIDTH, ETA = 2, 1.5
#: Codes and queries in a block; rows of a block of codes whose k-th distance is the bound for all others.
BLOCK, QUERIES, RERANK = 16_384, 8_192, 400
#: Cells at most, and rows of a cell on average at least; rounds of their fit; blocks whose results are merged at once.
MOST_CELLS, CELL_ROWS, CELL_ROUNDS, FEW = 256, 4_096, 10, 64
#: Rows that are measured at once.
ROWS = 4_096
CODES = 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").try_cast("long").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").try_cast("long").alias("vec_id"), v.alias("v")).where(
        F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    return rows


def extended(x: np.ndarray) -> np.ndarray:
    """(x, -|x|^2 / 2), padded to whole subspaces."""
    out = np.column_stack([x, -0.5 * (x * x).sum(axis=1)])
    return np.pad(out, ((0, 0), (0, -out.shape[1] % WIDTH)))


class Quantiser:
    """CODES code words for each subspace, fitted to the anisotropic loss
    |r|^2 + (ETA - 1) (r.x)^2 / |x|^2 of the residual r of x."""

    def __init__(self, x: np.ndarray):
        self.spaces = x.shape[1] // WIDTH
        rng = np.random.default_rng(7)
        first = x[rng.choice(len(x), CODES, replace=len(x) < CODES)]
        self.words = first.reshape(CODES, self.spaces, WIDTH).transpose(1, 0, 2).copy()
        for _ in range(ROUNDS):
            codes = self.encode(x)
            self._refit(x, codes)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(self.spaces), codes].reshape(len(codes), -1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent: each subspace in turn takes the word of least loss, the others as they are."""
        parts = x.reshape(len(x), self.spaces, WIDTH)
        norm = np.maximum((x * x).sum(axis=1), 1e-12)
        codes = np.empty((len(x), self.spaces), np.uint8)
        # squared distances and products with x of all words, subspace by subspace
        apart = [((parts[:, s, None, :] - self.words[s]) ** 2).sum(axis=2) for s in range(self.spaces)]
        along = [((parts[:, s, None, :] - self.words[s]) * parts[:, s, None, :]).sum(axis=2) for s in range(self.spaces)]
        every = np.arange(len(x))
        for s in range(self.spaces):
            codes[:, s] = apart[s].argmin(axis=1)
        total = sum(along[s][every, codes[:, s]] for s in range(self.spaces))
        for _ in range(2):
            for s in range(self.spaces):
                rest = total - along[s][every, codes[:, s]]
                loss = apart[s] + (ETA - 1) * (rest[:, None] + along[s]) ** 2 / norm[:, None]
                codes[:, s] = loss.argmin(axis=1)
                total = rest + along[s][every, codes[:, s]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Words of least loss for the codes, one subspace after another: small weighted least squares."""
        parts = x.reshape(len(x), self.spaces, WIDTH)
        norm = np.maximum((x * x).sum(axis=1), 1e-12)
        residual = x - self.decode(codes)
        total = (residual * x).sum(axis=1)
        for s in range(self.spaces):
            own, p = codes[:, s], parts[:, s]
            here = ((p - self.words[s][own]) * p).sum(axis=1)
            rest = total - here
            scale = (ETA - 1) / norm
            for c in range(CODES):
                m = own == c
                if not m.any():
                    continue
                q, k = p[m], scale[m]
                # minimise |q - w|^2 + k (rest + (q - w).q)^2 over w
                left = m.sum() * np.eye(WIDTH) + (q * k[:, None]).T @ q
                right = q.sum(axis=0) + ((k * (rest[m] + (q * q).sum(axis=1)))[:, None] * q).sum(axis=0)
                self.words[s, c] = np.linalg.solve(left, right)
            total = rest + ((p - self.words[s][own]) * p).sum(axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial products (queries, spaces, CODES) of extended queries."""
        return np.einsum("qsw,scw->qsc", q.reshape(len(q), self.spaces, WIDTH), self.words).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes of four bits a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack(packed: np.ndarray, spaces: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, :spaces]


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate products (queries, vectors): a table look-up for each packed byte, of the sums of its two codes."""
    n, spaces = len(tables), tables.shape[1]
    if spaces % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    both = (tables[:, ::2, None, :] + tables[:, 1::2, :, None]).reshape(n, -1, 256)
    out = np.zeros((n, len(packed)), np.float32)
    for s in range(packed.shape[1]):
        out += both[:, s][:, packed[:, s]]
    return out


def _block_search(quantiser: Quantiser, k: int):
    """Best k of one block of codes for one block of queries. limit: distances within which each query's nearest are."""

    def distances(x, rows, q):
        return np.concatenate([np.sqrt(((x[rows[a : a + ROWS]] - q) ** 2).sum(axis=1)) for a in range(0, max(1, len(rows)), ROWS)])

    def search(q_ids, q, ids, x, packed, limit=None):
        limit = np.full(len(q), np.inf) if limit is None else limit
        order = np.argsort(ids, kind="stable")
        ids, x, packed = ids[order], x[order], packed[order]
        ext = np.column_stack([q, np.ones(len(q))])
        ext = np.pad(ext, ((0, 0), (0, quantiser.spaces * WIDTH - ext.shape[1])))
        parts = [slice(a, a + ROWS) for a in range(0, len(ids), ROWS)]
        error = np.concatenate([np.linalg.norm(extended(x[p]) - quantiser.decode(unpack(packed[p], quantiser.spaces)), axis=1) for p in parts])
        long, squares = np.linalg.norm(ext, axis=1), (x * x).sum(axis=1)
        # what rounding adds: to squared distances and products in double precision, and to sums of tables in single precision
        double = 4 * (x.shape[1] + 4) * 2.0**-52 * (long + np.sqrt(squares.max())) ** 2
        out = []
        for a in range(0, len(q), 64):
            at = np.arange(a, min(a + 64, len(q)))
            tables = quantiser.tables(ext[at])
            near = scan(tables, packed)
            single = (quantiser.spaces + 4) * 2.0**-23 * np.abs(tables).max(axis=2).sum(axis=1)
            bound = limit[at] ** 2
            may = np.empty(near.shape, bool)
            for i, score in zip(at, near, strict=True):
                score[ids == q_ids[i]] = -np.inf
                if not np.isfinite(bound[i - a]):
                    take = min(max(RERANK, k), len(ids))
                    first = np.argpartition(score, len(ids) - take)[len(ids) - take :]
                    first = first[ids[first] != q_ids[i]]
                    if len(first) >= k:
                        bound[i - a] = np.partition(distances(x, first, q[i]), k - 1)[k - 1] ** 2
                # |q - x|^2 = |q|^2 - 2 ((q, 1).(x, -|x|^2 / 2)); what isn't a number may be near
                least = ((q[i] ** 2).sum() - bound[i - a]) / 2 - double[i] - single[i - a]
                may[i - a] = ~(score + long[i] * error < least)
            # rows that may be near a query, measured for all queries at once; those within the bound and rounding, once more each
            found = [[] for _ in at]
            some = np.flatnonzero(may.any(axis=0))
            for rows in (some[b : b + ROWS] for b in range(0, len(some), ROWS)):
                apart = (q[at] ** 2).sum(axis=1)[:, None] + squares[rows] - 2 * (q[at] @ x[rows].T)
                for i, within in enumerate(may[:, rows] & ~(apart > (bound + double[at])[:, None])):
                    found[i].append(rows[within])
            for i, rows in zip(at, found, strict=True):
                cand = np.concatenate([*rows, np.empty(0, np.intp)])
                cand = cand[ids[cand] != q_ids[i]]
                d = distances(x, cand, q[i])
                best = np.lexsort((ids[cand], d))[:k]
                out += [(q_ids[i], ids[cand[b]], d[b]) for b in best]
        return out

    return search


def fit_cells(x: np.ndarray, n: int) -> np.ndarray:
    """n centres or fewer, by Lloyd's rounds."""
    centres = x[np.random.default_rng(11).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(CELL_ROUNDS if len(centres) > 1 else 0):
        cell, _ = cells_of(x, centres)
        centres = np.array([x[cell == c].mean(axis=0) for c in range(len(centres)) if (cell == c).any()])
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    apart = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    cell = apart.argmin(axis=1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def _vectors(t, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), np.float64).reshape(t.num_rows, -1)


def _best(near: DataFrame, k: int, blocks: int) -> DataFrame:
    """query_id, part, vec_id, score of the k smallest of each query; near has a part from 0 to blocks - 1, and k rows of each at
    most. FEW parts are merged at once, in as many levels as that takes."""
    while True:
        near = near.withColumn("part", F.floor(F.col("part") / FEW).cast("int"))
        # FEW times k rows at most
        best = near.groupBy("query_id", "part").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("b"))
        near = best.select("query_id", "part", F.posexplode("b").alias("i", "b")).select("query_id", "part", "i", F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
        blocks = -(-blocks // FEW)
        if blocks == 1:
            return near


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == length["n"])
    # a bounded sample for the fit, the same in every run
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toPandas()["v"]
    sample = np.array(sample.tolist(), np.float64)
    quantiser, centres = Quantiser(extended(sample)), fit_cells(sample, max(1, min(MOST_CELLS, length["count"] // CELL_ROWS)))

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("v").to_pylist(), np.float64)
                codes, (cell, far) = pack(quantiser.encode(extended(x))), cells_of(x, centres)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "x", "code", "cell", "far"])

    coded = staged(rows.mapInArrow(encode, "vec_id long, x binary, code binary, cell int, far double"), "codes")
    queries = staged(coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "cell")).alias("m")).select("vec_id", "m.*"), "queries")
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    # a row a cell: MOST_CELLS at most
    sizes = sizes.join(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("q")), "cell", "left").orderBy("cell").collect()
    radius, place, block, q_block = {}, [], 0, 0
    for r in sizes:
        n, q = -(-r["n"] // BLOCK), -(-(r["q"] or 0) // QUERIES)
        place.append((r["cell"], block, n, q_block, q))
        radius[r["cell"]], block, q_block = r["radius"], block + n, q_block + q
    places = F.broadcast(spark.createDataFrame(place, "cell int, b0 int, bn int, q0 int, qn int"))
    spread = lambda first, n, *by: F.col(first) + F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    coded = coded.join(places, "cell").withColumn("block", spread("b0", "bn", "vec_id", "x"))
    queries = queries.join(places, "cell").withColumn("q_block", spread("q0", "qn", "vec_id"))
    search, spans = _block_search(quantiser, k), {c: (b0, bn) for c, b0, bn, *_ in place}
    upto = lambda first, n: F.when(F.col(n) > 0, F.sequence(F.col(first), F.col(first) + F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def both(left, right):
        q = v = d = []
        if left.num_rows and right.num_rows:
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            found = search(right.column("vec_id").to_numpy(), _vectors(right, "x"), left.column("vec_id").to_numpy(), _vectors(left, "x"), code, right.column("limit").to_numpy())
            q, v, d = zip(*found, strict=True) if found else ([], [], [])
        part = left.column("block")[0].as_py() if left.num_rows else 0
        return pa.table({"query_id": pa.array(q, pa.int64()), "part": pa.array([part] * len(q), pa.int32()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.float64())})

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        """left: coded with q_block; right: queries with limit and block."""
        left, right = left.select("block", "q_block", "vec_id", "x", "code"), right.select("block", "q_block", "vec_id", "x", "limit")
        return left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInArrow(both, "query_id long, part int, vec_id long, score double")

    # their own cells: each block of codes once for each block of the cell's queries, and each query once for each block
    near = searched(coded.withColumn("q_block", F.explode(upto("q0", "qn"))), queries.withColumn("limit", F.lit(float("inf"))).withColumn("block", F.explode(upto("b0", "bn"))))
    near = _best(near, k, block)
    if len(place) > 1:
        near = staged(near, "near")
        limits = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).otherwise(float("inf")).alias("limit"))

        def reached(batches):
            """The blocks of all other cells that reach within a query's limit."""
            names = sorted(spans)
            for batch in batches:
                x = _vectors(batch, "x") if batch.num_rows else np.zeros((0, centres.shape[1]))
                limit, out = batch.column("limit").to_numpy(zero_copy_only=False), []
                for i, own in enumerate(batch.column("cell").to_pylist()):
                    apart = np.sqrt(((centres[names] - x[i]) ** 2).sum(axis=1))
                    # beyond what rounding may add
                    out.append([c for c, d in zip(names, apart, strict=True) if c != own and d - radius[c] <= limit[i] + 1e-9 * (d + radius[c])])
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("vec_id", "x", "q_block", "limit")), pa.array(out, pa.list_(pa.int32()))], ["vec_id", "x", "q_block", "limit", "cells"])

        asked = queries.join(limits, queries["vec_id"] == limits["query_id"], "left").select("vec_id", "x", "q_block", "cell", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        asked = staged(asked.mapInArrow(reached, "vec_id long, x binary, q_block int, limit double, cells array<int>"), "asked")
        asked = asked.withColumn("cell", F.explode("cells")).drop("cells")
        # MOST_CELLS rows, each with the blocks of queries that ask for the cell
        wanted = F.broadcast(asked.groupBy("cell").agg(F.collect_set("q_block").alias("q_blocks")))
        right = asked.join(places, "cell").withColumn("block", F.explode(upto("b0", "bn")))
        more = searched(coded.join(wanted, "cell").withColumn("q_block", F.explode("q_blocks")), right)
        # the own cell's results are one part more
        near = _best(more.unionByName(near.select("query_id", F.lit(block).alias("part"), "vec_id", "score")), k, block + 1)
    return near.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "vec_id", "score")


def op5_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
