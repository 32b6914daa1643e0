"""Approximate nearest neighbours by cosine: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors of unit length make the largest cosine a maximum inner product. Each pair of dimensions has sixteen centres;
codes and centres minimise eta * |parallel residual|^2 + |orthogonal residual|^2, as an error along a vector disturbs
the scores of its near queries most. ``eta`` follows from the least cosine that matters. Codes are found by coordinate
descent over the subspaces, centres by the normal equations over all subspaces at once.

The index has a row for each vector: its codes, two in a byte, and the length of its residual. Queries meet every
block of the index. A block is scanned with one table of 256 sums for each byte of the codes; the estimate differs from
the cosine by at most the residual's length, and by its length over the root of the dimension as a standard deviation.
All rows whose estimate plus ``slack`` such deviations reaches the query's k-th exact cosine so far are ranked by their
original vectors: there is no cap on candidates, near copies with equal codes are all ranked, and a slack of the root
of the dimension gives the exact neighbours.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as do rows
without id and vectors of another than the most frequent length (of equally frequent ones, the least). Of rows with
one id the one with the least vector counts. Candidates are the rows of all other ids; equal cosines go by the smaller
id. Queries without candidates have no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .batches import matrix

#: Vectors that the centres are fitted on, rounds, the least cosine that matters, rows of a block, rows and queries of a scan.
SAMPLE, ROUNDS, LEAST_COSINE, BLOCK, SCAN_ROWS, SCAN_QUERIES = 8192, 6, 0.2, 1 << 15, 4096, 128
CENTRES, WIDTH = 16, 2
SLACK = 3.0


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows scaled by powers of two so that squares stay finite, their lengths, and their unit vectors."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -exponent[:, None])
    length = np.sqrt((x * x).sum(axis=1))
    return x, length, x / length[:, None]


@dataclass
class Quantiser:
    """Centres (subspaces, 16, 2) and the weight of parallel errors."""

    centres: np.ndarray
    eta: float

    def _split(self, unit: np.ndarray) -> np.ndarray:
        pad = self.centres.shape[0] * WIDTH - unit.shape[1]
        return np.pad(unit, ((0, 0), (0, pad))).reshape(len(unit), -1, WIDTH)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """The code of each row in each subspace: the nearest centres, then coordinate descent on the weighted loss."""
        x = self._split(unit)
        m = x.shape[1]
        plain = np.empty((m, len(x), CENTRES))  # squared residuals
        along = np.empty((m, len(x), CENTRES))  # residuals along the vector
        for k in range(m):
            rest = x[:, k, None, :] - self.centres[k][None]
            plain[k] = (rest * rest).sum(2)
            along[k] = (rest * x[:, k, None, :]).sum(2)
        codes = plain.argmin(2).astype(np.uint8)
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for k in range(m):
            total += along[k][rows, codes[k]]
        for _ in range(sweeps):
            for k in range(m):
                total -= along[k][rows, codes[k]]
                loss = plain[k] + (self.eta - 1) * (total[:, None] + along[k]) ** 2
                codes[k] = loss.argmin(1)
                total += along[k][rows, codes[k]]
        return np.ascontiguousarray(codes.T)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The quantised vectors of codes."""
        m = codes.shape[1]
        return self.centres[np.arange(m)[None], codes].reshape(len(codes), m * WIDTH)

    def residuals(self, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what the codes leave out of each row."""
        rest = self._split(unit).reshape(len(unit), -1) - self.decode(codes)
        return np.sqrt((rest * rest).sum(1))

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """For each byte of packed codes, each of its 256 values and each query the sum of its two products."""
        q = self._split(unit)
        each = np.einsum("qmw,mcw->mcq", q, self.centres).astype(np.float32)
        if len(each) % 2:
            each = np.concatenate([each, np.zeros_like(each[:1])])
        return (each[0::2, :, None] + each[1::2, None, :]).reshape(len(each) // 2, CENTRES * CENTRES, -1)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def fit(sample: np.ndarray, rounds: int = ROUNDS, least_cosine: float = LEAST_COSINE) -> Quantiser:
    """Centres for a sample of vectors (one at least); the same for the same sample."""
    unit = unit_rows(np.asarray(sample, float))[2]
    n, d = unit.shape
    m = -(-d // WIDTH)
    eta = max(1.0, (d - 1) * least_cosine**2 / (1 - least_cosine**2))
    model = Quantiser(np.zeros((m, CENTRES, WIDTH)), eta)
    x = model._split(unit)
    model.centres = x[np.linspace(0, n - 1, CENTRES).astype(int)].transpose(1, 0, 2).copy()
    model.centres += 1e-6 * np.arange(CENTRES)[None, :, None]  # repeated vectors: centres that differ
    size = m * CENTRES * WIDTH
    for _ in range(rounds):
        codes = model.encode(unit)
        at = (np.arange(m) * CENTRES + codes)[:, :, None] * WIDTH + np.arange(WIDTH)
        held = np.bincount(at.ravel(), minlength=size).astype(float)
        normal, right = np.diag(held + 1e-6), np.zeros(size)
        for k in range(0, n, 1024):
            u = np.zeros((len(x[k : k + 1024]), size))
            np.put_along_axis(u, at[k : k + 1024].reshape(len(u), -1), x[k : k + 1024].reshape(len(u), -1), 1)
            normal += (eta - 1) * (u.T @ u)
            right += eta * u.sum(0)
        solved = np.linalg.solve(normal, right + 1e-6 * model.centres.ravel())
        model.centres = solved.reshape(m, CENTRES, WIDTH)
    return model


def _usable(c: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(c, fine) & F.exists(c, lambda x: x != 0), F.lit(False))


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id, vector of the rows that take part, one for each id."""
    kind = "float" if dict(table.dtypes)["embedding"] == "array<float>" else "double"
    rows = table.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").cast(f"array<{kind}>").alias("vector"))
    rows = stage(rows.withColumn("length", F.size("vector")), "vectors")
    usual = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    return rows.filter(F.col("length") == F.lit(usual["length"] if usual else 0)).drop("length")


def index(vectors: DataFrame, model: Quantiser) -> DataFrame:
    """Every vector with its codes and the length of its residual."""
    kind = dict(vectors.dtypes)["vector"]
    width = model.centres.shape[0] * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN_ROWS):
                b = batch.slice(at, SCAN_ROWS)
                column = b.column("vector")
                unit = unit_rows(matrix(column, len(column.flatten()) // len(column)).astype(float))[2]
                codes = model.encode(unit)
                made = [*b.columns, pa.array(list(map(bytes, pack(codes))), pa.binary()), pa.array(model.residuals(unit, codes))]
                yield pa.record_batch(made, names=["vec_id", "vector", "codes", "residual"])

    return vectors.mapInArrow(run, f"vec_id long, vector {kind}, codes binary, residual double") if width else vectors


class _Block:
    """The rows of one block of the index, and the best of them for a batch of queries."""

    def __init__(self, batches: list[pa.RecordBatch], model: Quantiser, k: int, slack: float):
        self.model, self.k = model, k
        some = pa.Table.from_batches(batches).combine_chunks()
        self.ids = some["vec_id"].to_numpy()
        order = np.argsort(self.ids)
        raw = matrix(some["vector"].combine_chunks(), len(some["vector"].combine_chunks().flatten()) // len(self.ids)).astype(float)[order]
        self.ids = self.ids[order]
        self.rows, self.lengths, _ = unit_rows(raw)
        self.codes = np.frombuffer(b"".join(some["codes"].to_pylist()), np.uint8).reshape(len(self.ids), -1)[order]
        self.error = (some["residual"].to_numpy()[order] * (slack / np.sqrt(raw.shape[1]))).astype(np.float32)

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query its nearest: position of the query, id, cosine."""
        rows, lengths, unit = unit_rows(vectors)
        table = self.model.tables(unit)
        best_id = np.full((len(ids), self.k), np.iinfo(np.int64).max)
        best = np.full((len(ids), self.k), -np.inf)
        for at in range(0, len(self.ids), SCAN_ROWS):
            codes, names = self.codes[at : at + SCAN_ROWS], self.ids[at : at + SCAN_ROWS]
            high = np.zeros((len(names), len(ids)), np.float32)
            for j in range(codes.shape[1]):
                high += table[j][codes[:, j]]
            high += self.error[at : at + SCAN_ROWS, None]
            own = np.searchsorted(names, ids)
            there = np.flatnonzero((own < len(names)) & (names[np.minimum(own, len(names) - 1)] == ids))
            high[own[there], there] = -np.inf
            if np.isinf(best[:, -1]).any() and len(names) > self.k:  # a first bound from the k best estimates
                first = np.argpartition(-high, self.k, axis=0)[: self.k]
                best, best_id = self._ranked(best, best_id, first.T.ravel(), np.repeat(np.arange(len(ids)), self.k), high, at, rows, lengths)
                high[first, np.arange(len(ids))[None]] = -np.inf
            near = high >= best[:, -1].astype(np.float32)[None] - np.float32(1e-6)
            which, query = np.nonzero(near & (high > -np.inf))
            best, best_id = self._ranked(best, best_id, which, query, high, at, rows, lengths)
        query, place = np.nonzero(best > -np.inf)
        return query, best_id[query, place], best[query, place]

    def _ranked(self, best, best_id, which, query, high, at, rows, lengths):
        """The best so far with the exact cosines of more pairs of row and query."""
        keep = high[which, query] > -np.inf
        which, query = which[keep], query[keep]
        score = np.empty(len(which))
        for s in range(0, len(which), 1 << 15):
            a, b = which[s : s + (1 << 15)] + at, query[s : s + (1 << 15)]
            score[s : s + (1 << 15)] = (self.rows[a] * rows[b]).sum(axis=1) / (self.lengths[a] * lengths[b])
        n = len(best)
        query = np.concatenate([np.repeat(np.arange(n), self.k), query])
        score = np.concatenate([best.ravel(), score])
        ids = np.concatenate([best_id.ravel(), self.ids[which + at]])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query, "left")
        top = nth < self.k
        return score[top].reshape(n, self.k), ids[top].reshape(n, self.k)


def _scanned(model: Quantiser, k: int, slack: float):
    """Rows of a partition by block: the block's vectors first, then the queries that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, number = None, None
        for batch in batches:
            place = batch.column("block").to_numpy() * 2 + batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at, part = divmod(int(place[lo]), 2) if hi > lo else (number, 0), batch.slice(lo, hi - lo)
                (at, is_query) = at
                if at != number:
                    held, block, number = [], None, at
                if not is_query:
                    held.append(part)
                    continue
                if not held:
                    continue  # a block without vectors
                block = block or _Block(held, model, k, slack)
                for s in range(0, part.num_rows, SCAN_QUERIES):
                    some = part.slice(s, SCAN_QUERIES)
                    ids, column = some.column("vec_id").to_numpy(), some.column("vector")
                    query, found, score = block.search(ids, matrix(column, len(column.flatten()) // len(column)).astype(float))
                    yield pa.record_batch([pa.array(ids[query]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(table: DataFrame, queries: Column, *, k: int = 5, slack: float = SLACK, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest; ``queries`` tells by vec_id which rows ask.

    The centres are fitted on at most ``sample`` vectors, chosen by the hash of their ids; every vector is indexed and
    scanned. Blocks hold about ``block`` vectors, fewer where that leaves cores without one.
    """
    vectors = usable_vectors(table)
    spark = table.sparkSession
    n = vectors.count()
    order = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    few = vectors.filter(order < F.lit(int(2 * sample / max(n, 1) * (1 << 30)) + 1))  # twice the sample, so that little meets in its order
    some = few.orderBy(order, "vec_id").limit(sample).select("vector").toPandas()["vector"]
    out = "query_id long, vec_id long, score double"
    if not n:
        found = spark.createDataFrame([], out)
    else:
        model = fit(np.array(some.tolist(), float))
        rows = stage(index(vectors, model), "index")
        blocks = max(1, -(-n // block), min(2 * spark.sparkContext.defaultParallelism, n // 1024))
        empty = [F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("residual")]
        home = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
        asked = rows.filter(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "vec_id", "vector", *empty)
        both = rows.select(home, F.lit(False).alias("is_query"), "vec_id", "vector", "codes", "residual").unionByName(asked)
        both = both.repartition(blocks, "block").sortWithinPartitions("block", "is_query")
        found = both.mapInArrow(_scanned(model, k, slack), out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
