"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors lie in cells around centroids. Each is stored as the signs of its rotated, normalised offset from the
centroid, with its norm and a correction scalar. Inner products with a query are estimated from the packed bits;
an error bound on the estimate tells which vectors may belong to the nearest, and only these are measured
exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import common

SAMPLE = 20_000  # the bound of the rows that centroids are fitted on; every row is indexed
CELL = 2_000  # rows a cell is meant to hold
MOST_CELLS = 4_096
PROBED = 4  # cells a query looks into at least,
TARGET = 0.97  # and as many as hold this share of the nearest rows of sampled queries: few if vectors lie in groups, most if not
TRIED = 400  # sampled queries that tell
PART = 20_000  # rows of a cell, and queries to it, that one task holds; more are dealt over several
PLANES = 6  # bits a component of the query keeps
BOUND = 4.0  # standard errors that the bound allows for
QUERIES = 512  # queries that are estimated at once


class Index:
    """Centroids and a rotation; small, as the number of cells is bounded."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.size = sample.shape[1]
        self.rotation = np.linalg.qr(draw.normal(size=(self.size, self.size)))[0]
        distinct = np.unique(sample, axis=0)
        cells = max(1, min(cells, len(distinct)))
        c = distinct[draw.choice(len(distinct), cells, replace=False)].astype(float)
        for _ in range(12):
            at = self._nearest(c, sample)
            n = np.bincount(at, minlength=cells)
            for k in range(cells):
                if n[k]:
                    c[k] = sample[at == k].mean(0)
        self.centroids = c
        self.probed = self._needed(sample, draw.choice(len(sample), min(TRIED, len(sample)), replace=False))

    def _needed(self, sample: np.ndarray, tried: np.ndarray, k: int = 10) -> int:
        """How many cells, in the order that a query looks into them, hold TARGET of the sample's own nearest rows.

        All rows lie closer to a query than a sample of them does, so their nearest ones are spread over no more cells.
        """
        cell = self.cells(sample)
        ranks = []
        half = (sample * sample).sum(1) / 2
        for s in range(0, len(tried), 64):
            q = tried[s : s + 64]
            gap = half - sample[q] @ sample.T
            gap[np.arange(len(q)), q] = np.inf
            near = np.argsort(gap, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
            place = np.argsort(self._order(sample[q]), axis=1, kind="stable")
            ranks.append(np.take_along_axis(place, cell[near], 1).ravel())
        found = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0)
        return int(min(len(self.centroids), max(PROBED, found[int(np.ceil(TARGET * len(found))) - 1] + 1 if len(found) else 0)))

    def _order(self, x: np.ndarray) -> np.ndarray:
        gap = (self.centroids * self.centroids).sum(1) / 2 - x @ self.centroids.T
        return np.argsort(gap, axis=1, kind="stable")

    @staticmethod
    def _nearest(c: np.ndarray, x: np.ndarray) -> np.ndarray:
        half = (c * c).sum(1) / 2
        return np.concatenate([(half - x[s : s + 4096] @ c.T).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.centroids, x)

    def probes(self, x: np.ndarray) -> np.ndarray:
        return self._order(x)[:, : self.probed]

    def codes(self, x: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, norms and correction scalars of rows of one cell."""
        r = (x - self.centroids[cell]) @ self.rotation
        norm = np.sqrt((r * r).sum(1))
        o = r / np.maximum(norm, 1e-300)[:, None]
        return _packed(o > 0), norm, np.abs(o).sum(1) / np.sqrt(self.size)


def _packed(bits: np.ndarray) -> np.ndarray:
    words = -(-bits.shape[1] // 64)
    wide = np.zeros((len(bits), words * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def _estimates(index: Index, codes: np.ndarray, correction: np.ndarray, norm: np.ndarray, q: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances, queries by rows."""
    d = index.size
    r = (q - index.centroids[cell]) @ index.rotation
    far = np.sqrt((r * r).sum(1))
    u = r / np.maximum(far, 1e-300)[:, None]
    low = u.min(1)
    step = np.maximum((u.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
    whole = np.rint((u - low[:, None]) / step[:, None]).astype(np.int64)
    dots = np.zeros((len(q), len(codes)))
    for p in range(PLANES):
        plane = _packed((whole >> p) & 1 == 1)
        both = np.zeros((len(q), len(codes)), np.int32)
        for w in range(codes.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        dots += both * float(1 << p)
    ones = np.bitwise_count(codes).sum(1)
    # the inner product with the code's signs / sqrt(d), from the bits alone
    signed = (2 * (step[:, None] * dots + low[:, None] * ones[None, :]) - (step * whole.sum(1) + low * d)[:, None]) / np.sqrt(d)
    c = np.maximum(correction, 1e-9)
    guess = signed / c
    error = BOUND * np.sqrt(np.maximum(1 - c * c, 0)) / c / np.sqrt(max(d - 1, 1)) + step[:, None] / 2 * np.sqrt(d) / c * 0.5
    base, both = norm[None, :] ** 2 + far[:, None] ** 2, 2 * norm[None, :] * far[:, None]
    return base - both * np.minimum(guess + error, 1), base - both * np.maximum(guess - error, -1)


def search_cell(index: Index, cell: int, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of a cell's part for each query that looks into it, without the query's own row."""
    codes, norm, correction = index.codes(x, cell)
    out = []
    step = max(1, min(QUERIES, 4_000_000 // max(1, len(x))))
    for s in range(0, len(q), step):
        low, high = _estimates(index, codes, correction, norm, q[s : s + step], cell)
        own = ids[None, :] == query_ids[s : s + step, None]
        high = np.where(own, np.inf, high)
        m = min(k, len(ids))
        limit = np.partition(high, m - 1, axis=1)[:, m - 1] if m else np.zeros(len(high))
        for i in range(len(low)):
            at = np.flatnonzero((low[i] <= limit[i] + 1e-9) & ~own[i])
            d = np.sqrt(((x[at] - q[s + i]) ** 2).sum(1))
            at, d = (lambda o: (at[o], d[o]))(np.lexsort((ids[at], d))[:k])
            out.append(pd.DataFrame({"query_id": query_ids[s + i], "vec_id": ids[at], "score": d}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows whose vector is not null, zero or with a null or non-finite part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0)
    return vectors.select("vec_id", x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of each query row among all other rows; fewer only if there are fewer.

    Vectors of another length than most of the sample's take no part, nor those that ``usable`` leaves out.
    Rows of one vec_id count as one another's own. Ties go to the smaller vec_id. A cell's rows, and the queries that look
    into it, are dealt over as many tasks as their counts ask for, so a vector with a third of all rows is no task's burden.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    sizes = {r.d: r.n for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], out)
    d = max(sizes, key=lambda s: (sizes[s], -s))
    rows, n = rows.where(F.size("v") == d), sizes[d]
    share = min(1.0, 4 * SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = np.array([r.v for r in drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    index = Index(sample, min(MOST_CELLS, max(1, n // CELL)))
    shipped = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.cells(np.stack(v.to_numpy())) if len(v) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def cells_of(v: pd.Series) -> pd.Series:
        return pd.Series(list(shipped.value.probes(np.stack(v.to_numpy())).astype("int32")) if len(v) else [])

    placed = common.written(rows.select("vec_id", "v", cell_of("v").alias("cell")), "cells")
    count = lambda own: {r.cell: r.n for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # noqa: E731  a row a cell
    number = lambda counts: F.coalesce(F.create_map(*[F.lit(int(y)) for c, m in counts.items() for y in (c, -(-m // PART))])[F.col("cell")], F.lit(0))
    queries = placed.where(is_query).select("vec_id", "v", F.explode(cells_of("v")).alias("cell"))
    full, asked = count(placed), count(queries)
    if not full or not asked:
        return spark.createDataFrame([], out)
    rows, blocks = number(full).cast("int"), number(asked).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    data = placed.where(blocks > 0).withColumn("part", deal(rows)).withColumn("block", every(blocks))
    queries = queries.where(rows > 0).withColumn("block", deal(blocks)).withColumn("part", every(rows))

    def one(key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_cell(shipped.value, key[0], own.vec_id.to_numpy(), np.stack(own.v.to_numpy()), asked.vec_id.to_numpy(), np.stack(asked.v.to_numpy()), k)

    found = data.groupBy("cell", "part", "block").cogroup(queries.groupBy("cell", "part", "block")).applyInPandas(one, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each whose vec_id is divisible by 100."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
