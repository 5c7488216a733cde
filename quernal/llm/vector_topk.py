"""Exact top-k inner products over vectors sorted by length.

Vectors become integers, floor(1024 * x).  An orthogonal rotation from the
eigenvectors of their Gram matrix moves most of their length into the first
coordinates.  Candidates are cut into classes by descending length and these
into blocks; the first block gives each query a floor, its k-th best score
there.  By |q| |x| >= floor a query needs a leading run of the classes alone:
queries of like reach share a query block, and neither they nor candidates are
copied to pairs of blocks beyond it.  Each pair of blocks left is one task.
Within it candidates are taken in order of length: once |q| |x| cannot reach a
query's k-th best score, all later ones are skipped, and for the rest a partial
sum over the first coordinates plus the Cauchy-Schwarz bound of what is left
decides who is scored in full, with exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, keep

HEAD = 16
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
CHUNK = 1024
CLASSES = 1024  # of length; each is split into as many blocks as its rows fill
NO_FLOOR = -(1 << 62)
HIT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<long>, norm2; rows null, empty or holding null or non-finite components go."""
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * 1024).cast("long"))
    rows = vectors.where(good).select("vec_id", v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, strongest first; dim x dim numbers reach the driver."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(col(batch, "v")).astype(np.float64)
            if m.size:
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    parts = rows.select("v").mapInArrow(run, "i int, g array<double>")
    gram = parts.groupBy("i").agg(*[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(dim)]).collect()
    full = np.zeros((dim, dim))
    for r in gram:
        full[r["i"]] = [r[f"g{j}"] for j in range(dim)]
    values, basis = np.linalg.eigh((full + full.T) / 2)
    return basis[:, np.argsort(-values)]


class BestK:
    """Running k best (score, smaller id first) of each of n queries."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, -np.inf) if floor is None else floor

    def bound(self) -> np.ndarray:
        """A candidate below this cannot enter (one equal to it can, by id)."""
        last = self.score[:, -1].astype(np.float64)
        last[self.score[:, -1] == np.iinfo(np.int64).min] = -np.inf
        return np.maximum(last, self.floor)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for i in np.unique(q):
            at = q == i
            s, d = np.concatenate([self.score[i], score[at]]), np.concatenate([self.id[i], ids[at]])
            order = np.lexsort((d, ~s))[: self.k]
            self.score[i], self.id[i] = s[order], d[order]


def search_block(qid, q, cid, c, k: int, basis: np.ndarray, floor=None) -> BestK:
    """Best k of candidates `c` (sorted by descending length) for each query."""
    best = BestK(len(qid), k, floor)
    if not len(qid) or not len(cid):
        return best
    head = min(HEAD, q.shape[1])
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qr, cr = qf @ basis, cf @ basis
    qn, cn = np.sqrt((qf * qf).sum(1)), np.sqrt((cf * cf).sum(1))
    q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
    live = np.arange(len(qid))
    for k0 in range(0, len(cid), CHUNK):
        part = slice(k0, k0 + CHUNK)
        bound = best.bound()
        slack = 1e-6 * (1 + qn * cn[k0])  # covers rounding of the rotated sums
        live = live[(qn * cn[k0] + slack)[live] >= bound[live]]
        if not len(live):
            break
        upper = qr[live, :head] @ cr[part, :head].T + np.outer(q_rest[live], c_rest[part])
        a, b = np.nonzero((upper + slack[live, None] >= bound[live, None]) & (qid[live, None] != cid[part][None, :]))
        if len(a):
            score = np.einsum("ij,ij->i", q[live[a]], c[part][b])
            least = bound[live[a]]
            good = score >= least - 1e-12 * np.abs(np.where(np.isfinite(least), least, 0))  # doubles round scores over 2^53
            best.add(live[a][good], cid[part][b[good]], score[good])
    return best


def _hits(best: BestK, qid) -> pa.RecordBatch:
    got = best.score != np.iinfo(np.int64).min
    rows = np.nonzero(got)[0]
    return pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(best.id[got]), pa.array(best.score[got])], names=["query_id", "vec_id", "score"])


def _at(numbers: np.ndarray, index: str) -> Column:
    """The number at a class; an array of at most CLASSES + 1 numbers."""
    return F.get(F.array(*[F.lit(int(n)).cast("long") for n in numbers]), F.col(index))


def _range(start: int, end: Column) -> Column:
    """start, ..., end - 1; empty where there is none."""
    return F.when(end > start, F.sequence(F.lit(start).cast("long"), end - 1)).otherwise(F.array().cast("array<bigint>"))


def _classify(column: str, edges: np.ndarray):
    """Add the class of a squared length: 0 above every edge, one more for each edge at or above it."""

    def run(batches):
        for batch in batches:
            place = len(edges) - np.searchsorted(edges, col(batch, column).to_numpy(zero_copy_only=False), "left")
            yield batch.append_column("class", pa.array(place.astype(np.int32)))

    return run


def least_length2(floor: str, qnorm2: str) -> Column:
    """The squared length below which no candidate reaches the floor by |q| |x|, less what rounding may cost."""
    f = F.col(floor).cast("double")
    return F.when(f <= 0, F.lit(0.0)).when(F.col(qnorm2) == 0, F.lit(float("inf"))).otherwise(f * f / F.col(qnorm2) * (1 - 1e-9))


def query_groups(counts: dict[int, int], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query blocks of like reach.

    Per last class that a query needs: its first query block and how many it
    is spread over.  Per candidate class: how many leading query blocks need it.
    Far-reaching queries come first; small classes share one block.
    """
    first, split, wanted = (np.zeros(classes, np.int64) for _ in range(3))
    at, filled = -1, QUERY_ROWS
    for last in range(classes - 1, -1, -1):
        n = counts.get(last, 0)
        if n and filled + n <= QUERY_ROWS:
            first[last], split[last], filled = at, 1, filled + n
        elif n:
            first[last], split[last] = at + 1, -(-n // QUERY_ROWS)
            at += int(split[last])
            filled = n if split[last] == 1 else QUERY_ROWS
        wanted[last] = at + 1
    return first, split, wanted


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, dim: int | None = None) -> DataFrame:
    """k highest integer inner products of each query (ids divisible by `every`).

    Vectors of a length other than the most common one take no part, nor do
    null or empty vectors, null ids or vectors with null or non-finite components; ties
    go to the smaller id, repeated ids count as rows of their own but a query's
    own id never answers it; scores must fit 64 bits; an empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors)
    if dim is None:
        common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if common is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        dim = common["d"]
    rows = keep(rows.where(F.size("v") == dim), "vectors")
    basis = rotation(rows, dim)
    total = rows.count()
    classes = min(CLASSES, max(1, -(-total // BLOCK_ROWS)))
    # Bounds of the classes, longest first: quantiles of the lengths, at most CLASSES numbers.
    cuts = rows.approxQuantile("norm2", [i / classes for i in range(1, classes)], 0.25 / classes) if classes > 1 else []
    edges = np.array(sorted(set(cuts)))
    cands = keep(rows.mapInArrow(_classify("norm2", edges), "vec_id long, v array<long>, norm2 double, class int"), "topk-classes")
    parts = np.zeros(len(edges) + 1, np.int64)
    for r in cands.groupBy("class").count().collect():
        parts[r["class"]] = -(-r["count"] // BLOCK_ROWS)
    ends = np.cumsum(parts)  # blocks of a class and all longer ones
    block = _at(ends - parts, "class") + F.pmod(F.xxhash64("vec_id", "v"), F.greatest(_at(parts, "class"), F.lit(1)))
    cands = cands.withColumn("block", block)
    query_blocks = max(1, -(-total // every // QUERY_ROWS))
    by_hash = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("qblock", by_hash)
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm2").alias("qnorm2"), "qblock")

    def run(floors: bool):
        def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
            cid, c = col(left, "vec_id").to_numpy(), _matrix(col(left, "v").combine_chunks())
            qid, q = col(right, "query_id").to_numpy(), _matrix(col(right, "q").combine_chunks())
            order = np.argsort(-col(left, "norm2").to_numpy(), kind="stable")
            floor = col(right, "floor").to_numpy().astype(np.float64) if floors else None
            return pa.Table.from_batches([_hits(search_block(qid, q, cid[order], c[order], k, basis, floor), qid)])

        return work

    left = cands.where("block = 0").withColumn("qblock", F.explode(_range(0, F.lit(query_blocks))))
    right = queries.withColumn("block", F.lit(0).cast("long"))
    head = keep(left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInArrow(run(False), HIT), "topk-head")
    hits = head
    if ends[-1] > 1:
        floors = head.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NO_FLOOR)).alias("floor"))
        asked = queries.drop("qblock").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
        asked = keep(asked.withColumn("need2", least_length2("floor", "qnorm2")).mapInArrow(_classify("need2", edges), "query_id long, q array<long>, qnorm2 double, floor long, need2 double, class int"), "topk-asked")
        counts = {r["class"]: r["count"] for r in asked.groupBy("class").count().collect()}
        first, split, wanted = query_groups(counts, len(parts))
        asked = asked.withColumn("qblock", _at(first, "class") + F.pmod(F.xxhash64("query_id", F.lit(1)), F.greatest(_at(split, "class"), F.lit(1))))
        right = asked.withColumn("block", F.explode(_range(1, _at(ends, "class"))))
        left = cands.where("block > 0").withColumn("qblock", F.explode(_range(0, _at(wanted, "class"))))
        hits = head.unionByName(left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInArrow(run(True), HIT))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
