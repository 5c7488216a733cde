"""Requests for a region's sites, bins and linkage over a table of dosages.

The table has a row a site: chrom, pos, id and one number a sample (null for
missing).  Requests are checked first and fail with `BadRequest`; results are
DataFrames, so the range filter reaches the scan of a store that `write_store`
has laid out by chrom and position.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling

MODES = ("raw", "even", "random", "variance", "hybrid", "aggregate")
MOST_SITES, MOST_BINS, MOST_SPAN = 50_000, 5_000, 50_000_000
LEAST_IDS, MOST_GROUPS = 5, 4


class BadRequest(ValueError):
    """A request that cannot be answered; `kind` names why."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int
    end: int
    mode: str = "even"
    max_sites: int = 2_000
    seed: int = 1

    def check(self) -> Region:
        if self.mode not in MODES:
            raise BadRequest("mode", f"mode {self.mode} is none of {', '.join(MODES)}")
        if self.start < 0 or self.end <= self.start:
            raise BadRequest("range", f"{self.start} to {self.end} is no range")
        if self.end - self.start > MOST_SPAN:
            raise BadRequest("span", f"a span of {self.end - self.start} is over {MOST_SPAN}")
        if not 0 < self.max_sites <= MOST_SITES:
            raise BadRequest("sites", f"max_sites {self.max_sites} is not in 1..{MOST_SITES}")
        return self


def around(chrom: str, pos: int, flank: int, **more) -> Region:
    """The region about a breakpoint."""
    return Region(chrom, max(0, pos - flank), pos + flank, **more)


def candidate(chrom: str, start: int, end: int, margin: float = 0.2, **more) -> Region:
    """A candidate with a margin of its length on both sides."""
    extra = int((end - start) * margin)
    return Region(chrom, max(0, start - extra), end + extra, **more)


def tile(chrom: str, index: int, width: int, **more) -> Region:
    return Region(chrom, index * width, (index + 1) * width, **more)


def samples_of(store: DataFrame) -> list[str]:
    return [c for c in store.columns if c not in ("chrom", "pos", "id")]


def within(store: DataFrame, region: Region) -> DataFrame:
    return store.where((F.col("chrom") == region.chrom) & F.col("pos").between(region.start, region.end))


def sites(store: DataFrame, region: Region) -> DataFrame:
    """The region's sites, chosen by the mode; `raw` fails where there are more than allowed, and never switches by itself."""
    rows = within(store, region.check())
    if region.mode == "aggregate":
        return bins(store, region, region.max_sites)
    if region.mode == "raw":
        try:
            return sampling.at_most(rows, region.max_sites)
        except ValueError as e:
            raise BadRequest("cap", str(e)) from e
    n, keys = region.max_sites, ["chrom"]
    if region.mode == "even":
        pick = sampling.even_sites(rows, keys, "pos", "id", n)
    elif region.mode == "random":
        pick = sampling.draw(rows, keys, "id", n, region.seed)
    else:
        named = [F.col(s).cast("double") for s in samples_of(store)]
        seen = F.array_compact(F.array(*named))
        mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(seen), F.lit(0))
        spread = F.aggregate(F.transform(seen, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(seen), F.lit(0))
        varied = rows.withColumn("_variance", spread)
        choose = sampling.most_variable if region.mode == "variance" else sampling.hybrid_sites
        pick = choose(varied, keys, "_variance", "pos", "id", n)
    return rows.join(pick.select("id"), "id", "left_semi").orderBy("pos", "id")


def bins(store: DataFrame, region: Region, n: int) -> DataFrame:
    """Mean dosage per sample in n equal bins, missing values left out; bins without sites are there with nulls."""
    region.check()
    if not 0 < n <= MOST_BINS:
        raise BadRequest("bins", f"{n} bins are not in 1..{MOST_BINS}")
    width = (region.end - region.start) / n
    at = F.least(F.floor((F.col("pos") - region.start) / width), F.lit(n - 1))
    means = within(store, region).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n_sites"), *[F.avg(s).alias(s) for s in samples_of(store)])
    spine = store.sparkSession.range(n).select(F.col("id").alias("bin"), F.round(region.start + (F.col("id") + 0.5) * width).cast("long").alias("centre"))
    return spine.join(means, "bin", "left").fillna(0, ["n_sites"]).orderBy("bin")


@dataclass(frozen=True)
class LinkageRequest:
    chrom: str
    start: int
    end: int
    groups: dict = field(default_factory=dict)
    max_sites: int = 2_000

    def check(self, known: set[str]) -> LinkageRequest:
        """One to four named groups of at least five known samples each."""
        Region(self.chrom, self.start, self.end, "even", self.max_sites).check()
        if not 1 <= len(self.groups) <= MOST_GROUPS:
            raise BadRequest("groups", f"{len(self.groups)} groups are not in 1..{MOST_GROUPS}")
        for name, ids in self.groups.items():
            if not re.fullmatch(r"[A-Za-z0-9_]+", name):
                raise BadRequest("name", f"group name {name!r}")
            if len(set(ids) & known) < LEAST_IDS:
                raise BadRequest("ids", f"group {name} has under {LEAST_IDS} known samples")
        return self

    def key(self, version: str) -> str:
        """The same for groups and samples in any order."""
        body = asdict(self) | {"groups": {k: sorted(set(v)) for k, v in self.groups.items()}, "version": version}
        return "linkage." + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]


BLOCK = 256


def _r2(a, b):
    """Squared correlations of the rows of two matrices over the columns where both are present, and how many those are."""
    import numpy as np

    m, k = ~np.isnan(a), ~np.isnan(b)
    x, y, m, k = np.where(m, a, 0.0), np.where(k, b, 0.0), m.astype(float), k.astype(float)
    n = m @ k.T
    sx, sy = x @ k.T, m @ y.T
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = x @ y.T - sx * sy / n
        spread = ((x * x) @ k.T - sx * sx / n) * (m @ (y * y).T - sy * sy / n)
        return np.where(spread > 1e-12, cov * cov / spread, np.nan), n


def pairwise_r2(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, r2, n) for all pairs a < b of rows (pos, x): missing numbers are left out pair by pair, r2 is null without variation.

    Rows are dealt to pairs of blocks, one matrix product a pair of blocks.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    placed = rows.withColumn("_k", F.floor((F.row_number().over(Window.orderBy("pos")) - 1) / block))  # a request's sites, at most MOST_SITES
    last = placed.agg(F.max("_k")).first()[0]
    if last is None:
        return rows.sparkSession.createDataFrame([], "a long, b long, r2 double, n long")

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        flat = np.array(table[name].combine_chunks().flatten().to_pandas(), dtype=float)
        return flat.reshape(table.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p, q = left["p"].to_numpy(), right["q"].to_numpy()
        r2, n = _r2(matrix(left, "x"), matrix(right, "y"))
        i, j = np.nonzero(p[:, None] < q[None, :])
        return pa.table([pa.array(p[i], pa.int64()), pa.array(q[j], pa.int64()), pa.array(r2[i, j], pa.float64(), from_pandas=True), pa.array(n[i, j].astype(np.int64))], names=["a", "b", "r2", "n"])

    left = placed.withColumn("_j", F.explode(F.sequence(F.col("_k"), F.lit(last)))).select(F.col("_k").alias("i"), F.col("_j").alias("j"), F.col("pos").alias("p"), F.col("x").alias("x"))
    right = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k")))).select(F.col("_i").alias("i"), F.col("_k").alias("j"), F.col("pos").alias("q"), F.col("x").alias("y"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "a long, b long, r2 double, n long")


def linkage(store: DataFrame, request: LinkageRequest) -> DataFrame:
    """r2 of all pairs of the thinned sites, per group; null where a site does not vary.

    The request bounds the sites, so the pairs are bounded too.
    """
    request.check(set(samples_of(store)))
    chosen = sites(store, Region(request.chrom, request.start, request.end, "even", request.max_sites))
    out = None
    for name, ids in request.groups.items():
        members = sorted(set(ids) & set(samples_of(store)))
        part = pairwise_r2(chosen.select("pos", F.array(*[F.col(m).cast("double") for m in members]).alias("x"))).select(F.lit(name).alias("grp"), "a", "b", "r2", "n")
        out = part if out is None else out.unionByName(part)
    return out


def windows_json(store: DataFrame, size: int, step: int) -> DataFrame:
    """One JSON text a chromosome: its windows of `size` sites, each with its range and positions."""
    from ..operators.intervals import sliding_windows

    rows = sliding_windows(store.select("chrom", "pos", "id"), ["chrom"], ["pos", "id"], size, step)
    each = rows.groupBy("chrom", "window_id").agg(F.min("pos").alias("start_bp"), F.max("pos").alias("end_bp"), F.array_sort(F.collect_list("pos")).alias("snp_positions"))
    w = F.struct(F.col("window_id").alias("idx"), "start_bp", "end_bp", F.size("snp_positions").alias("n_snps"), "snp_positions")
    whole = each.groupBy("chrom").agg(F.array_sort(F.collect_list(w)).alias("windows"))
    return whole.select("chrom", F.to_json(F.struct("chrom", F.size("windows").alias("n_windows"), "windows")).alias("json"))


class ResultCache:
    """Results by key below a folder, built again where the source is newer than what was kept."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _changed(self, path: str) -> int | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

    def get(self, key: str, source: str, build) -> DataFrame:
        path, newest = f"{self.folder}/{key}", self._changed(source)
        kept = self._changed(path + "/_SUCCESS")
        if kept is None or (newest is not None and newest > kept):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


# Questions to a registry of keys and results.

RANK = {"SUSPECT": -1, "NONE": 0, "UNCERTAIN": 1, "SUPPORTED": 2, "VALIDATED": 3}


def last_tiers(keys: DataFrame, name: str = "q7_tier") -> DataFrame:
    """Per candidate the value of a key in its last row (row order by `line`)."""
    return keys.where(F.col("key") == name).groupBy("candidate_id").agg(F.max_by("value", "line").alias("tier"))


def reaches_rank(levels: DataFrame, least: str) -> DataFrame:
    """Candidates whose validation level is at least the given one; unknown levels rank as NONE."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("level")), F.lit(0))
    return levels.where(rank >= RANK[least])


def counts_by_kind(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
