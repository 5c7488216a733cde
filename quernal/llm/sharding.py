"""Minimax contiguous partition of ordered atomic groups into shards.

Rows with equal text form one atomic group.  Groups are ordered by a hash
bucket and the text's MD5, their sizes are summed along that order, and the
smallest shard capacity for which the greedy rule needs no more than the
wanted number of shards is found by search on the capacity.  The greedy check
of a capacity needs one lookup a shard ("the last group that still fits"), an
aggregate over the prefix sums; several capacities are checked together, so
the interval shrinks by that factor a round.  Nothing but the lookups' results
(a few numbers) reaches the driver, and no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

BUCKETS = 4096
SLOTS = 512
PROBES = 31


def _cuts_for(prefix: DataFrame, total: int, shards: int, capacities: list[int]) -> list[list[int] | None]:
    """Greedy cut positions for each capacity, or None where it needs more shards."""
    at = [[0] for _ in capacities]
    for _ in range(shards - 1):
        live = [i for i, a in enumerate(at) if a[-1] < total]
        if not live:
            break
        low = min(at[i][-1] for i in live)
        high = max(at[i][-1] + capacities[i] for i in live)
        row = (
            prefix.where(F.col("upto").between(low, high))
            .agg(*[F.max(F.when(F.col("upto") <= at[i][-1] + capacities[i], F.col("upto"))).alias(f"c{i}") for i in live])
            .first()
        )
        for i in live:
            at[i].append(max(at[i][-1], row[f"c{i}"] or 0))
    return [a if total - a[-1] <= c else None for a, c in zip(at, capacities, strict=True)]


def minimax_cuts(prefix: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and the prefix sums at which its shards end."""
    low = max(largest, -(-total // shards))
    high = low + largest
    best = None
    while low < high or best is None:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        tried = sorted({min(low + k * step, high) for k in range(PROBES + 1)})
        found = _cuts_for(prefix, total, shards, tried)
        first = next(i for i, x in enumerate(found) if x is not None) if any(x is not None for x in found) else None
        if first is None:
            low = tried[-1] + 1
            continue
        best = found[first]
        high = tried[first]
        if first:
            low = tried[first - 1] + 1
    return high, best[1:]


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard number and slot of every row, sizes near equal, equal texts together.

    Null text counts as empty (size 1); null or repeated ids are kept, each row
    gets its own slot; an empty table gives an empty result; other columns of
    the input are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = keep(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket"),
            F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        ),
        "shard-rows",
    )
    groups = slim.groupBy("bucket", "digest").agg(F.sum("size").alias("bytes"))
    within = groups.withColumn("part", F.sum("bytes").over(Window.partitionBy("bucket").orderBy("digest")))
    sums = slim.groupBy("bucket").agg(F.sum("size").alias("whole"))  # at most BUCKETS rows
    before = sums.select("bucket", (F.sum("whole").over(Window.orderBy("bucket")) - F.col("whole")).alias("before"))
    prefix = keep(within.join(F.broadcast(before), "bucket").select("bucket", "digest", "bytes", (F.col("before") + F.col("part")).alias("upto")), "shard-prefix")
    total, largest = prefix.agg(F.max("upto"), F.max("bytes")).first()

    shard = F.lit(0)
    if total:
        _, ends = minimax_cuts(prefix, total, largest, shards)
        for row in prefix.where(F.col("upto").isin([e for e in dict.fromkeys(ends) if 0 < e < total])).select("bucket", F.hex("digest").alias("digest")).collect() if any(0 < e < total for e in ends) else []:
            after = (F.col("bucket") > row["bucket"]) | ((F.col("bucket") == row["bucket"]) & (F.col("digest") > F.unhex(F.lit(row["digest"]))))
            shard = shard + after.cast("int")
    placed = slim.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOTS)).cast("int").alias("strip"))
    counts = placed.groupBy("shard", "strip").agg(F.count(F.lit(1)).alias("n"))  # at most shards * SLOTS rows
    base = counts.select("shard", "strip", (F.sum("n").over(Window.partitionBy("shard").orderBy("strip")) - F.col("n")).alias("base"))
    order = Window.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32")
    return placed.join(F.broadcast(base), ["shard", "strip"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
