"""Batches of documents that exchange compact messages with hash buckets.

A corpus-wide question about fingerprints ("does this window occur anywhere
else?", "how often does this word occur?") is asked batch by batch.  Documents
are cut into batches of a few MB and written once, bucketed by batch, to the
shared folder.  A batch sends every hash bucket one message with its distinct
fingerprints, packed and sorted; a bucket answers each batch in the same order,
so an answer needs no keys.  Answers are joined to the batches' rows, which
need not be shuffled again, being bucketed.

A batch names each fingerprint once, so however many rows share one, a bucket
gets at most one entry a batch: no key is hot.

Messages and replies are records of a fixed size, laid end to end.  They are cut
into rows, and put together again, by offsets into one buffer, so neither side
makes a Python object a message: where an input is so large that a message holds
a key or two, the exchange costs what a plain shuffle by key would.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import BATCH_BYTES, MADE, col, partitions, shared_dir, slices, text_buffers

MESSAGE = "bucket int, batch_id long, payload binary"
REPLY = "batch_id long, bucket int, payload binary, extra boolean"
#: Input bytes a bucket answers for: at least 1 MB, growing with the root of the input.
BYTES_PER_BUCKET = 1 << 20
ROOT_BYTES = 8
MAX_BUCKET_BITS = 24


def bucket_bits(total: int) -> int:
    per = max(BYTES_PER_BUCKET, ROOT_BYTES * int(total**0.5))
    return min(MAX_BUCKET_BITS, max(3, (total // per).bit_length()))


class Batches:
    """The written batch table, and how many hash buckets its size asks for."""

    def __init__(self, docs: DataFrame, batch_bytes: int = BATCH_BYTES):
        spark = self.spark = docs.sparkSession
        schema = docs.schema

        def run(batches):
            from pyspark import TaskContext

            number, used = TaskContext.get().partitionId() << 33, 0
            for batch in slices(batches, "text", batch_bytes):
                _, off = text_buffers(col(batch, "text"))
                if used and used + off[-1] > batch_bytes:
                    number, used = number + 1, 0
                used += int(off[-1])
                yield batch.append_column("batch_id", pa.array(np.full(batch.num_rows, number)))

        seen = Observation()
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        batched = docs.mapInArrow(run, f"{fields}, batch_id long").observe(seen, F.sum(F.octet_length("text")).alias("bytes"))
        name = f"batches_{uuid.uuid4().hex[:12]}"
        self.parts = partitions(spark)
        batched.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark, name)).bucketBy(self.parts, "batch_id").sortBy("batch_id").saveAsTable(name)
        MADE.append(f"table:{name}")
        self.table = spark.table(name)
        self.bytes = seen.get["bytes"] or 0
        self.bits = bucket_bits(self.bytes)

    def ask(self, make, replies: DataFrame | None, schema: str = MESSAGE) -> DataFrame:
        """`make(rows, answers)` for every batch; answers maps kind to the replies' bytes in the order of the keys."""

        def alone(table: pa.Table) -> pa.Table:
            return make(table, {})

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
            kinds = right["kind"].to_numpy()
            data, off = text_buffers(right["payload"])
            bounds = {int(k): np.searchsorted(kinds, [k, k + 1]) for k in np.unique(kinds)}
            return make(left, {k: data[off[a] : off[b]] for k, (a, b) in bounds.items()})

        rows = self.table.groupBy("batch_id")
        if replies is None:
            return rows.applyInArrow(alone, schema)
        return rows.cogroup(replies.select("batch_id", "bucket", "payload", "kind").groupBy("batch_id")).applyInArrow(both, schema)

    def settle(self, messages: DataFrame, answer, size: int, kind: int) -> DataFrame:
        """Replies to all messages, whose records have `size` bytes; written, rows marked extra apart.

        `answer(records, sender)` gets a bucket's records (n x size bytes) and
        each one's sender, and gives a reply record each, and bytes that go to
        no batch (or None), which come back as a row of their own.
        """

        def run(table: pa.Table) -> pa.Table:
            bucket = table["bucket"][0].as_py()
            data, off = text_buffers(table["payload"])
            off = off // size
            batch = table["batch_id"].to_numpy()
            reply, extra = answer(data.reshape(-1, size), np.repeat(np.arange(len(batch)), np.diff(off)))
            rows = pa.table([pa.array(batch), pa.array(np.full(len(batch), bucket, np.int32)), _cut_buffer(reply, off), pa.array(np.zeros(len(batch), bool))], names=["batch_id", "bucket", "payload", "extra"])
            if extra is None:
                return rows
            return pa.concat_tables([rows, pa.table([pa.array([-1], pa.int64()), pa.array([bucket], pa.int32()), pa.array([extra], pa.binary()), pa.array([True])], names=rows.column_names)])

        replies = messages.groupBy("bucket").applyInArrow(run, REPLY).withColumn("kind", F.lit(kind))
        path = shared_dir(self.spark, "replies")
        replies.write.partitionBy("extra").parquet(path)
        return self.spark.read.schema(replies.schema).parquet(path)


def _bytes(x: np.ndarray) -> np.ndarray:
    """The bytes of each of the first axis' entries, a row each."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize * int(np.prod(x.shape[1:], dtype=int)))


def _cut_buffer(records: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary array whose k-th value is records bounds[k] to bounds[k + 1]."""
    raw = _bytes(records)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds) * raw.shape[1]).astype(np.int32)), pa.py_buffer(raw.ravel())])


def messages_of(keys: np.ndarray, batch: int, bits: int, records: np.ndarray) -> pa.Table:
    """One message a bucket: the records of its keys, which are 64-bit and ascending."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int32)
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    bounds = np.append(begin, len(of))
    return pa.table([pa.array(of[begin]), pa.array(np.full(len(begin), batch)), _cut_buffer(records, bounds)], names=["bucket", "batch_id", "payload"])


def records_of(*columns: np.ndarray) -> np.ndarray:
    """Columns of numbers side by side as fixed-size records of bytes."""
    return np.concatenate([_bytes(c) for c in columns], 1)


def column_of(records: np.ndarray, at: int, kind: str) -> np.ndarray:
    """The numbers of `kind` at byte `at` of every record."""
    return np.ascontiguousarray(records[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
