"""Exact Jaccard self-join of shingle sets, by set-relation skipping.

Equal sets are one class.  A class is indexed under the rarest shingles of its
set (the prefix that any partner must share one of).  How many sets have a
shingle is found by the batch exchange, four bytes a shingle and batch; keys
that collide there change the order and so the work, but not the result.

Index-level skipping: index lists are cut into blocks by set size, and a
posting's position in its set bounds the size of the partners it can have, so a
probe reads only the blocks within its bounds and skips the others.

Answer-level skipping: sets are first compared with one similar set each (a
leader of their lists).  Later pairs take their answer from those of the two
sets against the same leader where the distances decide it: |x^y| lies between
the difference and the sum of |x^l| and |y^l|.  Only pairs that are neither
connected already nor decided so are compared in full.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MADE, col, hash_words, join_hash, keep, mix64, partitions, shared_dir, slices, text_buffers, word_bounds
from .exchange import Batches, column_of, messages_of, records_of
from .graph import components


class Rule(NamedTuple):
    """Words a shingle, and the least Jaccard similarity of linked sets as over / under."""

    shingle: int = 3
    over: int = 9
    under: int = 10

    def prefix_size(self, n: int) -> int:
        """Any set that is similar enough shares one of this many rarest shingles."""
        return n + self.over * n // -self.under + 1 if n else 0

    def block(self, n, shift: float = 0.0):
        """Size block: neighbouring blocks hold all sizes that may link."""
        return F.floor(F.log(n.cast("double")) * int(0.9 / math.log(self.under / self.over)) + F.lit(shift)).cast("int")

    def need(self, n, m):
        """Fewest common shingles of linked sets."""
        return F.ceil(self.over * (n + m) / F.lit(float(self.over + self.under)) - F.lit(1e-9))

    def may_link(self, n, i, m, j):
        """Size and position bounds of two postings of one token; the sets differ, so not all shingles are common."""
        return (self.under * F.least(n, m) >= self.over * F.greatest(n, m)) & (F.least(n - i, m - j) >= self.need(n, m)) & (self.need(n, m) <= F.greatest(n, m) - 1)

    def largest(self, n, i):
        """No larger partner can pass this position."""
        return F.floor((self.under * n - (self.over + self.under) * i) / F.lit(float(self.over)) + F.lit(1e-9))

    def near(self, apart: str) -> str:
        """Whether a symmetric difference is one of linked sets."""
        return f"{self.over + self.under} * {apart} <= {self.under - self.over} * (nx + ny)"


RULE = Rule()
BLOOM_BITS = 23
#: Rounds of comparisons with leaders, and how many leaders a set is compared with in each.
LEADERS = (1, 8)
#: A shingle in more sets than this has its list split.
HOT_ROWS = 1 << 16
NO_ID = -(1 << 63)
#: Fingerprints of the pairs that are compared at once.
PAIR_SHINGLES = 1 << 20


def shingle_sets(column, size: int = RULE.shingle) -> list[np.ndarray]:
    """Each row's distinct shingle fingerprints, ascending."""
    data, off = text_buffers(column)
    starts, ends, first = word_bounds(data, off)
    w = hash_words(LOWER[data], starts, ends)
    h = w
    for k in range(1, size):
        h = join_hash(h[:-1], w[k:]) if len(w) > k else h[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(h[a : b - size + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            whole = mix64(w[a : a + 1] + np.uint64(b - a))
            for k in range(a + 1, b):
                whole = join_hash(whole, w[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, independent of its order."""
    a = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix64(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _docs(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, and the set's signature of every row."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(col(batch, "text"), size)
            sig = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in sig], pa.int64()), pa.array([b for _, b in sig], pa.int64())], names=["doc_id", "n", "hi", "lo"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, hi long, lo long")


def _records(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Keys without the bits that name the bucket, and their counts up to 255: five bytes each."""
    return records_of((keys >> np.uint64(32 - bits)).astype("<u4"), np.minimum(counts, 255).astype(np.uint8))


def answer_rarity(records, sender):
    """For each key the bit length of the number of sets that have it."""
    u, inverse = np.unique(column_of(records, 0, "<u4"), return_inverse=True)
    return np.frexp(np.bincount(inverse, records[:, 4], len(u)))[1].astype(np.uint8)[inverse], None


class BatchSets:
    """A batch's different sets, and the distinct shingles in them."""

    def __init__(self, rows: pa.Table, size: int = RULE.shingle):
        self.sets: dict[tuple[int, int], np.ndarray] = {}
        for s in shingle_sets(rows["text"], size):
            if len(s):
                self.sets.setdefault(signature(s), s)
        whole = np.concatenate(list(self.sets.values())) if self.sets else np.zeros(0, np.uint64)
        self.keys, self.which, self.counts = np.unique(whole, return_inverse=True, return_counts=True)

    def messages(self, batch: int, bits: int) -> pa.Table:
        return messages_of(self.keys, batch, bits, _records(self.keys, self.counts, bits))

    def rarity(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        return answers[0][self.which] if len(self.keys) else np.zeros(0, np.uint8)


def _postings(batches: Batches, replies: DataFrame, hot_rows: int, rule: Rule) -> DataFrame:
    """Prefix postings of all sets, without shingles that no other set has."""
    hot_bits = max(0, hot_rows.bit_length() - 1)

    def run(rows: pa.Table, answers) -> pa.Table:
        batch = BatchSets(rows, rule.shingle)
        rank, at = batch.rarity(answers), 0
        token, hi, lo, size, pos, piece = [], [], [], [], [], []
        for sig, s in batch.sets.items():
            n = len(s)
            r = rank[at : at + n].astype(np.uint64)
            at += n
            key = (r << np.uint64(58)) | (s >> np.uint64(6))
            order = np.argsort(key)[: rule.prefix_size(n)]
            place = np.flatnonzero(r[order] > 1)
            order = order[place]
            token.append(key[order].view(np.int64))
            spread = np.left_shift(1, np.maximum(r[order].astype(np.int64) - 1 - hot_bits, 0))
            piece.append(np.where(spread > 1, abs(sig[0]) % spread + 1, 0))
            hi.append(np.full(len(order), sig[0]))
            lo.append(np.full(len(order), sig[1]))
            size.append(np.full(len(order), n))
            pos.append(place)
        arrays = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (token, hi, lo, size, pos, piece)]
        return pa.table([pa.array(a) for a in arrays], names=["token", "hi", "lo", "n", "pos", "piece"])

    return batches.ask(run, replies, "token long, hi long, lo long, n long, pos long, piece long")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Postings of tokens that several classes have, one each; of split lists all postings."""

    def run(batches):
        held: list[np.ndarray] = []  # the list that is being read, cut to two postings once known to be alone
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack([batch.column(i).to_numpy() for i in range(6)])
            if held:
                m = np.concatenate([held[0], m], 1)
            new = np.append(True, (m[0, 1:] != m[0, :-1]) | (m[5, 1:] != m[5, :-1]))
            same = np.append(False, ~new[1:] & (m[1, 1:] == m[1, :-1]) & (m[2, 1:] == m[2, :-1]))
            m, new = m[:, ~same], new[~same]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, m.shape[1]))
            good = np.repeat((size > 1) | (m[5, begin] > 0), size)
            # The last list may go on: its last posting is held back, marked as part of a longer list by repeating the one before.
            tail = 1 if size[-1] == 1 else 2
            out = good.copy()
            if held and held[0].shape[1] == 2:
                out[0] = False  # sent already
            out[-1] = False
            keep_back = m[:, -tail:].copy()
            held = [keep_back]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in m[:5, out]], names=["token", "hi", "lo", "n", "pos"])
        if held and (held[0].shape[1] == 2 or held[0][5, -1] > 0):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0][:5, -1:]], names=["token", "hi", "lo", "n", "pos"])

    dealt = postings.repartition(partitions(postings.sparkSession), "token", "piece").sortWithinPartitions("token", "piece", "hi", "lo")
    return dealt.mapInArrow(run, "token long, hi long, lo long, n long, pos long")


def _bloom(ids: DataFrame) -> np.ndarray:
    def run(batches):
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            bits[mix64(x) >> np.uint64(64 - BLOOM_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << BLOOM_BITS >> 3, np.uint8)
    for r in ids.repartition(4).mapInArrow(run, "bits binary").collect():
        total |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return np.unpackbits(total).astype(bool)


class SetStore:
    """Sets of the candidate classes, bucketed by node; `compare` gives exact overlaps."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int):
        spark = docs.sparkSession
        rep = F.coalesce("rep", F.lit(NO_ID))
        bloom = spark.sparkContext.broadcast(_bloom(nodes.select(rep.alias("rep"))))  # 2^BLOOM_BITS bits

        def run(batches):
            bits = bloom.value
            for batch in slices(batches, "text"):
                ids = col(batch, "doc_id").to_numpy()
                maybe = batch.filter(pa.array(bits[mix64(ids.view(np.uint64)) >> np.uint64(64 - BLOOM_BITS)]))
                sets = shingle_sets(col(maybe, "text"), size)
                sig = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([col(maybe, "doc_id"), pa.array([a for a, _ in sig], pa.int64()), pa.array([b for _, b in sig], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "hi", "lo", "shingles"])

        some = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(run, "rep long, hi long, lo long, shingles binary")
        found = some.join(nodes.select("node", rep.alias("rep"), "hi", "lo"), ["rep", "hi", "lo"]).groupBy("node").agg(F.first("shingles").alias("shingles"))
        name = f"sets_{uuid.uuid4().hex[:12]}"
        parts = partitions(spark)
        found.repartition(parts, "node").write.format("parquet").option("path", shared_dir(spark, name)).bucketBy(parts, "node").sortBy("node").saveAsTable(name)
        MADE.append(f"table:{name}")
        self.table = spark.table(name)

    def compare(self, pairs: DataFrame) -> DataFrame:
        """pairs (x, nx, y, ny) with their symmetric difference; written."""

        def run(batches):
            for batch in batches:
                nx, ny = col(batch, "nx").to_numpy(), col(batch, "ny").to_numpy()
                whole = np.append(0, np.cumsum(nx + ny))  # a set is as many fingerprints as its size
                i, n = 0, batch.num_rows
                while i < n:
                    j = max(int(np.searchsorted(whole, whole[i] + PAIR_SHINGLES, "right")) - 1, i + 1)
                    part = batch.slice(i, j - i)
                    common = [len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True)) for a, b in zip(col(part, "a"), col(part, "b"), strict=True)]
                    yield pa.RecordBatch.from_arrays([col(part, c) for c in ("x", "nx", "y", "ny")] + [pa.array(nx[i:j] + ny[i:j] - 2 * np.array(common, np.int64))], names=["x", "nx", "y", "ny", "apart"])
                    i = j

        left = self.table.select(F.col("node").alias("x"), F.col("shingles").alias("a"))
        right = self.table.select(F.col("node").alias("y"), F.col("shingles").alias("b"))
        both = pairs.join(left, "x").join(right, "y").select("x", "nx", "y", "ny", "a", "b")
        return keep(both.mapInArrow(run, "x long, nx long, y long, ny long, apart long"), "compared")


def _share_enough(pairs: DataFrame, prefixes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that share as many prefix shingles as linked sets must.

    Common shingles up to the end of the prefix that ends first lie in both
    prefixes; beyond it that set has ceil(n * over / under) - 1 shingles left.
    """
    a = prefixes.select(F.col("node").alias("x"), F.col("tokens").alias("a"))
    b = prefixes.select(F.col("node").alias("y"), F.col("tokens").alias("b"))
    nx, ny = F.col("nx"), F.col("ny")
    need = rule.need(nx, ny) - F.ceil(rule.over * F.greatest(nx, ny) / F.lit(float(rule.under)) - F.lit(1e-9)) + 1
    both = pairs.join(a, "x").join(b, "y").where(F.size(F.array_intersect("a", "b")) >= need)
    return both.select("x", "nx", "y", "ny")


def join_sets(docs: DataFrame, hot_rows: int = HOT_ROWS, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows without a word have an empty set and are linked with nothing; null
    text counts as empty; a null doc_id takes part, and a component's id is its
    smallest id that is not null; repeated rows are in one class; rows that
    share an id but not a text are separate; an empty table gives no rows.
    """
    batches = Batches(docs.select("doc_id", "text"))
    bits = batches.bits
    docs = batches.table
    rows = keep(_docs(docs, rule.shingle), "shingled")
    classes = rows.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"))
    replies = batches.settle(batches.ask(lambda t, _: BatchSets(t, rule.shingle).messages(t["batch_id"][0].as_py(), bits), None), answer_rarity, 5, 0)
    lists = keep(_shared_lists(_postings(batches, replies, hot_rows, rule)), "lists")
    nodes = keep(lists.select("hi", "lo").distinct().join(classes, ["hi", "lo"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = None
    if not nodes.isEmpty():
        links = _links(docs, nodes, keep(lists.join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("token", "node", "n", "pos"), "postings"), rule)
    best = nodes.select("hi", "lo", "n", "rep").limit(0).withColumn("least", F.col("rep")).drop("rep")
    if links is not None:
        comp = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
        member = nodes.join(comp, "node").select("hi", "lo", "n", "rep", "comp")
        best = member.join(member.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("hi", "lo", "n", "least")
    named = classes.join(best, ["hi", "lo", "n"], "left").select("hi", "lo", "n", F.coalesce("least", "rep").alias("component"))
    out = rows.join(named.hint("merge"), ["hi", "lo", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _links(docs: DataFrame, nodes: DataFrame, postings: DataFrame, rule: Rule) -> DataFrame | None:
    """Links that connect all linked classes, as (x, y)."""
    store = SetStore(docs, nodes, rule.shingle)
    compared: DataFrame | None = None
    comp: DataFrame | None = None

    def labelled():
        if comp is None:
            return postings.withColumn("comp", F.col("node"))
        return postings.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    prefixes = keep(postings.groupBy("node").agg(F.collect_list("token").alias("tokens")), "prefixes")  # at most a prefix a row
    for k, most in enumerate(LEADERS):
        now = labelled().withColumn("block", rule.block(F.col("n"), k / len(LEADERS)))
        # Rare shingles come first, so a set whose shared ones start early has little of its own:
        # such a central set leads, at first over all of a list, later over a quarter of it.
        out = F.lit(0) if k == 0 else (F.pmod(F.xxhash64("node", "token", F.lit(k)), F.lit(4)) > 0).cast("int")
        first = F.struct(out.alias("out"), (F.col("pos") / F.col("n")).alias("own"), F.xxhash64("node").alias("h"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"))
        leaders = now.groupBy("token", "block").agg(F.min(first).alias("l"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token", "block", "l.*")
        met = now.join(leaders.hint("merge"), ["token", "block"]).where((F.col("comp") != F.col("cy")) & rule.may_link(F.col("n"), F.col("pos"), F.col("ny"), F.col("py")))
        tally = met.groupBy(F.col("node").alias("x"), F.col("n").alias("nx"), "y", "ny").agg(F.count(F.lit(1)).alias("c"))
        at = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))
        pairs = tally.withColumn("at", at).where(F.col("at") <= most).select("x", "nx", "y", "ny")
        new = store.compare(_share_enough(pairs, prefixes, rule))
        compared = new if compared is None else compared.unionByName(new)
        comp = components(compared.where(rule.near("apart")).select(F.col("x").alias("u"), F.col("y").alias("v")))
        if k == 0:
            near = new
    # What is left: pairs of different components whose postings may link, read block by block.
    left = keep(labelled().where("comp is not null"), "left")
    mixed = left.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    left = left.join(mixed.hint("merge"), "token")
    n, i = F.col("n"), F.col("pos")
    most = rule.largest(n, i)
    probe = left.where(most >= n).select("token", F.col("node").alias("x"), n.alias("nx"), i.alias("px"), F.col("comp").alias("cx"), F.explode(F.sequence(rule.block(n), rule.block(most))).alias("block"))
    index = left.select("token", F.col("node").alias("y"), n.alias("ny"), i.alias("py"), F.col("comp").alias("cy"), rule.block(n).alias("block"))
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    open_pairs = probe.join(index, ["token", "block"]).where(ordered & (F.col("cx") != F.col("cy")) & rule.may_link(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"))).select("x", "nx", "y", "ny").distinct()
    known = compared.select("x", "y").unionByName(compared.select(F.col("y").alias("x"), F.col("x").alias("y")))
    open_pairs = keep(_share_enough(open_pairs, prefixes, rule).join(known, ["x", "y"], "left_anti"), "open")
    near = near.select(F.col("x").alias("node"), F.col("y").alias("via"), "apart")  # one leader a set
    dx = near.select(F.col("node").alias("x"), "via", F.col("apart").alias("ax"))
    dy = near.select(F.col("node").alias("y"), "via", F.col("apart").alias("ay"))
    derived = open_pairs.join(dx, "x").join(dy, ["y", "via"]).groupBy("x", "nx", "y", "ny").agg(F.min(F.col("ax") + F.col("ay")).alias("most"), F.max(F.abs(F.col("ax") - F.col("ay"))).alias("least"))
    settled = keep(derived.where(f"{rule.near('most')} or not ({rule.near('least')})"), "derived")
    new = store.compare(open_pairs.join(settled.select("x", "y"), ["x", "y"], "left_anti"))
    links = compared.unionByName(new).where(rule.near("apart")).select("x", "y").unionByName(settled.where(rule.near("most")).select("x", "y"))
    return keep(links.distinct(), "links")


def keep_one(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """One row of each component: that of its smallest id, all columns kept.

    Rows without a word, and rows whose component has no id, all stay; of rows
    that repeat an id and a text one stays.
    """
    joined = join_sets(docs, rule=rule)
    stay = joined.where("component_id is null or doc_id = component_id").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct()
    # All columns go into one struct, so that none can clash with a name used here.
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(stay.hint("merge"), "doc_id", "left_semi")
    at = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(1)))
    kept = kept.withColumn("at", at).where(f"at = 1 or doc_id = {NO_ID}")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
