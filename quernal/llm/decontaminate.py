"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by an item if some window of the item's word count
has a weighted 5-word-shingle similarity (sum of minima over sum of maxima of
the shingles' weighted counts) of at least 0.8 with it.  Weights are the
shingles' byte lengths.  Windows are fingerprinted with a 128-bit SimHash from
the same weighted shingles.  The fingerprints of the items are indexed by
RADIUS + 1 blocks of bits: by the pigeonhole rule two fingerprints within
RADIUS bits agree in at least one block, so the index returns every item within
the radius.  What it returns is checked by the exact similarity.

Windows without a single shingle of any item have similarity 0 with all items
and are not fingerprinted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, col, hash_words, join_hash, mix64, slices, text_buffers, word_bounds

WORDS = 5
SIMILARITY = 0.8
BITS = 128
RADIUS = 40
MAX_ITEM_BYTES = 256 << 20
HIT = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def shingle_rows(words: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and weight of the shingle starting at each word, and which starts are whole.

    A row with fewer than WORDS words has one shingle, all of it.
    """
    n = len(words)
    run = np.append(0, np.cumsum(sizes))
    h, count = words.copy(), np.diff(first)
    for k in range(1, WORDS):
        h[: n - k] = join_hash(h[: n - k], words[k:])
    stop = np.repeat(first[1:], count)
    whole = np.arange(n) + WORDS <= stop
    for i in first[:-1][(count > 0) & (count < WORDS)]:
        joined = words[i : i + 1]
        for k in range(i + 1, stop[i]):
            joined = join_hash(joined, words[k : k + 1])
        h[i], whole[i] = joined[0], True
    return h, run[np.minimum(np.arange(n) + WORDS, stop)] - run[:-1], whole


def _signs(h: np.ndarray) -> np.ndarray:
    """+1/-1 for each of the BITS bits of each hash."""
    halves = np.stack([mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix64(h + np.uint64(0x632BE59BD9B4E019))], 1)
    bits = np.unpackbits(halves.view(np.uint8).reshape(len(h), 16), axis=1)
    return bits.astype(np.int8) * 2 - 1


def fingerprint(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return (weight.astype(np.float64) @ _signs(h) > 0).astype(np.uint8)


class ItemIndex:
    """Items' shingles, and their fingerprints under RADIUS + 1 blocks of bits."""

    def __init__(self, ids, texts):
        self.ids, self.n_words, self.shingles, prints = [], [], [], []
        data, off = text_buffers(pa.array(texts, pa.string()))
        starts, ends, first = word_bounds(data, off)
        words = hash_words(LOWER[data], starts, ends)
        h, weight, whole = shingle_rows(words, ends - starts, first)
        for i, item in enumerate(ids):
            a, b = first[i], first[i + 1]
            if a == b or item is None:
                continue
            pick = np.flatnonzero(whole[a:b]) + a
            u, inverse = np.unique(h[pick], return_inverse=True)
            self.ids.append(item)
            self.n_words.append(int(b - a))
            self.shingles.append((u, np.bincount(inverse, weight[pick])))
            prints.append(fingerprint(h[pick], weight[pick]))
        self.prints = np.array(prints, np.uint8).reshape(len(prints), BITS)
        self.known = np.unique(np.concatenate([h for h, _ in self.shingles])) if prints else np.zeros(0, np.uint64)
        self.common = np.zeros(1 << 20, bool)
        self.common[self.known >> np.uint64(44)] = True
        self.edges = np.linspace(0, BITS, RADIUS + 2).astype(int)
        self.blocks: list[dict[bytes, np.ndarray]] = []
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            of: dict[bytes, list[int]] = {}
            for i, p in enumerate(self.prints):
                of.setdefault(p[a:b].tobytes(), []).append(i)
            self.blocks.append({k: np.array(v) for k, v in of.items()})
        self.by_size: dict[int, np.ndarray] = {n: np.flatnonzero(np.array(self.n_words) == n) for n in set(self.n_words)}
        # Which known shingles the items of each size have.
        self.of_size = {n: np.isin(self.known, np.concatenate([self.shingles[i][0] for i in items])) for n, items in self.by_size.items()}

    def within(self, p: np.ndarray) -> np.ndarray:
        """All items whose fingerprint lies within RADIUS bits."""
        found = [of[k] for (a, b), of in zip(zip(self.edges[:-1], self.edges[1:], strict=True), self.blocks, strict=True) if (k := p[a:b].tobytes()) in of]
        if not found:
            return np.zeros(0, np.int64)
        some = np.unique(np.concatenate(found))
        return some[(self.prints[some] != p).sum(1) <= RADIUS]

    def similarity(self, item: int, h: np.ndarray, weight: np.ndarray) -> float:
        u, inverse = np.unique(h, return_inverse=True)
        mine = np.bincount(inverse, weight)
        other, theirs = self.shingles[item]
        _, a, b = np.intersect1d(u, other, assume_unique=True, return_indices=True)
        both = np.minimum(mine[a], theirs[b]).sum()
        return float(both / (mine.sum() + theirs.sum() - both))


def search(index: ItemIndex, column) -> list[tuple[int, int, float, int, int]]:
    """(row, item id, best similarity, start word, words) of every contaminated row."""
    data, off = text_buffers(column)
    starts, ends, first = word_bounds(data, off)
    if not len(starts) or not len(index.ids):
        return []
    words = hash_words(LOWER[data], starts, ends)
    h, weight, whole = shingle_rows(words, ends - starts, first)
    near = np.flatnonzero(index.common[h >> np.uint64(44)] & whole)
    at = np.minimum(np.searchsorted(index.known, h[near]), len(index.known) - 1)
    right = index.known[at] == h[near]
    hits, of = near[right], at[right]
    if not len(hits) and min(index.by_size) >= WORDS:
        return []
    run = np.append(0, np.cumsum(np.where(whole, weight, 0)))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}

    def check(i, r, n, items, shingles, weights):
        """Items of n words that the index finds for a window and the exact similarity confirms."""
        for item in index.within(fingerprint(shingles, weights)):
            if item in items and (s := index.similarity(item, shingles, weights)) >= SIMILARITY:
                k = (int(r), int(index.ids[item]))
                if k not in best or (-s, i) < (-best[k][0], best[k][1]):
                    best[k] = (s, int(i), n)

    bytes_to = np.append(0, np.cumsum(ends - starts))
    for n, items in index.by_size.items():
        wanted = set(items.tolist())
        if n < WORDS:  # such an item is one shingle of all its words
            short = words.copy()
            for k in range(1, n):
                short[: len(words) - k] = join_hash(short[: len(words) - k], words[k:])
            row_end = np.repeat(first[1:], np.diff(first))
            for i in np.flatnonzero((np.arange(len(words)) + n <= row_end) & np.isin(short, index.known)):
                check(i, np.searchsorted(first, i, "right") - 1, n, wanted, short[i : i + 1], bytes_to[i + n : i + n + 1] - bytes_to[i])
            continue
        mine = hits[index.of_size[n][of]]
        if not len(mine):
            continue
        row = np.searchsorted(first, mine, "right") - 1
        # Windows of n words over some hit start between n - WORDS words before it and the hit.
        lo = np.maximum(mine - max(0, n - WORDS), first[row])
        hi = np.maximum(np.minimum(mine, first[row + 1] - n), first[row])
        # Hits ascend, so each range adds the starts beyond the one before.
        lo[1:] = np.maximum(lo[1:], np.maximum.accumulate(hi)[:-1] + 1)
        size = np.maximum(hi - lo + 1, 0)
        begin = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        begin_row = np.repeat(row, size)
        stop = np.minimum(begin + n, first[begin_row + 1])
        last = np.maximum(stop - WORDS + 1, begin + 1)
        # A window can reach the similarity only if its hits weigh SIMILARITY of what it holds.
        run_hit = np.append(0, np.cumsum(weight[mine]))
        got = run_hit[np.searchsorted(mine, last)] - run_hit[np.searchsorted(mine, begin)]
        dense = got >= SIMILARITY * (run[last] - run[begin])
        for i, r, e in zip(begin[dense], begin_row[dense], last[dense], strict=True):
            pick = np.flatnonzero(whole[i:e]) + i
            if len(pick):
                check(i, r, n, wanted, h[pick], weight[pick])
    return [(r, item, s, int(i - first[r]), n) for (r, item), (s, i, n) in best.items()]


def load_items(benchmark: DataFrame, most: int = MAX_ITEM_BYTES):
    """The benchmark's items on the driver, in blocks of about half of `most` bytes, one after the other."""
    items = benchmark.select("item_id", "text").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // most)) if size > most else 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = (items.where(of == k) if blocks > 1 else items).orderBy("item_id", "text").collect()
        yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """One row per document row and item it contains, with the best window.

    Words are compared with A-Z lower-cased.  Null or empty texts and items and
    items without an id match nothing; repeated documents are reported one by
    one; texts shorter than an item are compared whole; an empty table gives no
    rows; other columns are ignored.  A benchmark of over `most` bytes is taken in
    blocks, each against all documents.
    """
    spark, found = docs.sparkSession, None
    for items in load_items(benchmark, most):
        index = spark.sparkContext.broadcast(items)  # a block of at most about MAX_ITEM_BYTES
        part = docs.select("doc_id", "text").mapInArrow(_searcher(index), HIT)
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(index):
    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            ids = col(batch, "doc_id").to_pylist()
            found = search(index.value, col(batch, "text"))
            cols = list(zip(*((ids[r], *rest) for r, *rest in found), strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in HIT.split(", ")])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """Only the rows that contain no item, all columns kept; null cases and blocks as above."""
    for items in load_items(benchmark, most):
        docs = docs.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


def _cleaner(index):
    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            good = np.ones(batch.num_rows, bool)
            good[[r for r, *_ in search(index.value, col(batch, "text"))]] = False
            yield batch.filter(pa.array(good))

    return run
