"""Repeated passages by level-wise doubling.

The question is which windows of WINDOW words occur in another document.  It is
answered at growing lengths: 4, 8, then the window's 13 words.  At each length
every window that is still a candidate is stood for by the smallest fingerprint
among the sub-windows of that length inside it (equal windows choose the same
one), the distinct ones are looked up over the corpus, and only windows whose
sub-window is repeated across documents go on to twice that length.  When no
candidate survives, the rest of the levels is left out.  At full length
128-bit fingerprints are compared, and each is answered by the smallest
document id that has it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hash_words, join_hash, text_buffers, word_bounds
from .exchange import Batches, column_of, messages_of, records_of

WINDOW = 13
NO_ID = np.iinfo(np.int64).max


def lengths(window: int) -> list[int]:
    """Levels: a quarter of the window (rounded up), doubled up to the window."""
    at = [max(1, -(-window // 4))]
    while at[-1] < window:
        at.append(min(window, at[-1] * 2))
    return at


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of `size` words, built by doubling shorter runs."""
    h, n = words, 1
    while n < size:
        step = min(n, size - n)
        h = join_hash(h[:-step], h[step:]) if len(h) > step else h[:0]
        n += step
    return h


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    n = 1
    while n < size:
        step = min(n, size - n)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        n += step
    return h


class Corpus:
    """One batch's words, and which of its windows are still candidates."""

    def __init__(self, rows: pa.Table, window: int):
        self.window = window
        self.data, self.off = text_buffers(rows["text"])
        self.starts, self.ends, self.first = word_bounds(self.data, self.off)
        ids = rows["doc_id"]
        self.id = np.array([NO_ID if i is None else i for i in ids.to_pylist()], dtype=np.int64)
        self.words = hash_words(self.data, self.starts, self.ends)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        fits = np.arange(len(self.words)) + window <= np.repeat(self.first[1:], counts)
        self.alive = np.flatnonzero(fits)

    def level(self, size: int):
        """Distinct keys of the candidates, each candidate's key, and keys seen in several rows here."""
        value = sliding_min(window_hashes(self.words, size), self.window - size + 1)[self.alive]
        order = np.argsort(value, kind="stable")
        sorted_value = value[order]
        new = np.ones(len(value), bool)
        new[1:] = sorted_value[1:] != sorted_value[:-1]
        begin = np.flatnonzero(new)
        which = np.empty(len(value), np.int64)
        which[order] = np.cumsum(new) - 1
        row = self.row[self.alive][order]
        last = np.append(begin[1:], len(value)) - 1
        several = row[begin] != row[last] if len(value) else np.zeros(0, bool)
        return sorted_value[begin], which, several

    def narrow(self, size: int, answer: np.ndarray) -> None:
        _, which, several = self.level(size)
        self.alive = self.alive[(several | answer.astype(bool))[which]]

    def full(self):
        """Distinct 128-bit keys in order, each candidate's key, and each key's smallest id here."""
        high = window_hashes(self.words, self.window)[self.alive]
        low = window_hashes(hash_words(self.data, self.starts, self.ends, 1), self.window)[self.alive]
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        begin = np.flatnonzero(new)
        which = np.empty(len(high), np.int64)
        which[order] = np.cumsum(new) - 1
        ids = self.id[self.row[self.alive]][order]
        least = np.minimum.reduceat(ids, begin) if len(begin) else ids
        return high[begin], low[begin], which, least

    def replay(self, sizes: list[int], answers: dict[int, np.ndarray]) -> None:
        none = np.zeros(0, np.uint8)  # a batch without candidates has asked nothing
        for k, size in enumerate(sizes):
            self.narrow(size, answers.get(k, none))

    def removed(self, answer: np.ndarray) -> np.ndarray:
        """For each word, whether a window with a smaller document covers it."""
        _, _, which, _ = self.full()
        least = np.ascontiguousarray(answer).view("<i8")
        hit = self.alive[least[which] < self.id[self.row[self.alive]]]
        marks = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + self.window, -1)
        return np.cumsum(marks[:-1]) > 0


KEY48, KEY128 = 6, 24


def _top48(keys: np.ndarray) -> np.ndarray:
    """The upper six bytes of each key."""
    return np.ascontiguousarray((keys >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY48])


def answer_repeated(records, sender):
    """Whether more than one batch has sent a key, a byte each."""
    wide = np.zeros((len(records), 8), np.uint8)
    wide[:, :KEY48] = records
    key = wide.view("<u8").ravel()
    order = np.argsort(key, kind="stable")
    k = key[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    last = np.append(begin[1:], len(k)) - 1
    several = sender[order][begin] != sender[order][last]
    flags = np.empty(len(k), np.uint8)
    flags[order] = np.repeat(several, last - begin + 1)
    return flags, None


def answer_least(records, sender):
    """The smallest document id of each 128-bit key over all batches."""
    high, low, ids = column_of(records, 0, "<u8"), column_of(records, 8, "<u8"), column_of(records, 16, "<i8")
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
    least = np.minimum.reduceat(ids[order], begin)
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(begin, len(h))))
    return out, None


def _messages(rows: pa.Table, answers, window: int, sizes: list[int], bits: int) -> pa.Table:
    c = Corpus(rows, window)
    batch = rows["batch_id"][0].as_py()
    c.replay(sizes[:-1], answers)
    if sizes[-1] < window:
        keys, _, _ = c.level(sizes[-1])
        return messages_of(keys, batch, bits, _top48(keys))
    high, low, _, least = c.full()
    return messages_of(high, batch, bits, records_of(high.astype("<u8"), low.astype("<u8"), least.astype("<i8")))


def _find(docs: DataFrame, window: int):
    """The batches, all answers, and the function that gives a batch's removed words."""
    batches = Batches(docs)
    sizes, bits = lengths(window), batches.bits
    replies: DataFrame | None = None
    done = True
    for k, size in enumerate(sizes):
        part = sizes[: k + 1]
        messages = batches.ask(lambda rows, answers, part=part: _messages(rows, answers, window, part, bits), replies)
        new = batches.settle(messages, *((answer_least, KEY128) if size == window else (answer_repeated, KEY48)), k)
        if new.isEmpty():
            done = False
            break
        replies = new if replies is None else replies.unionByName(new)

    def removed(rows: pa.Table, answers) -> tuple[Corpus, np.ndarray]:
        c = Corpus(rows, window)
        if not done:
            return c, np.zeros(len(c.words), bool)
        c.replay(sizes[:-1], answers)
        return c, c.removed(answers.get(len(sizes) - 1, np.zeros(0, np.uint8)))

    return batches, replies, removed


def kept_words(c: Corpus, gone: np.ndarray, row: int) -> bytes:
    words = c.data[c.off[row] : c.off[row + 1]].tobytes().split()
    out = gone[c.first[row] : c.first[row + 1]]
    return b" ".join(w for w, g in zip(words, out.tolist(), strict=True) if not g) if out.any() else b" ".join(words)


def measure(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: words, words removed, and the SHA-256 of the kept words.

    A word goes if a window of `window` words over it also starts in a document
    with a smaller id.  Null text has no words; rows with equal ids are one
    another's equals (neither is smaller); a null id comes after all others;
    texts shorter than a window keep all words; an empty table gives no rows.
    """
    batches, replies, removed = _find(docs.select("doc_id", "text"), window)

    def run(rows: pa.Table, answers) -> pa.Table:
        c, gone = removed(rows, answers)
        total = np.diff(c.first)
        lost = np.diff(np.append(0, np.cumsum(gone))[c.first])
        digest = [hashlib.sha256(kept_words(c, gone, i)).hexdigest() for i in range(len(total))]
        return pa.table([rows["doc_id"], pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return batches.ask(run, replies, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows; where words went, the text is the kept words joined by a space."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(1).alias("none"))
    batches, replies, removed = _find(docs.select("doc_id", "text", rest.alias("rest")), window)
    kind = batches.table.schema["rest"].dataType.simpleString()

    def run(rows: pa.Table, answers) -> pa.Table:
        c, gone = removed(rows, answers)
        lost = np.diff(np.append(0, np.cumsum(gone))[c.first])
        text = [kept_words(c, gone, i).decode() if n else t for i, (n, t) in enumerate(zip(lost.tolist(), rows["text"].to_pylist(), strict=True))]
        return pa.table([rows["doc_id"], pa.array(text, pa.string()), rows["rest"]], names=["doc_id", "text", "rest"])

    out = batches.ask(run, replies, f"doc_id long, text string, rest {kind}")
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])
