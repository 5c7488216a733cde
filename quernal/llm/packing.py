"""Sum-of-squares online packing of token sequences.

Each document is tokenised whole and closed with one end id.  Full windows are
cut off at once; the rest is placed online into the fill level for which the
sum over levels of (count of partially filled windows)^2 becomes smallest; the
counts live in one level array.  Every task packs the rows it reads, so no row
moves and no group can grow hot.  What a task leaves open is cut and closed at
its end: all windows but the last become full, and the last rest becomes
windows whose fills are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, slices

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the splitting pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(path: str):
    """Encoder with the vocabulary and added tokens of a byte-level BPE file; ranks are its ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(code[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: The fast encoder's pattern cannot match a longer run of white space.
LONG_SPACE = re.compile(r"\s{100000}")


@cache
def plain_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of_text(path: str, text: str) -> list[int]:
    """The file's ids of a whole text; texts with very long white space go to the plain encoder."""
    if len(text) >= 100_000 and LONG_SPACE.search(text):
        return plain_encoder(path).encode(text, add_special_tokens=False).ids
    return encoder(path).encode(text, allowed_special="all")


class LevelPacker:
    """Open windows by fill level; `place` returns the window and offset of a piece."""

    def __init__(self, window: int = WINDOW, first_id: int = 0):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[tuple[int, list]]] = defaultdict(list)

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int, piece) -> tuple[int, list] | None:
        """Put a piece of `size` < window ids; the filled window is returned once full."""
        w, n = self.window, self.count
        rise = 2 * n[size:w] + 1  # change from one more window at level size + h
        cost = np.empty(w - size + 1, dtype=np.int64)
        cost[0] = rise[0]
        cost[1 : w - size] = rise[1:] + 1 - 2 * n[1 : w - size]
        cost[w - size] = 1 - 2 * n[w - size]
        cost[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        best = int(cost.argmin())
        if best:
            seq, held = self.open[best].pop()
            n[best] -= 1
        else:
            seq, held = self.new_id(), []
        held.append(piece)
        if best + size == w:
            return seq, held
        self.open[best + size].append((seq, held))
        n[best + size] += 1
        return None

    def close(self):
        """Cut what is open into full windows, the last rest into powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for _, held in self.open[level] for p in held]
        free = [seq for level in self.open.values() for seq, _ in level]
        self.open.clear()
        self.count[:] = 0
        total = sum(len(p[3]) for p in left)
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at = iter(left)
        piece = None
        for size in sizes:
            held = []
            while size:
                if piece is None:
                    piece = next(at)
                doc, start, tokens, ids = piece
                held.append((doc, start, tokens, ids[:size]))
                piece = (doc, start + size, tokens, ids[size:]) if len(ids) > size else None
                size -= len(held[-1][3])
            yield free.pop() if free else self.new_id(), held


def _rows(out, seq: int, held: list) -> None:
    offset = 0
    for doc, start, tokens, ids in held:
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, seq, offset))
        offset += len(ids)


def _flush(out):
    cols = list(zip(*out, strict=True)) if out else [[]] * 7
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
    out.clear()
    return batch


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Null or empty text is a document of the end id alone; null and repeated
    doc_ids are packed like any row; an empty table gives no rows; other
    columns are ignored.  Sequence ids are unique, not dense.
    """

    def run(batches):
        from pyspark import TaskContext

        packer = LevelPacker(window, TaskContext.get().partitionId() << 32)
        out: list = []
        for batch in slices(batches, "text"):
            for doc, text in zip(col(batch, "doc_id").to_pylist(), col(batch, "text").to_pylist(), strict=True):
                ids = np.array([*ids_of_text(vocabulary, text or ""), END_ID], dtype="<u4")
                n, start = len(ids), 0
                while n - start >= window:
                    _rows(out, packer.new_id(), [(doc, start, n, ids[start : start + window])])
                    start += window
                if start < n and (full := packer.place(n - start, (doc, start, n, ids[start:].copy()))):
                    _rows(out, *full)
            if len(out) > 20_000:
                yield _flush(out)
        for seq, held in packer.close():
            _rows(out, seq, held)
        yield _flush(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
