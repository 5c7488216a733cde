"""Gated recurrent language model over words, with a class-factored softmax.

A text is its words with A-Z lower-cased, then one end token.  The model reads
token after token with a GRU; P(token) = P(class | state) * P(slot | class).
Every class has CLASS_SIZE slots.  The TOP commonest tokens have a slot each, in
classes by frequency.  All other known tokens share slots by magnitude of their
count and a hash of their last two bytes, four magnitudes a class; within a
shared slot a token's share is the smoothed count's.  One last class stands for
every unknown token.  So the model is a distribution over the V known tokens and
one unknown.  Counts are taken over all training texts.

Parameters are trained by truncated backpropagation through time in numpy, on
every training text: the texts are dealt over ROUNDS rounds; in a round each
task trains on the stream of all its texts from common parameters, and the
results are averaged, weighted by tokens, in a tree.  A training token's slot is
that of its count less one (leave one out), so that tokens seen once teach the
unknown class.

Scoring carries each document's state across windows from its first token to
its last, whatever its length.  A task steps all texts it holds together, so
that the longest ones of many batches share the steps that only they have left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hash_words, one_blas_thread, shared_dir, text_buffers, word_bounds
from .exchange import Batches, column_of, messages_of, records_of

TOP, CLASS_SIZE = 4096, 64
BINS, ENDINGS = 12, 16
TAIL = BINS * ENDINGS
UNKNOWN = TOP + TAIL
#: Classes with slots; the unknown token is one more class.
FULL = UNKNOWN // CLASS_SIZE
CLASSES = FULL + 1
INPUTS = UNKNOWN + 1
EMBED, HIDDEN = 16, 24
FOLDS = 10
ROUNDS = 3
LANES, SPAN = 256, 32
RATE, CLIP = 0.02, 1.0
SMOOTH = 0.1
#: Stands where a lane has no token left.
NO_GOAL = -1
#: Tokens that are scored at once, rows that step side by side, and tokens of one task that are held.
AT_ONCE, SIDE, TOGETHER = 1 << 15, 1 << 12, 1 << 23
#: How many results are added up by one task of the reducing tree.
FAN = 32
END_KEY = np.uint64(0xE2D0_0000_0000_0000)
#: A key is a candidate for the top list if its count is at least bytes / COMMON.
COMMON = 1 << 18
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def remainder(doc_id, k: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k


class Tokens:
    """A batch's token keys in order, one end after each row's words.

    A key is the word's fingerprint with its low bits replaced by a hash of the
    word's last two bytes.
    """

    def __init__(self, rows: pa.Table):
        data, off = text_buffers(rows["text"])
        data = LOWER[data]
        starts, ends, first = word_bounds(data, off)
        h = hash_words(data, starts, ends)
        last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
        before = data[np.maximum(ends - 2, starts)].astype(np.uint64) if len(ends) else last
        ending = ((last * np.uint64(31) + before) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
        word = (h & ~np.uint64(ENDINGS - 1)) | ending
        n = np.diff(first)
        self.first = np.append(0, np.cumsum(n + 1))
        self.keys = np.full(self.first[-1], END_KEY, dtype=np.uint64)
        inner = np.ones(len(self.keys), bool)
        inner[self.first[1:] - 1] = False
        self.keys[inner] = word
        self.ids = rows["doc_id"].to_pylist()
        self.fold = np.array([remainder(i, FOLDS) for i in self.ids], dtype=np.int64)
        self.row = np.repeat(np.arange(len(n)), n + 1)
        self.distinct, self.which = np.unique(self.keys, return_inverse=True)

    def messages(self, batch: int, bits: int) -> pa.Table:
        count = np.bincount(self.which, self.fold[self.row] != 0, len(self.distinct)).astype("<u4")
        return messages_of(self.distinct, batch, bits, records_of(self.distinct.astype("<u8"), count))

    def counts(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Training count of each distinct key."""
        return np.ascontiguousarray(answers[0]).view("<i8")


def _bin(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(count, 1).astype(np.float64))[1] - 1, BINS - 1)


def tail_class(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Class among the tail's, TAIL for unknown."""
    k = _bin(count) * ENDINGS + (keys & np.uint64(ENDINGS - 1)).astype(np.int64)
    return np.where(count > 0, k, TAIL)


def _stats(keys: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """Types, tokens, and per tail class types, tokens, left-one-out tokens; then common keys and counts."""
    seen = count > 0
    k, c = keys[seen], count[seen]
    own, out = tail_class(k, c), tail_class(k, c - 1)
    head = np.concatenate([[len(c), c.sum()], np.bincount(own, minlength=TAIL + 1), np.bincount(own, c, TAIL + 1), np.bincount(out, c, TAIL + 1)]).astype(np.int64)
    big = c >= least
    return np.concatenate([head, k[big].view(np.int64), c[big]])


HEAD = 2 + 3 * (TAIL + 1)


def answer_counts(least: int):
    def answer(records, sender):
        keys, part = column_of(records, 0, "<u8"), column_of(records, 8, "<u4")
        u, inverse = np.unique(keys, return_inverse=True)
        count = np.bincount(inverse, part, len(u)).astype(np.int64)
        return count[inverse].astype("<i8"), _stats(u, count, least).tobytes()

    return answer


def reduce_tree(rows: DataFrame, merge, schema: str) -> list:
    """`merge(payload rows)` within every task, then over FAN tasks' results at a time; few rows are collected."""

    def run(batches):
        yield from merge(batches)

    rows = rows.mapInArrow(run, schema)
    left = rows.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        rows = rows.repartition(left).mapInArrow(run, schema)
    return rows.collect()


def _add_stats(parts) -> np.ndarray:
    head, top = np.zeros(HEAD, np.int64), np.zeros((2, 0), np.int64)
    for x in parts:
        head += x[:HEAD]
        top = np.concatenate([top, x[HEAD:].reshape(2, -1)], 1)
        if top.shape[1] > 4 * TOP:
            top = _most(top)
    return np.concatenate([head, _most(top).ravel()])


def _most(top: np.ndarray) -> np.ndarray:
    return top[:, np.lexsort((top[0], -top[1]))[:TOP]]


def _sum_stats(rows: DataFrame) -> np.ndarray:
    """Totals of the buckets' statistics."""

    def merge(batches):
        total = _add_stats(np.frombuffer(p.as_buffer(), np.int64) for batch in batches for p in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["payload"])

    return _add_stats(np.frombuffer(bytes(r[0]), np.int64) for r in reduce_tree(rows.select("payload"), merge, "payload binary"))


class Vocabulary:
    """Top tokens, tail classes' totals, and each class's left-one-out mass."""

    def __init__(self, stats: np.ndarray):
        self.types, self.tokens = int(stats[0]), int(stats[1])
        types, tokens, loo = stats[2:HEAD].reshape(3, -1).astype(np.float64)
        keys, counts = stats[HEAD:].reshape(2, -1)
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.slot = keys[order], order  # slot: rank by count
        own, out = tail_class(keys, counts), tail_class(keys, counts - 1)
        np.subtract.at(types, own, 1)
        np.subtract.at(tokens, own, counts)
        np.subtract.at(loo, out, counts)
        self.within = tokens + SMOOTH * types  # a shared slot's smoothed total
        self.mass = np.concatenate([np.zeros(TOP), np.maximum(loo, 0)]) + SMOOTH
        self.mass[: len(counts)] += counts

    def inputs(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Input id of each key: its rank in the top list, else its tail class."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        top = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return np.where(top, self.slot[at] if len(self.keys) else 0, TOP + tail_class(keys, count))


def initial(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights, and output biases that give every slot its share of the training tokens."""
    rng = np.random.default_rng(seed)
    f = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
    slots = v.mass[:UNKNOWN].reshape(FULL, CLASS_SIZE)
    classes = np.append(slots.sum(1), v.mass[UNKNOWN:].sum())
    oc, ow = f(HIDDEN + 1, CLASSES, scale=0.01), f(FULL, HIDDEN + 1, CLASS_SIZE, scale=0.01)
    oc[-1] = np.log(classes / classes.sum())
    ow[:, -1] = np.log(slots / slots.sum(1, keepdims=True))
    return {"embed": f(INPUTS, EMBED, scale=0.3), "wx": f(EMBED, 3 * HIDDEN, scale=0.3), "wh": f(HIDDEN, 3 * HIDDEN, scale=0.2), "b": np.zeros(3 * HIDDEN, np.float32), "oc": oc, "ow": ow}


def thirds(x: np.ndarray) -> list[np.ndarray]:
    """The parts for update gate, reset gate and candidate, each laid out on its own."""
    return [np.ascontiguousarray(x[..., k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def cell(x, w, h: np.ndarray):
    """One GRU step: both gates, the candidate's recurrent part, the candidate, the new state."""
    z = h @ w[0]
    z += x[0]
    r = h @ w[1]
    r += x[1]
    u = h @ w[2]
    _sigmoid(z)
    _sigmoid(r)
    c = r * u
    c += x[2]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return z, r, u, c, new


def slots_in_order(target: np.ndarray):
    """Order by class, bounds of each class with slots in it, and slots in that order."""
    k = target >> 6
    order = np.argsort(k.astype(np.uint8), kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(k, minlength=CLASSES)))[: FULL + 1]
    return order, bounds, (target & (CLASS_SIZE - 1))[order[: bounds[-1]]]


#: Logits beyond this are taken for it, which keeps exp in range.
LIMIT = np.float32(60)


def softmax_pick(logits: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the picked columns, and each row's total; logits become their exponentials."""
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    at = logits[np.arange(len(pick)), pick]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return at - np.log(total), total


def softmax_grad(logits: np.ndarray, pick: np.ndarray, size: int) -> None:
    """Logits become the gradient of the mean of -log p over `size` rows."""
    _, total = softmax_pick(logits, pick)
    total *= size
    logits /= total[:, None]
    logits[np.arange(len(pick)), pick] -= np.float32(1 / size)


def _slot_logits(p, state: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Logits within the class; `state` in class order, with a last column of ones."""
    out = np.empty((bounds[-1], CLASS_SIZE), state.dtype)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if a < b:
            np.matmul(state[a:b], p["ow"][k], out=out[a:b])
    return out


def log_probability(p, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of P(class) * P(slot | class) in each state, which may have a last column of ones already."""
    if states.shape[1] == HIDDEN:
        states = np.append(states, np.ones((len(states), 1), np.float32), 1)
    out = softmax_pick(states @ p["oc"], target >> 6)[0].astype(np.float64)
    order, bounds, slot = slots_in_order(target)
    order = order[: bounds[-1]]
    out[order] += softmax_pick(_slot_logits(p, states[order], bounds), slot)[0]
    return out


class Trainer:
    """Truncated backpropagation with Adam over token streams, one after the other."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m1, self.m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        self.step, self.tokens = 0, 0

    def learn(self, stream: np.ndarray) -> None:
        """One stream, cut into lanes that run side by side; a short one has fewer, so that it gets as many steps."""
        n = len(stream) - 1
        if n < 1:
            return
        lanes = max(1, min(LANES, n // 2, max(16, n >> 11)))
        length = -(-n // lanes)
        self.tokens += n
        pad = np.full(lanes * length - n, NO_GOAL)
        source = np.concatenate([stream[:-1], pad * 0]).reshape(lanes, length).T
        goal = np.concatenate([stream[1:], pad]).reshape(lanes, length).T
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t0 in range(0, length, SPAN):
            h = self.window(np.ascontiguousarray(source[t0 : t0 + SPAN]), np.ascontiguousarray(goal[t0 : t0 + SPAN]), h)

    def window(self, src: np.ndarray, dst: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, n = self.p, HIDDEN
        time, lanes = src.shape
        e = p["embed"][src.ravel()]
        w = thirds(p["wh"])
        x = [(e @ wx + b).reshape(time, lanes, n) for wx, b in zip(thirds(p["wx"]), thirds(p["b"]), strict=True)]
        before = np.empty((time, lanes, n), np.float32)
        state = np.ones((time, lanes, n + 1), np.float32)
        saved = []
        for t in range(time):
            before[t] = h
            *kept, h = cell((x[0][t], x[1][t], x[2][t]), w, h)
            saved.append(kept)
            state[t, :, :n] = h
        state, goal = state.reshape(-1, n + 1), dst.ravel()
        if goal.min() == NO_GOAL:
            real = np.flatnonzero(goal != NO_GOAL)
            if not len(real):
                return h
            some, g = self.output(state[real], goal[real])
            d_state = np.zeros((len(goal), n), np.float32)
            d_state[real] = some
        else:
            d_state, g = self.output(state, goal)
        d_state = d_state.reshape(time, lanes, n)
        # Gradients at the gates' and the candidate's sums, and at the candidate's recurrent part.
        dz, dr, dc, du = x[0], x[1], x[2], np.empty_like(x[2])
        back = [np.ascontiguousarray(k.T) for k in w]
        dh = np.zeros((lanes, n), np.float32)
        for t in range(time - 1, -1, -1):
            z, r, u, c = saved[t]
            dh += d_state[t]
            keep = dh * z
            dh -= keep
            v = c * c
            np.subtract(1, v, out=v)
            np.multiply(dh, v, out=dc[t])
            np.subtract(before[t], c, out=c)
            c *= keep
            np.subtract(1, z, out=z)
            np.multiply(c, z, out=dz[t])
            np.multiply(dc[t], r, out=du[t])
            u *= du[t]
            np.subtract(1, r, out=r)
            np.multiply(u, r, out=dr[t])
            keep += dz[t] @ back[0]
            keep += dr[t] @ back[1]
            keep += du[t] @ back[2]
            dh = keep
        flat = before.reshape(-1, n).T
        g["wh"] = np.concatenate([flat @ d.reshape(-1, n) for d in (dz, dr, du)], 1)
        dx = np.concatenate([d.reshape(-1, n) for d in (dz, dr, dc)], 1)
        g["wx"], g["b"] = e.T @ dx, dx.sum(0)
        d_embed = dx @ p["wx"].T
        order = np.argsort(src.ravel().astype(np.uint16), kind="stable")
        ids = src.ravel()[order]
        begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        self.update(g, ids[begin], np.add.reduceat(d_embed[order], begin, axis=0))
        return h

    def output(self, state: np.ndarray, target: np.ndarray):
        """Gradient at the states (without the column of ones) and at both output layers."""
        p, n, size = self.p, HIDDEN, len(target)
        logits = state @ p["oc"]
        softmax_grad(logits, target >> 6, size)
        g = {"oc": state.T @ logits, "ow": np.zeros_like(p["ow"])}
        d_state = logits @ p["oc"][:n].T
        order, bounds, slot = slots_in_order(target)
        order = order[: bounds[-1]]
        inner = state[order]
        logits = _slot_logits(p, inner, bounds)
        softmax_grad(logits, slot, size)
        d_inner = np.empty((len(slot), n), np.float32)
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a < b:
                np.matmul(inner[a:b].T, logits[a:b], out=g["ow"][k])
                np.matmul(logits[a:b], p["ow"][k, :n].T, out=d_inner[a:b])
        d_state[order] += d_inner
        return d_state, g

    def update(self, g: dict[str, np.ndarray], rows: np.ndarray, d_rows: np.ndarray) -> None:
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in (*g.values(), d_rows)))
        scale = np.float32(min(1.0, CLIP / (norm + 1e-9)))
        self.step += 1
        rate = np.float32(RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
        for k, d in g.items():
            m1, m2 = self.m1[k], self.m2[k]
            d *= scale
            m1 += np.float32(0.1) * (d - m1)
            d *= d
            m2 += np.float32(0.01) * (d - m2)
            self.p[k] -= rate * m1 / (np.sqrt(m2) + np.float32(1e-6))
        d_rows = d_rows * scale
        m1 = self.m1["embed"][rows] * np.float32(0.9) + np.float32(0.1) * d_rows
        m2 = self.m2["embed"][rows] * np.float32(0.99) + np.float32(0.01) * d_rows * d_rows
        self.m1["embed"][rows], self.m2["embed"][rows] = m1, m2
        self.p["embed"][rows] -= rate * m1 / (np.sqrt(m2) + np.float32(1e-6))


def train_stream(p: dict[str, np.ndarray], stream: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after one stream."""
    trainer = Trainer(p)
    trainer.learn(stream)
    return trainer.p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _mean(parts) -> tuple[float, np.ndarray] | None:
    total, weight = None, 0.0
    for w, raw in parts:
        x = np.frombuffer(raw, np.float32).astype(np.float64) * w
        total, weight = x if total is None else total + x, weight + w
    return None if total is None else (weight, (total / weight).astype(np.float32))


def _model_rows(weight: float, flat: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([flat.tobytes()], pa.binary())], names=["weight", "p"])


def _average(parts: DataFrame, like):
    """Token-weighted mean of the tasks' parameters."""

    def merge(batches):
        got = _mean((w, p) for batch in batches for w, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if got is not None:
            yield _model_rows(*got)

    got = _mean((r["weight"], bytes(r["p"])) for r in reduce_tree(parts, merge, "weight double, p binary"))
    return like if got is None else unflatten(got[1], like)


def score_rows(p, first: np.ndarray, ids: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
    """Summed log probability of each row's tokens, state carried from window to window.

    Rows step together with those of like length, SIDE at a time.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    gathered, w = thirds(p["embed"] @ p["wx"] + p["b"]), thirds(p["wh"])
    out = np.empty(len(size))
    for k in range(0, len(size), SIDE):
        rows = order[k : k + SIDE]
        out[rows] = _score_side(p, gathered, w, size[rows], first[rows], ids, ids[first[1] - 1], at_once)
    return out


def _score_side(p, gathered, w, size: np.ndarray, begin: np.ndarray, ids: np.ndarray, end, at_once: int) -> np.ndarray:
    """Totals of rows in descending order of size; each is read as if an end token went before it."""
    n, total = HIDDEN, np.zeros(len(size))
    h = cell([g[np.full(len(size), end)] for g in gathered], w, np.zeros((len(size), n), np.float32))[-1]
    t0 = 0
    while t0 < size[0]:
        live = int(np.searchsorted(-size, -t0, "left"))
        span = int(min(size[0] - t0, max(1, at_once // live)))
        t = t0 + np.arange(span)[:, None]
        inside = t < size[:live]
        token = ids[np.where(inside, begin[:live] + t, begin[:live])].astype(np.int64)
        states = np.ones((span, live, n + 1), np.float32)
        h = h[:live]
        for k in range(span):
            states[k, :, :n] = h
            h = cell([g[token[k]] for g in gathered], w, h)[-1]
        lane = np.broadcast_to(np.arange(live), inside.shape)[inside]
        total[:live] += np.bincount(lane, log_probability(p, states[inside], token[inside]), live)
        t0 += span
    return total


def score_texts(docs: DataFrame) -> DataFrame:
    """Per row the base score and the model's log10 probability of the whole text.

    Null text is the end token alone; a null id counts as an empty text for the
    fold; rows that repeat are counted and scored one by one; without training
    tokens every token is unknown; an empty table gives no rows.
    """
    batches = Batches(docs.select("doc_id", "text"))
    bits = batches.bits
    spark = batches.spark
    least = max(1, batches.bytes // COMMON)
    replies = batches.settle(batches.ask(lambda rows, _: Tokens(rows).messages(rows["batch_id"][0].as_py(), bits), None), answer_counts(least), 12, 0)
    vocabulary = Vocabulary(_sum_stats(replies.where("extra")))
    model = initial(vocabulary)
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)  # TOP entries

    def encode(rows: pa.Table, answers) -> pa.Table:
        """A batch's training streams, one a round, and (as round -1) its rows for scoring."""
        t, v = Tokens(rows), shared_vocabulary.value
        count = t.counts(answers)
        n = len(t.ids)
        ids = v.inputs(t.distinct, count)
        tail = (ids >= TOP) & (ids < UNKNOWN)
        share = np.zeros(len(ids))
        share[tail] = np.log((count[tail] + SMOOTH) / v.within[ids[tail] - TOP])
        base = np.log10((count + SMOOTH) / (v.tokens + SMOOTH * (v.types + 1)))
        known = np.bincount(t.row, count[t.which] > 0, n)
        facts = np.stack([np.diff(t.first), known, np.bincount(t.row, base[t.which], n), np.bincount(t.row, share[t.which], n)], 1)
        left_out = v.inputs(t.distinct, count - 1)[t.which].astype("<u2")
        turn = np.array([remainder(i, FOLDS * ROUNDS) // FOLDS if f else ROUNDS for f, i in zip(t.fold, t.ids, strict=True)], dtype=np.int64)[t.row]
        streams = [left_out[turn == k].tobytes() for k in range(ROUNDS)]
        return pa.table(
            [pa.array([-1, *range(ROUNDS)], pa.int32()), pa.array([ids[t.which].astype("<u2").tobytes(), *streams], pa.binary()), pa.array([facts.astype("<f8").tobytes()] + [None] * ROUNDS, pa.binary()), pa.array([t.ids] + [None] * ROUNDS, pa.list_(pa.int64()))],
            names=["round", "ids", "facts", "doc_ids"],
        )

    schema = "round int, ids binary, facts binary, doc_ids array<long>"
    path = shared_dir(spark, "tokens")
    batches.ask(encode, replies.where("not extra"), schema).write.partitionBy("round").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    end = vocabulary.inputs(np.array([END_KEY]), np.array([0])).astype("<u2")
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # a fixed number of parameters

        def learn(parts, shared=shared):
            one_blas_thread()
            trainer = Trainer(shared.value)
            for part in parts:
                for raw in part.column(0):
                    trainer.learn(np.concatenate([end, np.frombuffer(raw.as_buffer(), "<u2")]).astype(np.int64))
            if trainer.tokens:
                yield _model_rows(float(trainer.tokens), flatten(trainer.p))

        model = _average(written.where(F.col("round") == k).select("ids").mapInArrow(learn, "weight double, p binary"), model)

    final = spark.sparkContext.broadcast(model)

    def score(parts):
        one_blas_thread()
        held, tokens = [], 0
        for part in parts:
            for ids, facts, doc_ids in zip(*(part.column(c) for c in ("ids", "facts", "doc_ids")), strict=True):
                held.append((np.frombuffer(ids.as_py(), "<u2"), np.frombuffer(facts.as_py(), "<f8").reshape(-1, 4), doc_ids.as_py()))
                tokens += len(held[-1][0])
                if tokens >= TOGETHER:
                    yield scored(held)
                    held, tokens = [], 0
        if held:
            yield scored(held)

    def scored(held):
        ids, facts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        doc_ids = [i for h in held for i in h[2]]
        size = facts[:, 0].astype(np.int64)
        total = score_rows(final.value, np.append(0, np.cumsum(size)), ids) + facts[:, 3]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array([remainder(i, FOLDS) == 0 for i in doc_ids], pa.bool_()), pa.array(size), pa.array(facts[:, 1].astype(np.int64)), pa.array(np.full(len(size), shared_vocabulary.value.tokens)), pa.array(facts[:, 2]), pa.array(total / np.log(10))],
            names=[x.split()[0] for x in OUT.split(", ")],
        )

    return written.where("round = -1").select("ids", "facts", "doc_ids").mapInArrow(score, OUT)
